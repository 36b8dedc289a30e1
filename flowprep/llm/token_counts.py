"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE tokenizer works in two stages; both are compiled here into deterministic transducers.

1. The splitting pattern becomes a machine of 13 states over 12 character classes. Each transition says how many
   pieces end there: none, one just before the character, one a character earlier (the machine has looked ahead by
   one), or both. A stream of texts is cut into chunks; every chunk yields a map from each state it may be entered
   in to the state it is left in, all chunks advancing together, one character a step; where all states of a chunk have
   met, which takes a few characters, they go on as one. The maps compose by a parallel prefix scan, which gives each
   chunk its true entry state; a second walk then emits.
2. The merges become a transducer over blocks of eight bytes that is compiled as pieces come: a state is what has been
   read of a piece, a transition is annotated with the tokens it emits. All pieces of a block of texts walk it together.
   A merge can join all that came before, so the count of a piece is no sum over its bytes: transitions inside a piece
   emit nothing, the one that ends it emits its whole count. Pieces that the transducer lacks are merged by their ranks, all
   together, and compiled. Transitions are bounded: a full table becomes the older of two generations, whose pieces move
   on to the new one as they are met, the others are forgotten with it.

Cases: a null or empty text has 0 tokens; very long texts run in blocks of chunks, and a run of one class of any
length is merged in n log n; special strings inside texts count as the one token they are; repeated rows each get a
row; ids of any type and null ids are handed on as they are; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, quoted

# The classes of the splitting pattern 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
LETTER, CLIP, R, V, E, EL, NUMBER, OTHER, QUOTE, BLANK, SPACE, RESET = range(12)
CLASSES = 12
# Its states: the start; in letters, numbers, other signs; after a quote that begins a piece, with r, v, l after it;
# a finished clitic; white space of one or more characters that ends in a blank or in another space.
START, LETTERS, NUMBERS, OTHERS, QUOTED, QUOTE_R, QUOTE_V, QUOTE_L, CLITIC, BLANK_1, BLANK_N, SPACE_1, SPACE_N = range(13)
STATES = 13
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
HERE, BACK = 1, 2

CHUNK = 256
#: Characters after which a chunk's states are looked at: most have met by then.
SETTLE = 12
#: Transitions of a generation at most, half as many as it has slots, and the bytes of a piece that is compiled.
KEPT, KEPT_LENGTH = 1 << 20, 64
#: Ranks of pairs that never merge, and what stands behind a piece's end.
NEVER, NONE = (1 << 31) - 1, (1 << 16) - 1
#: Pieces that walk together.
TOGETHER = 1 << 20


@lru_cache(1)
def character_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[list(WHITE)] = SPACE
    out[0x20] = BLANK
    for chars, k in (("'", QUOTE), ("stmd", CLIP), ("r", R), ("v", V), ("e", E), ("l", EL)):
        for ch in chars:
            out[ord(ch)] = k
    return out


@lru_cache(1)
def machine() -> tuple[np.ndarray, np.ndarray]:
    """Next states and emissions, each flat by state * CLASSES + class."""
    entry = {NUMBER: NUMBERS, OTHER: OTHERS, QUOTE: QUOTED, BLANK: BLANK_1, SPACE: SPACE_1, RESET: START}
    letters = (LETTER, CLIP, R, V, E, EL)
    entry |= dict.fromkeys(letters, LETTERS)
    joined = entry | {QUOTE: OTHERS}  # after a blank, a quote is a sign like any other
    step, emit = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    for state in range(STATES):
        for c in range(CLASSES):
            white, to, out = c in (BLANK, SPACE), entry[c], HERE
            if state == LETTERS and c in letters or state == NUMBERS and c == NUMBER:
                out = 0
            elif state in (OTHERS, QUOTED) and c in (OTHER, QUOTE):
                to, out = OTHERS, 0
            elif state == QUOTED and c in (CLIP, R, V, EL):
                to, out = {CLIP: CLITIC, R: QUOTE_R, V: QUOTE_V, EL: QUOTE_L}[c], 0
            elif (state, c) in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, EL)):
                to, out = CLITIC, 0
            elif state in (QUOTE_R, QUOTE_V, QUOTE_L):  # no clitic: the quote stands alone, the letter begins a word
                out = BACK if c in letters else BACK | HERE
            elif state in (BLANK_1, BLANK_N, SPACE_1, SPACE_N) and white:
                to, out = (BLANK_N if c == BLANK else SPACE_N), 0
            elif state == BLANK_1 and c != RESET:
                to, out = joined[c], 0
            elif state == BLANK_N and c != RESET:
                to, out = joined[c], BACK
            elif state == SPACE_N and c != RESET:
                out = BACK | HERE
            step[state, c], emit[state, c] = to, out
    return step.ravel(), emit.ravel()


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """Where pieces begin in a stream of classes that ends with RESET; the scan over chunks is in the module's text."""
    step, emit = machine()
    n = len(classes)
    rows = -(-n // CHUNK)
    c = np.full(rows * CHUNK, RESET, np.uint8)
    c[:n] = classes
    c = np.ascontiguousarray(c.reshape(rows, CHUNK).T).astype(np.intp)
    wide = step.astype(np.intp) * CLASSES
    maps = np.broadcast_to(np.arange(STATES, dtype=np.intp) * CLASSES, (rows, STATES)).T.copy()  # state-major
    for t in range(SETTLE):
        maps = wide[maps + c[t]]
    met = (maps == maps[0]).all(axis=0)
    one, several = maps[0, met], maps[:, ~met]
    one_c, several_c = c[SETTLE:, met], c[SETTLE:, ~met]
    for t in range(CHUNK - SETTLE):
        one = wide[one + one_c[t]]
        if several.size:
            several = wide[several + several_c[t]]
    maps[:, met], maps[:, ~met] = one, several
    maps //= CLASSES
    reach = 1
    while reach < rows:  # maps[:, i] becomes the composition of chunks 0..i
        maps[:, reach:] = np.take_along_axis(maps[:, reach:], maps[:, :-reach], axis=0)
        reach *= 2
    state = np.zeros(rows, np.intp)
    state[1:] = maps[START, :-1]
    state *= CLASSES
    out = np.empty((CHUNK, rows), np.uint8)
    for t in range(CHUNK):
        at = state + c[t]
        out[t] = emit[at]
        state = wide[at]
    out = out.T.ravel()[:n]
    starts = np.zeros(n + 1, bool)
    starts[:n] = out & HERE > 0
    starts[: n - 1] |= out[1:] & BACK > 0
    starts[0] = True
    return np.flatnonzero(starts[:n])


class Merges:
    """The number of tokens of pieces, by their merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letter = dict(zip(shown, map(chr, shown), strict=True)) | {b: chr(256 + i) for i, b in enumerate(hidden)}

        ids = {ch: b for b, ch in self.letter.items()}
        for a, b in pairs:
            ids.setdefault(a + b, len(ids))
        keys = np.array([ids[a] << 16 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.joined = np.array([ids[a + b] for a, b in pairs], np.int32)  # by rank

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NEVER where it has none."""
        key = left.astype(np.int64) << 16 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def together(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The tokens of short pieces of the bytes: a piece a row, each round joins the first best pair of every row."""
        wide = int(size.max())
        columns = np.arange(wide)
        ids = data[np.minimum(begin[:, None] + columns, len(data) - 1)].astype(np.int32)
        ids[columns >= size[:, None]] = NONE
        ranks = np.full((len(ids), wide), NEVER, np.int32)
        ranks[:, :-1] = self.ranked(ids[:, :-1], ids[:, 1:])
        out, rows = size.astype(np.int64), np.arange(len(ids))
        while True:
            best = ranks.min(axis=1)
            on = best < NEVER
            if not on.any():
                return out
            if not on.all():
                rows, ids, ranks, best = rows[on], ids[on], ranks[on], best[on]
            each, at = np.arange(len(rows)), ranks.argmin(axis=1)
            out[rows] -= 1
            behind = np.minimum(columns + (columns > at[:, None]), wide - 1)  # the right one of the pair goes
            ids = np.take_along_axis(ids, behind, axis=1)
            ids[:, -1] = NONE
            ids[each, at] = self.joined[best]
            ranks = np.take_along_axis(ranks, np.minimum(columns + (columns >= at[:, None]), wide - 1), axis=1)
            ranks[:, -1] = NEVER
            ranks[each, at] = self.ranked(ids[each, at], ids[each, np.minimum(at + 1, wide - 1)])
            inner = np.flatnonzero(at)
            ranks[inner, at[inner] - 1] = self.ranked(ids[inner, at[inner] - 1], ids[inner, at[inner]])

    def counts(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The tokens of each piece of the bytes."""
        out, low = np.zeros(len(begin), np.int64), 0
        for high in (8, 16, KEPT_LENGTH):  # rows of about one width together
            at = np.flatnonzero((size > low) & (size <= high))
            for i in range(0, len(at), 1 << 16):
                few = at[i : i + (1 << 16)]
                out[few] = self.together(data, begin[few], size[few])
            low = high
        for i in np.flatnonzero(size > low).tolist():
            out[i] = self.many([self.letter[b] for b in data[begin[i] : begin[i] + size[i]].tolist()])
        return out

    def many(self, parts: list[str | None]) -> int:
        n, rank = len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, None, after[j]
            left -= 1
            if after[i] < n:
                before[after[i]] = i
                if (r := rank.get((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
            if (h := before[i]) >= 0 and (r := rank.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return left


class Generation:
    """Transitions (state, eight bytes) -> (state, tokens emitted), hashed with open addressing; state 0 is the start."""

    def __init__(self, kept: int):
        self.bits, self.kept, self.filled, self.states = (2 * kept - 1).bit_length(), kept, 0, 1
        n = 1 << self.bits
        self.source, self.symbol, self.target, self.emits = np.full(n, -1, np.int32), np.zeros(n, np.uint64), np.zeros(n, np.int32), np.zeros(n, np.int32)

    def slots(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        mixed = (symbol ^ (symbol >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + state.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The slot of each transition, or -1."""
        slot, todo = self.slots(state, symbol), np.arange(len(state))
        out = np.full(len(state), -1)
        while len(todo):
            at = slot[todo]
            source = self.source[at]
            hit = (source == state[todo]) & (self.symbol[at] == symbol[todo])
            out[todo[hit]] = at[hit]
            todo = todo[~hit & (source >= 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def walk(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The tokens emitted by each piece of the bytes, -1 where a transition is lacking."""
        eight = np.lib.stride_tricks.sliding_window_view(data, 8)
        out, state, todo, read = np.full(len(begin), -1), np.zeros(len(begin), np.int32), np.arange(len(begin)), 0
        while len(todo):
            left = np.minimum(size[todo] - read, 8)
            symbol = eight[begin[todo] + read].view(np.uint64).ravel() | ENDS[left]
            slot = self.find(state[todo], symbol)
            known = slot >= 0
            last = known & (left < 8)
            out[todo[last]] = self.emits[slot[last]]
            on = known & ~last
            state[todo[on]] = self.target[slot[on]]
            todo, read = todo[on], read + 8
        return out

    def add(self, state: np.ndarray, symbol: np.ndarray, target: np.ndarray, emits: np.ndarray) -> None:
        """Transitions that are lacking, each once."""
        slot, todo = self.slots(state, symbol), np.arange(len(state))
        while len(todo):
            free = self.source[slot[todo]] < 0
            slot[todo[~free]] = (slot[todo[~free]] + 1) & ((1 << self.bits) - 1)
            at, first = np.unique(slot[todo[free]], return_index=True)  # of those that want a slot one takes it
            takes = todo[free][first]
            self.source[at], self.symbol[at], self.target[at], self.emits[at] = state[takes], symbol[takes], target[takes], emits[takes]
            left = np.ones(len(state), bool)
            left[takes] = False
            todo = todo[left[todo]]
        self.filled += len(state)

    def compile(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, tokens: np.ndarray) -> None:
        """Add the transitions of pieces of the bytes that are lacking, each once."""
        eight = np.lib.stride_tricks.sliding_window_view(data, 8)
        state, todo, read = np.zeros(len(begin), np.int32), np.arange(len(begin)), 0
        while len(todo):
            left = np.minimum(size[todo] - read, 8)
            symbol = eight[begin[todo] + read].view(np.uint64).ravel() | ENDS[left]
            last = left < 8
            ends, inner, x = todo[last], todo[~last], symbol[~last]
            self.add(state[ends], symbol[last], np.zeros(len(ends), np.int32), tokens[ends])
            lacking = self.find(state[inner], x) < 0
            pairs = np.unique(np.stack([state[inner][lacking].astype(np.uint64), x[lacking]], axis=1), axis=0)
            self.add(pairs[:, 0].astype(np.int32), pairs[:, 1], self.states + np.arange(len(pairs)), np.zeros(len(pairs), np.int32))
            self.states += len(pairs)
            state[inner] = self.target[self.find(state[inner], x)]
            todo, read = inner, read + 8


#: By the bytes of a block that belong to a piece: those behind are set, which no byte of UTF-8 is.
ENDS = np.array([((1 << 64) - 1) ^ ((1 << 8 * n) - 1) for n in range(9)], np.uint64)


class Transducer:
    """Two generations of transitions, and the merges for what they lack."""

    def __init__(self, path: str, kept: int = KEPT):
        self.merges, self.now, self.before, self.kept = Merges(path), Generation(kept), None, kept

    def counts(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The tokens of each piece; data has eight bytes more at its end."""
        out = self.now.walk(data, begin, size)
        lacking = np.flatnonzero(out < 0)
        if not len(lacking):
            return out
        raw, numbers, first = data.tobytes(), {}, []
        of = np.empty(len(lacking), np.int64)
        for i, (b, n) in enumerate(zip(begin[lacking].tolist(), size[lacking].tolist(), strict=True)):
            of[i] = k = numbers.setdefault(raw[b : b + n], len(numbers))
            if k == len(first):
                first.append(lacking[i])
        begin, size = begin[first], size[first]  # one of each piece
        tokens = self.before.walk(data, begin, size) if self.before else np.full(len(first), -1)
        new = np.flatnonzero(tokens < 0)
        tokens[new] = self.merges.counts(data, begin[new], size[new])
        out[lacking] = tokens[of]
        short = np.flatnonzero(size <= KEPT_LENGTH)
        needs = np.cumsum(size[short] // 8 + 1)  # transitions at most
        if len(needs) and self.now.filled + needs[-1] > self.kept:
            self.before, self.now = self.now, Generation(self.kept)
            short = short[needs <= self.kept]
        self.now.compile(data, begin[short], size[short], tokens[short])
        return out


@lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    """The number of tokens of each text."""
    machine_ = transducer(path)
    totals = np.zeros(len(texts), np.int64)
    parts, owner = [], []
    for i, text in enumerate(texts):
        pieces = [text]
        for s in machine_.merges.special:
            if s in text:
                split = [q for p in pieces for q in p.split(s)]
                totals[i] += len(split) - len(pieces)
                pieces = split
        for p in pieces:
            if p:
                parts.append(p)
                owner.append(i)
    if not parts:
        return totals
    ends = np.cumsum(np.array([len(p) for p in parts]) + 1)  # each part is followed by a RESET
    whole = "\0".join(parts) + "\0"
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    classes = character_classes()[points]
    classes[ends - 1] = RESET
    starts = piece_starts(classes)  # a RESET is a piece of its own
    data = whole.encode()
    bytes_at = starts
    if len(data) > len(points):
        wide = np.cumsum((points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))
        bytes_at = starts + np.concatenate([[0], wide])[starts]
    real = np.flatnonzero(classes[starts] != RESET)
    begin, size = bytes_at[real], bytes_at[real + 1] - bytes_at[real]
    padded = np.frombuffer(data + bytes(8), np.uint8)
    of = np.asarray(owner)[np.searchsorted(ends, starts[real], side="right")]
    for a in range(0, len(real), TOGETHER):
        cut = slice(a, a + TOGETHER)
        np.add.at(totals, of[cut], machine_.counts(padded, begin[cut], size[cut]))
    return totals


def token_counts(df: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", limit: int = 1024) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of each row."""

    def fn(texts: pa.Array) -> list[pa.Array]:
        n = count_tokens(texts.to_pylist(), tokenizer)
        return [pc.binary_length(texts.cast(pa.binary())).cast(pa.int64()), pa.array(n), pa.array(n > limit)]

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return map_texts(df, text_col, [(id_col, quoted(id_col))], fields, fn)


def op6_token_counts(spark, sf_dir):
    """The documents' token counts for byte_bpe_50k.json."""
    import public_tokenizers

    from .common import table

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", F.col("over_limit"))
