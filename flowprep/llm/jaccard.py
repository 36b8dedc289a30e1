"""N-gram Jaccard join, size-aware: small sets by subsets, large sets by inverted lists, the boundary by cost.

Two documents link when their sets of 5-word shingles have a Jaccard similarity of 0.8 or more. The join is exact:

1. Documents with equal sets form a class; classes are joined instead of documents.
2. All tokens (64-bit shingle hashes) are put in one order. Those in the lowest `counted` part of the hash range are
   counted over the whole corpus; of these, tokens of one document come first, then shared ones by their count, then
   all other tokens. Executors know the shared ones by a filter of fixed size and the most frequent ones, at most
   `ordered`, by a list. Any order gives the same links; this one makes most documents' lists empty.
3. A set of at most x tokens is small. Linked small sets of sizes s and t share at least o(s, t) tokens, so they share
   a subset of that size: small sets emit all their subsets of the sizes that can matter. Larger sets (and those
   small ones that can link to larger ones) emit their first s - ceil(0.8 s) + 1 tokens, of which linked sets share one;
   tokens that only one document has needn't be emitted. x is the boundary where the subsets emitted and the lists
   scanned cost least, from the histogram of sizes and the mean length of a list; nothing else bounds it.
4. Keys that only one class has are dropped by an exact join.
5. Links are looked for in rounds. In each list the class with the most shared keys is a pivot; in the first round
   every other class is verified against the pivot that most of its lists name, in the next ones against its nearest
   class of another component in each long list. So a group of n near copies costs a few n pairs, not n squared.
   Links are contracted to components, and lists within one component are done.
6. Whatever is left is joined in full: in unfinished lists, classes outside the pivot's component meet all classes of
   other components. So every link is either found or lies within a component already known. Two sets of sizes s and
   t that link share at least o(s, t) - max(rest) keys, where rest is what a set has beyond its prefix. So a class
   with d keys in unfinished lists (those of pivots of its own component too) has no partner in bands of sizes where more
   than d are needed, and where v are needed it may leave out its v - 1 longest lists. Short lists are joined; long ones are
   compared by sketches, block by block; a block is bounded in classes and in bytes of sketches.
7. Pairs are verified in two steps. Each class has a parity sketch of about two bits a token; sets differ by at least
   as many tokens as their sketches differ by bits, so most wrong pairs go without a look at the sets. Both steps go
   pair by pair, as sets differ in size; each pair is a few numpy calls over whole sketches or sets.

Cases: a document with fewer words than a shingle has its whole word sequence as its one element; one without words
has an empty set and is linked with nothing, its component is its own id; rows are told apart by id and text: rows that
share an id but not the text are documents of their own, rows that repeat both are one document; a null id counts as
the largest and stays null when it is alone; ids are whole numbers (or text of such: others are an error); very long texts
are handled alone; an empty table gives no rows; other columns are ignored by jaccard_components() and kept by
one_of_each(), whatever their names. Classes are told apart by 128-bit hashes of their sets, tokens by 64 bits.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache, reduce
from math import comb, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowprep.cluster import ship

from .common import KeyFilter, arrow_map, flat_map_texts, numbered, quoted, same, text_of, tidy, written
from .components import components
from .textarrays import mix, power_table, windows, words_of

U = np.uint64
BASE = 0xD6E8FEB86659FD93
#: A sketch has at least so many bits, else the power of two above twice the size of its set.
SKETCH_LEAST = 256


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = words_of(texts, lower=True)
    h = words.hashes()
    runs, out = windows(h, n, BASE), []
    for a, b in itertools.pairwise(words.first.tolist()):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            k = b - a
            out.append(mix(np.array([(h[a:b] * power_table(BASE, k)[:k]).sum() + U(k)], U)))
        else:
            out.append(h[:0])
    return out


def class_of(tokens: np.ndarray) -> bytes | None:
    """A 128-bit hash of the set, null for an empty one."""
    if not len(tokens):
        return None
    sums = [mix(tokens ^ U(salt)).sum() + U(len(tokens)) for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
    return mix(np.array(sums, U)).astype(">u8").tobytes()


def needed(s: int, t: int, percent: int) -> int:
    """The overlap that sets of sizes s and t need: i >= percent / (100 + percent) * (s + t)."""
    return -(-percent * (s + t) // (100 + percent))


def prefix_length(s: int, percent: int) -> int:
    return s - -(-percent * s // 100) + 1


@lru_cache(512)
def subset_sizes(s: int, most: int, percent: int) -> tuple[int, ...]:
    """Sizes of the subsets that a small set must emit to meet every small set it may link with (of another class)."""
    partners = range(-(-percent * s // 100), min(most, s * 100 // percent) + 1)
    return tuple(sorted({o for t in partners if (o := needed(s, t, percent)) <= min(s, t) and not (s == t == o)}))


def subsets_of(s: int, most: int, percent: int) -> int:
    return sum(comb(s, c) for c in subset_sizes(s, most, percent))


def most_subsets(s: int, most: int, percent: int) -> float:
    """The logarithm of the largest of the binomials that subsets_of() sums up, without making any of them."""
    low, high = needed(s, -(-percent * s // 100), percent), min(s, needed(s, min(most, s * 100 // percent), percent))
    c = min(max(low, s // 2), high)  # the nearest to half of the sizes between the ends
    if not 0 < c < s:
        return 0.0
    return lgamma(s + 1) - lgamma(c + 1) - lgamma(s - c + 1)


def boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """The size up to which sets are small, at the least cost: subsets emitted, against tokens emitted and list entries scanned.

    Subsets only become more as the boundary rises, so the search ends where they alone cost more than the best so far. A
    size whose largest binomial is beyond that ends it before a binomial of hundreds of digits is made.
    """
    every = sorted(sizes)
    after = [0.0]  # what the lists cost from each size on
    for s in reversed(every):
        after.append(after[-1] + sizes[s] * prefix_length(s, percent) * (1 + list_length))
    after.reverse()
    lists = lambda x: after[bisect_left(every, -(-percent * (x + 1) // 100))]
    best = (lists(0), 0)
    for s in every:
        x = s * 100 // percent  # the least boundary that spares sets of size s their lists
        subsets = 0
        for t in every[: bisect_right(every, x)]:
            # one more than the best cost settles it; the slack of 1 covers what lgamma and sizes without a subset of that size may be off
            if most_subsets(t, x, percent) > log(max(best[0], 1.0)) + 1 + log(t):
                return best[1]
            subsets += sizes[t] * subsets_of(t, x, percent)
            if subsets > best[0]:
                return best[1]
        best = min(best, (subsets + lists(x), x))
    return best[1]


#: Numbers in a table of subsets that is kept, and subsets of one set that are made at a time.
KEPT_COMBOS, COMBO_BLOCK = 1 << 16, 1 << 14


def chosen(s: int, c: int) -> Iterator[np.ndarray]:
    """All ways to choose c of s, in blocks of rows."""
    ways = itertools.combinations(range(s), c)
    for n in itertools.repeat(COMBO_BLOCK):
        got = np.fromiter(itertools.chain.from_iterable(itertools.islice(ways, n)), np.int64)
        if not c or not len(got):
            return
        yield got.reshape(-1, c)


@lru_cache(64)
def combos(s: int, c: int) -> list[np.ndarray]:
    return list(chosen(s, c))


def sketch(tokens: np.ndarray) -> bytes:
    """The parity of the number of tokens at each place of a bitmap whose size is a power of two."""
    bits = max(SKETCH_LEAST, 1 << (2 * len(tokens)).bit_length())
    return np.packbits((np.bincount((tokens & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference; the longer sketch is folded to the shorter one's size."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    n = min(len(a), len(b))
    fold = np.bitwise_xor.reduce(a.reshape(-1, n), axis=0) ^ np.bitwise_xor.reduce(b.reshape(-1, n), axis=0)
    return int(np.bitwise_count(fold).sum())


def limit(counted: float) -> np.uint64:
    return U(min(int(counted * (1 << 64)), (1 << 64) - 1))


class Order:
    """One order of all tokens: counted ones of one document, counted ones that are shared, by count, and the others; ties by value."""

    def __init__(self, counted: float, shared: KeyFilter, tokens: np.ndarray, counts: np.ndarray):
        at = np.argsort(tokens)
        self.below, self.shared, self.tokens, self.counts = limit(counted), shared, tokens[at], counts[at].astype(np.int64)

    def prefix(self, tokens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the first n of a sorted set: those that another document may have, and their places from 1."""
        known, half = tokens < self.below, (tokens >> U(1)).view(np.int64)
        weight = np.where(known, 0, 1 << 62)
        weight[known & self.shared.has(half)] = 1
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, half), len(self.tokens) - 1)
            frequent = (self.tokens[at] == half) & (weight == 1)
            weight[frequent] = 1 + self.counts[at[frequent]]
        first = np.argsort(weight, kind="stable")[:n]
        places = np.flatnonzero(weight[first] > 0)
        return tokens[first[places]], places + 1


def subset_keys(tokens: np.ndarray, most: int, percent: int) -> np.ndarray:
    s = len(tokens)
    if not 0 < s <= most:
        return tokens[:0]
    mixed = mix(tokens)
    whole, out = mixed.sum(keepdims=True), [tokens[:0]]
    for c in subset_sizes(s, most, percent):
        left = s - c  # a subset's sum is the whole's without that of the few tokens left out
        if not left:
            out.append(mix(whole + U(c << 56)))
            continue
        for ways in combos(s, left) if comb(s, left) * left <= KEPT_COMBOS else chosen(s, left):
            out.append(mix(whole - mixed[ways].sum(axis=1) + U(c << 56)))
    return np.concatenate(out)


LONG = T.LongType()
#: Bytes of texts, sketches or sets that a batch brings to a function.
BATCH_BYTES = 4 << 20
#: Subsets that are made before they are handed on; one set's are made together.
EMITTED = 1 << 16


def fields(longs: str, binaries: str = "") -> T.StructType:
    return T.StructType([*(T.StructField(n, LONG) for n in longs.split()), *(T.StructField(n, T.BinaryType()) for n in binaries.split())])


#: kind 0: a document's id and row, class, size and sketch; kind 1: a key of a class, its size and the key's place.
SCANNED = fields("kind id row k n place", "c sketch")


def count_keys(docs: DataFrame, text_col: str, n: int, counted: float) -> DataFrame:
    """(k): half of every counted token of every set; -s for every set of a size s above 0."""
    below = limit(counted)

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(part.column(0), n)
        sizes = -np.array([len(s) for s in sets if len(s)], np.int64)
        tokens = [(s[: np.searchsorted(s, below)] >> U(1)).view(np.int64) for s in sets]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([sizes, *tokens]))], names=["k"])

    return flat_map_texts(docs, text_col, [], fields("k"), fn)


def emit_keys(docs: DataFrame, text_col: str, n: int, percent: int, order: Order, most: int) -> DataFrame:
    """SCANNED rows of every document."""
    handed = docs.sparkSession.sparkContext.broadcast(order)  # of bounded size
    listed = -(-percent * (most + 1) // 100)  # sets from this size on emit tokens

    def fn(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets, at = shingle_sets(part.column(2), n), 0
        costs = np.cumsum([subsets_of(len(s), most, percent) if len(s) <= most else 0 for s in sets])
        while at < len(sets):  # a batch ends with the set that brings its subsets beyond EMITTED
            to = 1 + int(np.searchsorted(costs[:-1], (costs[at - 1] if at else 0) + EMITTED))
            yield rows(part.slice(at, to - at), sets[at:to])
            at = to

    def rows(part: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        order = handed.value
        classes = pa.array([class_of(s) for s in sets], pa.binary())
        owners, keys, places = [], [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for s in sets:
            small = subset_keys(s, most, percent)
            token, place = order.prefix(s, prefix_length(len(s), percent)) if len(s) >= listed else (s[:0], s[:0].astype(np.int64))
            owners.append(len(small) + len(token))
            keys += [small, token]
            places += [np.zeros(len(small), np.int64), place]
        sizes = np.array([len(s) for s in sets], np.int64)
        m, k = len(sets), sum(owners)
        of = np.repeat(np.arange(m), owners)
        none = pa.nulls(k, pa.int64())
        zeros = np.zeros(m, np.int64)
        columns = [
            np.concatenate([zeros, np.ones(k, np.int64)]), pa.concat_arrays([part.column(0), none]), pa.concat_arrays([part.column(1), none]), np.concatenate([zeros, np.concatenate(keys).view(np.int64)]),
            np.concatenate([sizes, sizes[of]]), np.concatenate([zeros, *places]), pa.concat_arrays([classes, classes.take(pa.array(of))]), pa.concat_arrays([pa.array([sketch(s) for s in sets], pa.binary()), pa.nulls(k, pa.binary())]),
        ]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=SCANNED.names)

    return flat_map_texts(docs, text_col, [F.col("id"), F.col("row")], SCANNED, fn)


def row_hash() -> Column:
    return F.xxhash64("row", "id")


def sets_of_classes(docs: DataFrame, text_col: str, n: int, wanted: DataFrame) -> DataFrame:
    """(c, tokens) of the wanted classes (c, id, row of one document): only documents that may be wanted are read closely."""
    only = KeyFilter.of(wanted.select(row_hash().alias("h")), "h"), row_hash()

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(part.column(2), n)
        return pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([class_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "row", "c", "tokens"])

    found = flat_map_texts(docs, text_col, [F.col("id"), F.col("row")], fields("id row", "c tokens"), fn, only)
    return found.join(wanted, same(found, wanted, "c", "id", "row")).select(found["c"], "tokens").dropDuplicates(["c"])


def likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches don't forbid the similarity."""
    left, right = (sketches.select(F.col("c").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in ("a", "b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches):
        for batch in batches:
            ok = []
            for s, t, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                ok.append(sketch_distance(x.as_py(), y.as_py()) <= s + t - 2 * needed(s, t, percent))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return arrow_map(both, run, fields("", "a b"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough."""
    left, right = sets.select(F.col("c").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("c").alias("b"), F.col("tokens").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                i = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * i >= percent * (len(x) + len(y) - i))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return arrow_map(both, run, fields("", "a b"))


def least_shared(s: str, t: str, percent: int) -> str:
    """SQL for the least number of shared prefix tokens of linked sets of sizes s and t."""
    up = lambda x, y: f"(({x}) + {y} - 1) div {y}"
    return f"({up(f'{percent} * ({s} + {t})', 100 + percent)} - greatest({up(f'{percent} * {s}', 100)}, {up(f'{percent} * {t}', 100)}) + 1)"


#: Bands of sizes to the factor e; neighbours differ by 5 %.
BANDS = 20


def band(x: str) -> str:
    return f"cast(floor(ln(greatest({x}, 1D)) * {BANDS}) as int)"


def shared_in_band(percent: int) -> str:
    """SQL for a lower bound of the keys that a set of size s shares with any it links with in a band of sizes.

    In the partner's size the need rises up to s and falls beyond, so one of the band's ends has the least.
    """
    r, a = percent / 100, percent / (100 + percent)
    need = lambda t: f"({a}D * (s + {t}) - {r}D * greatest(cast(s as double), {t}))"
    low, high = f"greatest(exp(band / {BANDS}D), {r}D * s)", f"least(exp((band + 1) / {BANDS}D), s / {r}D)"
    return f"greatest(1, cast(ceil(least({need(low)}, {need(high)}) - 1e-6D) as int))"


#: Lists of more classes are compared by sketches in blocks instead of being joined. A side of a block has at most BLOCK classes
#: and BLOCK_BYTES of sketches, or one class.
LONG_LIST, BLOCK, BLOCK_BYTES = 64, 512, 16 << 20


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each value of a column."""
    return column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)


def compare_block(percent: int, nearest: bool, group: pa.Table) -> pa.Table:
    """Pairs of probing and other classes of one block whose sketches allow a link, or each probing class's nearest alone."""
    probing = group.column("probing").to_numpy(zero_copy_only=False)
    s, place = (group.column(n).to_numpy(zero_copy_only=False) for n in ("s", "place"))
    root, names = codes(group.column("root")), group.column("c").combine_chunks()
    halves = np.array([x.as_py() for x in names], "S16").view(np.uint8).reshape(-1, 2, 8).view(">u8")[:, :, 0]
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((halves[:, 1], halves[:, 0]))] = np.arange(len(names))  # Spark compares bytes in the same order
    raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("sketch").combine_chunks()]
    words = min(map(len, raw))
    bits = np.stack([np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) for x in raw])
    other = np.flatnonzero(~probing)
    root2, s2, place2, bits2 = root[other], s[other], place[other], bits[other]
    pairs: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    for i in np.flatnonzero(probing).tolist():
        both = s[i] + s2
        need = -(-percent * both // (100 + percent))
        ok = (root2 != root[i]) & (100 * np.minimum(s[i], s2) >= percent * np.maximum(s[i], s2))
        if place[i]:
            ok &= np.minimum(place[i], place2) + np.minimum(s[i] - place[i], s2 - place2) >= need
        at = np.flatnonzero(ok)
        apart = np.bitwise_count(bits2[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(apart <= (both - 2 * need)[at])
        found = other[at[near[np.argmin(apart[near]) :][:1] if nearest and len(near) else near]]
        low = rank[found] < rank[i]
        pairs.append(np.stack([np.where(low, found, i), np.where(low, i, found)], axis=1))
    found = np.concatenate(pairs)
    return pa.table({"a": names.take(pa.array(found[:, 0])), "b": names.take(pa.array(found[:, 1]))})


def block_rows() -> str:
    """SQL for how many classes of a list make a side of a block; a sketch has at most half a byte for each token."""
    return f"greatest(1, least({BLOCK}, {BLOCK_BYTES} div greatest({SKETCH_LEAST // 8}, most_s div 2 + 1)))"


def left_pairs(open_: DataFrame, sketches: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """(a, b) of classes in different components that may be linked, from rows (k, c, s, place, root, pivot_root, members, most_s).

    With nearest, a long list gives one pair for each probing class; else all pairs are given.
    """
    own = Window.partitionBy("c", F.col("place") == 0)
    r = percent / 100
    # Ranks go over all of a class's open lists: the first list that a linked pair shares is within the rank of both, and its pivot is in the component of one at most.
    ranked = open_.withColumns({"open_keys": F.count("*").over(own), "rank": F.row_number().over(own.orderBy("members", "k"))})
    every = ranked.where("root <> pivot_root").withColumn("band", F.explode(F.expr(f"sequence({band(f'{r}D * s')}, {band(f's / {r}D')})")))
    every = every.where(f"place = 0 or rank <= open_keys - {shared_in_band(percent)} + 1")
    columns = ("c", "root", "s", "place", "members", "most_s")
    probes, others = every.select("k", "band", *columns), open_.select("k", F.expr(band("s")).alias("band"), *columns)

    # short lists: their pairs are at most LONG_LIST times their rows
    one = probes.where(f"members <= {LONG_LIST}").select("k", "band", F.col("c").alias("a"), F.col("root").alias("ra"), F.col("s").alias("sa"), F.col("place").alias("pa"))
    other = others.where(f"members <= {LONG_LIST}").select("k", "band", F.col("c").alias("b"), F.col("root").alias("rb"), F.col("s").alias("sb"), F.col("place").alias("pb"))
    reach = f"pa = 0 or (least(pa, pb) + least(sa - pa, sb - pb)) * {100 + percent} >= {percent} * (sa + sb)"
    met = one.join(other, ["k", "band"]).where(f"ra <> rb and 100 * least(sa, sb) >= {percent} * greatest(sa, sb) and ({reach})")
    short = likely(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sketches, percent)

    # long lists: probing rows of block i meet other rows of block j in a group of their own; most lists are one block
    met_by = others.join(probes.select("k", "band").distinct(), ["k", "band"], "left_semi")
    blocks = f"cast(ceil(members / cast({block_rows()} as double)) as int)"
    spread, mine, first = F.explode(F.expr(f"sequence(0, {blocks} - 1)")), F.pmod(F.xxhash64("c"), F.expr(blocks)).cast("int"), F.lit(0)
    parts = []
    for side, flag in ((probes, True), (met_by, False)):
        i, j = ("i", "j") if flag else ("j", "i")
        columns = ("k", "band", "c", "root", "s", "place", F.lit(flag).alias("probing"))
        parts.append(side.where(f"members > {LONG_LIST} and members <= {block_rows()}").select(*columns, first.alias(i), first.alias(j)))
        parts.append(side.where(f"members > {LONG_LIST} and members > {block_rows()}").select(*columns, mine.alias(i), spread.alias(j)))
    both = reduce(DataFrame.unionByName, parts).join(sketches.select("c", "sketch"), "c")
    ship(open_.sparkSession)
    long = both.groupBy("k", "band", "i", "j").applyInArrow(lambda group: compare_block(percent, nearest, group), fields("", "a b"))
    return short.unionByName(long).distinct()


def link_roots(docs: DataFrame, text_col: str, n: int, percent: int, counted: float, ordered: int, rounds: int) -> tuple[DataFrame, DataFrame | None]:
    """(id, row, c, n) of every document, and (node, root) of every class that is linked."""
    counts = written(count_keys(docs, text_col, n, counted).groupBy("k").agg(F.count("*").alias("m")).where("m > 1 or k < 0"), "counts", BATCH_BYTES)
    sizes = {-r["k"]: r["m"] for r in counts.where("k < 0").collect()}  # a row for each size that a set has
    shared = counts.where("k >= 0")
    frequent = shared.where("m > 2").orderBy(F.desc("m"), "k").limit(ordered).toArrow()
    most = boundary(sizes, shared.agg(F.avg("m")).first()[0] or 0.0, percent)
    order = Order(counted, KeyFilter.of(shared, "k"), frequent["k"].to_numpy(), frequent["m"].to_numpy())
    scan = written(emit_keys(docs, text_col, n, percent, order, most), "keys", BATCH_BYTES)
    members = scan.where("kind = 0").select("id", "row", "c", "n")
    rows = scan.where("kind = 1").select("k", "c", F.col("n").alias("s"), "place")
    real = rows.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("k")
    rows = written(rows.join(written(real, "real"), "k").distinct(), "shared")
    if rows.isEmpty():
        return members, None
    degree = rows.groupBy("c").agg(F.count("*").alias("degree"))
    rows = written(rows.join(degree, "c"), "lists")
    nodes = rows.select("c").distinct()
    one = F.struct("id", "row")  # any document of the class; summed up before the join, so a class of many copies is a row a task
    known = scan.where("kind = 0 and n > 0").groupBy("c").agg(F.min(one).alias("one"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    known = known.join(nodes, "c", "left_semi")
    known = written(known.select("c", "one.*", "n", "sketch"), "classes")

    edges = roots = None
    for turn in range(rounds + 2):
        now = rows.withColumn("root", F.col("c")) if roots is None else rows.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
        rank = F.struct("degree", "c")  # the pivot: the class with the most shared keys
        best = now.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max_by(F.struct("c", "root", "s"), rank).alias("best"), F.count("*").alias("members"), F.max("s").alias("most_s")).where("lo < hi")
        best = written(best.select("k", F.col("best.c").alias("pivot"), F.col("best.root").alias("pivot_root"), F.col("best.s").alias("pivot_s"), "members", "most_s"), "pivots")
        open_ = now.join(best, "k")
        if turn == 0:
            named = open_.where(f"root <> pivot_root and (place = 0 or degree >= {least_shared('s', 'pivot_s', percent)})").groupBy("c", "pivot").agg(F.count("*").alias("votes"))
            pairs = named.groupBy("c").agg(F.max_by("pivot", F.struct("votes", "pivot")).alias("b")).select(F.col("c").alias("a"), "b")
            near = likely(pairs, known, percent)
        else:
            near = left_pairs(written(open_, "open"), known, percent, turn <= rounds)
        near = written(near, "near", BATCH_BYTES)
        if near.isEmpty():
            continue
        wanted = written(near.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(known.select("c", "id", "row"), "c"), "wanted")
        found = written(verified(near, sets_of_classes(docs, text_col, n, wanted), percent), "found", BATCH_BYTES)
        if found.isEmpty():
            continue
        edges = found if edges is None else edges.union(found)
        roots = components(edges)
    return members, roots


def component_ids(docs: DataFrame, text_col: str, n: int, percent: int, counted: float, ordered: int, rounds: int) -> DataFrame:
    """(id, row, n, first): every document with the first one of its component, (none, id, row): none is true for a null id."""
    members, roots = link_roots(docs, text_col, n, percent, counted, ordered, rounds)
    own = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = members.where("n > 0").groupBy("c").agg(F.min(own).alias("first"))
    if roots is not None:
        rooted = classes.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
        least = rooted.groupBy("root").agg(F.min("first").alias("least"))
        classes = rooted.join(least, "root").select("c", F.col("least").alias("first"))
    full = members.where("n > 0").join(classes, "c").select("id", "row", "n", "first")
    return full.unionByName(members.where("n = 0").select("id", "row", "n", own.alias("first")))


@tidy
def jaccard_components(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 5, percent: int = 80, counted: float = 0.5, ordered: int = 1 << 17, rounds: int = 1) -> DataFrame:
    """id, n_shingles, component_id of each row."""
    text = text_of(quoted(text_col))
    docs = df.select(quoted(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    out = component_ids(docs, "text", n, percent, counted, ordered, rounds)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"))


@tidy
def one_of_each(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 5, percent: int = 80, counted: float = 0.5, ordered: int = 1 << 17, rounds: int = 1) -> DataFrame:
    """One document of each component, the one with the smallest id (of an id's documents, the smallest hash of the text),
    with all columns. Documents go by id and text: others of the same id stay."""
    own = numbered(df)
    text = text_of(F.col(f"c{df.columns.index(text_col)}"))
    docs = own.withColumns({"id": F.col(f"c{df.columns.index(id_col)}").cast("long"), "row": F.xxhash64(text), "text": text})
    out = component_ids(docs.select("id", "row", "text"), "text", n, percent, counted, ordered, rounds)
    gone = written(out.where(~((F.col("first.row") == F.col("row")) & F.col("first.id").eqNullSafe(F.col("id")))).select("id", "row").distinct(), "gone")
    maybe, stays = KeyFilter.of(gone.select(row_hash().alias("h")), "h").split(docs.drop("text"), row_hash())
    return stays.unionByName(maybe.join(gone, same(maybe, gone, "id", "row"), "left_anti")).select(*own.columns).toDF(*df.columns)


def op7_jaccard_join(spark, sf_dir):
    """The documents with the components of their near copies."""
    from .common import table

    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS v FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * v >= 80 * (a.n + b.n - v)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = r)
SELECT w.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM w JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY w.doc_id
"""
