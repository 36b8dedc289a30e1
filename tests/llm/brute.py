"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def lines(rows, least=10):
    key = lambda line: lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs[key(line)].add(i)
    gone = {k for k, d in docs.items() if len(d) >= least and k}
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if key(x) not in gone]
        out.append((i, len(every), len(every) - len(kept), sha("\n".join(kept))))
    return out


def statistics(text):
    w = WORD.findall(text or "")
    runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)]


def passages(rows, window=50):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in docs:
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in docs:
        gone = {b for a in range(len(w) - window + 1) if first[tuple(w[a : a + window])] < i for b in range(a, a + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for a, x in enumerate(w) if a not in gone)).hexdigest()))
    return out


def components(rows, n=5, percent=80):
    sets, root = linked(rows, n, percent)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)]


def groups(rows, n=5, percent=80):
    """The rows of each component."""
    _, root = linked(rows, n, percent)
    out = defaultdict(list)
    for i, r in enumerate(rows):
        out[root(i)].append(r)
    return list(out.values())


def linked(rows, n, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            lists[x].append(i)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in lists[x] if j > i)
        for j, v in both.items():
            if 100 * v >= percent * (len(s) + len(sets[j]) - v):
                up[root(i)] = root(j)
    return sets, root


def licences(text):
    notices = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    starts, labels = [], set()
    for phrase, label in notices.items():
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


KNOWN = {"mit": "mit", "apache-2.0": "apache", "gpl-2.0-only": "gpl", "gpl-2.0+": "gpl", "gpl-2.0-or-later": "gpl", "eupl-1.2": "eupl", "wtfpl": "wtfpl"}


def expression(text):
    """Whether an expression of the names above holds, and the families that make it so; by recursive descent."""
    tokens = re.findall(r"[()]|[^\s()]+", text.lower())

    def alternatives():
        ok, found = both()
        while tokens and tokens[0] == "or":
            tokens.pop(0)
            more, others = both()
            ok, found = ok or more, (found if ok else set()) | (others if more else set())
        return ok, found

    def both():
        ok, found = single()
        while tokens and tokens[0] == "and":
            tokens.pop(0)
            more, others = single()
            ok, found = ok and more, found | others if ok and more else set()
        return ok, found

    def single():
        if tokens[0] == "(":
            tokens.pop(0)
            out = alternatives()
            tokens.pop(0)
            return out
        name = tokens.pop(0)
        ok = name in KNOWN
        if tokens and tokens[0] == "with":
            tokens.pop(0)
            ok &= tokens.pop(0) == "classpath-exception-2.0"
        return ok, {KNOWN[name]} if ok else set()

    return alternatives()


def labels_and_score(text):
    """Base labels, labels and score of lines that are each a tag, a notice or neither."""
    base, more, notices, tags, true = set(), set(), 0, 0, False
    for line in text.split("\n"):
        head, _, rest = line.partition(": ")
        if rest:
            tags += 1
            ok, found = expression(rest)
            true |= ok
            more |= found
        if line == "mit license":
            notices += 1
            base.add("mit")
        if line == "an isc license":
            more.add("isc")
    score = 1.0 if true else 1 - 0.5**notices if notices else 0.5 if tags else 0.0
    return ",".join(sorted(base)), ",".join(sorted(base | more)), score


def npy_tiles(payload):
    """The payload as rows of 64 RGB pixels in NPY files of 256 rows, by hand."""
    out, rows = b"", len(payload) // 192
    for a in range(0, rows, 256):
        part = payload[a * 192 : (a + 256) * 192]
        head = f"{{'descr': '|u1', 'fortran_order': False, 'shape': ({len(part) // 192}, 64, 3), }}"
        head += " " * (-(10 + len(head) + 1) % 64) + "\n"
        out += b"\x93NUMPY\x01\x00" + len(head).to_bytes(2, "little") + head.encode() + part
    return out


def difference_hash(grid):
    """Whether each of 8 by 8 area averages is darker than the next one to the right; averages in exact fractions."""
    from fractions import Fraction

    rows, columns, _ = grid.shape
    grey = grid.astype(int).sum(axis=2)

    def mean(a, b, c, d):
        """Of the rows a to b and the columns c to d, both fractional."""
        total = Fraction(0)
        for i in range(int(a), min(rows, -int(-b // 1))):
            for j in range(int(c), min(columns, -int(-d // 1))):
                total += (min(b, i + 1) - max(a, i)) * (min(d, j + 1) - max(c, j)) * int(grey[i, j])
        return total / ((b - a) * (d - c))

    bits = ""
    for i in range(8):
        cells = [mean(Fraction(i * rows, 8), Fraction((i + 1) * rows, 8), Fraction(j * columns, 9), Fraction((j + 1) * columns, 9)) for j in range(9)]
        bits += "".join("1" if cells[j + 1] > cells[j] else "0" for j in range(8))
    return f"{int(bits, 2):016x}"


def best_fit(sizes, room):
    """How many sequences item-by-item best fit takes, longest first."""
    import bisect

    rooms, n = [], 0
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            n, left = n + 1, room
        else:
            left = rooms.pop(at)
        bisect.insort(rooms, left - size)
    return n
