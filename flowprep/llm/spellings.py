"""Spelling variant grouping: words one edit apart by two-dimensional range reporting on wavelet trees.

Words that differ by one inserted, deleted or replaced code point agree before and after the edit. In the order of words
those that begin alike are an interval, in the order of reversed words those that end alike. So for each position of an
edit the near words of a word are the points of a rectangle: words' places in the one order against those in the other,
which a wavelet tree reports in time of its height for each.

Where things run:

1. Executors count the runs of each block of texts, counts are summed up before they are shuffled, and frequent words
   become a table. Nothing after that depends on the size of the texts.
2. Of two near words the shorter, or either, has l code points. They share the first l // 2 if the edit is behind these, else
   the last l - l // 2. So each word goes to the groups of its halves, as one of l and as one of l + 1 code points; every
   near pair meets in one group, at one position: the first place where they differ. Groups are dealt to buckets of bounded
   size. One with more words than a bucket holds is cut into blocks: each block of searching words meets each block of
   words searched, by wavelet trees, so no pairs but near ones are made.
3. A bucket gives a row for each word and group: how many near words it found there and the best of them. Pairs never
   leave the task. Sums of these rows are the answer, as no pair is found twice.
4. Forms point to words of five times as many occurrences, so chains are short; roots come by pointer doubling.

Cases: a null text has no words; a null document id is the text "" in the checksum; repeated rows are repeated
occurrences; a run that loses its only code point is no word; of near words with equal counts the first in the order of
code points is the form; very long texts are handled alone, very long words like others (a bucket is bounded in code
points too); an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowprep.cluster import ship

from .common import dropped, flat_map_texts, quoted, table, tidy, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: One of so many checksums of runs marks a run that loses a code point.
ODD = 199
#: Words, and code points of words, that a bucket has about at most.
BUCKET, BUCKET_CHARS = 1 << 14, 1 << 19


def damaged(doc: object, run: str) -> str:
    """A lower-cased run as it counts: of some, by a checksum, one code point is lost."""
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    if h % ODD:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def occurrences(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(word, n) of the words of the texts, summed up."""

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        total: Counter[str] = Counter()
        for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            for run, n in Counter(RUN.findall(text.as_py().translate(LOWER))).items():  # a run's checksum is the same all over a document
                total[damaged(doc, run)] += n
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counted = flat_map_texts(df, text_col, [quoted(id_col)], T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]), fn)
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


class Wavelet:
    """A permutation's values by position, bit by bit from the highest: counts of zeros before each place, at each level."""

    def __init__(self, values: np.ndarray):
        self.size, self.height = len(values), max(1, int(len(values) - 1).bit_length()) if len(values) else 0
        self.zeros, self.split, at = [], [], values.astype(np.int64)
        for level in reversed(range(self.height)):
            one = (at >> level & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            self.split.append(int((~one).sum()))
            at = np.concatenate([at[~one], at[one]])

    def report(self, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in [low, high) at places [a, b), for many queries at once.

        The frontier holds the nodes that some query still has places in; a node outside of its query's values is left at once.
        """
        query, first = np.arange(len(a)), np.zeros(len(a), np.int64)
        for k in range(self.height):
            width = 1 << (self.height - k - 1)
            zeros, split = self.zeros[k], self.split[k]
            za, zb = zeros[a], zeros[b]
            query, first = np.concatenate([query, query]), np.concatenate([first, first + width])
            a, b = np.concatenate([za, split + a - za]), np.concatenate([zb, split + b - zb])
            alive = (b > a) & (first < high[query]) & (first + width > low[query])
            query, first, a, b = query[alive], first[alive], a[alive], b[alive]
        inside = (b > a) & (first >= low[query]) & (first < high[query])
        return query[inside], first[inside]


def matrix(words: list[str], length: int) -> np.ndarray:
    """The code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length).astype(np.uint32)


def ordered(points: np.ndarray) -> np.ndarray:
    """The rows' order, column by column from the left."""
    return np.argsort(np.ascontiguousarray(points.astype(">u4")).view(f"S{4 * points.shape[1]}").ravel(), kind="stable")


def agreeing(points: np.ndarray) -> np.ndarray:
    """How many columns each sorted row shares with the row before it, from the left; none for the first."""
    out = np.zeros(len(points), np.int64)
    if len(points) > 1:
        same = points[1:] == points[:-1]
        out[1:] = np.where(same.all(axis=1), points.shape[1], np.argmin(same, axis=1))
    return out


class Order:
    """Searching and searched words in one order, and for each searching word the interval of searched ones that begin like it."""

    def __init__(self, searching: np.ndarray, searched: np.ndarray):
        n, self.length = len(searching), searching.shape[1]
        extra = searched.shape[1] - self.length
        both = np.concatenate([np.pad(searching, ((0, 0), (0, extra))), searched])
        order = ordered(both)
        self.place = np.empty(len(both), np.int64)
        self.place[order] = np.arange(len(both))
        self.shared, self.own = agreeing(both[order]), self.place[:n]
        self.before = np.concatenate([[0], np.cumsum(order >= n)])
        self.rank = self.before[self.place[n:]]  # of each searched word among searched words

    def interval(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Of searched words that share so many first code points with each searching word."""
        starts = np.flatnonzero(np.concatenate([[True], self.shared[1:] < length]))
        group = np.searchsorted(starts, self.own, side="right") - 1
        return self.before[starts[group]], self.before[np.concatenate([starts[1:], [len(self.shared)]])[group]]


def near_pairs(searching: list[str], searched: list[str], forward: bool, among: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places in both lists of the near words that one edit makes: searching words have one length, searched ones the same or one more.

    Edits are those behind the first half of a searching word, or else those within it. With among, the searching words are
    among those searched, so that an interval of one holds nothing new.
    """
    none = np.zeros(0, np.int64)
    if not searching or not searched:
        return none, none
    n, m = len(searching[0]), len(searched[0])
    x, y = matrix(searching, n), matrix(searched, m)
    begin, end = Order(x, y), Order(x[:, ::-1], y[:, ::-1])
    by_begin = np.empty(len(y), np.int64)
    by_begin[begin.rank] = np.arange(len(y))
    tree, by_end = Wavelet(end.rank[by_begin]), np.empty(len(y), np.int64)
    by_end[end.rank] = np.arange(len(y))
    found: list[tuple[np.ndarray, np.ndarray]] = [(none, none)]
    for i in range(n // 2, m) if forward else range(n // 2):
        a, b = begin.interval(i)
        low, high = end.interval(m - 1 - i)
        worth = np.flatnonzero((b - a > among) & (high - low > among))
        if not len(worth):
            continue
        q, value = tree.report(a[worth], b[worth], low[worth], high[worth])
        q, other = worth[q], by_end[value]
        differ = x[q, i] != y[other, i] if i < n else np.ones(len(q), bool)  # the first place where they differ is this one
        found.append((q[differ], other[differ]))
    return tuple(np.concatenate(side) for side in zip(*found, strict=True))


def best_of(owner: np.ndarray, words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each owner: its number, how many rows it has, and the row of the largest n and then the first word."""
    order = np.lexsort((words, -n, owner))
    owner = owner[order]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return owner[first], np.diff(np.concatenate([first, [len(owner)]])), order[first]


FOUND = T.StructType([T.StructField("word", T.StringType()), T.StructField("n_near", T.LongType()), T.StructField("best_n", T.LongType()), T.StructField("best", T.StringType())])


def search(group: pa.Table) -> pa.Table:
    """FOUND rows of one block of a bucket: searching words against the words searched, group by group of lengths and direction."""
    word, n = np.array(group.column("word").to_pylist(), object), group.column("n").to_numpy()
    forward, length, searching, searched = (group.column(c).to_numpy(zero_copy_only=False) for c in ("forward", "length", "searching", "searched"))
    size = np.array([len(w) for w in word], np.int64)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for way, l in sorted(set(zip(forward.tolist(), length.tolist(), strict=True))):
        here = (forward == way) & (length == l)
        short = np.flatnonzero(here & (size == l) & searching)
        for m in (l, l + 1):
            other = np.flatnonzero(here & (size == m) & searched)
            a, b = near_pairs(word[short].tolist(), word[other].tolist(), way, m == l and bool(searched[short].all()))
            a, b = short[a], other[b]
            out += [(a, b)] if m == l else [(a, b), (b, a)]
    left, right = (np.concatenate(side) for side in zip(*out, strict=True))
    if not len(left):
        return pa.table({f.name: [] for f in FOUND}, schema=pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())]))
    names, code = np.unique(word, return_inverse=True)  # code points in order
    owner, count, best = best_of(code[left], code[right], n[right])
    return pa.table({"word": pa.array(names[owner].tolist(), pa.string()), "n_near": pa.array(count), "best_n": pa.array(n[right[best]]), "best": pa.array(word[right[best]].tolist(), pa.string())})


def halves(words: DataFrame, least: int) -> DataFrame:
    """(word, n, length, forward, key): the groups a word belongs to, as one of their shorter words and as one with a code point more."""
    size, w = F.char_length("word"), F.col("word")
    both = words.select("*", F.explode(F.array(size, size - 1)).alias("length")).where(F.col("length") >= least)
    half = F.floor(F.col("length") / 2).cast("int")
    ends = F.array(F.struct(F.lit(True).alias("forward"), F.substring(w, F.lit(1), half).alias("key")), F.struct(F.lit(False).alias("forward"), F.right(w, F.col("length") - half).alias("key")))
    return both.select("word", "n", "length", F.inline(ends))


def near(words: DataFrame, least: int, bucket: int = BUCKET, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """(word, n_near, best): how many near words each word has, if any, and the best one as (best_n, best)."""
    places = written(halves(words, least), "halves")
    # one word alone in its group can't meet another
    sizes = places.groupBy("forward", "length", "key").agg(F.count("*").alias("words")).where("words > 1").withColumn("fits", F.greatest(F.lit(2), F.least(F.lit(bucket), F.floor(F.lit(bucket_chars) / F.col("length")))))
    dealt = places.join(written(sizes, "sizes").hint("merge"), ["forward", "length", "key"]).withColumn("blocks", F.ceil(F.col("words") / F.col("fits")).cast("int"))
    dealt = written(dealt, "dealt")
    total = dealt.agg(F.count("*").alias("rows"), F.sum("length").alias("chars")).first()
    buckets = max(1, -(-total["rows"] // bucket), -(-(total["chars"] or 0) // bucket_chars))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    where = F.pmod(F.xxhash64("forward", "length", "key"), F.lit(buckets)).alias("bucket")
    columns = ["word", "n", "forward", "length"]
    whole = dealt.where("blocks = 1").select(where, F.lit("").alias("key"), F.lit(0).alias("i"), F.lit(0).alias("j"), *columns, F.lit(True).alias("searching"), F.lit(True).alias("searched"))
    spread = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    hot = dealt.where("blocks > 1")
    rows = hot.select(where, "key", own.alias("i"), spread.alias("j"), *columns, F.lit(True).alias("searching"), F.lit(False).alias("searched"))
    others = hot.select(where, "key", spread.alias("i"), own.alias("j"), *columns, F.lit(False).alias("searching"), F.lit(True).alias("searched"))
    ship(words.sparkSession)
    found = whole.unionByName(rows).unionByName(others).groupBy("bucket", "key", "i", "j").applyInArrow(search, FOUND)
    # the largest count, of equal ones the first word: least words by count, then the largest count
    ranked = found.groupBy("word", "best_n").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return ranked.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max(F.struct("best_n", "best")).alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, by pointer doubling."""
    spark, now = forms.sparkSession, written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(now.join(up.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(spark, now)
        now = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return now


@tidy
def spelling_variants(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_length: int = 6, least_n: int = 5, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word of the texts."""
    words = written(occurrences(df, text_col, id_col).where((F.col("n") >= least_n) & (F.char_length("word") >= least_length)), "words")
    found = near(words, least_length)
    both = words.join(found.hint("merge"), "word", "left")
    good = F.col("best.best_n") >= times * F.col("n")
    formed = written(both.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.best")).alias("form"), F.when(good, F.col("best.best_n")).alias("form_n")), "forms")
    roots = rooted(formed.where("form is not null"))
    return formed.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir):
    """The frequent words of all documents with their most frequent near words."""
    return spelling_variants(table(spark, sf_dir, "documents"))
