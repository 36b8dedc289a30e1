"""Substring dedup by a compacted De Bruijn graph of token k-mers.

A word goes if it lies in a run of `window` words that also starts in a document with a smaller id.

1. The graph is sparse: of every `window` consecutive words the k-mer with the least hash is a node (the first on ties), so
   each window holds a node, and equal windows hold the same one. The token string from a node to the next, with both
   of them, is an edge. A document is a walk through the graph, from an opening to a closing edge. Nodes and edges are
   written once, with their source coordinates (document and word).
2. Nodes are summed up over the corpus: least and largest document, least and largest edge in and out. Those of
   one document are done: no window with one of them is repeated from elsewhere. The others go through a filter and an
   exact join.
3. Nonbranching paths compact by joins: where all walks leave a node by one edge, and all come into the next by it, the next
   one points back; pointers are doubled, join by join, until each node knows the head of its path and its rank on it.
   All walks through a path's node go through the whole path, so a path's windows share its least document.
4. A document's run of nodes on one path, with the words at its coordinates, is a span. Spans of `window` words or more
   are verified whole: their words, read at the source coordinates, are hashed to 128 bits and matched against those
   of the other documents. Windows across branches whose node is repeated are matched in the same way, one by one.
   The least document of each hash is found (partial minima first) and joined back.
5. Spans meet the texts of the documents that may have any.

Cases: a null or empty text has no words; rows that repeat an id are one document (none is smaller than another), each
gets its own row; a null id counts as the largest; ids are whole numbers (or text of such: others are an error); very long
texts are handled alone; words are bytes between ASCII white space; an empty table gives no rows; other columns are
ignored by dedup_passages() and kept by drop_passages(), whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KeyFilter, arrow_map, dropped, flat_map_texts, map_texts, numbered, quoted, same, text_blocks, text_of, tidy, written
from .textarrays import mix, power_table, windows, words_of

U = np.uint64
KMER_BASE, EDGE_BASE, FIRST_BASE, SECOND_BASE = 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25, 0xA24BAED4963EE407
#: What comes before a document's first sampled k-mer, and after its last.
OPEN, CLOSE = 1, 2


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least value in each run of `width` values; it never goes back."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    low, at, size = values, np.arange(len(values)), 1

    def join(a: np.ndarray, i: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        later = a[step:] < a[:-step]
        return np.where(later, a[step:], a[:-step]), np.where(later, i[step:], i[:-step])

    while size * 2 <= width:
        low, at = join(low, at, size)
        size *= 2
    if width > size:
        low, at = join(low, at, width - size)
    return at


@lru_cache(8)
def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def span_hashes(h: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of the words in each span, wherever it stands."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(h * power_table(base, len(h))[: len(h)])])
    return mix((sums[end] - sums[begin]) * power_table(inverse(base), len(h))[begin] + (end - begin).astype(U))


class Path:
    """The sampled k-mers of one document's word hashes: places, hashes, edges in and out."""

    def __init__(self, h: np.ndarray, k: int, window: int):
        hashes = windows(h, k, KMER_BASE)
        at = least_places(hashes, window - k + 1)
        new = np.diff(at, prepend=-1) > 0
        self.places = at[new]
        self.of_window = np.cumsum(new) - 1  # which place was taken from each window
        self.hashes = hashes[self.places]
        self.k = k

    def edges(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.places)
        into, out = np.full(n, OPEN, U), np.full(n, CLOSE, U)
        if n > 1:
            out[:-1] = into[1:] = span_hashes(mix(h), self.places[:-1], self.places[1:] + self.k, EDGE_BASE)
        return into, out


def spans_and_windows(path: Path, n: int, places: np.ndarray, head: np.ndarray, rank: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a walk of n words with some nodes repeated: the spans that lie on one path, as begins and ends, and the starts of
    the windows that lie on none, each with the number of its node among the repeated ones."""
    at, k = path.places, path.k
    slot = np.searchsorted(at, places)
    known = np.full(len(at), -1)
    known[slot] = np.arange(len(slot))
    on = np.diff(slot) == 1
    tied = np.zeros(max(len(at) - 1, 0), bool)
    tied[slot[:-1][on]] = ((head[1:] == head[:-1]) & (rank[1:] == rank[:-1] + 1))[on]
    bounds = np.diff(np.concatenate([[False], tied, [False]]).astype(np.int8))
    first, last = np.flatnonzero(bounds == 1), np.flatnonzero(bounds == -1)
    begin, end = at[first], at[last] + k
    wide = end - begin >= window
    first, begin, end = first[wide], begin[wide], end[wide]
    settled = np.zeros(n - window + 2, np.int64)
    np.add.at(settled, begin, 1)
    np.add.at(settled, end - window + 1, -1)
    # the k-mer taken from a window is taken from equal windows too: others inside it need not be
    starts = np.flatnonzero((np.cumsum(settled[:-1]) == 0) & (known[path.of_window] >= 0))
    node = known[np.concatenate([first, path.of_window[starts]])]
    return np.concatenate([begin, starts]), np.concatenate([end, starts + window]), node


def fields(*items: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(*i) for i in items])


LONG, INT, FLAG = T.LongType(), T.IntegerType(), T.BooleanType()


def batch_of(part: pa.RecordBatch, owners: list[int], counts: list[int], names: list[str], columns: list[list[np.ndarray]]) -> pa.RecordBatch | None:
    """Rows that repeat the first two columns of part by owner, beside the columns; places are 32-bit."""
    if not owners:
        return None
    rows = pa.array(np.repeat(np.array(owners, np.int64), counts))
    made = [np.concatenate(c) for c in columns]
    return pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), *(pa.array(c.view(np.int64) if c.dtype == U else c) for c in made)], names=names)


def scan_walks(docs: DataFrame, k: int, window: int) -> DataFrame:
    """(id, row, place, h, into, out): the nodes of every document's walk with the edges before and behind."""
    schema = fields(("id", LONG), ("row", LONG), ("place", INT), ("h", LONG), ("into", LONG), ("out", LONG))

    def fn(part: pa.RecordBatch) -> pa.RecordBatch | None:
        words = words_of(part.column(2))
        h, owners, counts, cols = words.hashes(), [], [], [[], [], [], []]
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            if b - a >= window:
                path = Path(h[a:b], k, window)
                owners.append(i)
                counts.append(len(path.places))
                for c, v in zip(cols, (path.places.astype(np.int32), path.hashes, *path.edges(h[a:b])), strict=True):
                    c.append(v)
        return batch_of(part, owners, counts, schema.names, cols)

    return flat_map_texts(docs, "text", [F.col("id"), F.col("row")], schema, fn)


def match_spans(docs: DataFrame, k: int, window: int) -> DataFrame:
    """(id, row, begin, end, h1, h2, may): spans and windows with the hashes of their words; may: of those a smaller document may have."""
    schema = fields(("id", LONG), ("row", LONG), ("begin", INT), ("end", INT), ("h1", LONG), ("h2", LONG), ("may", FLAG))

    def fn(part: pa.RecordBatch) -> pa.RecordBatch | None:
        words = words_of(part.column(3))
        h, owners, counts, cols = words.hashes(), [], [], [[], [], [], [], []]
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            mine = h[a:b]
            place, smaller, head, rank = (s.to_numpy(zero_copy_only=False) for s in part.column(2)[i].values.flatten())
            order = np.argsort(place)
            begin, end, node = spans_and_windows(Path(mine, k, window), b - a, place[order], head[order], rank[order], window)
            one, two = span_hashes(mine, begin, end, FIRST_BASE), span_hashes(mix(mine), begin, end, SECOND_BASE)
            owners.append(i)
            counts.append(len(begin))
            for c, v in zip(cols, (begin.astype(np.int32), end.astype(np.int32), one, two, smaller[order][node]), strict=True):
                c.append(v)
        return batch_of(part, owners, counts, schema.names, cols)

    return flat_map_texts(docs, "text", [F.col("id"), F.col("row"), F.col("nodes")], schema, fn)


def keyed(text: Column, key: Column) -> list[Column]:
    """What tells documents apart: id, and row, a hash of the text."""
    return [key.cast("long").alias("id"), F.xxhash64(text_of(text)).alias("row"), text_of(text).alias("text")]


def key_hash() -> Column:
    return F.xxhash64("row", "id")


def compacted(nodes: DataFrame) -> DataFrame:
    """(h, head, rank) of every node (h, one_in, one_out, into, out) that another one precedes on a nonbranching path.

    Each round a pointer takes over the pointer of what it points to, so a path of n nodes takes log2(n) rounds. Those that
    have come to their head are put aside. There is no cycle: a walk enters one from outside, so that node branches.
    """
    before = nodes.where("one_out").select(F.col("h").alias("head"), F.col("out").alias("edge"))
    after = nodes.where("one_in").select("h", F.col("into").alias("edge"))
    moving, done = written(after.join(before, "edge").select("h", "head", F.lit(1).alias("rank")), "pointers"), []
    while not moving.isEmpty():
        every = reduce(DataFrame.unionByName, [moving, *done])
        ahead = every.select(F.col("h").alias("at"), F.col("head").alias("next"), F.col("rank").alias("further"))
        step = moving.join(ahead, F.col("head") == F.col("at"), "left")
        step = written(step.select("h", F.coalesce("next", "head").alias("head"), (F.col("rank") + F.coalesce("further", F.lit(0))).alias("rank"), F.col("next").isNotNull().alias("moved")), "pointers")
        done.append(step.where("not moved").drop("moved"))
        moving = step.where("moved").drop("moved")
    return reduce(DataFrame.unionByName, done) if done else moving


def spans(docs: DataFrame, k: int, window: int) -> DataFrame:
    """(id, row, cuts): the word spans that go, of every document (id, row, text) that loses any."""
    walks = written(scan_walks(docs, k, window), "walks")
    ends = [f(c).alias(f"{c}_{f.__name__}") for c in ("into", "out") for f in (F.min, F.max)]
    sums = walks.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.bool_or(F.col("id").isNull()).alias("none"), *ends)
    shared = sums.where("least < most or none and least is not null")
    nodes = written(shared.select("h", "least", (F.col("into_min") == F.col("into_max")).alias("one_in"), (F.col("out_min") == F.col("out_max")).alias("one_out"), F.col("into_min").alias("into"), F.col("out_min").alias("out")), "nodes")
    placed = nodes.select("h", "least").join(compacted(nodes), "h", "left").select("h", "least", F.coalesce("head", "h").alias("head"), F.coalesce("rank", F.lit(0)).alias("rank"))
    known = written(placed, "paths")
    likely, _ = KeyFilter.of(nodes, "h").split(walks.select("h", "id", "row", "place"), F.col("h"))
    smaller = F.coalesce(F.col("least") < F.col("id"), F.lit(True))  # a null id is the largest; a repeated node's least is none
    found = likely.join(known, "h").select("id", "row", F.struct("place", smaller.alias("smaller"), "head", "rank").alias("node"))
    marked = written(found.groupBy("id", "row").agg(F.collect_set("node").alias("nodes")), "marked")
    maybe, _ = KeyFilter.of(marked.select(key_hash().alias("h")), "h").split(docs, key_hash())
    marks = written(match_spans(maybe.join(marked, same(maybe, marked, "id", "row")).select(maybe["id"], maybe["row"], "nodes", "text"), k, window), "marks")
    dropped(docs.sparkSession, walks, marked)
    first = marks.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.bool_or(F.col("id").isNull()).alias("none"))
    first = written(first.where("least < most or none and least is not null").select("h1", "h2", "least"), "first")  # a table on each side, so a common window can be split
    gone = marks.where("may").join(first, ["h1", "h2"]).where("least < id or id is null")
    return written(gone.groupBy("id", "row").agg(F.collect_set(F.struct("begin", "end")).alias("cuts")), "cuts")


def kept_words(raw: bytes, cuts: pa.Scalar) -> tuple[list[bytes], int]:
    words = raw.split()
    if not cuts.is_valid or not len(cuts):
        return words, len(words)
    begin, end = (c.to_numpy(zero_copy_only=False) for c in cuts.values.flatten())
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    stay = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(stay).tolist()], len(words)


def with_cuts(df: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df (with id and row) that may lose words, joined to their cuts, and the others."""
    maybe, whole = KeyFilter.of(cuts.select(key_hash().alias("h")), "h").split(df, key_hash())
    return maybe.join(cuts, same(maybe, cuts, "id", "row"), "left").select(*[maybe[c] for c in df.columns], "cuts"), whole


@tidy
def dedup_passages(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = 50, k: int = 15) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of each row."""
    docs = df.select(quoted(id_col).alias("doc"), *keyed(quoted(text_col), quoted(id_col)))
    joined, whole = with_cuts(docs, spans(docs.select("id", "row", "text"), k, window))
    kinds = [T.StructField("n_words", LONG), T.StructField("n_removed", LONG), T.StructField("kept_sha256", T.StringType())]

    def plain(texts: pa.Array) -> list[pa.Array]:
        split = [t.as_py().split() for t in texts.cast(pa.binary())]
        return [pa.array([len(w) for w in split], pa.int64()), pa.array([0] * len(split), pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in split], pa.string())]

    def cut(batches):
        for batch in batches:
            for part in text_blocks(batch, 1):
                got = [kept_words(t.as_py(), c) for t, c in zip(part.column(1).cast(pa.binary()), part.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in got], pa.int64()), pa.array([n - len(w) for w, n in got], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in got], pa.string())], names=names)

    names = ["doc", *(f.name for f in kinds)]
    whole = map_texts(whole, "text", [("doc", F.col("doc"))], kinds, plain)
    joined = joined.select("doc", "text", "cuts")
    return whole.unionByName(arrow_map(joined, cut, T.StructType([joined.schema["doc"], *kinds]))).withColumnRenamed("doc", id_col)


@tidy
def drop_passages(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = 50, k: int = 15) -> DataFrame:
    """df with its texts cut: where words go, the others are joined by single blanks; other texts stay as they are."""
    own, place = numbered(df), df.columns.index(text_col)
    docs = own.select("*", *keyed(F.col(f"c{place}"), F.col(f"c{df.columns.index(id_col)}")))
    joined, whole = with_cuts(docs.drop("text"), spans(docs.select("id", "row", "text"), k, window))
    columns, n = own.columns, len(own.columns)

    def cut(batches):
        for batch in batches:
            for part in text_blocks(batch, place):
                texts = [t.as_py() if not c.is_valid else b" ".join(kept_words(t.as_py(), c)[0]) for t, c in zip(part.column(place).cast(pa.binary()), part.column(n), strict=True)]
                new = pa.array(texts, pa.binary()).cast(part.column(place).type)
                yield pa.RecordBatch.from_arrays([new if i == place else part.column(i) for i in range(n)], names=columns)

    out = arrow_map(joined.select(*columns, "cuts"), cut, own.schema)
    return whole.select(*columns).unionByName(out).toDF(*df.columns)


def op5_substring_dedup(spark, sf_dir):
    """The documents without the runs of 50 words that a document before them has."""
    from .common import table

    return dedup_passages(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM (SELECT doc_id, i FROM win JOIN least USING (h) WHERE m < doc_id) CROSS JOIN range(50) r(o)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
marked AS (SELECT words.doc_id, word, words.p, gone.p IS NOT NULL AS goes FROM words LEFT JOIN gone USING (doc_id, p)),
kept AS (SELECT doc_id, count(*) FILTER (WHERE goes) AS n, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT goes) AS t FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
