"""Quality rules: statistics of each text, fixed base rules, and an isolation forest over the statistics.

The forest's trees split at random places; a document that few splits isolate is anomalous. It is fitted on at most
`fit_rows` labelled documents (those whose ids hash lowest, so the sample is the same at every run). A tree's sample is
good rows with one in 64 of the others, so that junk is rare in it and soon alone; features are split on as often as they
alone tell the labels apart. The threshold is calibrated on every labelled row that passes the base rules, good or not: of
those that reject at most `good_lost` of the good rows it has the best balanced accuracy, in the middle of the gap between
labelled scores. Without labelled bad rows it is the lowest one within that bound; with no labelled good rows nothing is
rejected by the forest.

Cases: a null or empty text has no words and fails the base rules; very long texts are handled alone; labels with a null
id or quality are left out, repeated ones weigh as often as they occur; an empty table gives no rows; other columns
are ignored by quality_rules() and kept by keep_good(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, map_texts, numbered, quoted, text_blocks, tidy, written
from .textarrays import Words, windows, words_of

# The base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: What the forest splits on. Repetition is left to the base rule: clean texts that quote themselves would be outliers.
FEATURES = ("word length", "symbols a word", "words a line")

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True


def by_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def repeated(words: Words) -> np.ndarray:
    """Of each text: the words in 3-word windows that occur twice or more in it."""
    h = words.hashes()
    n = len(words.first) - 1
    runs = windows(h, WINDOW, 0xD6E8FEB86659FD93)
    owner = np.repeat(np.arange(n), np.diff(words.first))
    inside = owner[: len(runs)] == owner[WINDOW - 1 :] if len(runs) else np.zeros(0, bool)
    place = np.flatnonzero(inside)
    key = runs[place] + owner[place].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # the same run in two texts differs
    _, codes, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = place[counts[codes] > 1]
    covered = np.zeros(len(h), bool)
    for j in range(WINDOW):
        covered[twice + j] = True
    return by_text(covered, words.first)


def statistics(texts: pa.Array) -> np.ndarray:
    """STATS by text."""
    words = words_of(texts)
    data, n = words.data, len(texts)
    at = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, words.starts, 1)
    np.add.at(inside, words.ends, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    chars = by_text(inside & ((data & 0xC0) != 0x80), at)
    symbols = by_text(IS_SYMBOL[data], at)
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, raw in enumerate(texts.cast(pa.binary()).to_pylist()):
        if b"\n" in raw:
            full = [x for x in raw.split(b"\n") if x.strip()]
            dup[i], lines[i] = len(full) - len(set(full)), len(full)
        else:
            lines[i] = 1
    return np.stack([np.diff(words.first), chars, symbols, dup, repeated(words), lines], axis=1)


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < LEAST_WORDS) | (100 * stats[:, 4] > MOST_REPEATED * stats[:, 0])


def features(stats: np.ndarray) -> np.ndarray:
    words, lines = np.maximum(stats[:, 0], 1), np.maximum(stats[:, 5], 1)
    return np.stack([stats[:, 1] / words, np.log1p(20 * stats[:, 2] / words), np.log1p(stats[:, 0] / lines)], axis=1)


def separation(rows: np.ndarray, good: np.ndarray) -> np.ndarray | None:
    """How far each feature alone tells good rows from the others: 0.01 (not at all) to 1; None with one kind of rows."""
    n, m = int(good.sum()), int((~good).sum())
    if not n or not m:
        return None
    out = []
    for column in rows.T:
        _, place, count = np.unique(column, return_inverse=True, return_counts=True)
        rank = (np.cumsum(count) - (count - 1) / 2)[place]
        out.append(abs(2 * (rank[good].sum() - n * (n + 1) / 2) / (n * m) - 1))
    return np.maximum(out, 0.01)


class IsolationForest:
    """Trees as arrays: feature (-1 at a leaf), threshold, left child (right is the next one), path length at leaves."""

    def __init__(self, rows: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7, good: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        weights = None if good is None else separation(rows, good)
        kinds = [np.arange(len(rows))] if weights is None else [np.flatnonzero(good), np.flatnonzero(~good)]
        few = 0 if weights is None else min(max(sample // 64, 1), len(kinds[1]))
        wanted = [min(sample - few, len(kinds[0])), few]
        self.sample = sum(wanted)
        deepest = int(np.ceil(np.log2(max(self.sample, 2))))
        self.trees = []
        for _ in range(trees):
            nodes: list[list[float]] = [[-1, 0, 0, 0]]
            picked = np.concatenate([rng.choice(kind, k, replace=False) for kind, k in zip(kinds, wanted, strict=False)])
            todo = [(0, rows[picked], 0)]
            while todo:
                k, part, depth = todo.pop()
                low, high = part.min(axis=0), part.max(axis=0)
                wide = np.flatnonzero(high > low)
                if depth >= deepest or not len(wide):
                    nodes[k] = [-1, 0, 0, depth + self.usual(len(part))]
                    continue
                f = int(rng.choice(wide, p=None if weights is None else weights[wide] / weights[wide].sum()))
                cut = rng.uniform(low[f], high[f])
                below = part[:, f] < cut
                nodes[k] = [f, cut, len(nodes), 0]
                todo += [(len(nodes), part[below], depth + 1), (len(nodes) + 1, part[~below], depth + 1)]
                nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
            self.trees.append(np.array(nodes))
        self.deepest = deepest

    @staticmethod
    def usual(n: int) -> float:
        """The mean path of a failed search in a binary tree of n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1: higher is more anomalous."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for tree in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.deepest):
                f = tree[at, 0].astype(np.int64)
                go = f >= 0
                right = rows[every, np.maximum(f, 0)] >= tree[at, 1]
                at = np.where(go, tree[at, 2].astype(np.int64) + right, at)
            total += tree[at, 3]
        return np.round(2 ** (-total / len(self.trees) / max(self.usual(self.sample), 1e-9)), 6)


def rule_stats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id and STATS of each row."""
    fields = [T.StructField(s, T.LongType()) for s in STATS]
    return map_texts(df, text_col, [(id_col, quoted(id_col))], fields, lambda texts: [pa.array(c) for c in statistics(texts).T])


class Judge:
    """The base rules and, if one could be fitted, a forest with its threshold."""

    def __init__(self, forest: IsolationForest | None = None, threshold: float = 2.0):
        self.forest, self.threshold = forest, threshold

    def __call__(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """base_failed, kept, score."""
        failed = base_failed(stats)
        score = np.zeros(len(stats)) if self.forest is None or not len(stats) else self.forest.score(features(stats))
        return failed, ~failed & (score < self.threshold), score


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", fit_rows: int = 8192, good_lost: float = 0.0005, label_id_col: str | None = None) -> Judge:
    """A judge from the statistics of all documents (as rule_stats() gives them) and the labels (1: good).

    The labels' ids are in label_id_col, by default called like those of stats."""
    known = labels.select(quoted(label_id_col or id_col).alias("__id"), quoted(label_col).cast("int").alias("__y")).where("__id is not null and __y is not null")
    passed = stats.where((F.col("n_words") >= LEAST_WORDS) & (100 * F.col("n_repeat_words") <= MOST_REPEATED * F.col("n_words")))
    rows = written(passed.join(known, quoted(id_col) == F.col("__id")).select("__y", "__id", *STATS), "labelled")  # the base rules settle the others
    n = rows.count()
    place = F.pmod(F.xxhash64("__id"), F.lit(1 << 30))
    low = (1 << 30) if n <= 4 * fit_rows else int((1 << 30) * 2 * fit_rows / n)  # about twice as many as are wanted
    picked = rows.where(place < low).orderBy(place, "__id", *STATS).limit(fit_rows).toPandas()  # bounded by fit_rows
    if not len(picked):
        return Judge()
    forest = IsolationForest(features(picked[list(STATS)].to_numpy(np.int64)), good=picked["__y"].to_numpy() == 1)
    schema = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("good", T.BooleanType())])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(forest.score(features(s)) * 2000) / 2000), b.column(0)], names=["score", "good"])

    # every labelled row counts; scores are counted in at most 2001 steps
    seen = arrow_map(rows.select((F.col("__y") == 1).alias("good"), *STATS), scores, schema).groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toPandas()
    return Judge(forest, calibrated(seen["score"].to_numpy(), seen["good"].to_numpy(), seen["bad"].to_numpy(), good_lost))


def calibrated(steps: np.ndarray, good: np.ndarray, bad: np.ndarray, good_lost: float) -> float:
    """The threshold for scores counted in steps of 0.0005."""
    if not good.sum():
        return 2.0
    at = np.argsort(-steps)
    steps, lost, caught = steps[at], np.concatenate([[0], np.cumsum(good[at])]), np.concatenate([[0], np.cumsum(bad[at])])
    most = int((lost[1:] <= good_lost * lost[-1]).sum())  # so many of the highest steps may be rejected
    k = int(np.argmax((caught / caught[-1] - lost / lost[-1])[: most + 1])) if caught[-1] else most
    top = float(steps[k]) + 0.0005  # the end of the highest step that is kept
    return (top + (float(steps[k - 1]) if k else top + 0.02)) / 2


@tidy
def quality_rules(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", **fitting) -> DataFrame:
    """id, the statistics, base_failed, kept, score of each row. The statistics are read once and written."""
    stats = written(rule_stats(df.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")), "text", "id"), "stats")
    judge = fit(stats, labels, "id", label_id_col=id_col, **fitting)
    schema = T.StructType([*stats.schema, T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, judge(s))], names=schema.names)

    return arrow_map(stats, run, schema).withColumnRenamed("id", id_col)


@tidy
def keep_good(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", **fitting) -> DataFrame:
    """The rows of df that the rules keep, with all their columns. Texts are read once and written with their statistics."""
    own, place = numbered(df), df.columns.index(text_col)
    schema = T.StructType([*own.schema, *(T.StructField(s, T.LongType()) for s in STATS)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_blocks(batch, place):
                stats = statistics(pc.fill_null(part.column(place).cast(pa.string()), ""))
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, stats.T)], names=schema.names)

    marked = written(arrow_map(own, measure, schema), "marked")
    judge = fit(marked.select(F.col(f"c{df.columns.index(id_col)}").alias("id"), *STATS), labels, "id", label_id_col=id_col, **fitting)

    @F.arrow_udf("boolean")
    def keeps(*stats: pa.Array) -> pa.Array:
        return pa.array(judge(np.stack([c.to_numpy(zero_copy_only=False) for c in stats], axis=1))[1])

    return marked.where(keeps(*[F.col(s) for s in STATS])).select(*own.columns).toDF(*df.columns)


def op3_quality_rules(spark, sf_dir):
    """The documents judged with the labels' quality."""
    from .common import table

    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *STATS[:5], "base_failed", "kept", "score")
