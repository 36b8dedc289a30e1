"""Models on data frames: scores, attributions and permutation importance, by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import ship
from ..functions.columns import order_key, own_name
from ..operators import metrics, ranks


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def each(rows: int, values: np.ndarray) -> np.ndarray:
    """The values, one a row; ValueError if there are fewer or more."""
    if len(values) != rows:
        raise ValueError(f"{len(values)} results for {rows} rows")
    return values


def with_scores(df: DataFrame, key: str, features: str, width: int, score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(key, score); an error if a batch gets another number of scores than it has rows."""
    src = df.select(F.col(key).alias("key"), F.col(features).alias("x"))
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(each(b.num_rows, score(matrix(b.column(1), width))).astype(float))], names=["key", "score"])

    return src.mapInArrow(run, T.StructType([src.schema["key"], T.StructField("score", T.DoubleType())])).withColumnRenamed("key", key)


def with_attributions(df: DataFrame, key: str, features: str, width: int, attribute: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(key, feature number, value) in long form."""
    src = df.select(F.col(key).alias("key"), F.col(features).alias("x"))
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = each(b.num_rows, attribute(matrix(b.column(1), width)))
            rows = np.repeat(np.arange(len(v)), width)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(width), len(v)).astype(np.int32)), pa.array(v.ravel())], names=["key", "feature", "value"])

    return src.mapInArrow(run, T.StructType([src.schema["key"], T.StructField("feature", T.IntegerType()), T.StructField("value", T.DoubleType())])).withColumnRenamed("key", key)


def donors(n: np.ndarray, size: int, key: int) -> np.ndarray:
    """A permutation of 0 to size - 1 at the places n: four Feistel rounds over the next even number of bits, again for what falls outside."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, left = n.astype(np.uint64), np.arange(len(n))
    with np.errstate(over="ignore"):
        while len(left):
            a, b = out[left] >> half, out[left] & mask
            for turn in range(4):
                x = b + np.uint64((key * 4 + turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                a, b = b, a ^ ((x ^ (x >> np.uint64(31))) & mask)
            out[left] = a << half | b
            left = left[out[left] >= size]
    return out.astype(np.int64)


def with_donors(df: DataFrame, key: str, repeats: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(n, columns): df with numbers from 0 in a reproducible order; and (n, r, donor): the row that each row meets in each repeat."""
    mixed = own_name(df.columns, "mixed")
    placed = ranks.with_ranks(df.withColumn(mixed, order_key(seed, key)), [], [F.col(mixed), F.col(key)]).drop(mixed)
    placed = placed.withColumn(ranks.RANK, F.col(ranks.RANK) - 1).withColumnRenamed(ranks.RANK, "n").withColumnRenamed(ranks.SIZE, "size")
    ship(df.sparkSession)

    @F.arrow_udf("array<bigint>")
    def dealt(n: pa.Array, size: pa.Array) -> pa.Array:
        if not len(n):
            return pa.array([], pa.list_(pa.int64()))
        at, rows = n.to_numpy(zero_copy_only=False), size[0].as_py()
        each_ = np.stack([donors(at, rows, seed * 1000 + r) for r in range(repeats)], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, each_.size + 1, repeats), pa.int32()), pa.array(each_.ravel()))

    return placed.drop("size"), placed.select("n", F.posexplode(dealt("n", "size")).alias("r", "donor"))


def permutation_importance(df: DataFrame, key: str, features: str, label: str, width: int, score: Callable[[np.ndarray], np.ndarray], chosen: list[int], repeats: int = 5, seed: int = 0, threshold: float = 0.5) -> DataFrame:
    """(feature, mean_drop, std_drop, baseline_macro_f1, repeats): how macro F1 drops when a feature's values are dealt anew among the
    rows; largest drops first.

    In each repeat every row meets one other row, by a keyed permutation of row numbers, and each feature in turn takes that row's
    value: a join of `repeats` rows for each row scores all features.
    """
    base = df.select(F.col(key).alias("key"), F.transform(features, lambda x: x.cast("double")).alias("x"), F.col(label).cast("int").alias("y"))
    placed, dealt = with_donors(base, "key", repeats, seed)
    pairs = dealt.join(placed.select("n", "x", "y"), "n").select("donor", "r", "x", "y")
    met = pairs.join(placed.select(F.col("n").alias("donor"), F.col("x").alias("other")), "donor").select("r", "x", "other", "y")
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            r, y = b.column(0).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False).astype(float)
            rows, other = matrix(b.column(1), width), matrix(b.column(2), width)
            out = []

            def count(feature: int, turn: int, of: np.ndarray, x: np.ndarray) -> None:
                said, t = ~(each(len(x), score(x)) < threshold), y[of]
                out.append((feature, turn, *(int(((t == 1 if a else (t != 1) & ~np.isnan(t)) & (said == bool(p))).sum()) for a, p in ((0, 0), (0, 1), (1, 0), (1, 1)))))

            for turn in np.unique(r).tolist():
                of = np.flatnonzero(r == turn)
                x = rows[of]
                if turn == 0:  # each row is met once in each repeat: in the first one as it is
                    count(0, -1, of, x)
                for feature in chosen:
                    held = x[:, feature].copy()
                    x[:, feature] = other[of, feature]
                    count(feature, turn, of, x)
                    x[:, feature] = held
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    names = ["feature", "r", "tn", "fp", "fn", "tp"]
    counted = met.mapInArrow(run, T.StructType([T.StructField(n, T.LongType()) for n in names]))
    # r is -1 for the rows as they are
    scored = metrics.metrics(counted.groupBy("feature", "r").agg(*[F.sum(n).alias(n) for n in names[2:]]))
    everything = Window.partitionBy()  # a row for each shuffle
    drops = scored.withColumn("baseline", F.max(F.when(F.col("r") < 0, F.col("macro_f1"))).over(everything)).where("r >= 0").withColumn("drop", F.col("baseline") - F.col("macro_f1"))
    out = drops.groupBy(F.col("feature").cast("int").alias("feature")).agg(F.round(F.avg("drop"), 9).alias("mean_drop"), F.round(F.stddev_pop("drop"), 9).alias("std_drop"), F.round(F.max("baseline"), 9).alias("baseline_macro_f1"), F.count("*").alias("repeats"))
    return out.orderBy(F.desc("mean_drop"), "feature")
