"""Samples that come out the same everywhere: rows are ranked by the md5 of a seed and their key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import half_even, order_key, own_name, ratio
from .ranks import RANK, SIZE, with_ranks
from .splits import THINNED, TRAIN, VAL


def shuffled(df: DataFrame, stream: Sequence[str], key: str, seed: int | str) -> DataFrame:
    """df with ranks in each stream's reproducible shuffle."""
    mixed = own_name(df.columns, "mixed")
    return with_ranks(df.withColumn(mixed, order_key(seed, key)), stream, [F.col(mixed), F.col(key)]).drop(mixed)


def thin_attacks(df: DataFrame, stream: Sequence[str], key: str, seed: int, per_benign: float, splits: Sequence[int] = (TRAIN, VAL), y: str = "y") -> DataFrame:
    """df with attacks beyond per_benign for each benign row of their split marked THINNED, in proportion within each stream.

    Splits whose attacks fit are left alone, as are benign rows; each stream keeps a row at least.
    """
    sums = df.groupBy("split").agg(F.count_if(F.col(y) == 0).alias("__b"), F.count_if(F.col(y) == 1).alias("__a"))
    budget = F.col("__b") * F.lit(float(per_benign))
    rates = sums.select("split", F.when(F.col("split").isin(*splits) & (F.col("__a") > budget), ratio(budget, F.col("__a"))).alias("__rate"))
    ranked = shuffled(df, ["split", y, *stream], key, seed).join(F.broadcast(rates), "split")  # one row a split
    keep = F.least(F.col(SIZE), F.greatest(F.lit(1), half_even(F.col(SIZE) * F.col("__rate"))))
    thinned = F.col("__rate").isNotNull() & (F.col(y) == 1) & (F.col(RANK) > keep)
    return ranked.withColumn("split", F.when(thinned, THINNED).otherwise(F.col("split"))).drop(RANK, SIZE, "__rate")


def stratified_sample(df: DataFrame, label: str, key: str, seed: int, size: int) -> DataFrame:
    """About `size` rows in the classes' proportions, one of each class at least; all rows if there are no more."""
    total = df.agg(F.count("*").alias("__total"))
    ranked = shuffled(df, [label], key, seed).join(F.broadcast(total))  # one row
    take = F.least(F.col(SIZE), F.greatest(F.lit(1), half_even(F.lit(size) * F.col(SIZE) / F.col("__total"))))
    return ranked.where((F.col("__total") <= size) | (F.col(RANK) <= take)).drop(RANK, SIZE, "__total")


def plain_sample(df: DataFrame, key: str, seed: int, size: int) -> DataFrame:
    """`size` rows, whatever their class."""
    return df.orderBy(order_key(seed, key), key).limit(size)


def batches(df: DataFrame, key: str, seed: int, epoch: int, size: int) -> DataFrame:
    """df with batch: numbers of shuffled mini-batches of `size` rows."""
    ranked = shuffled(df, [], key, f"{seed}|{epoch}")
    return ranked.withColumn("batch", F.floor((F.col(RANK) - 1) / size).cast("long")).drop(RANK, SIZE)
