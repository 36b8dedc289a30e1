"""Train, validation and test splits, and what is reported about them.

Splits are codes: 0 train, 1 validation, 2 test, -1 duplicate or out of scope, -2 thinned out. A cut is made by a row's
rank among its stream and the stream's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, half_even, order_key, own_name, ratio, uniform
from .ranks import RANK, SIZE, with_ranks

# The codes and the shares.
TRAIN, VAL, TEST, LEFT_OUT, THINNED = 0, 1, 2, -1, -2
NAMES = ("train", "val", "test")
SHARES = (0.70, 0.15)


def cut(rank: Column, n: Column, train: float, val: float, each: bool) -> Column:
    """The split of the rank-th of n rows. With each, three rows or more give every split at least one, fewer all go to train."""
    first, second = half_even(n * F.lit(train)), half_even(n * F.lit(val))
    if each:
        enough = n >= 3
        first = F.when(enough, F.least(F.greatest(first, F.lit(1)), n - 2)).otherwise(n)
        second = F.when(enough, F.least(F.greatest(second, F.lit(1)), n - first - 1)).otherwise(F.lit(0))
    return F.when(rank <= first, TRAIN).when(rank <= first + second, VAL).otherwise(TEST)


def by_rank(df: DataFrame, stream: Sequence[str], time: str, position: str, train: float, val: float, each: bool) -> DataFrame:
    ranked = with_ranks(df, stream, [F.col(time).asc_nulls_first(), F.col(position)])
    return ranked.withColumn("split", cut(F.col(RANK), F.col(SIZE), train, val, each)).drop(RANK, SIZE)


def temporal_stratified(df: DataFrame, file: str, label: str, time: str, position: str, train: float = SHARES[0], val: float = SHARES[1]) -> DataFrame:
    """Each (file, label) stream is cut in the order of time; rows without a time come first."""
    return by_rank(df, [file, label], time, position, train, val, True)


def temporal_within_file(df: DataFrame, file: str, time: str, position: str, train: float = SHARES[0], val: float = SHARES[1]) -> DataFrame:
    return by_rank(df, [file], time, position, train, val, False)


def by_capture_day(df: DataFrame, day: str, test_day: str, stream: Sequence[str], order: Sequence[str], train: float = SHARES[0], val: float = SHARES[1]) -> DataFrame:
    """The test day is the test split; the other days are cut into train and validation."""
    test = own_name(df.columns, "is_test")
    ranked = with_ranks(df.withColumn(test, F.col(day) == test_day), [*stream, test], [F.col(o).asc_nulls_first() for o in order])
    first = half_even(F.col(SIZE) * F.lit(train / (train + val)))
    return ranked.withColumn("split", F.when(F.col(test), TEST).when(F.col(RANK) <= first, TRAIN).otherwise(VAL)).drop(RANK, SIZE, test)


def random_cut(df: DataFrame, key: str, seed: int, train: float = SHARES[0], val: float = SHARES[1]) -> DataFrame:
    """An exact cut of a reproducible permutation of all rows."""
    mixed = own_name(df.columns, "mixed")
    ranked = with_ranks(df.withColumn(mixed, order_key(seed, key)), [], [F.col(mixed), F.col(key)])
    return ranked.withColumn("split", cut(F.col(RANK), F.col(SIZE), train, val, False)).drop(mixed, RANK, SIZE)


def assign_groups(sizes: Sequence[tuple[str, int]], train: float = SHARES[0], val: float = SHARES[1]) -> dict[str, int]:
    """Whole files to splits: the largest first, each to the split that is furthest below its share."""
    total = sum(n for _, n in sizes)
    wanted, got, out = [total * train, total * val, total * (1 - train - val)], [0, 0, 0], {}
    for name, n in sorted(sizes, key=lambda x: (x[1], x[0]), reverse=True):
        s = max(range(3), key=lambda i: (wanted[i] - got[i], -i))
        out[name], got[s] = s, got[s] + n
    return out


def group_by_file(df: DataFrame, file: str, train: float = SHARES[0], val: float = SHARES[1]) -> DataFrame:
    """One split for each file. Only the files' sizes reach the driver: one row a file."""
    sizes = [(r[file], r["n"]) for r in df.groupBy(file).agg(F.count("*").alias("n")).collect()]
    chosen = df.sparkSession.createDataFrame(list(assign_groups(sizes, train, val).items()) or [(None, 0)], f"`{file}` {dict(df.dtypes)[file]}, split int")
    return df.join(chosen, file)


def summary(df: DataFrame, y: str = "y", split: str = "split") -> DataFrame:
    """(split, n_rows, n_benign, n_attack, benign_ratio, attack_per_benign); thinned and left-out rows are splits below 0."""
    sums = df.groupBy(col(split).alias("split")).agg(F.count("*").alias("n_rows"), F.count_if(F.col(y) == 0).alias("n_benign"), F.count_if(F.col(y) == 1).alias("n_attack"))
    return sums.withColumns({"benign_ratio": F.round(F.col("n_benign") / F.col("n_rows"), 8), "attack_per_benign": F.round(ratio(F.col("n_attack"), F.col("n_benign")), 2)})


def family_coverage(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """(label, train, val, test, dropped, total, untrained): untrained families are tested or validated without being trained."""
    s = F.col(split)
    sums = df.groupBy(F.col(label).alias("label")).agg(*[F.count_if(s == i).alias(n) for i, n in enumerate(NAMES)], F.count_if(s < 0).alias("dropped"), F.count("*").alias("total"))
    return sums.withColumn("untrained", (F.col("train") == 0) & (F.col("val") + F.col("test") > 0))


def health(summaries: DataFrame, least_benign: int) -> DataFrame:
    """(split, problem) of each real split: ok, empty, no benign rows, or fewer than wanted."""
    every = summaries.sparkSession.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "split int, name string")
    full = every.join(summaries, "split", "left")
    problem = F.when(F.coalesce("n_rows", F.lit(0)) == 0, "empty").when(F.col("n_benign") == 0, "no benign").when(F.col("n_benign") < least_benign, "few benign").otherwise("ok")
    return full.select("name", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_benign", F.lit(0)).alias("n_benign"), problem.alias("problem"))


def upsampled(df: DataFrame, y: str, key: str, seed: int, shares: tuple[float, float] = SHARES) -> DataFrame:
    """The deliberate leak: benign rows are copied up to the attacks' number before the cut.

    split is a row's own draw; also_in has a bit for each other split that any of its copies falls into. The copies are
    never made: their draws are folded into the bits.
    """
    counts = df.agg(F.count_if(F.col(y) == 1).alias("a"), F.count_if(F.col(y) == 0).alias("b"))
    copies = counts.select(F.greatest(F.coalesce(half_even(ratio(F.col("a"), F.col("b"))), F.lit(1)), F.lit(1)).alias("__copies"))
    pick = lambda u: F.when(u < shares[0], TRAIN).when(u < shares[0] + shares[1], VAL).otherwise(TEST)
    base = df.join(F.broadcast(copies)).withColumn("split", pick(uniform(seed, key)))  # one row
    extra = F.when((F.col(y) == 0) & (F.col("__copies") > 1), F.sequence(F.lit(1).cast("long"), F.col("__copies") - 1)).otherwise(F.array().cast("array<bigint>"))
    bits = F.aggregate(extra, F.lit(0), lambda acc, i: acc.bitwiseOR(F.pow(F.lit(2), pick(uniform(seed, key, i))).cast("int")))
    own = F.pow(F.lit(2), F.col("split")).cast("int")
    return base.withColumn("also_in", bits.bitwiseAND(F.bitwise_not(own))).drop("__copies")


def member(code: int, split: str = "split", also_in: str = "also_in") -> Column:
    """Whether a row belongs to a split, by its own code or by its bits."""
    return (F.col(split) == code) | (F.shiftright(also_in, code).bitwiseAND(F.lit(1)) == 1)


def bitmask_leakage(df: DataFrame) -> DataFrame:
    """Rows in more than one split at once, by pair and at all."""
    a, b, c = (member(i) for i in range(3))
    return df.agg(F.count_if(a & b).alias("train_val"), F.count_if(a & c).alias("train_test"), F.count_if(b & c).alias("val_test"), F.count_if((a & b) | (a & c) | (b & c)).alias("any_two"))
