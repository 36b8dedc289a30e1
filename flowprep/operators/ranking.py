"""Rankings of features: shares, selections, folded waterfalls, comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, ratio
from .quantiles import quantiles

# Names of selections that set their own size.
NAMED_SIZES = {"top40": 40, "top20": 20}


def long_form(df: DataFrame, array: Column | str, names: Sequence[str] | None = None) -> DataFrame:
    """(feature, value) of each element of a vector column."""
    pos = df.select(F.posexplode(col(array)).alias("i", "value"))
    name = F.concat(F.lit("f"), F.lpad(F.col("i").cast("string"), 2, "0")) if names is None else F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)
    return pos.select(name.alias("feature"), F.col("value").cast("double").alias("value"))


def importance(values: DataFrame) -> DataFrame:
    """(feature, mean_abs, mean) from (feature, value)."""
    return values.groupBy("feature").agg(F.round(F.avg(F.abs("value")), 9).alias("mean_abs"), F.round(F.avg("value"), 9).alias("mean"))


def ranked(scores: DataFrame, by: str = "mean_abs") -> DataFrame:
    """scores with rank, share and cumulative, largest first, ties by name. A row for each feature meets in the window."""
    order = Window.orderBy(F.desc(by), "feature")
    total = F.sum(by).over(Window.partitionBy())
    upto = F.sum(by).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return scores.withColumns({"rank": F.row_number().over(order).cast("long"), "share": F.round(ratio(F.col(by), total), 9), "cumulative": F.round(ratio(upto, total), 9)})


def selected(ranking: DataFrame, mode: str, k: int | None = None, threshold: float | None = None) -> DataFrame:
    """The features of a selection: all, cumulative (share up to a threshold, one at least), a named size, or the first k."""
    if mode == "all":
        return ranking
    if mode == "cumulative":
        return ranking.where((F.col("cumulative") <= threshold) | (F.col("rank") == 1))
    n = NAMED_SIZES.get(mode, k)
    if n is None or ranking.count() < n:  # a row a feature
        raise ValueError(f"{mode}: there aren't {n} features")
    return ranking.orderBy("rank").limit(n)


def representative(df: DataFrame, value: Column | str, key: str) -> DataFrame:
    """The row whose value is nearest the median, the first key on ties."""
    base = df.select(F.col(key).alias("key"), col(value).cast("double").alias("value"))
    median = F.lit(quantiles(base, {"value": F.col("value")}, [0.5])["value"][0]).cast("double")
    near = F.struct(F.abs(F.col("value") - median).alias("d"), F.col("key"))
    return base.where("value is not null").agg(F.min_by(F.struct("key", "value", median.alias("median")), near).alias("r")).select("r.*")


def waterfall(values: DataFrame, shown: int) -> DataFrame:
    """(place, feature, value): the largest shown - 1 by size, then the sum of all others in one row, if there are any."""
    order = Window.orderBy(F.desc(F.abs("value")), "feature")
    placed = values.withColumns({"place": F.row_number().over(order).cast("long"), "__n": F.count("*").over(Window.partitionBy())})
    rest = F.col("place") >= shown
    name = F.when(rest, F.concat((F.col("__n") - (shown - 1)).cast("string"), F.lit(" other features"))).otherwise(F.col("feature"))
    return placed.groupBy(F.least("place", F.lit(shown)).alias("place"), name.alias("feature")).agg(F.round(F.sum("value"), 9).alias("value"))


def compared_with_list(published: DataFrame, ranking: DataFrame, shown: DataFrame) -> DataFrame:
    """Each published feature (feature, published_rank) with our rank, and whether our waterfall shows it."""
    ours = ranking.select("feature", F.col("rank").alias("our_rank"))
    seen = shown.select("feature", F.lit(True).alias("__seen"))
    return published.join(ours, "feature", "left").join(seen, "feature", "left").select("feature", "published_rank", "our_rank", F.col("our_rank").isNotNull().alias("ranked"), F.coalesce("__seen", F.lit(False)).alias("in_waterfall"))


def compared_rankings(base: DataFrame, others: Mapping[str, DataFrame]) -> DataFrame:
    """Ranks side by side (null where one lacks a feature), and the spread of those present if there are two."""
    out = base.select("feature", F.col("rank").alias("rank_base"))
    for name, r in others.items():
        out = out.join(r.select("feature", F.col("rank").alias(f"rank_{name}")), "feature", "left")
    ranks = [F.col(c) for c in out.columns if c.startswith("rank_")]
    present = sum((r.isNotNull().cast("int") for r in ranks), F.lit(0))
    return out.withColumn("spread", F.when(present >= 2, F.greatest(*ranks) - F.least(*ranks)))
