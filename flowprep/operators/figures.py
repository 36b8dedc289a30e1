"""The data of figures: what a plot of a run shows, a row for each mark. write_figures() puts them beside the plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .monitor import running_best
from .ranks import with_previous
from .splits import NAMES


def training_curve(history: DataFrame, value: str, epoch: str = "epoch", session: str = "session_id") -> DataFrame:
    """(epoch, value, best_so_far, resumed): resumed marks a record of another session than the one before; a missing session is one
    of its own."""
    held = history.select(F.col(epoch).alias("epoch"), F.col(value).alias("value"), F.struct(F.col(session).alias("s")).alias("own"))
    placed = with_previous(held, [], "epoch", "own", "before")
    resumed = F.col("before").isNotNull() & ~F.col("before.s").eqNullSafe(F.col("own.s"))
    return running_best(placed, "value", "epoch").select("epoch", "value", "best_so_far", resumed.alias("resumed"))


def class_distribution(df: DataFrame, y: str = "y", split: str = "split") -> DataFrame:
    """(split, benign, attack) of each real split, empty ones too."""
    counts = df.groupBy(F.col(split).alias("code")).agg(F.count_if(F.col(y) == 0).alias("benign"), F.count_if(F.col(y) == 1).alias("attack"))
    every = df.sparkSession.createDataFrame(list(enumerate(NAMES)), "code int, split string")
    return every.join(counts, "code", "left").select("split", F.coalesce("benign", F.lit(0)).alias("benign"), F.coalesce("attack", F.lit(0)).alias("attack"))


def comparison(deltas: DataFrame) -> DataFrame:
    """(metric, ours, paper_headline, paper_body, low, high) of the metrics that have a value and a published one; low and high are the
    ends of a metric's range."""
    shown = deltas.where(F.col("value").isNotNull() & (F.col("headline").isNotNull() | F.col("body").isNotNull()))
    three = ("value", "headline", "body")
    ends = [f(*[F.coalesce(c, "value") for c in three]).alias(n) for f, n in ((F.least, "low"), (F.greatest, "high"))]
    return shown.select("metric", F.col("value").alias("ours"), F.col("headline").alias("paper_headline"), F.col("body").alias("paper_body"), *ends)
