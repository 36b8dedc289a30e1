"""Run histories: boundaries, bests, gaps, stalls, trials, costs, acceptance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import finite, ratio
from .quantiles import quantiles
from .ranks import with_previous


def session_boundaries(history: DataFrame, order: str = "epoch", session: str = "session_id") -> DataFrame:
    """Records whose session isn't that of the record before."""
    w = Window.orderBy(order)  # a record an epoch
    return history.withColumn("previous_session", F.lag(session).over(w)).where(F.col("previous_session") != F.col(session)).select(order, session, "previous_session")


def running_best(df: DataFrame, value: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """df with best_so_far and is_new_best (strictly above all before)."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumns({"best_so_far": F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), "is_new_best": before.isNull() | (F.col(value) > before)})


def best_record(df: DataFrame, value: str, order: str) -> DataFrame:
    """The record with the largest value, the first of several."""
    return df.agg(F.max_by(F.struct(F.col(order), F.col(value)), F.struct(F.col(value), -F.col(order))).alias("r")).select("r.*")


def history_problems(history: DataFrame, last: int, position: str = "position", epoch: str = "epoch") -> DataFrame:
    """(problem, epoch): duplicate, missing among 1..last, out of range, out of order (of records by a whole-number position)."""
    spark = history.sparkSession
    seen = history.groupBy(epoch).agg(F.count("*").alias("n"))
    expected = spark.range(1, last + 1).select(F.col("id").alias(epoch))
    back = with_previous(history, [], position, epoch, "__p").where(F.col(epoch) < F.col("__p"))
    parts = [seen.where("n > 1").select(F.lit("duplicate").alias("problem"), epoch), expected.join(seen, epoch, "left_anti").select(F.lit("missing").alias("problem"), epoch), seen.where((F.col(epoch) < 1) | (F.col(epoch) > last)).select(F.lit("out_of_range").alias("problem"), epoch), back.select(F.lit("out_of_order").alias("problem"), epoch)]
    return reduce(DataFrame.unionByName, parts)


def stall(log: DataFrame, phases: Sequence[str], order: str = "recorded") -> DataFrame:
    """(n, stalled): whether neither of the last two training records advanced (an epoch beyond the one before)."""
    kept = log.where(F.col("phase").isin(*phases)).orderBy(F.desc(order)).limit(3)  # two records and the one before them
    w = Window.orderBy(order)
    moved = kept.withColumn("__p", F.lag("end_epoch").over(w)).withColumn("advanced", F.col("__p").isNull() | (F.col("end_epoch") > F.col("__p")))
    last = moved.orderBy(F.desc(order)).limit(2)
    return last.agg(F.count("*").alias("n"), ((F.count("*") == 2) & ~F.coalesce(F.bool_or("advanced"), F.lit(False))).alias("stalled"))


def trial_table(spark: SparkSession, trials: Sequence[dict]) -> DataFrame:
    """Ragged trial records as one table with the sorted union of their parameters."""
    frames = [spark.createDataFrame([t]) for t in trials]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*sorted(out.columns))


def trial_summary(trials: DataFrame, state: str = "state", value: str = "value", number: str = "number") -> DataFrame:
    """(n_complete, best_number, best_value), the first of equal bests."""
    done = F.col(state) == "complete"
    best = F.max_by(F.struct(F.col(number), F.col(value)), F.when(done, F.struct(F.col(value), -F.col(number))))
    return trials.agg(F.count_if(done).alias("n_complete"), best.alias("b")).select("n_complete", F.col(f"b.{number}").alias("best_number"), F.col(f"b.{value}").alias("best_value"))


def parameter_importance(trials: DataFrame, parameters: Sequence[str], value: str = "value", bins: int = 8) -> DataFrame:
    """(parameter, importance): each parameter's main effect on the value, as a share of the value's variance.

    A functional analysis of variance on cells: text and booleans by their values, numbers by `bins` ranges between exact quantiles
    (so logarithmic ones need no scale of their own). The variance between k cells is lowered by what k - 1 of them show by
    chance, (k - 1) times the mean variance within cells, so a parameter of pure noise gets about 0, however many values it has.
    Null is a cell of its own; trials without a value don't count; without variance or with a cell for each trial it is 0.
    """
    kinds = {f.name: f.dataType for f in trials.schema}
    done = trials.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    numbers = {p: finite(p) for p in parameters if isinstance(kinds[p], T.NumericType)}
    cuts = quantiles(done, numbers, [i / bins for i in range(1, bins)]) if numbers else {}
    cells = []
    for p in parameters:
        if p in numbers:
            edges = sorted({e for e in cuts[p] if e is not None})
            cell = F.when(numbers[p].isNotNull(), sum((F.when(numbers[p] > e, 1).otherwise(0) for e in edges), F.lit(0)).cast("string"))
        else:
            cell = F.col(f"`{p}`").cast("string")
        cells.append(F.struct(F.lit(p).alias("parameter"), cell.alias("cell")))
    long = done.select(F.inline(F.array(*cells)), F.col(value).cast("double").alias("v"))  # one scan for all parameters
    groups = long.groupBy("parameter", "cell").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    n, k, mean = F.sum("n"), F.count("*"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
    between, within = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * mean * mean, F.sum(F.col("n") * F.col("s"))
    sums = groups.groupBy("parameter").agg(n.alias("n"), k.alias("k"), F.greatest(between, F.lit(0.0)).alias("b"), within.alias("w"))
    share = (F.col("b") - (F.col("k") - 1) * ratio(F.col("w"), F.col("n") - F.col("k"))) / F.nullif(F.col("b") + F.col("w"), F.lit(0.0))
    every = trials.sparkSession.createDataFrame([(p,) for p in parameters], "parameter string")
    return every.join(sums, "parameter", "left").select("parameter", F.round(F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.0)), 9).alias("importance"))


def extrapolated(measured: DataFrame, rows: int, benign: int, session_s: float) -> DataFrame:
    """(stage, seconds, sessions): measured (stage, seconds, driver, n_rows, n_benign) carried on in proportion to rows or benign rows."""
    factor = F.when(F.col("driver") == "rows", ratio(F.lit(float(rows)), F.col("n_rows"))).when(F.col("driver") == "benign", ratio(F.lit(float(benign)), F.col("n_benign"))).otherwise(F.lit(1.0))
    return measured.select("stage", F.round(F.col("seconds") * factor, 6).alias("seconds"), F.ceil(F.col("seconds") * factor / F.lit(session_s)).cast("long").alias("sessions"))


def memory_needs(rows: int, train_rows: int, features: int) -> dict[str, int]:
    """Bytes that an index of all rows and a float matrix of the training rows would take; the larger is the peak."""
    index, matrix = rows * (19 + 17), train_rows * features * 4
    return {"index": index, "matrix": matrix, "peak": max(index, matrix)}


def accepted(checks: DataFrame) -> DataFrame:
    """(n_pass, n_skip, n_fail, verdict) of (check, status)."""
    n = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("PASS", "SKIP", "FAIL")]
    return checks.agg(*n).withColumn("verdict", F.when(F.col("n_fail") > 0, "FAIL").otherwise("PASS"))
