"""Scores of binary classifiers, exact and tie-aware, as sums over distinct scores. Class 1 is the attack."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, ratio
from .quantiles import quantiles

CLIP = 1e-7


def confusion(df: DataFrame, y: Column | str, score: Column | str, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    truth, said = col(y) == 1, col(score) >= threshold
    return df.groupBy(*by).agg(*[F.count_if((truth if t else ~truth) & (said if s else ~said)).alias(n) for n, t, s in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])


def zero_for_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def metrics(counts: DataFrame) -> DataFrame:
    """All rates of tn, fp, fn, tp. Precision, recall and F1 are 0 where they are undefined; specificity, fpr and fnr null."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n, pos, neg = tn + fp + fn + tp, tp + fn, tn + fp
    f1, f0 = zero_for_null(ratio(2 * tp, 2 * tp + fp + fn)), zero_for_null(ratio(2 * tn, 2 * tn + fn + fp))
    recall, spec = ratio(tp, pos), ratio(tn, neg)
    root = F.sqrt((tp + fp) * pos * neg * (tn + fn))
    values = {
        "accuracy": ratio(tp + tn, n), "balanced_accuracy": F.when(pos == 0, spec).when(neg == 0, recall).otherwise((recall + spec) / 2), "precision": zero_for_null(ratio(tp, tp + fp)), "recall": zero_for_null(recall),
        "f1": f1, "macro_f1": (f1 + f0) / 2, "weighted_f1": ratio(pos * f1 + neg * f0, n), "mcc": zero_for_null(ratio(tp * tn - fp * fn, root)),
        "specificity": spec, "fpr": ratio(fp, neg), "fnr": ratio(fn, pos), "always_attack_accuracy": ratio(pos, n), "attack_per_benign": ratio(pos, neg),
    }
    return counts.select("*", *[F.round(v, 9).alias(k) for k, v in values.items()])


def metric_rows(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """(metric, value) of each numeric column."""
    return wide.unpivot([], list(names), "metric", "value")


def per_class(counts: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support)."""
    cases = [("benign", "tn", "fn", "fp"), ("attack", "tp", "fp", "fn")]
    rows = [F.struct(F.lit(n).alias("class"), *[F.round(zero_for_null(v), 9).alias(k) for k, v in (("precision", ratio(F.col(t), F.col(t) + F.col(f))), ("recall", ratio(F.col(t), F.col(t) + F.col(m))), ("f1", ratio(2 * F.col(t), 2 * F.col(t) + F.col(f) + F.col(m))))], (F.col(t) + F.col(m)).alias("support")) for n, t, f, m in cases]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def normalised_confusion(counts: DataFrame) -> DataFrame:
    """(truth, said_benign, said_attack): rows sum to 1; an empty row is 0."""
    rows = [F.struct(F.lit(n).alias("truth"), F.round(F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1)), 9).alias("said_benign"), F.round(F.col(b) / F.greatest(F.col(a) + F.col(b), F.lit(1)), 9).alias("said_attack")) for n, a, b in (("benign", "tn", "fp"), ("attack", "fn", "tp"))]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


#: Scores from k / BLOCKS up to the next such bound share a block.
BLOCKS = 1024


def score_steps(df: DataFrame, y: Column | str, score: Column | str) -> DataFrame:
    """(score, pos, neg, tp, fp, all_pos, all_neg, next_pos, next_neg): running counts from the highest score down, one row
    for each distinct score, with the counts of the next lower one (null for the lowest).

    Scores run within their block; a row a block is summed up over all. So a window holds the distinct scores of a block,
    or the blocks (1025 of them for probabilities).
    """
    s = col(score)
    steps = df.groupBy(s.alias("score")).agg(F.count_if(col(y) == 1).alias("pos"), F.count_if(col(y) == 0).alias("neg"))
    steps = steps.withColumn("block", F.when(F.isnan("score"), F.lit(1 << 62)).otherwise(F.floor(F.col("score") * BLOCKS)))
    top = F.max_by(F.struct("pos", "neg"), "score")
    blocks = steps.groupBy("block").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"), top.alias("top"))
    order, every = Window.orderBy(F.desc("block")), Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block", F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("bn"),
        F.sum("bp").over(every).alias("all_pos"), F.sum("bn").over(every).alias("all_neg"), F.lead("top").over(order).alias("below"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("score"))
    down = inside.rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"rp": F.sum("pos").over(down), "rn": F.sum("neg").over(down), "lower": F.lead(F.struct("pos", "neg")).over(inside)})
    lower = F.coalesce("lower", "below")
    return steps.join(blocks, steps["block"].eqNullSafe(blocks["block"])).select("score", "pos", "neg", (F.col("rp") + F.col("bp")).alias("tp"), (F.col("rn") + F.col("bn")).alias("fp"), "all_pos", "all_neg", lower["pos"].alias("next_pos"), lower["neg"].alias("next_neg"))


def roc_curve(steps: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr): from (0, 0) at infinity, without the points inside straight runs."""
    d = lambda c: F.col(c)
    bent = (d("next_pos") != d("pos")) | (d("next_neg") != d("neg")) | d("next_pos").isNull()
    points = steps.where(bent).select(d("score").alias("threshold"), F.round(ratio(d("fp"), d("all_neg")), 9).alias("fpr"), F.round(ratio(d("tp"), d("all_pos")), 9).alias("tpr"))
    start = steps.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(points)


def roc_auc(steps: DataFrame) -> DataFrame:
    """The area under the curve, ties counting half; null with one class."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return steps.agg(F.round(ratio(area, F.max("all_pos") * F.max("all_neg")), 9).alias("roc_auc"))


def pr_curve(steps: DataFrame) -> DataFrame:
    """(threshold, precision, recall) by distinct score, and (null, 1, 0) at the end."""
    points = steps.select(F.col("score").alias("threshold"), F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 9).alias("precision"), F.round(ratio(F.col("tp"), F.col("all_pos")), 9).alias("recall"))
    end = steps.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def average_precision(steps: DataFrame) -> DataFrame:
    gain = F.col("pos") * ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return steps.agg(F.round(ratio(F.sum(gain), F.max("all_pos")), 9).alias("average_precision"))


def log_loss(df: DataFrame, y: Column | str, score: Column | str) -> DataFrame:
    p = F.least(F.greatest(col(score), F.lit(CLIP)), F.lit(1 - CLIP))
    return df.agg(F.round(F.avg(-F.ln(F.when(col(y) == 1, p).otherwise(1 - p))), 9).alias("log_loss"))


def logit_loss(df: DataFrame, y: Column | str, logit: Column | str) -> DataFrame:
    """Mean and sum of the cross entropy, from logits, without overflow."""
    z = col(logit)
    loss = F.greatest(z, F.lit(0.0)) - z * col(y) + F.log1p(F.exp(-F.abs(z)))
    return df.agg(F.round(F.avg(loss), 9).alias("mean_loss"), F.round(F.sum(loss), 6).alias("sum_loss"))


def metric_deltas(rows: DataFrame, published: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """(metric, value, headline, body, d_headline, d_body) of each published metric; differences of nulls are null."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(k, *v) for k, v in published.items()], "metric string, headline double, body double")
    both = known.join(rows, "metric", "left")
    return both.select("metric", F.round("value", 6).alias("value"), "headline", "body", F.round(F.col("value") - F.col("headline"), 6).alias("d_headline"), F.round(F.col("value") - F.col("body"), 6).alias("d_body"))


def latency(df: DataFrame, ms: Column | str, batch: int) -> DataFrame:
    """p50, p95 (linear) and rows a second at the median."""
    p50, p95 = quantiles(df, {"ms": col(ms).cast("double")}, [0.5, 0.95])["ms"]
    rate = batch / (p50 / 1000) if p50 else None
    out = df.sparkSession.createDataFrame([(p50, p95, rate)], "p50_ms double, p95_ms double, rows_per_s double")
    return out.select(F.round("p50_ms", 6).alias("p50_ms"), F.round("p95_ms", 6).alias("p95_ms"), F.round("rows_per_s", 3).alias("rows_per_s"))
