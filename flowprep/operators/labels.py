"""Labels: decisions by a small table, scope, counts, unknown ones."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col, stripped

#: A row that no decision covers, or one that is dropped from scope.
OUT_OF_SCOPE = 255


def decision_table(spark: SparkSession, benign: Iterable[str], attack: Iterable[str], dropped: Iterable[str] = ()) -> DataFrame:
    """(raw_label, decision): 0, 1 or, out of scope, null. Its size is that of the configuration."""
    out = set(dropped)
    rows = [(x, None if x in out else 0) for x in benign] + [(x, None if x in out else 1) for x in attack]
    rows += [(x, None) for x in sorted(out - {r for r, _ in rows})]
    return spark.createDataFrame(rows, "raw_label string, decision int")


def decide(df: DataFrame, label: Column | str, decisions: DataFrame) -> DataFrame:
    """df with raw_label (stripped) and y: 0, 1, or OUT_OF_SCOPE where the table says so or doesn't know the label."""
    return df.withColumn("raw_label", stripped(label)).join(decisions, "raw_label", "left").withColumn("y", F.coalesce("decision", F.lit(OUT_OF_SCOPE))).drop("decision")


def in_scope(df: DataFrame) -> DataFrame:
    return df.where(F.col("y") != OUT_OF_SCOPE)


def is_benign(label: Column | str) -> Column:
    return F.upper(stripped(label)).isin("BENIGN", "NORMAL")


def binary_counts(df: DataFrame) -> DataFrame:
    """n_benign, n_attack, n_dropped of decided rows."""
    return df.agg(*[F.count_if(F.col("y") == v).alias(n) for n, v in (("n_benign", 0), ("n_attack", 1), ("n_dropped", OUT_OF_SCOPE))])


def unknown_labels(df: DataFrame, label: Column | str, decisions: DataFrame) -> DataFrame:
    seen = df.select(stripped(label).alias("raw_label")).where(F.col("raw_label").isNotNull()).distinct()
    return seen.join(decisions, "raw_label", "left_anti")


def label_counts(df: DataFrame, file: Column | str, label: Column | str) -> DataFrame:
    """(file, raw_label, n): by file and, with a null file, over all; one scan."""
    base = df.where(col(label).isNotNull()).select(col(file).alias("file"), stripped(label).alias("raw_label"))
    return base.groupingSets([["file", "raw_label"], ["raw_label"]], "file", "raw_label").agg(F.count("*").alias("n"))


def label_crosstab(df: DataFrame, file: Column | str, label: Column | str, values: Mapping[str, str]) -> DataFrame:
    """One column of counts for each label (label -> column name), by file."""
    text = stripped(label)
    return df.groupBy(col(file).alias("file")).agg(*[F.count_if(text == v).alias(n) for v, n in values.items()], F.count("*").alias("n_rows"))
