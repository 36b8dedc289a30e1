"""Duplicates and leakage between splits.

Rows are told apart by 128-bit digests of their columns, so that wide rows and long texts don't cross a shuffle. Among 10^12
rows, two different ones share a digest with a probability below 10^-14.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import materialised
from ..functions.columns import own_name


def digest(columns: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of a row's columns. Nulls are equal to each other and to nothing else, as are NaNs; 0.0 equals -0.0."""
    parts = [p for c in columns for p in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(seed), *parts).alias(f"__h{seed}") for seed in (1, 2)]


def first_occurrences(df: DataFrame, columns: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """The columns to keep (all, if none are named) with is_first: whether a row is the first of its twins. Nulls are equal, as are NaNs.

    Rows that tie in the order stand as they are read: rows are numbered in a table written once, so exactly one of each group
    is first. Digests stand for the columns, so only what is kept, the order and the digests are written. The first of each
    group is a partial minimum, so a group of any size is one row for each task before the shuffle.
    """
    kept = list(df.columns if keep is None else keep)
    needed = list(dict.fromkeys([*kept, *order]))
    row, first = own_name(needed, "row_number"), own_name(needed, "first_row")
    held = materialised(df.select(*[F.col(f"`{c}`") for c in needed], *digest(columns), F.monotonically_increasing_id().alias(row)), "twins")
    place = F.struct(*[F.col(f"`{o}`") for o in order], F.col(row).alias("row_of_first"))
    firsts = held.groupBy("__h1", "__h2").agg(F.min(place)["row_of_first"].alias(first))
    return held.join(firsts, ["__h1", "__h2"]).select(*[F.col(f"`{c}`") for c in kept], (F.col(row) == F.col(first)).alias("is_first"))


def duplicate_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    groups = df.select(*digest(columns)).groupBy("__h1", "__h2").agg(F.count("*").alias("c"))
    return groups.agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_distinct"), (F.sum("c") - F.count("*")).alias("n_duplicates"), F.max("c").alias("largest_group"))


def leakage(df: DataFrame, columns: Sequence[str], split: Column | str = "split") -> DataFrame:
    """Rows whose twins stand in another split; splits below 0 don't count."""
    kept = df.withColumn("__s", F.col(split) if isinstance(split, str) else split).where("__s >= 0")
    groups = kept.select("__s", *digest(columns)).groupBy("__h1", "__h2").agg(F.count("*").alias("c"), F.min("__s").alias("lo"), F.max("__s").alias("hi"))
    crossing = F.col("lo") != F.col("hi")
    n = F.sum("c")
    return groups.agg(n.alias("n_rows"), F.coalesce(F.sum(F.when(crossing, F.col("c"))), F.lit(0)).alias("cross_rows"), F.count_if(crossing).alias("cross_groups"), F.round(n.cast("double") * n / F.lit(2.0**65), 12).alias("expected_hash_collisions"))
