"""Profiles of columns and files, each in one pass."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import ship
from ..functions.columns import col, finite, is_infinite
from .labels import is_benign
from .ranks import with_previous


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each column: n_rows, n_null, n_nan, n_inf, n_missing, missing_ratio, inf_ratio, finite min and max (floats only), dtype."""
    kinds = {f.name: f.dataType for f in df.schema}
    aggs, rows = [F.count("*").alias("n")], []
    for i, c in enumerate(columns):
        real = isinstance(kinds[c], (T.DoubleType, T.FloatType))
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("double")
        aggs += [F.count_if(F.col(c).isNull()).alias(f"null{i}"), (F.count_if(F.isnan(c)) if real else zero).alias(f"nan{i}"), (F.count_if(is_infinite(c)) if real else zero).alias(f"inf{i}"), (F.min(finite(c)) if real else none).alias(f"min{i}"), (F.max(finite(c)) if real else none).alias(f"max{i}")]
        missing = F.col(f"null{i}") + F.col(f"nan{i}") + F.col(f"inf{i}")
        n = F.greatest(F.col("n"), F.lit(1))
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(kinds[c].simpleString()).alias("dtype"), F.col("n").alias("n_rows"), F.col(f"null{i}").alias("n_null"), F.col(f"nan{i}").alias("n_nan"), F.col(f"inf{i}").alias("n_inf"), missing.alias("n_missing"), F.round(missing / n, 6).alias("missing_ratio"), F.round(F.col(f"inf{i}") / n, 6).alias("inf_ratio"), F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max")))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def worst_columns(profile: DataFrame, k: int = 5) -> DataFrame:
    return profile.orderBy(F.desc("missing_ratio"), "column").limit(k)


def shown_columns(profile: DataFrame) -> DataFrame:
    """Columns worth a look: any missing values, or text."""
    return profile.where((F.col("missing_ratio") > 0) | (F.col("dtype") == "string"))


def distinct_capped(df: DataFrame, columns: Sequence[str], cap: int) -> DataFrame:
    """(column, n_distinct, shown): exact counts up to cap, else "capped_at_<cap>".

    One scan serves all columns. A task hands on at most cap + 1 values of a column, since more settle its answer: what is
    shuffled is bounded by the cap, not by the distinct values.
    """
    names = list(columns)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[set[str]] = [set() for _ in names]
        for batch in batches:
            for have, values in zip(found, batch.columns, strict=True):
                if len(have) <= cap:
                    have.update(v for v in pc.unique(values).to_pylist() if v is not None)
        for i, have in enumerate(found):
            few = list(itertools.islice(have, cap + 1))
            for at in range(0, len(few), 1 << 14):
                part = few[at : at + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(part), pa.int32()), pa.array(part, pa.string())], names=["i", "v"])

    ship(df.sparkSession)
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(names)])
    counts = texts.mapInArrow(seen, "i int, v string").distinct().groupBy("i").agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame(list(enumerate(names)), "i int, column string").join(counts, "i", "left").select("column", F.coalesce("n", F.lit(0)).alias("n"))
    shown = F.when(F.col("n") > cap, F.lit(f"capped_at_{cap}")).otherwise(F.col("n").cast("string"))
    return every.select("column", F.least("n", F.lit(cap)).alias("n_distinct"), shown.alias("shown"))


def time_range(df: DataFrame, text: Column, time: Column) -> DataFrame:
    """The least and largest time as text (in the order of text) and as time."""
    return df.agg(F.min(text).alias("first_text"), F.max(text).alias("last_text"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def size_estimate(df: DataFrame, numeric: int, bytes_each: int = 4) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), (F.count("*") * numeric * bytes_each).alias("matrix_bytes"))


def identifier_columns(df: DataFrame, columns: Sequence[str], position: Column | str, first: int = 20_000, least: int = 1_000) -> DataFrame:
    """(column, n, n_distinct, step, verdict): among the `first` rows, unique text or evenly stepped whole numbers are identifiers
    ("error"), unique other numbers "note", the rest "ok". Fewer than `least` rows are not judged.

    Whether numbers are evenly stepped doesn't depend on their order: n different numbers are a run if their range is n - 1 steps
    and all lie a whole number of steps above the least. step is that of a run, else null.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    whole = {c for c in columns if isinstance(kinds[c], T.IntegralType)}
    head = df.where(col(position) < first).select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count(f"c{i}").alias(f"n{i}"), F.count_distinct(f"c{i}").alias(f"d{i}")]
        if c in whole:
            low, high = F.min(f"c{i}").cast("decimal(38,0)"), F.max(f"c{i}").cast("decimal(38,0)")
            aggs += [low.alias(f"low{i}"), (high - low).alias(f"range{i}")]
    sums = head.agg(*aggs)  # one row
    for i, c in enumerate(columns):
        if c in whole:
            gaps = F.nullif(F.col(f"d{i}") - 1, F.lit(0)).cast("decimal(38,0)")
            fits = (F.col(f"n{i}") == F.col(f"d{i}")) & (F.col(f"range{i}") % gaps == 0)
            sums = sums.withColumn(f"step{i}", F.when(fits, (F.col(f"range{i}") / gaps).cast("long")))
    both = head.join(F.broadcast(sums))
    off = [F.count_if((F.col(f"c{i}") - F.col(f"low{i}")) % F.col(f"step{i}") != 0).alias(f"off{i}") for i, c in enumerate(columns) if c in whole]
    held = [F.first(n).alias(n) for n in sums.columns if not n.startswith(("low", "range"))]
    one = both.agg(*held, *off)
    parts = []
    for i, c in enumerate(columns):
        step = F.when(F.col(f"off{i}") == 0, F.col(f"step{i}")) if c in whole else F.lit(None).cast("long")
        unique = (F.col(f"n{i}") == F.col(f"d{i}")) & (F.col(f"n{i}") >= least)
        run = step.isNotNull() if c in whole else F.lit(isinstance(kinds[c], T.StringType))
        said = F.when(unique & run, "error").when(unique & ~run & F.lit(c not in whole), "note").otherwise("ok")
        parts.append(F.struct(F.lit(c).alias("column"), F.coalesce(f"n{i}", F.lit(0)).alias("n"), F.coalesce(f"d{i}", F.lit(0)).alias("n_distinct"), step.alias("step"), F.coalesce(said, F.lit("ok")).alias("verdict")))
    return one.select(F.inline(F.array(*parts)))


def benign_map(df: DataFrame, file: Column | str, day: Column | str, label: Column | str) -> DataFrame:
    """(level, name, n_benign, n_attack, no_benign) by file and by day, in one pass."""
    base = df.select(col(file).alias("file"), col(day).alias("day"), F.coalesce(is_benign(label), F.lit(False)).alias("benign"))
    sums = base.groupingSets([["file"], ["day"]], "file", "day").agg(F.count_if("benign").alias("n_benign"), F.count_if(~F.col("benign")).alias("n_attack"), F.grouping("file").alias("g"))
    return sums.select(F.when(F.col("g") == 0, "file").otherwise("day").alias("level"), F.when(F.col("g") == 0, F.col("file")).otherwise(F.col("day")).alias("name"), "n_benign", "n_attack", (F.col("n_benign") == 0).alias("no_benign"))


def minute_slices(df: DataFrame, file: Column | str, time: Column | str, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """(file, minute, n, slice): each minute goes by the share of the file's rows before it."""
    minutes = df.groupBy(col(file).alias("file"), F.date_trunc("minute", col(time)).cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce(F.sum("n").over(before), F.lit(0)) / F.sum("n").over(Window.partitionBy("file"))
    return minutes.withColumn("slice", F.when(share < train, "train").when(share < train + val, "val").otherwise("test"))


def slice_totals(slices: DataFrame) -> DataFrame:
    return slices.groupBy("slice").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_minutes"), F.count_distinct("file").alias("n_files"))


def monotonic(df: DataFrame, file: Column | str, position: Column | str, time: Column | str) -> DataFrame:
    """(file, n, monotonic): whether time never goes back in the order of whole-number positions."""
    base = df.select(col(file).alias("file"), col(position).alias("__at"), col(time).alias("__t"))
    flagged = with_previous(base, ["file"], "__at", "__t", "__p").withColumn("__ok", F.coalesce(F.col("__t") >= F.col("__p"), F.lit(True)))
    return flagged.groupBy("file").agg(F.count("*").alias("n"), F.bool_and("__ok").alias("monotonic"))


def file_offsets(df: DataFrame, file: Column | str) -> DataFrame:
    """(file, n, begin, end): where each file's rows stand in the order of files. One row for each file meets in the window."""
    counts = df.groupBy(col(file).alias("file")).agg(F.count("*").alias("n"))
    end = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("end", end).withColumn("begin", F.col("end") - F.col("n"))


def audit_failures(n_rows: int, n_benign: int, n_attack: int, unknown: Sequence[str], clashes: Sequence[str], label_found: bool = True) -> list[str]:
    """What forbids going on, in words."""
    checks = [(not label_found, "there is no label column"), (n_rows == 0, "there are no rows"), (n_benign == 0, "no row is benign"), (n_attack == 0, "no row is an attack"), (bool(unknown), f"labels without a decision: {sorted(unknown)}"), (bool(clashes), f"columns that share a name: {sorted(clashes)}")]
    return [said for bad, said in checks if bad]
