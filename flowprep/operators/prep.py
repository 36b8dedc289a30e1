"""Fitting on the training split, transforming all splits: one aggregation to fit, one row of parameters to apply."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions.columns import finite
from .quantiles import first_pass, sizes_of
from .quantiles import quantiles as quantiles_of
from .ranks import RANK, SIZE, with_ranks


def fit(df: DataFrame, columns: Sequence[str], most_missing: float = 0.5) -> DataFrame:
    """(column, missing_ratio, median, mean, std, variance, verdict) over df; the moments are of the values after imputation.

    One scan sums up all columns, a second finds their medians; the moments after imputation follow from the sums of
    the present values and the median. A row a column reaches the driver.
    """
    values = {c: finite(c) for c in columns}
    aggs = [F.count("*").alias("rows")]
    for i, x in enumerate(values.values()):
        aggs += [F.avg(x).alias(f"a{i}"), F.var_pop(x).alias(f"v{i}")]
    sums = df.agg(*aggs, *first_pass(values)).first()
    sizes = sizes_of(values, sums)
    medians = quantiles_of(df, values, [0.5], sums)
    rows = []
    for i, c in enumerate(columns):
        median = medians[c][0] or 0.0
        k, low, high = sizes[c]
        p = k / sums["rows"] if sums["rows"] else 0.0
        present, spread = (median, 0.0) if not k else (sums[f"a{i}"], sums[f"v{i}"])
        flat = not k or low == high and (p == 1 or low == median)
        variance = 0.0 if flat else p * spread + p * (1 - p) * (present - median) ** 2
        verdict = "high_missing" if 1 - p > most_missing else "zero_variance" if variance == 0 else "kept"
        rows.append((c, 1 - p, median, p * present + (1 - p) * median, variance**0.5 if variance > 0 else 1.0, variance, verdict))
    return df.sparkSession.createDataFrame(rows, "column string, missing_ratio double, median double, mean double, std double, variance double, verdict string")


def standardised(df: DataFrame, columns: Sequence[str], parameters: Sequence) -> DataFrame:
    """df with its columns imputed and scaled; parameters are the collected rows of fit(): one a column."""
    by = {p["column"]: p for p in parameters}
    kept = [c for c in columns if by[c]["verdict"] == "kept"]
    scaled = [((F.coalesce(finite(c), F.lit(by[c]["median"])) - F.lit(by[c]["mean"])) / F.lit(by[c]["std"])).alias(c) for c in kept]
    return df.select(*[c for c in df.columns if c not in columns], *scaled)


def quantiles(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """(column, step, q, value): n + 1 evenly spaced exact quantiles of each column; a row of these for each reaches the driver."""
    got = quantiles_of(df, {c: finite(c) for c in columns}, [i / n for i in range(n + 1)])
    rows = [(c, i, i / n, v) for c in columns for i, v in enumerate(got[c])]
    return df.sparkSession.createDataFrame(rows, "column string, step int, q double, value double")


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """The inverse of the normal distribution function; shares nearer to 0 or 1 than 10^-7 count as that far."""
    inverse = np.frompyfunc(NormalDist().inv_cdf, 1, 1)
    return inverse(np.clip(p, 1e-7, 1 - 1e-7)).astype(float)


def quantile_normal(value: Column, grid: Sequence[float]) -> Column:
    """A value's place in a fitted grid of quantiles, as a normal score (a pandas function: there is no built-in)."""
    ship(SparkSession.getActiveSession())
    xs = np.asarray(grid, float)
    ps = np.linspace(0, 1, len(xs))

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        a = v.to_numpy(float)
        place = (np.interp(a, xs, ps) + 1 - np.interp(-a, -xs[::-1], ps)) / 2  # the middle of ties
        return pd.Series(normal_quantile(place))

    return score(value)


def write_shards(df: DataFrame, path: str, rows: int, most: int, split: str = "split") -> int:
    """Parquet files of exactly `rows` rows by split, the last one of each with what is left; how many are returned.

    ValueError, before anything is written, if a split needs more than `most`. Rows get numbers within their split where they
    are (one sum for each task and split), each run of `rows` numbers is one task's and one file, rows that are alike
    too; what the files hold is checked afterwards.
    """
    sizes = {r[split]: r["n"] for r in df.groupBy(split).agg(F.count("*").alias("n")).collect()}  # one row a split
    files = {s: -(-n // rows) for s, n in sizes.items()}
    over = [s for s, n in files.items() if n > most]
    if over:
        raise ValueError(f"splits {over} need more than {most} shards")
    if not sizes:
        df.write.mode("overwrite").partitionBy(split).parquet(path)
        return 0
    first, at = {}, 0  # a split's files are numbered from here on
    for s, n in files.items():
        first[s], at = at, at + n
    ranked = with_ranks(df, [split], [])
    shard = F.coalesce(*[F.when(F.col(split).eqNullSafe(F.lit(s)), F.lit(first[s])) for s in sizes]) + F.floor((F.col(RANK) - 1) / rows)
    ranked.repartitionById(at, shard.cast("int")).drop(RANK, SIZE).write.mode("overwrite").partitionBy(split).parquet(path)
    held = {r[split]: r["n"] for r in df.sparkSession.read.parquet(path).groupBy(split).agg(F.count("*").alias("n")).collect()}
    if held != sizes:
        raise ValueError(f"the shards hold {held}, not {sizes}")
    return at


def read_split(spark, path: str, split: str | int, columns: Sequence[str], rows: int | None = None, labels: tuple[str, Mapping[int, int]] | None = None) -> DataFrame:
    """One split's chosen columns: the split is a folder, so other splits are never opened.

    With rows, or with labels (a column and how often each value stands there), ValueError if the shards hold something else.
    """
    whole = spark.read.parquet(path).where(F.col("split") == split)
    if rows is not None and (n := whole.count()) != rows:
        raise ValueError(f"split {split} has {n} rows, not {rows}")
    if labels is not None:
        found = {r[0]: r["n"] for r in whole.groupBy(labels[0]).agg(F.count("*").alias("n")).collect()}  # a row a label
        if found != dict(labels[1]):
            raise ValueError(f"split {split} has labels {found}, not {dict(labels[1])}")
    return whole.select(*columns)
