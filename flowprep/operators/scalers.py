"""Scalers by name, fitted on the training rows, kept as a table, and applied without a join.

A scaler holds a row for each candidate feature: its verdict, its median for what is missing, and mean and deviation
("standard") or a grid of quantiles ("quantile", to normal scores). Its size follows from the features, not from the rows, and is
checked before it travels to the executors inside the expressions.

Cases: missing, NaN and infinite values become the median; a column without values has the median 0 and is left out; rejected
columns don't come back; values beyond the grid get the scores of its ends; ties in the grid get the middle of their places.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite
from .prep import fit, quantile_normal, standardised
from .quantiles import quantiles

# The names of scalers, and the steps of a grid.
KINDS, STEPS = ("standard", "quantile"), 999
#: Numbers that the grids of a scaler may hold together.
MOST = 1 << 22

PARAMETERS = "position int, kind string, column string, missing_ratio double, median double, mean double, std double, variance double, verdict string, grid array<double>"


@dataclass
class Scaler:
    kind: str
    parameters: list[Any]
    grids: dict[str, list[float]]

    @property
    def features(self) -> list[str]:
        """All candidates, in the order of fitting."""
        return [p["column"] for p in self.parameters]

    @property
    def kept(self) -> list[str]:
        return [p["column"] for p in self.parameters if p["verdict"] == "kept"]

    def apply(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """df with its kept features imputed and scaled, the rejected ones gone; ValueError if the features aren't those fitted."""
        if list(columns) != self.features:
            raise ValueError(f"fitted on {self.features}, not on {list(columns)}")
        if self.kind == "standard":
            return standardised(df, columns, self.parameters)
        medians = {p["column"]: p["median"] for p in self.parameters}
        scores = [quantile_normal(F.coalesce(finite(c), F.lit(medians[c])), self.grids[c]).alias(c) for c in self.kept]
        return df.select(*[c for c in df.columns if c not in columns], *scores)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, self.kind, p["column"], p["missing_ratio"], p["median"], p["mean"], p["std"], p["variance"], p["verdict"], self.grids.get(p["column"])) for i, p in enumerate(self.parameters)]
        return spark.createDataFrame(rows, PARAMETERS)

    def write(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def read_scaler(spark: SparkSession, path: str) -> Scaler:
    rows = spark.read.schema(PARAMETERS).parquet(path).orderBy("position").collect()  # a row a feature
    kinds = {r["kind"] for r in rows}
    if len(kinds) != 1 or not kinds <= set(KINDS):
        raise ValueError(f"{path} holds no scaler, or several: {sorted(map(str, kinds))}")
    return Scaler(kinds.pop(), rows, {r["column"]: list(r["grid"]) for r in rows if r["grid"] is not None})


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str = "standard", most_missing: float = 0.5, steps: int = STEPS) -> Scaler:
    """A scaler by name, fitted on all rows of df; grids are of the values after imputation."""
    if kind not in KINDS:
        raise ValueError(f"no scaler is called {kind!r}: there are {KINDS}")
    parameters = fit(df, columns, most_missing).collect()  # a row a feature
    kept = {p["column"]: p["median"] for p in parameters if p["verdict"] == "kept"}
    grids: dict[str, list[float]] = {}
    if kind == "quantile" and kept:
        if len(kept) * (steps + 1) > MOST:
            raise ValueError(f"grids of {len(kept)} features and {steps} steps hold more than {MOST} numbers")
        grids = quantiles(df, {c: F.coalesce(finite(c), F.lit(m)) for c, m in kept.items()}, [i / steps for i in range(steps + 1)])
    return Scaler(kind, parameters, grids)
