"""The preparation of a dataset from shards to scaled splits, and what is checked at its end."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import bucketed
from ..functions import schema as S
from ..functions.columns import own_name
from ..operators import dedup, labels, profile, sampling, scalers, splits

# The phases of a run, in order.
PHASES = ("prepare", "shap", "bo", "final_train", "evaluate", "done")


@dataclass
class Roles:
    """Which columns are what."""

    label: str = "label"
    file: str = "file"
    position: str = "position"
    time: str | None = "timestamp"
    metadata: Sequence[str] = ()
    benign: Sequence[str] = ("BENIGN",)
    attack: Sequence[str] = ()
    dropped: Sequence[str] = ()


@dataclass
class Prepared:
    rows: DataFrame
    parameters: list[Any]
    features: list[str]
    summary: DataFrame
    leaked: DataFrame
    timings: dict[str, float] = field(default_factory=dict)
    scaler: scalers.Scaler | None = None


def next_phase(phase: str) -> str:
    return PHASES[min(PHASES.index(phase) + 1, len(PHASES) - 1)]


def run_phases(handlers: Mapping[str, Callable[[], bool | None]], record: Callable[[str], None], phase: str = PHASES[0], most: int = 4) -> str:
    """Run phases from one on, and record each that is reached; the phase where it stopped.

    A handler that returns False was cut off: the phase stays. Phases behind training have none; another without one is an error.
    """
    for _ in range(most):
        if phase in PHASES[-2:]:
            break
        if phase not in handlers:
            raise KeyError(f"nothing runs the phase {phase!r}")
        if handlers[phase]() is False:
            break
        phase = next_phase(phase)
        record(phase)
    return phase


class Stages:
    """Seconds by stage."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    def run(self, name: str, f: Callable[[], Any]) -> Any:
        began = time.perf_counter()
        try:
            return f()
        finally:
            self.seconds[name] = time.perf_counter() - began


#: Unknown labels that a report names.
SHOWN = 100


def audit(df: DataFrame, roles: Roles) -> list[str]:
    """What forbids going on; an empty list is a pass."""
    decisions = labels.decision_table(df.sparkSession, roles.benign, roles.attack, roles.dropped)
    try:
        label = S.label_column(df.columns, [roles.label])
    except KeyError:
        return profile.audit_failures(1, 1, 1, [], [], label_found=False)
    counts = labels.binary_counts(labels.decide(df, label, decisions)).first()
    every = labels.unknown_labels(df, label, decisions)
    shown = [r["raw_label"] for r in every.limit(SHOWN + 1).collect()]  # of more, a report shows these and their number
    more = [f"and more, {every.count()} in all"] if len(shown) > SHOWN else []
    return profile.audit_failures(sum(counts), counts["n_benign"], counts["n_attack"], shown[:SHOWN] + more, [])


#: Columns of the index that stand for what tells rows apart.
TWINS = ("twin_1", "twin_2")


def split_index(df: DataFrame, roles: Roles, per_benign: float | None, seed: int = 0) -> DataFrame:
    """(file, position, raw_label, y, split, twin_1, twin_2) of every row in scope that is the first of its twins.

    Only keys, order and digests are carried through dedup, ranks and thinning, never whole rows. Duplicates go before scope: an
    out-of-scope row can be the first of its twins.
    """
    decided = labels.decide(df, roles.label, labels.decision_table(df.sparkSession, roles.benign, roles.attack, roles.dropped))
    told = S.hash_columns(df.columns, [roles.label, roles.file, roles.position, *roles.metadata])
    order = roles.time if roles.time else roles.position
    narrow = decided.select(*dict.fromkeys([roles.file, roles.position, order]), "raw_label", "y", *[h.alias(n) for h, n in zip(dedup.digest(told), TWINS, strict=True)])
    first = dedup.first_occurrences(narrow, TWINS, [roles.file, roles.position]).where("is_first")
    cut = splits.temporal_stratified(labels.in_scope(first), roles.file, "raw_label", order, roles.position)
    if per_benign is not None:
        key = own_name(cut.columns, "row_key")
        cut = cut.withColumn(key, F.concat_ws("|", roles.file, F.col(roles.position).cast("string")))
        cut = sampling.thin_attacks(cut, [roles.file, "raw_label"], key, seed, per_benign)
    return cut.select(roles.file, roles.position, "raw_label", "y", "split", *TWINS)


@dataclass
class Indexed:
    """Rows and their split index, both dealt to the same buckets by (file, position): they meet without a shuffle."""

    rows: DataFrame
    index: DataFrame
    keys: tuple[str, str]

    def cut(self, *columns: str) -> DataFrame:
        """The rows that have a split (with raw_label, y and split); of the index, only what is asked for is read."""
        return self.rows.join(self.index.select(*self.keys, *(columns or ("raw_label", "y", "split"))), list(self.keys))


def indexed(df: DataFrame, roles: Roles, per_benign: float | None, seed: int = 0, buckets: int | None = None) -> Indexed:
    """The split of a dataset, decided once and written as a table beside the rows; ValueError if a position is not unique in its file."""
    keys = (roles.file, roles.position)
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bucketed(df, keys, n, "rows")
    index = bucketed(split_index(rows, roles, per_benign, seed), keys, n, "index")
    if not index.groupBy(*keys).count().where("count > 1").isEmpty() or not rows.where(F.col(roles.position).isNotNull()).groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{roles.position} doesn't tell the rows of a {roles.file} apart")
    return Indexed(rows, index, keys)


def split_rows(df: DataFrame, roles: Roles, per_benign: float | None, seed: int = 0) -> DataFrame:
    """df with raw_label, y and split, without duplicates and rows out of scope."""
    return indexed(df, roles, per_benign, seed).cut()


def prepare(df: DataFrame, roles: Roles, per_benign: float | None = 30.0, most_missing: float = 0.5, seed: int = 0, scaler: str = "standard") -> Prepared:
    """Split once, a scaler (by name) fitted on train alone, transformed in one job; ValueError if the audit fails.

    The split is a table: fitting, the rows, the summary and the leakage audit read it, none of them decides it again.
    """
    stages = Stages()
    problems = stages.run("audit", lambda: audit(df, roles))
    if problems:
        raise ValueError("; ".join(problems))
    split = stages.run("split", lambda: indexed(df, roles, per_benign, seed))
    cut = split.cut()
    excluded = [roles.label, roles.file, roles.position, "raw_label", "y", "split", *roles.metadata, *([roles.time] if roles.time else [])]
    features, _, _ = S.feature_columns(cut.schema, excluded)
    fitted = stages.run("fit", lambda: scalers.fit_scaler(cut.where(F.col("split") == splits.TRAIN), features, scaler, most_missing))
    scaled = fitted.apply(cut.where("split >= 0"), features)
    return Prepared(scaled, fitted.parameters, fitted.kept, splits.summary(split.index), dedup.leakage(split.index, TWINS), stages.seconds, fitted)


def validate(prepared: Prepared, least_benign: int, columns: Iterable[str] = ()) -> list[tuple[str, str, str]]:
    """(check, PASS, SKIP or FAIL, detail): the acceptance of a preparation."""
    by = {r["split"]: r for r in prepared.summary.collect()}  # a row a split
    out = []

    def add(check: str, ok: bool | None, detail: object = "") -> None:
        out.append((check, "SKIP" if ok is None else "PASS" if ok else "FAIL", str(detail)))

    for i, name in enumerate(splits.NAMES):
        add(f"{name} has rows", i in by and by[i]["n_rows"] > 0)
        add(f"{name} has benign rows", i in by and by[i]["n_benign"] >= least_benign, by[i]["n_benign"] if i in by else 0)
    add("no row leaks", prepared.leaked.first()["cross_rows"] == 0)
    add("features are left", bool(prepared.features), len(prepared.features))
    bad = [F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in prepared.features]
    add("all values are finite", not any(prepared.rows.agg(*bad).first()) if bad else None)
    for c in columns:
        add(f"{c} is a feature", c in prepared.features)
    return out
