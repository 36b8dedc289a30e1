"""What a finished run must show: a table of rules over the facts in its reports, and the verdict.

A run is a folder of JSON reports (and one CSV). Its facts are a table (report, key, value): a key is the path to a value, a value
is JSON. A rule names a fact and how it must stand; one join of rules and facts settles them all. A check is a few rules: a
report that one of them needs and that is absent skips the check, one that can't be read fails it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import monitor
from ..sources.datasets import read_json, read_rows
from .config import CONSTRAINTS

# Where a run keeps its reports.
REPORTS = {
    "history": "checkpoints/history.json", "state": "checkpoints/training_state.json", "config": "config/run_config.json", "leakage": "config/leakage_audit.json", "fitting": "config/preprocessing.json",
    "features": "cache/selected_features.json", "search": "bayesopt/best_params.json", "metrics": "metrics/test_metrics.json", "explained": "explainability/explainability_notes.json",
}
COMPARISON = "metrics/comparison_with_paper.csv"
# The metrics that a test report has, and the columns of published values.
METRICS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "macro_f1", "mcc", "roc_auc", "pr_auc", "log_loss", "specificity", "fpr", "fnr")
PUBLISHED = ("paper_headline", "paper_body")


# Fixed value: the name of the model of the last epoch.
LAST_MODEL = f"model_epoch_{CONSTRAINTS['epochs']}.pt"
#: Epochs that a detail names; their number is given besides.
NAMED = 10


@dataclass(frozen=True)
class Rule:
    """How a fact must stand: is (a value), like (another fact, "report key"), there, or unset (absent, null, false, 0 or empty).

    With unless, a key of the same report that is set excuses it; an optional rule holds where its report is absent.
    """

    check: str
    report: str
    key: str
    must: str
    value: Any = None
    unless: str = ""
    optional: bool = False


_TRAINING = "experiment.training."
# The keys of reports.
RULES = (
    Rule("the history has every epoch once", "history", "problems", "unset"),
    Rule("the last epoch's model is final", "state", "", "there"),
    Rule("the last epoch's model is final", "files", f"checkpoints/{LAST_MODEL}", "there"),
    Rule("the last epoch's model is final", "metrics", "checkpoint", "is", LAST_MODEL, optional=True),
    Rule("training didn't stop early", "config", f"{_TRAINING}early_stopping", "unset"),
    Rule("training didn't stop early", "config", f"{_TRAINING}epochs", "is", CONSTRAINTS["epochs"]),
    *(Rule("fixed parameters held", "config", f"{_TRAINING}{k}", "is", CONSTRAINTS[k]) for k in ("batch_size", "learning_rate")),
    Rule("no duplicates between splits", "leakage", "cross_split_duplicate_rows", "is", 0, unless="upsample_before_split"),
    Rule("fitted on training rows only", "fitting", "fitted_on", "is", "train_only"),
    Rule("one feature set", "features", "feature_schema_hash", "like", "state feature_schema_hash"),
    Rule("the search is complete", "search", "n_trials_completed", "like", "search n_trials_requested"),
    *(Rule("the search is complete", "search", f"params.{k}", "absent") for k in ("learning_rate", "batch_size")),
    *(Rule("all metrics are there", "metrics", m, "there") for m in METRICS),
    *(Rule("both published values are kept", "comparison", c, "there") for c in PUBLISHED),
    Rule("attributions weren't fed back", "explained", "fed_back_into_selection", "is", False),
)


def written_as(value: Any) -> str:
    """A value as JSON; whole numbers are written alike, whatever their type."""
    return json.dumps(int(value) if isinstance(value, float) and value.is_integer() else value, sort_keys=True)


def flat(value: Any, key: str = "") -> Iterator[tuple[str, str]]:
    """(key, value) of a report and of all that is nested in it."""
    yield key, written_as(value) if not isinstance(value, dict) else "{}"
    if isinstance(value, Mapping):
        for k, v in value.items():
            yield from flat(v, f"{key}.{k}" if key else str(k))


def epochs(spark: SparkSession, records: Any, last: int) -> list[tuple[str, str]]:
    """The fact of what is wrong with a history, null if nothing is."""
    rows = spark.createDataFrame([(i, int(r["epoch"])) for i, r in enumerate(records)], "position long, epoch long")
    found = monitor.history_problems(rows, last).groupBy("problem").agg(F.sort_array(F.collect_set("epoch")).alias("e")).orderBy("problem").collect()  # at most an epoch each
    said = [f"{r['problem']}: {r['e'][:NAMED]}" + (f" and more, {len(r['e'])} in all" if len(r["e"]) > NAMED else "") for r in found]
    return [("", "[]"), ("problems", written_as("; ".join(said) or None))]


def facts(spark: SparkSession, folder: str) -> tuple[list[tuple[str, str, str]], list[tuple[str, str]]]:
    """(report, key, value) of the reports that can be read, and (report, what is wrong) of the others that exist."""
    at = lambda path: os.path.join(folder, path)
    found, broken, total = [("files", f"checkpoints/{LAST_MODEL}", "true")] if os.path.exists(at(f"checkpoints/{LAST_MODEL}")) else [], [], CONSTRAINTS["epochs"]
    for name in sorted(REPORTS, key=lambda n: n == "history"):  # the history is held against the state's number of epochs
        if not os.path.exists(at(REPORTS[name])):
            continue
        try:
            said = read_json(at(REPORTS[name]))
            if name == "state":
                total = said.get("total_epochs", total)
            elif name != "history" and not isinstance(said, Mapping):
                raise ValueError("it holds no keys")
            found += [(name, k, v) for k, v in (epochs(spark, said, total) if name == "history" else flat(said))]
        except (ValueError, KeyError, TypeError, AttributeError, OSError) as x:
            broken.append((name, f"{type(x).__name__}: {x}"))
    if os.path.exists(at(COMPARISON)):
        rows = read_rows(at(COMPARISON))
        found += [("comparison", c, "true") for c in ("", *(rows[0] if rows else ()))]
    return found, broken


def checked(spark: SparkSession, folder: str) -> DataFrame:
    """(check, status, detail) of a run's folder; monitor.accepted() makes the verdict."""
    found, broken = facts(spark, folder)
    known = spark.createDataFrame(found or [("files", "", "true")], "report string, key string, value string")
    states = spark.createDataFrame([*((r, "") for r in {"files", *(f[0] for f in found)}), *broken], "report string, wrong string")
    other = [r.value.split(" ", 1) if r.must == "like" else (r.report, r.unless) for r in RULES]
    rules = spark.createDataFrame(
        [(i, r.check, r.report, r.key, r.must, written_as(r.value), r.unless != "", r.optional, *o) for i, (r, o) in enumerate(zip(RULES, other, strict=True))],
        "n int, check string, report string, key string, must string, wanted string, excusable boolean, optional boolean, other_report string, other_key string",
    )
    mine = known.withColumnRenamed("value", "said")
    theirs = known.select(F.col("report").alias("other_report"), F.col("key").alias("other_key"), F.col("value").alias("other_said"))
    there = states.withColumn("present", F.lit(True))
    also = there.select(F.col("report").alias("other_report"), F.col("wrong").alias("other_wrong"), F.col("present").alias("other_present"))
    met = rules.join(mine, ["report", "key"], "left").join(theirs, ["other_report", "other_key"], "left").join(there, "report", "left").join(also, "other_report", "left")
    unset = lambda c: F.coalesce(F.col(c).isin("null", "false", "0", '""', "[]"), F.lit(True))
    holds = (
        F.when(F.col("must") == "is", F.col("said").eqNullSafe(F.col("wanted")))
        .when(F.col("must") == "like", F.col("said").eqNullSafe(F.col("other_said")))
        .when(F.col("must") == "there", F.coalesce(F.col("said") != "null", F.lit(False)))
        .when(F.col("must") == "absent", F.col("said").isNull())
        .otherwise(unset("said"))
    )
    excused = F.col("excusable") & ~unset("other_said")
    lacking = F.col("present").isNull() | F.col("other_present").isNull()
    wrong = F.coalesce(F.nullif(F.concat(F.coalesce("wrong", F.lit("")), F.when(F.col("must") == "like", F.coalesce("other_wrong", F.lit(""))).otherwise("")), F.lit("")), F.lit(None))
    status = F.when(lacking, F.when(F.col("optional"), "PASS").otherwise("SKIP")).when(wrong.isNotNull(), "FAIL").when(excused | holds, "PASS").otherwise("FAIL")
    name = F.when(F.col("key") == "", F.col("report")).otherwise(F.concat_ws(" ", "report", "key"))
    told = F.when(status == "SKIP", F.concat(F.lit("no "), F.when(F.col("present").isNull(), F.col("report")).otherwise(F.col("other_report")))).when(status == "FAIL", F.coalesce(wrong, F.concat(name, F.lit(" is "), F.coalesce("said", F.lit("absent")))))
    judged = met.select("n", "check", status.alias("status"), told.alias("told"))
    worst = F.when(F.bool_or(F.col("status") == "SKIP"), "SKIP").when(F.bool_or(F.col("status") == "FAIL"), "FAIL").otherwise("PASS")
    said = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("told").isNotNull(), F.struct("n", "told")))), lambda x: x["told"])), "; ")
    return judged.groupBy("check").agg(F.min("n").alias("n"), worst.alias("status"), said.alias("detail")).orderBy("n").select("check", "status", "detail")
