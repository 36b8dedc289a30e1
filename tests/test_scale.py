"""Operators that must hold for any skew: ranks, shards, twins, capped counts, the split as a table."""

import glob
import hashlib
import math
import os
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowprep.cluster import shared_dir
from flowprep.functions import columns as C
from flowprep.functions import schema as S
from flowprep.ml import explain
from flowprep.operators import dedup, monitor, prep, profile, quantiles, ranks, scalers
from flowprep.plans import prepare


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_other_spelling_of_a_rate_is_looked_up():
    index = S.alias_index({"fwd_packets_per_s": [], "Flow Bytes": ["bytes"]})
    assert S.resolve("Fwd Packets/s", index) == "fwd_packets_per_s" and S.resolve("Bytes", index) == "flow_bytes"
    assert S.resolve("other_s", index) == "other_s" and S.normal_name("ab﻿cd") == "abcd"
    assert S.resolve("a_s", {"a_s": "own", "a_per_s": "other"}) == "own"


def test_stripped_takes_what_text_strips(spark):
    ends = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    rows = [(f"{e}a{e} b{e}{e}",) for e in ends] + [("​x​",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(C.stripped("t")).collect()]
    assert got == [None if t is None else t.strip() for (t,) in rows]


def test_one_of_tied_twins_is_first(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (2, "c"), (2, "c")], "i int, row_number string").repartition(3)
    first = dedup.first_occurrences(df, ["row_number"], ["i"])
    assert first.columns == ["i", "row_number", "is_first"] and first.count() == 6
    assert sorted((r["row_number"], r["i"]) for r in first.where("is_first").collect()) == [("a", None), ("b", 1), ("c", 2)]
    assert dedup.first_occurrences(df, ["row_number"], ["i"], ["row_number"]).where("is_first").count() == 3


@pytest.mark.parametrize("stream", [[], ["s"]])
def test_ranks_by_sampled_ranges(spark, stream):
    df = spark.range(4000).select("id", (F.col("id") % 3).alias("s"), F.when(F.col("id") % 5 != 0, F.pmod(F.xxhash64("id"), F.lit(900))).alias("t"), F.lit("x").alias("place"))
    order = [F.col("t").asc_nulls_first(), F.col("id")]
    got = ranks.with_ranks(df, stream, order)
    want = df.withColumn("want", F.row_number().over(Window.partitionBy(*stream).orderBy(*order)))
    assert got.columns == [*df.columns, ranks.RANK, ranks.SIZE]
    assert got.join(want.select("id", "want"), "id").where(F.col(ranks.RANK) != F.col("want")).count() == 0 and got.count() == 4000
    assert ranks.with_ranks(df.limit(0), stream, order).count() == 0


@pytest.mark.parametrize("same", ["instant", "row"])
def test_one_instant_is_split_among_tasks(spark, same):
    """All rows in one second, or one row repeated: no task holds more than its share, and ranks are those of a permutation."""
    df = spark.range(8000).select(F.lit("f").alias("s"), F.lit(7).alias("t"), *([F.col("id")] if same == "instant" else []))
    order = [F.col("t"), *([F.col("id")] if same == "instant" else [])]
    got = ranks.with_ranks(df, ["s"], order)
    found = sorted(r[0] for r in got.select(ranks.RANK).collect())
    assert found == list(range(1, 8001)) and got.where(f"{ranks.SIZE} <> 8000").count() == 0
    parts = glob.glob(f"{shared_dir(spark)}/flowprep/ranks-*".removeprefix("file://"))
    newest = max(parts, key=os.path.getmtime)
    tasks = [r["count"] for r in spark.read.parquet(newest).groupBy("_metadata.file_path").count().collect()]
    assert sum(tasks) == 8000 and max(tasks) < 4000


@pytest.mark.parametrize("kind", ["distinct", "repeated"])
def test_shards_hold_exactly_their_rows(spark, tmp_path, kind):
    df = spark.range(0, 2000, numPartitions=7).select(F.col("id") if kind == "distinct" else F.lit(1).alias("id"), F.when(F.col("id") % 4 != 0, (F.col("id") % 4).cast("int")).alias("split"))
    path = str(tmp_path / kind)
    assert prep.write_shards(df, path, 200, 3) == 4 * 3
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("_metadata.file_path").count().collect()]
    assert sorted(sizes) == [100] * 4 + [200] * 8
    with pytest.raises(ValueError, match="more than 2"):
        prep.write_shards(df, str(tmp_path / "none"), 200, 2)
    assert not (tmp_path / "none").exists()


def test_capped_counts_shuffle_no_more_than_the_cap(spark):
    df = spark.range(20_000, numPartitions=4).select("id", (F.col("id") % 3).alias("few"), F.lit(None).cast("string").alias("none"))
    got = {r["column"]: (r["n_distinct"], r["shown"]) for r in profile.distinct_capped(df, ["id", "few", "none"], 50).collect()}
    assert got == {"id": (50, "capped_at_50"), "few": (3, "3"), "none": (0, "0")}
    assert profile.distinct_capped(df.limit(0), ["few"], 5).first()["shown"] == "0"


def test_identifiers_in_any_order(spark):
    rng = random.Random(1)
    ids = [17 + 3 * i for i in range(1500)]
    rng.shuffle(ids)
    rows = [(i, v, v if i else None, rng.randrange(10**9), 2**62 - v) for i, v in enumerate(ids)]
    df = spark.createDataFrame(rows, "at long, run long, gap long, free long, big long")
    got = {r["column"]: (r["step"], r["verdict"]) for r in profile.identifier_columns(df, ["run", "gap", "free", "big"], "at").collect()}
    assert got["run"] == (3, "error") and got["big"] == (3, "error") and got["free"][1] == "ok"
    assert profile.identifier_columns(df.limit(0), ["run"], "at").first()["verdict"] == "ok"


def test_importance_of_noise_and_of_a_planted_parameter(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        noise, rate, kind = rng.random(), 10 ** rng.uniform(-5, -1), rng.choice(["a", "b", None])
        rows.append((noise, rate, kind, abs(-3 - math.log10(rate)) + 0.05 * rng.random()))
    df = spark.createDataFrame([*rows, (0.5, 0.1, "a", None), (None, None, None, float("nan"))], "noise double, rate double, kind string, value double")
    got = {r["parameter"]: r["importance"] for r in monitor.parameter_importance(df, ["noise", "rate", "kind"]).collect()}
    assert got["noise"] < 0.1 and got["kind"] < 0.1 and got["rate"] > 0.8
    assert {r["importance"] for r in monitor.parameter_importance(df.limit(0), ["noise", "kind"]).collect()} == {0.0}


ROLES = prepare.Roles("label", "file", "position", "t", (), ["ok"], ["bad"])


def captured(spark, n=1200):
    base = spark.range(n).select((F.col("id") % 2).cast("string").alias("file"), (F.col("id") / 2).cast("long").alias("position"), F.lit(5).alias("t"), F.when(F.col("id") % 6 == 0, "ok").otherwise("bad").alias("label"))
    return base.withColumn("x", F.pmod(F.xxhash64("file", "position"), F.lit(700)).cast("double")).withColumn("y2", F.rand(3))


def test_consumers_of_the_split_decide_nothing_again(spark):
    """No shuffle and no window stands between the index and those that read it."""
    df = captured(spark).drop("y2")
    got = prepare.indexed(df, ROLES, 3.0, buckets=4)
    cut = got.cut()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        said = plan(got.cut())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in said and "Exchange" not in said and "Window" not in said
    assert cut.count() == df.select("t", "x").distinct().count()
    again = prepare.split_rows(df, ROLES, 3.0)
    assert {tuple(r) for r in again.select("file", "position", "split").collect()} == {tuple(r) for r in cut.select("file", "position", "split").collect()}
    ready = prepare.prepare(df, ROLES, 3.0)
    assert ready.leaked.first()["cross_rows"] == 0 and "Window" not in plan(ready.rows) + plan(ready.summary) + plan(ready.leaked)


def test_positions_must_tell_rows_apart(spark):
    df = captured(spark, 40)
    with pytest.raises(ValueError, match="apart"):
        prepare.indexed(df.union(df.limit(1).withColumn("x", F.lit(-1.0))), ROLES, None, buckets=2)


def test_an_audit_says_how_many_labels_are_unknown(spark):
    df = captured(spark, 300).withColumn("label", F.concat(F.lit("l"), F.col("position").cast("string")))
    assert any("150 in all" in p for p in prepare.audit(df, ROLES))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_donors_are_a_permutation(size):
    at = np.arange(size)
    seen = {tuple(explain.donors(at, size, key).tolist()) for key in range(4)}
    assert all(sorted(p) == list(range(size)) for p in seen) and (size < 64 or len(seen) == 4)


def test_importance_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + 0.2 * x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "i long, x array<double>, y int").repartition(3)
    score = lambda m: 1 / (1 + np.exp(-(m[:, 0] + 0.2 * m[:, 1])))
    got = {r["feature"]: r for r in explain.permutation_importance(df, "i", "x", "y", 3, score, [0, 1, 2], 3, seed=2).collect()}
    order = sorted(range(300), key=lambda i: (hashlib.md5(f"2|{i}".encode()).hexdigest(), i))

    def f1(m):
        said, out = score(m) >= 0.5, []
        for c in (0, 1):
            hit = int(((y == c) & (said == c)).sum())
            out.append(2 * hit / (int((y == c).sum()) + int((said == c).sum())))
        return sum(out) / 2

    for f in range(3):
        drops = []
        for r in range(3):
            m = x.copy()
            m[order, f] = x[np.array(order)[explain.donors(np.arange(300), 300, 2000 + r)], f]
            drops.append(f1(x) - f1(m))
        assert math.isclose(got[f]["mean_drop"], sum(drops) / 3, abs_tol=1e-8) and math.isclose(got[f]["std_drop"], float(np.std(drops)), abs_tol=1e-8)
        assert math.isclose(got[f]["baseline_macro_f1"], f1(x), abs_tol=1e-8) and got[f]["repeats"] == 3
    assert got[2]["mean_drop"] == 0 < got[1]["mean_drop"] < got[0]["mean_drop"]


def test_few_quantiles_take_two_scans(spark, monkeypatch):
    """Exact whatever the sketch says: with a margin too small for it, what it misses is found by passes."""
    rng = np.random.default_rng(5)
    cols = {"a": rng.normal(size=20_000), "b": rng.integers(0, 4, 20_000).astype(float), "c": np.full(20_000, -1.5), "d": np.exp(rng.normal(size=20_000) * 20)}
    df = spark.createDataFrame(list(zip(*(v.tolist() for v in cols.values()), strict=True)), ", ".join(f"{c} double" for c in cols)).repartition(5)
    shares = [0.0, 0.05, 0.5, 0.951, 1.0]
    passes = []
    real = quantiles.order_statistics
    monkeypatch.setattr(quantiles, "order_statistics", lambda *a: passes.append(1) or real(*a))

    def check():
        got = quantiles.quantiles(df, {c: F.col(c) for c in cols}, shares)
        for c, v in cols.items():
            v = np.sort(v)
            places = [quantiles.ranks_of(p, len(v)) for p in shares]
            assert got[c] == [v[i] + (v[j] - v[i]) * part if part else v[i] for i, j, part in places], c

    check()
    assert not passes
    monkeypatch.setattr(quantiles, "MARGIN", 0.0)
    check()
    assert passes


@pytest.mark.parametrize("kind", ["standard", "quantile"])
def test_scalers_are_kept_and_read_back(spark, tmp_path, kind):
    rng = np.random.default_rng(7)
    a, b = np.exp(rng.normal(size=2000)), rng.integers(0, 3, 2000).astype(float)
    rows = [(float(x) if i % 10 else None, float(y), None, 4.0) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, gone double, flat double")
    names = ["a", "b", "gone", "flat"]
    fitted = scalers.fit_scaler(df, names, kind, steps=99)
    assert fitted.kept == ["a", "b"]
    fitted.write(spark, str(tmp_path / kind))
    back = scalers.read_scaler(spark, str(tmp_path / kind))
    first, again = (np.array([tuple(r) for r in s.apply(df, names).collect()]) for s in (fitted, back))
    assert back.features == names and back.kind == kind and np.array_equal(first, again) and first.shape == (2000, 2)
    with pytest.raises(ValueError, match="fitted on"):
        back.apply(df, names[::-1])
    if kind == "quantile":
        filled = np.array([np.median(np.delete(a, slice(None, None, 10))) if i % 10 == 0 else v for i, v in enumerate(a)])
        grid = np.quantile(filled, np.linspace(0, 1, 100))
        place = (np.interp(filled, grid, np.linspace(0, 1, 100)) + 1 - np.interp(-filled, -grid[::-1], np.linspace(0, 1, 100))) / 2
        want = [NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7)) for p in place]
        assert np.allclose(first[:, 0], want, atol=1e-9)


def test_a_scaler_has_a_name(spark, tmp_path):
    with pytest.raises(ValueError, match="no scaler"):
        scalers.fit_scaler(captured(spark), ["x"], "other")
    ready = prepare.prepare(captured(spark).drop("y2"), ROLES, 3.0, scaler="quantile")
    low, high = ready.rows.agg(F.min("x"), F.max("x")).first()
    assert ready.scaler.kind == "quantile" and ready.features == ["x"] and -5.2 < low < -2 and 2 < high < 5.2
