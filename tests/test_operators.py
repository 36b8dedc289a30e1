import math

import pytest
from pyspark.sql import functions as F

from flowprep.functions import columns as C
from flowprep.operators import dedup, labels, metrics, monitor, prep, profile, ranking, sampling, splits


def one(df):
    return df.first().asDict()


def test_half_even(spark):
    got = spark.createDataFrame([(x,) for x in (0.5, 1.5, 2.5, 3.5)], "x double").select(C.half_even(F.col("x")).alias("r")).collect()
    assert [r["r"] for r in got] == [0, 2, 2, 4]


def test_times_of_mixed_formats(spark):
    df = spark.createDataFrame([("2018-12-01 10:01:48",), ("3/11/2018 10:01:48 AM",), ("nonsense",), (None,)], "t string")
    assert [r[0] is not None for r in df.select(C.parsed_time("t")).collect()] == [True, True, False, False]


def test_keep_first(spark):
    df = spark.createDataFrame(list(enumerate([7, 3, 7, 9, 3, 7])), "i int, v int")
    got = dedup.first_occurrences(df, ["v"], ["i"]).orderBy("i").collect()
    assert [r["is_first"] for r in got] == [True, True, False, True, False, False]


def test_keep_first_takes_nulls_and_nans_as_equal(spark):
    df = spark.createDataFrame([(0, None), (1, None), (2, float("nan")), (3, float("nan")), (4, 0.0), (5, -0.0)], "i int, v double")
    got = dedup.first_occurrences(df, ["v"], ["i"]).orderBy("i").collect()
    assert [r["is_first"] for r in got] == [True, False] * 3
    assert dedup.first_occurrences(df.limit(0), ["v"], ["i"]).count() == 0


@pytest.mark.parametrize(("n", "sizes"), [(1, (1, 0, 0)), (2, (2, 0, 0)), (3, (1, 1, 1)), (5, (3, 1, 1)), (10, (7, 2, 1)), (15, (10, 2, 3))])
def test_cut_sizes(spark, n, sizes):
    df = spark.range(n).select(F.col("id").alias("i"), F.lit("f").alias("file"), F.lit("l").alias("label"), F.col("id").alias("t"))
    got = {r["split"]: r["count"] for r in splits.temporal_stratified(df, "file", "label", "t", "i").groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in range(3)) == sizes


def test_missing_times_come_first_and_order_holds(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else 100 - i) for i in range(40)], "i int, t int").withColumns({"f": F.lit("a"), "l": F.lit("b")})
    got = splits.temporal_stratified(df, "f", "l", "t", "i").groupBy("split").agg(F.min(F.coalesce("t", F.lit(-1))).alias("lo"), F.max(F.coalesce("t", F.lit(-1))).alias("hi")).orderBy("split").collect()
    assert got[0]["lo"] == -1
    assert got[0]["hi"] < got[1]["lo"] and got[1]["hi"] < got[2]["lo"]


def test_group_assignment():
    assert splits.assign_groups([("a", 70), ("b", 16), ("c", 14)]) == {"a": 0, "b": 2, "c": 1}
    assert splits.assign_groups([]) == {}


def test_bitmask_membership(spark):
    df = spark.createDataFrame([(0, 0b100), (1, 0), (2, 0), (0, 0b010)], "split int, also_in int")
    got = df.select(splits.member(0).alias("train"), splits.member(2).alias("test")).collect()
    assert [r["train"] for r in got] == [True, False, False, True]
    assert [r["test"] for r in got] == [True, False, True, False]


def test_thinning_keeps_benign_and_every_stream(spark):
    df = spark.createDataFrame([(i, "rare" if i < 2 else "big", 1) for i in range(1000)] + [(1000 + i, "benign", 0) for i in range(20)], "i int, label string, y int").withColumns({"file": F.lit("f"), "split": F.lit(0)})
    got = sampling.thin_attacks(df, ["file", "label"], "i", 1, 3.0).where("split = 0").groupBy("label").count().collect()
    by = {r["label"]: r["count"] for r in got}
    assert by["benign"] == 20 and by["rare"] == 1 and by["big"] == 60


@pytest.mark.parametrize(("sizes", "size", "wanted"), [((100, 900), 200, (20, 180)), ((1, 9999), 100, (1, 100)), ((3, 4), 100, (3, 4))])
def test_sample_follows_classes(spark, sizes, size, wanted):
    df = spark.range(sum(sizes)).select("id", (F.col("id") >= sizes[0]).cast("int").alias("y"))
    got = {r["y"]: r["count"] for r in sampling.stratified_sample(df, "y", "id", 3, size).groupBy("y").count().collect()}
    assert (got[0], got[1]) == wanted


def test_batches_are_full(spark):
    got = sampling.batches(spark.range(1000), "id", 1, 1, 64).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in got] == [64] * 15 + [40]


def test_profile_counts_what_is_missing(spark):
    df = spark.createDataFrame([(float("inf"), "a", 1), (float("nan"), None, 2), (None, "b", None)] + [(1.0, "c", 3)] * 97, "v double, s string, n int")
    got = {r["column"]: r for r in profile.column_profile(df, ["v", "s", "n"]).collect()}
    assert (got["v"]["n_inf"], got["v"]["n_nan"], got["v"]["n_null"], got["v"]["n_missing"], got["v"]["missing_ratio"], got["v"]["inf_ratio"]) == (1, 1, 1, 3, 0.03, 0.01)
    assert got["v"]["min"] == got["v"]["max"] == 1.0 and got["n"]["min"] is None and got["s"]["n_null"] == 1
    assert profile.column_profile(df.limit(0), ["v"]).first()["missing_ratio"] == 0


def test_label_decisions(spark):
    df = spark.createDataFrame([(" a\t",), ("b",), ("c",), ("d",), (None,)], "l string")
    table = labels.decision_table(spark, ["a"], ["b"], ["c"])
    assert one(labels.binary_counts(labels.decide(df, "l", table))) == {"n_benign": 1, "n_attack": 1, "n_dropped": 3}
    assert [r[0] for r in labels.unknown_labels(df, "l", table).collect()] == ["d"]
    assert df.where(labels.is_benign(F.lit(" Normal "))).count() == 5


def test_identifiers(spark):
    df = spark.range(4000).select("id", F.concat(F.lit("x"), "id").alias("s"), (F.col("id") * 1.5).alias("f"), (F.col("id") % 7).alias("k"))
    got = {r["column"]: r["verdict"] for r in profile.identifier_columns(df, ["id", "s", "f", "k"], "id").collect()}
    assert got == {"id": "error", "s": "error", "f": "note", "k": "ok"}
    assert profile.audit_failures(0, 0, 0, ["x"], []) and not profile.audit_failures(2, 1, 1, [], [])


def test_fit_literals(spark):
    rows = [(1.0, 5.0, None, 1.0), (float("nan"), 5.0, None, None), (3.0, 5.0, None, None), (5.0, 5.0, None, None), (7.0, 5.0, None, None)]
    got = {r["column"]: r for r in prep.fit(spark.createDataFrame(rows, "m double, c double, e double, h double"), ["m", "c", "e", "h"]).collect()}
    assert got["m"]["median"] == 4.0 and got["m"]["verdict"] == "kept"
    assert got["c"]["verdict"] == "zero_variance" and got["e"]["verdict"] == got["h"]["verdict"] == "high_missing" and got["e"]["median"] == 0
    filled = [1.0, 4.0, 3.0, 5.0, 7.0]
    mean = sum(filled) / 5
    assert math.isclose(got["m"]["mean"], mean) and math.isclose(got["m"]["std"], (sum((x - mean) ** 2 for x in filled) / 5) ** 0.5)


def test_infinity_becomes_the_median(spark):
    train = spark.createDataFrame([(float(x),) for x in range(1, 6)], "v double")
    fitted = prep.fit(train, ["v"]).collect()
    got = prep.standardised(spark.createDataFrame([(float("inf"),), (float("-inf"),), (None,), (3.0,)], "v double"), ["v"], fitted).collect()
    assert [r["v"] for r in got] == [0.0] * 4


def test_shards(spark, tmp_path):
    df = spark.range(1000).withColumn("split", (F.col("id") % 3).cast("int"))
    assert prep.write_shards(df, str(tmp_path / "s"), 100, 64) == 12
    assert prep.read_split(spark, str(tmp_path / "s"), 1, ["id"]).count() == 333
    with pytest.raises(ValueError, match="more than 2"):
        prep.write_shards(df, str(tmp_path / "t"), 100, 2)


def test_normal_quantiles():
    import numpy as np

    assert np.allclose(prep.normal_quantile(np.array([0.5, 0.975, 0.001])), [0, 1.959964, -3.090232], atol=1e-5)


def test_always_attack(spark):
    df = spark.createDataFrame([(int(i >= 10), 0.99) for i in range(1000)], "y int, p double")
    got = one(metrics.metrics(metrics.confusion(df, "y", "p")))
    assert (got["accuracy"], got["balanced_accuracy"], got["mcc"], got["specificity"], got["fpr"], got["always_attack_accuracy"]) == (0.99, 0.5, 0, 0, 1, 0.99)


def test_confusion_literal(spark):
    df = spark.createDataFrame(list(zip([0, 0, 0, 0, 1, 1, 1, 1], [0.1, 0.2, 0.9, 0.4, 0.8, 0.7, 0.3, 0.95], strict=True)), "y int, p double")
    assert one(metrics.confusion(df, "y", "p")) == {"tn": 3, "fp": 1, "fn": 1, "tp": 3}
    steps = metrics.score_steps(df, "y", "p")
    assert one(metrics.roc_auc(steps))["roc_auc"] == 0.75


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, p double")
    assert one(metrics.roc_auc(metrics.score_steps(df, "y", "p")))["roc_auc"] is None
    got = one(metrics.metrics(metrics.confusion(df, "y", "p")))
    assert got["specificity"] is None and got["fpr"] is None and got["recall"] == 1


def test_roc_drops_straight_points(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5)], "y int, p double")
    got = metrics.roc_curve(metrics.score_steps(df, "y", "p")).collect()
    assert [(r["fpr"], r["tpr"]) for r in got] == [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]
    last = metrics.pr_curve(metrics.score_steps(df, "y", "p")).where("threshold is null").first()
    assert (last["precision"], last["recall"]) == (1.0, 0.0)


def test_waterfall(spark):
    df = spark.createDataFrame([(f"f{i:02d}", float((-1) ** i * (12 - i))) for i in range(12)], "feature string, value double")
    got = ranking.waterfall(df, 8).orderBy("place").collect()
    assert len(got) == 8 and got[-1]["feature"] == "5 other features"
    assert math.isclose(sum(r["value"] for r in got), sum((-1) ** i * (12 - i) for i in range(12)))
    assert ranking.waterfall(df.limit(3), 8).count() == 3


def test_selections(spark):
    r = ranking.ranked(spark.createDataFrame([("a", 6.0), ("b", 3.0), ("c", 1.0)], "feature string, mean_abs double"))
    assert r.orderBy("rank").collect()[-1]["cumulative"] == 1.0
    assert ranking.selected(r, "cumulative", threshold=0.5).count() == 1
    assert ranking.selected(r, "cumulative", threshold=0.95).count() == 2
    assert ranking.selected(r, "first", 2).count() == 2
    with pytest.raises(ValueError, match="20"):
        ranking.selected(r, "top20", 2)


def test_history(spark):
    def problems(epochs, last):
        df = spark.createDataFrame(list(enumerate(epochs)), "position int, epoch long")
        return {(r["problem"], r["epoch"]) for r in monitor.history_problems(df, last).collect()}

    assert problems([1, 2, 3], 3) == set()
    assert problems([1, 3, 3, 2, 5], 4) == {("duplicate", 3), ("missing", 4), ("out_of_range", 5), ("out_of_order", 2)}


def test_stall(spark):
    log = lambda ends: spark.createDataFrame([(i, "train", e) for i, e in enumerate(ends)], "recorded int, phase string, end_epoch int")
    assert one(monitor.stall(log([5, 5, 5]), ["train"]))["stalled"] is True
    assert one(monitor.stall(log([5, 6, 6]), ["train"]))["stalled"] is False
    assert one(monitor.stall(log([5]), ["train"]))["stalled"] is False


def test_trials(spark):
    t = monitor.trial_table(spark, [{"number": 0, "value": 1.0, "state": "complete", "a": 1}, {"number": 1, "value": 2.0, "state": "complete", "b": 2}, {"number": 2, "value": 3.0, "state": "pruned", "a": 1}])
    assert t.columns == ["a", "b", "number", "state", "value"]
    assert one(monitor.trial_summary(t)) == {"n_complete": 2, "best_number": 1, "best_value": 2.0}
    assert monitor.memory_needs(1000, 10, 4)["peak"] == 36000


@pytest.mark.parametrize("kind", ["timestamp", "date", "string", "double", "long", "decimal(12,3)"])
def test_ranks_hold_for_every_kind_of_time(spark, kind):
    """Blocks change nothing about the ranks, nor do rows without a time or equal times."""
    from pyspark.sql import Window

    from flowprep.operators import ranks

    seconds = F.pmod(F.xxhash64("i"), F.lit(400_000))
    value = {"timestamp": F.timestamp_seconds(seconds), "date": F.date_add(F.lit("2020-01-01").cast("date"), (seconds % 300).cast("int")), "string": F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), "double": F.when(seconds % 50 == 0, float("nan")).otherwise((seconds - 200_000) / 7.0), "long": seconds * 3 - 500_000}
    time = value.get(kind, (seconds / 7).cast(kind))
    df = spark.range(3000).select((F.col("id") * 1000).alias("i"), (F.col("id") % 3).alias("s")).withColumn("t", F.when(F.col("i") % 7 != 0, time))
    order = [F.col("t").asc_nulls_first(), F.col("i")]
    got = ranks.with_ranks(df, ["s"], order, ranks.time_block(df, "t", "i"))
    plain = df.withColumn("want", F.row_number().over(Window.partitionBy("s").orderBy(*order)))
    assert got.join(plain.select("i", "want"), "i").where(F.col(ranks.RANK) != F.col("want")).count() == 0 and got.count() == 3000
    assert got.where(f"{ranks.SIZE} <> 1000").count() == 0


def test_the_row_before(spark):
    from pyspark.sql import Window

    from flowprep.operators import ranks

    df = spark.range(2000).select((F.col("id") * 333).alias("p"), F.when(F.col("id") % 5 != 0, F.col("id") % 11).alias("v"), F.when(F.col("id") % 3 != 0, F.col("id") % 3).alias("s"))
    for stream in ([], ["s"]):
        got = ranks.with_previous(df, stream, "p", "v", "before")
        want = df.withColumn("want", F.lag("v").over(Window.partitionBy(*stream).orderBy("p")))
        assert got.join(want.select("p", "want"), "p").where(~F.col("before").eqNullSafe(F.col("want"))).count() == 0 and got.count() == 2000


@pytest.mark.parametrize("seed", range(4))
def test_quantiles_are_exact(spark, seed, monkeypatch):
    """Against numpy, for values that crowd, spread over all sizes, repeat, or are few; with small buckets too."""
    import numpy as np

    from flowprep.operators import quantiles as Q

    if seed % 2:
        monkeypatch.setattr(Q, "BUCKETS", 4)
        monkeypatch.setattr(Q, "LISTED", 3)
    rng = np.random.default_rng(seed)
    n = 1500
    cols = {"even": rng.random(n), "wide": rng.choice([-1, 1], n) * 10.0 ** rng.uniform(-300, 300, n), "crowded": np.where(rng.random(n) < 0.99, rng.random(n) * 1e-9, 1e12), "few": rng.integers(0, 3, n).astype(float), "one": np.full(n, 2.5), "ends": rng.choice([-1.7e308, 5e-324, 0.0, -0.0, 1e-323, 1.7e308], n)}
    rows = list(zip(*(c.tolist() for c in cols.values()), [None] * n, strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*cols, "none"]))
    shares = [0.0, 0.1, 0.25, 0.5, 0.501, 0.95, 1.0]
    got = Q.quantiles(df, {c: F.col(c) for c in [*cols, "none"]}, shares)
    assert got["none"] == [None] * len(shares)
    for c, v in cols.items():
        v = np.sort(v)
        want = []
        for p in shares:
            a, b, part = Q.ranks_of(p, n)
            want.append(v[a] + (v[b] - v[a]) * part if part else v[a])
        assert got[c] == want, c


def test_shards_are_what_is_said(spark, tmp_path):
    """As many files as are returned, whatever the number of tasks, and reading back checks rows and labels."""
    df = spark.range(0, 5000, numPartitions=8).select("id", (F.col("id") % 3).cast("int").alias("split"), (F.col("id") % 2).cast("int").alias("y"))
    path = str(tmp_path / "shards")
    n = prep.write_shards(df, path, 400, 5)
    files = list((tmp_path / "shards").rglob("*.parquet"))
    assert n == len(files) == 15 and max(len([f for f in files if f"split={s}" in str(f)]) for s in range(3)) == 5
    assert prep.read_split(spark, path, 1, ["id"], rows=1667, labels=("y", {0: 833, 1: 834})).count() == 1667
    odd = df.withColumn("split", F.when(F.col("id") % 3 != 0, F.col("split")))
    assert prep.write_shards(odd, str(tmp_path / "odd"), 1000, 5) == 6 and spark.read.parquet(str(tmp_path / "odd")).where("split is null").count() == 1667
    assert prep.write_shards(df.limit(0), str(tmp_path / "none"), 1000, 5) == 0
    with pytest.raises(ValueError, match="rows"):
        prep.read_split(spark, path, 1, ["id"], rows=1)
    with pytest.raises(ValueError, match="labels"):
        prep.read_split(spark, path, 1, ["id"], labels=("y", {0: 1667}))


def test_score_steps_across_blocks(spark):
    """Many distinct scores, in and out of [0, 1]: as the plain definition."""
    import numpy as np

    rng = np.random.default_rng(2)
    scores = np.concatenate([np.round(rng.random(800), 4), rng.normal(size=300) * 50])
    y = rng.integers(0, 2, len(scores))
    steps = metrics.score_steps(spark.createDataFrame(list(zip(scores.tolist(), y.tolist(), strict=True)), "s double, y int"), "y", "s")
    got = {r["score"]: r for r in steps.collect()}
    distinct = sorted(set(scores.tolist()), reverse=True)
    for i, v in enumerate(distinct):
        r = got[v]
        assert (r["tp"], r["fp"]) == (int(((scores >= v) & (y == 1)).sum()), int(((scores >= v) & (y == 0)).sum()))
        if i + 1 < len(distinct):
            at = scores == distinct[i + 1]
            assert (r["next_pos"], r["next_neg"]) == (int((at & (y == 1)).sum()), int((at & (y == 0)).sum()))
        else:
            assert r["next_pos"] is None
    assert len(got) == len(distinct)
