import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowprep.ml import explain, net, search, trees
from flowprep.plans import config, prepare
from flowprep.sources import datasets
from flowprep.streaming import flows


@pytest.fixture(scope="module")
def capture(spark, tmp_path_factory):
    """Two days of flows whose shards spell their headers differently; 120 rows are copies."""
    root = tmp_path_factory.mktemp("data") / "capture"
    base = spark.range(3000).select("id", (F.hash("id") % 1_000_000).alias("d"), F.timestamp_seconds(1_543_655_000 + F.col("id") * 7 % 5000).cast("string").alias("t"), F.when(F.col("id") % 10 == 0, "BENIGN").otherwise(" DrDoS_DNS").alias("l"))
    a = base.union(base.where("id < 120").select(F.col("id") + 10_000, "d", "t", "l")).orderBy("id")
    a.select(F.concat(F.lit("a"), "id").alias("Flow ID"), F.col("d").alias(" Flow Duration"), F.col("t").alias(" Timestamp"), F.col("l").alias(" Label")).coalesce(1).write.parquet(str(root / "01-12"))
    b = base.select(F.concat(F.lit("b"), "id").alias("FlowID"), (F.col("d") + 2_000_000).alias("Flow Duration"), F.col("t").alias("Timestamp"), F.col("l").alias("Label"))
    b.coalesce(1).write.parquet(str(root / "03-11"))
    return root


ROLES = prepare.Roles(metadata=["flow_id"], attack=["DrDoS_DNS"])


def test_reading_shards(spark, capture):
    df = datasets.read_dataset(spark, str(capture))
    assert df.columns == ["flow_id", "flow_duration", "timestamp", "label", "file", "position"]
    assert df.count() == 6120 and df.select("file").distinct().count() == 2
    assert datasets.file_summary(spark, str(capture)).agg(F.sum("n_rows")).first()[0] == 6120
    with pytest.raises(FileNotFoundError, match="no \\*.csv"):
        datasets.discover(spark, str(capture), "*.csv")
    assert datasets.resolve_root(spark, str(capture / "moved" / "versions")).removeprefix("file:") == str(capture)


def test_schema_difference_is_an_error(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "d" / "a"))
    spark.range(3).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "d" / "b"))
    with pytest.raises(ValueError, match="besides"):
        datasets.read_dataset(spark, str(tmp_path / "d"))


def test_preparation(spark, capture):
    df = datasets.read_dataset(spark, str(capture))
    assert prepare.audit(df, ROLES) == []
    got = prepare.prepare(df, ROLES, per_benign=3.0)
    assert got.features == ["flow_duration"] and got.leaked.first()["cross_rows"] == 0
    assert all(s != "FAIL" for _, s, _ in prepare.validate(got, 10, ["flow_duration"]))
    test = [r for r in got.summary.collect() if r["split"] == 2][0]
    assert test["n_attack"] > 3 * test["n_benign"]  # the test split keeps its own proportions
    train = got.rows.where("split = 0").agg(F.avg("flow_duration"), F.stddev_pop("flow_duration")).first()
    assert abs(train[0]) < 1e-6 and abs(train[1] - 1) < 1e-6
    with pytest.raises(ValueError, match="without a decision"):
        prepare.prepare(df, prepare.Roles(metadata=["flow_id"], attack=["Syn"]))


def test_duplicates_go_before_the_cut(spark, capture):
    df = datasets.read_dataset(spark, str(capture))
    assert prepare.split_rows(df, ROLES, None).count() == 6000


def test_reports(tmp_path):
    datasets.write_rows(str(tmp_path / "r.csv"), [{"a": 1, "b": "x"}])
    assert datasets.read_rows(str(tmp_path / "r.csv")) == [{"a": "1", "b": "x"}]
    assert datasets.read_rows(str(tmp_path / "none.csv")) == []
    datasets.write_json(str(tmp_path / "r.json"), {"k": 1})
    assert datasets.read_json(str(tmp_path / "r.json")) == {"k": 1}


def test_store(spark, tmp_path):
    store = datasets.Store(spark, f"file://{tmp_path}/store")
    (tmp_path / "x").write_text("hello")
    assert not store.get("a/b", str(tmp_path / "y"))
    store.put("a/b", str(tmp_path / "x"))
    assert store.exists("a/b") and store.get("a/b", str(tmp_path / "y")) and (tmp_path / "y").read_text() == "hello"
    with pytest.raises(ValueError, match="leaves"):
        store.exists("../x")


def test_variants():
    base = {"shap": {"top_k": 40, "seed": 1}, "session": {"minutes": 300}, "training": {"epochs": 100}}
    assert config.variant(base, "feat20")["shap"] == {"top_k": 20, "seed": 1, "feature_set": "top20"}
    assert config.merged({"a": [1, 2]}, {"a": [3]}) == {"a": [3]} and base["shap"]["top_k"] == 40
    assert config.fingerprint(base) == config.fingerprint({**base, "session": {"minutes": 1}}) != config.fingerprint({**base, "shap": {}})
    with pytest.raises(ValueError, match="fixed"):
        config.variant({"training": {"epochs": 3}}, "main")
    assert set(config.run_record(base)) == {"config", "constraints", "versions"}
    assert prepare.next_phase("prepare") == "shap" and prepare.next_phase("done") == "done"


def test_streams(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(seconds=20 * i), "a" if i % 2 else "b") for i in range(60)] + [(99, t0 + datetime.timedelta(hours=3), "a")]
    df = spark.createDataFrame(rows, "id int, ts timestamp, k string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = flows.read_stream(spark, str(tmp_path / "in"), df.schema)
    flows.run_available(flows.minute_counts(stream, "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 20 and got.agg(F.sum("n")).first()[0] == 60
    flows.run_available(flows.first_within(stream, "ts", ["k"]), str(tmp_path / "first"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "first")).count() == 2
    flows.run_available(flows.session_counts(stream, "ts", ["k"]), str(tmp_path / "sessions"), str(tmp_path / "cp3"))
    assert spark.read.parquet(str(tmp_path / "sessions")).count() == 2
    assert flows.label_counts(df, "k").count() == 2
    for _ in range(2):
        flows.run_available(flows.first_within(stream, "ts", ["k"]), str(tmp_path / "again"), str(tmp_path / "cp4"), fingerprint="one")
    assert spark.read.parquet(str(tmp_path / "again")).count() == 2
    with pytest.raises(flows.Changed, match="one"):
        flows.run_available(flows.first_within(stream, "ts", ["k"]), str(tmp_path / "again"), str(tmp_path / "cp4"), fingerprint="two")


@pytest.mark.parametrize(("k", "n"), [(40, 126721), (20, 83201)])
def test_parameter_counts(k, n):
    assert net.Net(net.Shape(k)).n_parameters() == n


@pytest.mark.parametrize("shape", [net.Shape(9, cnn_filters_1=3, cnn_filters_2=2, activation="tanh"), net.Shape(9, conv_mode="conv2d_reshape", activation="tanh"), net.Shape(1, activation="elu"), net.Shape(5, architecture="cnn_only", cnn_kernel_size=5, activation="tanh"), net.Shape(5, architecture="mlp_only", activation="tanh")])
def test_gradients(shape):
    n = net.Net(shape, 1)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(6, shape.n_features)), np.array([0, 1, 0, 1, 1, 0.0])
    z, tapes = n.forward(x)
    base, slope = net.loss_and_slope(z, y)
    grads, below = n.backward(tapes, slope)
    for k, w in n.weights.items():
        i, old = (0,) * w.ndim, w[(0,) * w.ndim]
        w[i] = old + 1e-6
        up = net.loss_and_slope(n.forward(x)[0], y)[0]
        w[i] = old
        assert abs((up - base) / 1e-6 - grads[k][i]) < 1e-4
    x[0, 0] += 1e-6
    assert abs((net.loss_and_slope(n.forward(x)[0], y)[0] - base) / 1e-6 - below[0, 0]) < 1e-4


def test_interrupted_training_is_the_same():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    y = (x[:, 0] > 0).astype(float)
    whole, parts = (net.Net(net.Shape(6, dropout=0.3), 2) for _ in range(2))
    losses = [loss for _, loss in net.epochs(whole, net.Adam(0.01), x, y, 1, 6, 64)]
    opt = net.Adam(0.01)
    for a, b in ((1, 2), (3, 6)):
        list(net.epochs(parts, opt, x, y, a, b, 64))
    assert losses[-1] < losses[0] and all(np.allclose(whole.weights[k], parts.weights[k], atol=1e-12) for k in whole.weights)


def test_small_grids_lose_pools():
    shape = net.Shape(1)
    net.Net(shape)
    assert len(shape.notes) == 2
    with pytest.raises(ValueError, match="none of"):
        net.Shape(3, architecture="x")


def test_attributions_add_up_and_find_the_signal(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 6))
    y = (2.5 * x[:, 0] - 1.8 * x[:, 1] + 1.1 * x[:, 2] + rng.normal(size=1500) > 0).astype(int)
    df = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i int, features array<double>, label int")
    ensemble = trees.Ensemble.of(trees.fit_surrogate(df, trees=10, depth=4), spark)
    values = ensemble.attributions(x[:200])
    assert np.allclose(values.sum(axis=1) + ensemble.expected(), ensemble.margin(x[:200]), atol=1e-9)
    assert np.argsort(-np.abs(values).mean(axis=0))[:3].tolist() == [0, 1, 2]
    score = lambda m: 1 / (1 + np.exp(-2 * ensemble.margin(m)))
    got = {r["feature"]: r["mean_drop"] for r in explain.permutation_importance(df, "i", "features", "label", 6, score, [0, 5], 2).collect()}
    assert got[0] > 0.1 > got[5]


def test_gradients_attribute_the_signal():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 5))
    y = (x[:, 2] > 0).astype(float)
    n = net.Net(net.Shape(5, dropout=0.0), 1)
    list(net.epochs(n, net.Adam(0.005), x, y, 1, 8, 64))
    v = net.expected_gradients(n, x[:50], x, 16)
    assert np.abs(v).mean(axis=0).argmax() == 2


def test_every_row_has_one_score(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "k int, x array<double>")
    assert explain.with_scores(df, "k", "x", 2, lambda m: m[:, 0]).count() == 5
    with pytest.raises(Exception, match="results for"):
        explain.with_scores(df, "k", "x", 2, lambda m: m[:0, 0]).count()


def test_search_resumes():
    space = {"a": {"type": "float", "low": 0.0, "high": 1.0}, "b": {"type": "categorical", "choices": [1, 2, 3]}, "c": {"type": "int", "low": 1, "high": 9}}
    objective = lambda p, report: -((p["a"] - 0.3) ** 2) + (p["b"] == 2)
    whole = search.search(space, objective, 20)
    again = search.search(space, objective, 20, whole[:7])
    assert len(whole) == 20 and [t["params"] for t in whole] == [t["params"] for t in again] and max(t["value"] for t in whole) > 0.9
    with pytest.raises(ValueError, match="fixed"):
        search.check_space({"learning_rate": {"type": "float", "low": 0, "high": 1}})


def test_search_prunes_below_the_median():
    def objective(p, report):
        for step in range(1, 6):
            report(step, p["a"])
        return p["a"]

    got = search.search({"a": {"type": "float", "low": 0.0, "high": 1.0}}, objective, 15)
    assert {t["state"] for t in got} == {"complete", "pruned"}


def test_permutation_importance_of_every_feature(spark, sf):
    """All components are scored and ranked; each repeat deals a feature's values anew among all rows."""
    from flowprep.catalogue import QUERIES

    got = QUERIES["permutation_importance"](spark, sf).collect()
    assert sorted(r["feature"] for r in got) == list(range(64))
    assert [r["mean_drop"] for r in got] == sorted((r["mean_drop"] for r in got), reverse=True)
    df = spark.createDataFrame([(i, [float(i % 2), float(i)], i % 2) for i in range(200)], "i long, x array<double>, y int")
    by = {r["feature"]: r for r in explain.permutation_importance(df, "i", "x", "y", 2, lambda m: m[:, 0], [0, 1], 5).collect()}
    assert 0.3 < by[0]["mean_drop"] < 0.7 and by[0]["std_drop"] > 0 and by[1]["mean_drop"] == 0 == by[1]["std_drop"]
