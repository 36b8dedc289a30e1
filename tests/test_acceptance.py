"""Acceptance of a run's folder, resuming, phases."""

import json

import numpy as np
import pytest

from flowprep.ml import checkpoints
from flowprep.ml import net as N
from flowprep.operators import monitor
from flowprep.plans import acceptance, prepare
from flowprep.plans.session import Budget
from flowprep.sources.datasets import write_rows


def whole_run(folder):
    reports = {
        "history": [{"epoch": e} for e in range(1, 101)], "state": {"total_epochs": 100, "feature_schema_hash": "f"}, "config": {"experiment": {"training": {"early_stopping": False, "epochs": 100, "batch_size": 4096, "learning_rate": 0.001}}}, "leakage": {"cross_split_duplicate_rows": 0},
        "fitting": {"fitted_on": "train_only"}, "features": {"feature_schema_hash": "f"}, "search": {"n_trials_completed": 20, "n_trials_requested": 20, "params": {"dropout": 0.1}}, "metrics": {m: 0.5 for m in acceptance.METRICS} | {"checkpoint": "model_epoch_100.pt"}, "explained": {"fed_back_into_selection": False},
    }
    for name, value in reports.items():
        put(folder, name, value)
    (folder / "checkpoints/model_epoch_100.pt").write_bytes(b"")
    write_rows(str(folder / acceptance.COMPARISON), [{"metric": "f1", "paper_headline": 1, "paper_body": 2}])
    return reports


def put(folder, name, value):
    path = folder / acceptance.REPORTS[name]
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value))


def statuses(spark, folder):
    return {r["check"]: r["status"] for r in acceptance.checked(spark, str(folder)).collect()}


def test_a_whole_run_is_accepted(spark, tmp_path):
    whole_run(tmp_path)
    checks = acceptance.checked(spark, str(tmp_path))
    assert set(statuses(spark, tmp_path).values()) == {"PASS"} and checks.count() == 11
    assert monitor.accepted(checks).first()["verdict"] == "PASS"


def test_an_empty_run_is_skipped(spark, tmp_path):
    assert set(statuses(spark, tmp_path).values()) == {"SKIP"}


@pytest.mark.parametrize(
    ("name", "change", "check"),
    [
        ("history", lambda h: h[:50] + h[51:], "the history has every epoch once"), ("metrics", lambda m: m | {"checkpoint": "model_epoch_7.pt"}, "the last epoch's model is final"), ("config", lambda c: {"experiment": {"training": {"early_stopping": True}}}, "training didn't stop early"),
        ("config", lambda c: {"experiment": {"training": c["experiment"]["training"] | {"batch_size": 1}}}, "fixed parameters held"), ("leakage", lambda a: {}, "no duplicates between splits"), ("fitting", lambda f: {"fitted_on": "all"}, "fitted on training rows only"),
        ("features", lambda f: {"feature_schema_hash": "g"}, "one feature set"), ("search", lambda s: s | {"params": {"batch_size": 8}}, "the search is complete"), ("search", lambda s: s | {"n_trials_completed": 3}, "the search is complete"), ("metrics", lambda m: m | {"mcc": None}, "all metrics are there"),
        ("explained", lambda e: {}, "attributions weren't fed back"), ("history", lambda h: "nonsense", "the history has every epoch once"),
    ],
)
def test_a_fault_fails_its_check(spark, tmp_path, name, change, check):
    reports = whole_run(tmp_path)
    put(tmp_path, name, change(reports[name]))
    got = statuses(spark, tmp_path)
    assert got[check] == "FAIL"


def test_a_deliberate_leak_passes(spark, tmp_path):
    whole_run(tmp_path)
    put(tmp_path, "leakage", {"upsample_before_split": True, "cross_split_duplicate_rows": 9})
    assert statuses(spark, tmp_path)["no duplicates between splits"] == "PASS"


def made():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    shape = N.Shape(8, cnn_filters_1=2, cnn_filters_2=2, cnn_dense=4, mlp_units_1=8, mlp_units_2=4, fusion_dim=4, dropout=0.1)
    return N.Net(shape, 1), N.Adam(0.01), x, (x[:, 0] > 0).astype(float)


def test_a_run_that_is_cut_off_goes_on(tmp_path):
    net, opt, x, y = made()
    whole = checkpoints.train(checkpoints.Checkpoint(str(tmp_path / "a"), {"config": "1"}), net, opt, x, y, 6, 64, evaluate=lambda n: checkpoints.evaluate_split(n, x, y))
    other, opt2, *_ = made()
    checkpoints.train(checkpoints.Checkpoint(str(tmp_path / "b"), {"config": "1"}), other, opt2, x, y, 2, 64)
    third, opt3, *_ = made()
    history = checkpoints.train(checkpoints.Checkpoint(str(tmp_path / "b"), {"config": "1"}), third, opt3, x, y, 6, 64)
    assert [r["epoch"] for r in history] == list(range(1, 7)) and [r["loss"] for r in history] == [r["loss"] for r in whole]
    assert all(np.array_equal(net.weights[k], third.weights[k]) for k in net.weights)
    with pytest.raises(checkpoints.Changed, match="config"):
        checkpoints.train(checkpoints.Checkpoint(str(tmp_path / "b"), {"config": "2"}), third, opt3, x, y, 8, 64)


def test_a_budget_cuts_between_epochs(tmp_path):
    net, opt, x, y = made()
    ticks = iter(range(0, 10_000, 3))
    budget = Budget(20, 2, clock=lambda: next(ticks))
    point = checkpoints.Checkpoint(str(tmp_path), {})
    history = checkpoints.train(point, net, opt, x, y, 50, 64, budget=budget)
    assert 0 < len(history) < 50 and point.state()["status"] == "cut" and point.state()["epoch"] == len(history)


def test_split_evaluation():
    net, _, x, y = made()
    got = checkpoints.evaluate_split(net, x, y, 7)
    z = net.forward(x)[0]
    said = z >= 0
    assert np.isclose(got["accuracy"], (said == (y == 1)).mean()) and np.isclose(got["loss"], (np.log1p(np.exp(-z * (2 * y - 1)))).mean())
    scores = sorted(set(z.tolist()), reverse=True)
    ap, before = 0.0, 0
    for s in scores:
        tp = int(((z >= s) & (y == 1)).sum())
        ap += (tp - before) * tp / int((z >= s).sum())
        before = tp
    assert np.isclose(got["pr_auc"], ap / y.sum()) and np.isnan(checkpoints.evaluate_split(net, x, np.ones(len(x)))["pr_auc"])


def test_phases_run_in_order():
    seen, told = [], []
    handlers = {p: (lambda p=p: seen.append(p)) for p in prepare.PHASES[:4]}
    assert prepare.run_phases(handlers, told.append) == "evaluate" and seen == list(prepare.PHASES[:4]) and told == list(prepare.PHASES[1:5])
    assert prepare.run_phases(handlers | {"bo": lambda: False}, told.append, "shap") == "bo"
    with pytest.raises(KeyError):
        prepare.run_phases({}, told.append)
