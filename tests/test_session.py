import numpy as np

from flowprep.operators import metrics
from flowprep.plans import session


def test_budget_stops_before_the_deadline():
    now = [0.0]
    b = session.Budget(300, 25, clock=lambda: now[0])
    assert b.fits(275) and not b.fits(276)
    now[0] = 200
    assert b.left() == 75 and not b.fits(80)


def test_trials_are_read_back(tmp_path):
    log = session.TrialLog(str(tmp_path / "t.db"))
    for i in (1, 0):
        log.add({"number": i, "value": i / 2})
    log.add({"number": 1, "value": 9})
    log.snapshot(str(tmp_path / "copy.db"))
    assert session.TrialLog(str(tmp_path / "copy.db")).read() == log.read() == [{"number": 0, "value": 0.0}, {"number": 1, "value": 9}]


def test_latest_run():
    assert session.latest_run(["20240101-a", "20240301-b", "x"], "2024") == "20240301-b" and session.latest_run([]) is None


def test_costs_and_latency(spark):
    costs = []
    assert session.measured("sum", lambda: 3, costs) == 3 and costs[0]["stage"] == "sum" and costs[0]["rise_mb"] >= 0
    times = session.batch_times(lambda x: x.sum(), np.ones((10, 2)), 2, 20)
    got = metrics.latency(spark.createDataFrame([(t,) for t in times], "ms double"), "ms", 10).first()
    assert len(times) == 20 and got["p95_ms"] >= got["p50_ms"]
