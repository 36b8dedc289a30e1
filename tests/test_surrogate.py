"""The leaf-wise surrogate against a plain fit of the same histograms, one row of code after the other."""

import numpy as np
import pytest

from flowprep.ml import explain, leafwise


def plain(x, y, edges, trees, leaves, rate, least):
    """Margins of boosted trees that split their best leaf first, by trying each threshold of each leaf."""
    score = np.full(len(y), np.log(y.sum() / (len(y) - y.sum())))
    shapes = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = np.round((p - y) * 2**24) / 2**24, np.round(p * (1 - p) * 2**24) / 2**24

        def offer(rows, g=g, h=h):
            top = (0.0, None, None)
            for f in range(x.shape[1]):
                for edge in edges[f]:
                    goes = x[rows, f] <= edge
                    a, b = rows[goes], rows[~goes]
                    if len(a) < least or len(b) < least or h[a].sum() < 1e-3 or h[b].sum() < 1e-3:
                        continue
                    gain = g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - g[rows].sum() ** 2 / h[rows].sum()
                    if gain > top[0]:
                        top = (gain, a, b)
            return top

        open_ = [(np.arange(len(y)), offer(np.arange(len(y))))]
        while len(open_) < leaves:
            at = max(range(len(open_)), key=lambda i: open_[i][1][0])
            if open_[at][1][0] <= 0:
                break
            _, a, b = open_.pop(at)[1]
            open_ += [(a, offer(a)), (b, offer(b))]
        for rows, _ in open_:
            score[rows] -= rate * g[rows].sum() / h[rows].sum()
        shapes.append(len(open_))
    return score, shapes


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(600, 4)), 2)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.5) ^ (rng.random(600) < 0.1)).astype(float)
    df = spark.createDataFrame([(i, r.tolist(), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double").repartition(5, "id")
    return df, x, y


@pytest.mark.parametrize("small", [100, 8192])
def test_as_a_plain_fit(signal, small):
    """Also when large nodes go by summed histograms and small ones in one group."""
    df, x, y = signal
    edges = leafwise.feature_edges(df, "x", 4, 20)
    want, shapes = plain(x, y, edges, 4, 9, 0.3, 15)
    model = leafwise.fit_leafwise(df, "x", "y", 4, trees=4, leaves=9, rate=0.3, least=15, bins=20, small=small, keep=2)
    assert [int((t["feature"] < 0).sum()) for t in model.trees[1:]] == shapes and max(shapes) == 9
    assert np.allclose(model.margin(x), want, atol=1e-9)


def test_partitions_change_nothing_and_attributions_add_up(signal):
    df, x, y = signal
    a = leafwise.fit_leafwise(df, "x", "y", 4, trees=6, leaves=12, least=10, small=64)
    b = leafwise.fit_leafwise(df.repartition(2), "x", "y", 4, trees=6, leaves=12, least=10)
    assert np.array_equal(a.margin(x), b.margin(x))
    values = explain.with_attributions(df, "id", "x", 4, a.attributions).groupBy("id").agg({"value": "sum"}).orderBy("id").collect()
    assert np.allclose([r[1] + a.expected() for r in values], a.margin(x))
    size = np.abs(a.attributions(x)).mean(axis=0)
    assert min(size[0], size[2]) > 2 * max(size[1], size[3])


def test_odd_rows(spark):
    rows = [([None, 1.0], 0), ([float("nan"), 1.0], 1), ([float("inf"), 1.0], 1), ([0.0, 1.0], 0), ([-1.0, 1.0], None)] * 30
    df = spark.createDataFrame(rows, "x array<double>, y int")
    model = leafwise.fit_leafwise(df, "x", "y", 2, trees=5, leaves=4, least=5)
    x = np.array([[np.nan, 1], [0, 1], [np.inf, 1], [-np.inf, 1]])
    m = model.margin(x)
    assert np.isfinite(m).all() and m[0] == m[2] and m[1] == m[3] and m[1] < m[0]
    assert not (np.concatenate([t["feature"] for t in model.trees]) == 1).any()


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([([1.0], 1)] * 9, "x array<double>, y int")
    assert leafwise.fit_leafwise(df.limit(0), "x", "y", 1).margin(np.zeros((2, 1))).tolist() == [0, 0]
    assert (leafwise.fit_leafwise(df, "x", "y", 1).margin(np.zeros((2, 1))) > 30).all()
    alike = spark.createDataFrame([([1.0], i % 2) for i in range(200)], "x array<double>, y int")
    assert np.allclose(leafwise.fit_leafwise(alike, "x", "y", 1).margin(np.ones((1, 1))), 0)
    with pytest.raises(ValueError, match="bins"):
        leafwise.fit_leafwise(df, "x", "y", 1, bins=300)
