"""Boosted trees that grow best leaf first, over histograms of gradients.

Rows become codes (a byte a feature: the number of the quantile that a value falls under) in a table of blocks, written once. To
learn the best splits of some nodes, each task sums up gradients, hessians and counts of its rows by node, feature and code; the
sums are shuffled by node and feature and give one candidate each. A node of few rows sends its rows instead, as codes, and one
group grows all of its subtree. So a pass over the table teaches a level of large nodes and everything below small ones, and a
tree of any shape takes about log2(rows / small) + 1 passes. The driver holds splits: at most `leaves` times the features.

Which leaf comes next depends on gains alone, so a tree is drawn up by the gains that are known and asks for those that it lacks,
until it lacks none. Gradients are whole multiples of 2^-24: sums don't depend on their order, so the partitioning changes nothing.

Cases: rows without a label (null, NaN) are left out; missing values, NaN and infinity above all edges go right at every split;
features without a finite value are never split on; no rows give a margin of 0; one class gives a constant.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import materialised, ship
from ..functions.columns import finite
from ..operators.quantiles import quantiles
from .explain import matrix
from .trees import Ensemble

#: Codes are bytes.
CODES = 256
#: Gradients are multiples of this, so that their sums are exact up to 2^29 rows.
UNIT = 2.0**-24
#: The least hessian of a leaf.
LEAST_HESSIAN = 1e-3


class Sums(NamedTuple):
    g: float
    h: float
    n: float

    @property
    def value(self) -> float:
        return -self.g / self.h if self.h > 0 else 0.0


class Split(NamedTuple):
    """The best split of a node: rows whose code is at most `code` go left. The feature is -1 if nothing is gained."""

    gain: float
    feature: int
    code: int
    left: Sums
    right: Sums

    @property
    def whole(self) -> Sums:
        return Sums(*(a + b for a, b in zip(self.left, self.right, strict=True)))


def gradients(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-score))
    return np.rint((p - y) / UNIT) * UNIT, np.rint(p * (1 - p) / UNIT) * UNIT


def histogram(codes: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(3, features, codes): sums of gradients, of hessians, and counts."""
    width = codes.shape[1]
    at = (codes + np.arange(width) * CODES).ravel()
    return np.stack([np.bincount(at, w, width * CODES).reshape(width, CODES) for w in (np.repeat(g, width), np.repeat(h, width), None)])


def best(sums: np.ndarray, least: int, first: int = 0) -> Split:
    """The best split of a histogram whose features are numbered from `first`; ties go to the smaller feature, then code."""
    left = sums.cumsum(axis=2)
    whole = left[:, :, -1:]
    right = whole - left
    fits = (left[2] >= least) & (right[2] >= least) & (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - whole[0] ** 2 / whole[1], 0.0)
    f, c = np.unravel_index(np.argmax(gain), gain.shape)
    if gain[f, c] <= 0:
        return Split(0.0, -1, 0, Sums(*map(float, whole[:, 0, 0])), Sums(0.0, 0.0, 0.0))
    return Split(float(gain[f, c]), first + int(f), int(c), Sums(*map(float, left[:, f, c])), Sums(*map(float, right[:, f, c])))


def children(path: str, split: Split) -> list[tuple[str, Sums]]:
    return [(path + "0", split.left), (path + "1", split.right)]


def drawn(known: dict[str, Split], leaves: int, least: int) -> tuple[dict[str, Split], dict[str, int]]:
    """The tree that the known splits give, best leaf first; and the nodes, with their rows, that it lacks."""
    taken: dict[str, Split] = {}
    lacks: dict[str, int] = {}
    heap = [(-known[""].gain, "")]
    while heap and len(taken) < leaves - 1:
        gain, path = heapq.heappop(heap)
        if gain >= 0:
            break
        taken[path] = known[path]
        for child, sums in children(path, known[path]):
            if child in known:
                heapq.heappush(heap, (-known[child].gain, child))
            elif sums.n >= 2 * least:
                lacks[child] = int(sums.n)
    return taken, lacks


def grown(codes: np.ndarray, g: np.ndarray, h: np.ndarray, leaves: int, least: int) -> dict[str, Split]:
    """All splits that a tree of so many leaves can take below a node of few rows, by paths from it."""
    known = {"": best(histogram(codes, g, h), least)}
    rows = {"": np.arange(len(codes))}
    heap = [(-known[""].gain, "")]
    for _ in range(leaves - 1):
        if not heap or heap[0][0] >= 0:
            break
        path = heapq.heappop(heap)[1]
        mine, split = rows.pop(path), known[path]
        goes = codes[mine, split.feature] <= split.code
        for (child, sums), of in zip(children(path, split), (mine[goes], mine[~goes]), strict=True):
            if sums.n >= 2 * least:
                known[child] = best(histogram(codes[of], g[of], h[of]), least)
                rows[child] = of
                heapq.heappush(heap, (-known[child].gain, child))
    return known


def dealt(codes: np.ndarray, splits: dict[str, Split], at: Sequence[str] | None = None) -> Iterator[tuple[str, np.ndarray]]:
    """(path, rows) of the tree's leaves, or of the nodes asked for."""
    asked = None if at is None else set(at)
    todo = [("", np.arange(len(codes)))]
    while todo:
        path, rows = todo.pop()
        if asked is not None and path in asked or asked is None and path not in splits:
            yield path, rows
        elif path in splits and len(rows):
            goes = codes[rows, splits[path].feature] <= splits[path].code
            todo += [(path + "0", rows[goes]), (path + "1", rows[~goes])]


class Tree(NamedTuple):
    splits: dict[str, Split]
    values: dict[str, float]

    @staticmethod
    def of(splits: dict[str, Split], root: Sums) -> Tree:
        ends = {child: sums.value for path, s in splits.items() for child, sums in children(path, s) if child not in splits}
        return Tree(splits, ends or {"": root.value})

    def add_to(self, score: np.ndarray, codes: np.ndarray, rate: float) -> None:
        for path, rows in dealt(codes, self.splits):
            score[rows] += rate * self.values[path]

    def arrays(self, edges: list[np.ndarray], rows: float) -> dict[str, np.ndarray]:
        """The tree as an Ensemble holds it."""
        paths = sorted([*self.splits, *self.values], key=lambda p: (len(p), p))
        number = {p: i for i, p in enumerate(paths)}
        cover = {"": rows} | {c: s.n for p, split in self.splits.items() for c, s in children(p, split)}
        inner = [self.splits.get(p) for p in paths]
        return {
            "feature": np.array([s.feature if s else -1 for s in inner]),
            "threshold": np.array([edges[s.feature][s.code] if s else 0.0 for s in inner]),
            "left": np.array([number.get(p + "0", -1) for p in paths]),
            "right": np.array([number.get(p + "1", -1) for p in paths]),
            "value": np.array([self.values.get(p, 0.0) for p in paths]),
            "cover": np.array([float(cover[p]) for p in paths]),
        }


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bytes: a value's code is the number of edges below it, so it is at most c where the value is at most edge c."""
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def feature_edges(df: DataFrame, features: str, width: int, bins: int = 255) -> list[np.ndarray]:
    """For each feature its distinct quantiles without the largest: exact, and the same for any partitioning."""
    flat = df.select(*[F.col(features)[i].cast("double").alias(f"x{i}") for i in range(width)])
    grids = quantiles(flat, {f"x{i}": finite(f"x{i}") for i in range(width)}, [i / bins for i in range(bins + 1)])
    found = [np.unique(np.array([v for v in grids.get(f"x{i}") or [] if v is not None], float)) for i in range(width)]
    return [e[:-1] if len(e) > 1 else e for e in found]


BLOCK = pa.schema([("codes", pa.binary()), ("y", pa.binary()), ("score", pa.binary())])
BLOCK_DDL = "codes binary, y binary, score binary"
SENT_DDL = "node int, feature int, part long, codes binary, sums binary"
SPLIT_DDL = "node int, path string, gain double, feature int, code int, gl double, hl double, nl double, gr double, hr double, nr double"


def blocks(df: DataFrame, features: str, label: str, edges: list[np.ndarray], base: float) -> DataFrame:
    """A row for each batch of rows: their codes, labels and first scores as bytes."""
    src = df.select(F.transform(features, lambda v: F.coalesce(v.cast("double"), F.lit(float("nan")))).alias("x"), F.col(label).cast("double").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, y = coded(matrix(b.column(0), len(edges)), edges), b.column(1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pylist([{"codes": codes.tobytes(), "y": y.tobytes(), "score": np.full(len(y), base).tobytes()}], BLOCK)

    return materialised(src.mapInArrow(run, BLOCK_DDL), "surrogate")


def opened(batches: Iterator[pa.RecordBatch], width: int, trees: list[Tree], rate: float) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(codes as bytes, codes, labels, scores with these trees) of each block."""
    for b in batches:
        for row in b.to_pylist():
            codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, width)
            score = np.frombuffer(row["score"]).copy()
            for t in trees:
                t.add_to(score, codes, rate)
            yield row["codes"], codes, np.frombuffer(row["y"]), score


def rescored(table: DataFrame, width: int, trees: list[Tree], rate: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, _, y, score in opened(batches, width, trees, rate):
            yield pa.RecordBatch.from_pylist([{"codes": held, "y": y.tobytes(), "score": score.tobytes()}], BLOCK)

    return materialised(table.mapInArrow(run, BLOCK_DDL), "surrogate")


def learnt(table: DataFrame, width: int, trees: list[Tree], rate: float, splits: dict[str, Split], lacks: dict[str, int], leaves: int, least: int, small: int) -> dict[str, Split]:
    """One pass: the best splits of the nodes that are lacking, and all below those of at most `small` rows."""
    paths = list(lacks)
    few = [lacks[p] <= small for p in paths]
    number = {p: i for i, p in enumerate(paths)}
    names = ["node", "feature", "part", "codes", "sums"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        summed: dict[int, np.ndarray] = {}
        for _, codes, y, score in opened(batches, width, trees, rate):
            g, h = gradients(score, y)
            for path, rows in dealt(codes, splits, paths):
                if not len(rows):
                    continue
                i = number[path]
                if few[i]:
                    yield batch([(i, -1, part, codes[rows].tobytes(), np.stack([g[rows], h[rows]]).tobytes())])
                else:
                    summed[i] = summed.get(i, 0) + histogram(codes[rows], g[rows], h[rows])
        for i, held in summed.items():
            yield batch([(i, f, part, None, np.ascontiguousarray(held[:, f]).tobytes()) for f in range(width)])

    def choose(key: tuple, rows: pa.Table) -> pa.Table:
        node, feature = key[0].as_py(), key[1].as_py()
        if feature < 0:
            codes = np.concatenate([np.frombuffer(c.as_py(), np.uint8).reshape(-1, width) for c in rows["codes"]])
            g, h = np.concatenate([np.frombuffer(s.as_py()).reshape(2, -1) for s in rows["sums"]], axis=1)
            found = grown(codes, g, h, leaves, least)
        else:
            whole = sum(np.frombuffer(s.as_py()).reshape(3, 1, CODES) for s in rows["sums"])
            found = {"": best(whole, least, feature)}
        out = [(node, path, s.gain, s.feature, s.code, *s.left, *s.right) for path, s in found.items()]
        kinds = [pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), *[pa.float64()] * 6]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SPLIT_DDL.split(", ")])

    known: dict[str, Split] = {}
    for r in table.mapInArrow(send, SENT_DDL).groupBy("node", "feature").applyInArrow(choose, SPLIT_DDL).collect():  # a row a node and feature
        path, split = paths[r["node"]] + r["path"], Split(r["gain"], r["feature"], r["code"], Sums(r["gl"], r["hl"], r["nl"]), Sums(r["gr"], r["hr"], r["nr"]))
        if path not in known or (-split.gain, split.feature) < (-known[path].gain, known[path].feature):
            known[path] = split
    return known


def fit_leafwise(df: DataFrame, features: str, label: str, width: int, trees: int = 200, leaves: int = 63, rate: float = 0.1, least: int = 50, bins: int = 255, small: int = 8192, keep: int = 20) -> Ensemble:
    """Boosted trees for a label of 0 and 1 and an array of `width` numbers.

    small: nodes of at most so many rows are finished in one group. keep: scores are written anew after so many trees; a pass
    replays the trees since then.
    """
    if not 2 <= bins < CODES or leaves < 2 or least < 1:
        raise ValueError(f"bins from 2 to {CODES - 1}, 2 leaves and 1 row a leaf are the least: {bins}, {leaves}, {least}")
    ship(df.sparkSession)
    rows = df.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    n, ones = rows.agg(F.count("*"), F.sum(F.col(label).cast("double"))).first()
    base = float(np.log(ones / (n - ones))) if n and 0 < ones < n else 0.0 if not n else float(np.sign(2 * ones - n)) * 35.0
    constant = {"feature": np.array([-1]), "threshold": np.zeros(1), "left": np.array([-1]), "right": np.array([-1]), "value": np.array([base]), "cover": np.array([float(max(n, 1))])}
    if not n or not 0 < ones < n:
        return Ensemble([constant], [1.0])
    edges = feature_edges(rows, features, width, bins)
    table = blocks(rows, features, label, edges, base)
    done: list[Tree] = []
    fresh: list[Tree] = []
    while len(done) + len(fresh) < trees:
        if len(fresh) == keep:
            table = rescored(table, width, fresh, rate)
            done, fresh = done + fresh, []
        known: dict[str, Split] = {}
        taken: dict[str, Split] = {}
        lacks = {"": n}
        while lacks:
            known |= learnt(table, width, fresh, rate, taken, lacks, leaves, least, small)
            taken, lacks = drawn(known, leaves, least)
        fresh.append(Tree.of(taken, known[""].whole))
        if not taken:  # nothing is gained: nor would it be later
            break
    grown_ = done + fresh
    return Ensemble([constant, *[t.arrays(edges, float(n)) for t in grown_]], [1.0, *[rate] * len(grown_)])
