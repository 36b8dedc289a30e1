"""Exact order statistics without a sort and without a buffer that holds a column.

A few wanted ranks take two scans of the input, whatever the number of columns. The first one sums up sizes and a mergeable
quantile sketch of each column; its bounds hold a wanted rank with room to spare. The second counts what lies below and
between the bounds, value by value, into a small table in which the rank is then found. What a sketch missed (it errs by
chance) is seen from the counts, and found as many ranks are: by passes over the input.

Such a pass counts values in a fixed number of buckets between bounds, for all columns at once (partial sums first). The
buckets that hold a wanted rank become the next pass's bounds, until few enough values are left to be listed with their
counts. Bounds far apart are cut evenly by logarithm, others evenly: whatever the values, a few passes do. Buckets are cut by
a function that never falls, so whatever rounding does, the order of values holds. What reaches the driver is bounded by the
number of wanted ranks, not by the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..cluster import materialised

#: Buckets between two bounds, and the values between bounds from which on they are listed.
BUCKETS, LISTED = 1024, 2048
#: A sketch of so many kept values errs by less than MARGIN of all ranks, but for about one in thousands; so many shares go by it.
SKETCH, MARGIN, FEW = 2048, 0.005, 16


def _bucket(x: Column, low: Column, high: Column) -> Column:
    """0 to BUCKETS - 1 from low to high; halves keep the differences of the largest doubles finite."""
    above, below = (low > 0) & (high / 16 > low), (high < 0) & (low / 16 < high)
    around = (low <= 0) & (high >= 0)

    def scale(v: Column) -> Column:
        signed = F.signum(v) * F.coalesce(F.ln(F.nullif(F.abs(v), F.lit(0.0))) + 746, F.lit(0.0))  # ln of the least double is above -745
        return F.when(around, signed).when(above, F.ln(v)).when(below, -F.ln(-v)).otherwise(v / 2)

    part = (scale(x) - scale(low)) / F.nullif(scale(high) - scale(low), F.lit(0.0)) * BUCKETS
    return F.coalesce(F.least(F.floor(part), F.lit(BUCKETS - 1)), F.lit(0)).cast("int")


Span = tuple[str, int, int, float, float]


def order_statistics(df: DataFrame, columns: Mapping[str, Column], wanted: Mapping[str, Sequence[int]], sizes: Mapping[str, tuple[int, float, float]]) -> dict[str, dict[int, float]]:
    """The values at the wanted ranks (from 0) of columns of doubles, nulls left out; sizes: (count, min, max) of each column."""
    names = [c for c in columns if sizes[c][0] and wanted[c]]
    if not names:
        return {c: {} for c in columns}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("b"), columns[c].alias("x")) for i, c in enumerate(names)])).alias("v")).select("v.*", F.lit(1).cast("long").alias("w")).where("x is not null")
    spans = {i: (c, 0, *sizes[c]) for i, c in enumerate(names)}
    return {c: {} for c in columns} | narrowed(long, spans, {i: sorted(set(wanted[c])) for i, c in enumerate(names)})


def narrowed(long: DataFrame, spans: dict[int, Span], ranks: dict[int, list[int]]) -> dict[str, dict[int, float]]:
    """The values at ranks within spans: number -> (column, values before it, values in it, bounds). long has rows (b, x, w) of a
    span's number, a value and how often it stands there."""
    spark = long.sparkSession
    found: dict[str, dict[int, float]] = {c: {} for c, *_ in spans.values()}
    while spans:
        done = {i for i, (_, _, n, low, high) in spans.items() if n <= LISTED or not high / 2 - low / 2 > 0}
        for i, (c, before, n, low, high) in list(spans.items()):
            if low == high:
                found[c] |= dict.fromkeys(ranks[i], low)
                done.discard(i)
                del spans[i]
        if done:  # list what is left in these
            mine = spark.createDataFrame([(i,) for i in sorted(done)], "b int")
            got = long.join(F.broadcast(mine), "b").groupBy("b", "x").agg(F.sum("w").alias("n")).toArrow()  # at most LISTED values a span
            b, x, n = (got[k].to_numpy() for k in ("b", "x", "n"))
            for i in done:
                c, before = spans.pop(i)[:2]
                at = np.flatnonzero(b == i)
                at = at[np.argsort(x[at])]
                upto = before + np.cumsum(n[at])
                found[c] |= {r: float(x[at[np.searchsorted(upto, r, side="right")]]) for r in ranks[i]}
        if not spans:
            break
        bounds = spark.createDataFrame([(i, s[3], s[4]) for i, s in spans.items()], "b int, low double, high double")  # at most a row for each wanted rank
        cut = long.join(F.broadcast(bounds), "b").select("b", "x", "w", _bucket(F.col("x"), F.col("low"), F.col("high")).alias("k"))
        got = cut.groupBy("b", "k").agg(F.sum("w").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).toArrow()
        b, k, n, low, high = (got[c].to_numpy() for c in ("b", "k", "n", "low", "high"))
        new_spans, new_ranks, moved = {}, {}, []
        for i, (c, before, *_) in spans.items():
            at = np.flatnonzero(b == i)
            at = at[np.argsort(k[at])]
            upto = before + np.cumsum(n[at])
            for r in ranks[i]:
                j = int(np.searchsorted(upto, r, side="right"))
                key = (i, int(k[at[j]]))
                if key not in new_ranks:
                    new_ranks[key] = []
                    new_spans[key] = (c, int(upto[j] - n[at[j]]), int(n[at[j]]), float(low[at[j]]), float(high[at[j]]))
                    moved.append(key)
                new_ranks[key].append(r)
        number = {key: i for i, key in enumerate(moved)}
        spans, ranks = {number[key]: s for key, s in new_spans.items()}, {number[key]: r for key, r in new_ranks.items()}
        names_of = spark.createDataFrame([(i, k_, number[(i, k_)]) for i, k_ in moved], "b int, k int, next int")
        long = cut.join(F.broadcast(names_of), ["b", "k"]).select(F.col("next").alias("b"), "x", "w")
    return found


def ranks_of(p: float, n: int) -> tuple[int, int, float]:
    """The two neighbours of a share of n values, and how far between them it lies."""
    at = p * (n - 1)
    low = min(int(at), n - 1)
    return low, min(low + 1, n - 1), at - low


def first_pass(columns: Mapping[str, Column], sketched: bool = True) -> list[Column]:
    """What the first scan sums up of each column: its values, the least and the largest, and a sketch of their order."""
    aggs = [f(x).alias(f"{n}{i}") for i, x in enumerate(columns.values()) for f, n in ((F.count, "n"), (F.min, "low"), (F.max, "high"))]
    return aggs + [F.kll_sketch_agg_double(x, F.lit(SKETCH)).alias(f"sketch{i}") for i, x in enumerate(columns.values()) if sketched]


def sizes_of(columns: Mapping[str, Column], sums: Row) -> dict[str, tuple[int, float, float]]:
    return {c: (sums[f"n{i}"], sums[f"low{i}"], sums[f"high{i}"]) for i, c in enumerate(columns)}


def sketch_bounds(spark: SparkSession, columns: Mapping[str, Column], shares: Sequence[float], sums: Row) -> dict[str, list[tuple[float, float]]]:
    """Intervals, apart from each other and in order, that hold the wanted shares of each column."""
    names = [(i, c) for i, c in enumerate(columns) if sums[f"n{i}"]]
    if not names:
        return {}
    row = spark.createDataFrame([tuple(bytes(sums[f"sketch{i}"]) for i, _ in names)], ", ".join(f"s{i} binary" for i, _ in names))
    ends = sorted({min(max(p + d, 0.0), 1.0) for p in shares for d in (-MARGIN, MARGIN)})
    got = row.select(*[F.kll_sketch_get_quantile_double(f"s{i}", F.array(*map(F.lit, ends))).alias(f"q{i}") for i, _ in names]).first()
    out = {}
    for i, c in names:
        at = dict(zip(ends, got[f"q{i}"], strict=True)) | {0.0: sums[f"low{i}"], 1.0: sums[f"high{i}"]}
        pairs: list[tuple[float, float]] = []
        for p in sorted(shares):
            low, high = at[min(max(p - MARGIN, 0.0), 1.0)], at[min(max(p + MARGIN, 0.0), 1.0)]
            if pairs and low <= pairs[-1][1]:
                pairs[-1] = (pairs[-1][0], max(high, pairs[-1][1]))
            else:
                pairs.append((low, high))
        out[c] = pairs
    return out


def between_bounds(df: DataFrame, columns: Mapping[str, Column], bounds: Mapping[str, list[tuple[float, float]]]) -> DataFrame:
    """(c, part, x, w): how many values of column number c are in each part. Odd parts are intervals, with their values; even ones,
    before and behind them, have none. Written, as it is read more than once and is small."""
    parts = []
    for i, c in enumerate(columns):
        if c in bounds:
            x, part = columns[c], F
            for k, (low, high) in enumerate(bounds[c]):
                part = part.when(x < low, 2 * k).when(x <= high, 2 * k + 1)
            parts.append(F.struct(F.lit(i).alias("c"), x.alias("x"), part.otherwise(2 * len(bounds[c])).alias("part")))
    long = df.select(F.inline(F.array(*parts))).where("x is not null").select("c", "part", F.when(F.col("part") % 2 == 1, F.col("x")).alias("x"))
    return materialised(long.groupBy("c", "part", "x").agg(F.count("*").alias("w")), "between")


def quantiles(df: DataFrame, columns: Mapping[str, Column], shares: Sequence[float], sums: Row | None = None) -> dict[str, list[float | None]]:
    """The exact quantiles of columns of doubles, by linear interpolation; nulls are left out; None without values.

    sums is a row of first_pass(), if the caller has scanned the input already.
    """
    few = 0 < len(shares) <= FEW
    if sums is None:
        sums = df.agg(*first_pass(columns, few)).first()
    sizes = sizes_of(columns, sums)
    wanted = {c: sorted({r for p in shares for r in ranks_of(p, sizes[c][0])[:2]}) if sizes[c][0] else [] for c in columns}
    found: dict[str, dict[int, float]] = {c: {} for c in columns}
    bounds = sketch_bounds(df.sparkSession, columns, shares, sums) if few else {}
    if bounds:
        counted = between_bounds(df, columns, bounds)
        held: dict[tuple[int, int], int] = {(r["c"], r["part"]): r["n"] for r in counted.groupBy("c", "part").agg(F.sum("w").alias("n")).collect()}  # a few rows a column
        spans, ranks, number = {}, {}, {}
        for i, c in enumerate(columns):
            before = 0
            for part in range(2 * len(bounds.get(c, [])) + 1):
                n = held.get((i, part), 0)
                mine = [r for r in wanted[c] if before <= r < before + n]
                if part % 2 and mine:
                    number[(i, part)] = k = len(spans)
                    spans[k], ranks[k] = (c, before, n, *bounds[c][part // 2]), mine
                before += n
        if spans:
            names = df.sparkSession.createDataFrame([(i, part, k) for (i, part), k in number.items()], "c int, part int, b int")
            found |= narrowed(counted.join(F.broadcast(names), ["c", "part"]).select("b", "x", "w"), spans, ranks)
    missed = {c: [r for r in wanted[c] if r not in found[c]] for c in columns}
    if any(missed.values()):
        for c, values in order_statistics(df, columns, missed, sizes).items():
            found[c] = found[c] | values
    out: dict[str, list[float | None]] = {}
    for c in columns:
        n = sizes[c][0]
        places = [ranks_of(p, n) for p in shares] if n else []
        out[c] = [found[c][a] + (found[c][b] - found[c][a]) * part if part else found[c][a] for a, b, part in places] or [None] * len(shares)
    return out
