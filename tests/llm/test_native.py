"""Line dedup, substring dedup and the Jaccard join against brute force."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowprep.llm import common, components, jaccard, lines, passages, quality, textarrays

TWO = "doc_id long, text string"


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def wanted(rows):
    return sorted(rows, key=repr)


def test_lines_as_brute_force(spark, docs, pairs):
    assert got(lines.dedup_lines(docs).drop("keep")) == wanted(brute.lines(pairs))
    rng = random.Random(1)
    made = [(i, "\n".join(rng.choice(["Ab", " ab\t", "c", "", " ", "d" * rng.randint(0, 3), "é"]) for _ in range(rng.randint(0, 150)))) for i in range(60)]
    for least in (2, 30):
        assert got(lines.dedup_lines(spark.createDataFrame(made, TWO), min_docs=least).drop("keep")) == wanted(brute.lines(made, least))


def test_lines_odd(spark, odd):
    out = lines.dedup_lines(odd, min_docs=2)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256", "keep"] and out.count() == 11
    by = {(r["doc_id"], r["n_lines"]): r["n_dropped"] for r in out.collect()}
    assert by[(1, 3)] == 2 and by[(2, 1)] == 0 and by[(4, 1)] == 0  # a repeated row is one document
    assert lines.dedup_lines(odd.limit(0)).count() == 0
    kept = lines.drop_lines(odd, min_docs=2)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").first()["text"] == "" and kept.where("doc_id = 2").first()["text"] is None


def test_lines_keep_first(spark):
    df = spark.createDataFrame([(1, "a\nb\na"), (2, "b\nc"), (3, "c")], TWO)
    assert [r["text"] for r in lines.drop_lines(df, min_docs=1, keep_first=True).orderBy("doc_id").collect()] == ["a\nb", "c", ""]


def test_lines_bitmaps(spark):
    df = spark.createDataFrame([(i, "\n".join(f"{i}.{j}" if j % 70 else "same" for j in range(200))) for i in range(3)], TWO)
    keep = lines.dedup_lines(df, min_docs=3).where("doc_id = 0").first()["keep"]
    assert keep == {0: ~1, 1: ~(1 << 6), 2: ~(1 << 12)}  # the words of 64 lines that lose one


def test_lines_plan_is_native(docs):
    plan = lines.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def passage_rows():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    parts = [[rng.choice(words) for _ in range(rng.randint(45, 150))] for _ in range(12)]
    rows = []
    for _ in range(250):
        w = []
        for _ in range(rng.randint(0, 5)):
            r = rng.random()
            if r < 0.3:
                w += rng.choice(parts)
            elif r < 0.5:
                p = rng.choice(parts)
                a = rng.randrange(len(p))
                w += p[a : a + rng.randint(40, 90)]
            elif r < 0.6:
                w += ["lol"] * rng.randint(10, 120)
            elif r < 0.7:
                w += ["a", "b"] * rng.randint(10, 60)
            else:
                w += [rng.choice(words) for _ in range(rng.randint(1, 60))]
        if rows and rng.random() < 0.2:
            w = rng.choice(rows)[1].split()
            if w and rng.random() < 0.6:
                w[rng.randrange(len(w))] = "zz"
        rows.append((rng.randint(0, 10**6), rng.choice([" ", "\n"]).join(w)))
    return [*rows, (5, ""), (7, rows[3][1]), (7, rows[3][1]), (7, rows[4][1])]


def test_passages_as_brute_force(spark, docs, pairs):
    assert got(passages.dedup_passages(docs)) == wanted(brute.passages(pairs))
    rows = passage_rows()
    df = spark.createDataFrame(rows, TWO)
    assert got(passages.dedup_passages(df)) == wanted(brute.passages(rows))
    assert got(passages.dedup_passages(df, window=20, k=6)) == wanted(brute.passages(rows, 20))


def test_passages_odd(spark, odd):
    out = passages.dedup_passages(odd)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and out.count() == 11
    assert {r["n_removed"] for r in out.collect()} == {0}  # equal ids are no smaller than another
    again = passages.dedup_passages(odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100)))
    assert again.where("doc_id = 104").first()["n_removed"] == 60_000
    assert passages.dedup_passages(odd.limit(0)).count() == 0
    cut = passages.drop_passages(odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100)))
    assert cut.columns == odd.columns and cut.count() == 22 and cut.where("doc_id = 104").first()["text"] == "" and cut.where("doc_id = 2").first()["text"] is None


def jaccard_rows():
    rng = random.Random(5)
    rows = []
    for _ in range(150):
        base = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice("abcdefgh")
            if rng.random() < 0.3 and w:
                w = w[: rng.randint(1, len(w))]
            rows.append((len(rows), rng.choice([" ", "\n", " A "]).join(w)))
    centre = [f"t{i}" for i in range(120)]  # a group of near copies of one text, not all of each other
    for _ in range(60):
        w = list(centre)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"m{rng.randrange(999)}"
        rows.append((len(rows), " ".join(w)))
    return rows


def test_jaccard_as_brute_force(spark, docs, pairs, monkeypatch):
    assert got(jaccard.jaccard_components(docs)) == wanted(brute.components(pairs))
    rows = jaccard_rows()
    df = spark.createDataFrame(rows, TWO)
    assert got(jaccard.jaccard_components(df)) == wanted(brute.components(rows))
    monkeypatch.setattr(jaccard, "LONG_LIST", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 200)
    assert got(jaccard.jaccard_components(df)) == wanted(brute.components(rows))  # long lists, in many blocks
    assert got(jaccard.jaccard_components(df, n=2, percent=60, counted=1.0, rounds=0)) == wanted(brute.components(rows, 2, 60))


def bridged_hubs(groups):
    """Groups of two edited hubs, each with copies of its own, and copies that bridge them."""
    rng, fresh, rows = random.Random(1), iter(range(10**6)), []

    def edit(words, n):
        at = set(rng.sample(range(len(words)), n))
        return [f"e{next(fresh)}" if i in at else x for i, x in enumerate(words)]

    for g in range(groups):
        hub = [f"g{g}w{i}" for i in range(60)]
        near = edit(hub, 1)
        bridge = edit(near, 1)
        other = edit(bridge, 1)
        texts = [hub, near, bridge, other, *(edit(h, 1) for h in (hub, other) for _ in range(8))]
        for _ in range(4):
            at = set(rng.sample(range(60), 30))
            texts.append([other[i] if i in at else x for i, x in enumerate(hub)])
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(texts)]
    return rows


def test_jaccard_bridges_of_components(spark):
    """The lists that a linked pair shares may have their pivots in the component of either."""
    rows = bridged_hubs(60)
    df = spark.createDataFrame(rows, TWO)
    for rounds in (0, 1):
        assert got(jaccard.jaccard_components(df, rounds=rounds)) == wanted(brute.components(rows))


def test_jaccard_odd(spark, odd):
    out = jaccard.jaccard_components(odd)
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and out.count() == 11
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in out.collect()}
    assert by[(7, 5)] == 1 and by[(2, 0)] == 2 and by[(3, 0)] == 3 and by[(None, 0)] is None and by[(None, 1)] is None and by[(5, 0)] == 5
    assert jaccard.jaccard_components(odd.limit(0)).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and [r["text"] for r in kept.where("doc_id = 7").collect()] == ["another row of the same id"]  # the other row copies document 1
    assert kept.where("doc_id is null").count() == 2 and kept.where("doc_id = 4").count() == 2


def test_jaccard_keeps_other_texts_of_an_id(spark):
    """A row goes for its own text alone: ids that repeat, the largest id and null ids lose nothing else."""
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "a b c d e f g")
    top = (1 << 63) - 1
    rows = [(1, a), (5, a), (5, b), (9, c), (top, b), (None, c), (None, a), (top, "alone here"), (None, "alone too")]
    df = spark.createDataFrame(rows, TWO)
    assert got(jaccard.one_of_each(df)) == wanted([(1, a), (5, b), (9, c), (top, "alone here"), (None, "alone too")])
    assert got(jaccard.jaccard_components(df).select("doc_id", "component_id")) == wanted([(1, 1), (5, 1), (5, 5), (9, 9), (top, 5), (None, 9), (None, 1), (top, top), (None, None)])
    rng = random.Random(8)
    rows = [(rng.choice([None, top, *range(40)]), t) for _, t in jaccard_rows()]
    rows = list(dict.fromkeys(rows))
    kept = {tuple(r) for r in jaccard.one_of_each(spark.createDataFrame(rows, TWO)).collect()}
    for group in brute.groups(rows):
        least = min((i is None, i or 0) for i, _ in group)
        assert sum(r in kept for r in group) == (len(group) if not group[0][1].split() else 1)
        assert not group[0][1].split() or any(r in kept and (r[0] is None, r[0] or 0) == least for r in group)


def test_boundary_follows_cost():
    assert jaccard.boundary({}, 5.0, 80) == 0
    assert jaccard.boundary({5: 1000}, 500.0, 80) >= 5 > jaccard.boundary({12: 1000}, 0.0, 80)
    assert jaccard.boundary({20: 10}, 1e9, 80) == 25  # nothing but the cost bounds it
    sizes = {s: 1000 // s for s in range(1, 400)}
    for mean in (0.0, 3.0, 80.0):
        def cost(x, mean=mean):
            lists = sum(n * jaccard.prefix_length(s, 80) * (1 + mean) for s, n in sizes.items() if s >= -(-80 * (x + 1) // 100))
            return lists + sum(n * jaccard.subsets_of(s, x, 80) for s, n in sizes.items() if s <= x)

        assert jaccard.boundary(sizes, mean, 80) == min(range(60), key=lambda x: (cost(x), x))


def test_sketches_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (3, 50, 400, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n * 9 // 10], rng.integers(0, 1 << 63, n // 2 + 1).astype(np.uint64)]))
        assert jaccard.sketch_distance(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(1, 2), (3, 4), (2, 4), (9, 8)]])
def test_components(spark, edges):
    up = {}
    for a, b in edges:
        up.setdefault(a, {a})
        up.setdefault(b, {b})
        both = up[a] | up[b]
        for x in both:
            up[x] = both
    roots = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {}
    for n, r in roots.items():
        groups.setdefault(r, set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted({tuple(sorted(g)) for g in up.values() if len(g) > 1}) or sorted(map(tuple, map(sorted, groups.values()))) == sorted({tuple(sorted(g)) for g in up.values() if len(g) > 1})


#: Names that the operators use inside, or used to.
INSIDE = ["id", "row", "pos", "key", "h1", "h2", "block", "keep", "lines", "i", "r", "c", "c0", "c1", "k0", "n", "cuts", "doc", "h", "place", "node", "nodes", "first", "root", "n_words", "n_lines", "score", "stats", "__text", "__key", "__row", "__bits", "__lines", "__id", "__cuts", "a.b", "k`k"]


def test_columns_of_any_name_come_back(spark):
    """Each stage that hands columns on gives them back as they were, whatever they are called."""
    words = " ".join(f"w{i}" for i in range(70))
    rows = [(i, t, *(f"{n}{i}" for n in INSIDE)) for i, t in enumerate([f"same line\n{words}", f"same line\n{words} more", "same line\nshort", None, f"other {words} text"])]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{n.replace('`', '``')}` string" for n in INSIDE)]))
    labels = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int")
    outs = [lines.drop_lines(df, min_docs=2), passages.drop_passages(df), jaccard.one_of_each(df), quality.keep_good(df, labels)]
    cut = False
    for out in outs:
        assert out.columns == df.columns
        got_rows = {r[0]: tuple(r) for r in out.collect()}
        assert got_rows and all(r[2:] == rows[i][2:] for i, r in got_rows.items())
        cut |= any(r[1] != rows[i][1] for i, r in got_rows.items())
    assert cut and outs[2].count() == 3 and outs[3].count() == 3


def test_tables_that_nothing_reads_go(spark):
    """What an operator leaves behind is what its result reads."""
    import os

    from flowprep.cluster import shared_dir

    folder = shared_dir(spark).removeprefix("file://") + "/flowprep"
    df = spark.createDataFrame([(i, f"a b c d e f {i % 3}") for i in range(30)], TWO)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = jaccard.jaccard_components(df)
    left = set(os.listdir(folder)) - before
    assert out.count() == 30 and 0 < len(left) <= 3
    with common.scratch(spark):
        lines.dedup_lines(df, min_docs=2).collect()
    assert set(os.listdir(folder)) - before == left


def test_boundary_of_long_sets():
    import time

    began = time.perf_counter()
    assert jaccard.boundary({5000: 3}, 2.0, 80) == 0 and jaccard.boundary({10: 3, 5000: 2}, 2.0, 80) == 0
    assert jaccard.boundary({5: 3, 1_000_000: 2}, 9.0, 80) == 6 and jaccard.boundary({10**6: 5, 30_000: 2, 3: 1}, 9.0, 80) < 10
    assert jaccard.boundary({7: 10, 4000: 3}, 3.0, 100) >= 7  # no subset of one size alone is needed
    assert time.perf_counter() - began < 1
    rng = random.Random(3)
    for _ in range(200):
        sizes = {rng.randint(1, 40): rng.randint(1, 1000) for _ in range(rng.randint(1, 12))}
        mean, percent = rng.choice([0.0, 1.0, 1e3, 1e12]), rng.choice([50, 80, 95])
        cost = lambda x: sum(n * jaccard.prefix_length(s, percent) * (1 + mean) for s, n in sizes.items() if s >= -(-percent * (x + 1) // 100)) + sum(n * jaccard.subsets_of(s, x, percent) for s, n in sizes.items() if s <= x)  # noqa: E731, B023
        assert cost(jaccard.boundary(sizes, mean, percent)) == min(cost(s * 100 // percent) for s in [0, *sizes])


def test_subset_keys_by_complements():
    from itertools import combinations

    for s, most in ((1, 3), (4, 6), (9, 12), (14, 20)):
        tokens = np.sort(np.random.default_rng(s).integers(0, 1 << 63, s, np.int64).astype(np.uint64))
        mixed = jaccard.mix(tokens)
        want = [jaccard.mix(mixed[list(c)].sum(keepdims=True) + np.uint64(k << 56))[0] for k in jaccard.subset_sizes(s, most, 80) for c in combinations(range(s), k)]
        assert sorted(jaccard.subset_keys(tokens, most, 80).tolist()) == sorted(int(w) for w in want)
    assert np.concatenate(list(jaccard.chosen(22, 5))).shape == (26334, 5)


@pytest.mark.parametrize("short", [0, 4])
def test_jaccard_of_long_texts(spark, short):
    rng = random.Random(short)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(5000)] for _ in range(3)]
    texts.append([*texts[0][:4900], "other", "end"])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(10 + i, f"a few words only {i % 2} and some more") for i in range(short)]
    if short:
        rows.append((99, " ".join(str(k) for k in range(30_000))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.jaccard_components(df)) == wanted(brute.components(rows))


def test_hashes_of_long_words(monkeypatch):
    texts = pa.array(["é" * 700 + " ab", "x" * 1000 + "y", "x" * 1000 + "z", "x" * 1000 + "y"])
    whole = textarrays.words_of(texts).hashes()
    monkeypatch.setattr(textarrays, "HASH_BLOCK", 64)
    assert whole.tolist() == textarrays.words_of(texts).hashes().tolist() and len(set(whole.tolist())) == 4


def test_scratches_of_two_threads(spark):
    """Each thread's tables belong to its own scratch."""
    import threading

    inside, over, rows = threading.Event(), threading.Event(), []

    def other():
        with common.scratch(spark) as keep:
            inside.set()
            over.wait(60)
            out = common.written(spark.range(3).toDF("a"), "mine")
            keep(out)
        rows.append(out.count())

    thread = threading.Thread(target=other)
    with common.scratch(spark):
        thread.start()
        inside.wait(60)
        common.written(spark.range(2).toDF("a"), "gone")
        over.set()
        thread.join()
    assert rows == [3]


def test_batches_are_bounded_while_a_table_is_written(spark):
    """Also when two writes overlap; the setting comes back."""
    from flowprep.llm import common

    before = spark.conf.get(common.BATCH_SETTING)
    wide = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 1000).alias("t"))
    sizes = wide.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")
    with common.batches_of(spark, 1 << 20):
        held = common.written(sizes, "sizes", 1 << 18)
        assert spark.conf.get(common.BATCH_SETTING) != before
    assert spark.conf.get(common.BATCH_SETTING) == before
    assert held.agg(F.sum("n"), F.max("n")).first()[0] == 3000 and held.agg(F.max("n")).first()[0] <= 600
