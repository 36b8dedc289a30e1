"""The registered queries and the pipeline against brute force."""

import itertools
import zlib

import brute
import corpus_pipeline
import pytest
from compare import same

import __spark_entry__ as entry
from flowprep.llm import quality
from flowprep.llm.common import table


def test_all_are_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op1_line_dedup", "op5_substring_dedup", "op7_jaccard_join", "op8_chat_format"])
def test_same_as_sql(spark, duck, sf, name):
    same(entry.queries()[name](spark, sf), duck.sql(entry.oracle_sql()[name]))


@pytest.mark.parametrize("name", ["op2_sentencepiece", "op3_quality_rules", "op4_media", "op6_token_counts", "op9_licences"])
def test_a_row_for_each_document(spark, docs, sf, name):
    out = entry.queries()[name](spark, sf)
    assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())


def test_pipeline_as_brute_force(spark, sf):
    """Each stage's decisions, made plainly from what the stage before left; the last one's tokens are counted."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    stats = quality.rule_stats(table(spark, sf, "documents"))
    judge = quality.fit(stats, table(spark, sf, "labels"))
    import numpy as np

    marks = judge(np.array([[*brute.statistics(t), max(1, sum(bool(x.strip()) for x in t.split("\n"))) if "\n" in t else 1] for _, t in docs]))[1]
    docs = [d for d, ok in zip(docs, marks, strict=True) if ok]
    key = lambda x: brute.lower(x.strip(" \t\n\x0b\x0c\r"))
    seen = {}
    for i, t in docs:
        for x in t.split("\n"):
            seen.setdefault(key(x), set()).add(i)
    docs = [(i, "\n".join(x for x in t.split("\n") if not key(x) or len(seen[key(x)]) < 10)) for i, t in docs]
    docs = [d for d, (i, _, first) in zip(docs, brute.components(docs), strict=True) if i == first]
    first = {}
    for i, t in docs:
        w = t.split()
        for a in range(len(w) - 49):
            k = tuple(w[a : a + 50])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in docs:
        w = t.split()
        gone = {b for a in range(len(w) - 49) if first[tuple(w[a : a + 50])] < i for b in range(a, a + 50)}
        out.append((i, " ".join(x for a, x in enumerate(w) if a not in gone) if gone else t))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, sizes = {}, []
    for i, t in out:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        n = -(-len(ids) // 1024)
        cuts = [0, *(len(ids) - 1024 * (n - 1 - k) for k in range(n))]
        want[i] = [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts))]
        sizes += [b - a for a, b in itertools.pairwise(cuts)]
    got, sequences = {}, {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {i: sorted(p) for i, p in got.items()} == want
    for items in sequences.values():
        ends = itertools.accumulate(n for _, n in sorted(items))
        assert [o for o, _ in sorted(items)] == [0, *ends][: len(items)] and sum(n for _, n in items) <= 1024
    assert len(sequences) == brute.best_fit(sizes, 1024)


def test_stages_keep_the_columns(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def made(spark, tmp_path, rows, labels):
    rows = [(i, t, "en", "src", None if t is None else len(t), 1.5, t) for i, t in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, c0 string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_pipeline_of_odd_rows(spark, tmp_path):
    import random

    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))
    clean = [(i, text(rng.randint(60, 150))) for i in range(40)]
    long, alone = text(20_000), text(90)
    odd = [(100, None), (101, ""), (102, "too short"), (103, clean[3][1]), (7, clean[7][1]), (None, alone), (104, long), (105, "## $$ %% ||" * 60)]
    labels = [(i, 1, 0) for i in range(40)] + [(105, 0, 0)]
    out = corpus_pipeline.run(spark, made(spark, tmp_path, clean + odd, labels)).collect()
    ids = {r["doc_id"] for r in out}
    assert {*range(40), None, 104} == ids
    pieces = lambda i: [(r["start"], r["length"]) for r in out if r["doc_id"] == i]
    assert len(pieces(7)) == 2 and len(set(pieces(7))) == 1 and len(pieces(8)) == 1  # repeated rows stay together
    cuts = sorted(pieces(104))
    assert len(cuts) > 20 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(cuts)) and max(n for _, n in cuts) == 1024


def test_pipeline_of_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, made(spark, tmp_path, [], [])).count() == 0
