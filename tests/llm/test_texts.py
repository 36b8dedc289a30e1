"""Tokens, media, quality, chats, licences and packing against libraries and brute force."""

import hashlib
import random
import struct
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowprep.llm import chat, licences, media, packing, quality, sentencepieces, token_counts

PARTS = ["'", "s", "re", "ve", "ll", "'re", "'r", "'l", "'v", " ", "  ", "\n", "\t", "a", "Z", "1", "²", "é", "日", "!", "..", " ", "　", "<|endoftext|>", "<|endof", "\x00", "‍", "🙂", "'S", "▁", "<s>"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path("byte_bpe_50k.json"))


def test_counts_as_the_library(path, library, pairs):
    texts = [*random_texts(5000), *[t for _, t in pairs], "a" * 3000, "日" * 1000, " " * 1000, "ab" * 60, "x" * 65, ""]
    assert token_counts.count_tokens(texts, path("byte_bpe_50k.json")).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_classes_as_the_library(path, library):
    texts = [f"a{c}b 1{c}1 .{c}." for c in map(chr, [*range(1, 0x3000), *range(0xF900, 0x10500)])]
    assert token_counts.count_tokens(texts, path("byte_bpe_50k.json")).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_odd(odd, path):
    out = token_counts.token_counts(odd, path("byte_bpe_50k.json"), limit=5)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.count() == 11
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[3]["n_tokens"] == by[2]["n_tokens"] == 0 and by[4]["over_limit"] and not by[3]["over_limit"]
    assert token_counts.token_counts(odd.limit(0), path("byte_bpe_50k.json")).count() == 0


def mapped_model(path, squeeze):
    """The model with a real character map instead of its empty one, as a file's bytes."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    normaliser = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    with open(path("piece_bpe_32k.model"), "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    model.normalizer_spec.CopyFrom(sentencepiece_model_pb2.ModelProto.FromString(normaliser.serialized_model_proto()).normalizer_spec)
    return model.SerializeToString()


@pytest.mark.parametrize("kind", ["as it is", "mapped", "mapped, squeezed"])
def test_pieces_as_the_library(spark, path, pairs, tmp_path, kind):
    """What the query returns, against the library on the raw texts; and the spans lie in the source, in order."""
    import sentencepiece

    model = path("piece_bpe_32k.model")
    if kind != "as it is":
        model = str(tmp_path / "mapped.model")
        (tmp_path / "mapped.model").write_bytes(mapped_model(path, kind.endswith("squeezed")))
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    p = sentencepieces.pieces(model)
    texts = [*random_texts(1000, 2), *[t for _, t in pairs[:60]], "", " ", "  a", "ﬁne ①② ㌔  x", "Å　B", "a\u200bb", "▁ ▁a"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in sentencepieces.digest(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        ids = library.encode(text, add_eos=True)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids)))
        _, begins, ends = p.encode(text)
        assert (begins[1:] == ends[:-1]).all() and (ends >= begins).all() and 0 <= begins[0] and ends[-1] <= len(text.encode())
        if kind == "as it is":
            assert begins[0] == 0 and ends[-1] == len(text.encode())  # the spans tile the source
    _, begins, ends = p.encode("ﬁx ㌔ é")
    raw = "ﬁx ㌔ é".encode()
    assert b"".join(raw[b:e] for b, e in zip(begins, ends, strict=True)) == raw


def test_normaliser_as_the_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    rng = random.Random(3)
    alphabet = [*"ab  \t\n", "ﬁ", "①", "Å", "Å", "㌔", "　", "é", "é", "ｱ", "ﾞ", "​", "🙂", "日", "½"]
    for squeeze in (True, False):
        library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
        spec = sentencepiece_model_pb2.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
        mine = sentencepieces.Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        for _ in range(1500):
            text = "".join(rng.choices(alphabet, k=rng.randint(0, 12)))
            normal, align = mine(text)
            assert normal.decode() == library.normalize(text)
            assert len(align) == len(normal) + 1 and (np.diff(align) >= 0).all() and align[-1] <= len(text.encode())


def test_pieces_odd(odd, path):
    model = path("piece_bpe_32k.model")
    out = sentencepieces.digest(odd, model)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc"] and out.count() == 11
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == 1 and by[3]["decoded_sha256"] == brute.sha("") and by[3]["ids_sha256"] == brute.sha("2")
    full = {r["doc_id"]: r for r in sentencepieces.encode(odd.where("doc_id = 1"), model).collect()}[1]
    assert full["ids"][-1] == 2 and full["begins"][0] == 0 and full["ends"][-1] == len(odd.where("doc_id = 1").first()["text"])
    assert sentencepieces.digest(odd.limit(0), model).count() == 0


def test_statistics_as_brute_force(pairs):
    rng = random.Random(2)
    texts = [t for _, t in pairs] + ["", "a", "a b a b a b", "\n\n", "é #|\n é #|\né #|", " x y z  x y z\r\n"] + ["".join(rng.choices("ab \n\té# \x1c\x85", k=rng.randint(0, 60))) for _ in range(2000)]
    assert quality.statistics(pa.array(texts))[:, :5].tolist() == [brute.statistics(t) for t in texts]


def test_rules_follow_the_labels(spark, docs):
    """Labelled junk goes far more often than labelled good documents, of which nearly none go by the forest."""
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.quality_rules(big, labels).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg((~F.col("kept")).cast("int")).alias("gone")).collect()
    by = {r["quality"]: r["gone"] for r in got}
    assert by[1] < 0.005 and by[0] > 0.3


def test_threshold_heeds_both_labels(spark):
    """Junk that a feature tells apart goes, at a loss of good documents within the bound; held-out junk goes too."""
    big, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = labels.withColumn("quality", F.when(F.col("doc_id") % 2 == 0, F.col("quality")))
    for known, other in ((labels, labels), (half, labels.where("doc_id % 2 = 1"))):
        rows = quality.quality_rules(big, known).join(other, "doc_id").where("not base_failed")
        by = {r["quality"]: r["gone"] for r in rows.groupBy("quality").agg(F.avg((~F.col("kept")).cast("int")).alias("gone")).collect()}
        assert by[0] > 0.95 and by[1] <= 0.002
    assert quality.calibrated(np.array([0.7, 0.6, 0.5]), np.array([0, 0, 9]), np.array([1, 2, 1]), 0.0005) == pytest.approx(0.55025)
    assert quality.calibrated(np.array([0.7, 0.5]), np.array([1, 9]), np.array([0, 0]), 0.0005) == pytest.approx(0.7105)


def test_verdicts_as_brute_force(spark):
    """Scores by a walk of each row through each tree; the threshold from trying every one; kept from both."""
    big, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.quality_rules(big, labels).collect()}
    judge = quality.fit(quality.rule_stats(big), labels)
    forest, known, marks = judge.forest, {r["doc_id"]: r["quality"] for r in labels.collect()}, []
    for r in got.values():
        words, lines = max(r["n_words"], 1), max(r["n_lines"], 1)
        x = [r["word_chars"] / words, np.log1p(20 * r["n_symbols"] / words), np.log1p(r["n_words"] / lines)]
        total = 0.0
        for tree in forest.trees:
            at = 0
            while tree[at][0] >= 0:
                at = int(tree[at][2]) + bool(x[int(tree[at][0])] >= tree[at][1])
            total += tree[at][3]
        h = sum(1 / i for i in range(1, forest.sample))
        score = 2 ** (-total / len(forest.trees) / (2 * h - 2 * (forest.sample - 1) / forest.sample))
        assert abs(score - r["score"]) < 0.01  # the harmonic number is approximated there
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert (r["base_failed"], r["kept"]) == (failed, not failed and r["score"] < judge.threshold)
        if not failed and known.get(r["doc_id"]) is not None:
            marks.append((r["score"], known[r["doc_id"]] == 1))
    n_good, n_bad = sum(g for _, g in marks), sum(not g for _, g in marks)
    assert n_good and n_bad

    def balance(threshold):
        lost, caught = sum(g and s >= threshold for s, g in marks), sum(not g and s >= threshold for s, g in marks)
        return (caught / n_bad - lost / n_good) if lost <= 0.0005 * n_good else -1.0

    best = max(balance(k / 2000) for k in range(2001))
    assert balance(judge.threshold) == pytest.approx(best)


def test_rules_without_labels(odd, docs):
    none = odd.select("doc_id", F.lit(None).cast("int").alias("quality"))
    out = quality.quality_rules(odd, none)
    assert out.count() == 11 and {(r["base_failed"], r["kept"]) for r in out.collect()} == {(True, False)}
    assert quality.quality_rules(odd.limit(0), none).count() == 0
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == quality.quality_rules(docs, none).where("not base_failed").count()


def test_forest_isolates_outliers():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(size=(500, 3)), [[9, 9, 9]]])
    scores = quality.IsolationForest(rows).score(rows)
    assert scores.argmax() == 500 and scores.min() > 0 and scores.max() < 1


def picture():
    return np.random.default_rng(4).integers(0, 256, (37, 23, 3), dtype=np.uint8)


def bmp(image):
    line = (image.shape[1] * 3 + 3) // 4 * 4
    head = struct.pack("<IiiHHIIiiII", 40, image.shape[1], image.shape[0], 1, 24, 0, 0, 0, 0, 0, 0)
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + head + b"".join(r[:, ::-1].tobytes().ljust(line, b"\0") for r in image[::-1])


def old_bmp(image):
    """With the header of 12 bytes."""
    line = (image.shape[1] * 3 + 3) // 4 * 4
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 26) + struct.pack("<IHHHH", 12, image.shape[1], image.shape[0], 1, 24) + b"".join(r[:, ::-1].tobytes().ljust(line, b"\0") for r in image[::-1])


def test_decoding():
    image = picture()
    assert (media.decode(b"P6 # a comment\n23 37\n255\n" + image.tobytes()) == image).all()
    assert (media.decode(bmp(image)) == image).all()
    assert (media.decode(b"P5\n23 37\n255\n" + image[:, :, 0].tobytes())[:, :, 0] == image[:, :, 0]).all()
    assert (media.decode(b"P2\n3 1\n255\n1 2 # x\n3") == [[[1], [2], [3]]]).all()
    assert (media.decode(b"P1\n3 1\n1 0 1") == [[[0], [255], [0]]]).all()
    assert (media.decode(b"P4\n3 1\n\xa0") == [[[0], [255], [0]]]).all()
    assert (media.read_tiles(b"".join(media.tiles(image, 10))) == image).all()
    assert media.decode(b"P5 3 1 100\n" + bytes([0, 50, 100])).ravel().tolist() == [0, 128, 255]  # scaled to 255, halves up
    assert media.decode(b"P3 1 1 1\n1 0 1").ravel().tolist() == [255, 0, 255]
    assert (media.decode(old_bmp(image)) == image).all()
    palette = bytes(x for i in range(256) for x in (i, 255 - i, i // 2))
    grey = image[:, :, 0]
    line = (grey.shape[1] + 3) // 4 * 4
    rows = b"".join(r.tobytes().ljust(line, b"\0") for r in grey[::-1])
    small = b"BM" + struct.pack("<IHHI", 0, 0, 0, 26 + 768) + struct.pack("<IHHHH", 12, grey.shape[1], grey.shape[0], 1, 8) + palette + rows
    assert (media.decode(small) == np.stack([grey // 2, 255 - grey, grey], axis=2)).all()
    for bad in (b"P5 1 1 65535\n\0\0", b"P2 1 1 9\n10", b"P2 1 1 9\n-1", b"P5 1 1 0\n\0", b"P6", b"BM"):
        with pytest.raises((ValueError, struct.error)):
            media.decode(bad)


def test_area_resize_is_exact():
    image = picture()
    slow = image.repeat(8, 0).repeat(9, 1).astype(float).reshape(8, 37, 9, 23, 3).mean((1, 3))
    assert np.allclose(media.area_resize(image, 8, 9), slow)


def test_media_columns(spark):
    image = picture()
    rows = [(1, b"P6 23 37 255\n" + image.tobytes()), (2, bmp(image)), (3, None), (4, b"nothing"), (5, b"P6 9 9 255\nshort"), (1, b"P6 23 37 255\n" + image.tobytes())]
    out = media.media_columns(spark.createDataFrame(rows, "id int, media binary").withColumn("ok", F.lit("clash")))
    got = out.collect()
    assert [r["ok"] for r in got] == [True, True, False, False, False, True]
    assert got[0]["dhash"] == got[1]["dhash"] == got[5]["dhash"] and (media.read_tiles(b"".join(got[0]["tiles"])) == image).all()
    assert out.limit(0).count() == 0


def test_payloads(odd):
    out = media.payload_digest(odd)
    by = {r["doc_id"]: r for r in out.collect()}
    for i, text in ((1, odd.where("doc_id = 1").first()["text"]), (2, ""), (6, odd.where("doc_id = 6").first()["text"])):
        raw = text.encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (by[i]["n_bytes"], by[i]["payload_bytes"], by[i]["payload_sha256"], by[i]["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored, grid = brute.npy_tiles(payload), np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
        assert (by[i]["media_bytes"], by[i]["media_sha256"], by[i]["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), brute.difference_hash(grid))
    assert out.where("doc_id = 4").select("media_sha256", "feature").distinct().count() == 1 and media.payload_digest(odd.limit(0)).count() == 0


def test_escaping_is_reversible():
    for text in [*random_texts(500), "<|im_end|>", "<\\|x", "<\\\\|", "<<||", "a<|<\\|b"]:
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_chats(spark, path):
    ranks = path("byte_bpe_50k.tiktoken")
    rows = [(1, 1, "assistant", "ok <|im_end|>"), (1, 0, "user", "hi"), (None, 0, None, None), (2, 0, "assistant", "x " * 200_000), (2, 0, "assistant", "x " * 200_000), (3, None, "a\\ssistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("ids", F.lit(1))
    by = {r["conv_id"]: r for r in chat.chat_digest(chat.format_chats(df, ranks), ranks).collect()}
    assert (by[1]["n_turns"], by[1]["loss_chars"], by[1]["loss_sha256"]) == (2, 13, brute.sha("ok <|im_end|>"))
    assert by[1]["turns_sha256"] == brute.sha("user\nhi\nassistant\nok <|im_end|>\n")
    assert by[2]["n_turns"] == 2 and by[2]["loss_sha256"] == brute.sha("x " * 400_000)
    assert by[None]["n_turns"] == 1 and by[None]["loss_chars"] == 0 and by[3]["n_turns"] == 1
    formatted = chat.format_chats(df.where("conv_id = 1"), ranks).first()
    shown = f"{chat.START}user\nhi{chat.END}\n{chat.START}assistant\nok <\\|im_end|>{chat.END}\n"
    assert by[1]["formatted_chars"] == len(shown) and len(formatted["ids"]) == len(formatted["mask"])
    assert chat.format_chats(df.where("conv_id = 2"), ranks).count() > 1  # a long conversation comes in blocks
    assert chat.chat_digest(chat.format_chats(df.limit(0), ranks), ranks).count() == 0


def test_licences_as_brute_force(pairs):
    texts = [t for _, t in pairs] + ["", "MIT License MIT license\nmit-license apache license general public license general public licenses", "K mit license", "É mit LICENSE é"]
    assert [licences.scan(t)[:5] for t in texts] == [brute.licences(t) for t in texts]


@pytest.mark.parametrize(
    ("expression", "wanted"),
    [("MIT", (True, {"mit"})), ("MIT OR Apache-2.0", (True, {"mit", "apache"})), ("(GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSD-3-Clause", (True, {"gpl", "bsd"})), ("Foo AND MIT", (False, set())), ("Foo OR MIT */", (True, {"mit"})), ("Foo AND MIT OR ISC", (True, {"isc"})), ("Foo AND (MIT OR ISC)", (False, set())), ("MIT AND", (True, {"mit"}))],
)
def test_expressions(expression, wanted):
    assert licences.evaluate(expression) == wanted


def random_expression(rng, depth=0):
    r = rng.random()
    if depth > 3 or r < 0.4:
        return rng.choice(["MIT", "Foo", "Apache-2.0", "apache-9.9", "GPL-2.0-only", "GPL-2.0+", "EUPL-1.2", "WTFPL", "MIT-9.7", "BSD", "LicenseRef-x"])
    if r < 0.55:
        return f"{rng.choice(['GPL-2.0-or-later', 'Foo', 'MIT'])} WITH {rng.choice(['Classpath-exception-2.0', 'nonsense-thing', 'MIT'])}"
    a, b = random_expression(rng, depth + 1), random_expression(rng, depth + 1)
    return f"({a} {rng.choice(['AND', 'or'])} {b})" if r < 0.8 else f"{a} {rng.choice(['and', 'OR'])} {b}"


def test_expressions_as_brute_force():
    rng = random.Random(4)
    for _ in range(3000):
        e = random_expression(rng)
        assert licences.evaluate(e) == brute.expression(e), e
    lines = [f"// SPDX-License-Identifier: {random_expression(rng)}" for _ in range(300)] + ["mit license", "an isc license", "nothing", "", "License-Expression: EUPL-1.2"]
    for _ in range(400):
        text = "\n".join(rng.choices(lines, k=rng.randint(0, 5)))
        assert licences.scan(text)[4:] == brute.labels_and_score(text), text


def test_broken_expressions():
    for bad in ("", "AND", "(MIT", ") MIT"):
        with pytest.raises(ValueError, match="expression"):
            licences.evaluate(bad)
    with pytest.raises(ValueError, match="left side"):
        licences.postfix(["and"])


def test_tags_and_scores(spark, odd):
    texts = ["// SPDX-License-Identifier: MIT OR ISC\nx", "spdx-license-identifier: Foo", "mit license", "none", "Licensed under CC BY-NC 4.0."]
    got = [licences.scan(t) for t in texts]
    assert [g[5] for g in got] == ["isc,mit", "", "mit", "", "cc-by"] and [g[6] for g in got] == [1.0, 0.5, 0.5, 0.0, 0.0]
    out = licences.licence_scan(odd)
    assert out.count() == 11 and out.where("doc_id = 2").first()["n_words"] == 0 and licences.licence_scan(odd.limit(0)).count() == 0


def test_ranks_as_the_tokenizers_file(path, library):
    """Packing encodes with the rank file: the same ids, special strings included."""
    ranks = path("byte_bpe_50k.tiktoken")
    for t in [*random_texts(3000, 5), *[f"a{c}b 1{c}1 .{c}." for c in map(chr, range(1, 0x3000))]]:
        assert packing.token_ids(t, ranks).tolist() == library.encode(t, add_special_tokens=False).ids


def test_plan_is_whole_and_tight():
    rng = random.Random(6)
    for _ in range(30):
        size = rng.choice([8, 64, 1024])
        histogram = {k: rng.randint(0, 200) for k in rng.sample(range(1, size + 1), min(size, 20))}
        slots = packing.plan_slots(histogram, size)
        used = {}
        for length, a, b, first, each, offset in slots.tolist():
            for r in range(a, b):
                used.setdefault(first + (r - a) // each, []).append((offset + (r - a) % each * length, length))
        for items in used.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= size
        assert sorted(x for i in used.values() for _, x in i) == sorted(k for k, n in histogram.items() for _ in range(n))
        total = sum(k * n for k, n in histogram.items())
        assert len(used) <= 11 / 9 * -(-total // size) + len([k for k in histogram if 2 * k > size]) * 200 + 1
        # as item-by-item best fit, longest first
        rooms = []
        for k in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
            fit = min((r for r in rooms if r >= k), default=None)
            if fit is None:
                rooms.append(size - k)
            else:
                rooms[rooms.index(fit)] -= k
        assert len(used) == len(rooms)


def test_packing(spark, odd, docs, path, library):
    ranks = path("byte_bpe_50k.tiktoken")
    for df in (docs, odd):
        got = packing.pack(df, ranks).collect()
        texts = {}
        for r in df.select("doc_id", "text").collect():
            texts.setdefault(r["doc_id"], []).append(r["text"] or "")
        sequences = {}
        for r in got:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for items in sequences.values():
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(items), sorted(items)[1:], strict=False)) and min(items)[0] == 0 and sum(n for _, n in items) <= 1024
        for i, group in texts.items():
            want = []
            for t in group:
                ids = [*library.encode(t, add_special_tokens=False).ids, 2]
                n = -(-len(ids) // 1024)
                cuts = [0, *[len(ids) - 1024 * (n - 1 - k) for k in range(n)]]
                want += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i) == sorted(want)
    assert packing.pack(odd.limit(0), ranks).count() == 0

def test_long_white_space(spark, path, library):
    """A run of white space of any length has the ids that the tokenizers library gives, wherever it stands."""
    ranks = path("byte_bpe_50k.tiktoken")
    for ch in (" ", "\n", "　"):
        for text in (f"a{ch * 1_000_000}x{ch}", ch * 1_000_000, f"{ch * 70_000}\n{ch * 70_000}<|endoftext|>{ch * 70_000} b", f"a {ch * 70_000}'s{ch * 65_536}1"):
            assert (packing.token_ids(text, ranks) == library.encode(text, add_special_tokens=False).ids).all()
        long = ch * (10_000_000 if ch == " " else 2_000_000) + "x"
        assert (packing.token_ids(long, ranks) == library.encode(long, add_special_tokens=False).ids).all()
        assert token_counts.count_tokens([long], path("byte_bpe_50k.json"))[0] == len(packing.token_ids(long, ranks))
    df = spark.createDataFrame([(1, 0, "user", " " * 1_000_000 + "x"), (1, 1, "assistant", "\n" * 1_000_000)], "doc_id long, turn int, role string, text string")
    assert packing.pack(df.drop("turn", "role"), ranks).agg(F.sum("length")).first()[0] == sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in df.collect())
    got = chat.chat_digest(chat.format_chats(df, ranks, conv_col="doc_id").withColumnRenamed("doc_id", "conv_id"), ranks).first()
    assert got["n_turns"] == 2 and got["loss_sha256"] == brute.sha("\n" * 1_000_000)


def test_chat_ties_go_by_text(spark, path):
    ranks = path("byte_bpe_50k.tiktoken")
    texts = ["b", "a", "", "é", "B", None, "a\n"]
    df = spark.createDataFrame([(1, 0, "user", t) for t in texts], "conv_id long, turn int, role string, text string")
    wanted = "".join(f"user\n{t}\n" for t in sorted(t or "" for t in texts))
    assert chat.chat_digest(chat.format_chats(df, ranks), ranks).first()["turns_sha256"] == brute.sha(wanted)


def test_counts_with_few_transitions(path, library, pairs, monkeypatch):
    """Generations that are full after a few pieces change nothing, nor does the order of texts."""
    texts = [*random_texts(1500, 9), *[t for _, t in pairs[:80]], "abcdefgh", "abcdefghabcdefgh", " abcdefg" * 9, "x" * 64, "x" * 63, "é" * 40]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    for kept in (4, 64, 1000):
        few = token_counts.Transducer(path("byte_bpe_50k.json"), kept)
        monkeypatch.setattr(token_counts, "transducer", lambda _, few=few: few)
        got = [n for i in range(0, len(texts), 97) for n in token_counts.count_tokens(texts[i : i + 97], "").tolist()]
        assert got == want and few.now.filled <= kept and few.before is not None
