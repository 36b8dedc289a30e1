"""Files and their footers, links that expire, bundles."""

import io
import tarfile
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from flowprep.sources import datasets, footers, links


@pytest.fixture
def shards(spark, tmp_path):
    df = spark.range(90).select("id", F.when(F.col("id") % 3 == 0, " a ").otherwise("b").alias("Label"))
    for day in ("d1", "d2"):
        for i in range(2):
            df.where(F.col("id") % 4 == i + 2 * (day == "d2")).coalesce(1).write.parquet(str(tmp_path / "top" / "set" / day / f"s{i}"))
    return tmp_path / "top"


def test_roots_are_found(spark, shards):
    inside = str(shards / "set")
    assert datasets.resolve_root(spark, inside) == inside
    assert datasets.resolve_root(spark, str(shards / "elsewhere" / "deep")).removeprefix("file:") == inside
    assert datasets.resolve_root(spark, f"file://{shards}/no").removeprefix("file:") == inside
    with pytest.raises(FileNotFoundError):
        datasets.resolve_root(spark, str(shards), "*.csv")


def test_files_are_summed_up(spark, shards):
    rows = datasets.file_summary(spark, str(shards / "set"), label="Label").collect()
    assert len(rows) == 4 and sum(r["n_rows"] for r in rows) == 90 and all(r["row_groups"] == 1 and r["bytes"] > 0 for r in rows)
    assert sum(r["labels"]["a"] for r in rows) == 30 and sum(r["labels"]["b"] for r in rows) == 60 and rows[0]["file"].startswith("d")
    assert all(r["labels"] == {} for r in datasets.file_summary(spark, str(shards / "set")).collect())


def test_the_first_files_alone(spark, shards):
    whole = datasets.read_dataset(spark, str(shards / "set"))
    few = datasets.read_dataset(spark, str(shards / "set"), most_files=3)
    names = sorted(r["file"] for r in whole.select("file").distinct().collect())
    assert len(names) == 4 and sorted(r["file"] for r in few.select("file").distinct().collect()) == names[:3]


def test_figures_are_written(spark, tmp_path):
    paths = datasets.write_figures(str(tmp_path / "f"), {"curve": spark.range(3).withColumnRenamed("id", "x")})
    assert datasets.read_rows(paths[0]) == [{"x": "0"}, {"x": "1"}, {"x": "2"}]
    with pytest.raises(ValueError, match="more than"):
        datasets.write_figures(str(tmp_path / "f"), {"curve": spark.range(3)}, most=2)


def test_a_folder_is_put(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "x").write_text("1")
    (tmp_path / "in" / "y").write_text("2")
    store = datasets.Store(spark, f"file://{tmp_path}/store")
    assert store.put_folder("run", str(tmp_path / "in")) == ["run/a/x", "run/y"] and store.exists("run/a/x")


def test_links():
    held, now = {}, datetime(2030, 1, 1, tzinfo=UTC)
    entry = lambda k, until="2031-01-01T00:00:00Z": {"get_url": f"https://s/{k}?sig=secret", "put_url": f"https://s/{k}?sig=secret", "expires_at": until}
    get = lambda link: (200, held[link]) if link in held else (403, b"")
    put = lambda link, raw: (200, held.__setitem__(link, raw) or b"")
    store = links.Links({"entries": {"a": entry("a"), "old": entry("old", "2029-01-01T00:00:00Z"), "new": None, "b": entry("b")}}, get, put, lambda: now)
    store.write("a", b"1")
    assert store.read("a") == b"1" and store.read("new") is None and not store.exists("none") and "secret" not in repr(store)
    with pytest.raises(links.Expired, match="2029"):
        store.read("old")
    with pytest.raises(links.Expired) as said:
        store.read("b")
    assert "secret" not in str(said.value) and said.value.exit_code == 75
    with pytest.raises(links.Unusable):
        store.write("none", b"")
    for bad in ([], {}, {"entries": 3}):
        with pytest.raises(links.Unusable):
            links.Links(bad, get, put)
    assert links.Unusable.exit_code == 76


def test_bundles(tmp_path):
    (tmp_path / "src" / "__pycache__").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x")
    (tmp_path / "src" / "__pycache__" / "a.pyc").write_text("y")
    path = str(tmp_path / "b.tar.gz")
    assert links.bundle(path, str(tmp_path), ["src"]) == ["src/a.py"]
    assert links.unpack(path, str(tmp_path / "out")) == ["src/a.py"] and (tmp_path / "out/src/a.py").read_text() == "x"
    for name, kind in (("../evil", tarfile.REGTYPE), ("/evil", tarfile.REGTYPE), ("link", tarfile.SYMTYPE)):
        with tarfile.open(path, "w:gz") as out:
            info = tarfile.TarInfo(name)
            info.type, info.linkname, info.size = kind, "/etc/passwd", 0
            out.addfile(info, io.BytesIO(b""))
        with pytest.raises(links.Unusable):
            links.unpack(path, str(tmp_path / "out2"))


def test_footers_are_a_table(spark, shards, tmp_path):
    """Executors read footers, not rows; stores that Arrow doesn't know are the driver's."""
    files = datasets.discover(spark, str(shards / "set"))
    table = footers.footer_table(spark, files)
    assert "Scan parquet" not in table._jdf.queryExecution().executedPlan().toString()
    rows = table.collect()
    assert len(rows) == 4 and sum(r["n_rows"] for r in rows) == 90 and all(r["columns"] == ["id", "Label"] and r["bytes"] > 0 for r in rows)
    assert footers.bounds(table, "id", "long").first() == (90, 0, 0, 89) and footers.bounds(table, "Label", "string").first()[2:] == (" a ", "b")
    spark.range(3).withColumn("x", F.lit(1)).coalesce(1).write.parquet(str(shards / "set" / "odd"))
    spark.range(0).coalesce(1).write.parquet(str(shards / "set" / "none"))
    more = footers.footer_table(spark, datasets.discover(spark, str(shards / "set")))
    assert sorted((r["columns"], r["n_files"], r["n_rows"]) for r in footers.schemas(more).collect()) == [(["id"], 1, 0), (["id", "Label"], 4, 90), (["id", "x"], 1, 3)]
    driver = {(r[0], r[2], r[3]) for r in footers.read_by_driver(spark, files)}
    assert driver == {(r["path"], r["row_group"], r["n_rows"]) for r in rows}
    assert footers.footer_table(spark, []).count() == 0
