"""Datasets as folders of Parquet shards: discovery, canonical names, file identity, counts; CSV, JSON and YAML at the edge."""

from __future__ import annotations

import csv
import json
import os
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions.columns import stripped
from .footers import footer_table


def _files(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """All files below a folder of any store that Spark reads, whose name fits the pattern, sorted by path."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    wanted = re.compile(re.escape(pattern).replace(r"\*", "[^/]*") + "$")
    found, it = [], fs.listFiles(path, True)
    while it.hasNext():
        at = it.next().getPath()
        if wanted.match(at.getName()):
            found.append(at.toString())
    return sorted(found)


def discover(spark: SparkSession, root: str, pattern: str = "*.parquet") -> list[str]:
    """The dataset's files; FileNotFoundError says what is there instead."""
    found = _files(spark, root, pattern)
    if not found:
        there = _files(spark, root, "*")
        raise FileNotFoundError(f"no {pattern} below {root}; there are {len(there)} other files, such as {there[:5]}")
    return found


def resolve_root(spark: SparkSession, root: str, pattern: str = "*.parquet") -> str:
    """The folder itself if it holds matches, else the deepest folder that holds all matches below its nearest ancestor that
    exists (not the store's top). In any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if _files(spark, root, pattern):
        return root
    while path is not None and not (fs.exists(path) and fs.getFileStatus(path).isDirectory()):
        path = path.getParent()
    matches = _files(spark, path.toString(), pattern) if path is not None and path.getParent() is not None else []
    if not matches:
        raise FileNotFoundError(f"nothing fits {pattern} in or near {root}")
    return os.path.commonpath([m.rpartition("/")[0] for m in matches]) if len(matches) > 1 else matches[0].rpartition("/")[0]


@dataclass
class Footer:
    """What the end of a Parquet file says of it."""

    path: str
    columns: tuple[str, ...]
    row_groups: int


def footers(spark: SparkSession, files: Sequence[str]) -> list[Footer]:
    """The footers of files in their order, read by executors: a row a file, as the list of files is the driver's too."""
    table = footer_table(spark, files).groupBy("path", "columns").agg(F.count("row_group").alias("n"))
    found = {r["path"]: Footer(r["path"], tuple(r["columns"]), r["n"]) for r in table.collect()}
    return [found[f] for f in files]


def _below(root: str) -> Column:
    """A file's path below a dataset's folder."""
    name = root.rstrip("/").split("/")[-1]
    path = F.col("_metadata.file_path")
    return F.substring_index(path, f"/{name}/", -1) if name else path


def read_dataset(spark: SparkSession, root: str, aliases: Mapping[str, Iterable[str]] | None = None, pattern: str = "*.parquet", most_files: int = 0) -> DataFrame:
    """All shards (with most_files, the first ones by path) under canonical names, with file (its path below the root) and
    position (its row in the file).

    Schemas are compared before reading: shards whose canonical columns differ are an error. Each spelling of a schema
    is read by itself and then joined to the others by name, so a shard may spell its headers in its own way.
    """
    index = S.alias_index(aliases or {})
    groups: dict[tuple[str, ...], list[str]] = {}
    for f in footers(spark, discover(spark, root, pattern)[: most_files or None]):
        groups.setdefault(f.columns, []).append(f.path)
    out, names = None, None
    for columns, members in groups.items():
        mapping, clashes = S.column_mapping(columns, index)
        if clashes:
            raise ValueError(f"columns share a name: {clashes}")
        mine = [mapping[c] for c in columns]
        if names is not None and set(mine) != set(names):
            lacking, more = S.schema_difference(names, mine)
            raise ValueError(f"{members[0]} lacks {lacking} and has {more} besides")
        names = names or mine
        raw = spark.read.parquet(*members)
        part = raw.select(*[F.col(f"`{c}`").alias(mapping[c]) for c in columns], _below(root).alias("file"), F.col("_metadata.row_index").alias("position"))
        out = part if out is None else out.unionByName(part)
    return out


def file_summary(spark: SparkSession, root: str, pattern: str = "*.parquet", label: str | None = None) -> DataFrame:
    """(file, n_rows, row_groups, bytes, labels) of each shard; labels counts each value of a label column, if one is named."""
    files = footers(spark, discover(spark, root, pattern))
    groups = spark.createDataFrame([(f.path, f.row_groups) for f in files], "path string, row_groups int")
    df = spark.read.parquet(*[f.path for f in files])
    value = stripped(F.col(f"`{label}`")) if label else F.lit(None).cast("string")
    path = F.col("_metadata.file_path")
    counts = df.groupBy(_below(root).alias("file"), path.alias("path"), value.alias("value")).agg(F.count("*").alias("n"), F.max("_metadata.file_size").alias("bytes"))
    pairs = F.filter(F.collect_list(F.struct("value", "n")), lambda p: p["value"].isNotNull())
    sums = counts.groupBy("file", "path").agg(F.sum("n").alias("n_rows"), F.max("bytes").alias("bytes"), F.map_from_entries(pairs).alias("labels"))
    same = F.regexp_replace("path", "^file:/+", "/")  # a local path is spelled with one slash or with three
    sums, groups = sums.withColumn("at", same), groups.withColumn("at", same).select("at", "row_groups")
    return sums.join(groups, "at").select("file", "path", "n_rows", "row_groups", "bytes", "labels")


def read_yaml(path: str) -> dict[str, Any]:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def write_rows(path: str, rows: list[dict[str, Any]]) -> None:
    """A small report as CSV; the header is the first row's, no rows give an empty file."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        if rows:
            w = csv.DictWriter(f, fieldnames=list(rows[0]))
            w.writeheader()
            w.writerows(rows)


def write_figures(folder: str, figures: Mapping[str, DataFrame], most: int = 100_000) -> list[str]:
    """The data behind each figure as a CSV file of its name; ValueError if one has more than `most` rows."""
    os.makedirs(folder, exist_ok=True)
    paths = []
    for name, df in figures.items():
        rows = [r.asDict() for r in df.limit(most + 1).collect()]  # bounded
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        paths.append(os.path.join(folder, f"{name}.csv"))
        write_rows(paths[-1], rows)
    return paths


def read_rows(path: str) -> list[dict[str, str]]:
    """A CSV report; a missing file has no rows."""
    if not os.path.exists(path):
        return []
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.DictReader(f))


def write_json(path: str, value: Any) -> None:
    """All of it or nothing: to a file beside, flushed, checked for its size, then renamed."""
    beside, raw = f"{path}.part", json.dumps(value, indent=2, sort_keys=True).encode()
    with open(beside, "wb") as f:
        f.write(raw)
        f.flush()
        os.fsync(f.fileno())
    if os.path.getsize(beside) != len(raw):
        raise OSError(f"{beside} was cut short")
    os.replace(beside, path)


def read_json(path: str) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


class Store:
    """Objects under keys in any store that Spark reads; an object that isn't there is a cold start, not an error."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, key: str):
        if key.startswith("/") or ".." in key.split("/"):
            raise ValueError(f"{key!r} leaves the store")
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")
        return path.getFileSystem(self.conf), path

    def exists(self, key: str) -> bool:
        fs, path = self._at(key)
        return fs.exists(path)

    def put(self, key: str, local: str) -> None:
        fs, path = self._at(key)
        fs.copyFromLocalFile(False, True, self.jvm.org.apache.hadoop.fs.Path(local), path)

    def get(self, key: str, local: str) -> bool:
        fs, path = self._at(key)
        if not fs.exists(path):
            return False
        fs.copyToLocalFile(False, path, self.jvm.org.apache.hadoop.fs.Path(local), True)
        return True

    def put_folder(self, key: str, local: str) -> list[str]:
        """All files of a local folder, under their paths below it; the keys."""
        keys = []
        for path in sorted(p for p in Path(local).rglob("*") if p.is_file()):
            keys.append(f"{key}/{path.relative_to(local).as_posix()}")
            self.put(keys[-1], str(path))
        return keys
