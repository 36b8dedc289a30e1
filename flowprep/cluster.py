"""What a cluster needs to run Python functions of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_sent: dict[str, str] = {}


def _own_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, which goes when the application ends."""
    path = f"{shared_dir(spark)}/flowprep/{label}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialised(df: DataFrame, label: str) -> DataFrame:
    """df as a table of files in the shared folder: computed once, and read again when an executor is lost."""
    path = _own_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int, label: str) -> DataFrame:
    """df as a table in the shared folder, dealt to buckets by its keys and sorted by them: tables that are bucketed alike
    are joined and grouped by the keys without a shuffle."""
    name = f"flowprep_{label}_{uuid.uuid4().hex}"
    held = df.repartition(buckets, *[F.col(f"`{k}`") for k in keys]).write.bucketBy(buckets, *keys).sortBy(*keys)
    held.format("parquet").option("path", _own_path(df.sparkSession, label)).saveAsTable(name)
    return df.sparkSession.table(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='flowprep-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once for each application."""
    context = spark.sparkContext
    if _sent.get("app") == context.applicationId:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="flowprep-src-"), "flowprep.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(here)))
    context.addPyFile(path)
    _sent["app"] = context.applicationId
