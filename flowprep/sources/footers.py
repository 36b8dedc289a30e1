"""What the ends of Parquet files say, as a table: executors read the footers of their share of the files, never their rows.

Stores that Arrow knows (local and shared folders, HDFS, S3, GCS) are read by the executors. Others are left to a pool of threads of the
driver's JVM, which knows all that Spark knows; rows, groups and columns come from there too, but no bounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import ship

_STATS = T.StructType([T.StructField("column", T.StringType()), T.StructField("nulls", T.LongType()), T.StructField("low", T.StringType()), T.StructField("high", T.StringType())])
#: One row a row group (or one with a null row_group for a file without any): the file's columns in order, the group's rows and bytes,
#: and of each flat column its nulls and bounds as text, null where the file doesn't say.
SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("columns", T.ArrayType(T.StringType())), T.StructField("row_group", T.IntegerType()), T.StructField("n_rows", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("stats", T.ArrayType(_STATS))])
#: Files whose footers a task reads.
SHARE = 64


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path, and the path in it."""
    uri = "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    return pafs.FileSystem.from_uri(uri)


def groups_of(path: str) -> list[dict[str, Any]]:
    """SCHEMA rows of one file."""
    store, at = opened(path)
    with store.open_input_file(at) as source:
        said = pq.read_metadata(source)
    names = [f.name for f in said.schema.to_arrow_schema()]
    out = []
    for g in range(said.num_row_groups):
        group, stats = said.row_group(g), []
        for c in range(group.num_columns):
            column = group.column(c)
            if column.path_in_schema in names:
                s = column.statistics
                bounds = (str(s.min), str(s.max)) if s is not None and s.has_min_max else (None, None)
                stats.append({"column": column.path_in_schema, "nulls": s.null_count if s is not None and s.has_null_count else None, "low": bounds[0], "high": bounds[1]})
        out.append({"path": path, "columns": names, "row_group": g, "n_rows": group.num_rows, "bytes": group.total_byte_size, "stats": stats})
    return out or [{"path": path, "columns": names, "row_group": None, "n_rows": 0, "bytes": 0, "stats": []}]


def read_by_driver(spark: SparkSession, files: Sequence[str]) -> list[tuple]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    statuses, asked = jvm.java.util.ArrayList(), {}
    for f in files:
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        asked[status.getPath().toString()] = f
        statuses.add(status)
    rows: list[tuple] = []
    for f in jvm.org.apache.parquet.hadoop.ParquetFileReader.readAllFootersInParallel(conf, statuses):
        said, path = f.getParquetMetadata(), asked[f.getFile().toString()]
        names = [c.getName() for c in said.getFileMetaData().getSchema().getFields()]
        blocks = list(said.getBlocks())
        rows += [(path, names, g, b.getRowCount(), b.getTotalByteSize(), []) for g, b in enumerate(blocks)] or [(path, names, None, 0, 0, [])]
    return rows


def footer_table(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """SCHEMA rows of all files."""
    if not files:
        return spark.createDataFrame([], SCHEMA)
    try:
        opened(files[0])
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return spark.createDataFrame(read_by_driver(spark, files), SCHEMA)
    ship(spark)
    form = pa.schema([("path", pa.string()), ("columns", pa.list_(pa.string())), ("row_group", pa.int32()), ("n_rows", pa.int64()), ("bytes", pa.int64()), ("stats", pa.list_(pa.struct([("column", pa.string()), ("nulls", pa.int64()), ("low", pa.string()), ("high", pa.string())])))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(groups_of(path), schema=form)

    paths = spark.createDataFrame([(f,) for f in files], "path string").repartition(-(-len(files) // SHARE))
    return paths.mapInArrow(read, SCHEMA)


def schemas(table: DataFrame) -> DataFrame:
    """(columns, n_files, n_rows, first): each list of columns that files have, and the first file that has it."""
    files = table.groupBy("path", "columns").agg(F.sum("n_rows").alias("n"))
    return files.groupBy("columns").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_rows"), F.min("path").alias("first"))


def bounds(table: DataFrame, column: str, kind: str) -> DataFrame:
    """(n_rows, nulls, low, high) of a column over all files, without reading a row; of a type that text can be cast to."""
    groups = table.select("n_rows", F.filter("stats", lambda s: s["column"] == column)[0].alias("s"))
    return groups.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.sum("s.nulls").alias("nulls"), F.min(F.col("s.low").cast(kind)).alias("low"), F.max(F.col("s.high").cast(kind)).alias("high"))
