"""The operators that make sense on an unbounded input, as structured streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import col


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_each: int = 1) -> DataFrame:
    """Shards as they come, a few files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def minute_counts(events: DataFrame, time: str, by: Sequence[str] = (), late: str = "10 minutes", every: str = "1 minute") -> DataFrame:
    """(window start, by, n): rows of each minute; rows later than the watermark are left out."""
    marked = events.withWatermark(time, late)
    return marked.groupBy(F.window(time, every).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), *by, "n")


def first_within(events: DataFrame, time: str, columns: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each set of twins that come within the watermark; state is dropped behind it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(columns))


def session_counts(events: DataFrame, time: str, by: Sequence[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(by, first, last, n): runs of rows without a longer gap."""
    marked = events.withWatermark(time, late)
    return marked.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n")


def label_counts(events: DataFrame, label: Column | str) -> DataFrame:
    return events.groupBy(col(label).alias("label")).agg(F.count("*").alias("n"))


class Changed(RuntimeError):
    """A checkpoint of another configuration."""


def guard(spark: SparkSession, checkpoint: str, fingerprint: str) -> None:
    """Note the configuration's fingerprint beside a checkpoint; Changed if another one is noted there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint.rstrip("/") + ".fingerprint")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        noted = spark.read.text(at.toString()).first()[0]
        if noted != fingerprint:
            raise Changed(f"{checkpoint} was made by {noted}, not by {fingerprint}")
        return
    out = fs.create(at, False)
    out.write(bytearray(fingerprint.encode()))
    out.close()


def run_available(out: DataFrame, path: str, checkpoint: str, mode: str = "append", fingerprint: str | None = None) -> StreamingQuery:
    """Work off all that is there as Parquet, then stop; a later call goes on from the checkpoint.

    With a configuration's fingerprint, a later call with another one is refused.
    """
    if fingerprint is not None:
        guard(out.sparkSession, checkpoint, fingerprint)
    query = out.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
