"""Ranks within streams of any size, without a task that sees a whole stream."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import materialised
from ..functions.columns import own_name

RANK, SIZE = "__rank", "__n"


def with_ranks(df: DataFrame, stream: Sequence[str], order: Sequence[Column], block: Column | None = None) -> DataFrame:
    """df with __rank (from 1) among its stream in an order, and __n, the stream's size.

    Rows are dealt to partitions by ranges of (stream, order) between sampled splitters, sorted there and written once with
    their places. A place holds the partition and the row's number in it, so a row's rank is its distance from the first row
    of its stream in the partition, and what the stream has in partitions before: a sum over a row for each partition and
    stream. No window and no task holds more rows than a range does, also if all rows are of one instant, or alike: rows
    that tie are numbered as they are read. Without an order, rows stay where they are and only the sums are shuffled.

    With a block (an expression that never falls along the order; nulls come first) nothing is written: rows are ranked
    within their block by a window, so blocks must be known to be small.
    """
    if block is not None:
        return _ranks_in_blocks(df, stream, order, block)
    kept, keys = df.columns, [F.col(f"`{s}`").asc_nulls_first() for s in stream]
    tie, place = own_name(kept, "tie"), own_name(kept, "place")
    if order:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        by = [*keys, *order, F.col(tie)]
        sorted_ = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by).drop(tie)
    else:
        sorted_ = df.sortWithinPartitions(*keys) if keys else df
    held = materialised(sorted_.withColumn(place, F.monotonically_increasing_id()), "ranks")
    part = F.shiftrightunsigned(place, 33)  # the partition's number: a row's number takes the low 33 bits
    own = [F.col(f"`{s}`").alias(f"s{i}") for i, s in enumerate(stream)]
    sums = held.groupBy(*own, part.alias("part")).agg(F.count("*").alias("c"), F.min(place).alias("first"))
    along = Window.partitionBy(*[f"s{i}" for i in range(len(stream))])
    before = F.coalesce(F.sum("c").over(along.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[f"s{i}" for i in range(len(stream))], "part", (before - F.col("first") + 1).alias("shift"), F.sum("c").over(along).alias("size"))
    rows = held.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], *own, F.col(place).alias("at"))
    same = reduce(lambda a, b: a & b, [rows[f"s{i}"].eqNullSafe(sums[f"s{i}"]) for i in range(len(stream))], F.shiftrightunsigned(rows["at"], 33) == sums["part"])
    return rows.join(sums, same).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], (F.col("at") + F.col("shift")).alias(RANK), F.col("size").alias(SIZE))


def _ranks_in_blocks(df: DataFrame, stream: Sequence[str], order: Sequence[Column], block: Column) -> DataFrame:
    kept = df.columns
    blocked = df.withColumn("__blk", block)
    along = Window.partitionBy(*stream)
    sizes = blocked.groupBy(*stream, "__blk").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(along.orderBy(F.col("__blk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sizes.select(*[F.col(s).alias(f"__s{i}") for i, s in enumerate(stream)], F.col("__blk").alias("__b"), before.alias("__before"), F.sum("__c").over(along).alias(SIZE))
    inner = blocked.withColumn("__r", F.row_number().over(Window.partitionBy(*stream, "__blk").orderBy(*order)))
    same = [F.col(s).eqNullSafe(F.col(f"__s{i}")) for i, s in enumerate(stream)] + [F.col("__blk").eqNullSafe(F.col("__b"))]
    return inner.join(places, reduce(lambda a, b: a & b, same)).select(*kept, (F.col("__r") + F.col("__before")).alias(RANK), SIZE)


#: Whole numbers that agree but for their last 16 bits share a block.
NEAR = 16


def time_block(df: DataFrame, time: str, position: str | None = None) -> Column | None:
    """Parts of the order by a time: hours, days, whole parts of numbers, or the first 13 characters of texts. Rows without a
    time, which come first, are parted by a whole-number position."""
    kind, t = df.schema[time].dataType, F.col(time)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        block = F.date_trunc("hour", t)
    elif isinstance(kind, (T.DateType, T.BooleanType)):
        block = t
    elif isinstance(kind, T.IntegralType):
        block = F.shiftright(t.cast("long"), NEAR)
    elif isinstance(kind, (T.FractionalType)):
        block = F.when(F.isnan(t.cast("double")), F.lit(1 << 62)).otherwise(F.floor(t.cast("double")))
    elif isinstance(kind, T.StringType):
        block = F.substring(t, 1, 13)
    else:
        return None
    if position is None or not isinstance(df.schema[position].dataType, T.IntegralType):
        return block
    return F.struct(block.alias("t"), F.when(t.isNull(), F.shiftright(F.col(position).cast("long"), NEAR)).otherwise(0).alias("p"))


def with_previous(df: DataFrame, stream: Sequence[str], position: str, value: str, name: str) -> DataFrame:
    """df with the value of the row before it in its stream (null for the first), by a whole-number position.

    Rows look back within their block of positions; a block's first row looks at the last one of the block before. A window
    holds the rows of a block, or a row for each block of a stream.
    """
    blocked = df.withColumn("__blk", F.shiftright(F.col(position).cast("long"), NEAR))
    held = F.struct(F.col(value).alias("v"))  # not null, whatever the value
    last = blocked.groupBy(*stream, "__blk").agg(F.max_by(held, F.col(position)).alias("__last"))
    before = F.lag("__last").over(Window.partitionBy(*stream).orderBy("__blk"))
    before = last.select(*[F.col(s).alias(f"__s{i}") for i, s in enumerate(stream)], F.col("__blk").alias("__b"), before.alias("__before"))
    inner = blocked.withColumn("__own", F.lag(held).over(Window.partitionBy(*stream, "__blk").orderBy(position)))
    same = [F.col(s).eqNullSafe(F.col(f"__s{i}")) for i, s in enumerate(stream)] + [F.col("__blk").eqNullSafe(F.col("__b"))]
    return inner.join(before, reduce(lambda a, b: a & b, same)).select(*df.columns, F.coalesce("__own", "__before")["v"].alias(name))


def digest_block(digest: Column) -> Column:
    """The first three hex digits of a digest: 4096 even blocks along its order."""
    return F.substring(digest, 1, 3)
