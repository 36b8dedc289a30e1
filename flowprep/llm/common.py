"""Shared helpers: tables cut from their lineage, Arrow maps over texts, row keys."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, nullcontext
from contextvars import ContextVar
from threading import Lock

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowprep.cluster import shared_dir, ship

#: Bytes of text that an Arrow function handles at a time (a longer text is handled alone).
BLOCK_BYTES = 2 << 20


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _store(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


#: The folders that each open scratch() of this thread or task has seen written, innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open scratches", default=())


#: Sessions whose Arrow batches are bounded now: how many writes ask for it, and the setting before.
_bounded: dict[int, list] = {}
_bounding = Lock()
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def batches_of(spark: SparkSession, most: int):
    """Jobs of this session send Arrow batches of about so many bytes, or one row, to Python functions in the meantime. Results
    don't depend on it; writes of several threads share the bound until the last of them ends."""
    with _bounding:
        held = _bounded.setdefault(id(spark), [0, spark.conf.get(BATCH_SETTING)])
        held[0] += 1
        spark.conf.set(BATCH_SETTING, str(most))
    try:
        yield
    finally:
        with _bounding:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(BATCH_SETTING, _bounded.pop(id(spark))[1])


def written(df: DataFrame, label: str, batch_bytes: int | None = None) -> DataFrame:
    """df as a table in the shared folder: later jobs read files instead of recomputing, and survive lost executors.

    It goes when the application ends at the latest, and with the scratch() it was written in if nothing reads it then.
    batch_bytes: for wide rows that go through Python functions, of which 10,000 may be too much at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flowprep/{label}-{uuid.uuid4().hex}"
    with batches_of(spark, batch_bytes) if batch_bytes else nullcontext():
        df.write.parquet(path)
    fs, p = _store(spark, path)
    fs.deleteOnExit(p)
    if _open.get():
        _open.get()[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def roots_of(df: DataFrame) -> list[str]:
    """The folders that a data frame's plan reads."""
    found, leaves = [], df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            paths = leaf.relation().location().rootPaths()
            found += [paths.apply(k).toString() for k in range(paths.size())]
    return found


def delete_tables(spark: SparkSession, paths: Sequence[str]) -> None:
    for path in paths:
        fs, p = _store(spark, path)
        fs.delete(p, True)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    delete_tables(spark, [path for t in tables for path in roots_of(t) if "/flowprep/" in path])


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside go at the end, but for those that the frames handed to the yielded function read."""
    made: list[str] = []
    kept: list[DataFrame] = []
    around = _open.get()
    _open.set((*around, made))
    try:
        yield kept.append
    finally:
        _open.set(around)
        needed = {path.rpartition("/")[2] for df in kept for path in roots_of(df)}
        stays = [path for path in made if path.rpartition("/")[2] in needed]
        delete_tables(spark, [path for path in made if path not in stays])
        if around:
            around[-1].extend(stays)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on a data frame that leaves no tables behind but those its result reads."""

    @functools.wraps(operator)
    def call(df: DataFrame, *args, **named) -> DataFrame:
        with scratch(df.sparkSession) as keep:
            out = operator(df, *args, **named)
            keep(out)
        return out

    return call


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns called c0, c1 and so on, so that no name of a caller's meets one of ours."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def text_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Rows of two frames whose columns are equal, nulls too."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


def text_blocks(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most limit bytes together, or that hold one row."""
    n, at = batch.num_rows, 0
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    total = np.cumsum(sizes)
    while at < n:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Return freed memory to the system: Spark keeps a worker for a minute after its task, with all that it once had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def _inputs(df: DataFrame, text_col: str, columns: Sequence[Column]) -> DataFrame:
    return df.select(*[c.alias(f"k{i}") for i, c in enumerate(columns)], text_of(quoted(text_col)).alias("text"))


def map_texts(df: DataFrame, text_col: str, keep: Sequence[tuple[str, Column]], fields: list[T.StructField], fn: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """The kept columns and what fn makes of each block of texts (null: empty), row by row."""
    src, k = _inputs(df, text_col, [c for _, c in keep]), len(keep)
    schema = T.StructType([T.StructField(n, src.schema[i].dataType) for i, (n, _) in enumerate(keep)] + fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_blocks(batch, k):
                yield pa.RecordBatch.from_arrays([*part.columns[:k], *fn(part.column(k))], names=names)

    return arrow_map(src, run, schema)


def flat_map_texts(df: DataFrame, text_col: str, inputs: Sequence[Column], schema: T.StructType, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch] | None], only: tuple[KeyFilter, Column] | None = None) -> DataFrame:
    """Any number of rows for each block: fn gets the inputs and, last, the texts (null: empty), and makes one batch, several, or none.

    only: a filter and the hash that it tests; rows it surely lacks are left out. It is tested by the worker that runs fn, where
    KeyFilter.split() would take a second one for each task.
    """
    src, k = _inputs(df, text_col, [*inputs, *([only[1]] if only else [])]), len(inputs)
    handed = df.sparkSession.sparkContext.broadcast(only[0]) if only else None  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if handed:
                held = pa.array(handed.value.has(batch.column(k).to_numpy(zero_copy_only=False)))
                batch = pa.RecordBatch.from_arrays([*batch.columns[:k], batch.column(k + 1)], names=[*batch.schema.names[:k], "text"]).filter(held)
            for part in text_blocks(batch, k):
                out = fn(part)
                for one in [out] if isinstance(out, pa.RecordBatch) else out or ():
                    yield from (one.slice(i, 1 << 17) for i in range(0, one.num_rows, 1 << 17))

    return arrow_map(src, run, schema)


#: A filter has about so many bits for each key, a power of two between these bounds: 64 KB to 32 MB.
FILTER_BITS_EACH, FILTER_LEAST, FILTER_MOST = 10, 1 << 19, 1 << 28
FILTER_HASHES = 3


class KeyFilter:
    """A Bloom filter over hashes of 64 bits, sized by the number of keys up to a bound. One beyond its bound lets more
    pass: results never depend on it, only how many rows a later exact join has to move."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, 64 * len(words)

    @staticmethod
    def of(hashes: DataFrame, column: str) -> KeyFilter:
        """Bits are gathered on the executors; at most FILTER_MOST / 64 words reach the driver."""
        keys = hashes.count()  # of a written table: read from its files' footers
        size = max(FILTER_LEAST, min(FILTER_MOST, 1 << (FILTER_BITS_EACH * keys).bit_length()))
        at = [F.shiftrightunsigned(quoted(column), 18 * i).bitwiseAND(F.lit(size - 1)) for i in range(FILTER_HASHES)]
        bits = hashes.select(F.explode(F.array(*at)).alias("b")).select(F.expr("b div 64").alias("w"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("m"))
        got = bits.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
        words = np.zeros(size // 64, np.int64)
        words[got["w"].to_numpy()] = got["m"].to_numpy()
        return KeyFilter(words.view(np.uint64))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out, h = np.ones(len(hashes), bool), hashes.view(np.uint64)
        for i in range(FILTER_HASHES):
            b = (h >> np.uint64(18 * i)) & np.uint64(self.bits - 1)
            out &= (self.words[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1
        return out

    def split(self, df: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
        """The rows of df whose hash may be among the keys, and the rows whose hash surely isn't."""
        ship(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("boolean")
        def maybe(h: pa.Array) -> pa.Array:
            return pa.array(shared.value.has(h.to_numpy(zero_copy_only=False)))

        return df.where(maybe(key)), df.where(~maybe(key))
