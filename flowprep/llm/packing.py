"""Best-fit packing by a plan over the histogram of lengths.

Documents become pieces of at most `size` tokens. Only the histogram of piece lengths (at most `size` rows) reaches
the driver. Best fit, longest first, is run over counts: open sequences with equal room form a group, an item goes to
the group with the least room that still takes it, and a whole group is filled in one step. The plan is a list of
slots (length, first and last rank, sequences, offset); its size depends on `size`, not on the number of documents.
A piece's rank within its length is its rank within its task plus the pieces of that length in earlier tasks, so no
task sees all pieces of a length. Then each piece takes its slot by length and rank.

Cases: a null or empty text is the end id alone; very long texts are cut into full pieces after a first, shorter one; a run
of white space of any length is encoded apart, with the same ids; repeated rows and ties are packed separately, in the
order the table is read; ids of any type and null ids are handed on as they are; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, quoted, text_blocks, text_of, tidy, written
from .token_counts import WHITE

#: A run of so much white space is a piece that is encoded apart: the library's pattern would need a stack as deep as the run.
LONG_RUN = 1 << 16
RUNS = re.compile(f"[{''.join(map(chr, WHITE))}]{{{LONG_RUN},}}")


@lru_cache(2)
def encoding(ranks_path: str):
    """The vocabulary of byte_bpe_50k as tiktoken ranks: the same ids as the tokenizers file gives (tested), several times as fast."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def token_ids(text: str, ranks_path: str, special: bool = True) -> np.ndarray:
    """The ids of a text; with special, special strings in it are the ids they stand for.

    White space before a word is a piece without its last character, which goes with the word; at the end it is whole.
    """
    coder = encoding(ranks_path)
    known = {"allowed_special": "all"} if special else {"disallowed_special": ()}
    if len(text) < LONG_RUN or not RUNS.search(text):
        return coder.encode_to_numpy(text, **known).astype("<u4")
    parts, at = [], 0
    for m in RUNS.finditer(text):
        whole = m.end() == len(text) or special and any(text.startswith(x, m.end()) for x in coder.special_tokens_set)
        end = m.end() - (not whole)
        parts.append(coder.encode_to_numpy(text[at : m.start()], **known))
        parts.append(np.array(coder._core_bpe.encode_single_piece(text[m.start() : end].encode()), np.uint32))
        at = end
    parts.append(coder.encode_to_numpy(text[at:], **known))
    return np.concatenate(parts).astype("<u4")


def plan_slots(histogram: dict[int, int], size: int) -> np.ndarray:
    """Rows (length, first rank, last rank + 1, first sequence, items in each sequence, offset), by length and first rank."""
    slots, rooms, sequences = [], {}, 0  # rooms: room -> [(first sequence, sequences)]
    heap: list[int] = []

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in rooms:
                rooms[room] = []
            rooms[room].append((first, n))

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0
        heap = [r for r in rooms if r >= length]
        heapq.heapify(heap)
        while left:
            while heap and not rooms.get(heap[0]):
                rooms.pop(heapq.heappop(heap), None)
            if heap:
                room = heap[0]
                first, n = rooms[room].pop()
            else:
                room, first = size, sequences
                n = -(-left // (size // length))
                sequences += n
            each = room // length
            full = min(n, left // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each, size - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                slots.append((length, rank, rank + left, first + full, left, size - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, n - full)
    return np.array(sorted(slots), np.int64).reshape(-1, 6)


PIECE = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]


def pieces(df: DataFrame, ranks_path: str, size: int, end_id: int, text_col: str, id_col: str) -> DataFrame:
    src = df.select(quoted(id_col).alias("id"), text_of(quoted(text_col)).alias("text"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), *PIECE, T.StructField("task", T.IntegerType()), T.StructField("rank", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for part in text_blocks(batch, 1):
                rows, number, start, length, crc = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(token_ids(text, ranks_path), np.uint32(end_id)).astype("<u4")
                    n = -(-len(ids) // size)
                    cuts = [0, *range(len(ids) - size * (n - 1), len(ids) + 1, size)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(i)
                        number.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                sizes = np.array(length, np.int64)
                order = np.argsort(sizes, kind="stable")
                ranks, by = np.empty(len(sizes), np.int64), sizes[order]
                ranks[order] = np.arange(len(by)) - np.searchsorted(by, by) + seen[by]
                seen += np.bincount(sizes, minlength=size + 1)
                ids_out = part.column(0).take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids_out, pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()), pa.array([task] * len(rows), pa.int32()), pa.array(ranks)], names=schema.names)

    return arrow_map(src, run, schema)


@tidy
def pack(df: DataFrame, ranks_path: str, size: int = 1024, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    parts = written(pieces(df, ranks_path, size, end_id, text_col, id_col), "pieces")
    counts = parts.groupBy("length", "task").agg(F.count("*").alias("n"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    plan = plan_slots(total, size)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranked = parts.join(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), ["length", "task"])
    src = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    schema = T.StructType([src.schema["id"], *PIECE, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = 1 << 46
        keys = plan[:, 0] * stride + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            slot = plan[np.searchsorted(keys, length * stride + rank, side="right") - 1] if len(plan) else np.zeros((0, 6), np.int64)
            inner = rank - slot[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(slot[:, 3] + inner // slot[:, 4]), pa.array(slot[:, 5] + inner % slot[:, 4] * length)], names=schema.names)

    return arrow_map(src, run, schema).withColumnRenamed("id", id_col)


def op10_best_fit_packing(spark, sf_dir):
    """The documents' pieces in sequences of 1024 tokens."""
    import public_tokenizers

    from .common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
