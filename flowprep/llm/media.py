"""Media columns: Netpbm and BMP pictures to numpy, area resizing by integral images, NPY tiles, difference hashes.

decode() reads PBM, PGM and PPM (P1 to P6; a largest value of up to 255, to which samples are scaled, halves up) and
uncompressed BMP (8, 24, 32 bits, with headers of 12 or of 40 and more bytes; an alpha channel is left out). 16-bit samples and
other kinds of BMP are not read. area_resize() averages exactly over
fractional areas with an integral image kept only at the column bounds that are asked for, so its memory is a few
numbers for each row. tiles() writes a picture as a run of NPY files of bounded height, read back by read_tiles().

Cases: ids of any type and null ids are handed on as they are; null media, media of no known form and truncated media give null columns and ok = false; empty tables give no
rows; equal media give equal values; other columns are ignored, whatever their names. In payload_digest() a null or
empty text is a payload of 192 blanks.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map, map_texts, quoted

TILE_ROWS = 256
#: Bytes that a payload is a multiple of, as 64 pixels of 3 samples.
ROW_BYTES = 192


def decode_netpbm(blob: bytes) -> np.ndarray:
    kind = blob[1:2]
    wanted, at, fields = 2 if kind in b"14" else 3, 2, []
    token = re.compile(rb"(?:\s|#[^\n\r]*)*([0-9]+)")
    for _ in range(wanted):
        m = token.match(blob, at)
        if not m:
            raise ValueError("a Netpbm header that breaks off")
        fields.append(int(m[1]))
        at = m.end()
    width, height, top = fields[0], fields[1], fields[2] if wanted == 3 else 1
    depth = 3 if kind in b"36" else 1
    n = width * height * depth
    if not 0 < top < 256 or not n:
        raise ValueError("not 8-bit samples")
    if kind == b"1":
        raw = np.frombuffer(re.sub(rb"[^01]", b"", blob[at:])[:n], np.uint8) - 0x30
        raw = (1 - raw) * 255
    elif kind in b"23":
        raw = scaled(np.array(re.sub(rb"#[^\n\r]*", b"", blob[at:]).split()[:n], dtype=np.int64), top)
    elif kind == b"4":
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, -(-width // 8) * height, at + 1).reshape(height, -1), axis=1)
        raw = (1 - bits[:, :width]) * 255
    else:
        raw = scaled(np.frombuffer(blob, np.uint8, n, at + 1), top)
    return raw.reshape(height, width, depth)


def scaled(samples: np.ndarray, top: int) -> np.ndarray:
    """Samples of 0 to top as 0 to 255, halves up; ValueError if one is above."""
    if len(samples) and (samples.min() < 0 or samples.max() > top):
        raise ValueError("a sample above the largest value")
    return samples.astype(np.uint8, copy=False) if top == 255 else ((samples.astype(np.int64) * 510 + top) // (2 * top)).astype(np.uint8)


def decode_bmp(blob: bytes) -> np.ndarray:
    start, head = struct.unpack_from("<10xII", blob)
    width, height, _, bits = struct.unpack_from("<HHHH" if head == 12 else "<iiHH", blob, 18)
    packed = struct.unpack_from("<I", blob, 30)[0] if head >= 20 else 0
    colours = struct.unpack_from("<I", blob, 46)[0] if head >= 36 else 0
    if head < 12 or packed or bits not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError("a BMP of a kind that isn't read")
    line = (width * bits // 8 + 3) // 4 * 4
    raw = np.frombuffer(blob, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : width * bits // 8]
    raw = raw.reshape(abs(height), width, bits // 8)
    if bits == 8:
        each = 3 if head == 12 else 4  # bytes of a colour
        palette = np.zeros((256, each), np.uint8)  # what a short palette lacks is black
        given = np.frombuffer(blob, np.uint8, min(each * (colours or 256), max(start - 14 - head, 0)) // each * each, 14 + head).reshape(-1, each)[:256]
        palette[: len(given)] = given
        raw = palette[raw[:, :, 0]]
    return raw[:: -1 if height > 0 else 1, :, 2::-1]


def decode(blob: bytes) -> np.ndarray:
    """uint8 samples by row, column and channel."""
    if blob[:1] == b"P" and blob[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return decode_netpbm(blob)
    if blob[:2] == b"BM":
        return decode_bmp(blob)
    raise ValueError("neither Netpbm nor BMP")


def bounds(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The place k * n / parts for each k: its whole number and the rest in units of 1 / parts."""
    at = np.arange(parts + 1, dtype=np.int64) * n
    return at // parts, at % parts


def integral_at(sums: np.ndarray, whole: np.ndarray, rest: np.ndarray, parts: int) -> np.ndarray:
    """Values times parts of a running sum (along axis 0) at fractional places."""
    nxt = np.minimum(whole + 1, len(sums) - 1)
    rest = rest.reshape(-1, *[1] * (sums.ndim - 1))
    return sums[whole] * (parts - rest) + sums[nxt] * rest


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area averages as float64 by row, column and channel; rows are taken in blocks."""
    rows, columns, depth = image.shape
    whole, rest = bounds(columns, width)
    sums = np.zeros((rows + 1, width, depth), np.int64)
    for a in range(0, rows, 4096):
        part = np.zeros((columns + 1, min(4096, rows - a), depth), np.int64)
        np.cumsum(image[a : a + 4096].transpose(1, 0, 2), axis=0, dtype=np.int64, out=part[1:])
        sums[a + 1 : a + 1 + part.shape[1]] = np.diff(integral_at(part, whole, rest, width), axis=0).transpose(1, 0, 2)
    np.cumsum(sums, axis=0, out=sums)
    cells = np.diff(integral_at(sums, *bounds(rows, height), height), axis=0)
    return cells / (rows * columns)


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 area averages is darker than the next to the right."""
    grey = area_resize(image, 8, 9).sum(axis=2)
    return np.packbits(grey[:, 1:] > grey[:, :-1]).tobytes().hex()


def tiles(image: np.ndarray, rows: int = TILE_ROWS) -> Iterator[bytes]:
    for a in range(0, len(image), rows):
        out = io.BytesIO()
        np.save(out, np.ascontiguousarray(image[a : a + rows]), allow_pickle=False)
        yield out.getvalue()


def read_tiles(blob: bytes) -> np.ndarray:
    """The picture in a run of NPY files."""
    src, parts = io.BytesIO(blob), []
    while src.tell() < len(blob):
        parts.append(np.load(src, allow_pickle=False))
    return np.concatenate(parts)


def media_columns(df: DataFrame, media_col: str = "media", id_col: str = "id", height: int = 8, width: int = 8) -> DataFrame:
    """id, ok, height, width, channels, resized (area averages), tiles (NPY, the whole picture), dhash of each picture."""
    src = df.select(quoted(id_col).alias("id"), quoted(media_col).cast("binary").alias("media"))
    fields = [("ok", T.BooleanType()), ("height", T.IntegerType()), ("width", T.IntegerType()), ("channels", T.IntegerType()), ("resized", T.ArrayType(T.DoubleType())), ("tiles", T.ArrayType(T.BinaryType())), ("dhash", T.StringType())]
    schema = T.StructType([src.schema["id"], *(T.StructField(*f) for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.binary()), pa.string()]
        for batch in batches:
            for i in range(batch.num_rows):  # a picture at a time: one may be large
                blob = batch.column(1)[i].as_py()
                try:
                    image = decode(blob or b"")
                    row = [True, *image.shape, area_resize(image, height, width).ravel().tolist(), list(tiles(image)), difference_hash(image)]
                except (ValueError, struct.error, OverflowError):
                    row = [False] + [None] * 6
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([v], k) for v, k in zip(row, kinds, strict=True))], names=schema.names)

    return arrow_map(src, run, schema).withColumnRenamed("id", id_col)


def as_ppm(payload: bytes) -> bytes:
    return b"P6\n64 %d\n255\n" % (len(payload) // ROW_BYTES) + payload


def payload_digest(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Texts as pictures of 64 columns, decoded from PPM, stored as NPY tiles and read back; see the columns below."""

    def fn(texts: pa.Array) -> list[pa.Array]:
        cols: list[list] = [[] for _ in range(7)]
        for text in texts.cast(pa.binary()):
            raw = text.as_py()
            payload = raw + b" " * (-len(raw) % ROW_BYTES or (0 if raw else ROW_BYTES))
            image = decode(as_ppm(payload))
            stored = b"".join(tiles(image))
            image = read_tiles(stored)
            back = image.tobytes()
            row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(image))
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        return [pa.array(c, pa.string() if i in (2, 5, 6) else pa.int64()) for i, c in enumerate(cols)]

    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    fields = [T.StructField(n, T.StringType() if i in (2, 5, 6) else T.LongType()) for i, n in enumerate(names)]
    return map_texts(df, text_col, [(id_col, quoted(id_col))], fields, fn)


def op4_media(spark, sf_dir):
    """The documents as pictures."""
    from .common import table

    return payload_digest(table(spark, sf_dir, "documents"))
