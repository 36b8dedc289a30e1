"""SentencePiece encoding that keeps source offsets, and decoding.

A text is normalised here: at each place the longest prefix that the model's compiled character map has is replaced,
anything else is taken as it is, and every byte of the result remembers the byte it came from. The library merges the
normalised text, with a model whose own normaliser does nothing; its pieces, laid end to end, are that text, so each
projects to a span of the source. A model whose character map is empty, and that keeps white space, takes a path that is
vectorised whole; only blanks are marked there.

Cases: a null or empty text encodes to the end id alone and decodes to an empty text; very long texts are handled
alone; repeated rows each get a row; ids of any type and null ids are handed on as they are; an empty table gives no rows;
other columns are ignored, whatever their names. Models that mark words at their ends are refused.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts, quoted

MARK = "▁".encode()  # stands for a blank in pieces


def read_trie(blob: bytes) -> dict[bytes, bytes]:
    """All keys of a compiled character map: a Darts double array, then replacements that end with a zero byte."""
    if len(blob) < 4:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :]
    every = np.arange(1, 256)

    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    out, todo = {}, [(offset(int(units[0])), b"")]
    while todo:
        at, key = todo.pop()
        child = at ^ every
        inside = child < len(units)
        for byte in every[inside][units[child[inside]] & 0x800000FF == every[inside]].tolist():
            unit = int(units[at ^ byte])
            below, longer = at ^ byte ^ offset(unit), key + bytes([byte])
            if unit >> 8 & 1:
                where = int(units[below]) & 0x7FFFFFFF
                out[longer] = texts[where : texts.index(b"\0", where)]
            todo.append((below, longer))
    return out


class Normaliser:
    """Texts in the form that pieces are merged in, with the source byte of each byte."""

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, squeeze: bool = False, escape: bool = True, symbols: frozenset[bytes] = frozenset()):
        """symbols: strings that the model defines as pieces; they are never replaced."""
        self.map, self.dummy_prefix, self.squeeze = read_trie(charsmap), dummy_prefix, squeeze
        self.symbols, self.longest_symbol = symbols, max(map(len, symbols), default=0)
        self.blank = MARK if escape else b" "
        self.longest = max(map(len, self.map), default=0)
        self.first = {k[0] for k in self.map}

    def prefix(self, raw: bytes, at: int) -> tuple[bytes, int]:
        """The longest match at a place and its length in the source, else the character that stands there."""
        for n in range(min(self.longest_symbol, len(raw) - at), 0, -1):
            if raw[at : at + n] in self.symbols:
                return raw[at : at + n], n
        if raw[at] in self.first:
            for n in range(min(self.longest, len(raw) - at), 0, -1):
                if (found := self.map.get(raw[at : at + n])) is not None:
                    return found, n
        n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        return raw[at : at + n], n

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and the end) the source byte where it begins."""
        raw = text.encode()
        return self.plain(raw) if not self.map and not self.squeeze else self.mapped(raw)

    def plain(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        if not raw:
            return b"", np.zeros(1, np.int64)
        lead = self.blank if self.dummy_prefix else b""
        data = np.frombuffer(raw, np.uint8)
        width = np.where(data == 0x20, len(self.blank), 1)
        align = np.concatenate([np.zeros(len(lead), np.int64), np.repeat(np.arange(len(raw)), width), [len(raw)]])
        return lead + raw.replace(b" ", self.blank), align

    def mapped(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        at, end = 0, len(raw)
        parts: list[tuple[bytes, int]] = []  # replacement, source place
        while at < end:
            got, n = self.prefix(raw, at)
            parts.append((got, at))
            at += n
        if self.squeeze:
            while parts and not parts[0][0].strip(b" "):
                parts.pop(0)
        if not parts:
            return b"", np.full(1, end, np.int64)
        out, align = bytearray(), []
        if self.dummy_prefix:
            out += self.blank
            align += [parts[0][1]] * len(self.blank)
        was_blank = self.squeeze
        for got, place in parts:
            if was_blank:
                got = got.lstrip(b" ") if self.squeeze else got
            for byte in got:
                new = self.blank if byte == 0x20 else bytes([byte])
                out += new
                align += [place] * len(new)
            was_blank = (got[-1:] == b" " or (was_blank and not got)) and self.squeeze
        stop = end
        if self.squeeze:
            while out.endswith(self.blank):
                stop = align[len(out) - len(self.blank)]
                del out[-len(self.blank) :]
            del align[len(out) :]
        return bytes(out), np.array([*align, stop], np.int64)


class Pieces:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        if model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a model that marks words at their ends")
        spec, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece.Type
        symbols = frozenset(p.piece.encode() for p in model.pieces if p.type == kinds.USER_DEFINED)
        self.normalise = Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, symbols)
        self.width = np.array([1 if p.type == kinds.BYTE else 0 if p.type == kinds.CONTROL else len(p.piece.encode()) for p in model.pieces], np.int64)
        spec.name, spec.precompiled_charsmap, spec.normalization_rule_tsv = "identity", b"", ""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())  # takes texts as they are
        self.unknown, self.end = self.library.unk_id(), self.library.eos_id()
        self.shown = [str(i) for i in range(len(model.pieces))]

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The ids, and where each piece begins and ends in the source's bytes; the end id is empty at the end."""
        normal, align = self.normalise(text)
        shown = normal.decode()
        ids = self.merges.encode(shown, add_eos=True)
        widths = self.width[np.array(ids, np.int64)]
        if self.unknown in ids:  # an unknown piece covers what the library shows for it
            said = [len(x.encode()) for x in self.merges.encode(shown, out_type=str)]
            lost = np.flatnonzero(np.array(ids) == self.unknown)
            widths[lost] = np.array(said)[lost]
        ends = np.cumsum(widths)
        if int(ends[-1] if len(ends) else 0) != len(normal):
            raise ValueError("the pieces don't cover the normalised text")
        return ids, align[ends - widths], align[ends]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(df: DataFrame, model: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, ids, begins, ends (source bytes of each piece) of each row."""

    def fn(texts: pa.Array) -> list[pa.Array]:
        p = pieces(model)
        rows = [p.encode(t) for t in texts.to_pylist()]
        return [pa.array([r[0] for r in rows], pa.list_(pa.int32())), *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (1, 2))]

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), *(T.StructField(n, T.ArrayType(T.LongType())) for n in ("begins", "ends"))]
    return map_texts(df, text_col, [(id_col, quoted(id_col))], fields, fn)


def digest(df: DataFrame, model: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """What encode() makes, reduced where it is made: id, n_tokens, ids_sha256, decoded_sha256, spans_crc (of begins and ends)."""
    import zlib

    def fn(texts: pa.Array) -> list[pa.Array]:
        p, raw = pieces(model), texts.to_pylist()
        n, ids_sha, text_sha, crc = [], [], [], []
        for text in raw:
            ids, begins, ends = p.encode(text)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(p.shown.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(p.decode(ids).encode()).hexdigest())
            crc.append(zlib.crc32(ends.tobytes(), zlib.crc32(begins.tobytes())))
        return [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(crc, pa.int64())]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("spans_crc", T.LongType())]
    return map_texts(df, text_col, [(id_col, quoted(id_col))], fields, fn)


def op2_sentencepiece(spark, sf_dir):
    """The documents encoded and decoded with piece_bpe_32k.model."""
    import public_tokenizers

    from .common import table

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
