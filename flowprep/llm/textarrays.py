"""Words of Arrow texts as numpy arrays: places in the bytes, owners, 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: [\x20\x09-\x0D]
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes of words that are hashed at a time; no table of powers is longer.
HASH_BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(8)
def byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


@lru_cache(64)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def power_table(base: int, n: int) -> np.ndarray:
    return powers(base, 1 << max(6, int(n).bit_length()))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row, and where each text starts (one more at the end)."""
    if pa.types.is_large_string(texts.type):
        width = np.int64
    else:
        texts, width = texts.cast(pa.string()), np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each text: the number of its first word; one more at the end

    def hashes(self, seed: int = 1, base: int = 0x9E3779B97F4A7C55) -> np.ndarray:
        """A 64-bit hash of each word's bytes, in blocks of bounded memory: a word beyond a block is summed up in parts."""
        out, lens, codes = np.empty(len(self.starts), U), self.ends - self.starts, byte_codes(seed)
        at, total = 0, np.cumsum(lens)
        while at < len(lens):
            if lens[at] > HASH_BLOCK:
                out[at] = self._long(int(self.starts[at]), int(self.ends[at]), codes, base)
                at += 1
                continue
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HASH_BLOCK, side="right")))
            n = lens[at:to]
            place = np.cumsum(n) - n
            inner = np.arange(int(n.sum())) - np.repeat(place, n)
            raw = self.data[inner + np.repeat(self.starts[at:to], n)]
            out[at:to] = np.add.reduceat(codes[raw] * power_table(base, int(n.max()))[inner], place) + n.astype(U)
            at = to
        return mix(out)

    def _long(self, start: int, end: int, codes: np.ndarray, base: int) -> np.uint64:
        table, out = power_table(base, HASH_BLOCK)[:HASH_BLOCK], (end - start) & (1 << 64) - 1
        for a in range(start, end, HASH_BLOCK):
            part = codes[self.data[a : min(end, a + HASH_BLOCK)]]
            out += int((part * table[: len(part)]).sum()) * pow(base, a - start, 1 << 64)
        return U(out & (1 << 64) - 1)


def words_of(texts: pa.Array, gaps: np.ndarray = SPACES, lower: bool = False) -> Words:
    data, at = bytes_of(texts)
    if lower:
        data = LOWER[data]
    inside = ~gaps[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cut = at[(at > 0) & (at < len(data))]
    before[cut], after[cut - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    return Words(data, starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, at, side="left"))


def windows(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes; doubling takes log2(k) steps."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done, size, part = None, 0, 1, h
    table, left = power_table(base, k), k
    while left:
        if left & 1:
            take = part[done : done + n] * table[done]
            out, done = take if out is None else out + take, done + size
        left >>= 1
        if left:
            part = part[:-size] + part[size:] * table[size]
            size *= 2
    return mix(out)
