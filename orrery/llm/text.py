"""Vectorised word handling for Arrow batches of texts.

Words are runs of bytes other than space and \\x09-\\x0D in the UTF-8 text, so the whole
batch is cut and hashed with a few passes over one byte buffer instead of a Python loop
over words. Batches are handled in pieces of a megabyte, which bounds memory whatever
the batch size; only a single longer document makes a longer piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: What a shingle's hash so far is multiplied by.
TIMES = _M2


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


def pieces(batch: pa.RecordBatch, text_col: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of at most ``limit`` bytes of text each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.cumsum(pc.binary_length(batch.column(text_col)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < n:
        base = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


class Words:
    """The words of a piece of texts.

    ``blank`` marks further bytes to read as white space.

    ``buf`` holds the bytes (lower-cased A-Z on request) with eight bytes of padding, ``off``
    where each text begins, ``start`` and ``end`` where each word does, and ``first[i]`` the
    number of the first word of text ``i`` (one more entry than texts).
    """

    def __init__(self, texts: pa.Array, lower: bool = False, blank: np.ndarray | None = None):
        texts = texts.cast(pa.binary()) if not pa.types.is_binary(texts.type) else texts
        texts = texts.fill_null(b"")
        off = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        size = int(off[-1] - off[0])
        buf = np.zeros(size + 8, dtype=np.uint8)
        if size:
            raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[off[0] : off[-1]]
            buf[:size] = LOWER[raw] if lower else raw
        self.buf, self.off, self.size = buf, off - off[0], size
        inside = ~(SPACE if blank is None else SPACE | blank)[buf[:size]]
        cut = np.zeros(size + 1, dtype=bool)
        cut[self.off] = True
        before = np.zeros(size, dtype=bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | cut[:-1]))
        after = np.zeros(size, dtype=bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, self.off)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, from eight bytes at a time."""
        lanes = np.lib.stride_tricks.as_strided(self.buf[: self.size + 8].view(np.uint8), shape=(self.size + 1, 8), strides=(1, 1))
        size = self.end - self.start
        h = mix(size.astype(np.uint64) + _M1)
        at, left, who = self.start, size, slice(None)
        while len(at):
            lane = np.ascontiguousarray(lanes[at]).view("<u8").ravel()
            short = left < 8
            lane[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            h[who] = mix((h[who] ^ lane) + _M2)
            more = np.flatnonzero(left > 8)
            if not len(more):
                break
            who = more if isinstance(who, slice) else who[more]
            at, left = at[more] + 8, left[more] - 8
        return h

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), self.counts)


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive entries of ``h`` (order matters)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:m].copy()
    for i in range(1, n):
        out = mix(out * TIMES + h[i : i + m])
    return out


def code_point_ends(text: bytes) -> np.ndarray:
    """For each byte offset of a UTF-8 text, the number of code points that begin before it."""
    b = np.frombuffer(text, dtype=np.uint8)
    return np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
