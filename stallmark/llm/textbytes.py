"""Whole-batch text work on UTF-8 bytes, shared by the operators of this subpackage.

Texts arrive as Arrow columns; their bytes are used in place as one numpy array for about
``SLICE`` bytes of documents at a time, so memory does not follow the Arrow batch, and a
document longer than that gets a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 1 << 20

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that only white space ends: [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words of letters, digits and anything that is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow: list[np.ndarray] = []


class Slice(NamedTuple):
    """Rows ``lo`` to ``hi`` of a batch: their bytes, and where each row begins (one more than rows)."""

    lo: int
    hi: int
    data: np.ndarray
    at: np.ndarray


class Words(NamedTuple):
    """First byte, byte after the last, and row of every word of a slice."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[Slice]:
    """Consecutive rows of about ``most`` bytes. A null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield Slice(lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> Words:
    """Maximal runs of bytes for which ``kind`` holds; a run ends where its row does."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none)
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = kind[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = at[(at > 0) & (at < len(data))]
    begins = inside & ~before
    begins[edges] = inside[edges]
    ends = before & ~inside
    ends[edges] |= before[edges]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return Words(start, end, np.searchsorted(at, start, "right") - 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        size = max(n, SLICE + 4096)
        _pow[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_STEP, _BACK)]
    return _pow[0], _pow[1]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit digests of byte spans, the same for equal bytes anywhere."""
    if not len(start):
        return np.zeros(0, np.uint64)
    forth, back = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * forth[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_of(text: str, lower: bool = True) -> int:
    """The digest that ``hashes`` gives for one span."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(hashes(LOWER[data] if lower else data, np.zeros(1, np.int64), np.full(1, len(data), np.int64))[0])


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)


def rows_of(table: pa.Table | pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """One record batch with exactly ``schema``."""
    return pa.RecordBatch.from_arrays([table.column(f.name).cast(f.type) for f in schema], schema=schema)
