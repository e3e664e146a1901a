"""Vectorised work on the UTF-8 bytes of an Arrow text column.

A column becomes one byte buffer with document offsets; words are spans of it,
and hashes of spans come from one prefix polynomial. Two multipliers give 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes of text a task works on at a time.
SLICE_BYTES = 3 << 20
#: Values whose prefixes span_hash holds at once.
STRETCH = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = int(offsets[0]) if len(offsets) else 0
    return raw[lo : int(offsets[-1])], offsets - lo


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about limit bytes; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document index) of the runs of non-space bytes; none crosses documents."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~SPACE[raw]
    begin = ink.copy()
    begin[1:] &= ~ink[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    begin[edges] = ink[edges]
    starts = np.flatnonzero(begin)
    stop = ink.copy()
    stop[:-1] &= ~ink[1:]
    stop[edges - 1] = ink[edges - 1]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        p = MULTIPLIERS[which]
        inverse = np.uint64(pow(int(p), -1, 1 << 64))
        with np.errstate(over="ignore"):
            have = tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, x, np.uint64)))) for x in (p, inverse))
        _POWERS[which] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
        return h


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of values[start:end] (bytes or 64-bit words) for many spans at once.

    Spans in ascending order are hashed a stretch of values at a time, so that the
    64-bit prefixes of a long buffer are never held whole.
    """
    if len(values) <= 2 * STRETCH or not len(starts) or (starts[1:] < starts[:-1]).any():
        return _span_hash(values, starts, ends, which)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + STRETCH)))
        base = starts[i]
        out[i:j] = _span_hash(values[base : ends[i:j].max()], starts[i:j] - base, ends[i:j] - base, which)
        i = j
    return out


def _span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    n = len(values)
    up, down = _powers(n + 1, which)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        part = values.astype(np.uint64)
        part += np.uint64(1)
        part *= up[:n]
        np.cumsum(part, out=prefix[1:])
        h = prefix[ends]
        h -= prefix[starts]
        h *= down[starts]
        h += (ends - starts).astype(np.uint64) * MULTIPLIERS[1 - which]
        return mix(h)


def fixed_hash(values: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of values[start:start + width], a few spans at a time."""
    powers = _powers(width, 0)[0][:width]
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), 1 << 13):
        part = values[starts[at : at + (1 << 13), None] + np.arange(width)].astype(np.uint64)
        with np.errstate(over="ignore"):
            out[at : at + (1 << 13)] = (part + np.uint64(1)) @ powers
    return mix(out)


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, counts)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values (van Herk): len(values) - width + 1 of them."""
    n = len(values)
    if n < width:
        return values[:0]
    if width == 1:
        return values
    pad = -n % width
    top = np.iinfo(values.dtype).max
    blocks = np.concatenate((values, np.full(pad, top, values.dtype))).reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])
