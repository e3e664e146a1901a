"""Burrows-Wheeler transforms of string collections, and their merge by interleave refinement.

A shard is a collection of byte strings, each closed by a terminator that sorts before
all bytes and differs from every other terminator. Its suffixes are sorted once, to a
fixed depth. Shards are merged without sorting their suffixes again: the interleave, the
merged order of the shards' rows, starts as a merge of the shards' sorted first symbols
and is refined by stable distributions of its transform's symbols, two in a round; an
interleave that is right for the first k symbols becomes right for k + 2. A border that
first appears between two rows when k grows means a common prefix that ends there, so
the rows without a border at `depth` are the intervals of equal prefixes of that length.
A row with borders on both sides stays alone in every later round and is dropped from
the interleave.
"""

from __future__ import annotations

import numpy as np


def _pack7(symbols: np.ndarray) -> np.ndarray:
    """The first seven 9-bit symbols at each place as one integer."""
    n = len(symbols)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        part = np.zeros(n, np.uint64)
        if k < n:
            part[: n - k] = symbols[k:]
        key = (key << np.uint64(9)) | part
    return key


def suffix_array(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys): places of symbols in the order of their suffixes' first `depth` symbols, ties by
    place, and the first seven symbols of each suffix in that order, 0 where a terminator is among them.

    Symbols are byte + 1, terminators 0. Prefixes are doubled until depth; only suffixes
    whose prefix is still shared are sorted again.
    """
    n = len(symbols)
    # what stands behind a terminator must not count: distance to the terminator bounds a prefix
    place = np.arange(n)
    stops = np.flatnonzero(symbols == 0)
    left = stops[np.searchsorted(stops, place)] - place
    key = _pack7(symbols)
    short = np.uint64(9) * (np.uint64(7) - np.minimum(left + 1, 7).astype(np.uint64))
    key = key >> short << short
    order = np.argsort(key, kind="stable")
    key = key[order]
    whole = np.where(left[order] >= 7, key, np.uint64(0))
    new = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    have = 7
    while have < depth:
        slots = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
        if not len(slots):
            break
        sub = order[slots]
        after = np.where(left[sub] >= have, rank[np.minimum(sub + have, n - 1)] + 1, 0)
        pair = rank[sub] * (n + 1) + after
        by = np.argsort(pair, kind="stable")
        sub, pair = sub[by], pair[by]
        fresh = np.concatenate(([True], pair[1:] != pair[:-1]))
        order[slots], new[slots] = sub, fresh
        rank[sub] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        have *= 2
    return order, whole


def transform(symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The symbol before each suffix; a string's first suffix has its terminator."""
    before = np.concatenate((symbols[-1:], symbols[:-1]))
    return before[places]


def _grouped(border: np.ndarray, *rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """The group of each row that is not alone between two borders, and those rows' values."""
    group = np.cumsum(border[:-1], dtype=np.int32)
    shared = ~(border[:-1] & border[1:])
    return (group[shared], *(x[shared] for x in rows))


def _borders(*values: np.ndarray) -> np.ndarray:
    border = np.ones(len(values[0]) + 1, bool)
    border[1:-1] = values[0][1:] != values[0][:-1]
    for v in values[1:]:
        border[1:-1] |= v[1:] != v[:-1]
    return border


def merge(transforms: list[np.ndarray], keys: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, group) of the rows, over the shards side by side, that share `depth` symbols with another row.

    keys: the first seven symbols of each row, 0 for a row that a terminator cuts short.
    Rows come in merged order, group by group.
    """
    symbol = np.concatenate(transforms)
    step = np.empty(len(symbol), np.int32)  # row of the suffix that has one symbol more in front
    at = 0
    for t in transforms:
        step[at + np.argsort(t, kind="stable")] = np.arange(at, at + len(t), dtype=np.int32)
        at += len(t)
    if depth >= 7:
        key = np.concatenate(keys)
        have, row = 7, np.flatnonzero(key).astype(np.int32)
        row = row[np.argsort(key[row], kind="stable")]  # sorted runs: a merge
        group, row = _grouped(_borders(key[row]), row)
    else:
        have, row, group = 0, np.arange(len(symbol), dtype=np.int32), np.zeros(len(symbol), np.int32)
    wide = np.uint16 if symbol.dtype == np.uint8 else np.uint32
    pair = (symbol[step].astype(wide) << (8 * symbol.itemsize)) | symbol  # the symbol two in front, then the one in front
    stop = (symbol == 0) | (symbol[step] == 0)  # terminators all differ
    step2 = step[step]
    while have < depth and len(row):
        two = depth - have >= 2
        row_kept = ~(stop[row] if two else symbol[row] == 0)
        row, group = row[row_kept], group[row_kept]
        c = (pair if two else symbol)[row]
        by = np.argsort(c, kind="stable")
        c, row, group = c[by], (step2 if two else step)[row[by]], group[by]
        group, row = _grouped(_borders(c, group), row)
        have += 2 if two else 1
    return row, group


def equal_prefixes(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, group) of the suffixes, over the shards laid end to end, that share `depth` symbols with another.

    shards: symbols of each collection. Places come group by group.
    """
    shards = [s for s in shards if len(s)]
    if not shards:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if max(int(s.max()) for s in shards) < 256:  # text: no byte above 0xF4, and one-byte symbols sort faster
        shards = [s.astype(np.uint8) for s in shards]
    sorted_ = [suffix_array(s, depth) for s in shards]
    row, group = merge([transform(s, p) for s, (p, _) in zip(shards, sorted_)], [k for _, k in sorted_], depth)
    first = np.cumsum([0, *[len(s) for s in shards[:-1]]])
    every = np.concatenate([p + f for (p, _), f in zip(sorted_, first)])
    return every[row], group.astype(np.int64)
