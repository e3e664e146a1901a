"""Directly addressable codes for token ids.

An id is split into 8-bit chunks. Level 0 holds the lowest chunk of every id, level k
the k-th chunk of the ids that have one; a bitmap at each level says which ids go on,
and a rank directory (ones before each block of 512 bits) gives an id's place in the
next level. Any token is read from a file with a few short reads and no decoding of
its neighbours.

File: segments one after another, then the index (JSON) and its length (8 bytes).
"""

from __future__ import annotations

import json

import numpy as np

CHUNK = 8
BLOCK_BITS = 512


def encode(ids: np.ndarray) -> tuple[bytes, dict]:
    """Bytes of one segment and its index entry (offsets inside the segment)."""
    rest = ids.astype(np.uint32)
    out, levels, at = [], [], 0
    while len(rest):
        chunk = (rest & np.uint32((1 << CHUNK) - 1)).astype(np.uint8)
        rest = rest >> np.uint32(CHUNK)
        goes_on = rest > 0
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % (BLOCK_BITS // 8), np.uint8)))
        ones = np.bitwise_count(bits.view(np.uint64)).reshape(-1, BLOCK_BITS // 64).sum(1)
        rank = np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4")
        level = {"n": len(chunk), "chunks": at}
        level["bits"] = level["chunks"] + len(chunk)
        level["rank"] = level["bits"] + len(bits)
        at = level["rank"] + rank.nbytes
        out += [chunk.tobytes(), bits.tobytes(), rank.tobytes()]
        levels.append(level)
        rest = rest[goes_on]
    return b"".join(out), {"n": len(ids), "bytes": at, "levels": levels}


def decode(data: bytes, entry: dict) -> np.ndarray:
    """All ids of a segment."""
    parts = []
    for level in entry["levels"]:
        n = level["n"]
        chunk = np.frombuffer(data, np.uint8, n, level["chunks"]).astype(np.uint32)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, level["rank"] - level["bits"], level["bits"]), bitorder="little")[:n].astype(bool)
        parts.append((chunk, bits))
    above = np.zeros(0, np.uint32)
    for chunk, bits in reversed(parts):
        value = chunk.copy()
        value[bits] |= above << np.uint32(CHUNK)
        above = value
    return above


def get(read, entry: dict, i: int) -> int:
    """Token i of a segment; read(offset, length) returns bytes of the segment."""
    value, shift = 0, 0
    for level in entry["levels"]:
        value |= read(level["chunks"] + i, 1)[0] << shift
        block, inside = divmod(i, BLOCK_BITS)
        word = int.from_bytes(read(level["bits"] + block * (BLOCK_BITS // 8), BLOCK_BITS // 8), "little")
        if not word >> inside & 1:
            return value
        before = int.from_bytes(read(level["rank"] + 4 * block, 4), "little")
        i = before + (word & ((1 << inside) - 1)).bit_count()
        shift += CHUNK
    raise ValueError("the last level goes on")


def finish(entries: list[dict], docs: list[list]) -> bytes:
    """The index: segments, and each document's id, first token and length."""
    index = json.dumps({"segments": entries, "docs": docs}).encode()
    return index + len(index).to_bytes(8, "little")


def open_index(source, size: int) -> dict:
    source.seek(size - 8)
    length = int.from_bytes(source.read(8), "little")
    source.seek(size - 8 - length)
    return json.loads(source.read(length))
