"""Super-k-mer packing shared by the two substring operators.

A sequence (words, or bytes) is cut into windows of w items. Each window's minimiser
is its least k-mer hash; consecutive windows of one document with the same minimiser
form a run, and the run's items travel as one packed string to the minimiser's bucket.
Equal windows have equal minimisers, so they always meet. Strings of one slice and
bucket are one compressed row.

A k-mer that very many different strings share would make one bucket of them all. Such
k-mers, found on a sample of the documents, come after all others in the order by which
minimisers are chosen: a window with any other k-mer goes to that one's bucket. All
tasks use one list, and equal windows still choose alike, whatever the list holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewise as bw
from . import common
from .bytewise import slices  # noqa: F401

#: Bytes of strings in a bucket, and those a task gathers before it packs them by bucket.
BUCKET_BYTES = 6 << 20
GATHER_BYTES = 16 << 20
PLACE = np.uint64((1 << 24) - 1)
#: One document in so many is looked at for frequent minimisers; a minimiser is frequent if, by that, its
#: different strings have more bytes than this; and so many are known at most.
SAMPLE, HOT_BYTES, HOT_MERS = 16, 4 << 20, 1 << 16
#: Strings repeated in one slice that a task remembers; further ones travel once a slice.
HOT_STRINGS = 1 << 16
_CODEC = "zstd"
#: What stands for a null id.
NULL_ID = np.iinfo(np.int64).min
SHIPPED = "bucket int, blob binary, doc long, key long, lo int, hi int"


def windows(mers: np.ndarray, firsts: np.ndarray, counts: np.ndarray, w: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of a batch of sequences laid end to end.

    mers: hash of the k-mer at each item (junk across borders); firsts and counts: place
    and length of each sequence. Returns (sequence, first window, last window, minimiser,
    moves, at). A minimiser is the upper 40 bits of the least hash; the lower bits hold
    its place, so that ties go to the left. moves: the place changes inside the run,
    without which no window can repeat inside it; always set where places do not fit.
    at: the place, counted from the run's first window, 0 where it moves.
    """
    place = np.arange(len(mers), dtype=np.uint64) & PLACE
    least = bw.window_min(mers & ~PLACE | place, w - k + 1)
    n = np.maximum(counts - w + 1, 0)
    at = bw.runs(firsts, n)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64), np.zeros(0, bool), z
    owner = np.repeat(np.arange(len(firsts)), n)
    full = least[at]
    value = full >> np.uint64(24)
    change = np.concatenate(([True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])))
    begin = np.flatnonzero(change)
    end = np.concatenate((begin[1:], [len(at)])) - 1
    moves = (full[begin] != full[end]) | (len(mers) > int(PLACE))
    where = np.where(moves, 0, (full[begin] & PLACE).astype(np.int64) - at[begin])
    return owner[begin], at[begin], at[end], value[begin], moves, where


NONE = np.zeros(0, np.uint64)


def name_of(minimiser: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The 39 bits by which a minimiser of windows() is on the list of frequent ones."""
    return minimiser & np.uint64((1 << 39) - 1) if len(hot) else minimiser >> np.uint64(1)


def demoted(mers: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """mers with those on the sorted list after all others."""
    if not len(hot) or not len(mers):
        return mers
    name = mers >> np.uint64(25)
    table = np.zeros(1 << 16, bool)
    table[(hot & np.uint64(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(name & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(hot, name[maybe]), len(hot) - 1)
    out = mers >> np.uint64(1)
    out[maybe[hot[at] == name[maybe]]] |= np.uint64(1 << 63)
    return out


def frequent(docs: DataFrame, strings, rounds: int = 3) -> np.ndarray:
    """The sorted names of frequent minimisers; strings(part, hot) gives minimiser, hash and bytes of a slice's strings.

    What comes first after one list may be frequent itself, so it is looked for again.
    """
    hot = NONE
    sample = identified(docs).where(F.pmod(F.xxhash64("doc", "key"), F.lit(SAMPLE)) == 0)

    def sizes(hot: np.ndarray) -> DataFrame:
        @common.frees
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 2):
                    least, name, size = strings(part, hot)
                    yield pa.RecordBatch.from_arrays([pa.array(name_of(least, hot).astype(np.int64)), pa.array(name.view(np.int64)), pa.array(size.astype(np.int64))], ["mer", "name", "size"])

        each = sample.mapInArrow(task, "mer long, name long, size long").distinct()
        return each.groupBy("mer").agg((F.sum("size") * SAMPLE).alias("size")).where(F.col("size") > HOT_BYTES)

    for _ in range(rounds):
        found = sizes(hot).orderBy(F.desc("size"), "mer").limit(HOT_MERS - len(hot)).collect()
        new = np.setdiff1d(np.array([r["mer"] for r in found], np.uint64), hot)
        if not len(new):
            break
        hot = np.sort(np.concatenate([hot, new]))
    return hot


def take_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return data[bw.runs(starts, ends - starts)]


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one compressed string."""
    out = pa.BufferOutputStream()
    for name in sorted(arrays):
        a = np.ascontiguousarray(arrays[name])
        out.write(a.dtype.str.encode().ljust(8) + len(a).to_bytes(8, "little") + a.tobytes())
    raw = out.getvalue()
    return len(raw).to_bytes(8, "little") + pa.Codec(_CODEC, 3).compress(raw, asbytes=True)


def unpack(data: bytes, names: list[str]) -> dict[str, np.ndarray]:
    raw = pa.Codec(_CODEC).decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    out, at = {}, 0
    for name in sorted(names):
        kind, n = np.dtype(raw[at : at + 8].decode().strip()), int.from_bytes(raw[at + 8 : at + 16], "little")
        out[name] = np.frombuffer(raw, kind, n, at + 16)
        at += 16 + n * kind.itemsize
    return out


class Packer:
    """Strings of several slices of a task, packed by bucket when there are enough: longer rows compress better."""

    def __init__(self) -> None:
        self.parts: list[dict[str, np.ndarray]] = []
        self.held = 0

    def add(self, bucket: np.ndarray, arrays: dict[str, np.ndarray]) -> None:
        """arrays: text (the strings end to end), length, and one value a string of any other name."""
        self.parts.append({"bucket": bucket, **arrays})
        self.held += len(arrays["text"])

    def rows(self, least: int = GATHER_BYTES) -> Iterator[pa.RecordBatch]:
        """One row a bucket, if at least so many bytes are held."""
        if not self.parts or self.held < least:
            return
        every = {n: np.concatenate([p[n] for p in self.parts]) for n in self.parts[0]}
        self.parts, self.held = [], 0
        stop = np.cumsum(every["length"].astype(np.int64))
        start = stop - every["length"]
        text, bucket = every.pop("text"), every.pop("bucket")
        where, blobs = [], []
        for which, i in by_bucket(bucket):
            where.append(which)
            blobs.append(pack({"text": take_spans(text, start[i], stop[i]), **{n: x[i] for n, x in every.items()}}))
        none = [None] * len(where)
        yield rows_of(where, blobs, none, none, none, none)


def equal_groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, start of each group in it) of rows with equal 128-bit hashes (a, b)."""
    order = np.argsort(a, kind="stable")
    x = a[order]
    tied = np.flatnonzero(x[1:] == x[:-1])
    if len(tied):  # only ties of the first hash need the second
        order = np.lexsort((b, a))
        x = a[order]
    y = b[order]
    new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, bool)
    return order, np.flatnonzero(new)


def spans_of(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) indices of runs of set flags that have one owner."""
    if not flags.any():
        z = np.zeros(0, np.int64)
        return z, z
    same = np.concatenate(([False], owner[1:] == owner[:-1]))
    begin = flags & ~(np.concatenate(([False], flags[:-1])) & same)
    nxt = np.concatenate((same[1:], [False]))
    end = flags & ~(np.concatenate((flags[1:], [False])) & nxt)
    return np.flatnonzero(begin), np.flatnonzero(end)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    edge = np.concatenate(([0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)])) if len(b) else np.zeros(1, np.int64)
    for lo, hi in zip(edge[:-1], edge[1:]):
        yield int(b[lo]), order[lo:hi]


def rows_of(bucket, blob, doc, key, lo, hi) -> pa.RecordBatch:
    """A batch of the schema SHIPPED."""
    kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((bucket, blob, doc, key, lo, hi), kinds)], ["bucket", "blob", "doc", "key", "lo", "hi"])


def identified(docs: DataFrame) -> DataFrame:
    """doc, key, text: what the tasks need of a row, and the join back goes by."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("doc"), common.row_key(docs).alias("key"), "text")


def spans_by_row(found: DataFrame) -> DataFrame:
    """doc, key, spans: the disjoint spans, in order, that a row's spans cover; touching ones are one."""
    grouped = found.groupBy("doc", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            flat = spans.flatten()
            size = np.diff(spans.offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            lo, hi = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
            by = np.lexsort((lo, row))
            row, lo, hi = row[by], lo[by], hi[by]
            reach = np.maximum.accumulate(hi + (row << 32)) - (row << 32)  # furthest end so far in the row
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (lo[1:] > reach[:-1])
            begin = np.flatnonzero(new)
            last = np.concatenate((begin[1:], [len(row)]))[: len(begin)] - 1
            edge = np.searchsorted(row[begin], np.arange(len(size) + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(lo[begin], pa.int32()), pa.array(reach[last], pa.int32())], ["lo", "hi"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(edge, items)], ["doc", "key", "spans"])

    return grouped.mapInArrow(task, "doc long, key long, spans array<struct<lo: int, hi: int>>")


def with_spans(docs: DataFrame, spans: DataFrame, replaced: list[str]) -> DataFrame:
    """docs, without the columns that the result replaces, with __spans."""
    rows = common.without(docs, replaced).withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))), "__key": common.row_key(docs)})
    named = common.cut(spans.select(F.col("doc").alias("__doc"), F.col("key").alias("__key"), F.col("spans").alias("__spans")))
    return common.small_join(rows, named, ["__doc", "__key"]).drop("__doc", "__key")


def gaps(intervals: list[dict], n: int) -> list[tuple[int, int]]:
    """What disjoint {'lo', 'hi'} intervals in order leave of [0, n)."""
    edges = [0, *(x for pair in intervals for x in (pair["lo"], pair["hi"])), n]
    return [(lo, hi) for lo, hi in zip(edges[::2], edges[1::2]) if lo < hi]
