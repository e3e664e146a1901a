"""Substring dedup over words by super-k-mer partitioning.

Words covered by a window of `width` words whose sequence starts more than once in the
corpus (all documents, overlaps and the same document included) are removed. Windows
travel as super-k-mers (see superkmer) to their minimiser's bucket, where the windows
of all strings are sorted by a 128-bit hash and counted.

A string that occurs twice or more in one slice of a task is counted there: its places
are known to repeat, one copy travels with count 2, and later slices of the task send
none. So a passage that a third of all documents share costs each task one string.

Defined cases: a null or empty text, or one of fewer than `width` words, loses
nothing; rows that repeat a document make each other's windows repeat, also where their
ids are null or equal; a very long text is one slice of its task, which holds some forty
times its bytes; further columns keep their values, but kept, n_words and n_removed are
replaced and none may begin with two underscores; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewise as bw
from . import common
from . import superkmer as sk
from .jaccard_join import groups_of

WIDTH, MER = 35, 5
NAMES = ["text", "length", "count", "doc", "key", "first"]
RESULT = ["kept", "n_words", "n_removed"]
EXPANSION = 3.2


def _words(raw: np.ndarray, offsets: np.ndarray):
    """Normalised bytes (words joined by one space), and start, end, owner and hashes of the words in it."""
    starts, ends, owner = bw.words(raw, offsets)
    size = ends - starts
    at = np.cumsum(size + 1) - size - 1
    text = np.full(int((size + 1).sum()), 0x20, np.uint8)
    text[bw.runs(at, size)] = raw[bw.runs(starts, size)]
    return text, at, at + size, owner


def _runs(part: pa.RecordBatch, width: int, frequent: np.ndarray):
    """Text, first and last byte and hash of the words of a slice, count and first of each document, and its super-k-mers."""
    text, at, stop, owner = _words(*bw.utf8(part.column(2)))
    counts = np.bincount(owner, minlength=part.num_rows)
    firsts = np.cumsum(counts) - counts
    h = bw.span_hash(text, at, stop)
    item = np.arange(max(len(h) - MER + 1, 0))
    mers = sk.demoted(bw.span_hash(h, item, item + MER), frequent) if len(item) else np.zeros(0, np.uint64)
    return text, at, stop, h, firsts, counts, mers


def strings(width: int):
    """For sk.frequent()."""

    def of(part: pa.RecordBatch, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, at, stop, h, firsts, counts, mers = _runs(part, width, frequent)
        if len(at) < width:
            return sk.NONE, sk.NONE, sk.NONE
        _, lo, last, least, _, _ = sk.windows(mers, firsts, counts, width, MER)
        return least, bw.span_hash(h, lo, last + width), stop[last + width - 1] - at[lo]

    return of


def ship(docs: DataFrame, width: int, buckets: int, frequent: np.ndarray = sk.NONE) -> DataFrame:
    """bucket, blob of packed strings; and rows without a blob, which are places known to repeat (key, lo, hi)."""

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: set[bytes] = set()
        packer = sk.Packer()
        for batch in batches:
            for part in sk.slices(batch, 2):
                ids, key = part.column(0).to_numpy(), part.column(1).to_numpy()
                text, at, stop, h, firsts, counts, mers = _runs(part, width, frequent)
                if len(at) < width:
                    continue
                doc, lo, last, least, _, _ = sk.windows(mers, firsts, counts, width, MER)
                if not len(doc):
                    continue
                hi = last + width
                a, b = bw.span_hash(h, lo, hi), bw.span_hash(h, lo, hi, 1)
                order, begin = sk.equal_groups(a, b)
                size = np.diff(np.concatenate((begin, [len(order)])))
                head = order[begin]
                repeated = np.repeat(size > 1, size)
                known = np.zeros(len(doc), bool)
                known[order[repeated]] = True
                send = np.ones(len(begin), bool)
                count = np.minimum(size, 2).astype(np.uint8)
                names = np.stack([a[head], b[head]], 1)
                if hot:
                    send = np.array([x.tobytes() not in hot for x in names])
                    again = np.repeat(~send, size)
                    known[order[again]] = True
                if len(hot) < sk.HOT_STRINGS:
                    hot.update(x.tobytes() for x in names[(size > 1) & send])
                if known.any():
                    d = doc[known]
                    keys, los, his = key[d], lo[known] - firsts[d], hi[known] - firsts[d]
                    yield sk.rows_of((bw.mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), [None] * len(keys), ids[d], keys, los, his)
                head, count = head[send], count[send]
                g, s, e = head, at[lo[head]], stop[hi[head] - 1]
                packer.add((bw.mix(least[g]) % np.uint64(buckets)).astype(np.int64), {"text": sk.take_spans(text, s, e), "length": (e - s).astype(np.uint32), "count": count, "doc": ids[doc[g]], "key": key[doc[g]], "first": np.where(count > 1, -1, lo[g] - firsts[doc[g]]).astype(np.int32)})
                yield from packer.rows()
        yield from packer.rows(0)

    return sk.identified(docs).mapInArrow(task, sk.SHIPPED)


def count_windows(bucket: list[dict[str, np.ndarray]], width: int) -> tuple[np.ndarray, ...]:
    """(doc, key, lo, hi) of the word spans that repeated windows of a bucket cover, for strings that carry a place."""
    join = lambda name: np.concatenate([x[name] for x in bucket])
    text, length, count, doc, key, first = (join(n) for n in NAMES)
    offsets = np.concatenate(([0], np.cumsum(length.astype(np.int64))))
    starts, ends, owner = bw.words(text, offsets)
    h = bw.span_hash(text, starts, ends)
    n = np.bincount(owner, minlength=len(length))
    at = bw.runs(np.cumsum(n) - n, n - width + 1)
    string = np.repeat(np.arange(len(length)), n - width + 1)
    order, begin = sk.equal_groups(bw.span_hash(h, at, at + width), bw.span_hash(h, at, at + width, 1))
    total = np.add.reduceat(count[string[order]].astype(np.int64), begin)
    flags = np.zeros(len(at), bool)
    flags[order] = np.repeat(total > 1, np.diff(np.concatenate((begin, [len(order)]))))
    flags &= first[string] >= 0
    lo, hi = sk.spans_of(flags, string)
    base = np.cumsum(n - width + 1) - (n - width + 1)
    s = string[lo]
    return doc[s], key[s], first[s] + lo - base[s], first[s] + hi - base[s] + width


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc, key, lo, hi: half-open word spans covered by repeated windows."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * parts, int(size * EXPANSION / sk.BUCKET_BYTES))
    frequent = sk.frequent(docs, strings(width)) if size * EXPANSION > sk.HOT_BYTES else sk.NONE
    return count_buckets(ship(docs, width, buckets, frequent), max(parts, buckets // 4), lambda x: count_windows(x, width), NAMES)


def count_buckets(shipped: DataFrame, parts: int, count, names: list[str]) -> DataFrame:
    """(doc, key, lo, hi) of count() over the strings of each bucket, and of the rows without a blob as they are."""

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches):
            plain = table.filter(pc.is_null(table["blob"]))
            if plain.num_rows:
                yield from plain.select(["doc", "key", "lo", "hi"]).to_batches()
            table = table.filter(pc.is_valid(table["blob"]))
            which = table["bucket"].to_numpy()
            edge = np.concatenate(([0], np.flatnonzero(which[1:] != which[:-1]) + 1, [len(which)]))
            for lo, hi in zip(edge[:-1], edge[1:]):
                if hi > lo:
                    found = count([sk.unpack(x, names) for x in table["blob"].slice(lo, hi - lo).to_pylist()])
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in found[:2]), *(pa.array(x, pa.int32()) for x in found[2:])], ["doc", "key", "lo", "hi"])

    return shipped.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(task, "doc long, key long, lo int, hi int")


def remove(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with kept (the words left, joined by one space), n_words and n_removed, one row a document row."""
    common.prepare(docs.sparkSession)
    rows = sk.with_spans(docs, sk.spans_by_row(repeats(docs, width)), RESULT)

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = names.index("text")
            for part in sk.slices(batch, at):
                text, start, stop, owner = _words(*bw.utf8(part.column(at)))
                edge = np.searchsorted(owner, np.arange(part.num_rows + 1))
                body = text.tobytes()
                kept, n, gone = [], [], []
                for i, spans in enumerate(part.column(names.index("__spans")).to_pylist()):
                    lo, hi = edge[i], edge[i + 1]
                    n.append(int(hi - lo))
                    spans = spans or []
                    gone.append(sum(x["hi"] - x["lo"] for x in spans))
                    kept.append(b" ".join(body[start[lo + x] : stop[lo + y - 1]] for x, y in sk.gaps(spans, int(hi - lo))))
                yield pa.RecordBatch.from_arrays([*[c for c, name in zip(part.columns, names) if name != "__spans"], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*[x for x in names if x != "__spans"], *RESULT])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__spans")
    return rows.mapInArrow(task, f"{own}, kept string, n_words long, n_removed long")
