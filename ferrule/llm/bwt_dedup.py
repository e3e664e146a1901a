"""Suffix-array dedup over bytes: merged Burrows-Wheeler transforms of shards.

Bytes covered by a `width`-byte string that also starts earlier (smaller id, or the
same document at an earlier place) are removed. Byte super-k-mers (see superkmer) bring
all windows that can be equal to one bucket. There, equal strings are one string of
their earliest place, found by hash; the strings that share what surrounds their
minimiser with another, or may repeat inside themselves, form SHARDS shards by the task
slices they came from (slices are dealt to the shards in turn). The shards' transforms
are merged by interleave refinement (see bwt), and the intervals of equal prefixes of
`width` symbols are the repeated windows: all but the earliest place of an interval
are removed. Whole strings that are equal are thus decided by hash, parts of strings by
the merged transforms.

Strings that occur twice or more in one slice keep their earliest place there; the
task remembers it, and only an earlier place of the same string travels again.

Defined cases: a null text is empty; texts shorter than `width` bytes lose nothing;
null ids come first; rows that repeat an id are ordered by the hash of their text, and
rows identical in id and text count as one document; a very long text is one slice of
its task, which holds some sixty times its bytes; further columns keep their values, but
kept, n_bytes, n_removed and n_spans are replaced and none may begin with two
underscores; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt, common
from . import bytewise as bw
from . import superkmer as sk
from .substring_dedup import count_buckets

WIDTH, MER = 100, 16
SHARDS = 3
NAMES = ["text", "length", "doc", "key", "first", "least", "again", "at"]
EXPANSION = 3.4


def _mers(raw: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    at = np.arange(len(raw) - MER + 1)
    return sk.demoted(bw.span_hash(raw, at, at + MER), frequent)


def strings(width: int):
    """For sk.frequent()."""

    def of(part: pa.RecordBatch, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw, offsets = bw.utf8(part.column(2))
        if len(raw) < width:
            return sk.NONE, sk.NONE, sk.NONE
        _, lo, last, least, _, _ = sk.windows(_mers(raw, frequent), offsets[:-1], np.diff(offsets), width, MER)
        return least, bw.span_hash(raw, lo, last + width), last + width - lo

    return of


def ship(docs: DataFrame, width: int, buckets: int, frequent: np.ndarray = sk.NONE) -> DataFrame:
    """bucket, blob of packed strings with their places; rows without a blob are places that are not the earliest."""

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: dict[bytes, tuple] = {}
        known = np.zeros(0, "S16")
        packer = sk.Packer()
        for batch in batches:
            for part in sk.slices(batch, 2):
                doc_id = part.column(0).to_numpy()
                key = part.column(1).to_numpy()
                raw, offsets = bw.utf8(part.column(2))
                if len(raw) < width:
                    continue
                mers = _mers(raw, frequent)
                counts = np.diff(offsets)
                doc, lo, last, least, again, place = sk.windows(mers, offsets[:-1], counts, width, MER)
                if not len(doc):
                    continue
                hi = last + width
                first = lo - offsets[doc]
                rank = np.lexsort((first, key[doc], doc_id[doc]))
                a, b = bw.span_hash(raw, lo, hi), bw.span_hash(raw, lo, hi, 1)
                order, begin = sk.equal_groups(a[rank], b[rank])
                order = rank[order]  # stable: each group begins with its earliest place
                size = np.diff(np.concatenate((begin, [len(order)])))
                later = np.zeros(len(doc), bool)
                later[order] = True
                later[order[begin]] = False
                head = order[begin]
                send = np.ones(len(head), bool)
                names = np.stack([a[head], b[head]], 1).view("S16").ravel()
                met = size > 1
                if hot:
                    if len(known) < len(hot):
                        known = np.array(list(hot), "S16")
                    met |= np.isin(names, known)
                for g in np.flatnonzero(met):
                    i = head[g]
                    name = bytes(names[g])  # without trailing zero bytes, on both sides
                    own = (int(doc_id[doc[i]]), int(key[doc[i]]), int(first[i]))
                    best = hot.get(name)
                    if best is not None and best <= own:
                        send[g] = False
                        later[i] = best < own
                    elif best is not None or (size[g] > 1 and len(hot) < sk.HOT_STRINGS):
                        hot[name] = own
                # a place is never later than itself: identical rows are one document
                twin = np.zeros(len(doc), bool)
                if later.any():
                    lead = np.repeat(head, size)
                    same = (doc_id[doc[order]] == doc_id[doc[lead]]) & (key[doc[order]] == key[doc[lead]]) & (first[order] == first[lead])
                    twin[order[same & (order != lead)]] = True
                gone = later & ~twin
                if gone.any():
                    k = key[doc[gone]]
                    yield sk.rows_of((bw.mix(k.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), [None] * len(k), doc_id[doc[gone]], k, first[gone], first[gone] + hi[gone] - lo[gone])
                head = head[send]
                g = head
                packer.add((bw.mix(least[g]) % np.uint64(buckets)).astype(np.int64), {"text": sk.take_spans(raw, lo[g], hi[g]), "length": (hi - lo)[g].astype(np.uint32), "doc": doc_id[doc[g]], "key": key[doc[g]], "first": first[g].astype(np.int32), "least": least[g].astype(np.uint32), "again": again[g], "at": place[g].astype(np.uint8)})
                yield from packer.rows()
        yield from packer.rows(0)

    return sk.identified(docs).mapInArrow(task, sk.SHIPPED)


def may_share(text, lo, length, least, again, at, width: int) -> np.ndarray:
    """Which of a bucket's distinct strings may share a window with another or hold one twice.

    Equal windows have their minimiser at the same place, so they share at least half of
    what is left of the window on one side of it, and the minimiser. Strings whose
    minimiser moves are compared with all others of that minimiser.
    """
    _, group = np.unique(least, return_inverse=True)
    moving = np.bincount(group, again) > 0
    side = (width - MER + 1) // 2
    mer = lo + at
    met = np.bincount(group)[group] > 1
    out = again | (moving[group] & met)
    for begin, stop in ((mer - side, mer + MER), (mer, mer + MER + side)):
        fits = np.flatnonzero(met & (begin >= lo) & (stop <= lo + length))
        if len(fits):
            name = bw.fixed_hash(text, begin[fits], side + MER)
            _, same, count = np.unique(name, return_inverse=True, return_counts=True)
            out[fits[count[same] > 1]] = True
    return out


def later_windows(bucket: list[dict[str, np.ndarray]], width: int) -> tuple[np.ndarray, ...]:
    """(doc, key, lo, hi) of the byte spans of a bucket covered by windows that also start earlier."""
    join = lambda name: np.concatenate([x[name] for x in bucket])
    text, length, doc, key, first, least, again, at = (join(n) for n in NAMES)
    length, first = length.astype(np.int64), first.astype(np.int64)
    shard = np.repeat(np.arange(len(bucket)) % SHARDS, [len(x["length"]) for x in bucket])
    lo = np.cumsum(length) - length
    rank = np.lexsort((first, key, doc))
    order, begin = sk.equal_groups(bw.span_hash(text, lo, lo + length)[rank], bw.span_hash(text, lo, lo + length, 1)[rank])
    order = rank[order]
    head = order[begin]
    lead = np.repeat(head, np.diff(np.concatenate((begin, [len(order)]))))
    differs = (doc[order] != doc[lead]) | (key[order] != key[lead]) | (first[order] != first[lead])
    gone = order[differs]
    out = [(doc[gone], key[gone], first[gone], first[gone] + length[gone])]
    some = head[may_share(text, lo[head], length[head], least[head], again[head], at[head].astype(np.int64), width)]
    some = some[np.argsort(shard[some], kind="stable")]
    if len(some):
        n = length[some]
        symbols = np.zeros(int((n + 1).sum()), np.uint16)
        begin = np.cumsum(n + 1) - (n + 1)
        symbols[bw.runs(begin, n)] = sk.take_spans(text, lo[some], lo[some] + n).astype(np.uint16) + 1
        cuts = np.searchsorted(shard[some], np.arange(SHARDS + 1))
        ends = np.concatenate((begin, [len(symbols)]))
        place, group = bwt.equal_prefixes([symbols[ends[cuts[s]] : ends[cuts[s + 1]]] for s in range(SHARDS)], width)
        string = np.searchsorted(begin, place, "right") - 1
        start = first[some][string] + place - begin[string]
        by = np.lexsort((start, key[some][string], doc[some][string], group))
        g, s, at = group[by], string[by], start[by]
        fresh = np.concatenate(([True], g[1:] != g[:-1]))
        lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(g) else np.zeros(0, np.int64)
        other = (doc[some][s] != doc[some][s[lead]]) | (key[some][s] != key[some][s[lead]]) | (at != at[lead])
        flags = np.zeros(len(symbols), bool)
        flags[place[by][other]] = True
        owner = np.repeat(np.arange(len(some)), n + 1)
        f, l = sk.spans_of(flags, owner)
        w = owner[f] if len(f) else np.zeros(0, np.int64)
        out.append((doc[some][w], key[some][w], first[some][w] + f - begin[w], first[some][w] + l - begin[w] + width))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(4))


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc, key, lo, hi: half-open byte spans covered by windows that start earlier too."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * parts, int(size * EXPANSION / sk.BUCKET_BYTES))
    frequent = sk.frequent(docs, strings(width)) if size * EXPANSION > sk.HOT_BYTES else sk.NONE
    return count_buckets(ship(docs, width, buckets, frequent), max(parts, buckets // 4), lambda x: later_windows(x, width), NAMES)


RESULT = ["kept", "n_bytes", "n_removed", "n_spans"]


def remove(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with kept (binary), n_bytes, n_removed and n_spans, one row a document row."""
    common.prepare(docs.sparkSession)
    rows = sk.with_spans(docs, sk.spans_by_row(repeats(docs, width)), RESULT)

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for part in sk.slices(batch, names.index("text")):
                raw, offsets = bw.utf8(part.column(names.index("text")))
                body = raw.tobytes()
                kept, n, gone, cuts = [], [], [], []
                for i, spans in enumerate(part.column(names.index("__spans")).to_pylist()):
                    lo, hi = int(offsets[i]), int(offsets[i + 1])
                    spans = spans or []
                    n.append(hi - lo)
                    kept.append(b"".join(body[lo + x : lo + y] for x, y in sk.gaps(spans, hi - lo)))
                    gone.append(sum(s["hi"] - s["lo"] for s in spans))
                    cuts.append(len(spans))
                yield pa.RecordBatch.from_arrays([*[c for c, name in zip(part.columns, names) if name != "__spans"], pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (n, gone, cuts))], [*[x for x in names if x != "__spans"], *RESULT])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__spans")
    return rows.mapInArrow(task, f"{own}, kept binary, n_bytes long, n_removed long, n_spans long")
