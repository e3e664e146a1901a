"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pair sum is
taken in linear time as half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

A document's features are its words and their shapes (punctuation, case and digit
classes), hashed to a fixed number of slots with log-scaled counts of unit norm,
and structure statistics of the text (ratios of character classes, repeated words and
lines, lengths), each cut into ten steps. The length in characters is the metadata;
language, source and id are never used. Whole texts are scored inside Arrow batches.

The model is fitted on at most TRAIN_ROWS labelled rows, chosen by a hash of the id:
that bounded sample is the only data that reaches the driver.

Defined cases: a null or empty text has only its statistics as features and gets a
score from them; a null label is no label; a null id counts as empty text in the fold
rule; repeated rows get equal scores; a very long text is scored whole, in a batch of its
own; a column named quality_score is replaced by the score (no other name may be __text);
no labels at all give 0.5 everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewise as bw
from . import common

WORD_BITS = 15
#: Bytes of text whose features a worker holds at a time.
SLICE = 1 << 18
STEPS = 10
FACTORS = 8
TRAIN_ROWS = 4_000
#: A document is accepted from this score on.
CUT = 0.3

_CLASS = np.full(256, 5, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 other ASCII, 5 beyond ASCII
_CLASS[:128] = 4
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[np.flatnonzero(bw.SPACE)] = 3
STATS = 14
SLOTS = (1 << WORD_BITS) + STATS * STEPS


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, slot, value) triples of a batch of texts, in document order."""
    n = len(offsets) - 1
    starts, ends, owner = bw.words(raw, offsets)
    kinds = _CLASS[raw]
    by_class = [_sums(kinds == k, offsets) for k in range(6)]
    size = np.maximum(np.diff(offsets).astype(float), 1)
    n_words = np.bincount(owner, minlength=n).astype(float)
    some = np.maximum(n_words, 1)

    hashed = bw.span_hash(raw, starts, ends)
    slot = (hashed >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    # shapes: classes of the first and the last two bytes of a word
    first, last = kinds[starts], kinds[np.maximum(ends - 1, 0)] if len(ends) else kinds[:0]
    before = kinds[np.maximum(ends - 2, starts)] if len(ends) else kinds[:0]
    tail = raw[np.maximum(ends - 1, 0)] if len(ends) else raw[:0]
    shape = bw.mix((first.astype(np.uint64) << np.uint64(24)) | (before.astype(np.uint64) << np.uint64(16)) | (last.astype(np.uint64) << np.uint64(8)) | np.where(last == 4, tail, 0).astype(np.uint64))
    shape_slot = (shape >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key = np.concatenate((owner, owner)) << WORD_BITS | np.concatenate((slot, shape_slot))
    unique, count = np.unique(key, return_counts=True)
    doc, col = unique >> WORD_BITS, unique & ((1 << WORD_BITS) - 1)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(doc, value**2, n))
    value = value / np.maximum(norm[doc], 1e-9)

    pair = np.unique(owner.astype(np.uint64) << np.uint64(40) | hashed >> np.uint64(24))
    distinct = np.bincount((pair >> np.uint64(40)).astype(np.int64), minlength=n) / some
    upper_word = np.bincount(owner[(first == 1) & (before == 1)], minlength=n) / some if len(owner) else np.zeros(n)
    odd_tail = np.bincount(owner[(last == 4) & (before == 4)], minlength=n) / some if len(owner) else np.zeros(n)
    again = np.zeros(n)
    if len(owner) > 1:
        same = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
        again = np.bincount(owner[1:][same], minlength=n) / some
    lone = np.bincount(owner[(ends - starts == 1) & (last == 4)], minlength=n) / some if len(owner) else np.zeros(n)
    lines = _sums(raw == 10, offsets)
    ratio = [by_class[k] / size for k in (0, 1, 2, 3, 4)]
    scaled = [*ratio[:1], *(np.minimum(1, 4 * r) for r in ratio[1:]), distinct, upper_word, odd_tail, again, lone, np.minimum(1, np.log1p(n_words) / 10), np.minimum(1, np.log1p(size) / 14), np.minimum(1, lines / some * 5), np.minimum(1, (size - by_class[3]) / some / 15)]
    stat = np.stack(scaled, 1)
    step = np.minimum((stat * STEPS).astype(np.int64), STEPS - 1)
    stat_col = (1 << WORD_BITS) + np.arange(STATS) * STEPS + step
    doc = np.concatenate((doc, np.repeat(np.arange(n), STATS)))
    col = np.concatenate((col, stat_col.ravel()))
    value = np.concatenate((value, np.full(n * STATS, STATS**-0.5)))
    order = np.argsort(doc, kind="stable")
    return doc[order], col[order], value[order]


def pair_sum(doc: np.ndarray, col: np.ndarray, value: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pair term of every document, and sum_i v_if x_i, by the sum-of-squares identity."""
    out, sums = np.zeros(n), np.zeros((n, v.shape[1]))
    for f in range(v.shape[1]):
        part = v[col, f] * value
        sums[:, f] = np.bincount(doc, part, n)
        out += sums[:, f] ** 2 - np.bincount(doc, part**2, n)
    return out / 2, sums


def predict(doc, col, value, n: int, model: dict) -> np.ndarray:
    z = model["b"] + np.bincount(doc, model["w"][col] * value, n) + pair_sum(doc, col, value, model["v"], n)[0]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(doc, col, value, y: np.ndarray, epochs: int = 8, batch: int = 256, steps: int = 160, rate: float = 0.02, ridge: float = 1e-5, seed: int = 7) -> dict:
    """Weights by Adam over shuffled batches of documents; both labels weigh the same in the loss, shifted to the cut."""
    n = len(y)
    rng = np.random.default_rng(seed)
    p = {"b": np.zeros(1), "w": np.zeros(SLOTS), "v": rng.normal(0, 0.05, (SLOTS, FACTORS))}
    if not n or y.min() == y.max():
        return {"b": 0.0, "w": p["w"], "v": np.zeros((SLOTS, FACTORS))}
    share = np.where(y == 1, (y == 1).mean(), (y == 0).mean())
    moment = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in p.items()}
    edge = np.searchsorted(doc, np.arange(n + 1))
    batch = max(32, min(batch, n // 8))
    t = 0
    for _ in range(max(epochs, -(-steps * batch // n))):  # few labels take more rounds
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            t += 1
            mine = order[lo : lo + batch]
            size = edge[mine + 1] - edge[mine]
            at = bw.runs(edge[mine], size)
            d, c, x, m = np.repeat(np.arange(len(mine)), size), col[at], value[at], len(mine)
            pair, sums = pair_sum(d, c, x, p["v"], m)
            z = p["b"][0] + np.bincount(d, p["w"][c] * x, m) + pair
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[mine]) * 0.5 / share[mine] / m
            ex = e[d] * x
            square = np.bincount(c, ex * x, SLOTS)
            grad = {"b": np.array([e.sum()]), "w": np.bincount(c, ex, SLOTS) + ridge * p["w"]}
            grad["v"] = np.stack([np.bincount(c, ex * sums[d, f], SLOTS) for f in range(FACTORS)], 1) - square[:, None] * p["v"] + ridge * p["v"]
            for k, g in grad.items():
                first, second = moment[k]
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                p[k] -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    # the accepted side starts at CUT, not at one half
    return {"b": float(p["b"][0] + np.log(CUT / (1 - CUT))), "w": p["w"], "v": p["v"]}


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> dict:
    """A model fitted on at most train_rows labelled rows outside the held-out fold."""
    common.prepare(docs.sparkSession)
    key = F.col("doc_id")
    known = labels.where(F.col(label).isNotNull() & key.isNotNull() & (fold(key) != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("__y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # at most train_rows ids and labels: a fixed bound
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "__y", F.xxhash64("doc_id", "text").alias("h"))

    @common.frees
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bw.slices(whole, 0, SLICE)):
            doc, col, value = features(*bw.utf8(batch.column(0)))
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.ListArray.from_arrays(cut, col.astype(np.int32)), pa.ListArray.from_arrays(cut, value.astype(np.float32))], ["y", "h", "col", "value"])

    # rows that repeat an id can be more than the ids: the first by hash, so that reruns learn alike
    got = rows.mapInArrow(featured, "y int, h long, col array<int>, value array<float>").orderBy("h").limit(train_rows).toArrow()
    y = got["y"].to_numpy().astype(float)
    size = [len(x) for x in got["col"].to_pylist()] if len(y) else []
    doc = np.repeat(np.arange(len(y)), size) if len(y) else np.zeros(0, np.int64)
    flat = lambda c: got[c].combine_chunks().flatten().to_numpy() if len(y) else np.zeros(0)
    return fit(doc, flat("col").astype(np.int64), flat("value").astype(float), y)


def score(docs: DataFrame, model: dict, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The keep columns (all by default) of every row with quality_score, the probability of label 1."""
    common.prepare(docs.sparkSession)
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c.lower() != "quality_score")
    model = {"b": model["b"], "w": model["w"].astype(np.float32), "v": model["v"].astype(np.float32)}

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bw.slices(whole, 0, SLICE)):
            raw, offsets = bw.utf8(batch.column(0))
            p = predict(*features(raw, offsets), batch.num_rows, model) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p, pa.float64())], [*batch.schema.names[1:], "quality_score"])

    df = docs.select(F.col("text").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields[1:])
    return df.mapInArrow(task, f"{kept}quality_score double")
