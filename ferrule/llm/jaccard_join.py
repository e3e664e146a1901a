"""N-gram Jaccard join by chosen paths.

Documents become sets of hashed word n-grams. Equal sets are collapsed first, so copies
are one row with a count. Each set is embedded as a sketch: the minimum of its hashes in
each of BINS bins, and a (bin, minimum) pair is a token that two sets share with a
probability of their Jaccard similarity. A run splits all sets recursively: a set samples
about SPLIT of its tokens by a hash of the path so far, and meets the sets that chose the
same token. Buckets of at most SMALL sets are compared by brute force; larger ones are
split again. Runs are repeated until the chance of missing a pair at the threshold is
below 1 - recall. Large buckets whose sets are alike on average are groups of near copies,
which no split can part; these, and what is still large after DEPTH splits, are compared
block against block. Candidates are verified on the whole sets exactly.

What is returned grows with documents: counts of links and a class per document. Large
groups send counts and spanning edges, never their pairs.

Defined cases: words are runs of non-space characters, case kept; a text of fewer than
`width` words but not none is one n-gram; a null or empty text is linked to nothing and
is its own class; copies are links of each other; rows that repeat an id count as
documents; a very long text is one set, cut whole by one task; join() reads no columns
but doc_id and text, keep_one() returns all columns (none may begin with two
underscores); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewise as bw
from . import common
from .components import components, measured_components

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.9995
BINS, SPLIT, SMALL, DEPTH = 64, 2.0, 40, 3
BLOCK = 1024
#: A large bucket of at least this mean similarity is split no further.
COHERENT = 0.5
#: Bytes of text a worker cuts into n-grams at a time.
SLICE = 1 << 20
#: Candidates whose sketches agree in this much less than the threshold are not verified:
#: four standard deviations of 64 bins, so that about 1 in 10,000 pairs at the threshold goes.
SKETCH_MARGIN = 0.2
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def runs_for(recall: float, threshold: float = THRESHOLD, split: float = SPLIT) -> int:
    """Runs after which a pair at the threshold is missed with probability 1 - recall.

    A pair survives a split when the Poisson number of shared chosen tokens that lead on
    is not 0; the bound is that of pairs that are decided only in the last of DEPTH splits.
    """
    met = 1.0
    for _ in range(DEPTH):
        met = 1 - math.exp(-split * threshold * met)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    n = len(offsets) - 1
    starts, ends, owner = bw.words(raw, offsets)
    count = np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, np.int64)
    first = np.cumsum(count) - count
    grams = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = bw.runs(first, grams)
    stop = np.minimum(at + width, np.repeat(first + count, grams))
    h = bw.span_hash(bw.span_hash(raw, starts, ends), at, stop, 1) if len(at) else np.zeros(0, np.uint64)
    edge = np.concatenate(([0], np.cumsum(grams)))
    return [np.unique(h[edge[i] : edge[i + 1]]) for i in range(n)]


def sketch(sets: list[np.ndarray]) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """(128-bit digest, size, sketch rows) of sets; an empty bin is NONE."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), size)
    g = bw.mix(flat ^ np.uint64(0x1234567))
    rows = np.full((len(sets), BINS), NONE)
    cell = owner * BINS + (g >> np.uint64(58)).astype(np.int64)
    np.minimum.at(rows.reshape(-1), cell, g & np.uint64(0x03FFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        sums = [np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)]
        for k, x in enumerate((bw.mix(flat), bw.mix(flat ^ np.uint64(0xABCDEF01234)))):
            total = np.concatenate(([np.uint64(0)], np.cumsum(x)))
            edge = np.concatenate(([0], np.cumsum(size)))
            sums[k] = total[edge[1:]] - total[edge[:-1]]
        both = np.stack([bw.mix(sums[0] + size.astype(np.uint64)), bw.mix(sums[1])], 1)
    return [both[i].tobytes() if size[i] else None for i in range(len(sets))], size, rows


def bits_of(rows: np.ndarray) -> np.ndarray:
    """One bit of each bin of sketches as a 64-bit code; empty bins get bits that agree by chance only."""
    bit = bw.mix(rows.reshape(-1)).reshape(rows.shape) & np.uint64(1)
    with np.errstate(over="ignore"):
        own = bw.mix(rows.sum(1, dtype=np.uint64))
    chance = own[:, None] >> np.arange(BINS, dtype=np.uint64)[None] & np.uint64(1)
    bit = np.where(rows == NONE, chance, bit)
    return np.bitwise_or.reduce(bit << np.arange(BINS, dtype=np.uint64)[None], axis=1).view(np.int64)


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, key, sig, n, sk (array<int>, null for an empty bin), code (see bits_of): one row a document."""

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bw.slices(whole, 2, SLICE)):
            sig, n, rows = sketch(shingle_sets(*bw.utf8(batch.column(2)), width))
            empty = (rows == NONE).reshape(-1)
            value = bw.mix(rows.reshape(-1)).astype(np.uint32).view(np.int32)
            sk = pa.ListArray.from_arrays(np.arange(0, len(value) + 1, BINS, dtype=np.int32), pa.array(value, mask=empty))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sig, pa.binary()), pa.array(n, pa.int32()), sk, pa.array(bits_of(rows), pa.int64())], ["doc_id", "key", "sig", "n", "sk", "code"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.row_key(docs).alias("key"), "text").mapInArrow(task, "doc_id long, key long, sig binary, n int, sk array<int>, code long")


def split(rows: DataFrame) -> DataFrame:
    """The buckets after one more choice: path, sig, code for each chosen token of each (path, sig, sk, code)."""
    full = F.size(F.filter("sk", lambda v: v.isNotNull()))
    limit = F.lit(float(1 << 32)) * SPLIT / full
    tokens = F.transform("sk", lambda v, i: F.struct(v.alias("v"), i.alias("i"), F.pmod(F.xxhash64("path", i), F.lit(1 << 32)).alias("h")))
    chosen = F.filter(tokens, lambda t: t["v"].isNotNull() & (t["h"] < limit))
    return rows.select("sig", "code", F.explode(chosen).alias("t"), "path").select(F.xxhash64("path", "t.i", "t.v").alias("path"), "sig", "code")


def coherent(frontier: DataFrame) -> DataFrame:
    """path of the buckets whose mean pairwise similarity is at least COHERENT, by the counts of each bit.

    With a share p of ones, two random members agree in a bit with p^2 + (1 - p)^2, and
    in (1 + similarity) / 2 of all bits. Counts are partial sums of 64 numbers a bucket.
    """
    ones = [F.avg(F.getbit("code", F.lit(i))).alias(f"p{i}") for i in range(BINS)]
    agree = [F.pow(F.col(f"p{i}"), 2) + F.pow(1 - F.col(f"p{i}"), 2) for i in range(BINS)]
    mean = F.aggregate(F.array(*agree), F.lit(0.0), lambda acc, v: acc + v) / BINS
    return frontier.groupBy("path").agg(*ones).where(2 * mean - 1 >= COHERENT).select("path")


def leaves(sketches: DataFrame, runs: int) -> tuple[DataFrame, DataFrame | None]:
    """(small, large): (path, sig) of buckets of 2 to SMALL sets, and of larger ones that are coherent or left after DEPTH splits (None: there are none)."""
    sketches = sketches.select("sig", "sk", "code")
    frontier = sketches.withColumn("path", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(runs).cast("long"))))
    small, large, in_large = [], [], 0
    for depth in range(DEPTH):
        rows = common.cut(split(frontier))
        sizes, seen = common.cut_counted(rows.groupBy("path").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), large=F.count_if(F.col("m") > SMALL))
        small.append(rows.join(sizes.where(F.col("m") <= SMALL).select("path"), "path", "left_semi"))
        if not seen["large"]:
            break
        hot = common.small_join(rows, sizes.where(F.col("m") > SMALL).select("path"), ["path"], "inner", size=24 * seen["large"])
        if depth == DEPTH - 1:
            hot, seen = common.cut_counted(hot, n=F.count(F.lit(1)))
            large.append(hot)
            in_large += seen["n"]
            break
        hot = common.cut(hot)
        done, size = common.cut_measured(coherent(hot).withColumn("done", F.lit(True)))
        hot, seen = common.cut_counted(common.small_join(hot, done, ["path"], "left", size=size), open=F.count_if(F.col("done").isNull()), done=F.count_if(F.col("done")))
        if seen["done"]:
            large.append(hot.where("done"))
            in_large += seen["done"]
        frontier = hot.where("done is null").select("path", "sig").join(sketches, "sig")
        if not seen["open"]:
            break
    union = lambda parts: reduce(DataFrame.unionByName, [x.select("path", "sig") for x in parts])
    return union(small), union(large) if in_large else None


def groups(large: DataFrame) -> DataFrame:
    """sig, gid: the sets of large buckets, those of connected buckets in one group.

    Only buckets are joined: each set links its buckets to the least of them, and equal
    links of many sets are one.
    """
    own, _ = common.cut_measured(large.groupBy("sig").agg(F.sort_array(F.collect_set("path")).alias("paths")).withColumn("hub", F.element_at("paths", 1)))
    links = own.select(F.col("hub").alias("a"), F.explode("paths").alias("b")).where("a <> b").distinct()
    label, size = measured_components(links)
    return common.small_join(own.select("sig", "hub"), label.withColumnRenamed("node", "hub"), ["hub"], "left", size=size).select("sig", F.xxhash64(F.coalesce("label", "hub")).alias("gid"))


def candidates(small: DataFrame, reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, path: distinct pairs that share a small bucket, whose sizes allow the threshold; path is one of them."""
    rows = small.join(reps.select("sig", "n", "gid"), "sig")
    groups = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("sig", "n", "gid"))).alias("m"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("m") - 1), lambda i: F.transform(F.slice("m", i + 1, F.size("m")), lambda y: F.struct(F.element_at("m", i).alias("x"), y.alias("y")))))
    fits = F.filter(pairs, lambda p: (F.least(p["x"]["n"], p["y"]["n"]) >= F.lit(threshold) * F.greatest(p["x"]["n"], p["y"]["n"])) & ~F.coalesce(p["x"]["gid"] == p["y"]["gid"], F.lit(False)))
    pairs = groups.select("path", F.explode(fits).alias("p")).select(F.col("p.x.sig").alias("a"), F.col("p.y.sig").alias("b"), "path")
    return pairs.groupBy("a", "b").agg(F.min("path").alias("path"))


def alike(pairs: DataFrame, sketches: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """pairs whose sketches agree enough to be verified."""
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("sig").alias(side), F.col("sk").alias(f"s{side}")), side)
    z = F.zip_with("sa", "sb", lambda x, y: F.when(x == y, 1).when(x.isNotNull() | y.isNotNull(), 0))
    z = F.filter(z, lambda v: v.isNotNull())
    same = F.aggregate(z, F.lit(0), lambda acc, v: acc + v)
    return pairs.where(same >= F.size(z) * F.lit(max(threshold - SKETCH_MARGIN, 0.0))).select("a", "b", "path")


def with_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """wanted (key, sig, slots array<long>, ...), written down, with the whole set of its text, one row a slot."""
    wanted, size = common.cut_measured(wanted)
    texts = docs.select(common.row_key(docs).alias("key"), "text")
    rows = common.small_join(texts, wanted, ["key"], "inner", size=size).select("sig", "slots", "copies", "text")

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bw.slices(whole, 3, SLICE)):
            sets = shingle_sets(*bw.utf8(batch.column(3)), width)
            slots = batch.column(1).to_pylist()
            out = [(slot, i) for i, s in enumerate(slots) for slot in s]
            take = pa.array([i for _, i in out], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), batch.column(0).take(take), batch.column(2).take(take), pa.array([sets[i].tobytes() for _, i in out], pa.binary())], ["slot", "sig", "copies", "set"])

    return rows.mapInArrow(task, "slot long, sig binary, copies long, set binary")


def groups_of(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Whole runs of equal keys of a sorted stream of batches, as few tables as the stream allows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(column[1:] != column[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != batch.column(key)[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            head = batch.slice(0, int(change[-1]))
            yield pa.Table.from_batches([*held, head])
            held = [batch.slice(int(change[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def overlaps(sets: list[np.ndarray], other: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by an incidence product over shared elements."""
    every = sets if other is None else [*sets, *other]
    size = [len(s) for s in every]
    flat = np.concatenate(every) if every else np.zeros(0, np.uint64)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(every)), size)
    shared = count[inverse] > 1
    column = np.cumsum(count > 1) - 1
    rows, cols = owner[shared], column[inverse[shared]]
    n = len(sets)
    m = n if other is None else len(other)
    out = np.zeros((n, m), np.float32)
    width = int((count > 1).sum())
    for lo in range(0, width, 4096):
        part = (cols >= lo) & (cols < lo + 4096)
        hot = np.zeros((len(every), min(4096, width - lo)), np.float32)
        hot[rows[part], cols[part] - lo] = 1
        out += hot[:n] @ (hot[:n] if other is None else hot[n:]).T
    return out.round().astype(np.int64)


def verify(rows: DataFrame, threshold: float) -> DataFrame:
    """a, b, ca, cb of the pairs of each slot with a similarity of at least the threshold, exactly."""

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches):
            slot = table["slot"].to_numpy()
            sig = table["sig"].to_pylist()
            copies = table["copies"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
            edge = np.concatenate(([0], np.flatnonzero(slot[1:] != slot[:-1]) + 1, [len(slot)]))
            found = []
            for lo, hi in zip(edge[:-1], edge[1:]):
                mine = sets[lo:hi]
                if hi - lo == 2:
                    both = len(np.intersect1d(*mine, assume_unique=True))
                    if both >= threshold * (len(mine[0]) + len(mine[1]) - both):
                        found.append((lo, lo + 1))
                elif hi - lo > 2:
                    size = np.array([len(s) for s in mine])
                    both = overlaps(mine)
                    i, j = np.nonzero(np.triu(both >= threshold * (size[:, None] + size[None] - both), 1))
                    found += zip(i + lo, j + lo)
            pairs = [(i, j) if sig[i] < sig[j] else (j, i) for i, j in found if sig[i] != sig[j]]
            yield pa.RecordBatch.from_arrays([pa.array([sig[i] for i, _ in pairs], pa.binary()), pa.array([sig[j] for _, j in pairs], pa.binary()), pa.array([copies[i] for i, _ in pairs], pa.int64()), pa.array([copies[j] for _, j in pairs], pa.int64())], ["a", "b", "ca", "cb"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "slot").sortWithinPartitions("slot").mapInArrow(task, "a binary, b binary, ca long, cb long")


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a boolean adjacency matrix."""
    seen = np.zeros(len(linked), bool)
    out = []
    for s in range(len(linked)):
        if seen[s]:
            continue
        seen[s] = True
        todo = [s]
        while todo:
            v = todo.pop()
            new = np.flatnonzero(linked[v] & ~seen)
            seen[new] = True
            out += [(v, int(w)) for w in new]
            todo += new.tolist()
    return out


def compare_blocks(members: DataFrame, threshold: float) -> DataFrame:
    """For sets of large groups (slot: the group): sig, links, and spanning edges (sig, other).

    A set travels as its difference from the group's first set, so near copies are
    short, once for each pair of blocks its block is in. Rows are (sig, other, links):
    an edge where other is there, a count where links is.
    """
    least = members.groupBy("slot").agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("m"))
    core, size = common.cut_measured(members.join(least.select("slot", "sig", "m"), ["slot", "sig"]).select("slot", F.col("set").alias("core"), "m").dropDuplicates(["slot"]))
    rows = common.small_join(members, core, ["slot"], "inner", size=size)

    @common.frees
    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, diff = [], [], []
            for s, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                s, c = np.frombuffer(s, np.uint64), np.frombuffer(c, np.uint64)
                d = np.setxor1d(s, c, assume_unique=True)
                size.append(len(s))
                gone.append(len(np.setdiff1d(c, s, assume_unique=True)))
                diff.append(d.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(diff, pa.binary()), pa.array([len(c) // 8 for c in batch.column(3).to_pylist()], pa.int64()), *batch.columns[4:]], ["slot", "sig", "size", "gone", "diff", "whole", "m", "copies"])

    short = rows.select("slot", "sig", "set", "core", "m", "copies").mapInArrow(differ, "slot long, sig binary, size long, gone long, diff binary, whole long, m long, copies long")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("long")
    short = common.cut(short.withColumn("block", F.pmod(F.xxhash64("sig"), blocks)).withColumn("blocks", blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = short.withColumn("other", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    dealt = dealt.withColumn("task", F.xxhash64("slot", "lo", "hi"))

    @common.frees
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches):
            keys = table["task"].to_numpy()
            for lo, hi in _edges(keys):
                t = table.slice(lo, hi - lo)
                sig, copies, size, gone = t["sig"].to_pylist(), t["copies"].to_numpy(), t["size"].to_numpy(), t["gone"].to_numpy()
                diff = [np.frombuffer(x, np.uint64) for x in t["diff"].to_pylist()]
                left = t["block"].to_numpy() == t["lo"].to_numpy()
                same = t["lo"][0].as_py() == t["hi"][0].as_py()
                l, r = (np.arange(len(sig)), np.arange(len(sig))) if same else (np.flatnonzero(left), np.flatnonzero(~left))
                both = overlaps(diff) if same else overlaps([diff[i] for i in l], [diff[i] for i in r])
                both += t["whole"].to_numpy()[l, None] - gone[l, None] - gone[None, r]
                count = np.zeros((len(sig), len(sig)), bool)
                count[np.ix_(l, r)] = both >= threshold * (size[l, None] + size[None, r] - both)
                count |= count.T
                np.fill_diagonal(count, False)
                links = count @ copies
                tree = spanning(count)
                yield pa.RecordBatch.from_arrays([pa.array([*sig, *(sig[i] for i, _ in tree)], pa.binary()), pa.array([*[None] * len(sig), *(sig[j] for _, j in tree)], pa.binary()), pa.array([*links.tolist(), *[None] * len(tree)], pa.int64())], ["sig", "other", "links"])

    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = ["task", "sig", "copies", "size", "gone", "diff", "whole", "block", "lo", "hi"]
    return dealt.select(*cols).repartition(parts, "task").sortWithinPartitions("task").mapInArrow(block, "sig binary, other binary, links long")


def _edges(keys: np.ndarray) -> list[tuple[int, int]]:
    edge = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
    return list(zip(edge[:-1].tolist(), edge[1:].tolist()))


def join(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, key, class_id (least id of the class), n_links and n_shingles, one row a document row."""
    common.prepare(docs.sparkSession)
    rows = common.cut(sketched(docs, width))
    reps = rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.first("sk").alias("sk"), F.first("code").alias("code"))
    reps = common.cut(reps)
    small, large = leaves(reps.select("sig", "sk", "code"), runs_for(recall, threshold))
    if large is None:
        known = reps.select("sig", "n", "key", "copies", F.lit(None).cast("long").alias("gid"))
    else:
        member, size = common.cut_measured(groups(large))
        known = common.cut(common.small_join(reps.select("sig", "n", "key", "copies"), member, ["sig"], "left", size=size))
    pairs, _ = common.cut_measured(alike(candidates(small, known, threshold), reps, threshold))
    slots = pairs.select("path", F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.collect_set("path").alias("slots"))
    wanted = known.join(slots, "sig").select("sig", "key", "copies", "slots")
    edges, _ = common.cut_measured(verify(with_sets(docs, wanted, width), threshold).distinct())
    ends = F.array(F.struct(F.col("a").alias("sig"), F.col("cb").alias("links")), F.struct(F.col("b").alias("sig"), F.col("ca").alias("links")))
    links = edges.select(F.explode(ends).alias("e")).select("e.sig", "e.links")
    joined = edges.select("a", "b")
    if large is not None:
        grouped = known.where("gid is not null").select("sig", "key", "copies", F.array("gid").alias("slots"))
        blocks, _ = common.cut_measured(compare_blocks(common.cut(with_sets(docs, grouped, width).dropDuplicates(["slot", "sig"])), threshold))
        links = links.unionByName(blocks.where("links is not null").select("sig", "links"))
        joined = joined.unionByName(blocks.where("other is not null").select(F.col("sig").alias("a"), F.col("other").alias("b")))
    links = links.groupBy("sig").agg(F.sum("links").alias("links"))
    label, size = measured_components(joined)
    classed = common.small_join(reps.select("sig", "least", "copies"), label.withColumnRenamed("node", "sig"), ["sig"], "left", size=size)
    # only texts with links or copies are joined back: the others are their own class
    classed, _ = common.cut_measured(classed.where("label is not null or copies > 1").withColumn("label", F.coalesce("label", "sig")))
    ids = classed.groupBy("label").agg(F.min("least").alias("class_id"))
    classed = classed.join(ids, "label").join(links, "sig", "left").select("sig", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    special, size = common.cut_measured(classed.where("n_links > 0"))
    out = common.small_join(rows.select("doc_id", "key", "sig", "n"), special, ["sig"], "left", size=size)
    return out.select("doc_id", "key", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("n").alias("n_shingles"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class: the one with the least id, null first (ties: the least row key).

    Only the rows that go are looked up; of rows identical in id and text one stays.
    """
    classes = common.cut(join(docs, **options).where("n_links > 0").select("doc_id", "key", "class_id"))
    first = classes.groupBy("class_id").agg(F.min(F.struct("doc_id", "key")).alias("f")).select(F.col("f.doc_id").alias("doc_id"), F.col("f.key").alias("__k"))
    first = common.cut(first)
    seen = classes.groupBy("doc_id", F.col("key").alias("__k")).agg(F.count(F.lit(1)).alias("n"))
    same = (F.col("__k") == F.col("__f")) & F.col("doc_id").eqNullSafe(F.col("__i"))
    gone, size = common.cut_measured(seen.join(first.select(F.col("doc_id").alias("__i"), F.col("__k").alias("__f")), same, "left_anti").select("doc_id", "__k"))
    again = common.cut(seen.where("n > 1").join(first.select(F.col("doc_id").alias("__i"), F.col("__k").alias("__f")), same, "left_semi").select("doc_id", "__k"))
    rows = common.small_join(docs.withColumn("__k", common.row_key(docs)), gone, ["doc_id", "__k"], "left_anti", size=size)
    if not again.isEmpty():
        twice = common.small_join(rows, again, ["doc_id", "__k"], "left_semi").dropDuplicates(["doc_id", "__k"])
        rows = common.small_join(rows, again, ["doc_id", "__k"], "left_anti").unionByName(twice)
    return rows.drop("__k")
