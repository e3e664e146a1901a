"""Exact joins of vectors within a radius, by pivots and rings.

Each vector goes home to its nearest pivot, into the ring of its distance to it. It also
visits other pivots' rings: if y lives with pivot q and x with p, and they are within r
of each other, then d(x, q) - d(x, p) <= 2r, and y's ring lies within r of d(x, q). So a
vector is compared only with the rings that may hold a neighbour; vectors of one pivot
meet in the lower ring. Homes and visitors of a ring are cut into blocks, and each pair
of blocks is one group, so no ring has to fit one task.

Cosine similarity t of unit vectors is a Euclidean radius of sqrt(2 - 2t); means of unit
vectors whose mean distance is at most d are within sqrt(2d) of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.session import workers_import, written

#: Vectors of a block: at least, at most (with 64 coordinates 8 MB), and the blocks that all vectors make in between; pivots at most.
BLOCK, LARGEST, BLOCKS, PIVOTS = 2048, 16384, 24, 1024
SLACK = 1e-9


def block_of(n: int, least: int = BLOCK) -> int:
    """How many of n vectors a block has: where pivots rule nothing out each vector goes to every block, so their number hardly grows."""
    return max(least, min(LARGEST, -(-n // BLOCKS)))


def pivots_of(vectors: DataFrame, n: int, block: int) -> np.ndarray:
    """A bounded choice of the n vectors, by hash of their ids: about one a block."""
    k = max(1, min(PIVOTS, -(-n // block)))
    rows = vectors.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(k).collect()
    return np.array([r["v"] for r in rows], float) if rows else np.zeros((0, 0))


def visits(vectors: DataFrame, pivots: np.ndarray, r: float) -> DataFrame:
    """g, id, cell, ring, home: where each vector lives, and the lower cells and rings where neighbours of it may live."""
    workers_import(vectors.sparkSession)
    width, square = max(r, SLACK), (pivots * pivots).sum(1)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            v = np.stack(frame["v"].to_numpy())
            d = np.sqrt(np.maximum((v * v).sum(1)[:, None] + square - 2 * (v @ pivots.T), 0))
            home, all_rows = d.argmin(1), np.arange(len(v))
            own = d[all_rows, home]
            ring = np.floor(own / width).astype(int)
            row, cell = np.nonzero((d - own[:, None] <= 2 * r + SLACK) & (np.arange(len(pivots)) <= home[:, None]))
            low = np.maximum(np.floor((d[row, cell] - r - SLACK) / width), 0).astype(int)
            high = np.floor((d[row, cell] + r + SLACK) / width).astype(int)
            high = np.where(cell == home[row], ring[row] - 1, high)
            n = np.maximum(high - low + 1, 0)
            at = np.repeat(np.arange(len(row)), n)
            rings = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            rows = np.concatenate([all_rows, row[at]])
            out = frame[["g", "id"]].iloc[rows].reset_index(drop=True)
            out["cell"], out["ring"] = np.concatenate([home, cell[at]]), np.concatenate([ring, rings])
            out["home"] = np.arange(len(rows)) < len(v)
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select("g", "id", "v").mapInPandas(place, f"g {kinds['g']}, id {kinds['id']}, cell int, ring int, home boolean")


def block_pairs(placed: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """placed (keys, id, home) with the groups (h, w) of each row and whether it is home in that group.

    Group (h, w) holds home block h and, for w > 0, one block of visitors, or a later
    home block, which visits there. Together they meet each pair of rows with a home row once.
    """
    counts = placed.groupBy(*keys).agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests")).where("homes > 0")
    counts = counts.select(*keys, F.ceil(F.col("homes") / block).cast("int").alias("nb"), F.ceil(F.col("guests") / block).cast("int").alias("nv"))
    rows = placed.join(counts, keys)
    b, c, nb, nv = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"), F.pmod(F.xxhash64("id"), F.greatest("nv", F.lit(1))).cast("int"), F.col("nb"), F.col("nv")
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), lambda i: i < n)
    at = lambda h, w, home: F.struct(h.cast("int").alias("h"), w.cast("int").alias("w"), F.lit(home).alias("here"))
    own = F.transform(F.filter(upto(1 + nv + nb), lambda w: (w <= nv) | (w > 1 + nv + b)), lambda w: at(b, w, True))
    as_guest = F.transform(upto(b), lambda h: at(h, 1 + nv + b, False))
    guest = F.transform(upto(nb), lambda h: at(h, 1 + c, False))
    dealt = F.when(F.col("home"), F.concat(own, as_guest)).otherwise(guest)
    return rows.select(*keys, "id", F.inline(dealt))


def groups(vectors: DataFrame, r: float, block: int | None = None) -> DataFrame:
    """g, cell, ring, h, w, here, id, v: rows of the groups in which all pairs of one g within r meet.

    The places of the vectors are few bytes in files and many rows, so that side of the
    join is never broadcast.
    """
    vectors, n = vectors.select("g", "id", "v"), vectors.count()
    block = block or block_of(n)
    pivots = pivots_of(vectors, n, block)
    if not len(pivots):
        return vectors.selectExpr("g", "0 as cell", "0 as ring", "0 as h", "0 as w", "true as here", "id", "v")
    placed = written(visits(vectors, pivots, r), "visits")
    return block_pairs(placed, ["g", "cell", "ring"], block).join(vectors.hint("merge"), ["g", "id"])


KEYS = ["g", "cell", "ring", "h", "w"]


def slabs(frame: pd.DataFrame, similar: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, similarities) of a group's pairs, each pair once, a few hundred home rows at a time.

    rows and columns are positions in frame: home rows against each other in group w = 0,
    against the visitors in the others.
    """
    here = frame["here"].to_numpy()
    left = np.flatnonzero(here)
    alone = frame["w"].iloc[0] == 0
    right = left if alone else np.flatnonzero(~here)
    for start in range(0, len(left), 256):
        rows = left[start : start + 256]
        s = similar(rows, right)
        if alone:
            s = np.where(np.arange(len(right))[None, :] > np.arange(start, start + len(rows))[:, None], s, -np.inf)
        yield rows, right, s


def dense(frame: pd.DataFrame) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    v = np.stack(frame["v"].to_numpy())
    return lambda rows, columns: v[rows] @ v[columns].T


def spanning(frame: pd.DataFrame, least: float, similarity=dense) -> pd.DataFrame:
    """g, a, b: a spanning forest of a group's pairs of similarity at least `least`."""
    frame = frame.sort_values("id", ignore_index=True)
    label, out = np.arange(len(frame)), []
    for rows, columns, s in slabs(frame, similarity(frame)):
        hit = s >= least
        for i in np.flatnonzero(hit.any(1)):
            a = rows[i]
            for other in np.unique(label[columns[hit[i]]]):
                if other != label[a]:
                    out.append((a, other))
                    label[label == max(other, label[a])] = min(other, label[a])
    a, b = np.array(out, int).reshape(-1, 2).T
    ids = frame["id"].to_numpy()
    return pd.DataFrame({"g": frame["g"].iloc[:1].repeat(len(a)).to_numpy(), "a": ids[a], "b": ids[b]})


def all_pairs(frame: pd.DataFrame, least: float, similarity=dense) -> pd.DataFrame:
    """g, a, b, similarity of a group's pairs, a < b."""
    frame = frame.sort_values("id", ignore_index=True)
    ids, out = frame["id"].to_numpy(), []
    for rows, columns, s in slabs(frame, similarity(frame)):
        i, j = np.nonzero(s >= least)
        x, y = ids[rows[i]], ids[columns[j]]
        out.append(pd.DataFrame({"g": frame["g"].iloc[0], "a": np.minimum(x, y), "b": np.maximum(x, y), "similarity": s[i, j]}))
    return pd.concat(out) if out else pd.DataFrame({"g": frame["g"].iloc[:0], "a": ids[:0], "b": ids[:0], "similarity": np.zeros(0)})


def best(frame: pd.DataFrame, least: float, similarity=dense) -> pd.DataFrame:
    """g, id, d, near: each row's nearest in its group at a similarity of at least `least`, the least id on a tie."""
    frame = frame.sort_values("id", ignore_index=True)
    ids = frame["id"].to_numpy()
    top, near = np.full(len(ids), -np.inf), np.zeros(len(ids), int)
    for rows, columns, s in slabs(frame, similarity(frame)):
        if not s.size:
            continue
        for own, other, part in ((rows, columns, s), (columns, rows, s.T)):
            at = part.argmax(1)
            most = part[np.arange(len(own)), at]
            better = (most > top[own]) | ((most == top[own]) & (most > -np.inf) & (ids[other[at]] < ids[near[own]]))
            top[own[better]], near[own[better]] = most[better], other[at[better]]
    found = np.flatnonzero(top >= least)
    return pd.DataFrame({"g": frame["g"].iloc[:1].repeat(len(found)).to_numpy(), "id": ids[found], "d": 1 - top[found], "near": ids[near[found]]})


def _run(dealt: DataFrame, kernel: Callable, least: float, columns: str, similarity=dense, keys: list[str] = KEYS) -> DataFrame:
    workers_import(dealt.sparkSession)
    return dealt.groupBy(*keys).applyInPandas(lambda frame: kernel(frame, least, similarity), columns)


def spanning_edges(dealt: DataFrame, least: float, similarity=dense, keys: list[str] = KEYS) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    return _run(dealt, spanning, least, f"g {kinds['g']}, a {kinds['id']}, b {kinds['id']}", similarity, keys)


def pairs(dealt: DataFrame, least: float, similarity=dense, keys: list[str] = KEYS) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    return _run(dealt, all_pairs, least, f"g {kinds['g']}, a {kinds['id']}, b {kinds['id']}, similarity double", similarity, keys)


def nearest_within(dealt: DataFrame, least: float, similarity=dense, keys: list[str] = KEYS) -> DataFrame:
    """g, id, d, near over all groups; dealt holds every pair of similarity at least `least`."""
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    found = _run(dealt, best, least, f"g {kinds['g']}, id {kinds['id']}, d double, near {kinds['id']}", similarity, keys)
    return found.groupBy("g", "id").agg(F.min(F.struct("d", "near")).alias("b")).select("g", "id", "b.d", "b.near")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """g, id, component of nodes (g, id) by edges (g, a, b): the least id reachable.

    Minimum labels with pointer jumping, each round a written table, until nothing moves.
    Labels grow with the nodes and are not broadcast.
    """
    both = written(edges.select("g", "a", "b").unionByName(edges.select("g", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(nodes.select("g", "id", F.col("id").alias("component")), "labels")
    while True:
        near = both.join(labels.select("g", F.col("id").alias("b"), "component").hint("merge"), ["g", "b"]).select("g", F.col("a").alias("id"), "component")
        least = near.unionByName(labels).groupBy("g", "id").agg(F.min("component").alias("next"))
        was = least.join(labels.withColumnRenamed("component", "was").hint("merge"), ["g", "id"])
        jump = labels.select("g", F.col("id").alias("next"), F.col("component").alias("far"))
        new = written(was.join(jump.hint("merge"), ["g", "next"]).select("g", "id", F.least("next", "far").alias("component"), "was"), "labels")
        if new.where("component <> was").isEmpty():
            return new.drop("was")
        labels = new.drop("was")


def radius_components(vectors: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """g, id, component of unit vectors (g, id, v): linked where their cosine is at least the threshold, directly or by others.

    Equal vectors hang on the least id of theirs and only that one is compared, so a
    group of copies costs one edge each.
    """
    unit = written(vectors.select("g", "id", "v"), "unit")
    own = F.when(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < 0.5, F.col("id"))  # a zero vector equals none
    rows = unit.withColumn("own", own)
    first = written(rows.groupBy("g", "v", "own").agg(F.min("id").alias("first")), "first")
    named = first.select(F.col("g").alias("fg"), F.col("v").alias("fv"), F.col("own").alias("fo"), "first")
    copies = rows.join(named, F.col("g").eqNullSafe(F.col("fg")) & (F.col("v") == F.col("fv")) & F.col("own").eqNullSafe(F.col("fo")))
    star = copies.where("id <> first").select("g", F.col("first").alias("a"), F.col("id").alias("b"))
    alone = first.where("v is not null").select("g", F.col("first").alias("id"), "v")
    near = spanning_edges(groups(alone, float(np.sqrt(max(2 - 2 * threshold, 0))), block), threshold)
    return components(unit, near.unionByName(star))
