"""Average-linkage clustering by cosine over any number of vectors.

The mean distance of two clusters of unit vectors is 1 - sum . sum / (sizes), so a cluster
is its sum and its size. Clusters that are each other's nearest can merge in any order
(average linkage is reducible), and a cluster whose nearest is beyond the distance is final.
With a distance, only clusters that a radius join finds near each other are compared.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.session import workers_import, written

from . import radius
from .vector import dot, normalized

#: Groups up to so many clusters are finished in one task, in memory linear in their number.
LOCAL = 8000
#: Vectors of a block in the search for nearest clusters: at least, at most, and the blocks that a group makes in between.
BLOCK, LARGEST, BLOCKS = 4096, 16384, 8
#: A round that merges less than this share of the clusters left is the last one for groups of up to so many clusters, which are then finished in one task each.
LEAST, FINISH = 0.2, 20_000


def _cut(df: DataFrame) -> DataFrame:
    """df written and read again: a checkpoint would keep the constraints and partitionings of each self-join,
    which double from round to round."""
    return written(df, "clusters")  # ids are few bytes in files: joins by id say that nothing is broadcast


def chain(ids: np.ndarray, sums: np.ndarray, n: np.ndarray, distance: float | None = None) -> list[tuple[int, int, float]]:
    """All merges (a, b, height) of clusters by nearest-neighbour chains, a < b naming clusters by their least id."""
    ids, n = ids.copy(), n.astype(float)
    mean, off = sums / n[:, None], np.zeros(len(ids))
    path: list[int] = []
    out, left = [], len(ids)
    while left > 1:
        if not path:
            if left < len(ids) // 2:
                live = off == 0
                ids, n, mean, off = ids[live], n[live], mean[live], off[live]
            path.append(int(np.argmax(off == 0)))
        x = path[-1]
        near = mean @ mean[x] + off
        near[x] = -np.inf
        y = int(np.argmax(near))
        if len(path) > 1 and near[path[-2]] >= near[y] - 1e-12:
            y = path[-2]
        d = 1 - near[y]
        if distance is not None and d > distance:
            off[x], left, path = -np.inf, left - 1, []
        elif len(path) > 1 and y == path[-2]:
            keep, gone = (x, y) if ids[x] < ids[y] else (y, x)
            out.append((int(ids[keep]), int(ids[gone]), max(0.0, float(d))))
            mean[keep] = (n[x] * mean[x] + n[y] * mean[y]) / (n[x] + n[y])
            n[keep] += n[gone]
            off[gone], left = -np.inf, left - 1
            del path[-2:]
        else:
            path.append(y)
    return out


def _nearest(clusters: DataFrame, sizes: DataFrame, kind: str) -> DataFrame:
    """(g, id, d, near) of each cluster's nearest in its group, the least id on a tie; each pair of blocks is one group."""
    blocks = F.ceil(F.col("c") / F.greatest(F.lit(BLOCK), F.least(F.lit(LARGEST), F.ceil(F.col("c") / BLOCKS))))  # each vector goes to every block
    rows = clusters.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("id"), blocks))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select("g", "id", F.transform("s", lambda x: x / F.col("n")).alias("m"), "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        same = frame["lo"].iloc[0] == frame["hi"].iloc[0]
        left = (frame["block"] == frame["lo"]).to_numpy()
        right = left if same else ~left
        ids, m = frame["id"].to_numpy(), np.stack(frame["m"].to_numpy())
        ia, ib, a, b = ids[left], ids[right], m[left], m[right]
        if not len(ia) or not len(ib):
            return pd.DataFrame({"g": frame["g"].iloc[:0], "id": ids[:0], "d": np.zeros(0), "near": ids[:0]})
        row, row_at = np.full(len(ia), np.inf), np.zeros(len(ia), int)
        col, col_at = np.full(len(ib), np.inf), np.zeros(len(ib), int)
        for start in range(0, len(ia), 512):
            d = 1 - a[start : start + 512] @ b.T  # each pair once, so that both sides see the same number
            if same:
                d[np.arange(len(ib))[None, :] <= np.arange(start, start + len(d))[:, None]] = np.inf
            at = d.argmin(1)
            row[start : start + len(d)], row_at[start : start + len(d)] = d[np.arange(len(d)), at], at
            at = d.argmin(0)
            least = d[at, np.arange(len(ib))]
            better = least < col
            col[better], col_at[better] = least[better], at[better] + start
        out = pd.DataFrame({"id": np.concatenate([ia, ib]), "d": np.concatenate([row, col]), "near": np.concatenate([ib[row_at], ia[col_at]])})
        out.insert(0, "g", frame["g"].iloc[0])
        return out[np.isfinite(out["d"])]

    found = dealt.groupBy("g", "lo", "hi").applyInPandas(search, f"g {kind}, id long, d double, near long")
    return found.groupBy("g", "id").agg(F.min(F.struct("d", "near")).alias("b")).select("g", "id", "b.d", "b.near")


def _finisher(start: int, distance: float | None):
    """All merges of a group of clusters (g, id, s, n, h), numbered from start."""

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        high = dict(zip(frame["id"], frame["h"], strict=True))
        rows = []
        for i, (a, b, d) in enumerate(chain(frame["id"].to_numpy(), np.stack(frame["s"].to_numpy()), frame["n"].to_numpy(), distance)):
            high[a] = max(d, high[a], high[b])
            rows.append((a, b, high[a], start + i))
        out = pd.DataFrame(rows, columns=["a", "b", "h", "step"]).astype({"a": "int64", "b": "int64", "h": float, "step": "int64"})
        out.insert(0, "g", frame["g"].iloc[0])
        return out

    return finish


def _merged(clusters: DataFrame, best: DataFrame) -> DataFrame:
    """g, a, b, s, n, h of the clusters that are each other's nearest, merged."""
    back = best.select("g", F.col("id").alias("near"), F.col("near").alias("id"))
    pairs = best.join(back.hint("merge"), ["g", "id", "near"]).where("id < near").select("g", F.col("id").alias("a"), F.col("near").alias("b"), "d")
    a = clusters.select("g", F.col("id").alias("a"), F.col("s").alias("sa"), F.col("n").alias("na"), F.col("h").alias("ha"))
    b = clusters.select("g", F.col("id").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb"), F.col("h").alias("hb"))
    return _cut(pairs.join(a.hint("merge"), ["g", "a"]).join(b.hint("merge"), ["g", "b"]).select("g", "a", "b", F.zip_with("sa", "sb", lambda x, y: x + y).alias("s"), (F.col("na") + F.col("nb")).alias("n"), F.greatest("d", "ha", "hb").alias("h")))


def _after(clusters: DataFrame, best: DataFrame, merged: DataFrame) -> DataFrame:
    """The clusters after a round; those without any nearest are final and go."""
    gone = merged.select("g", F.col("a").alias("id")).unionByName(merged.select("g", F.col("b").alias("id")))
    rest = clusters.join(best.select("g", "id").hint("merge"), ["g", "id"], "left_semi").join(gone.hint("merge"), ["g", "id"], "left_anti")
    return _cut(rest.select("g", "id", "s", "n", "h").unionByName(merged.select("g", F.col("a").alias("id"), "s", "n", "h")))


def _step(merged: DataFrame, step: int) -> DataFrame:
    return merged.select("g", "a", "b", "h", F.lit(step).cast("long").alias("step"))


def _merges_within(clusters: DataFrame, distance: float, local: int, kind: str) -> list[DataFrame]:
    """Merges at heights up to the distance.

    Clusters further apart than the distance never come within it by merging, so each
    component of the graph of clusters within the distance is a problem of its own. The
    graph comes from a radius join of the means. Components up to `local` are finished in
    one task each; in larger ones all mutually nearest clusters merge, and the graph of
    what is left, which is sparser, is taken again.
    """
    edges, step, r = [], 0, float(np.sqrt(2 * distance))
    mean = F.transform("s", lambda x: x / F.col("n")).alias("v")
    while True:
        means = _cut(clusters.select("g", "id", mean))
        linked = radius.spanning_edges(radius.groups(means, r, radius.block_of(means.count(), BLOCK)), 1 - distance - radius.SLACK)
        clusters = _cut(clusters.join(radius.components(means, linked), ["g", "id"]))
        sizes = _cut(clusters.groupBy("g", "component").agg(F.count(F.lit(1)).alias("c")))
        lonely = clusters.join(sizes.where((F.col("c") <= local) & (F.col("c") > 1)), ["g", "component"], "left_semi")
        edges.append(_cut(lonely.groupBy("g", "component").applyInPandas(_finisher(step, distance), f"g {kind}, a long, b long, h double, step long")))
        clusters = _cut(clusters.join(sizes.where(F.col("c") > local), ["g", "component"], "left_semi").drop("component"))
        if clusters.isEmpty():
            return edges
        means = _cut(clusters.select("g", "id", mean))
        best = _cut(radius.nearest_within(radius.groups(means, r, radius.block_of(means.count(), BLOCK)), 1 - distance))
        merged = _merged(clusters, best)
        if merged.isEmpty():
            return edges
        edges.append(_step(merged, step))
        clusters = _after(clusters, best, merged)
        step += 1


def merges(vectors: DataFrame, distance: float | None = None, local: int | None = None) -> DataFrame:
    """(g, a, b, h, step): every merge in each group g of vectors (g, id, v), b being absorbed by a < b at height h.

    Equal vectors merge first, at height 0. Without a distance, groups over `local`
    clusters merge all pairs of mutually nearest clusters in rounds of Spark jobs, the
    others are finished in one task each; with one, see _merges_within().
    """
    workers_import(vectors.sparkSession)
    local, kind = local or LOCAL, vectors.schema["g"].dataType.simpleString()
    unit = vectors.select("g", "id", normalized(F.col("v")).alias("v"))
    unit = _cut(unit.withColumn("own", F.when(dot(F.col("v"), F.col("v")) < 1 - 1e-9, F.col("id")).otherwise(F.lit(None))))  # a zero vector equals none
    key = ["g", "v", F.coalesce("own", F.lit(-1).cast("long")).alias("own")]
    same = unit.select("id", *key).groupBy("g", "v", "own").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n"))
    copies = unit.select("id", *key).join(same.where("n > 1").select("g", "v", "own", "a"), ["g", "v", "own"]).where("id <> a")
    edges = [_cut(copies.select("g", "a", F.col("id").alias("b"), F.lit(0.0).alias("h"), F.lit(-1).cast("long").alias("step")))]
    clusters = _cut(same.select("g", F.col("a").alias("id"), F.transform("v", lambda x: x * F.col("n")).alias("s"), "n", F.lit(0.0).alias("h")))
    if distance is not None:
        edges += _merges_within(clusters, distance, local, kind)
        return functools.reduce(DataFrame.unionByName, edges)
    step = 0
    while True:
        sizes = _cut(clusters.groupBy("g").agg(F.count(F.lit(1)).alias("c")))
        large = sizes.where(F.col("c") > local)
        few = clusters.join(sizes.where((F.col("c") <= local) & (F.col("c") > 1)).select("g"), "g", "left_semi")
        edges.append(_cut(few.groupBy("g").applyInPandas(_finisher(step, None), f"g {kind}, a long, b long, h double, step long")))
        before = large.agg(F.sum("c")).first()[0]
        if not before:
            break
        clusters = clusters.join(large.select("g"), "g", "left_semi")
        best = _cut(_nearest(clusters, large, kind))
        merged = _merged(clusters, best)
        edges.append(_step(merged, step))
        clusters = _after(clusters, best, merged)
        step += 1
        if merged.count() < LEAST * before:
            local = max(local, FINISH)  # long chains: rounds no longer pay
    return functools.reduce(DataFrame.unionByName, edges)


def numbered(reps: DataFrame) -> DataFrame:
    """(g, id, cluster): 0, 1, .. in each group by id, without a task that holds a group."""
    parts = _cut(reps.repartitionByRange("g", "id").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("g", "part").agg(F.count(F.lit(1)).alias("c")).select("g", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    n = F.row_number().over(Window.partitionBy("g", "part").orderBy("id"))
    return parts.withColumn("n", n).join(counts, ["g", "part"]).select("g", "id", (F.col("before") + F.col("n") - 1).cast("int").alias("cluster"))


def labels(vectors: DataFrame, tree: DataFrame) -> DataFrame:
    """(g, id, cluster) of vectors (g, id) by the merges in tree, numbered by each cluster's least id."""
    now = vectors.select("g", "id").join(tree.select("g", F.col("b").alias("id"), "a").hint("merge"), ["g", "id"], "left").select("g", "id", F.coalesce("a", "id").alias("root"))
    now = _cut(now)
    while True:
        far = now.where("root <> id").select("g", F.col("id").alias("root"), F.col("root").alias("far"))
        new = _cut(now.join(far.hint("merge"), ["g", "root"], "left").select("g", "id", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    number = numbered(now.where("root = id").select("g", "id"))
    return now.join(number.select("g", F.col("id").alias("root"), "cluster").hint("merge"), ["g", "root"]).select("g", "id", "cluster")


def cut_tree(vectors: DataFrame, tree: DataFrame, k: Column) -> DataFrame:
    """tree without each group's k - 1 highest merges; k: of a group's size n."""
    wanted = _cut(vectors.groupBy("g").agg(F.count(F.lit(1)).alias("n")).select("g", k.alias("k")))
    most = wanted.agg(F.max("k")).first()[0] or 1
    w = Window.partitionBy("g").orderBy(F.desc("h"), F.desc("step"), F.desc("b"))
    top = tree.select("g", "b", "h", "step").withColumn("r", F.row_number().over(w)).where(F.col("r") < most)
    top = _cut(top.join(wanted, "g").where("r < k").select("g", "b"))
    return tree.join(top, ["g", "b"], "left_anti")


def target_clusters(n: Column, target: int | None) -> Column:
    """vector.target_clusters as a Column."""
    tenth = F.greatest(F.lit(5), F.floor(n / 10))
    wanted = F.lit(target) if target else F.greatest(F.lit(5), F.least(F.lit(20), F.floor(n / 20)))
    return F.greatest(F.lit(1), F.least(wanted, tenth, F.lit(20)))


def tree_of(vectors: DataFrame, group: str, local: int | None = None) -> DataFrame:
    """merges() of all vectors of each group in one table, for agglomerate() and split_oversized()."""
    return _cut(merges(vectors.select(F.col(group).alias("g"), "id", "v"), local=local))


def agglomerate(vectors: DataFrame, group: str, target: int | None = 15, distance: float | None = None, local: int | None = None, tree: DataFrame | None = None) -> DataFrame:
    """(group, id, cluster) by average linkage inside each group, of any size: to a number of clusters, or below a distance.

    tree: that of tree_of(), if it is at hand and there is no distance.
    """
    rows = vectors.select(F.col(group).alias("g"), "id", "v")
    tree = merges(rows, distance, local) if tree is None else tree
    if distance is None:
        tree = cut_tree(rows, tree, target_clusters(F.col("n"), target))
    return labels(rows, tree).withColumnRenamed("g", group)


def _within(tree: DataFrame, rows: DataFrame) -> DataFrame:
    """The merges of tree inside each set of rows (g, key, id), by the sets' keys."""
    a, b = (rows.select("g", F.col("id").alias(x), F.col("key").alias(f"k{x}")) for x in "ab")
    return _cut(tree.join(a.hint("merge"), ["g", "a"]).join(b.hint("merge"), ["g", "b"]).where("ka = kb").select(F.col("ka").alias("g"), "a", "b", "h", "step"))


def split_oversized(clusters: DataFrame, vectors: DataFrame, group: str, share: float = 0.4, levels: int = 3, local: int | None = None, tree: DataFrame | None = None) -> DataFrame:
    """Clusters above a share of their group are split again, at most `levels` times; new numbers follow the largest.

    tree: that of tree_of(), if the clusters are cut from it. Average linkage merges the
    members of one of its clusters in the same order by themselves as among all others, so
    their part of it is their own tree, and nothing is clustered again.
    """
    now = _cut(clusters.select(F.col(group).alias("g"), "id", "cluster"))
    totals = now.groupBy("g").agg(F.count(F.lit(1)).alias("total"))
    for _ in range(levels):
        sizes = now.groupBy("g", "cluster").agg(F.count(F.lit(1)).alias("size"))
        top = sizes.groupBy("g").agg(F.max("cluster").alias("top"))
        big = _cut(sizes.join(totals, "g").join(top, "g").where((F.col("size") > share * F.col("total")) & (F.col("total") >= 3)).withColumn("key", F.monotonically_increasing_id()))
        if big.isEmpty():
            break
        rows = _cut(now.join(big.select("g", "cluster", "key"), ["g", "cluster"]).select("g", F.col("key"), "id"))
        if tree is None:
            own = rows.select(F.col("key").alias("g"), "id").join(vectors.select("id", "v").hint("merge"), "id")
            inner = merges(own, local=local)
        else:
            inner = _within(tree, rows)
        rows = rows.select(F.col("key").alias("g"), "id")
        k = F.greatest(F.lit(3), F.least(F.lit(5), F.floor(F.col("n") / 50)))
        part = labels(rows, cut_tree(rows, inner, k)).select(F.col("g").alias("key"), "id", F.col("cluster").alias("part"))
        part = _cut(part)
        more = part.groupBy("key").agg(F.max("part").alias("more"))
        before = Window.partitionBy("g").orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)
        base = big.join(more, "key").select("g", "cluster", "key", (F.col("top") + F.coalesce(F.sum("more").over(before), F.lit(0))).alias("base"))
        moved = part.where("part > 0").join(base, "key").select("g", "id", (F.col("base") + F.col("part")).cast("int").alias("new"))
        now = _cut(now.join(moved, ["g", "id"], "left").select("g", "id", F.coalesce("new", "cluster").alias("cluster")))
    return now.withColumnRenamed("g", group)
