"""Vectors: cosine, TF-IDF, radius components, canonical choice, centroids, nearest neighbours, linkage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.session import workers_import, written

from . import radius


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """a over its length; a zero vector stays nearly zero. The length is bound as an array's element, else each coordinate computes it anew."""
    over = lambda n: F.transform(a, lambda x: x.cast("double") / n)
    return F.element_at(F.transform(F.array(norm(a) + 1e-12), over), 1)


def similar_pairs(vectors: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """(a, b, similarity), a < b, of cosine similarity at least threshold; vectors: id, v.

    Vectors meet in the rings of pivots that may hold them both, and a group of blocks is
    compared by a matrix product in bounded memory; see radius.
    """
    unit = written(vectors.where("v is not null").select(F.lit(0).alias("g"), "id", normalized(F.col("v")).alias("v")), "unit")
    dealt = radius.groups(unit, float(np.sqrt(max(2 - 2 * threshold, 0))), block)
    return radius.pairs(dealt, threshold).select("a", "b", "similarity")


def radius_components(vectors: DataFrame, threshold: float) -> DataFrame:
    """(id, component): components of the graph of cosines at least threshold; spanning edges stand for its pairs."""
    unit = vectors.select(F.lit(0).alias("g"), "id", normalized(F.col("v")).alias("v"))
    return radius.radius_components(unit, threshold).select("id", "component")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable by edges (a, b)."""
    zero = F.lit(0).alias("g")
    return radius.components(nodes.select(zero, "id"), edges.select(zero, "a", "b")).select("id", "component")


def canonical(clusters: DataFrame) -> DataFrame:
    """Of cluster, text, freq: the most frequent text, the shorter on a tie, then the smaller."""
    w = Window.partitionBy("cluster").orderBy(F.desc("freq"), F.length("text"), "text")
    return clusters.withColumn("r", F.row_number().over(w)).where("r = 1").select("cluster", F.col("text").alias("canonical_text"))


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Mean of the unit vectors of each group, as a unit vector, by partial sums per coordinate."""
    cells = vectors.select(group, F.posexplode(normalized(F.col("v"))).alias("i", "x"))
    mean = cells.groupBy(group, "i").agg(F.avg("x").alias("x"))
    whole = mean.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("m"))
    return whole.select(group, normalized(F.col("m")).alias("centroid"))


def member_similarity(vectors: DataFrame, group: str) -> DataFrame:
    """Each vector's cosine to its group's centroid."""
    return vectors.join(centroids(vectors, group), group).select("id", group, dot(normalized(F.col("v")), F.col("centroid")).alias("similarity"))


def medoid_samples(vectors: DataFrame, group: str, k: int) -> DataFrame:
    """The k members nearest to each centroid; rank 1 is the medoid."""
    w = Window.partitionBy(group).orderBy(F.desc(F.round("similarity", 9)), "id")
    return member_similarity(vectors, group).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(group, "id", "rank")


def intra_similarity(vectors: DataFrame, group: str) -> DataFrame:
    """Mean pairwise cosine of each group without any pair: (|sum v|^2 - n) / (n (n - 1)), 1 for one member."""
    cells = vectors.select(group, "id", F.posexplode(normalized(F.col("v"))).alias("i", "x"))
    sums = cells.groupBy(group, "i").agg(F.sum("x").alias("s"))
    total = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    n = vectors.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("n") == 1, F.lit(1.0)).otherwise((F.col("q") - F.col("n")) / F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1)))
    return total.join(n, group).select(group, "n", F.round(value, 6).alias("mean_similarity"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, limit: int = 1000, slice_rows: int = 4096) -> DataFrame:
    """The k largest cosines of each query; queries in blocks of about limit meet the vectors in slices, by matrix products."""
    blocks, slices = max(1, -(-queries.count() // limit)), max(1, -(-vectors.count() // slice_rows))
    scored = _block_nearest(vectors, queries, k, blocks, slices)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block_nearest(vectors: DataFrame, queries: DataFrame, k: int, blocks: int, slices: int) -> DataFrame:
    """(query_id, id, score): the k best of each query in each slice of vectors; a block of queries and a slice are one group."""
    workers_import(vectors.sparkSession)

    def dealt(df: DataFrame, own: str, own_n: int, other: str, other_n: int, query: bool) -> DataFrame:
        rows = df.select("id", normalized(F.col("v")).alias("v"), F.lit(query).alias("query"), F.pmod(F.xxhash64("id"), F.lit(own_n).cast("long")).alias(own))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_n - 1).cast("long"))))

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        is_query = frame["query"].to_numpy()
        ids, v = frame["id"].to_numpy(), np.stack(frame["v"].to_numpy())
        q_ids, q, x_ids, x = ids[is_query], v[is_query], ids[~is_query], v[~is_query]
        out = []
        for i in range(len(q) if len(x) else 0):
            score = np.round(x @ q[i], 6)
            top = np.argsort(-score, kind="stable")[: k + 1]
            top = top[x_ids[top] != q_ids[i]][:k]
            out.append(pd.DataFrame({"query_id": q_ids[i], "id": x_ids[top], "score": score[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": ids[:0], "id": ids[:0], "score": np.zeros(0)})

    both = dealt(queries, "block", blocks, "slice", slices, True).unionByName(dealt(vectors, "slice", slices, "block", blocks, False))
    return both.groupBy("block", "slice").applyInPandas(best, "query_id long, id long, score double")


def tfidf(texts: DataFrame, sizes: tuple[int, ...] = (2, 3, 4), digits: int | None = 6) -> DataFrame:
    """(id, gram, weight): character n-grams inside padded words, smoothed idf, unit length; weights to so many digits."""
    words = texts.select("id", F.explode(F.split("text", r"\s+")).alias("w")).where("w <> ''").select("id", F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    n = F.length("w")
    grams = F.concat(*[_grams(n, k) for k in sizes])
    tf = words.select("id", F.explode(grams).alias("gram")).groupBy("id", "gram").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    total = texts.agg(F.count(F.lit(1)).alias("docs"))
    w = tf.join(df, "gram").join(F.broadcast(total), F.lit(True)).withColumn("w", F.col("tf") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    length = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    weight = F.col("w") / F.col("length")
    return w.join(length, "id").select("id", "gram", (weight if digits is None else F.round(weight, digits)).alias("weight"))


def _grams(n: Column, k: int) -> Column:
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(F.col("w"), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def linkage(v: np.ndarray, k: int | None = None, distance: float | None = None) -> np.ndarray:
    """Average-linkage labels of the rows of v by cosine: down to k clusters, or while merges are below distance."""
    n = len(v)
    unit = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), n
    while alive > (k or 1):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if distance is not None and d[i, j] > distance:
            break
        i, j = min(i, j), max(i, j)
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        alive -= 1
    return np.unique(label, return_inverse=True)[1]


def target_clusters(n: int, target: int | None = 15) -> int:
    return max(1, min(target or max(5, min(20, n // 20)), max(5, n // 10), 20))
