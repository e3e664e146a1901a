"""Fusion of the objects of many domains: semantic groups of objects, joint clusters of their samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.session import workers_import, written

from . import clustering, embed, radius, vector

SAMPLES = 20


def object_text(name: Column, description: Column, samples: Column, most: int = 5) -> Column:
    """What an object says: its name, its description and its first samples; empty parts are left out."""
    some = F.array_join(F.slice(F.coalesce(samples, F.array().cast("array<string>")), 1, most), "、")
    parts = [F.coalesce(name, F.lit("")), F.when(description != "", description), F.when(some != "", some)]
    return F.concat_ws(" | ", *parts)


def semantic_groups(objects: DataFrame, distance: float = 0.15, local: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of objects by average linkage of their vectors.

    objects: id, domain, object_name, cluster_size, v. groups: group_id (the least id),
    repr_name (the largest member's; ties to the smaller id), aliases (sorted distinct
    names), domains, members, total_size, avg_similarity (mean cosine of all pairs, 1 for
    one member). members: group_id, id. Names of a group are made distinct before they meet.
    """
    vectors = objects.select(F.lit(0).alias("g"), "id", "v")
    labels = clustering.agglomerate(vectors.withColumnRenamed("g", "label"), "label", distance=distance, local=local)
    first = labels.groupBy("cluster").agg(F.min("id").alias("group_id"))
    members = written(labels.join(first, "cluster").select("group_id", "id"), "members")
    rows = objects.join(members, "id")
    size = rows.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.sum("cluster_size").alias("total_size"),
        F.max_by("object_name", F.struct("cluster_size", -F.col("id"))).alias("repr_name"),
    )
    names = rows.groupBy("group_id").agg(F.array_sort(F.collect_set("object_name")).alias("aliases"), F.array_sort(F.collect_set("domain")).alias("domains"))
    alike = vector.intra_similarity(rows.select("group_id", "id", "v"), "group_id").select("group_id", F.col("mean_similarity").alias("avg_similarity"))
    return size.join(names, "group_id").join(alike, "group_id"), members


def flat_samples(objects: DataFrame, most: int = SAMPLES) -> DataFrame:
    """domain, object_code, object_name, sample: the first samples of each object, its name where it has none; trimmed, blank ones gone."""
    own = F.when(F.size("samples") > 0, F.slice("samples", 1, most)).otherwise(F.array("object_name"))
    rows = objects.select("domain", "object_code", "object_name", F.explode(own).alias("sample"))
    return rows.withColumn("sample", F.trim("sample")).where("sample <> ''")


def prefixes(vectors: DataFrame, least: float) -> DataFrame:
    """id, term: the terms of each sparse vector that a partner with a product of at least `least` must share one of.

    vectors: id, terms, weights, of length 1 at most. Terms go from rare to common; where
    what remains has a length under `least`, sharing only that cannot be enough, so the
    rest of the vector is no prefix. Two vectors that are near enough share a term in the
    prefixes of both: the first that they have in common.
    """
    cells = vectors.select("id", F.explode(F.arrays_zip("terms", "weights")).alias("c")).select("id", F.col("c.terms").alias("term"), F.col("c.weights").alias("w"))
    often = cells.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("id").orderBy("df", "term")  # the terms of one vector
    rest = F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = cells.join(often, "term").withColumn("rest", F.sqrt(rest))
    return ranked.where(F.col("rest") >= least - radius.SLACK).select("id", "term")


def sparse(frame: pd.DataFrame):
    """Products of a group's sparse vectors, over the terms of the group."""
    sizes = frame["terms"].map(len).to_numpy()
    owner = np.repeat(np.arange(len(frame)), sizes)
    terms, place = np.unique(np.concatenate(frame["terms"].to_list() or [[]]), return_inverse=True)
    weight = np.concatenate(frame["weights"].to_list() or [[]]).astype(float)

    def similar(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(columns)))
        for start in range(0, len(terms), 2048):  # a stretch of terms at a time
            here = (place >= start) & (place < start + 2048)
            part = np.zeros((len(frame), min(2048, len(terms) - start)), np.float64)
            part[owner[here], place[here] - start] = weight[here]
            out += part[rows] @ part[columns].T
        return out

    return similar


SPARSE_KEYS = ["g", "term", "h", "w"]


def sparse_groups(vectors: DataFrame, least: float, block: int = 512) -> DataFrame:
    """g, term, h, w, here, id, terms, weights: groups in which all pairs with a product of at least `least` meet.

    The rows of a term are cut into blocks, and each pair of blocks is one group, so a
    common term does not have to fit one task.
    """
    placed = written(prefixes(vectors, least).select(F.lit(0).alias("g"), "id", "term", F.lit(True).alias("home")), "prefixes")
    return radius.block_pairs(placed, ["g", "term"], block).join(vectors, "id")


def _linked(vectors: DataFrame, least: float, block: int) -> DataFrame:
    """id, component of sparse vectors linked by products of at least `least`."""
    edges = radius.spanning_edges(sparse_groups(vectors, least, block), least - radius.SLACK, sparse, SPARSE_KEYS)
    return radius.components(vectors.select(F.lit(0).alias("g"), "id"), edges).select("id", "component")


def sparse_linkage(vectors: DataFrame, distance: float, local: int = clustering.LOCAL, block: int = 512) -> DataFrame:
    """id, root: average-linkage clusters of sparse unit vectors below a cosine distance, by their least id.

    vectors: id, n (how many rows have this vector), terms, weights. Only components of
    the graph of clusters within the distance are clustered, each in one task up to
    `local` clusters; in larger ones mutually nearest clusters merge, as sums of sparse
    vectors, and the graph is taken again. A join finds the pairs (see prefixes()).
    """
    spark = vectors.sparkSession
    workers_import(spark)
    least = 1 - distance
    clusters = written(vectors.select("id", F.col("n").cast("double").alias("n"), "terms", "weights"), "means")  # means of unit vectors
    tree = []

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", ignore_index=True)
        label = linkage_of(sparse(frame)(np.arange(len(frame)), np.arange(len(frame))), frame["n"].to_numpy(float), distance)
        ids = frame["id"].to_numpy()
        return pd.DataFrame({"id": ids, "root": ids[label]})[label != np.arange(len(ids))]

    while True:
        linked = written(clusters.join(_linked(clusters.select("id", "terms", "weights"), least, block), "id"), "linked")
        sizes = linked.groupBy("component").agg(F.count(F.lit(1)).alias("c"))
        few = linked.join(sizes.where((F.col("c") > 1) & (F.col("c") <= local)), "component", "left_semi")
        tree.append(written(few.groupBy("component").applyInPandas(finish, "id long, root long"), "tree"))
        clusters = written(linked.join(sizes.where(F.col("c") > local), "component", "left_semi").drop("component"), "means")
        if clusters.isEmpty():
            break
        best = written(radius.nearest_within(sparse_groups(clusters.select("id", "terms", "weights"), least, block), least, sparse, SPARSE_KEYS), "best")
        back = best.select(F.col("id").alias("near"), F.col("near").alias("id"))
        merged = written(best.join(back, ["id", "near"]).where("id < near").select(F.col("near").alias("id"), F.col("id").alias("root")), "merged")
        if merged.isEmpty():
            break
        tree.append(merged)
        alive = clusters.join(best.select("id"), "id", "left_semi").join(merged, "id", "left").select(F.coalesce("root", "id").alias("id"), "n", F.explode(F.arrays_zip("terms", "weights")).alias("c"))
        totals = clusters.join(best.select("id"), "id", "left_semi").join(merged, "id", "left").groupBy(F.coalesce("root", "id").alias("id")).agg(F.sum("n").alias("n"))
        sums = alive.groupBy("id", F.col("c.terms").alias("term")).agg(F.sum(F.col("c.weights") * F.col("n")).alias("s"))
        cells = sums.join(totals, "id").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("term", (F.col("s") / F.col("n")).alias("w")))).alias("c"))
        clusters = written(cells.select("id", "n", F.transform("c", lambda c: c["term"]).alias("terms"), F.transform("c", lambda c: c["w"]).alias("weights")), "means")
    merges = tree[0]
    for t in tree[1:]:
        merges = merges.unionByName(t)
    zero = F.lit(0).alias("g")
    return radius.components(vectors.select(zero, "id"), merges.select(zero, F.col("root").alias("a"), F.col("id").alias("b"))).select("id", F.col("component").alias("root"))


def linkage_of(similarity: np.ndarray, n: np.ndarray, distance: float) -> np.ndarray:
    """The least row of each row's cluster: average linkage of rows that stand for n vectors each, while merges stay within the distance."""
    s, n = similarity.copy(), n.astype(float).copy()
    np.fill_diagonal(s, -np.inf)
    label, path, open_ = np.arange(len(s)), [], np.ones(len(s), bool)
    while open_.any():
        if not path:
            path.append(int(np.argmax(open_)))
        x = path[-1]
        row = np.where(open_, s[x], -np.inf)
        y = int(np.argmax(row))
        if len(path) > 1 and row[path[-2]] >= row[y] - 1e-12:
            y = path[-2]
        if not row[y] >= 1 - distance:
            open_[x], path = False, []
        elif len(path) > 1 and y == path[-2]:
            a, b = min(x, y), max(x, y)
            s[a] = (n[a] * s[a] + n[b] * s[b]) / (n[a] + n[b])
            s[:, a] = s[a]
            s[a, a], n[a] = -np.inf, n[a] + n[b]
            open_[b] = False
            label[label == b] = a
            del path[-2:]
        else:
            path.append(y)
    return label


def sample_groups(objects: DataFrame, distance: float = 0.2, most: int = SAMPLES, local: int = clustering.LOCAL, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """(groups, members): joint clusters of the samples of all objects.

    objects: domain, object_code, object_name, samples. Samples are TF-IDF vectors of
    character n-grams over the distinct texts, and a text weighs as often as it occurs.
    groups: group_id (the least text), repr_name (the most frequent sample, the smaller on
    a tie), size, samples (distinct), domains, avg_similarity. members: group_id, domain, object_code,
    object_name, sample_count.
    """
    rows = written(flat_samples(objects, most), "samples")
    texts = rows.groupBy(F.col("sample").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    texts = written(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    cells = vector.tfidf(texts.select("id", "text"), digits=None)
    cells = cells.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("gram", "weight"))).alias("c"))
    vectors = written(texts.join(cells, "id").select("id", "n", F.transform("c", lambda c: c["gram"]).alias("terms"), F.transform("c", lambda c: c["weight"]).alias("weights")), "vectors")
    roots = written(sparse_linkage(vectors, distance, local, block), "roots")
    named = texts.join(roots, "id", "left").select("text", "n", "id", F.coalesce("root", "id").alias("root"))
    named = written(named.join(named.groupBy("root").agg(F.min("text").alias("group_id")), "root"), "named")
    sums = named.join(vectors.drop("n"), "id").select("group_id", "n", F.explode(F.arrays_zip("terms", "weights")).alias("c"))
    sums = sums.groupBy("group_id", F.col("c.terms").alias("term")).agg(F.sum(F.col("n") * F.col("c.weights")).alias("s"))
    square = sums.groupBy("group_id").agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    best = named.groupBy("group_id").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("samples"), F.min_by("text", F.struct(-F.col("n"), "text")).alias("repr_name"))
    owned = rows.join(named.select(F.col("text").alias("sample"), "group_id"), "sample")
    domains = owned.groupBy("group_id").agg(F.array_sort(F.collect_set("domain")).alias("domains"))
    n = F.col("size")
    alike = F.when((n == 1) | F.col("q").isNull(), F.lit(1.0)).otherwise((F.col("q") - n) / F.when(n > 1, n * (n - 1)))
    groups = best.join(square, "group_id", "left").join(domains, "group_id").select("group_id", "repr_name", "size", "samples", "domains", F.round(alike, 4).alias("avg_similarity"))
    members = owned.groupBy("group_id", "domain", "object_code", "object_name").agg(F.count(F.lit(1)).alias("sample_count"))
    return groups, members


def global_dedupe(cells: DataFrame, threshold: float, store: str, make=embed.hashed_grams, model: str = "hashed-grams-256", per_pair: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(canon, mapping) of texts over all datasets: attributes of one lower-cased name are pooled.

    cells: dataset, attribute, raw. The distinct texts of a pool are embedded and linked
    where their cosine is at least the threshold; a component's canonical text is its most
    frequent one (see vector.canonical()). per_pair: only so many most frequent texts of
    each dataset's attribute take part. canon: dataset, attribute, canonical_text,
    cluster_size (texts of that pair in the component), freq. mapping: dataset, attribute,
    from_text, canonical_text.
    """
    counts = cells.where("raw is not null").groupBy("dataset", "attribute", "raw").agg(F.count(F.lit(1)).alias("freq"))
    if per_pair is not None:
        first = Window.partitionBy("dataset", "attribute").orderBy(F.desc("freq"), "raw")
        counts = counts.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_pair).drop("r")
    counts = written(counts.withColumn("pool", F.lower("attribute")), "counts")
    texts = counts.select("pool", F.col("raw").alias("text")).distinct()
    vectors = embed.embed(texts, store, make, model)[0].select(F.col("pool").alias("g"), F.col("text").alias("id"), vector.normalized(F.col("vector")).alias("v"))
    linked = written(radius.radius_components(vectors, threshold).select(F.col("g").alias("pool"), F.col("id").alias("raw"), "component"), "linked")
    total = counts.groupBy("pool", "raw").agg(F.sum("freq").alias("freq")).join(linked, ["pool", "raw"])
    named = total.select(F.struct("pool", "component").alias("cluster"), F.col("raw").alias("text"), "freq")
    canon = written(vector.canonical(named).select("cluster.pool", "cluster.component", "canonical_text"), "canon")
    rows = counts.join(linked, ["pool", "raw"]).join(canon, ["pool", "component"])
    sizes = rows.groupBy("dataset", "attribute", "canonical_text").agg(F.count(F.lit(1)).alias("cluster_size"), F.sum("freq").alias("freq"))
    return sizes, rows.select("dataset", "attribute", F.col("raw").alias("from_text"), "canonical_text")
