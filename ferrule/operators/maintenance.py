"""Seeds, batches, cleaning of sheets, merges by centroid, and cross-dataset canonical texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.session import written

from . import vector

STAGES = ["PLANNING", "DESIGN", "CONSTRUCTION", "OPERATION"]
GAPS = [0, 60, 150, 330]  # days from the start to each stage: steps of 60, 90 and 180


def seed_lifecycle(objects: DataFrame, base: str) -> DataFrame:
    """Four stages for each object, starting (id % 30) weeks after base; the last stage is open."""
    start = F.date_add(F.lit(base).cast("date"), ((F.col("object_id") % 30) * 7).cast("int"))
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(g).alias("gap"), F.lit(n).cast("int").alias("until")) for s, g, n in zip(STAGES, GAPS, [*GAPS[1:], None])])
    rows = objects.select("object_id", start.alias("start"), F.explode(stages).alias("s"))
    return rows.select("object_id", "s.stage", F.date_add("start", F.col("s.gap")).alias("entered"), F.date_add("start", F.col("s.until")).alias("exited"))


def seed_missing(table: DataFrame, defaults: DataFrame, keys: list[str]) -> DataFrame:
    """table with those defaults whose key it lacks; applying it again changes nothing."""
    return table.unionByName(defaults.join(table.select(*keys).distinct(), keys, "left_anti").select(*table.columns))


def clean_sheets(cells: DataFrame, names: list[str], prefixes: list[str]) -> DataFrame:
    """Workbook cells without the named or prefixed sheets and without each sheet's last column."""
    drop = F.col("sheet").isin(names)
    for p in prefixes:
        drop |= F.col("sheet").startswith(p)
    rows = cells.where(~drop)
    last = rows.groupBy("file", "sheet").agg(F.max("column").alias("last"))
    return rows.join(last, ["file", "sheet"]).where(F.col("column") < F.col("last")).drop("last")


def not_overwritten(cells: DataFrame, existing: DataFrame, legacy: list[str]) -> DataFrame:
    """cells (domain, ...) without the legacy domains that exist already: an import never overwrites those."""
    kept = existing.where(F.col("domain").isin(legacy)).select("domain").distinct()
    return cells.join(kept, "domain", "left_anti")


def overall(domains: DataFrame, stats: DataFrame) -> DataFrame:
    """Totals over the domains that were extracted, and how many there are of all."""
    joined = domains.join(stats, "domain", "left")
    have = F.col("object_count").isNotNull()
    return joined.agg(F.count(F.lit(1)).alias("domains"), F.count_if(have).alias("extracted"), F.coalesce(F.sum("object_count"), F.lit(0)).alias("objects"), F.coalesce(F.sum("relation_count"), F.lit(0)).alias("relations"))


def merge_targets(vectors: DataFrame, small: int) -> DataFrame:
    """For groups of fewer than small vectors, the large group with the nearest centroid.

    Centroids are one row a group; small ones meet large ones in blocks.
    """
    sizes = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    c = vector.centroids(vectors, "label").join(sizes, "label")
    a = c.where(F.col("n") < small).select(F.col("label").cast("long").alias("id"), F.col("centroid").alias("v"))
    b = c.where(F.col("n") >= small).select(F.col("label").cast("long").alias("id"), F.col("centroid").alias("v"))
    found = vector.nearest(written(b, "centroids"), written(a, "centroids"), 1)
    return found.select(F.col("query_id").alias("source"), F.col("id").alias("target"), F.col("score").alias("similarity"))


def merge_targets_by_samples(objects: DataFrame, small: int) -> DataFrame:
    """For objects under the size, the large one with most samples in common, else the first large one by position.

    objects: position, object_code, cluster_size, samples. Only objects with a common
    sample meet; ties go to the earlier position. Without any large object there is no row.
    """
    few, many = objects.where(F.col("cluster_size") < small), objects.where(F.col("cluster_size") >= small)
    a = few.select(F.col("object_code").alias("source"), F.explode(F.array_distinct("samples")).alias("s"))
    b = many.select(F.col("object_code").alias("target"), "position", F.explode(F.array_distinct("samples")).alias("s"))
    shared = a.join(b, "s").groupBy("source", "target", "position").agg(F.count(F.lit(1)).alias("overlap"))
    best = shared.groupBy("source").agg(F.min(F.struct((-F.col("overlap")).alias("m"), "position", "target")).alias("b")).select("source", "b.target", (-F.col("b.m")).alias("overlap"))
    first = many.agg(F.min_by("object_code", "position").alias("f"))
    rows = few.select(F.col("object_code").alias("source")).join(best, "source", "left").withColumn("f", first.scalar())
    return rows.select("source", F.coalesce("target", "f").alias("target"), F.coalesce("overlap", F.lit(0)).alias("overlap")).where("target is not null")


def global_canon(cells: DataFrame, cluster: Column) -> DataFrame:
    """Canonical text of each cluster over all datasets, with each (dataset, attribute)'s own members.

    cells: dataset, attribute, raw. Attributes of one lower-cased name are pooled.
    """
    counts = cells.groupBy(F.lower("attribute").alias("name"), "dataset", "attribute", "raw").agg(F.count(F.lit(1)).alias("freq")).withColumn("cluster", F.concat_ws("|", "name", cluster))
    total = counts.groupBy("cluster", F.col("raw").alias("text")).agg(F.sum("freq").alias("freq"))
    canon = vector.canonical(total)
    sizes = counts.groupBy("cluster", "dataset", "attribute").agg(F.count_distinct("raw").alias("cluster_size"), F.sum("freq").alias("freq"))
    return sizes.join(canon, "cluster").select("dataset", "attribute", "canonical_text", "cluster_size", "freq")


def retrieve(found: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The texts of each query's k best rows, in order, joined into one context."""
    rows = found.where(F.col("rank") <= k).join(texts, "id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("context"))


def batches(events: DataFrame, k: int = 50) -> DataFrame:
    """Runs (batch_id, started, status) with their number of objects, the latest k."""
    return events.groupBy("batch_id").agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("objects")).orderBy(F.desc("started"), "batch_id").limit(k)
