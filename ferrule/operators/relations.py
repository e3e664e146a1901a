"""Statistics, listings, search and ranking over objects and their relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import clamped, known

LAYERS = ["CONCEPT", "LOGICAL", "PHYSICAL"]


def ratio(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage, 0 where the whole is 0."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits), F.lit(0.0))


def distinct_names(relations: DataFrame) -> DataFrame:
    """Object, layer and entity name once, with the sum and the number of strengths.

    One narrow shuffle on the triple makes the distinct counts below plain counts, so
    no plan needs an Expand over several distinct sets.
    """
    return relations.groupBy("object_id", "layer", "entity_name").agg(F.sum("strength").alias("s"), F.count("strength").alias("n"))


def relation_stats(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct entities per layer, average strength and relation count of every object."""
    per = distinct_names(relations).groupBy("object_id").agg(
        *[F.count_if(F.col("layer") == layer).alias(f"{layer.lower()}_entity_count") for layer in LAYERS],
        F.sum("s").alias("s"), F.sum("n").alias("relation_count"),
    )
    names = relations.select("object_id", "entity_name").distinct().groupBy("object_id").agg(F.count(F.lit(1)).alias("total_entity_count"))
    joined = objects.join(per, "object_id", "left").join(names, "object_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select("object_code", "object_name", "domain", *[zero(f"{x.lower()}_entity_count") for x in LAYERS], zero("total_entity_count"), zero("relation_count"), F.round(F.col("s") / F.col("relation_count"), 4).alias("avg_strength"))


def layer_counts(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """Rows per layer of every object, absent layers 0."""
    counts = relations.groupBy("object_id").agg(*[F.count_if(F.col("layer") == x).alias(f"{x.lower()}_count") for x in LAYERS])
    joined = objects.join(counts, "object_id", "left")
    return joined.select("object_code", "object_name", "domain", "object_type", *[F.coalesce(f"{x.lower()}_count", F.lit(0)).alias(f"{x.lower()}_count") for x in LAYERS])


def domain_stats(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """Objects, relations, average strength and types of every domain."""
    by_object = relations.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"), F.sum("strength").alias("s"))
    joined = objects.join(by_object, "object_id", "left")
    return joined.groupBy("domain").agg(
        F.count(F.lit(1)).alias("object_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("relation_count"),
        F.round(F.sum("s") / F.sum("n"), 4).alias("avg_strength"), F.array_join(F.array_sort(F.collect_set("object_type")), ",").alias("types"),
    )


def top_relations(relations: DataFrame, k: int, layer: str | None = None) -> DataFrame:
    """The k strongest entities of each object and layer, ties by name."""
    rows = relations if layer is None else relations.where(F.col("layer") == layer)
    rows = rows.groupBy("object_id", "layer", "entity_name", "via").agg(F.max("strength").alias("strength"))
    w = Window.partitionBy("object_id", "layer").orderBy(F.desc("strength"), "entity_name", F.col("via").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def logical_per_concept(relations: DataFrame) -> DataFrame:
    """Distinct logical entities reached through each concept of an object."""
    concept = relations.where("layer = 'CONCEPT'").select("object_id", "entity_name").distinct()
    logical = relations.where("layer = 'LOGICAL'").groupBy("object_id", F.col("via").alias("entity_name"), F.col("entity_name").alias("l")).count()
    counts = logical.groupBy("object_id", "entity_name").agg(F.count(F.lit(1)).alias("logical_count"))
    return concept.join(counts, ["object_id", "entity_name"], "left").select("object_id", "entity_name", F.coalesce("logical_count", F.lit(0)).alias("logical_count"))


def system_stats(objects: DataFrame, relations: DataFrame) -> DataFrame:
    o = objects.agg(F.count(F.lit(1)).alias("total_objects"), F.count_distinct("domain").alias("total_domains"))
    r = relations.agg(F.count(F.lit(1)).alias("total_relations"), *[F.count_if(F.col("layer") == x).alias(f"{x.lower()}_relations") for x in LAYERS], F.round(F.avg("strength"), 4).alias("avg_strength"))
    return o.join(r, F.lit(True))  # one row each


def search(relations: DataFrame, text: str, layer: str | None = None, limit: int = 500) -> DataFrame:
    """Distinct entities whose name contains text, case ignored; sorted, then limited."""
    found = F.lower("entity_name").contains(text.lower())
    if known(layer, LAYERS, "layer") is not None:
        found &= F.col("layer") == layer
    rows = relations.where(found).select("entity_name", "entity_code", "layer").distinct()
    return rows.orderBy("layer", "entity_name", "entity_code").limit(clamped(limit, 500))


def in_domains(objects: DataFrame, domains: str) -> DataFrame:
    """Objects of a comma list of domains; an empty list keeps all."""
    names = [d.strip() for d in domains.split(",") if d.strip()]
    return objects.where(F.col("domain").isin(names)) if names else objects


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def top_objects(objects: DataFrame, relations: DataFrame, k: int = 5) -> DataFrame:
    """Objects with most relations, ties by code."""
    counts = relations.groupBy("object_id").agg(F.count(F.lit(1)).alias("relation_count"))
    return objects.join(counts, "object_id").select("object_code", "object_name", "relation_count").orderBy(F.desc("relation_count"), "object_code").limit(k)


def granularity(locals_: DataFrame, small: int = 3, large: int = 20) -> DataFrame:
    """Cluster sizes with their severity: SMALL up to small, LARGE from large on."""
    size = F.col("cluster_size")
    return locals_.select("domain", "object_code", "cluster_size", F.when(size <= small, "SMALL").when(size >= large, "LARGE").otherwise("NORMAL").alias("severity"))


def granularity_summary(locals_: DataFrame, small: int = 3) -> DataFrame:
    size = F.col("cluster_size")
    return locals_.groupBy("domain").agg(F.max(size).alias("max_size"), F.min(size).alias("min_size"), F.round(F.avg(size), 4).alias("avg_size"), F.count_if(size < small).alias("small_objects"), F.count(F.lit(1)).alias("objects"))


def fields_by_subdomain(relations: DataFrame) -> DataFrame:
    """Entities of each object by subdomain; no subdomain is OTHER; names joined in order."""
    sub = F.coalesce("subdomain", F.lit("OTHER"))
    rows = relations.where("layer = 'CONCEPT'").groupBy("object_id", sub.alias("subdomain"))
    return rows.agg(F.count(F.lit(1)).alias("n_fields"), F.array_join(F.array_sort(F.collect_set("entity_name")), ",").alias("fields"))


def object_business_objects(mappings: DataFrame, object_code: str, domain: str | None = None, k: int = 100) -> DataFrame:
    """The business objects of an object, the best matches first, at most k."""
    rows = mappings.where(F.col("object_code") == object_code)
    if domain:
        rows = rows.where(F.col("data_domain") == domain)
    return rows.select("business_object_name", "match_method", "match_score", "data_domain").orderBy(F.desc("match_score"), "business_object_name").limit(k)


def layer_average(relations: DataFrame, object_id: int) -> DataFrame:
    """Count and mean strength, to four places, by layer of one object."""
    return relations.where(F.col("object_id") == object_id).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("strength"), 4).alias("strength"))


def filtered(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every wanted value that is given."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def named_attributes(attributes: DataFrame, names: list[str] | None = None, system: str = "__sheet__") -> DataFrame:
    """Attributes whose name or display name is one of names (all of a known type without names), system ones left out, in order."""
    if names:
        rows = attributes.where(F.col("name").isin(names) | F.col("display_name").isin(names))
    else:
        rows = attributes.where(F.col("data_type").isin("text", "number", "datetime", "bool"))
    return rows.where(F.col("name") != system).orderBy("ord_index", "id")


def canon_top(canon: DataFrame, mappings: DataFrame, k: int = 10) -> DataFrame:
    """The k canonical texts of the largest clusters with their number of mappings; ties by id."""
    counts = mappings.groupBy("canon_id").agg(F.count(F.lit(1)).alias("n"))
    top = canon.orderBy(F.desc("cluster_size"), "canon_id").limit(k)
    return top.join(counts, "canon_id", "left").select("canon_id", "canonical_text", "cluster_size", F.coalesce("n", F.lit(0)).alias("mapping_rows"))


def top_slices(rows: DataFrame, keys: list[str], head: int, other: DataFrame, other_keys: list[str], other_head: int) -> tuple[DataFrame, DataFrame]:
    """The first rows of two tables, each by its keys descending."""
    return rows.orderBy(*[F.desc(k) for k in keys]).limit(head), other.orderBy(*[F.desc(k) for k in other_keys]).limit(other_head)


def enriched(rows: DataFrame, other: DataFrame, key: str, column: str) -> DataFrame:
    """rows whose column, where it is null or an empty array, is that of the other source."""
    given = other.select(key, F.col(column).alias("__other"))
    lacks = F.col(column).isNull() | (F.size(column) <= 0)
    return rows.join(given, key, "left").withColumn(column, F.when(lacks, F.coalesce("__other", F.col(column))).otherwise(F.col(column))).drop("__other")


def with_file_domains(stats: DataFrame, files: DataFrame, key: str = "domain") -> DataFrame:
    """Stats of the table and of those domains that only files have, by name."""
    return stats.unionByName(files.join(stats.select(key), key, "left_anti").select(*stats.columns)).orderBy(key)
