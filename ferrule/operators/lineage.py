"""Traceability chains, field lineage and the rule graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.session import written

from . import needles

EXPRESSION = "struct<formula:string,sources:array<string>>"


def chains(nodes: DataFrame) -> DataFrame:
    """One row a chain: its nodes' types in order."""
    ordered = F.array_sort(F.collect_list(F.struct("node_order", "node_type")))
    rows = nodes.groupBy("chain_id").agg(F.count(F.lit(1)).alias("nodes"), ordered.alias("o"), F.min("node_order").alias("first_order"), F.max("node_order").alias("last_order"))
    return rows.select("chain_id", "nodes", F.array_join(F.transform("o", lambda x: x["node_type"]), ">").alias("path"), "first_order", "last_order")


def edges(nodes: DataFrame) -> DataFrame:
    w = Window.partitionBy("chain_id").orderBy("node_order")
    return nodes.select("chain_id", "node_order", "node_type", F.lead("node_type").over(w).alias("next_type")).where("next_type is not null")


def chains_through(nodes: DataFrame, objects: DataFrame) -> DataFrame:
    """Chains with a node whose label, lower-cased, contains an object's needle; distinct pairs, found in the needle index."""
    labels = nodes.select(F.col("chain_id").alias("id"), F.lower("node_label").alias("text"))
    found = needles.contained(labels, objects.select("needle"))
    return found.join(objects, "needle").select(F.col("id").alias("chain_id"), F.col("n_name").alias("object_name")).distinct()


def with_objects(nodes: DataFrame, objects: DataFrame) -> DataFrame:
    """nodes (or field lineages) with the code and name of their object, null where they have none or it is gone."""
    return nodes.join(objects.select("object_id", "object_code", "object_name"), "object_id", "left")


def relink(nodes: DataFrame, objects: DataFrame) -> DataFrame:
    """nodes (node_id, node_label, object_id) where those without an object get the first whose name their label contains.

    objects: object_id, object_name. Objects come in the order of their ids; of equal
    names the largest id stands, at the place of the smallest. Nodes that have an object,
    and labels that hold no name, stay.
    """
    names = objects.where("object_name is not null").groupBy(F.col("object_name").alias("name")).agg(F.min("object_id").alias("rank"), F.max("object_id").alias("own"))
    open_ = nodes.where("object_id is null").select(F.col("node_id").alias("id"), F.coalesce("node_label", F.lit("")).alias("text"))
    found = needles.first_contained(open_, names.select("name", "rank")).join(names.select("name", "own"), "name").select(F.col("id").alias("node_id"), "own")
    return nodes.join(found, "node_id", "left").select(*[F.coalesce("object_id", "own").alias(c) if c == "object_id" else F.col(c) for c in nodes.columns])


def sources(lineage: DataFrame) -> DataFrame:
    """Each source of each field; derived says that it is a field itself. Broken JSON has none."""
    parsed = lineage.withColumn("e", F.from_json("expression", EXPRESSION))
    rows = parsed.select("lineage_code", "field", F.explode("e.sources").alias("source"))
    fields = lineage.select(F.col("field").alias("source"), F.lit(True).alias("known")).distinct()
    return rows.join(fields, "source", "left").select("lineage_code", "field", "source", F.coalesce("known", F.lit(False)).alias("derived"))


def upstream(lineage: DataFrame, depth: int = 10) -> DataFrame:
    """All direct and indirect sources of each field with their least distance."""
    step = written(sources(lineage).select("field", "source").distinct(), "lineage")
    frontier = reached = written(step.withColumn("depth", F.lit(1)), "lineage")
    for k in range(2, depth + 1):
        nxt = frontier.select("field", F.col("source").alias("via")).join(step.withColumnRenamed("field", "via"), "via").select("field", "source").distinct()
        frontier = written(nxt.join(reached, ["field", "source"], "left_anti").withColumn("depth", F.lit(k)), "lineage")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def rule_graph(rules: DataFrame, objects: DataFrame) -> DataFrame:
    """Vertices and edges of active rules as rows of kind NODE and EDGE; a node without a name drops OBJ_."""
    active = rules.where("is_active")
    ends = active.select(F.explode(F.array("source_code", "target_code")).alias("object_code")).distinct()
    names = objects.select("object_code", "object_name")
    nodes = ends.join(names, "object_code", "left").select(F.lit("NODE").alias("kind"), F.col("object_code").alias("a"), F.lit("").alias("b"), F.coalesce("object_name", F.regexp_replace("object_code", "^OBJ_", "")).alias("label"))
    return nodes.unionByName(active.select(F.lit("EDGE").alias("kind"), F.col("source_code").alias("a"), F.col("target_code").alias("b"), F.col("rule_code").alias("label")))
