"""Writes as functions from old tables and a table of requests to new tables.

A request names what it changes by code or id; one that names nothing known changes
nothing, and applying a request again changes nothing more, but for appended rows that
carry no code of their own. New ids follow the largest old one, in the order of codes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eav import number_rows


def _with_ids(old: DataFrame, new: DataFrame, id_: str, code: str) -> DataFrame:
    """new rows with ids after the largest of old."""
    top = old.agg(F.coalesce(F.max(id_), F.lit(0)).alias("__top"))
    rows = number_rows(new.withColumn("__sheet", F.lit(0)), "__sheet", code).drop("__sheet")
    return rows.withColumn("__top", top.scalar()).withColumn(id_, (F.col("__top") + F.col("row_number")).cast(old.schema[id_].dataType)).drop("__top", "row_number")


def _filled(rows: DataFrame, like: DataFrame, **defaults) -> DataFrame:
    """rows with the columns of like: given ones, else defaults, null ones filled as well."""
    value = lambda c: F.coalesce(F.col(c), F.lit(defaults.get(c))) if c in rows.columns else F.lit(defaults.get(c))
    return rows.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in like.schema])


def create(old: DataFrame, request: DataFrame, id_: str, code: str, **defaults) -> DataFrame:
    """Old rows and those requested whose code is new; requests without a code are left out, of equal codes the first by all columns counts."""
    wanted = request.where(F.col(code).isNotNull() & (F.col(code) != "")).join(old.select(code), code, "left_anti")
    others = [c for c in request.columns if c != code]
    one = wanted.groupBy(code).agg(F.min(F.struct(*others)).alias("__r")).select(code, *[F.col(f"__r.`{c}`") for c in others]) if others else wanted.distinct()
    return old.unionByName(_filled(_with_ids(old, one, id_, code), old, **defaults))


def update(old: DataFrame, request: DataFrame, key: str, stamp: dict[str, str] | None = None, at: str | None = None) -> DataFrame:
    """Old rows with the values of a request (key and some columns; null: as it was); a key once in the request.

    stamp: flag column -> column that takes the time `at` where the request sets the flag.
    """
    mine = [c for c in request.columns if c != key]
    rows = old.join(request.select(key, *[F.col(c).alias(f"__{c}") for c in mine]), key, "left")
    value = {c: F.coalesce(f"__{c}", c) for c in mine}
    for flag, column in (stamp or {}).items():
        value[column] = F.when(F.col(f"__{flag}"), F.lit(at).cast(old.schema[column].dataType)).otherwise(F.col(column))
    return rows.select(*[value.get(c, F.col(c)).alias(c) for c in old.columns])


def delete(old: DataFrame, request: DataFrame, key: str) -> DataFrame:
    return old.join(request.select(key).distinct(), key, "left_anti")


def write_relations(old: DataFrame, new: DataFrame, objects: DataFrame) -> DataFrame:
    """Relations in which those of the given objects are replaced.

    objects: object_id, object_code; new: object_code and the columns of old but
    object_id. Rows of unknown codes are left out; an empty `via` is null.
    """
    rows = new.join(objects.select("object_id", "object_code"), "object_code").withColumn("via", F.nullif("via", F.lit("")))
    return old.join(objects.select("object_id").distinct(), "object_id", "left_anti").unionByName(rows.select(*old.columns))


def start_batches(batches: DataFrame, request: DataFrame, at: str) -> DataFrame:
    """Batches with new running ones: request has data_domain (once) and source_files; the code holds the domain and the time."""
    code = F.concat(F.lit("SEMANTIC_"), "data_domain", F.lit(f"_{at}"))
    return create(batches, request.withColumn("batch_code", code), "batch_id", "batch_code", status="RUNNING")


def end_batches(batches: DataFrame, request: DataFrame) -> DataFrame:
    """Batches with the counts of a request (batch_id, objects, relations) and its status, COMPLETED where it has none."""
    status = F.coalesce("status", F.lit("COMPLETED")) if "status" in request.columns else F.lit("COMPLETED")
    return update(batches, request.select("batch_id", "objects", "relations", status.alias("status")), "batch_id")


def create_chains(chains: DataFrame, nodes: DataFrame, request: DataFrame, request_nodes: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chains, nodes) with the requested chains and their nodes; nodes find their object by its code, or have none.

    request: chain_code, chain_name and more; request_nodes: chain_code, node_order,
    object_code and more. Chains without code or name, and codes that exist, are left
    out with their nodes. A node's label is its entity's name where it has none.
    """
    good = request.where((F.col("chain_name") != "") & F.col("chain_name").isNotNull())
    after = create(chains, good, "chain_id", "chain_code", chain_type="CUSTOM", data_domain="", description="")
    made = after.join(chains.select("chain_code"), "chain_code", "left_anti").select("chain_id", "chain_code")
    first = objects.groupBy("object_code").agg(F.min("object_id").alias("object_id"))
    rows = request_nodes.join(made, "chain_code").join(first, "object_code", "left")
    rows = rows.withColumn("node_label", F.coalesce("node_label", "entity_name"))
    return after, nodes.unionByName(_filled(rows, nodes, node_order=0, node_type="INTERMEDIATE", entity_name=""))


def link_rules(functions: DataFrame, request: DataFrame) -> DataFrame:
    """Functions with the rule of a request (func_id, rule_id); a null rule unlinks."""
    rows = functions.join(request.select("func_id", F.col("rule_id").alias("__rule"), F.lit(True).alias("__asked")), "func_id", "left")
    return rows.select(*[F.when(F.col("__asked"), F.col("__rule")).otherwise(F.col(c)).alias(c) if c == "linked_rule_id" else F.col(c) for c in functions.columns])


def resolve_alerts(alerts: DataFrame, request: DataFrame, at: str) -> DataFrame:
    """Alerts with those of a request (alert_id, resolved_by) resolved by that name, `system` where it has none."""
    asked = request.select("alert_id", F.coalesce("resolved_by", F.lit("system")).alias("resolved_by"), F.lit(True).alias("is_resolved"))
    return update(alerts, asked, "alert_id", {"is_resolved": "resolved_at"}, at)
