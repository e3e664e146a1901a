"""Node and link tables for Sankey and layered graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best(rows: DataFrame, group: list[str], k: int) -> DataFrame:
    """The k strongest rows of each group, ties by name; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*group).orderBy(F.desc("strength"), "entity_name")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def layer(relations: DataFrame, name: str) -> DataFrame:
    """Distinct entities of a layer with their parent and greatest strength."""
    return relations.where(F.col("layer") == name).groupBy("object_id", "entity_name", "via").agg(F.max("strength").alias("strength"))


def sankey(objects: DataFrame, relations: DataFrame, logical: DataFrame, top: int = 3) -> DataFrame:
    """source, target, value: the top concepts of each object weighted by logical entities, and one rest link."""
    concepts = layer(relations, "CONCEPT").join(logical, ["object_id", "entity_name"], "left")
    w = Window.partitionBy("object_id").orderBy(F.desc("strength"), "entity_name")
    ranked = concepts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    total = concepts.groupBy("object_id").agg(F.count(F.lit(1)).alias("total"))
    code = objects.select("object_id", "object_code")
    shown = ranked.join(code, "object_id").select(F.col("object_code").alias("source"), F.col("entity_name").alias("target"), F.greatest(F.coalesce("logical_count", F.lit(0)), F.lit(1)).cast("long").alias("value"))
    rest = total.where(F.col("total") > top).join(code, "object_id").select(F.col("object_code").alias("source"), F.concat(F.lit("other "), (F.col("total") - top).cast("string")).alias("target"), (F.col("total") - top).cast("long").alias("value"))
    return shown.unionByName(rest)


def sankey_totals(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """Object to layer links with row totals."""
    return relations.groupBy("object_id", "layer").agg(F.count(F.lit(1)).alias("value")).join(objects, "object_id").select(F.col("object_code").alias("source"), F.col("layer").alias("target"), "value")


def object_graph(objects: DataFrame, relations: DataFrame, object_id: int, shown: tuple[int, int, int] = (15, 20, 30)) -> DataFrame:
    """Links of one object's graph: each entity hangs on its parent if that is shown, else on the object."""
    own = relations.where(F.col("object_id") == object_id)
    code = objects.where(F.col("object_id") == object_id).select("object_code")
    c, l, p = (best(layer(own, n), ["object_id"], k) for n, k in zip(("CONCEPT", "LOGICAL", "PHYSICAL"), shown))
    out = None
    parents = None
    for name, rows in (("CONCEPT", c), ("LOGICAL", l), ("PHYSICAL", p)):
        if parents is None:
            linked = rows.withColumn("parent", F.lit(None).cast("string"))
        else:
            linked = rows.join(F.broadcast(parents), rows["via"] == parents["parent"], "left")  # at most shown[] rows
        links = linked.join(F.broadcast(code), F.lit(True)).select(F.coalesce("parent", "object_code").alias("source"), F.col("entity_name").alias("target"), F.lit(name).alias("layer"), "strength")
        out = links if out is None else out.unionByName(links)
        parents = rows.select(F.col("entity_name").alias("parent")).distinct()
    return out


def global_graph(objects: DataFrame, relations: DataFrame, concepts: int = 5) -> DataFrame:
    """Nodes of the overview: objects sized by their relations and their strongest concepts."""
    size = relations.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))
    nodes = objects.join(size, "object_id", "left").select(F.col("object_code").alias("id"), F.lit("object").alias("kind"), F.least(F.lit(60), F.greatest(F.lit(20), 2 * F.coalesce("n", F.lit(0)))).cast("long").alias("size"))
    top = best(layer(relations, "CONCEPT"), ["object_id"], concepts).select(F.col("entity_name").alias("id"), F.lit("concept").alias("kind"), F.lit(10).cast("long").alias("size")).distinct()
    return nodes.unionByName(top)


def three_tier(objects: DataFrame, relations: DataFrame, depth: int = 4, shown: tuple[int, int, int] = (8, 3, 2)) -> DataFrame:
    """Links object, concept, logical, physical: the strongest of each level under each shown parent."""
    if not 2 <= depth <= 4:
        raise ValueError("depth is 2 to 4")
    level = best(layer(relations, "CONCEPT"), ["object_id"], shown[0])
    out = level.join(objects.select("object_id", "object_code"), "object_id").select(F.col("object_code").alias("source"), F.col("entity_name").alias("target"), F.lit("CONCEPT").alias("layer"))
    for name, k in list(zip(("LOGICAL", "PHYSICAL"), shown[1:]))[: depth - 2]:
        parent = level.select("object_id", F.col("entity_name").alias("via")).distinct()
        rows = layer(relations, name).join(parent, ["object_id", "via"], "left_semi")
        level = best(rows, ["object_id", "via"], k)
        out = out.unionByName(level.select(F.col("via").alias("source"), F.col("entity_name").alias("target"), F.lit(name).alias("layer")))
    return out
