"""Entity-attribute-value model: melt, typed values, type votes, hashes, incremental import, pivot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import text as tx
from ferrule.session import written


def melt(rows: DataFrame, key: str) -> DataFrame:
    """entity_id, attribute, raw: one row a non-empty cell; one narrow pass, no shuffle."""
    others = [c for c in rows.columns if c != key]
    wide = rows.select(F.col(key).alias("entity_id"), *[F.col(f"`{c}`").cast("string").alias(c) for c in others])
    long = wide.unpivot("entity_id", others, "attribute", "raw")
    return long.withColumn("raw", F.trim(tx.normalize_na(F.col("raw")))).where("raw is not null")


def typed(cells: DataFrame) -> DataFrame:
    return cells.select("entity_id", "attribute", "raw", *[c.alias(n) for n, c in tx.typed_slots(F.col("raw")).items()])


def vote(cells: DataFrame) -> DataFrame:
    """Each attribute's most frequent value type; ties in the order number, datetime, bool, text."""
    counts = cells.groupBy("attribute", tx.value_type(F.col("raw")).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*[F.lit(t) for t in tx.TYPE_ORDER]), F.col("type"))
    return counts.groupBy("attribute").agg(F.max_by("type", F.struct("n", -place)).alias("type"), F.sum("n").alias("values"))


def vote_by_samples(cells: DataFrame, samples: int = 200) -> DataFrame:
    """file, attribute, type, values: as vote(), over the first values by row of each sheet alone.

    cells: file, sheet, row, attribute, raw (null where there is none). An attribute
    without any value is text. Each task keeps the first values of a sheet's attribute
    that it reads and passes only those on (a window group limit ahead of the shuffle).
    """
    first = Window.partitionBy("file", "sheet", "attribute").orderBy("row", "raw")
    some = cells.where(F.trim("raw") != "").withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= samples)
    counts = some.groupBy("file", "attribute", tx.value_type(F.col("raw")).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*[F.lit(t) for t in tx.TYPE_ORDER]), F.col("type"))
    voted = counts.groupBy("file", "attribute").agg(F.max_by("type", F.struct("n", -place)).alias("type"), F.sum("n").alias("values"))
    every = cells.select("file", "attribute").distinct()
    return every.join(voted, ["file", "attribute"], "left").select("file", "attribute", F.coalesce("type", F.lit("text")).alias("type"), F.coalesce("values", F.lit(0)).cast("long").alias("values"))


def pivot(cells: DataFrame, attributes: list[str]) -> DataFrame:
    """Attributes of each entity back in columns; the list of attributes spares a pass over the data."""
    return cells.where(F.col("attribute").isin(attributes)).groupBy("entity_id").pivot("attribute", attributes).agg(F.first("raw"))


def hashes(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).alias("entity_id"), tx.row_hash([F.col(f"`{c}`") for c in rows.columns]).alias("row_hash"))


def incremental(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """What an import does with each row: INSERT, UPDATE, SKIP, or KEEP for rows gone at the source."""
    a = old.select("entity_id", F.col("row_hash").alias("old_hash"))
    b = new.select("entity_id", F.col("row_hash").alias("new_hash"))
    action = F.when(F.col("new_hash").isNull(), "KEEP").when(F.col("old_hash").isNull(), "INSERT")
    if not force:
        action = action.when(F.col("old_hash") == F.col("new_hash"), "SKIP")
    return a.join(b, "entity_id", "full_outer").select("entity_id", action.otherwise("UPDATE").alias("action"))


def frequency(cells: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct texts of each attribute by frequency; the first `limit` of each, ties by text."""
    counts = cells.groupBy("attribute", "raw").agg(F.count(F.lit(1)).alias("freq"))
    if limit is None:
        return counts
    w = Window.partitionBy("attribute").orderBy(F.desc("freq"), "raw")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).drop("place")


def multi_frequency(cells: DataFrame, per_pair: int, limit: int) -> DataFrame:
    """Texts over several (dataset, attribute) pairs: total and per-pair counts.

    Each pair is cut to per_pair texts before pairs are merged, and the result to limit.
    """
    counts = cells.groupBy("dataset", "attribute", "raw").agg(F.count(F.lit(1)).alias("freq"))
    w = Window.partitionBy("dataset", "attribute").orderBy(F.desc("freq"), "raw")
    top = counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_pair)
    pair = F.concat_ws(".", "dataset", "attribute")
    merged = top.groupBy("raw").agg(F.sum("freq").alias("total"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", pair, F.col("freq").cast("string")))), ";").alias("per_pair"))
    return merged.orderBy(F.desc("total"), "raw").limit(limit)


def normalized_view(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Raw texts with their canonical text, the raw one where none is mapped."""
    joined = cells.join(mapping, (cells["attribute"] == mapping["map_attribute"]) & (cells["raw"] == mapping["from_text"]), "left")
    return joined.select("entity_id", "attribute", "raw", F.coalesce("canonical_text", "raw").alias("normalized"))


def normalized_values(values: DataFrame, entities: DataFrame, attributes: DataFrame, mapping: DataFrame, canon: DataFrame) -> DataFrame:
    """entity_id, dataset_id, attribute_id, attribute, raw, normalized: values with the canonical text of their mapping.

    values: entity_id, attribute_id, raw; entities: entity_id, dataset_id; attributes:
    attribute_id, attribute; mapping: dataset_id, attribute_id, from_text, canonical_id;
    canon: canonical_id, canonical_text. Texts of values and mapping are compared without
    case; of mappings that then agree the smallest canonical id counts.
    """
    rows = values.join(entities, "entity_id").join(attributes, "attribute_id").withColumn("__fold", F.lower("raw"))
    one = mapping.groupBy("dataset_id", "attribute_id", F.lower("from_text").alias("__fold")).agg(F.min("canonical_id").alias("canonical_id"))
    rows = rows.join(one, ["dataset_id", "attribute_id", "__fold"], "left").join(canon, "canonical_id", "left")
    return rows.select("entity_id", "dataset_id", "attribute_id", "attribute", "raw", F.coalesce("canonical_text", "raw").alias("normalized"))


def attribute_list(attributes: DataFrame, dataset: str | None = None, system: str = "__sheet__") -> DataFrame:
    """Attributes (dataset, attribute, type, place) of all datasets or one, in order, without the system's own."""
    rows = attributes.where(F.col("attribute") != system)
    return (rows if dataset is None else rows.where(F.col("dataset") == dataset)).orderBy("dataset", "place", "attribute")


def mapping_health(mapping: DataFrame, canon: DataFrame) -> DataFrame:
    """Counts of the semantic tables and of mappings without a canonical row."""
    orphans = mapping.join(canon.select("canonical_text"), "canonical_text", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    sizes = mapping.agg(F.count(F.lit(1)).alias("mappings"), F.count_distinct("canonical_text").alias("used"))
    return sizes.join(canon.agg(F.count(F.lit(1)).alias("canon")), F.lit(True)).join(orphans, F.lit(True))  # one row each


def number_rows(rows: DataFrame, sheet_order: str, row: str) -> DataFrame:
    """rows with row_number, from 1, over sheets in order and rows in order; equal rows of a sheet in any order.

    Rows are dealt by range and counted by range; the number is the count of the ranges
    before and the place inside, so that neither all sheets nor one sheet is one task's.
    """
    parts = written(rows.repartitionByRange(sheet_order, row).withColumn("__part", F.spark_partition_id()), "rows")
    counts = parts.groupBy(sheet_order, "__part").agg(F.count(F.lit(1)).alias("__n"))  # a row a sheet and range
    before = Window.orderBy(F.col(sheet_order).asc_nulls_first(), "__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col(sheet_order).alias("__of"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(sheet_order, "__part").orderBy(row))
    numbered = parts.withColumn("__inside", inside).join(firsts, F.col(sheet_order).eqNullSafe(F.col("__of")) & (F.col("__part") == F.col("__p")))
    return numbered.withColumn("row_number", F.col("__before") + F.col("__inside")).drop("__part", "__p", "__of", "__inside", "__before")


def bulk_import(rows: DataFrame, sheet_order: str, row: str, start: int = 1) -> tuple[DataFrame, DataFrame]:
    """(entities, values) of an import into ids that follow each other: entity_id is start plus the place over all sheets.

    values: entity_id, attribute, value of all cells that hold one, as text, without any inference of types.
    """
    numbered = number_rows(rows, sheet_order, row).withColumn("entity_id", F.col("row_number") - 1 + start)
    entities = numbered.select("entity_id", "row_number", F.concat_ws("!", F.col(sheet_order), F.col(row).cast("string")).alias("external_id"))
    cells = numbered.drop("row_number", sheet_order, row)
    others = [c for c in cells.columns if c != "entity_id"]
    wide = cells.select("entity_id", *[tx.value_text(F.col(f"`{c}`")).alias(c) for c in others])
    return entities, wide.unpivot("entity_id", others, "attribute", "value").where("value is not null")
