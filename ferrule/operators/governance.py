"""Completeness, defects, metrics and consistency across domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relations import LAYERS, distinct_names, ratio


def _counts(objects: DataFrame, relations: DataFrame) -> DataFrame:
    per = distinct_names(relations).groupBy("object_id").agg(*[F.count_if(F.col("layer") == x).alias(x) for x in LAYERS])
    return objects.join(per, "object_id", "left").na.fill(0, LAYERS)


def completeness(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """COMPLETE with all layers, EMPTY with none, else PARTIAL."""
    rows = _counts(objects, relations)
    every = F.least(*LAYERS) > 0
    return rows.select("object_code", "domain", *[F.col(x).alias(f"{x.lower()}_count") for x in LAYERS], F.when(every, "COMPLETE").when(F.greatest(*LAYERS) == 0, "EMPTY").otherwise("PARTIAL").alias("status"))


def defects(objects: DataFrame, relations: DataFrame, attributes: DataFrame, weak: float = 0.5) -> DataFrame:
    """MISSING_LAYER (the first gap), WEAK_RELATION (each weak row group) and NO_ATTRIBUTES."""
    rows = _counts(objects, relations)
    gap = F.when(F.col("CONCEPT") == 0, "CONCEPT").when(F.col("LOGICAL") == 0, "LOGICAL").when(F.col("PHYSICAL") == 0, "PHYSICAL")
    code, kind, level, what = "object_code", "defect_type", "severity", "detail"
    missing = rows.withColumn(what, gap).where(f"{what} is not null").select(code, F.lit("MISSING_LAYER").alias(kind), F.lit("HIGH").alias(level), what)
    weak_rows = relations.where((F.col("strength") < weak) & (F.col("layer") == "CONCEPT")).join(objects.select("object_id", code), "object_id")
    weak_rows = weak_rows.select(code, F.lit("WEAK_RELATION").alias(kind), F.lit("MEDIUM").alias(level), F.col("entity_name").alias(what))
    bare = objects.join(attributes.select("object_id"), "object_id", "left_anti").select(code, F.lit("NO_ATTRIBUTES").alias(kind), F.lit("LOW").alias(level), F.lit("").alias(what))
    return missing.unionByName(weak_rows).unionByName(bare)


def single_status(objects: DataFrame, relations: DataFrame, weak: float = 0.6) -> DataFrame:
    """One verdict an object by row counts: the first missing layer, WEAK on average, else OK."""
    per = relations.groupBy("object_id").agg(*[F.count_if(F.col("layer") == x).alias(x) for x in LAYERS], F.avg("strength").alias("mean"))
    rows = objects.join(per, "object_id", "left").na.fill(0, LAYERS)
    out = F.lit(None).cast("string")
    verdict = F.when(F.col("CONCEPT") == 0, "MISSING_CONCEPT").when(F.col("LOGICAL") == 0, "MISSING_LOGICAL").when(F.col("PHYSICAL") == 0, "MISSING_PHYSICAL").when(F.round("mean", 6) < weak, "WEAK").otherwise(F.coalesce(out, F.lit("OK")))
    return rows.select("object_code", verdict.alias("verdict"), F.when(F.least(*LAYERS) > 0, "COMPLETE").otherwise("INCOMPLETE").alias("completeness"))


def metrics(objects: DataFrame, relations: DataFrame, attributes: DataFrame, strong: float = 0.8, weak: float = 0.5) -> DataFrame:
    """Key figures of all objects in one row."""
    state = completeness(objects, relations).agg(*[F.count_if(F.col("status") == s).alias(f"{s.lower()}_objects") for s in ("COMPLETE", "PARTIAL", "EMPTY")], F.count(F.lit(1)).alias("total_objects"))
    kept = relations.join(objects.select("object_id"), "object_id", "left_semi")
    rel = kept.agg(F.count(F.lit(1)).alias("total_relations"), F.count_if(F.col("strength") >= strong).alias("strong_relations"), F.count_if(F.col("strength") < weak).alias("weak_relations"), F.round(F.avg("strength"), 4).alias("avg_strength"))
    cover = objects.join(attributes.select("object_id").distinct(), "object_id", "left_semi").agg(F.count(F.lit(1)).alias("with_attributes"))
    one = state.join(rel, F.lit(True)).join(cover, F.lit(True))  # one row each
    total = F.col("total_objects")
    return one.select("*", ratio(F.col("complete_objects"), total).alias("completeness_rate"), ratio(F.col("strong_relations"), F.col("total_relations")).alias("strong_rate"), ratio(F.col("with_attributes"), total).alias("attribute_coverage"))


def domain_consistency(locals_: DataFrame) -> DataFrame:
    """For each object code: where it is, where it is missing, and whether every domain has it."""
    pairs = locals_.select("domain", "object_code").distinct()
    everything = pairs.agg(F.array_sort(F.collect_set("domain")).alias("everything"))  # as many as there are domains
    rows = pairs.groupBy("object_code").agg(F.array_sort(F.collect_set("domain")).alias("here")).join(F.broadcast(everything), F.lit(True))
    n, m = F.size("here"), F.size("everything")
    return rows.select("object_code", F.array_join("here", ",").alias("present_in"), F.array_join(F.array_except("everything", "here"), ",").alias("missing_in"), F.concat_ws("/", n, m).alias("coverage"), (n == m).alias("consistent"), ratio(n, m).alias("rate"))


# Endings that mark a field rather than an object, in order of precedence.
FIELD_SUFFIXES = [
    "编号", "代码", "代号", "ID", "id",
    "名称", "标题", "简称", "全称",
    "状态", "类型", "类别", "分类",
    "时间", "日期",
    "金额", "数量", "价格", "单价", "总价",
    "地址", "电话", "邮箱",
    "标识", "标志", "标记",
]


def suffix_noise(names: DataFrame, name: str, suffixes: list[str] = FIELD_SUFFIXES) -> DataFrame:
    """Names that end with one of the suffixes and have at least two more characters; the first suffix in order."""
    hit = F.coalesce(*[F.when(F.col(name).endswith(s) & (F.length(name) > len(s) + 1), F.lit(s)) for s in suffixes])
    return names.withColumn("suffix", hit)


def coverage(objects: DataFrame, **tables: DataFrame) -> DataFrame:
    """One row: for each table (with object_id) how many objects occur in it, and their share of all in percent."""
    out = objects.agg(F.count_distinct("object_id").alias("objects"))
    for name, rows in tables.items():
        own = rows.where("object_id is not null").select("object_id").distinct().join(objects.select("object_id"), "object_id", "left_semi")
        out = out.join(own.agg(F.count(F.lit(1)).alias(name)), F.lit(True))  # one row each
    return out.select("*", *[ratio(F.col(n), F.col("objects")).alias(f"{n}_rate") for n in tables])


def layer_totals(locals_: DataFrame) -> DataFrame:
    """Literal groups: by code, else name: the distinct names joined by a slash, members, domains and totals of the three layers."""
    key = F.coalesce(F.nullif("object_code", F.lit("")), F.nullif("object_name", F.lit("")))
    rows = locals_.withColumn("key", key).where("key is not null")
    return rows.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("object_name")), "/").alias("group_name"), F.count(F.lit(1)).alias("members"), F.count_distinct("domain").alias("domains"), *[F.sum(c).alias(f"total_{c}") for c in ("concept", "logical", "physical")])
