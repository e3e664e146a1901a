"""Lifecycle intervals: history, transitions, durations, templates, batch moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_of(stage: Column, order: list[str]) -> Column:
    """Position of a stage in the order, from 1; 0 where it is none of them."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in order]), stage), F.lit(0)).cast("int")


def by_object() -> Window:
    return Window.partitionBy("object_id").orderBy("entered", "event_id")


def history(events: DataFrame) -> DataFrame:
    """Each stage entry with its exit, the next entry of the same object."""
    return events.withColumn("exited", F.lead("entered").over(by_object()))


def transitions(events: DataFrame, order: list[str]) -> DataFrame:
    """Whether each entry may follow the one before it.

    No stage is skipped, going back needs notes, the same stage is allowed, the first
    entry is free, and a stage outside the order is invalid.
    """
    w = by_object()
    rows = events.withColumn("rank", rank_of(F.col("stage"), order))
    rows = rows.withColumn("before", F.lag("rank").over(w))
    verdict = (
        F.when(F.col("rank") == 0, "UNKNOWN_STAGE")
        .when(F.col("before").isNull() | (F.col("before") == 0), "OK")
        .when(F.col("rank") > F.col("before") + 1, "SKIPPED")
        .when((F.col("rank") < F.col("before")) & (F.coalesce(F.trim("notes"), F.lit("")) == ""), "BACK_WITHOUT_NOTES")
        .otherwise("OK")
    )
    return rows.select("event_id", "object_id", "stage", F.col("before").alias("previous_rank"), verdict.alias("verdict"))


def distribution(events: DataFrame, order: list[str]) -> DataFrame:
    """Objects ever in each stage, in stage order."""
    return events.groupBy("stage").agg(F.count_distinct("object_id").alias("objects")).withColumn("position", rank_of(F.col("stage"), order))


def durations(rows: DataFrame, as_of: str) -> DataFrame:
    """Average, least and most calendar days in each stage; open stages end at as_of."""
    days = F.datediff(F.coalesce("exited", F.lit(as_of).cast("timestamp")), F.col("entered"))
    return rows.groupBy("stage").agg(F.round(F.avg(days), 1).alias("avg_days"), F.min(days).alias("min_days"), F.max(days).alias("max_days"), F.count(F.lit(1)).alias("entries"))


def bottleneck(rows: DataFrame, as_of: str, order: list[str]) -> DataFrame:
    """The stage with the longest average; the earlier stage on a tie."""
    d = durations(rows, as_of).withColumn("position", rank_of(F.col("stage"), order))
    return d.agg(F.max_by("stage", F.struct("avg_days", -F.col("position"), "stage")).alias("bottleneck"), F.max("avg_days").alias("avg_days"))


def report(rows: DataFrame, as_of: str) -> DataFrame:
    """Whole elapsed days of each object: total, number of stages, and stage:days in order."""
    seconds = F.unix_timestamp(F.coalesce("exited", F.lit(as_of).cast("timestamp"))) - F.unix_timestamp("entered")
    days = F.floor(seconds / 86400).cast("long")
    rows = rows.withColumn("days", days)
    path = F.array_sort(F.collect_list(F.struct("entered", "event_id", "stage", "days")))
    return rows.groupBy("object_id").agg(F.sum("days").alias("total_days"), F.count(F.lit(1)).alias("stages"), path.alias("path")).select("object_id", "total_days", "stages", F.array_join(F.transform("path", lambda p: F.concat_ws(":", p["stage"], p["days"].cast("string"))), ",").alias("path"))


def latest(events: DataFrame) -> DataFrame:
    """The last entry of each object, by partial aggregation instead of a sort."""
    order = F.struct("entered", "event_id")
    return events.groupBy("object_id").agg(F.max_by(F.struct(*events.columns), order).alias("last")).select("last.*")


def validate_templates(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """Required attributes that the snapshot lacks, and the completion in percent.

    rows: object_id, stage, snapshot map<string,string>; templates: stage, required array.
    """
    joined = rows.join(templates, "stage")
    filled = F.map_keys(F.map_filter("snapshot", lambda k, v: v.isNotNull() & (v != "")))
    missing = F.array_sort(F.array_except("required", filled))
    n = F.size("required")
    return joined.select("event_id", "object_id", "stage", F.array_join(missing, ",").alias("missing"), (n - F.size(missing)).alias("filled"), F.coalesce(F.round(F.try_divide((n - F.size(missing)).cast("double"), n.cast("double")) * 100, 1), F.lit(100.0)).alias("completion"))


def batch_advance(current: DataFrame, requests: DataFrame, order: list[str]) -> DataFrame:
    """Outcome of moving objects to a stage: unknown objects and skips are rejected."""
    rows = requests.join(current.select("object_id", F.col("stage").alias("current")), "object_id", "left")
    now, new = rank_of(F.col("current"), order), rank_of(F.col("target"), order)
    outcome = F.when(F.col("current").isNull(), "UNKNOWN_OBJECT").when(new == 0, "UNKNOWN_STAGE").when((now > 0) & (new > now + 1), "SKIPPED").otherwise("ADVANCED")
    return rows.select("object_id", "current", "target", outcome.alias("outcome"))


def trigger_alerts(events: DataFrame, templates: DataFrame, functions: DataFrame) -> DataFrame:
    """Alerts of the functions that a stage's template triggers, where the threshold is passed."""
    fired = events.join(templates.select("stage", F.explode("triggers").alias("func_code")), "stage")
    fired = fired.join(functions, "func_code")
    return fired.where(F.col("value") > F.col("threshold")).select("event_id", "object_id", "stage", "func_code", "level", "value")
