"""Request statistics, batch and stream: class, counts and times."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.session import small, workers_import


def classify(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """requests with their class: exact route, then the first prefix, then the default of the method.

    routes: kind (exact, prefix, method), pattern, class, position; a small literal table.
    """
    r = small(routes)
    hit = ((F.col("kind") == "exact") & (F.col("path") == F.col("pattern"))) | ((F.col("kind") == "prefix") & F.startswith(F.col("path"), F.col("pattern"))) | ((F.col("kind") == "method") & (F.col("method") == F.col("pattern")))
    # one row a request in and out, equal ones too: the best route is found per distinct request by an aggregate of its matches
    order = F.when(F.col("kind") == "exact", 0).when(F.col("kind") == "prefix", 1).otherwise(2)
    kinds = requests.select("method", "path").distinct()
    best = kinds.join(r, hit, "left").groupBy("method", "path").agg(F.min_by("class", F.struct(order, "position")).alias("class"))
    best = best.select(F.col("method").alias("__m"), F.col("path").alias("__p"), "class")
    same = F.col("method").eqNullSafe(F.col("__m")) & F.col("path").eqNullSafe(F.col("__p"))
    return requests.join(best, same, "left").drop("__m", "__p")


def classify_columns(requests: DataFrame, routes: list[tuple[str, str, str]]) -> DataFrame:
    """As classify(), but as one projection over a literal route list, which also serves streams."""
    path, method = F.col("path"), F.col("method")
    exact = [F.when(path == p, F.lit(c)) for k, p, c in routes if k == "exact"]
    prefix = [F.when(path.startswith(p), F.lit(c)) for k, p, c in routes if k == "prefix"]
    default = [F.when(method == p, F.lit(c)) for k, p, c in routes if k == "method"]
    return requests.withColumn("class", F.coalesce(*exact, *prefix, *default, F.lit("TP")))


def stats(requests: DataFrame) -> DataFrame:
    return requests.groupBy("class").agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("ms"), 2).alias("total_ms"), F.round(F.avg("ms"), 4).alias("avg_ms"))


def windowed(requests: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Counts and times of each class in tumbling windows of ts; late: the watermark of a stream."""
    rows = requests.withWatermark("ts", late) if late else requests
    w = rows.groupBy(F.window("ts", width).alias("w"), "class").agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("ms"), 2).alias("total_ms"))
    return w.select(F.col("w.start").alias("start"), "class", "requests", "total_ms")


def sessions(requests: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of each user: requests no further apart than gap."""
    rows = requests.withWatermark("ts", late) if late else requests
    s = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return s.select("user_id", F.col("w.start").alias("start"), "requests")


def run_to_folder(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """All available input of a stream, as a table in a shared folder; nothing passes through the driver.

    Each batch is written under its number, which a repeated batch overwrites; in
    complete mode the last batch is the result.
    """
    spark, kinds = stream.sparkSession, stream.schema

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{'last' if mode == 'complete' else number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    return spark.read.schema(kinds).option("recursiveFileLookup", True).parquet(f"{folder}/rows")


def transitions_stream(events: DataFrame, order: list[str]) -> DataFrame:
    """Stage transitions of a stream, checked against the last stage kept for each object.

    The events of an object in one micro-batch are put in order over all their frames
    first, so that a frame's border is no step back.
    """
    workers_import(events.sparkSession)
    rank = {s: i for i, s in enumerate(order, 1)}

    def check(key, frames, state):
        rows = pd.concat(list(frames)).sort_values(["entered", "event_id"], ignore_index=True)
        now = rows["stage"].map(rank).fillna(0).astype(int).to_numpy()
        before = np.concatenate([[state.get[0] if state.exists else 0], now[:-1]])
        bare = rows["notes"].fillna("").str.strip().eq("").to_numpy()
        verdict = np.select([now == 0, before == 0, now > before + 1, (now < before) & bare], ["UNKNOWN_STAGE", "OK", "SKIPPED", "BACK_WITHOUT_NOTES"], "OK")
        state.update((int(now[-1]),))
        yield pd.DataFrame({"event_id": rows["event_id"], "object_id": int(key[0]), "stage": rows["stage"], "verdict": verdict})

    return events.groupBy("object_id").applyInPandasWithState(check, "event_id long, object_id long, stage string, verdict string", "before int", "append", "NoTimeout")
