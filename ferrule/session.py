"""Session helpers: worker imports, the shared folder, written tables, sides small enough to broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a side that may be broadcast.
BROADCAST_BYTES = 32 << 20


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster the package is shipped with --py-files; this serves local sessions and
    clusters that share the path.
    """
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where that is unset and the master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "ferrule-shared")
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder URI that the driver and all executors see."""
    return f"{shared_root(spark)}/ferrule/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and nothing is computed twice."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, written, with the hint to broadcast it if its measured bytes are few; else joins with it shuffle."""
    df = written(df, "small")
    size = df.select(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))) + 16).alias("b")).first()["b"] or 0
    return F.broadcast(df) if size <= limit else df
