"""Session, storage and join helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.session import workers_import

#: White space of the contracts: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a side that may be broadcast; larger sides are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes of a written table, measured, that one task reads at least; see packed.
PACK_BYTES = 4 << 20
#: Bytes of an Arrow batch: what a task holds beside the slice that it works on.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, bound Arrow batches by bytes, and give the session a checkpoint folder.

    The folder is the one named by spark.checkpoint.dir; a local one is made only
    where that setting is absent and the master is local (tests).
    """
    workers_import(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(spark))


def shared_root(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "ferrule-shared")
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder URI that the driver and all executors see."""
    return f"{shared_root(spark)}/ferrule/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """cut(df), and aggregates of all its rows (null: 0) that are taken while it is written, without a job of their own."""
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(n) for n, c in counts.items()]))
    return out, {n: seen.get.get(n) or 0 for n in counts}


def packed(df: DataFrame, size: int) -> DataFrame:
    """A cut df of about size bytes in partitions of PACK_BYTES, if it has more than that takes.

    The driver keeps a record of every task; a small table written by many tasks is read by few.
    """
    return df.coalesce(max(1, -(-size // PACK_BYTES)))


def cut_measured(df: DataFrame, **counts: Column) -> tuple[DataFrame, int] | tuple[DataFrame, int, dict[str, int]]:
    """cut(df), packed, and about the bytes of all its rows, see small_join; with counts also these, see cut_counted."""
    out, seen = cut_counted(df, __size=F.sum(_row_bytes(df)), **counts)
    size = seen.pop("__size")
    return (packed(out, size), size, seen) if counts else (packed(out, size), size)


def row_key(df: DataFrame, text: str = "text", key: str = "doc_id") -> Column:
    """A reproducible 64-bit key of a row; rows that agree in id and text share it."""
    return F.xxhash64(F.col(key), F.col(text))


def frees(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """task for mapInArrow that gives its memory back at its end: an idle worker else keeps its largest task's."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def _width(c: Column, kind: T.DataType) -> Column | int:
    """Bytes of a value, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return functools.reduce(lambda a, b: a + b, [_width(c[f.name], f.dataType) for f in kind], F.lit(8))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType)):
            each = F.transform(c, lambda x: F.lit(0) + _width(x, kind.elementType))
            return F.coalesce(F.aggregate(each, F.lit(0), lambda a, b: a + b), F.lit(0)) + 16
        fields = len(kind.elementType.fields) + 1 if isinstance(kind.elementType, T.StructType) else 1
        return F.greatest(F.size(c), F.lit(0)) * (8 * fields) + 16
    return 8


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with the number, from 1, of each row among those of its keys; rows of one key are counted a partition at a time."""
    rows = cut(df.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))
    counts = rows.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cut(counts.select(*keys, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first")))
    inside = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__row"))
    return small_join(rows.withColumn("__inside", inside), firsts, [*keys, "__part"]).withColumn(name, F.col("__first") + F.col("__inside")).drop("__part", "__row", "__first", "__inside")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that a result's own columns replace."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row."""
    return functools.reduce(lambda a, b: a + b, [_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema], F.lit(16)).cast("long")


def bytes_of(df: DataFrame) -> int:
    """About the bytes of all rows; one pass over df."""
    return df.agg(F.sum(_row_bytes(df))).first()[0] or 0


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", limit: int | None = None, size: int | None = None) -> DataFrame:
    """Join left with a small, cut right side, nulls equal.

    right is measured, unless its size is given: up to limit bytes (BROADCAST_BYTES) it is
    broadcast, beyond that both sides are shuffled by the key, and adaptive execution
    splits left's hot keys.
    """
    named = right.select(*[F.col(f"`{c}`").alias(f"__r_{c}") if c in on else F.col(f"`{c}`") for c in right.columns])
    if (bytes_of(right) if size is None else size) <= (BROADCAST_BYTES if limit is None else limit):
        named = F.broadcast(named)
    cond = [left[c].eqNullSafe(named[f"__r_{c}"]) for c in on]
    return left.join(named, cond, how).drop(*[f"__r_{c}" for c in on])
