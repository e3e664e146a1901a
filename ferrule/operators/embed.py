"""Text embeddings from any model, with a table of what was embedded before.

A model is a callable that makes an encoder, and an encoder turns a list of texts into
a matrix. A worker makes the encoder once and keeps it; texts reach it in Arrow batches.
Vectors are kept in a table by the hash of their text and the model's name, so a text is
embedded once however many rows hold it, and not again in later runs.

Null texts have no vector; an empty text is embedded like any other.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.session import workers_import, written

Encoder = Callable[[list[str]], np.ndarray]

#: Encoders of this worker by the name of their model.
_LOADED: dict[str, Encoder] = {}

STORE = "text_hash string, model string, vector array<float>"


def hashed_grams(dims: int = 256, sizes: tuple[int, ...] = (1, 2, 3)) -> Encoder:
    """The default encoder: signed, hashed character n-grams, dampened by square root; the same everywhere."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for i, text in enumerate(texts):
            padded = f" {text} "
            for gram in (padded[j : j + k] for k in sizes for j in range(len(padded) - k + 1)):
                h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
                out[i, (h >> 1) % dims] += 1 if h & 1 else -1
        return np.sign(out) * np.sqrt(np.abs(out))

    return encode


def text_hash(text):
    return F.sha2(text, 256)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The vectors of all runs that ended, by the folders they wrote; empty where there is none.

    The folders are named one by one: Spark takes two reads of one root for the same
    table, whatever was written between them.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [str(x.getPath().getParent()) for x in files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS")) or []]
    return spark.read.schema(STORE).parquet(*sorted(done)) if done else spark.createDataFrame([], STORE)


def encoded(texts: DataFrame, make: Callable[[], Encoder], model: str, batch: int = 256) -> DataFrame:
    """text_hash, model, vector of unit length; texts: text_hash, text."""
    workers_import(texts.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if model not in _LOADED:
            _LOADED[model] = make()
        encode = _LOADED[model]
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                v = np.asarray(encode(part["text"].tolist()), np.float32)
                v = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)
                yield pd.DataFrame({"text_hash": part["text_hash"].to_numpy(), "model": model, "vector": list(v.astype(np.float32))})

    return texts.select("text_hash", "text").mapInPandas(run, STORE)


def embed(texts: DataFrame, store: str, make: Callable[[], Encoder] = hashed_grams, model: str = "hashed-grams-256") -> tuple[DataFrame, int]:
    """(texts with vector, number of texts that the model saw).

    texts: any columns and text. Distinct texts that the store lacks are embedded into a
    folder of their own in it, which counts once it is complete; a vector that two runs
    wrote at the same time counts once.
    """
    spark = texts.sparkSession
    rows = texts.withColumn("text_hash", text_hash(F.col("text")))
    known = open_store(spark, store).where(F.col("model") == model).select("text_hash").distinct()
    new = written(rows.where("text is not null").groupBy("text_hash").agg(F.first("text").alias("text")).join(known, "text_hash", "left_anti"), "texts")
    n = new.count()
    if n:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 10_000))
        encoded(new.repartition(parts), make, model).write.parquet(f"{store}/run-{uuid.uuid4().hex}")
    vectors = open_store(spark, store).where(F.col("model") == model).groupBy("text_hash").agg(F.first("vector").alias("vector"))
    return rows.join(vectors, "text_hash", "left").drop("text_hash"), n
