"""Token-ID output: whole texts encoded with a public tokenizer, kept as directly addressable codes.

Documents are range-partitioned by id; a task encodes its range in order and writes
one file (see dac). Each document ends with the end id. Files carry the number of
their range, so the ids before a document are those of earlier files and of earlier
documents in its own file. Encoding is in `units`: by units of the text where the
tokenizer's file says that its units stand alone, by whole texts else.

Defined cases: a null text is empty and has the end id only; null ids come first;
rows that repeat an id stand side by side, ordered by their text's hash; a very long
text is encoded in one go by its task; further columns, whatever their names, are not
read; an empty table writes no file and gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewise as bw
from . import common, dac, storage, units

#: Ids of a segment of a file.
SEGMENT = 1 << 20
#: Bytes of text encoded at a time.
SLICE = 1 << 18


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, parts: int | None = None) -> DataFrame:
    """One file a range of ids; returns shard, path, bytes and n_tokens of each."""
    spark = docs.sparkSession
    common.prepare(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}.dac"
        stream = commit = None
        entries, index, held, size, total = [], [], [], 0, 0

        def flush() -> None:
            nonlocal held, size
            if held:
                data, entry = dac.encode(np.concatenate(held))
                entry["at"] = sum(e["bytes"] for e in entries)
                entry["first"] = sum(e["n"] for e in entries)
                stream.write(data)
                entries.append(entry)
                held, size = [], 0

        for batch in (part for whole in batches for part in bw.slices(whole, 1, SLICE)):
            ids = batch.column(0).to_pylist()
            if ids and stream is None:
                stream, commit = storage.open_new(path)
            for doc_id, code in zip(ids, units.encoder(tokenizer).texts(*bw.utf8(batch.column(1)))):
                code = np.append(code, np.uint32(end_id))
                index.append([doc_id, total, len(code)])
                held.append(code)
                total += len(code)
                size += len(code)
                if size >= SEGMENT:
                    flush()
        if stream is not None:
            flush()
            tail = dac.finish(entries, index)
            stream.write(tail)
            commit()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "bytes": pa.array([sum(e["bytes"] for e in entries) + len(tail)], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    return rows.select("doc_id", "text").mapInArrow(task, "shard int, path string, bytes long, n_tokens long")


def documents_of(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files."""
    # one row a file: the number of files is the number of partitions that wrote
    shards = sorted(manifest.collect(), key=lambda r: r["shard"])
    rows, before = [], 0
    for r in shards:
        rows.append((r["path"], r["bytes"], before))
        before += r["n_tokens"]
    files = spark.createDataFrame(rows, "path string, bytes long, before long").repartition(max(1, len(rows)), "path")

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                with storage.open_ranges(file["path"]) as source:
                    index = dac.open_index(source, file["bytes"])
                    docs = iter(index["docs"])
                    for entry in index["segments"]:
                        source.seek(entry["at"])
                        code = dac.decode(source.read(entry["bytes"]), entry).astype("<u4")
                        ids, first, n, crc = [], [], [], []
                        at = 0
                        while at < len(code):
                            doc_id, start, count = next(docs)
                            ids.append(doc_id)
                            first.append(file["before"] + start)
                            n.append(count)
                            crc.append(zlib.crc32(code[at : at + count].tobytes()))
                            at += count
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, first, n, crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token(path: str, size: int, i: int) -> int:
    """Token i of a file, by a few short reads."""
    with storage.open_ranges(path) as source:
        index = dac.open_index(source, size)
        entry = next(e for e in index["segments"] if e["first"] <= i < e["first"] + e["n"])

        def read(at: int, length: int) -> bytes:
            source.seek(entry["at"] + at)
            return source.read(length)

        return dac.get(read, entry, i - entry["first"])
