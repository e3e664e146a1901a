"""Exact top-k search by inner product with a pivot table.

Vectors become integers (floor(scale * x)). Each vector is lifted by one coordinate
sqrt(M^2 - |x|^2) so that the inner product and the Euclidean distance to a query
order alike. Distances of all rows to a fixed number of pivots are the pivot table,
stored beside the vectors; for a query the largest |d(q, p) - d(x, p)| over the pivots
is a lower bound of d(q, x). Candidates are evaluated in the order of that bound until
the bound shows that no later one can enter the k best. Scores are exact integers.

Queries are dealt into blocks of about `block` vectors, each a file in the shared
folder; none passes the driver. A task takes its vectors in chunks of CHUNK rows and
reads the blocks one after another for each chunk, so what it holds is bounded. It
keeps the k-th score of each query, which stops later chunks earlier, and sends on at
most k rows a query and chunk.

Where vectors are alike in all directions (random ones of 64 dimensions), distances to
pivots differ little and the bounds leave most rows to be evaluated: 0.95 of them with
32 pivots, 0.90 with 512 over 20,000 such rows.

Defined cases: a vector that is null or holds a null or non-finite component takes no
part; vectors only meet vectors of the same length; repeated ids are separate
candidates except that a query never meets rows of its own id; a query id with several
vectors gets a ranking for each distinct one; ties go to the smaller id; further
columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, storage

#: Queries a pass holds at once: 16,384 vectors of 64 integers are 8 MB.
QUERY_BLOCK = 16_384
#: Rows a task holds at once.
CHUNK = 32_768
PIVOTS = 32


def integer_vectors(df: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, v) with v array<long> = floor(scale * x), only for vectors that take part."""
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return df.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.int64)


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    norm = (x.astype(float) ** 2).sum(1)
    return np.concatenate((x.astype(float), np.sqrt(np.maximum(top - norm, 0))[:, None]), 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def best_of(ids, x, bound, query_id, q, q_lift, slack, k, least):
    """The k best of one chunk for one query, by elimination; (ids, scores). Rows that score below `least` may be left out."""
    order = np.argsort(bound, kind="stable")
    order = order[ids[order] != query_id]
    got = np.zeros(0, np.int64)
    score = np.zeros(0, np.int64)
    step = max(4 * k, 64)
    at = 0
    while at < len(order):
        worst = max(least, score.min()) if len(got) >= k else least
        if worst > NO_SCORE:
            # distance of the k-th best; a bound above it cannot reach that score
            far = np.sqrt(max(q_lift - 2.0 * worst, 0.0)) + slack
            if bound[order[at]] > far:
                break
        take = order[at : at + step]
        at += step
        step *= 2
        got = np.concatenate((got, take))
        score = np.concatenate((score, x[take] @ q))
        if len(got) > k:
            keep = np.lexsort((ids[got], -score))[:k]
            got, score = got[keep], score[keep]
    keep = np.lexsort((ids[got], -score))[:k]
    keep = keep[score[keep] >= least]
    return ids[got[keep]], score[keep]


NO_SCORE = np.iinfo(np.int64).min


def pivot_topk(df: DataFrame, id_col: str, vector: str, queries: Column, k: int = 10, scale: int = 1024, pivots: int = PIVOTS, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, id, score of the k largest inner products of each query row."""
    spark: SparkSession = df.sparkSession
    common.prepare(spark)
    vectors = common.cut(integer_vectors(df, id_col, vector, scale).withColumn("dim", F.size("v")))
    asked = integer_vectors(df.where(queries), id_col, vector, scale).withColumn("dim", F.size("v")).distinct()
    asked = common.cut(asked)
    norm = F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    tops = {r["dim"]: r["top"] for r in vectors.groupBy("dim").agg(norm.alias("top")).collect()}  # one row for each vector length
    per_dim = {r["dim"]: r["count"] for r in asked.groupBy("dim").count().collect()}
    out = None
    for dim in sorted(per_dim):
        mine = vectors.where(F.col("dim") == dim)
        # the pivots: a fixed number of rows
        chosen = np.array([r["v"] for r in mine.orderBy(F.xxhash64("id", "v")).select("v").limit(pivots).collect()], np.int64)
        files = _write_blocks(asked.where(F.col("dim") == dim).select("id", "v"), -(-per_dim[dim] // block))
        found = _search(_pivot_table(mine.select("id", "v"), chosen, tops[dim]), files, chosen, tops[dim], k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _write_blocks(asked: DataFrame, blocks: int) -> list[str]:
    """Paths of Arrow files (id, v) that together hold the queries, one a block."""
    folder = storage.make_folder(common.shared_path(asked.sparkSession, "queries"))
    named = asked.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(held) if held else None
        for part in table["part"].unique().to_pylist() if held else ():
            rows = table.filter(pc.equal(table["part"], part)).select(["id", "v"])
            path = f"{folder}/block-{part:06d}.arrow"
            stream, commit = storage.open_new(path)
            with pa.ipc.new_file(stream, rows.schema) as sink:
                sink.write_table(rows)
            commit()
            yield pa.RecordBatch.from_pydict({"path": [path]})

    return sorted(r["path"] for r in named.repartition(blocks, "part").mapInArrow(task, "path string").collect())


def _pivot_table(rows: DataFrame, chosen: np.ndarray, top: float) -> DataFrame:
    """rows with to_pivots, the distances to the pivots, stored."""
    lifted = _lift(chosen, top)

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _distances(_lift(_matrix(batch.column(1)), top), lifted)
                offsets = np.arange(0, far.size + 1, far.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(far.reshape(-1)))], ["id", "v", "to_pivots"])

    return common.cut(rows.mapInArrow(task, "id long, v array<long>, to_pivots array<double>"))


def _search(table: DataFrame, files: list[str], chosen: np.ndarray, top: float, k: int) -> DataFrame:
    """query_id, query (its number), id, score: at most k rows a query and chunk."""
    lifted = _lift(chosen, top)

    def compare(ids, x, to_pivots, kth: dict) -> Iterator[pa.RecordBatch]:
        for which, path in enumerate(files):
            with storage.open_ranges(path) as source:
                asked = pa.ipc.open_file(source).read_all()
            q_ids, q = asked["id"].to_numpy(), _matrix(asked["v"])
            norm = (q.astype(float) ** 2).sum(1)
            q_piv = _distances(np.concatenate((q.astype(float), np.zeros((len(q), 1))), 1), lifted)
            slack = 1e-6 * np.sqrt(top + norm.max()) + 1e-3
            least = kth.setdefault(which, np.full(len(q), NO_SCORE))
            out = []
            for i in range(len(q)):
                bound = np.zeros(len(ids))
                for p in range(len(lifted)):
                    np.maximum(bound, np.abs(to_pivots[p] - q_piv[i, p]), out=bound)
                a, s = best_of(ids, x, bound, q_ids[i], q[i], norm[i] + top, slack, k, least[i])
                if len(a) == k:
                    least[i] = max(least[i], s.min())
                out.append((np.full(len(a), q_ids[i]), np.full(len(a), (which << 32) + i), a, s))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["query_id", "query", "id", "score"])

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, kth = [], 0, {}
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield from chunk(held, kth)
                held, n = [], 0
        if n:
            yield from chunk(held, kth)

    def chunk(held: list, kth: dict) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        far = t["to_pivots"].combine_chunks()
        by_pivot = np.ascontiguousarray(np.asarray(far.flatten()).reshape(len(far), -1).T)
        yield from compare(t["id"].to_numpy(), _matrix(t["v"]), by_pivot, kth)

    return table.mapInArrow(task, "query_id long, query long, id long, score long")
