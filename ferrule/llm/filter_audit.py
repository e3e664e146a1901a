"""Filter interaction audit: what each filter of a chain removes, in every order.

Rows that say which filters they fail are packed, in blocks of a partition, into bit
sets with numpy: one for each filter and label, with the rows of a part in a run of
whole 64-bit words. Those alive after a set of filters are those alive after the set
without one of its filters, AND NOT the failures of that one; their popcounts, summed
over a part's words, are partial counts that Spark adds up. The counts of all 2^n
prefix sets give every number of every order, and no order is ever run.

`quality_flags` makes the failures of five document filters; `audit` takes any boolean
columns. A task holds one block of BLOCK_ROWS rows and 2^n bit sets of it, whatever
the number of parts; the counts of a block go out before the next.

Defined cases: a null or empty text has no words and no characters, and equals any
other such text; a null part is the empty string; a null failure or label is false;
rows that repeat an id are judged one by one, none a copy of the other by id alone; a
null id is no copy and has no copies; labels that repeat an id say yes if one of them
does; a very long text is one row of an Arrow batch; other columns of docs and labels
are not read, so their names don't matter; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a block of bit sets.
BLOCK_ROWS = 1 << 18
#: Filters at most: their orders are listed, and there are n! of them.
MAX_FILTERS = 7
#: Fixed values of the contract.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 50, 65, 5
MARKS, UPPER = b"#$%&*|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails; bytes.split() cuts at just the white space of the contract."""
    words = text.split()
    points = len(text.decode(errors="replace"))
    upper = len(text) - len(text.translate(None, UPPER))
    marked = len(text) != len(text.translate(None, MARKS))
    return (len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1 | (100 * upper > MAX_UPPER * points) << 2 | marked << 3


@common.frees
def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits, digests = [], []
        for value in batch.column(2):  # one text at a time
            text = value.as_py() or b""
            bits.append(failures(text))
            digests.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "bits", "digest"])


def quality_flags(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, A to E (fails the filter), good and toxic: one row a document."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    rows = common.cut(rows.mapInArrow(_judge, "id long, part string, bits int, digest binary"))
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = common.small_join(rows, common.cut(first), ["digest"])
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = common.small_join(rows, common.cut(known), ["id"])
    fails = [(F.col("bits").bitwiseAND(1 << i) != 0).alias(c) for i, c in enumerate(FILTERS[:4])]
    return rows.select("part", *fails, F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias(FILTERS[4]), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def packed(columns: list[np.ndarray], place: np.ndarray, words: int) -> list[np.ndarray]:
    """Bit sets of boolean columns whose rows go to the given places."""
    out = []
    for column in columns:
        spread = np.zeros(words * 64, bool)
        spread[place] = column
        out.append(np.packbits(spread).view(np.uint64))
    return out


def block_counts(codes: np.ndarray, parts: int, fails: list[np.ndarray], labels: list[np.ndarray]) -> np.ndarray:
    """Counts [part, set, 1 + label] of rows alive after each set of filters; bit i of a set is filter i."""
    sizes = np.bincount(codes, minlength=parts)
    width = -(-sizes // 64)
    first = np.cumsum(width) - width
    order = np.argsort(codes, kind="stable")
    place = np.empty(len(codes), np.int64)
    place[order] = np.repeat(first * 64 - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(codes))
    valid, *rest = packed([np.ones(len(codes), bool), *fails, *labels], place, int(width.sum()))
    fail, label = rest[: len(fails)], rest[len(fails) :]
    alive, out = [valid], np.empty((parts, 1 << len(fails), 1 + len(label)), np.int64)
    for subset in range(1 << len(fails)):
        if subset:
            i = (subset & -subset).bit_length() - 1
            alive.append(alive[subset & (subset - 1)] & ~fail[i])
        for j, bits in enumerate([alive[subset], *(alive[subset] & x for x in label)]):
            out[:, subset, j] = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), first)
    return out


def prefix_counts(flags: DataFrame, filters: list[str], labels: list[str], part: str = "part") -> DataFrame:
    """part, prefix, alive, alive_0 ...: documents, and those of each label, that pass each set of filters."""
    common.prepare(flags.sparkSession)
    n, names = len(filters), [f"alive_{j}" for j in range(len(labels))]
    kinds = ", ".join(f"{c} long" for c in ["alive", *names])

    def counted(block: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(block).combine_chunks()
        coded = table.column(0).combine_chunks().dictionary_encode()
        columns = [table.column(j + 1).combine_chunks().to_numpy(zero_copy_only=False).astype(bool) for j in range(n + len(labels))]
        parts = len(coded.dictionary)
        counts = block_counts(coded.indices.to_numpy().astype(np.int64), parts, columns[:n], columns[n:])
        at = np.repeat(np.arange(parts), 1 << n)
        sets = np.tile(np.arange(1 << n, dtype=np.int32), parts)
        return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(at)), pa.array(sets), *(pa.array(counts[:, :, j].ravel()) for j in range(1 + len(labels)))], ["part", "prefix", "alive", *names])

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                block.append(batch)
            if sum(b.num_rows for b in block) >= BLOCK_ROWS:
                yield counted(block)
                block = []
        if block:
            yield counted(block)

    told = [F.coalesce(F.col(f"`{c}`").cast("boolean"), F.lit(False)).alias(f"c{i}") for i, c in enumerate([*filters, *labels])]
    rows = flags.select(F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), *told)
    return rows.mapInArrow(task, f"part string, prefix int, {kinds}").groupBy("part", "prefix").agg(*[F.sum(c).alias(c) for c in ["alive", *names]])


def _steps(flags: DataFrame, filters: list[str]) -> DataFrame:
    """filter_order, step, filter, before: every step of every order with the set of filters ahead of it."""
    rows = []
    for order in itertools.permutations(range(len(filters))):
        name, before = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order):
            rows.append((name, step + 1, i, before))
            before |= 1 << i
    return flags.sparkSession.createDataFrame(rows, "filter_order string, step int, filter int, before int")


def audit(flags: DataFrame, filters: list[str], labels: list[str], part: str = "part") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, <label>_lost ..., shapley.

    Every part has a row for each step of each order, zeros included. filters and labels
    are names of boolean columns of flags; a filter is true where it fails.
    """
    if not 0 < len(filters) <= MAX_FILTERS:
        raise ValueError(f"between 1 and {MAX_FILTERS} filters")
    names = [f"alive_{j}" for j in range(len(labels))]
    counts = prefix_counts(flags, filters, labels, part)
    every = (1 << len(filters)) - 1
    sets = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("prefix", "alive", *names))).alias("sets"))
    rows = sets.select("part", "sets", F.explode(F.sequence(F.lit(0), F.lit(every))).alias("before"))
    rows = rows.join(F.broadcast(_steps(flags, filters)), "before")
    one = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    after = F.col("before").bitwiseOR(one)

    def alive(at: Column | int, name: str = "alive") -> Column:
        return F.get("sets", F.lit(at) if isinstance(at, int) else at)[name]

    removed = alive(F.col("before")) - alive(after)
    rows = rows.select(
        "part",
        "filter_order",
        "step",
        "filter",
        alive(after).alias("kept"),
        removed.alias("removed"),
        (alive(0) - alive(one) - removed).alias("redundant"),
        (alive(F.lit(every).bitwiseXOR(one)) - alive(every)).alias("unique_fails"),
        *[(alive(F.col("before"), name) - alive(after, name)).alias(f"{label}_lost") for label, name in zip(labels, names)],
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return rows.withColumn("shapley", shapley).drop("filter")

