"""Line dedup, with DataFrame functions only.

Every text is split at line feeds and its lines exploded with their positions. A line's
key is the line without white space at both ends, A-Z lower-cased; keys of at least
`min_chars` code points are hashed (two 64-bit hashes of different seeds), and the
distinct documents of each hash are counted. Lines whose key is in at least `min_docs`
documents go, except in the document with the largest id that holds the key. A text is
put together again from the stretches between the positions that it loses.

Hashes, positions and ids are written once and used for counting and for finding what
goes, so texts are read twice: for hashing, and to rewrite those that lose lines. Ids
of one hash are first made distinct by hash and id, then counted in part before they
meet, so a line that a third of all documents hold is no hot key. The keys that go and
the positions lost are joined by broadcast up to a measured size, else by shuffle.

Defined cases: a null or empty text is one empty line and stays the empty text; rows
that repeat an id are one document for counting, and each of them is rewritten; a null
id is a document smaller than all others; lines that repeat inside the document that
keeps the key all stay; a text of any length is one row; further columns keep their
values, whatever their names, but n_lines, n_dropped and kept are replaced and none may
begin with two underscores; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .url_filter import LOWER, UPPER

#: U+0020 and U+0009 to U+000D.
BLANK = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
RESULT = ["n_lines", "n_dropped", "kept"]


def line_key(bare: Column) -> Column:
    """A stripped line with A-Z lower-cased; lower() does that for lines of ASCII alone, and faster."""
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """__id, __key, __pos, __h1, __h2: the lines whose keys are long enough; positions count from 0."""
    rows = docs.select(F.col("doc_id").alias("__id"), common.row_key(docs).alias("__key"), F.posexplode(_lines(F.col("text"))).alias("__pos", "__line"))
    bare = rows.withColumn("__line", F.btrim("__line", F.lit(BLANK))).where(F.length("__line") >= min_chars)
    keyed = bare.withColumn("__line", line_key(F.col("__line")))
    return keyed.select("__id", "__key", "__pos", F.xxhash64("__line").alias("__h1"), F.xxhash64(F.lit(1), "__line").alias("__h2"))


def shared_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """__h1, __h2, n_docs, __last: the keys of at least min_docs documents, with the largest id."""
    holders = lines.select("__h1", "__h2", "__id").distinct()
    counted = holders.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("__id").alias("__last"))
    return counted.where(F.col("n_docs") >= min_docs)


def _rewritten(lines: Column, gone: Column) -> Column:
    """lines without the positions in the sorted array gone: the stretches between them, joined."""
    ends = F.concat(gone, F.array(F.size(lines)))
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(gone, i - 1) + 1)
    return F.array_join(F.flatten(F.transform(ends, lambda end, i: F.slice(lines, start(i) + 1, end - start(i)))), "\n")


def remove(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with n_lines (before dropping), n_dropped and kept, the text that is left."""
    docs = common.without(docs, RESULT)
    lines = common.cut(hashed_lines(docs, min_chars))
    shared = common.cut(shared_lines(lines, min_docs).select("__h1", "__h2", "__last"))
    gone = common.small_join(lines, shared, ["__h1", "__h2"], "inner").where(~F.col("__id").eqNullSafe(F.col("__last")))
    gone = common.cut(gone.groupBy("__id", "__key").agg(F.sort_array(F.collect_set("__pos")).alias("__gone")))
    keyed = docs.withColumns({"__id": F.col("doc_id"), "__key": common.row_key(docs)})
    joined = common.small_join(keyed, gone, ["__id", "__key"], "left")
    # the lines are bound once as the element of a one-element array
    kept = F.element_at(F.transform(F.array(_lines(F.col("text"))), lambda lines: _rewritten(lines, F.col("__gone"))), 1)
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("__gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept"),
    )
