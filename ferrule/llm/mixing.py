"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, in a reproducible order of its documents, are packed into
blocks of fixed length. Targets come from the weights by filling up: no source may
exceed `repeat` times its size, and what it leaves is shared among the others. A
source's target fixes its number of slots; the slots of all sources are laid over
the output shards by one pseudorandom permutation, so a shard's source counts are a
multinomial draw given the totals. A source's slots are numbered over the shards and
mapped through a pseudorandom permutation of its block indices, pass after pass, so
that no block is used twice before all were used once. Blocks are joined by index.

Permutations are swap-or-not networks on [0, n): hash-driven exchanges of x and
key - x, computed per row for any n. Nothing depends on partitioning, so reruns agree.

Sources are one small row each and are ordered by name in one task; documents and slots
never are.

Defined cases: a null source is a source of its own, ordered last; a null text has no
words; documents without words take none; rows that repeat an id are separate
documents, and rows identical in id and text have neighbouring places that may swap; a
very long text is many blocks; further columns keep their values, whatever their names
(none may begin with two underscores); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 128
#: Output slots a shard holds.
SHARD_SLOTS = 4096
#: Output slots a task draws, about.
TASK_SLOTS = 1 << 17
#: Rows of one ordered run of documents; a source of any size is many runs.
RUN_ROWS = 4000
ROUNDS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def permute(x: Column, n: Column, seed: Column | int, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0 <= x < n, driven by seed."""
    seed = F.lit(seed) if isinstance(seed, int) else seed

    def swap(now: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(seed, r, F.lit("key")), n) - now, n)
        return F.when(F.pmod(F.xxhash64(seed, r, F.greatest(now, other)), F.lit(2)) == 0, now).otherwise(other)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), swap)


def targets(sizes: DataFrame, weights: list[float], share: float, repeat: float) -> DataFrame:
    """source, source_size, target: one row a source. sizes: source, source_size.

    With the ratios cap / weight in ascending order, the capped sources are a prefix;
    the level is what remains over the weight that remains.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    rows = rows.withColumn("cap", repeat * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumn("all", F.lit(float(share)) * F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    rows = rows.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the first source whose own level stays under its ratio sets the level of all later ones
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy("ratio", F.col("source").asc_nulls_last())))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everything)["level"]
    return rows.withColumn("final", level).select("source", "source_size", F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("final")), F.col("cap")).otherwise(F.col("w") * F.col("final")).alias("target"))


def place(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """sized with the place of each document's first word in its source.

    Documents fall by hash into runs of about RUN_ROWS, ordered inside; runs are then
    ordered by number. No source meets in one task.
    """
    runs = max(1, -(-sized.count() // RUN_ROWS))
    rows = sized.withColumn("run", F.pmod(F.xxhash64("key"), F.lit(max(64, runs))))
    inside = Window.partitionBy("source", "run").orderBy("doc_id", "key")
    rows = rows.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    totals = rows.groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    earlier = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    firsts = common.cut(totals.select("source", "run", F.coalesce(F.sum("run_size").over(earlier), F.lit(0)).alias("run_first")))
    rows = common.small_join(rows, firsts, ["source", "run"], "left")
    rows = common.small_join(rows, sources, ["source"], "left")
    return rows.withColumn("first", F.col("run_first") + F.col("inside"))


def slots(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """shard, slot, source, block: the output plan, one row a slot.

    sources: source, source_size, target. A source's draws are generated in chunks, so
    a source with most of the words is no single task.
    """
    n = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    plan = sources.where("source_size > 0").withColumn("blocks", n)
    plan = plan.withColumn("draws", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")).where("draws > 0")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    plan = plan.withColumn("before", F.coalesce(F.sum("draws").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = plan.withColumn("total", F.sum("draws").over(Window.partitionBy()))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1, F.lit(SHARD_SLOTS).cast("long")))
    plan = common.cut(plan)
    total = plan.agg(F.sum("draws")).first()[0] or 0
    parts = max(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_SLOTS))
    # with a number, adaptive execution doesn't merge the few rows that become many
    chunks = plan.withColumn("from", chunk).repartition(parts, "source", "from")
    draws = chunks.withColumn("draw", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + SHARD_SLOTS, F.col("draws")) - 1)))
    draws = draws.withColumn("slot", permute(F.col("before") + F.col("draw"), F.col("total"), F.lit(seed)))
    draws = common.cut(draws.select("source", "blocks", "slot", F.floor(F.col("slot") / SHARD_SLOTS).cast("long").alias("shard")))
    # multinomial counts a shard, then the number of each slot among its source's
    counts = draws.groupBy("source", "shard").agg(F.count(F.lit(1)).alias("drawn"))
    earlier = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = common.cut(counts.select("source", "shard", F.coalesce(F.sum("drawn").over(earlier), F.lit(0)).alias("shard_first")))
    inside = F.row_number().over(Window.partitionBy("source", "shard").orderBy("slot")) - 1
    numbered = common.small_join(draws.withColumn("inside", inside), firsts, ["source", "shard"], "left")
    j = F.col("shard_first") + F.col("inside")
    lap = F.floor(j / F.col("blocks"))
    index = permute(F.pmod(j, F.col("blocks")), F.col("blocks"), F.xxhash64(F.lit(seed), F.coalesce(F.col("source"), F.lit("\0null")), lap))
    return numbered.select("shard", "slot", "source", index.alias("block"))


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, repeat: float = 2.0, block: int = BLOCK, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(documents, plan).

    documents: doc_id, key, size, source, source_size, target, taken and pieces, an array
    of (start, length, times, block, at): which words the mix takes, of which block of the
    source and from which place in it. plan: the slots, see slots().
    """
    sized = docs.select("doc_id", "source", common.row_key(docs).alias("key"), word_count(F.col("text")).alias("size"))
    sized = common.cut(sized)
    sources = common.cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeat))
    plan = slots(sources, block, seed)
    used = plan.groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    placed = place(sized, sources)
    spans = placed.withColumn("row", F.monotonically_increasing_id())
    spans = common.cut(spans)
    first_block = F.floor(F.col("first") / block).cast("long")
    last_block = F.floor((F.col("first") + F.col("size") - 1) / block).cast("long")
    covers = spans.where("size > 0").select("row", "source", "first", "size", F.explode(F.sequence(first_block, last_block)).alias("block"))
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    joined = covers.withColumn("name", name).join(used.select(name.alias("name"), "block", "times"), ["name", "block"])
    start = F.greatest(F.col("block") * block - F.col("first"), F.lit(0))
    stop = F.least((F.col("block") + 1) * block - F.col("first"), F.col("size"))
    taken = joined.select("row", start.alias("start"), (stop - start).alias("length"), "times", "block", F.greatest(F.col("first") - F.col("block") * block, F.lit(0)).alias("at"))
    taken = taken.groupBy("row").agg(F.sum(F.col("length") * F.col("times")).alias("taken"), F.sort_array(F.collect_list(F.struct("start", "length", "times", "block", "at"))).alias("pieces"))
    out = spans.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return out.select("doc_id", "key", "size", "source", "source_size", "target", "taken", "pieces"), plan


def _with_pieces(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """docs, of which the mix takes something, with __pieces."""
    took = mixed.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("taken").alias("__taken"), F.col("pieces").alias("__pieces"))
    rows = docs.withColumn("__k", common.row_key(docs))
    twins = common.cut(took.groupBy("__id", "__key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("__id").alias("__t"), F.col("__key").alias("__u")))
    same = lambda i, k: F.col(i).eqNullSafe(F.col("__t")) & (F.col(k) == F.col("__u"))
    meets = rows["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__key"))
    if twins.isEmpty():
        return rows.join(took.where("__taken > 0"), meets)
    # identical rows are numbered on both sides, so that each gets its own pieces
    one = rows.join(twins, same("doc_id", "__k"), "left_anti").join(took.where("__taken > 0"), meets)
    left = common.numbered(rows.join(twins, same("doc_id", "__k"), "left_semi"), ["doc_id", "__k"], "__n")
    right = common.numbered(took.join(twins, same("__id", "__key"), "left_semi"), ["__id", "__key"], "__m")
    many = left.join(right.where("__taken > 0"), left["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__key")) & (F.col("__n") == F.col("__m")))
    return one.unionByName(many.drop("__n", "__m"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _cut_out(words: Column, p: Column) -> Column:
    return F.slice(words, (p["start"] + 1).cast("int"), p["length"].cast("int"))


def mixed_texts(docs: DataFrame, mixed: DataFrame, repeat: float = 2.0) -> DataFrame:
    """docs with each text replaced by the words the mix takes of it, pass after pass; rows without any go.

    n_chars follows the new text; the other columns stay.
    """
    laps = F.sequence(F.lit(1), F.lit(int(-(-repeat // 1))))

    def taken(words: Column) -> Column:
        one = lambda lap: F.flatten(F.transform(F.filter("__pieces", lambda p: p["times"] >= lap), lambda p: _cut_out(words, p)))
        return F.array_join(F.flatten(F.transform(laps, one)), " ")

    # the words are bound once as the element of a one-element array, else each piece splits the text again
    out = _with_pieces(docs, mixed).withColumn("text", F.element_at(F.transform(F.array(_words(F.col("text"))), taken), 1))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed_shards(docs: DataFrame, mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """shard, slot, source, n_words, text: the mix itself, a block of words in each slot, joined by block index.

    A block's words come from the documents that it covers and travel once for each slot
    that draws it. The last block of a source may be short.
    """
    rows = _with_pieces(docs.select("doc_id", "text", "source"), mixed)
    cut = lambda words: F.transform("__pieces", lambda p: F.struct(p["block"].alias("block"), p["at"].alias("at"), _cut_out(words, p).alias("words")))
    pieces = rows.select("source", F.inline(F.element_at(F.transform(F.array(_words(F.col("text"))), cut), 1)))
    named = lambda df: df.withColumn("__name", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")))
    drawn = named(plan).select("shard", "slot", "__name", "block")
    slot = named(pieces).join(drawn, ["__name", "block"]).groupBy("shard", "slot").agg(F.first("source").alias("source"), F.sort_array(F.collect_list(F.struct("at", "words"))).alias("parts"))
    words = F.flatten(F.transform("parts", lambda p: p["words"]))
    return slot.select("shard", "slot", "source", F.size(words).cast("long").alias("n_words"), F.array_join(words, " ").alias("text"))
