"""Benchmark decontamination, with DataFrame functions only.

Benchmark items are cut into windows of `width` normalised words (an item of fewer
words is one window). Every run of 13 words holds just one 7-gram that starts at a
multiple of seven words, so a document is scanned by the hashes of these 7-grams
(shorter windows likewise). Each is looked up in a bitmap of the benchmark's 7-grams, a
scalar subquery of at most 2 MB; what passes goes on as rows with the words around it,
which meet the broadcast hash table of the 7-grams and then that of the windows, where
hash and words must agree. A benchmark of more than BROADCAST_WINDOWS windows is joined
by shuffled hash instead. Verified hits give covered words, spans and items per
document; contaminated documents, or the covered spans alone, can then be removed.

Words are what is left between characters that are neither digits, letters a-z after
lower-casing A-Z, nor beyond ASCII.

Defined cases: a null text has no words; an item without words has no window; a null
item id is left out of the list of items but its windows count; repeated rows are
judged one by one; a text of any length is one row, scanned in one go; columns of docs
may have any name that does not begin with two underscores; an empty benchmark
contaminates nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .url_filter import LOWER, UPPER

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 13
BROADCAST_WINDOWS = 2_000_000
#: Longs of the bitmap of anchors at most; where it is dense, more rows reach the join.
BITMAP_LONGS = 1 << 18


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), lambda w: w != "")


def _window(words: Column, start: Column, length: Column | int) -> tuple[Column, Column]:
    """Hash and words of a window."""
    window = F.slice(words, start, length)
    return F.xxhash64(window), window


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """hash, words, length, items: the distinct windows with the sorted distinct ids of their items."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), normal_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("length", F.least(F.size("words"), F.lit(width)))
    rows = rows.withColumn("start", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)))
    name, window = _window(F.col("words"), F.col("start"), F.col("length"))
    rows = rows.select("item", name.alias("hash"), "length", window.alias("words"))
    return rows.groupBy("hash", "words", "length").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _slot(gram: Column, longs: int) -> tuple[Column, Column]:
    """(element, bit) of a hash in a bitmap of so many longs."""
    return F.pmod(F.shiftright(gram, 6), F.lit(longs)).cast("int"), F.pmod(gram, F.lit(64)).cast("int")


def bitmap(anchors: DataFrame) -> tuple[DataFrame, int]:
    """(one row with an array of longs that has the bit of each b_anchor set, its length): 32 bits an anchor, 2 MB at most."""
    longs = 64
    n = anchors.count()
    while longs < BITMAP_LONGS and longs * 2 < n:
        longs *= 2
    element, bit = _slot(F.col("b_anchor"), longs)
    some = anchors.select(element.alias("e"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("e").agg(F.bit_or("b").alias("b"))
    every = anchors.sparkSession.range(longs).join(F.broadcast(some), F.col("id") == F.col("e"), "left")
    rows = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("m"))
    return rows.select(F.transform("m", lambda x: x["b"]).alias("m")), longs


def _anchor(length: int) -> tuple[int, int]:
    """(k, stride): every run of `length` words holds just one k-gram that starts at a multiple of stride."""
    k = (length + 1) // 2
    return k, length - k + 1


def _anchors(words: Column, lengths: list[int], bits: Column, longs: int) -> Column:
    """Array of (at, length, anchor, from, near, n_words): one entry with at -1 for the row itself, then the
    anchors that are in the bitmap with the words of all windows that may hold them; positions count from 1."""
    null, total = F.lit(None).cast("long"), F.size(words).cast("long")
    field = lambda at, length, anchor, first, near, n: F.struct(at.alias("at"), F.lit(length).alias("length"), anchor.alias("anchor"), first.alias("from"), near.alias("near"), n.alias("n_words"))
    out = [F.array(field(F.lit(-1), 0, null, F.lit(0), F.slice(words, 1, 0), total))]

    def known(a: Column) -> Column:
        element, bit = _slot(a["gram"], longs)
        return F.getbit(F.get(bits, element), bit) == 1

    for length in lengths:
        k, stride = _anchor(length)

        def one(a: Column, length: int = length, stride: int = stride) -> Column:
            first = F.greatest(a["at"] - (stride - 1), F.lit(1))
            return field(a["at"], length, a["gram"], first, F.slice(words, first, a["at"] - first + length), null)

        def gram(i: Column, length: int = length, k: int = k) -> Column:
            return F.struct(i.alias("at"), F.xxhash64(F.lit(length), F.slice(words, i, k)).alias("gram"))

        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1)), F.lit(stride))
        out.append(F.transform(F.filter(F.transform(starts, _unary(gram)), known), _unary(one)))
    return F.concat(*out)


def _unary(f):
    """f as a lambda of one argument: Spark would take defaults for further arguments."""
    return lambda i: f(i)


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ("doc_id",), broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The keep columns with __row, __key, n_words, n_hit, items (sorted ids) and hits, one row a document row.

    hits is an array of (start, length) of verified windows, start counted from 0.
    """
    windows = common.cut(benchmark_windows(benchmark, width))
    lengths = sorted(r["length"] for r in windows.groupBy("length").count().collect())  # at most `width` numbers
    anchors = None
    for length in lengths:
        k, _ = _anchor(length)
        grams = windows.where(F.col("length") == length).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(length - k + 1)), _unary(lambda i, length=length, k=k: F.xxhash64(F.lit(length), F.slice("words", i, k))))).alias("b_anchor"))
        anchors = grams if anchors is None else anchors.unionByName(grams)
    anchors = docs.sparkSession.createDataFrame([], "b_anchor long") if anchors is None else common.cut(anchors.distinct())
    wanted = windows.select(F.col("hash").alias("b_hash"), F.col("words").alias("b_words"), "items")
    rows_of_bits, longs = bitmap(anchors)
    if windows.count() <= broadcast_windows:  # an item has fewer anchors than seven a window
        anchors, wanted = F.broadcast(anchors), F.broadcast(wanted)
    kept = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)]
    names = [f"__k{i}" for i in range(len(keep))]
    own = [*names, "__row", "__id", "__key"]
    rows = docs.select(*kept, F.monotonically_increasing_id().alias("__row"), _id(docs).alias("__id"), _key(docs).alias("__key"), F.array(normal_words(F.col("text"))).alias("__words"), rows_of_bits.scalar().alias("__bits"))
    # the words are bound once as the element of a one-element array
    near = rows.select(*own, F.inline(F.element_at(F.transform("__words", lambda words: _anchors(words, lengths, F.col("__bits"), longs)), 1)))
    near = near.join(anchors, F.col("anchor") == F.col("b_anchor"), "left").where("at < 0 or b_anchor is not null")
    blank = F.array(F.struct(F.lit(-1).alias("start"), F.lit(None).cast("long").alias("hash"), F.lit(None).cast("array<string>").alias("window")))
    last = F.least(F.col("at") - F.col("from") + 1, F.size("near") - F.col("length") + 1)

    def window(i: Column) -> Column:
        name, words = _window(F.col("near"), i, F.col("length"))
        return F.struct((i + F.col("from") - 2).alias("start"), name.alias("hash"), words.alias("window"))

    near = near.withColumn("w", F.when((F.col("at") < 0) | (last < 1), blank).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), window)))
    found = near.select(*own, "n_words", "length", "at", F.inline("w"))
    found = found.join(wanted, (F.col("hash") == F.col("b_hash")) & (F.col("window") == F.col("b_words")), "left")
    found = found.where("at < 0 or b_hash is not null").drop("window", "b_words", "hash", "b_hash")
    per_row = found.groupBy("__row", "__id", "__key").agg(
        *[F.first(n).alias(n) for n in names],
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("at") >= 0, F.struct("start", "length")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1)))))
    return per_row.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "__row", "__id", "__key", "n_words", covered.cast("long").alias("n_hit"), "items", "hits")


def _id(docs: DataFrame) -> Column:
    return F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long")


def _key(docs: DataFrame) -> Column:
    return common.row_key(docs) if "doc_id" in docs.columns else F.xxhash64("text")


def contaminated(min_share: int = 20) -> Column:
    """n_hit > 0 and n_hit at least one min_share-th of n_words."""
    return (F.col("n_hit") > 0) & (F.lit(min_share) * F.col("n_hit") >= F.col("n_words"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_share: int = 20) -> DataFrame:
    """docs without the contaminated rows; columns and texts unchanged."""
    bad = common.cut(find(docs, benchmark, width, ()).where(contaminated(min_share)).select("__id", "__key").distinct())
    keyed = docs.withColumns({"__id": _id(docs), "__key": _key(docs)})
    return common.small_join(keyed, bad, ["__id", "__key"], "left_anti").drop("__id", "__key")


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs whose texts lost the normalised words inside any window; only hit rows are rewritten."""
    hits = find(docs, benchmark, width, ()).where("n_hit > 0").groupBy("__id", "__key").agg(F.first("hits").alias("__hits"))
    keyed = docs.withColumns({"__id": _id(docs), "__key": _key(docs)})
    joined = common.small_join(keyed, common.cut(hits), ["__id", "__key"], "left")
    words = normal_words(F.col("text"))
    covered = F.flatten(F.transform("__hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1)))
    left = F.filter(words, lambda w, i: ~F.array_contains("__covered", i))
    joined = joined.withColumn("__covered", covered)
    return joined.withColumn("text", F.when(F.col("__hits").isNull(), F.col("text")).otherwise(F.array_join(left, " "))).select(*[F.col(f"`{c}`") for c in docs.columns])
