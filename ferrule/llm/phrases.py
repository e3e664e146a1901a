"""Phrase collocation mining by contiguous pattern growth.

Texts, A-Z lower-cased, are cut at punctuation and line ends into pieces and those at
blanks into words; phrases lie within pieces, and everything is counted by language.

1. Words are counted; a word (with its language) goes by a 64-bit hash from there on.
2. Pairs of frequent words are counted: the frequent pairs are the prefixes to grow.
3. Every place of a frequent pair whose next pair is frequent too is projected: the
   pair with the words to its right, up to `max_words`, as far as pairs stay frequent
   (a phrase is frequent only if all its pairs are). Words stand in for pointers, since a
   task cannot reach into the texts of another; equal projections of a task travel as
   one with their number.
4. Projections are dealt by range to sorted partitions: a task has a run of prefixes, and
   a prefix with more projections than a task should hold is divided by the words that
   follow. In a task, a prefix is a range of the sorted projections; it is extended to
   the right depth first, by splitting its range at the next word, while the phrase is
   frequent. Ranges that touch the end of what a task holds at a time go out as partial
   counts, which are added up, so no prefix has to fit one task.
5. Cuts are scored by joins of a phrase's two parts with the counts, in decimals of 38
   digits (exact while counts stay under 10^16). Phrases covered by a longer one go; the
   best of each language are ranked in shares first, so no language is one task's sort.

Frequent words and pairs reach the tasks as bit sets of at most BITMAP_BITS bits; what
passes by chance is counted exactly later and goes then. Two words that share a hash,
one of which could count as frequent, make the miner take another seed.

Defined cases: a null text is empty; a null language is `und`, like a document of that
language; rows that repeat an id or a text all count; a very long text is cut into
stretches of STRETCH bytes when its words are hashed; other columns are not read, so
their names don't matter; a language without candidates, and an empty table, give no
rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

#: Fixed values of the contract: what ends a piece, and blanks.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b"\x20\x09"
MIN_COUNT, MAX_WORDS, TOP, COVER, SCALE = 100, 5, 2000, 100, 1000
#: Bits of the sets of frequent words and pairs at most; where they are dense, more is counted exactly.
BITMAP_BITS = 1 << 26
#: Bytes of text whose words are in memory at once, and distinct words or rows of counts that a task keeps.
STRETCH, KEPT = 4 << 20, 1 << 19
#: Projections that a task grows at a time, and that a sorted partition holds about.
CHUNK_ROWS, PARTITION_ROWS = 1 << 19, 1 << 19
#: Shares of a language that are ranked before the language is.
SHARES = 64

_EVEN = bytes.maketrans(PIECE_ENDS + b"\x09", b"\n" * len(PIECE_ENDS) + b" ")


def _blobs(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(language, texts joined by a piece end, lower-cased, with one kind of piece end and of blank)."""
    held: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        held.setdefault(lang, []).append(text.as_py() or b"")
    for lang, texts in held.items():
        yield lang, b"\n".join(texts).lower().translate(_EVEN)


def _stretches(blob: bytes) -> Iterator[bytes]:
    """blob in stretches of about STRETCH bytes that end between words."""
    at = 0
    while at < len(blob):
        end = at + STRETCH
        if end < len(blob):
            ends = [e for e in (blob.find(b" ", end), blob.find(b"\n", end)) if e >= 0]
            end = min(ends, default=len(blob)) + 1
        yield blob[at:end]
        at = end


class Hashes(dict):
    """64-bit hash of a word of one language, remembered; 0 is a piece end and 1 nothing."""

    def __init__(self, lang: str, seed: int):
        self.seed = 42  # as Spark's xxhash64() of several columns starts; see word_hash()
        for part in (str(seed), lang):
            self.seed = xxhash.xxh64_intdigest(part.encode(), self.seed)
        self.clear()

    def clear(self) -> None:
        super().clear()
        self[b"\n"], self[b""] = 0, 1

    def __missing__(self, word: bytes) -> int:
        out = self[word] = max(2, xxhash.xxh64_intdigest(word, self.seed))
        return out

    def of(self, blob: bytes) -> np.ndarray:
        out = []
        for part in _stretches(blob):
            out.append(np.fromiter(map(self.__getitem__, part.replace(b"\n", b" \n ").split(b" ")), np.uint64))
            if len(self) > KEPT:
                self.clear()
        found = np.concatenate(out) if out else np.zeros(0, np.uint64)
        return found[found != 1]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def word_hash(seed: int) -> Column:
    """The hash of a word (lang, word) that Hashes gives it in the tasks."""
    h = F.xxhash64(F.lit(str(seed)), "lang", "word")
    return F.when(h.between(0, 1), F.lit(2).cast("long")).otherwise(h)


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, n: how often each word occurs."""
    common.prepare(docs.sparkSession)

    def out(lang: str, count: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(count), pa.string()), pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["lang", "word", "n"])

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, blob in _blobs(batch):
                for part in _stretches(blob):
                    counts.setdefault(lang, Counter()).update(part.split())
                if sum(map(len, counts.values())) > KEPT:
                    yield from (out(*x) for x in counts.items())
                    counts = {}
        yield from (out(*x) for x in counts.items())

    return _texts(docs).mapInArrow(task, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _mixed(a, b):
    """a turned by 21 bits, exclusive or b: one number for a pair of hashes (numpy unsigned)."""
    return (a << np.uint64(21)) ^ (a >> np.uint64(43)) ^ b


def _mixed_columns(a: Column, b: Column) -> Column:
    turned = F.call_function("shiftleft", a, F.lit(21)).bitwiseXOR(F.shiftrightunsigned(a, 43))
    return turned.bitwiseXOR(b)


def bit_set(keys: DataFrame, key: Column) -> np.ndarray:
    """Bytes with the bit of each key's low bits set: 32 bits a key, BITMAP_BITS at most."""
    bits, n = 1 << 12, keys.count()
    while bits < BITMAP_BITS and bits < 32 * n:
        bits *= 2
    low = key.bitwiseAND(bits - 1)
    longs = keys.select(F.shiftright(low, 6).cast("int").alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(63).cast("int")).alias("bit"))
    rows = longs.groupBy("slot").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows["slot"].to_numpy()] = rows["bit"].to_numpy()
    return out.view(np.uint64)


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys & np.uint64(len(bits) * 64 - 1)
    return (bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def _summed(columns: list[np.ndarray], n: np.ndarray) -> list[np.ndarray]:
    """Equal rows as one, with the sum of n; rows that don't come to lie together stay apart."""
    mixed = columns[0]
    for c in columns[1:]:
        mixed = _mixed(mixed, c)
    order = np.argsort(mixed)
    columns, n = [c[order] for c in columns], n[order]
    new = np.ones(len(n), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    return [*(c[first] for c in columns), np.add.reduceat(n, first) if len(n) else n]


def _counted(docs: DataFrame, seed: int, names: list[str], rows_of) -> DataFrame:
    """names, n: what rows_of(hashes of a blob) gives, summed in a task."""
    common.prepare(docs.sparkSession)

    def out(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        *columns, n = _summed([np.concatenate([h[i] for h in held]) for i in range(len(names))], np.concatenate([h[-1] for h in held]))
        return pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(n)], [*names, "n"])

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Hashes] = {}
        held: list[list[np.ndarray]] = []
        for batch in batches:
            for lang, blob in _blobs(batch):
                if lang not in known and sum(map(len, known.values())) > KEPT:
                    known = {}
                columns = rows_of(known.setdefault(lang, Hashes(lang, seed)).of(blob))
                held.append(_summed(columns, np.ones(len(columns[0]), np.int64)))
            if sum(len(h[-1]) for h in held) > 4 * KEPT:
                yield out(held)
                held = []
        if held:
            yield out(held)

    kinds = ", ".join(f"{c} long" for c in [*names, "n"])
    return _texts(docs).mapInArrow(task, kinds)


def count_pairs(docs: DataFrame, frequent: DataFrame, seed: int) -> DataFrame:
    """a, b, n: pairs of neighbouring words in the set of frequent ones, by their hashes."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_set(frequent, F.col("hash")))

    def pairs(found: np.ndarray) -> list[np.ndarray]:
        ok = (found != 0) & _has(bits.value, found)
        at = np.flatnonzero(ok[1:] & ok[:-1])
        return [found[at], found[at + 1]]

    return _counted(docs, seed, ["a", "b"], pairs).groupBy("a", "b").agg(F.sum("n").alias("n"))


def project(docs: DataFrame, pairs: DataFrame, seed: int, max_words: int = MAX_WORDS) -> DataFrame:
    """w1 ... and n: each frequent pair with at least one word to its right; 0 where the projection has ended."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_set(pairs, _mixed_columns(F.col("a"), F.col("b"))))
    names = [f"w{i + 1}" for i in range(max_words)]

    def projections(found: np.ndarray) -> list[np.ndarray]:
        ok = np.zeros(len(found) + max_words, bool)
        if len(found) > 1:
            ok[: len(found) - 1] = (found[:-1] != 0) & (found[1:] != 0) & _has(bits.value, _mixed(found[:-1], found[1:]))
        at = np.flatnonzero(ok[:-1] & ok[1:])
        going, out = np.ones(len(at), bool), [found[at], found[at + 1]]
        for k in range(2, max_words):
            going = going & ok[at + k - 1]
            out.append(np.where(going, found[np.minimum(at + k, len(found) - 1)] if len(found) else found, np.uint64(0)))
        return out

    return _counted(docs, seed, names, projections)


def grow(columns: list[np.ndarray], n: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(first row, words, count) of phrases of three words and more in sorted projections.

    A range of rows is a prefix; each of its runs of one next word is a longer prefix,
    which is grown before the next run. Runs that touch the first or last row count
    whatever their number, for they may go on elsewhere.
    """
    every = len(n)

    def extend(lo: int, hi: int, depth: int) -> Iterator[tuple[int, int, int]]:
        word = columns[depth][lo:hi]
        starts = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        sums, stops = np.add.reduceat(n[lo:hi], starts), np.append(starts[1:], hi - lo)
        wanted = (sums >= least) | (starts + lo == 0) | (stops + lo == every)
        for i in np.flatnonzero(wanted & (word[starts] != 0)):
            if depth >= 2:
                yield lo + int(starts[i]), depth + 1, int(sums[i])
            if depth + 1 < len(columns):
                yield from extend(lo + int(starts[i]), lo + int(stops[i]), depth + 1)

    if every:
        yield from extend(0, every, 0)


def grown(projections: DataFrame, least: int) -> DataFrame:
    """words (array of hashes), n: the frequent phrases of three words and more."""
    spark = projections.sparkSession
    names = [c for c in projections.columns if c != "n"]

    def phrases(block: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(block)
        columns = [table.column(c).to_numpy() for c in names]
        found = list(grow(columns, table.column("n").to_numpy(), least))
        words = [[int(columns[k][at]) for k in range(size)] for at, size, _ in found]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int64())), pa.array([x[2] for x in found], pa.int64())], ["words", "n"])

    @common.frees
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[pa.RecordBatch] = []
        for batch in batches:
            block.append(batch)
            if sum(b.num_rows for b in block) >= CHUNK_ROWS:
                yield phrases(block)
                block = []
        if block:
            yield phrases(block)

    path = common.shared_path(spark, "projections")
    projections.write.parquet(path)
    written = spark.read.parquet(path)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-written.count() // PARTITION_ROWS))
    dealt = written.repartitionByRange(parts, *names).sortWithinPartitions(*names)
    found = dealt.mapInArrow(task, "words array<long>, n long")
    return found.groupBy("words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def frequent_words(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """(lang, word, hash, n of frequent words; lang, total; seed without confusions)."""
    counted, seed = common.cut(count_words(docs)), 0
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    while True:
        words = counted.withColumn("hash", word_hash(seed))
        shared = words.groupBy("hash").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"))
        if shared.where((F.col("words") > 1) & (F.col("n") >= least)).isEmpty():
            return words.where(F.col("n") >= least), totals, seed
        seed += 1


def count_phrases(docs: DataFrame, least: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, n of all frequent phrases from one word on; lang, word, hash, n; lang, total)."""
    words, totals, seed = frequent_words(docs, least)
    pairs = common.cut(count_pairs(docs, words, seed).where(F.col("n") >= least))
    every = words.select(F.array("hash").alias("words"), "n").unionByName(pairs.select(F.array("a", "b").alias("words"), "n"))
    if max_words > 2:
        every = every.unionByName(grown(project(docs, pairs, seed, max_words), least))
    return common.cut(every), words, totals


def _exact(name: str) -> Column:
    return F.col(name).cast(T.DecimalType(16, 0))


def score_cuts(phrases: DataFrame, every: DataFrame, heads: DataFrame) -> DataFrame:
    """words, a, l, r, n, score: each phrase of two words and more by its lowest-scoring cut.

    heads: head (a phrase's first word), lang, total.
    """
    rows = common.small_join(phrases.withColumn("head", F.get("words", 0)), heads, ["head"], "inner")
    rows = rows.select("lang", "words", F.col("n").alias("a"), F.col("total").alias("n"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    rows = rows.withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    rows = common.small_join(rows, every.select(F.col("words").alias("left"), F.col("n").alias("l")), ["left"], "inner")
    rows = common.small_join(rows, every.select(F.col("words").alias("right"), F.col("n").alias("r")), ["right"], "inner")
    rows = rows.withColumns({"over": F.lit(SCALE).cast(T.DecimalType(4, 0)) * (_exact("a") * _exact("n")), "under": _exact("l") * _exact("r")})
    rows = rows.withColumn("score", F.expr("over div under"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return rows.groupBy("lang", "words", "a", "n").agg(best).select("lang", "words", "a", "best.l", "best.r", "n", "best.score")


def covered(phrases: DataFrame, cover: int = COVER) -> DataFrame:
    """words of the phrases inside a longer one with 100 * n(longer) >= cover * n."""
    size = F.size("words")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.slice("words", i, k))))
    inside = phrases.where(size > 2).select(F.explode(F.array_distinct(spans)).alias("words"), "n")
    longest = inside.groupBy("words").agg(F.max("n").alias("longer"))
    return common.small_join(phrases, common.cut(longest), ["words"], "inner").where(100 * F.col("longer") >= cover * F.col("n")).select("words")


def spelled(rows: DataFrame, words: DataFrame) -> DataFrame:
    """rows with phrase, the words of the hashes joined by one space."""
    each = rows.select("words", F.posexplode("words").alias("at", "hash"))
    each = common.small_join(each, words.select("hash", F.col("word").cast("string").alias("word")), ["hash"], "inner")
    texts = each.groupBy("words").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("of"))
    texts = texts.select("words", F.array_join(F.transform("of", lambda x: x["word"]), " ").alias("phrase"))
    return common.small_join(rows, common.cut(texts), ["words"], "inner")


def mine(docs: DataFrame, least: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, cover: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language by their lowest-scoring cut."""
    if least < 1 or max_words < 2 or not 0 < cover <= 100:
        raise ValueError("least from 1, max_words from 2, cover from 1 to 100")
    every, words, totals = count_phrases(docs, least, max_words)
    phrases = every.where(F.size("words") > 1)
    heads = common.cut(common.small_join(words, common.cut(totals), ["lang"], "inner").select(F.col("hash").alias("head"), "lang", "total"))
    rows = common.small_join(phrases, common.cut(covered(phrases, cover)), ["words"], "left_anti")
    rows = common.cut(score_cuts(rows, every, heads))
    rows = spelled(rows, words)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    rows = rows.withColumn("share", share).withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("place") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
