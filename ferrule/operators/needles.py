"""Which of many short texts (needles) are contained in which of many texts, without comparing all with all.

A needle of SIZE characters and more is looked up by one of its grams of SIZE
characters, the one that occurs in fewest texts; a shorter one by itself, as a gram of
its own length. A text offers its distinct grams, of those lengths that needles have,
and only those that some needle is looked up by. The join is by gram; what meets is
verified. A common gram is joined only if some needle has no rarer one, and adaptive
execution splits its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.session import small, written

SIZE = 4


def grams(text: Column, size: int) -> Column:
    """The distinct substrings of so many characters."""
    n = F.length(text)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(n >= size, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def contained(texts: DataFrame, needles: DataFrame, size: int = SIZE, distinct: bool = True) -> DataFrame:
    """(id, needle): texts (id, text) whose text contains a needle; an empty needle is in every text, a null in none.

    Needles count once; rows of texts that are equal count once too, unless distinct is false.
    """
    words = written(needles.select("needle").where("needle is not null").distinct(), "needles")
    rows = texts.select("id", "text").where("text is not null")
    if distinct:
        rows = rows.distinct()
    rows = written(rows, "haystack")
    longest = min(size, words.agg(F.max(F.length("needle"))).first()[0] or 0)
    lengths = [r["n"] for r in words.where("needle <> ''").select(F.least(F.length("needle"), F.lit(size)).alias("n")).distinct().collect()]  # at most `size` numbers
    offer = F.flatten(F.array(*[grams(F.col("text"), k) for k in sorted(lengths)])) if longest else F.array().cast("array<string>")
    each = words.where("needle <> ''").select("needle", F.explode(grams(F.col("needle"), size)).alias("gram"))
    each = each.unionByName(words.where((F.length("needle") < size) & (F.col("needle") != "")).select("needle", F.col("needle").alias("gram")))
    wanted = small(each.select("gram").distinct())
    often = rows.select(F.explode(offer).alias("gram")).join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy("needle").orderBy(F.coalesce("df", F.lit(0)), "gram")  # the grams of one needle
    keys = each.join(often, "gram", "left").withColumn("r", F.row_number().over(rarest)).where("r = 1 and df > 0").select("gram", "needle")
    keys = small(keys)
    met = rows.select("id", "text", F.explode(offer).alias("gram")).join(keys, "gram").where(F.col("text").contains(F.col("needle"))).select("id", "needle")
    if words.where("needle = ''").isEmpty():
        return met
    return met.unionByName(rows.select("id", F.lit("").alias("needle")))


def first_contained(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name, rank): for each text the contained name of least rank; names: name, rank."""
    found = contained(texts, names.select(F.col("name").alias("needle")))
    ranked = found.join(names, F.col("needle") == F.col("name"))
    return ranked.groupBy("id").agg(F.min(F.struct("rank", "name")).alias("b")).select("id", "b.name", "b.rank")
