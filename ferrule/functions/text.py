"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "no value", compared without case after trimming.
NA_TOKENS = ["", "nan", "null", "none", "n/a", "#n/a", "na", "-", "—"]
# Texts that mean yes and no.
TRUE_TEXT = ["true", "yes", "y", "1", "是"]
BOOL_TEXT = ["true", "false", "yes", "no", "y", "n", "是", "否"]
TYPE_ORDER = ["number", "datetime", "bool", "text"]
# Characters that no n-gram may hold.
GRAM_STOP = "[0-9\\-_()（）、，。 ]"


def normalize_na(x: Column) -> Column:
    """x unchanged, or null where its trimmed text means no value."""
    return F.when(~F.lower(F.trim(x)).isin(NA_TOKENS), x)


def attribute_name(x: Column) -> Column:
    """Trimmed, runs of white space one space; null is empty."""
    return F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"\s+", " ")


def short_attribute_name(x: Column) -> Column:
    """Trimmed, line ends each a space, cut to 160 characters; null is empty."""
    return F.substring(F.translate(F.trim(F.coalesce(x, F.lit(""))), "\n\r", "  "), 1, 160)


def value_text(x: Column) -> Column:
    """Trimmed text, null where it is empty or says nan, none or null."""
    t = F.trim(x.cast("string"))
    return F.when(~F.lower(t).isin("", "nan", "none", "null"), t)


def value_type(x: Column) -> Column:
    """number, datetime, bool or text of one value.

    A numeric text with one of - / : T is no number; as a lone signed number it reads as
    a date. Dates are ISO-like or with slashes, with or without a time.
    """
    t = F.trim(F.coalesce(x, F.lit("")))
    plain = F.regexp_replace(t, ",", "")
    numeric = plain.rlike(r"^[+]?(\d+(\.\d*)?|\.\d+)([eE][+]?\d+)?$")
    dated = t.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$") | t.rlike(r"^-\d{1,4}$")
    return F.when(t == "", "text").when(F.lower(t).isin(BOOL_TEXT), "bool").when(numeric, "number").when(dated, "datetime").otherwise("text")


def typed_slots(raw: Column) -> dict[str, Column]:
    """The four typed slots of a stored value: number, datetime, bool and text."""
    t = F.trim(raw)
    kind = value_type(t)
    number = F.when(kind == "number", F.regexp_replace(t, ",", "").try_cast("decimal(38,10)"))
    moment = F.when(kind == "datetime", F.coalesce(F.try_to_timestamp(F.regexp_replace(t, "/", "-"), F.lit("yyyy-M-d")), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, "/", "-"), "T", " "), F.lit("yyyy-M-d H:mm:ss"))))
    flag = F.when(kind == "bool", F.lower(t).isin(TRUE_TEXT))
    return {"value_number": number, "value_datetime": moment, "value_bool": flag, "value_text": F.when(number.isNull() & moment.isNull() & flag.isNull(), t)}


def row_hash(values: list[Column]) -> Column:
    """SHA-1 over UTF-8 values, 0xFF for null, each followed by 0x1F."""
    return F.sha1(F.concat(*[x for v in values for x in (F.coalesce(F.encode(v.cast("string"), "UTF-8"), F.unhex(F.lit("FF"))), F.unhex(F.lit("1F")))]))


def char_grams(x: Column, sizes: tuple[int, ...] = (2, 3), filtered: bool = True) -> Column:
    """The sorted distinct character n-grams of x; filtered: without those that hold a stop character."""
    n = F.length(x)
    one = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    grams = F.concat(*[one(k) for k in sizes])
    if filtered:
        grams = F.filter(grams, lambda g: ~g.rlike(GRAM_STOP))
    return F.array_sort(F.array_distinct(grams))


def sample_grams(names: Column) -> Column:
    """The distinct 2- and 3-grams, stop characters and all, of an array of names."""
    return F.array_distinct(F.flatten(F.transform(names, lambda s: char_grams(s, filtered=False))))


def sample_letters(names: Column) -> Column:
    """The distinct characters of an array of names joined by spaces."""
    return F.filter(F.array_distinct(F.split(F.array_join(names, " "), "")), lambda c: c != "")


def gram_overlap(a: Column, b: Column) -> Column:
    """How many grams two arrays of names share; if none, how many characters."""
    both = F.size(F.array_intersect(sample_grams(a), sample_grams(b)))
    return F.when(both > 0, both).otherwise(F.size(F.array_intersect(sample_letters(a), sample_letters(b))))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets, 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both).cast("double")), F.lit(0.0))


def is_garbage(name: Column, whitelist: list[str]) -> Column:
    """Names too short or too bare to mean anything, unless whitelisted."""
    t = F.trim(F.coalesce(name, F.lit("")))
    bare = t.rlike(r"^[A-Za-z]{1,4}$") | t.rlike(r"^[一-鿿]{1,2}$") | t.rlike(r"^\d+$") | t.rlike(r"^[A-Za-z\d_-]{1,3}$")
    return (t == "") | (bare & ~t.isin(whitelist))


# Endings of names cut off in the middle, and particles that no name ends with.
CUT_ENDINGS = ["完", "单", "信", "管", "市", "业"]
PARTICLES = ["的", "与", "和"]


def is_broken(code: Column, name: Column) -> Column:
    """A code with a Chinese character, a name of three or four characters with a cut ending, or one that ends with a particle."""
    ends = lambda words: name.rlike("(" + "|".join(words) + ")$")
    return F.coalesce(code, F.lit("")).rlike("[一-鿿]") | (F.length(name).between(3, 4) & ends(CUT_ENDINGS)) | ends(PARTICLES)


def confidence(samples: Column, word: Column, floor: Column) -> Column:
    """min(0.95, 0.5 + share of samples with the word / 2), at least floor, to two places."""
    hits = F.size(F.filter(samples, lambda s: s.contains(word)))
    share = F.coalesce(F.try_divide(hits.cast("double"), F.size(samples).cast("double")), F.lit(0.0))
    # six places first, so that 0.575 is not rounded by its binary tail
    return F.round(F.round(F.greatest(floor, F.least(F.lit(0.95), 0.5 + share * 0.5)), 6).cast("decimal(9,6)"), 2).cast("double")


def first_match(text: Column, routes: list[tuple[str, str]]) -> Column:
    """The target of the first keyword in list order that text contains."""
    return F.coalesce(*[F.when(text.contains(k), F.lit(v)) for k, v in routes], F.lit(None).cast("string"))


# Words before which a name is split into keywords.
KEYWORD_HEADS = ["信息", "管理", "数据"]


def keyword_tokens(name: Column, least: int = 2) -> Column:
    """The words of a name, split at white space and before KEYWORD_HEADS, of at least so many characters."""
    spaced = F.regexp_replace(F.coalesce(name, F.lit("")), "(" + "|".join(KEYWORD_HEADS) + ")", " $1")
    return F.filter(F.split(spaced, r"\s+"), lambda t: F.length(t) >= least)


def known(value: str | None, allowed: list[str], what: str) -> str | None:
    """value, if it is null or allowed; anything else raises."""
    if value is not None and value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}, not {value}")
    return value


def clamped(limit: int | None, most: int, default: int | None = None, least: int = 1) -> int:
    """A limit between least and most; the default where it is absent."""
    return max(least, min(most, most if limit is None and default is None else default if limit is None else limit))
