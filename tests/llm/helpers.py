"""Small tables that hold the awkward cases: nulls, empty and long texts, ties, copies, odd columns."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, `a b` string"


def words(text):
    return WORD.findall(text or "")


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * rnd.random() ** 2)}" for _ in range(n))


def awkward_docs(seed=3, n=60):
    """Rows of DOC_SCHEMA with near copies, exact copies, shared passages, nulls, ties and a very long text."""
    rnd = random.Random(seed)
    texts = [prose(rnd, rnd.randint(40, 160), 5000) for _ in range(n)]
    shared = prose(rnd, 60, 5000)
    for i in range(0, n, 7):
        texts[i] = texts[i] + "\n" + shared + " tail"
    for i in range(1, n, 9):
        parts = texts[i - 1].split(" ")
        parts[len(parts) // 2] = "changed"
        texts[i] = " ".join(parts)
    texts[5] = texts[6] = texts[7]
    texts[8] = prose(rnd, 6000, 5000)
    texts += [None, "", " \t\n", "one", "two words", "Und " * 150, "Und " * 150, "x" * 4000, "é ü ñ " * 60, "tie tie", "a\x85b c"]
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 4}", None, 0.5, "x") for i, t in enumerate(texts)]
    rows.append((None, texts[0], "de", "s1", 1, 0.1, None))
    rows.append((3, texts[3], "de", "s3", 1, 0.1, None))
    return rows


def awkward(spark, **options):
    return spark.createDataFrame(awkward_docs(**options), DOC_SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
