from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ferrule.llm import bwt, bwt_dedup, substring_dedup
from ferrule.llm import superkmer as sk

from .helpers import awkward, awkward_docs, no_docs, words


@pytest.mark.parametrize("width", [35, 8])
def test_words_against_brute_force(spark, width):
    docs = [w for w in (words(r[1]) for r in awkward_docs())]
    count = Counter(tuple(d[i : i + width]) for d in docs for i in range(len(d) - width + 1))
    want = []
    for d in docs:
        gone = {p for i in range(len(d) - width + 1) if count[tuple(d[i : i + width])] > 1 for p in range(i, i + width)}
        want.append((len(d), len(gone), " ".join(w for i, w in enumerate(d) if i not in gone)))
    got = substring_dedup.remove(awkward(spark), width).collect()
    assert sorted((r["n_words"], r["n_removed"], r["kept"]) for r in got) == sorted(want)
    assert {"a b", "score", "lang"} <= set(got[0].asDict())


def byte_brute(rows, width):
    seen, out = set(), []
    for doc_id, text in rows:
        b = (text or "").encode()
        mask = [False] * len(b)
        for i in range(len(b) - width + 1):
            s = b[i : i + width]
            if s in seen:
                mask[i : i + width] = [True] * width
            seen.add(s)
        spans = sum(m and (i == 0 or not mask[i - 1]) for i, m in enumerate(mask))
        out.append((doc_id, len(b), sum(mask), spans, bytes(x for x, m in zip(b, mask) if not m)))
    return out


def test_bytes_against_brute_force(spark):
    rows = [(r[0], r[1]) for r in awkward_docs() if r[0] is not None][:-1]
    want = byte_brute(rows, 100)
    docs = awkward(spark).where("doc_id is not null and lang = 'en'").repartition(5)
    got = bwt_dedup.remove(docs).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want


def test_bytes_of_repeated_rows_and_null_ids(spark):
    text = "".join(chr(97 + (i * i) % 23) for i in range(300))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in bwt_dedup.remove(docs).collect())
    assert got[0] == (-1, byte_brute([(0, text)], 100)[0][2]) and [x[1] for x in got[1:]] == [300, 300]


def test_empty_tables(spark):
    assert bwt_dedup.remove(no_docs(spark)).count() == substring_dedup.remove(no_docs(spark)).count() == 0


def test_merged_transforms_find_equal_prefixes():
    rnd = random.Random(1)
    for _ in range(40):
        texts = [bytes(rnd.choice(b"ab\0\xff"[: rnd.randint(1, 4)]) for _ in range(rnd.randint(0, 40))) for _ in range(rnd.randint(1, 12))]
        depth, shards = rnd.randint(1, 12), [[] for _ in range(rnd.randint(1, 4))]
        for t in texts:
            rnd.choice(shards).append(t)
        places = [(t, i) for s in shards for t in s for i in range(len(t) + 1)]
        symbols = [np.array([x for t in s for x in [*(b + 1 for b in t), 0]], np.uint16) for s in shards]
        got: dict = {}
        for place, group in zip(*bwt.equal_prefixes(symbols, depth)):
            got.setdefault(int(group), []).append(int(place))
        want: dict = {}
        for k, (t, i) in enumerate(places):
            if len(t) - i >= depth:
                want.setdefault(t[i : i + depth], []).append(k)
        assert sorted(sorted(v) for v in got.values()) == sorted(v for v in want.values() if len(v) > 1)


def test_hot_strings_across_slices(spark, monkeypatch):
    from ferrule.llm import bytewise

    rows = [(i, "shared " * 3 + hashlib.md5(b"x").hexdigest() * 8 + f" own {hashlib.md5(str(i).encode()).hexdigest() * 5}") for i in range(60)]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(bytewise, "SLICE_BYTES", 1500)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in bwt_dedup.remove(docs).collect())
    assert got == byte_brute(rows, 100)


def test_columns_with_clashing_names(spark):
    rows = [(i, "a shared passage of many words " * 9 + f"end {i}", "k", "x", 7) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, kept string, n_removed int")
    for op in (substring_dedup, bwt_dedup):
        got = op.remove(docs).collect()
        assert {r["key"] for r in got} == {"k"} and len(got[0]) == len(set(got[0].asDict())) and sum(r["n_removed"] > 0 for r in got) >= 2


def test_spans_join_by_shuffle(spark, monkeypatch):
    from ferrule.llm import common

    docs = awkward(spark)
    want = sorted((r["doc_id"] or -1, r["n_removed"], r["kept"]) for r in substring_dedup.remove(docs).collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted((r["doc_id"] or -1, r["n_removed"], r["kept"]) for r in substring_dedup.remove(docs).collect()) == want


def common_minimiser(module, seed=2, docs=150):
    """Different texts that all hold one phrase often, whose words, or bytes, have the least hash."""
    import ferrule.llm.bytewise as bw

    rnd = random.Random(seed)
    phrases = [" ".join(f"{rnd.choice('bcdfg')}{rnd.randint(10, 99)}" for _ in range(5)) for _ in range(4000)]

    def least(phrase):
        if module is bwt_dedup:
            return int(bwt_dedup._mers(np.frombuffer(phrase.encode(), np.uint8), sk.NONE).min())
        text, at, stop, _ = substring_dedup._words(np.frombuffer(phrase.encode(), np.uint8), np.array([0, len(phrase)]))
        return int(bw.span_hash(bw.span_hash(text, at, stop), np.array([0]), np.array([5]))[0])

    best = min(phrases, key=least)
    return [" ".join(f"w{rnd.randint(0, 10**9)}" if i % 12 else best for i in range(200)) for _ in range(docs)]


@pytest.mark.parametrize("module", [substring_dedup, bwt_dedup])
def test_a_minimiser_of_all_documents_is_no_bucket(spark, monkeypatch, module):
    """Its windows go to the buckets of other k-mers, with the same result."""
    texts = common_minimiser(module)
    texts[9] = texts[4][300:] + texts[9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    width = module.WIDTH
    monkeypatch.setattr(sk, "SAMPLE", 1)
    monkeypatch.setattr(sk, "HOT_BYTES", 30_000)
    hot = sk.frequent(docs, module.strings(width))

    def largest(frequent):
        blobs = module.ship(docs, width, 64, frequent).where("blob is not null").collect()
        size = Counter()
        for r in blobs:
            size[r["bucket"]] += len(sk.unpack(r["blob"], module.NAMES)["text"])
        return max(size.values()) / (sum(size.values()) / 64)

    before, after = largest(sk.NONE), largest(hot)
    assert len(hot) and after < 6 and before > 2 * after
    plain = {r["doc_id"]: r["n_removed"] for r in module.remove(docs).collect()}
    monkeypatch.setattr(sk, "HOT_BYTES", 1 << 40)
    assert {r["doc_id"]: r["n_removed"] for r in module.remove(docs).collect()} == plain and plain[9] > 0


def test_strings_remembered_up_to_a_bound(spark, monkeypatch):
    monkeypatch.setattr(sk, "HOT_STRINGS", 2)
    docs = awkward(spark).where("doc_id is not null and lang = 'en'").coalesce(1)
    rows = [(r[0], r[1]) for r in awkward_docs() if r[0] is not None][:-1]
    got = bwt_dedup.remove(docs).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == byte_brute(rows, 100)
    count = Counter(tuple(d[i : i + 35]) for d in (words(t) for _, t in rows) for i in range(len(d) - 34))
    gone = sum(len({p for i in range(len(d) - 34) if count[tuple(d[i : i + 35])] > 1 for p in range(i, i + 35)}) for d in (words(t) for _, t in rows))
    assert sum(r["n_removed"] for r in substring_dedup.remove(docs).collect()) == gone


def test_very_long_texts_and_clashing_names(spark):
    """Two texts of 2 MB that share a passage of 1 MB; columns named like the result's are replaced."""
    rnd = random.Random(4)
    part = lambda: " ".join(str(rnd.randint(0, 10**9)) for _ in range(100_000))
    shared, a, b = part(), part(), part()
    docs = spark.createDataFrame([(1, f"{a} {shared}", "k", 1), (2, f"{shared} {b}", "k", 1), (None, None, "k", 1)], "doc_id long, text string, kept string, n_words int")
    got = {r["doc_id"]: r for r in substring_dedup.remove(docs).collect()}
    assert [got[i]["n_removed"] for i in (1, 2)] == [100_000] * 2 and got[1]["kept"] == a and got[2]["n_words"] == 200_000 and got[None]["kept"] == ""
    got = {r["doc_id"]: r for r in bwt_dedup.remove(docs.withColumnRenamed("n_words", "n_spans")).collect()}
    assert got[1]["n_removed"] == 0 and bytes(got[2]["kept"]) == b"" + f" {b}".encode()[0 if got[2]["n_removed"] == len(shared.encode()) else 1 :] and got[2]["n_spans"] == 1
