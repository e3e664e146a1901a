from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import filter_audit, line_dedup, phrases

from .helpers import DOC_SCHEMA, awkward, awkward_docs, no_docs, words

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lined_docs():
    """awkward_docs with lines that many documents share, in cases, blanks and repeats."""
    rnd = random.Random(5)
    rows = awkward_docs()
    lines = ["A Line That Many Documents Hold", "  a line that many documents hold\t", "ÄÖ with CAPITALS of two alphabets", "short", "", "in two documents only, this line"]
    out = []
    for k, r in enumerate(rows):
        text = r[1]
        if text is not None and k % 3 == 0:
            text = "\n".join([text, *(rnd.choice(lines[:5]) for _ in range(4)), "a\nb\x85c\r"])
        if k in (10, 11):
            text = (text or "") + "\n" + lines[5]
        out.append((r[0], text, *r[2:]))
    out += [(200, "\n".join([lines[0]] * 3), "en", "s1", 1, 0.5, "x"), (201, "\n\n", "en", "s1", 1, 0.5, "x"), (202, "x" * 2_000_000 + "\n" + lines[1], "en", "s1", 1, 0.5, "x")]
    return out


def dedup_brute(rows, least=20, docs=3):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders[key(line)].add(-1 if r[0] is None else r[0])
    gone = {k: max(v) for k, v in holders.items() if len(k) >= least and len(v) >= docs}
    out = []
    for r in rows:
        lines, me = (r[1] or "").split("\n"), -1 if r[0] is None else r[0]
        kept = [x for x in lines if gone.get(key(x), me) == me]
        out.append((me, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines_against_brute_force(spark):
    rows = lined_docs()
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(7)
    got = line_dedup.remove(docs).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got) == dedup_brute(rows)
    assert sum(r["n_dropped"] for r in got) > 20 and {"a b", "score", "lang"} <= set(got[0].asDict())


def test_lines_by_shuffled_joins(spark, monkeypatch):
    from ferrule.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    rows = lined_docs()
    got = line_dedup.remove(spark.createDataFrame(rows, DOC_SCHEMA), 10, 2).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got) == dedup_brute(rows, 10, 2)


def test_lines_columns_that_clash_and_no_rows(spark):
    docs = spark.createDataFrame([(i, "a line of twenty characters\nx", "k", 7) for i in range(3)], "doc_id long, text string, kept string, n_lines int")
    got = {r["doc_id"]: r for r in line_dedup.remove(docs).collect()}
    assert [got[i]["kept"] for i in range(3)] == ["x", "x", "a line of twenty characters\nx"] and got[0]["n_lines"] == 2
    named = spark.createDataFrame([(1, "t", "p", "l", 3)], "doc_id long, text string, pos string, line string, h1 int")
    assert line_dedup.remove(named).first()["line"] == "l"
    assert line_dedup.remove(no_docs(spark)).count() == 0


def phrase_brute(rows, least, longest, top, cover=100):
    f, total = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), lang, a, counts[p[:k]], counts[p[k:]], total[lang], score))
        out += [(r[3], i + 1, r[2].decode(), *r[4:]) for i, r in enumerate(sorted(rows)[:top])]
    return sorted(out)


def spoken_docs():
    rnd = random.Random(8)
    set_phrases = ["In the Middle of", "the middle of the night", "ça va bien", "x \t y\tz", "a a a a a a", "nul\0 byte\x85x"]
    rows = []
    for i in range(120):
        parts = [rnd.choice(set_phrases) if rnd.random() < 0.4 else f"w{int(30 * rnd.random() ** 2)}" for _ in range(rnd.randint(0, 60))]
        rows.append((i, "".join(p + rnd.choice([" ", " ", " ", ". ", "\n", "  ", "\t"]) for p in parts), rnd.choice(["en", "en", "fr", None, "und"]), "s", 1, 0.5, "x"))
    rows += [(None, None, None, None, None, None, None), (5, "", "xx", "s", 1, 0.5, "x"), (5, rows[4][1], rows[4][2], "s", 1, 0.5, "x"), (500, "of the night " * 50_000, "en", "s", 1, 0.5, "x")]
    return rows


@pytest.mark.parametrize(("least", "longest", "top", "cover"), [(5, 5, 2000, 100), (12, 5, 7, 80), (3, 2, 2000, 100), (4, 3, 50, 100)])
def test_phrases_against_brute_force(spark, least, longest, top, cover):
    rows = spoken_docs()
    docs = spark.createDataFrame(rows, DOC_SCHEMA).withColumnRenamed("score", "n").withColumnRenamed("source", "word").repartition(3)
    got = phrases.mine(docs, least, longest, top, cover).collect()
    assert sorted(tuple(r) for r in got) == phrase_brute(rows, least, longest, top, cover)
    assert len(got) > 10


def test_phrases_in_small_chunks(spark, monkeypatch):
    """Prefixes divided over many chunks, stretches and flushes give the same counts."""
    for name in ("CHUNK_ROWS", "PARTITION_ROWS", "KEPT"):
        monkeypatch.setattr(phrases, name, 40)
    monkeypatch.setattr(phrases, "STRETCH", 64)
    rows = spoken_docs()[:-1]
    got = phrases.mine(spark.createDataFrame(rows, DOC_SCHEMA).repartition(4), 5).collect()
    assert sorted(tuple(r) for r in got) == phrase_brute(rows, 5, 5, 2000)


def test_phrases_exact_beyond_64_bits(spark):
    every = spark.createDataFrame([([1], 3 * 10**15), ([2], 10**15 + 7), ([1, 2], 10**15)], "words array<long>, n long")
    heads = spark.createDataFrame([(1, "en", 9 * 10**15)], "head long, lang string, total long")
    got = phrases.score_cuts(every.where("size(words) > 1"), every, heads).first()
    assert int(got["score"]) == 1000 * 10**15 * 9 * 10**15 // (3 * 10**15 * (10**15 + 7))


def test_words_that_share_a_hash_take_another_seed(spark, monkeypatch):
    real = phrases.word_hash
    monkeypatch.setattr(phrases, "word_hash", lambda seed: F.lit(7).cast("long") if seed == 0 else real(seed))
    docs = spark.createDataFrame([(1, "x y " * 6, "en")], "doc_id long, text string, lang string")
    words, _, seed = phrases.frequent_words(docs, 5)
    assert seed == 1 and words.count() == 2


def test_hashes_of_tasks_and_of_columns_agree(spark):
    rows = [(lang, w) for lang in ("en", "zh", "") for w in ("a", "é", "x" * 100, "nul\0")]
    df = spark.createDataFrame([(lang, bytearray(w.encode())) for lang, w in rows], "lang string, word binary")
    for seed in (0, 3):
        got = [r["h"] for r in df.select(phrases.word_hash(seed).alias("h")).collect()]
        assert got == [np.array([phrases.Hashes(lang, seed)[w.encode()]], np.uint64).view(np.int64)[0] for lang, w in rows]


def test_no_phrases(spark):
    assert phrases.mine(no_docs(spark)).count() == 0
    assert phrases.mine(awkward(spark), 10**6).count() == 0


def audit_brute(rows, labels):
    first, out = {}, []
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(r[0], first.get(r[1] or "", r[0]))
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    parts = defaultdict(list)
    for r in rows:
        t = r[1] or ""
        w = words(t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": r[0] is not None and first[t] < r[0],
        }
        parts[r[3] or ""].append(({c for c, x in fails.items() if x}, r[0] in good, r[0] in toxic))
    for part, docs in parts.items():
        rows, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            for i, c in enumerate(order):
                earlier = set(order[:i])
                here = [d for d in docs if c in d[0] and not d[0] & earlier]
                kept = sum(not d[0] & (earlier | {c}) for d in docs)
                redundant = sum(c in d[0] and bool(d[0] & earlier) for d in docs)
                shapley[c] += len(here)
                rows.append([part, "".join(order), i + 1, kept, len(here), redundant, sum(d[0] == {c} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here), c])
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_audit_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(filter_audit, "BLOCK_ROWS", block)
    rows = awkward_docs() + [(900, "SHOUT # " * 60, "en", None, 1, 0.5, "x"), (901, "AB cd", "en", "", 1, 0.5, "x"), (902, "a%" * 1_000_000, "en", "s1", 1, 0.5, "x")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(2, 1, None), (None, 1, 1), (5, None, 1), (5, 0, 0)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).withColumn("good", F.lit("x")).repartition(3)
    flags = filter_audit.quality_flags(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = filter_audit.audit(flags, list("ABCDE"), ["good", "toxic"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(tuple(r) for r in got.collect()) == audit_brute(rows, labels)


def test_audit_of_any_columns(spark):
    """Boolean columns by name, nulls false, a part of its own name; empty tables have no parts."""
    flags = spark.createDataFrame([("p", True, None, True), ("p", True, True, False), (None, False, True, True)], "part string, `a b` boolean, y boolean, good boolean")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audit(flags, ["a b", "y"], ["good"]).collect()}
    assert len(got) == 8 and got["p", "ya b", 1]["removed"] == 1 and got["p", "ya b", 2]["good_lost"] == 1 and got["", "a by", 2]["kept"] == 0
    assert filter_audit.audit(flags.limit(0), ["a b", "y"], ["good"]).count() == 0
    empty = filter_audit.quality_flags(no_docs(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert filter_audit.audit(empty, list("ABCDE"), []).count() == 0
    with pytest.raises(ValueError):
        filter_audit.audit(flags, [], [])


def test_block_counts_by_hand():
    codes = np.array([1, 0, 1, 1])
    counts = filter_audit.block_counts(codes, 2, [np.array([1, 0, 0, 1], bool), np.array([1, 1, 0, 0], bool)], [np.array([0, 1, 1, 1], bool)])
    assert counts.tolist() == [[[1, 1], [1, 1], [0, 0], [0, 0]], [[3, 2], [1, 1], [2, 2], [1, 1]]]


def test_digests_of_whole_texts(spark):
    """The thin query's digest is that of the kept text."""
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {r["kept"] for r in line_dedup.remove(docs).collect()} == {""} and hashlib.sha256(b"").hexdigest().startswith("e3b0")
