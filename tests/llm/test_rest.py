from __future__ import annotations

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import common, dac, exact_topk, queries, quality, storage, tokens, url_filter, warc

from .helpers import awkward, awkward_docs, no_docs


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "CHUNK", 64)
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, []), (1000, rows[7][1]), (1001, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in exact_topk.pivot_topk(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=5, block=3).collect()}
    fine = {i: np.floor(1024 * np.float32(v).astype(float)).astype(np.int64) for i, v in rows if v and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in fine:
        if q % 50 == 0:
            best = sorted((-int(fine[c] @ fine[q]), c) for c in fine if c != q)[:5]
            want |= {(q, r): (c, -s) for r, (s, c) in enumerate(best, 1)}
    assert got == want
    assert exact_topk.pivot_topk(df.where("vec_id < 0"), "vec_id", "embedding", F.lit(True)).count() == 0


def test_url_rules_and_model(spark):
    urls = ["https://A.Example.com/en/x?q", "https://www.example.com/en/", "http://example.com", "http://x.net/es/1#f", "http://y.net/frx", None, "no scheme", "http://spam-farm.example.org/en/1", "http://garden.example.org/en/1", "http://notexample.com/en/", "x://?y", "http://h?x://y/z"]
    pages = spark.createDataFrame([(i, u, "odd") for i, u in enumerate(urls)], "page_id long, url string, score string")
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, rules).collect()}
    assert [got[i]["rule"] for i in range(12)] == ["example.com/en/", "www.example.com/en/", None, "net/es/", None, None, None, None, None, "com/", None, None]
    assert (got[0]["host"], got[0]["path"], got[0]["verdict"]) == ("a.example.com", "/en/x", "block")
    assert (got[2]["host"], got[2]["path"]) == ("example.com", "") and (got[5]["host"], got[6]["path"]) == ("", "")
    assert got[7]["verdict"] == "block" and got[8]["verdict"] == "allow" and (got[11]["host"], got[11]["path"]) == ("h", "")
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def split_url(url):
    """(host, path) by plain string work."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    for c in "?#":
        rest = rest.split(c, 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def test_url_model_on_unseen_words():
    rows = [(*split_url(u), y) for u, y in url_filter.labelled_urls()]
    order = np.random.default_rng(0).permutation(len(rows))
    known, new = [rows[i] for i in order[: len(rows) * 3 // 4]], [rows[i] for i in order[len(rows) * 3 // 4 :]]
    w = url_filter.train(known)
    z = url_filter.logits(*url_filter.grams([h for h, _, _ in new], [p for _, p, _ in new]), len(new), w)
    y = np.array([label for _, _, label in new])
    assert (z[y == 1] >= 0).mean() >= 0.9 and (z[y == 0] < 0).mean() >= 0.65


def test_url_filter_over_the_pages_table(spark):
    """Rules against brute force for every row; the model on hosts whose names it never saw."""
    sf = "/root/testdata/sf0.01"
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op3_url_filter(spark, sf).collect()
    assert len(got) == len(urls)
    odd, plain = [], []
    for r in got:
        host, path = split_url(urls[r["page_id"]])
        fits = [(-len(rule), rule, v) for rule, v in rules for h, slash, p in [rule.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(slash + p)]
        want = min(fits)[1:] if fits else (None, r["verdict"])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *want)
        assert r["verdict"] in ("allow", "block")
        (odd if "-" in host else plain).append(r["score"] < 0.5)
    assert np.mean(plain) <= 0.1 and np.mean(odd) >= 0.9


def test_url_columns_that_clash(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", "mine", "kept")], "page_id long, url string, host string, note string")
    got = url_filter.filter_urls(pages, [("com/", "allow")], keep=("page_id", "host", "note")).collect()
    assert [r.asDict() for r in got][0] | {"score": 0} == {"page_id": 1, "note": "kept", "host": "a.com", "path": "/x", "rule": "com/", "verdict": "allow", "score": 0}


def test_quality(spark):
    rnd = random.Random(4)
    good = lambda: ". ".join(" ".join(rnd.choice(["the", "river", "runs", "past", "old", "mills", "and", "fields"]) for _ in range(12)) for _ in range(5))
    bad = lambda: " ".join(rnd.choice(["BUY!!", "NOW!!", "cheap***", "win$$$", "free%%%"]) for _ in range(60))
    rows = [(i, bad() if i % 5 == 0 else good()) for i in range(400)]
    extra = [(1000, None), (1001, ""), (None, "text"), (1002, "word " * 50_000)]
    docs = spark.createDataFrame([(*r, "odd") for r in rows + extra], "doc_id long, text string, quality_label string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(400)] + [(7, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= quality.CUT) == (i % 5 != 0) for i in held) >= 0.97 * len(held)
    assert len(got) == 404 and all(0 <= v <= 1 for v in got.values())
    none = quality.train(docs, labels.limit(0))
    assert {round(r["quality_score"], 6) for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_scores_against_loops_over_pairs(spark):
    """score() of whole texts, empty and long ones too: bias, weights and every pair of features, one by one."""
    rng = np.random.default_rng(5)
    model = {"b": -0.3, "w": rng.normal(0, 0.3, quality.SLOTS), "v": rng.normal(0, 0.2, (quality.SLOTS, quality.FACTORS))}
    texts = ["", None, "One two TWO!! 3 three", "Und " * 30, "é ü\nx  y", " ".join(f"w{i}" for i in range(120)), "a " * 500_000]
    docs = spark.createDataFrame([(i, t, 7.0) for i, t in enumerate(texts)], "doc_id long, text string, quality_score double").repartition(3)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model).collect()}
    w, v = model["w"].astype(np.float32).astype(float), model["v"].astype(np.float32).astype(float)
    for i, t in enumerate(texts):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        _, col, value = quality.features(raw, np.array([0, len(raw)]))
        z = model["b"]
        for a, x in zip(col, value):
            z += w[a] * x
        for j in range(len(col)):
            for k in range(j):
                z += float(v[col[j]] @ v[col[k]]) * value[j] * value[k]
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-5


def test_pair_sum_is_the_pair_sum():
    rng = np.random.default_rng(0)
    doc, col, value, v = np.repeat([0, 1], 5), np.tile(np.arange(5), 2), rng.normal(size=10), rng.normal(size=(5, 3))
    want = [sum(v[i] @ v[j] * value[5 * d + i] * value[5 * d + j] for i in range(5) for j in range(i)) for d in (0, 1)]
    assert np.allclose(quality.pair_sum(doc, col, value, v, 2)[0], want)


def strict_parse(folder):
    """Reads the archives by the format's own rules: version line, mandatory fields, lengths, unique record ids."""
    import glob
    import gzip
    import re

    ids = []
    for path in glob.glob(f"{folder}/*.warc.gz"):
        data, at, first = gzip.open(path).read(), 0, True
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            version, *lines = data[at:end].decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            assert version == "WARC/1.1" and len(fields) == len(lines)
            assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"]) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
            assert fields["WARC-Type"] == ("warcinfo" if first else fields["WARC-Type"]) and fields["Content-Type"]
            block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
            if not first:
                head, _, payload = block.partition(b"\r\n\r\n")
                assert head.startswith(b"HTTP/1.1 200 OK\r\n") and fields["WARC-Target-URI"]
                if fields["WARC-Type"] == "response":
                    assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
                else:
                    assert fields["WARC-Profile"] and fields["WARC-Refers-To"] and not payload
            at = end + 4 + len(block)
            assert data[at : at + 4] == b"\r\n\r\n"
            ids.append(fields["WARC-Record-ID"])
            at, first = at + 4, False
    assert len(ids) == len(set(ids)) and ids


@pytest.mark.parametrize("size", [1 << 20, 700])
def test_warc_round_trip(spark, size):
    rnd = random.Random(6)
    big = "<p>" + "é" * 700
    magic = "".join(chr(rnd.randrange(256)) for _ in range(3000)) + "\x1f\x8b\x08\x00"
    rows = [(1, "http://a/%20\r\nb", big, 1), (2, None, big, 1), (3, "u", "x" * 999, 1), (4, "u", "x" * 999, 1), (5, "u", None, 1), (6, "u", "", 1), (None, "n", big, 1), (7, "z", magic, 1), (8, "z", "y" * 100_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    folder = storage.make_folder(common.shared_path(spark, "test-warc"))
    assert warc.write(warc.with_types(pages), folder).agg(F.sum("records")).first()[0] == len(rows)
    got = {r["id"]: r for r in warc.read(spark, folder, range_bytes=size).collect()}
    assert len(got) == len(rows)
    for i, url, html, _ in rows:
        body = (html or "").encode()
        kind = "revisit" if i in (1, None) else "response"
        r = got[i]
        assert (r["url"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) == (url, kind, len(body), hashlib.sha1(body).hexdigest(), 2 if kind == "revisit" else None)
        assert bytes(r["payload"]) == (b"" if kind == "revisit" else body)
    strict_parse(folder.removeprefix("file://"))
    empty = storage.make_folder(common.shared_path(spark, "test-warc"))
    warc.write(warc.with_types(pages.limit(0)), empty).collect()
    assert warc.read(spark, empty).count() == 0


def test_reader_owns_each_member_once():
    records = [b"WARC/1.1\r\nWARC-Type: response\r\n\r\n" + bytes([i]) * (50 * i) for i in range(1, 40)]
    data = b"".join(b"junk\x1f\x8b\x08" * (i % 2) + warc.member(r) for i, r in enumerate(records))
    for step in (97, 1000, len(data)):
        found = [m for at in range(0, len(data), step) for m in warc.members(io.BytesIO(data), at, min(at + step, len(data)), len(data))]
        assert found == records


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 5000):
        ids = (rng.integers(0, 1 << 31, n) >> rng.integers(0, 31, n)).astype(np.uint32)
        data, entry = dac.encode(ids)
        assert (dac.decode(data, entry) == ids).all()
        assert all(dac.get(lambda a, k: data[a : a + k], entry, i) == ids[i] for i in range(0, n, 37))


def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    odd = [(200 + i, s, "en", "s", None, 0.0, "") for i, s in enumerate(["Don't it's we'LL x'sy", "a<|endoftext|>b c", "É́ é  \t\r\nb 12a3", "'s a's's x' (it's) it's.", "ΣΑΣ. ﬁ ½ İstanbul", "x　y z", "(word), [Word]! _w_", "\x1cend", "``q''"])]
    rows = [r for r in awkward_docs() if r[0] is not None][:-1] + odd
    from .helpers import DOC_SCHEMA

    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(4)
    monkeypatch.setattr(tokens, "SEGMENT", 700)
    folder = storage.make_folder(common.shared_path(spark, "test-tokens"))
    manifest = tokens.write(docs, folder, path, 2).cache()
    got = sorted(tuple(r) for r in tokens.documents_of(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    want, start, every = [], 0, []
    for r in sorted(rows, key=lambda r: r[0]):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        every += ids
    assert got == want
    first = min(manifest.collect(), key=lambda r: r["shard"])
    assert [tokens.token(first["path"], first["bytes"], i) for i in range(0, first["n_tokens"], 101)] == every[: first["n_tokens"]][::101]
    manifest.unpersist()
    empty = storage.make_folder(common.shared_path(spark, "test-tokens"))
    assert tokens.documents_of(spark, tokens.write(no_docs(spark), empty, path, 2)).count() == 0


def test_token_files_with_null_and_repeated_ids(spark):
    docs = awkward(spark)
    folder = storage.make_folder(common.shared_path(spark, "test-tokens"))
    got = tokens.documents_of(spark, tokens.write(docs, folder, queries.tokenizer_path(), 2)).orderBy("start").collect()
    assert len(got) == docs.count() and got[0]["doc_id"] is None
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
