"""The pipeline's stages, each against a plain version of what it must keep."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ferrule.llm import queries, quality

from .helpers import DOC_SCHEMA, awkward_docs, no_docs, words
from .test_pairs_and_mix import brute_classes, brute_hits, brute_targets

corpus_pipeline = pytest.importorskip("corpus_pipeline")
STAGES = dict(corpus_pipeline.STAGES)
BENCH_SCHEMA = "item_id long, text string"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark that hold the awkward cases."""
    rnd = random.Random(8)
    rows = awkward_docs()
    junk = [(3000 + i, " ".join(rnd.choice(["BUY!!", "NOW!!", "cheap***", "win$$$"]) for _ in range(80)), "en", "s1", None, 0.0, "x") for i in range(40)]
    base = words(rows[20][1])
    rows += [*junk, (4000, "x " + " ".join(base[3:30]), "en", "s2", 5, 0.0, "x")]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOC_SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int(r[0] < 3000)) for r in rows if r[0] is not None] + [(None, 1), (7, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(base[3:25])), (2, None), (None, "--")], BENCH_SCHEMA).write.parquet(f"{folder}/benchmark.parquet")
    return folder


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_quality_stage(spark, sf):
    docs = docs_of(spark, sf)
    kept = STAGES["quality"](spark, docs, sf)
    assert kept.columns == docs.columns
    scored = quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
    want = sorted((tuple(r)[:-1] for r in scored if r["quality_score"] >= 0.3), key=repr)
    assert rows_of(kept) == want
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert not any(i in ids for i in range(3000, 3040)) and sum(i in ids for i in range(60)) >= 57


def test_near_duplicate_stage(spark, sf):
    docs = docs_of(spark, sf)
    kept = STAGES["near_duplicates"](spark, docs, sf)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # a class is named by its least id; those without any link, or without words, stay all
    classes = brute_classes(rows)
    alone = sum(n for (_, _, links), n in classes.items() if not links)
    named = {label for (_, label, links) in classes if links}
    got = kept.select("doc_id").collect()
    # the row without an id is a copy of document 0 and comes first of its class
    assert len(got) == alone + len(named) and (named - {0}) | {None} <= {r["doc_id"] for r in got}


def test_decontamination_stage(spark, sf):
    docs = docs_of(spark, sf)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs.collect()]
    want = [r for r in rows if not any(hit and 20 * hit >= n for _, n, hit, _ in brute_hits([r[:2]], bench))]
    assert len(want) < len(rows)
    assert rows_of(STAGES["decontamination"](spark, docs, sf)) == sorted(want, key=repr)


def test_mixing_stage(spark, sf):
    docs = docs_of(spark, sf)
    mixed = STAGES["mixing"](spark, docs, sf)
    assert mixed.columns == docs.columns
    before = {}
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(words(r["text"]))
        before.setdefault(r["doc_id"], []).append(words(r["text"]))
    want = brute_targets(dict(sizes), [3.0, 1.0, 2.0])
    got = Counter()
    for r in mixed.collect():
        own = words(r["text"])
        got[r["source"]] += len(own)
        assert own and any(Counter(own) <= Counter(b + b) for b in before[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    assert all(abs(got[s] - t) <= 3 * 128 for s, t in want.items())


def test_token_stage(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    docs = docs_of(spark, sf)
    got = STAGES["tokens"](spark, docs, sf).collect()
    crc = lambda text: zlib.crc32(np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter((r["doc_id"], crc(r["text"])) for r in docs.collect())
    ordered = sorted(got, key=lambda r: r["start"])
    assert ordered[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ordered, ordered[1:]))


def test_run_and_empty_tables(spark, sf, tmp_path):
    assert corpus_pipeline.run(spark, sf).count() > 20
    no_docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
