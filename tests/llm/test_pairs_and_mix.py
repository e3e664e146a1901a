from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from ferrule.llm import common, decontaminate, jaccard_join, mixing
from ferrule.llm.components import components

from .helpers import awkward, awkward_docs, no_docs, prose, words


def shingles(text, width=5):
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))) if w else frozenset()


def brute_classes(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    linked = defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= threshold * len(a | b):
                linked[i].add(j)
                linked[j].add(i)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in linked[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        label[i] = min(ids) if ids else None
    return Counter((rows[i][0], label[i], len(linked[i])) for i in range(len(rows)))


def test_join_against_brute_force(spark):
    rows = [(r[0], r[1]) for r in awkward_docs()]
    got = jaccard_join.join(awkward(spark)).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute_classes(rows)


def test_large_group_of_near_copies(spark, monkeypatch):
    import random

    rnd = random.Random(5)
    base = prose(rnd, 200, 5000).split(" ")
    rows = []
    for i in range(130):
        w = list(base)
        w[rnd.randrange(200)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(rnd, 100, 9000)) for i in range(30)] + [(2000, rows[0][1])]
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute_classes(rows)


def jobs_of(spark, action):
    """(jobs that an action starts, its result)."""
    group, before = uuid.uuid4().hex, spark.sparkContext.getLocalProperty("spark.jobGroup.id")
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", before)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out


def test_what_is_written_is_counted_on_the_way(spark):
    df = spark.range(100).select("id", F.expr("if(id % 2 = 0, null, repeat('x', 10))").alias("t")).repartition(3)
    want = common.bytes_of(df)
    alone, _ = jobs_of(spark, lambda: common.cut(df))
    jobs, (out, size) = jobs_of(spark, lambda: common.cut_measured(df))
    assert jobs == alone and out.count() == 100 and size == want
    assert common.cut_measured(df.where("id < 0"))[1] == 0
    assert common.cut_counted(df, odd=F.count_if(F.col("t").isNotNull()), none=F.sum(F.lit(None).cast("long")))[1] == {"odd": 50, "none": 0}


def test_components_look_for_changes_without_jobs_of_their_own(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40) if k != 20] + [(7, 7)], "a long, b long").coalesce(2)
    # jobs of cut() go to groups of their own, what components() starts besides stays in its group
    monkeypatch.setattr(common, "cut", lambda df, cut=common.cut: jobs_of(spark, lambda: cut(df))[1])
    jobs, label = jobs_of(spark, lambda: components(edges))
    assert not jobs
    assert {r["node"]: r["label"] for r in label.collect()} == {k: 0 if k <= 20 else 21 for k in range(41)}


def tasks_of(spark, action):
    """(tasks that an action starts, its result)."""
    group, before = uuid.uuid4().hex, spark.sparkContext.getLocalProperty("spark.jobGroup.id")
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", before)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    seen = spark.sparkContext.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup(group) for s in seen.getJobInfo(j).stageIds}
    return sum(i.numCompletedTasks for i in map(seen.getStageInfo, stages) if i), out


@pytest.fixture
def many_partitions(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "53")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield 53
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("limit", [1 << 23, 0])
def test_components_of_few_edges_take_few_tasks(spark, many_partitions, monkeypatch, limit):
    monkeypatch.setattr("ferrule.llm.components.LABEL_BYTES", limit)
    edges = spark.createDataFrame([(k, k + 1) for k in range(40) if k != 20] + [(7, 7)], "a long, b long").coalesce(2)
    tasks, label = tasks_of(spark, lambda: components(edges))
    assert {r["node"]: r["label"] for r in label.collect()} == {k: 0 if k <= 20 else 21 for k in range(41)}
    assert tasks < 2 * many_partitions or not limit, tasks


def test_small_tables_are_read_by_few_tasks(spark, many_partitions, monkeypatch):
    df = spark.range(1000).repartition(many_partitions, "id")
    out, size, seen = common.cut_measured(df, even=F.count_if(F.col("id") % 2 == 0))
    assert size == 1000 * 24 and seen == {"even": 500} and out.rdd.getNumPartitions() == 1
    monkeypatch.setattr(common, "PACK_BYTES", 1000)
    out, _ = common.cut_measured(df)
    assert out.rdd.getNumPartitions() == 24 and out.distinct().count() == 1000
    monkeypatch.setattr(common, "PACK_BYTES", 1)
    assert common.cut_measured(df)[0].rdd.getNumPartitions() == many_partitions


def test_recall_over_the_documents_table(spark):
    """Links and classes of a whole table, found by an inverted index over shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = [shingles(t) for _, t in rows]
    holders, shared = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for group in holders.values():
        shared.update((a, b) for k, a in enumerate(group) for b in group[:k])
    links = {(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)}
    assert any(shared[p] < 0.9 * len(sets[p[0]] | sets[p[1]]) for p in links)
    count = Counter(x for p in links for x in p)
    got = {r["doc_id"]: r for r in jaccard_join.join(docs).collect()}
    assert {rows[i][0]: count[i] for i in range(len(rows))} == {i: r["n_links"] for i, r in got.items()}
    assert all(got[rows[a][0]]["class_id"] == got[rows[b][0]]["class_id"] for a, b in links)


def test_join_below_the_usual_threshold(spark):
    a = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:62])), (3, " ".join(a[:40]))]
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.6).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_keep_one_keeps_columns_and_one_row_a_class(spark):
    docs = awkward(spark)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    classes = jaccard_join.join(docs).where("n_links > 0").select("class_id").distinct().count()
    alone = jaccard_join.join(docs).where("n_links = 0").count()
    assert kept.count() == classes + alone


def test_recall_sets_the_runs():
    assert jaccard_join.runs_for(0.9) < jaccard_join.runs_for(0.999)


def test_join_of_nothing(spark):
    assert jaccard_join.join(no_docs(spark)).count() == 0


def brute_targets(sizes, weights, share=1.5, repeat=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(repeat * sizes[s] for s in capped)
        goal = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if goal[s] > repeat * sizes[s]}
        if not over:
            return {**{s: repeat * sizes[s] for s in capped}, **goal}
        capped |= over


def test_mix(spark):
    docs = awkward(spark)
    sizes = Counter()
    for r in awkward_docs():
        sizes[r[3]] += len(words(r[1]))
    want = brute_targets(dict(sizes), [3.0, 1.0, 2.0])
    mixed, plan = mixing.mix(docs, [3.0, 1.0, 2.0], block=8)
    got = mixed.collect()
    assert len(got) == docs.count()
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert r["taken"] <= 2 * r["size"] and r["taken"] == sum(p["length"] * p["times"] for p in r["pieces"] or [])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 24
    again = mixing.mix(docs.repartition(7), [3.0, 1.0, 2.0], block=8)[0].collect()
    key = lambda r: (r["doc_id"] or -1, r["key"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    slots = plan.collect()
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots)
    assert sorted(r["slot"] for r in slots) == list(range(len(slots)))
    uses = Counter((r["source"], r["block"]) for r in slots)
    assert max(uses.values()) <= 2 and all(0 <= b < -(-sizes[s] // 8) for s, b in uses)
    texts = mixing.mixed_texts(docs, mixed).collect()
    assert Counter((r["doc_id"], len(words(r["text"]))) for r in texts) == Counter((r["doc_id"], r["taken"]) for r in got if r["taken"])


def swap_or_not(x, n, seed):
    """mixing.permute() of one number, with Python's integers."""
    h = lambda *parts: xxh(parts) % n

    def xxh(parts):
        state = 42
        for p in parts:
            raw = p.encode() if isinstance(p, str) else p[0].to_bytes(p[1], "little", signed=True)
            state = xxhash.xxh64_intdigest(raw, state)
        return state - (state >> 63 << 64)

    for r in range(1, mixing.ROUNDS + 1):
        other = (h(seed, (r, 4), "key") - x) % n
        x = x if xxh((seed, (r, 4), (max(x, other), 8))) % 2 == 0 else other
    return x


def test_taken_against_a_plain_mix(spark):
    """The whole mix in plain Python: order of documents, slots, draws and the words that they give."""
    block, weights, rows = 8, [3.0, 1.0, 2.0], awkward_docs()
    mixed, _ = mixing.mix(awkward(spark).repartition(5), weights, block=block)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["key"], r["taken"]) for r in mixed.collect())
    keys = {(r["doc_id"], r["text"]): r["k"] for r in awkward(spark).select("doc_id", "text", common.row_key(awkward(spark)).alias("k")).collect()}
    run_of = {k: r["run"] for r in spark.createDataFrame([(k,) for k in keys.values()], "key long").select("key", F.pmod(F.xxhash64("key"), F.lit(64)).alias("run")).collect() for k in [r["key"]]}
    docs = {}
    for r in rows:
        k = keys[r[0], r[1]]
        docs.setdefault(r[3], []).append((run_of[k], (r[0] is not None, r[0] or 0), k, len(words(r[1]))))
    sizes = {s: sum(d[3] for d in own) for s, own in docs.items()}
    target = brute_targets(sizes, weights)
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    blocks = {s: -(-sizes[s] // block) for s in names}
    draws = {s: round(target[s] * blocks[s] / sizes[s]) if sizes[s] else 0 for s in names}
    total, before, use = sum(draws.values()), 0, Counter()
    for s in names:
        slots = sorted(swap_or_not(before + d, total, (11, 4)) for d in range(draws[s]))
        before += draws[s]
        for j, _ in enumerate(slots):  # in the order of their slots
            lap, x = divmod(j, blocks[s])
            state = 42
            for raw in ((11).to_bytes(4, "little"), (s if s is not None else "\0null").encode(), lap.to_bytes(8, "little")):
                state = xxhash.xxh64_intdigest(raw, state)
            use[s, swap_or_not(x, blocks[s], (state - (state >> 63 << 64), 8))] += 1
    want = []
    for s, own in docs.items():
        at = 0
        for _, (known, doc), k, n in sorted(own):
            want.append((doc if known else -1, k, sum(use[s, (at + i) // block] for i in range(n))))
            at += n
    assert got == sorted(want)


def test_identical_rows_take_their_own_words(spark):
    rows = [(7, "a b c d e f g h i j k l", None, "s")] * 3 + [(i, "q r s t u", None, "s") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixed, _ = mixing.mix(docs, [1.0], share=0.6, block=8)
    got = Counter((r["doc_id"], r["taken"]) for r in mixed.collect() if r["taken"])
    assert Counter((r["doc_id"], len(words(r["text"]))) for r in mixing.mixed_texts(docs, mixed).collect()) == got


def test_shards_hold_the_words_that_the_mix_takes(spark):
    docs = awkward(spark).withColumnRenamed("score", "taken").withColumnRenamed("a b", "pieces")
    mixed, plan = mixing.mix(docs, [3.0, 1.0, 2.0], block=8)
    shards = mixing.mixed_shards(docs, mixed, plan).collect()
    slots = plan.collect()
    assert sorted((r["shard"], r["slot"], r["source"] or "") for r in shards) == sorted((r["shard"], r["slot"], r["source"] or "") for r in slots)
    out, want = {}, {}
    for r in shards:
        assert r["n_words"] == len(words(r["text"])) <= 8
        out.setdefault(r["source"], Counter()).update(words(r["text"]))
    for r in mixing.mixed_texts(docs, mixed).collect():  # columns named taken and pieces stay
        assert r["taken"] in (0.5, 0.1)
        want.setdefault(r["source"], Counter()).update(words(r["text"]))
    assert out == want
    # the words of a block are those of its documents, in order
    once = {r["text"] for r in shards if r["n_words"] == 8}
    texts = [" ".join(words(r[1])) for r in awkward_docs()]
    assert sum(any(t in x for x in texts) for t in once) > 0.8 * len(once)


def test_steps_that_keep_rows_keep_columns_of_any_name(spark):
    """Names that the operators use inside come back as they were."""
    names = ["taken", "key", "items", "hits", "n_words", "label", "class_id", "row"]
    docs = awkward(spark).withColumns({n: F.lit(n) for n in names})
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    mixed, _ = mixing.mix(docs, [1.0])
    for out in (jaccard_join.keep_one(docs), decontaminate.remove_documents(docs, bench), decontaminate.remove_spans(docs, bench), mixing.mixed_texts(docs, mixed)):
        assert out.columns == docs.columns and all(out.select(names).distinct().first()[i] == n for i, n in enumerate(names))


def test_shard_counts_vary_like_draws(spark):
    docs = spark.createDataFrame([(i, "w " * 64, None, f"s{i % 3}") for i in range(1800)], "doc_id long, text string, lang string, source string")
    _, plan = mixing.mix(docs, [1.0], share=1.0, block=8)
    counts = [r["count"] for r in plan.groupBy("shard", "source").count().where("shard < 3").collect()]
    mean = sum(counts) / len(counts)
    assert 0 < max(counts) - min(counts) < 0.25 * mean


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 1000):
        rows = spark.range(n).select(mixing.permute(F.col("id"), F.lit(n), 5).alias("p")).collect()
        assert sorted(r["p"] for r in rows) == list(range(n))


def test_mix_of_nothing(spark):
    mixed, plan = mixing.mix(no_docs(spark), [3.0, 1.0, 2.0])
    assert mixed.count() == plan.count() == 0


def brute_hits(docs, bench, width=13):
    import re

    norm = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    windows = defaultdict(set)
    for item, text in bench:
        w = norm(text)
        n = min(len(w), width)
        for i in range(len(w) - n + 1) if w else ():
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for doc_id, text in docs:
        w, hit, items = norm(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found is not None:
                    hit.update(range(i, i + n))
                    items |= found
        out.append((doc_id, len(w), len(hit), tuple(sorted(str(x) for x in items if x is not None))))
    return Counter(out)


@pytest.mark.parametrize("broadcast", [1, 10**6])
def test_decontamination_against_brute_force(spark, broadcast):
    rows = [(r[0], r[1]) for r in awkward_docs()]
    base = words(rows[20][1])
    bench = [(1, " ".join(base[3:25]).upper()), (2, "Two, WORDS!"), (3, None), (4, "--"), (None, " ".join(words(rows[22][1])[:13])), (5, "one"), (6, " ".join(base[10:30])), (6, " ".join(base[10:30])), (7, "é ü ñ é ü ñ é")]
    rows += [(500, "x " + " | ".join(base[3:16]) + " y"), (501, " ".join(base[3:15]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.find(docs, spark.createDataFrame(bench, "item_id long, text string"), broadcast_windows=broadcast).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == brute_hits(rows, bench)


def test_decontamination_removes(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "q r s"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "C d")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.remove_documents(docs, bench).collect()) == [2, 3]
    assert {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()} == {1: "a b e f", 2: "q r s", 3: None}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_documents(docs, none).count() == 3
    assert decontaminate.find(no_docs(spark), bench).count() == 0
