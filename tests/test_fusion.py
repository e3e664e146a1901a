"""Embedding store, semantic groups and joint sample clusters against loops over plain Python values."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.functions import text as tx
from ferrule.operators import embed, extract, fusion, vector
from ferrule.session import shared_path


def test_second_run_embeds_nothing(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def make():
        inner = embed.hashed_grams(64)

        def encode(texts):
            with open(seen, "a") as f:
                f.write("".join(t + "\n" for t in texts))
            return inner(texts)

        return encode

    store = shared_path(spark, "store")
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "ä")], "id long, text string")
    first, n = embed.embed(rows, store, make, "m")
    assert n == 3 and sorted(open(seen).read().split("\n")) == ["", "", "a b", "ä"]
    vectors = {r["id"]: r["vector"] for r in first.collect()}
    assert vectors[3] is None and vectors[1] == vectors[2] and abs(np.linalg.norm(vectors[5]) - 1) < 1e-5
    again, n = embed.embed(rows.unionByName(spark.createDataFrame([(6, "new")], "id long, text string")), store, make, "m")
    assert n == 1 and open(seen).read().count("\n") == 4 and again.count() == 6
    _, n = embed.embed(rows, store, make, "other")
    assert n == 3  # another model has its own vectors
    same, _ = embed.embed(rows, shared_path(spark, "store"), make, "m")
    assert {r["id"]: r["vector"] for r in same.collect()} == vectors


def test_object_text(spark):
    rows = spark.createDataFrame([("n", "d", list("abcdef")), ("n", "", None), (None, None, ["x"])], "n string, d string, s array<string>")
    assert [r[0] for r in rows.select(fusion.object_text(F.col("n"), F.col("d"), F.col("s"))).collect()] == ["n | d | a、b、c、d、e", "n", " | x"]


def test_semantic_groups_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 6))
    rows = [(i, f"d{i % 3}", f"name {int(k)} {'x' if i % 4 else 'y'}", int(rng.integers(1, 9)), [float(x) for x in centres[k] + rng.normal(0, 0.15, 6)]) for i, k in enumerate(rng.integers(0, 5, 60))]
    df = spark.createDataFrame(rows, "id long, domain string, object_name string, cluster_size long, v array<double>")
    groups, members = fusion.semantic_groups(df, 0.15)
    v = np.array([r[4] for r in rows])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    label = vector.linkage(v, distance=0.15)
    want = {}
    for c in set(label):
        at = [i for i in range(60) if label[i] == c]
        s = unit[at] @ unit[at].T
        best = min(at, key=lambda i: (-rows[i][3], i))
        mean = 1.0 if len(at) == 1 else round((s.sum() - len(at)) / (len(at) * (len(at) - 1)), 6)
        want[at[0]] = (rows[best][2], sorted({rows[i][2] for i in at}), sorted({rows[i][1] for i in at}), len(at), sum(rows[i][3] for i in at), mean)
    got = {r["group_id"]: (r["repr_name"], r["aliases"], r["domains"], r["members"], r["total_size"], r["avg_similarity"]) for r in groups.collect()}
    assert {k: x[:5] for k, x in got.items()} == {k: x[:5] for k, x in want.items()}
    assert all(abs(got[k][5] - want[k][5]) < 1e-5 for k in want) and members.count() == 60


def tfidf_of(texts):
    out = {}
    counts = {t: Counter(g for w in t.split() for k in (2, 3, 4) for g in [f" {w} "[i : i + k] for i in range(len(w) + 3 - k)]) for t in texts}
    df = Counter(g for c in counts.values() for g in c)
    for t, c in counts.items():
        w = {g: n * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in c.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        out[t] = {g: x / length for g, x in w.items()}
    return out


def average_linkage(vectors, weight, distance):
    """Sets of texts: the nearest two clusters merge while their mean distance is within the distance."""
    clusters = [[t] for t in sorted(vectors)]
    sim = {frozenset(p): sum(x * vectors[p[1]].get(g, 0) for g, x in vectors[p[0]].items()) for p in itertools.combinations(sorted(vectors), 2)}
    while len(clusters) > 1:
        score = lambda a, b: sum(weight[x] * weight[y] * sim[frozenset((x, y))] for x in a for y in b) / (sum(weight[x] for x in a) * sum(weight[y] for y in b))
        best, a, b = max((score(a, b), a, b) for a, b in itertools.combinations(clusters, 2))
        if 1 - best > distance:
            break
        clusters = [c for c in clusters if c not in (a, b)] + [a + b]
    return clusters


def sampled_objects(seed=2):
    rnd = random.Random(seed)
    stems = ["project plan", "project planning", "supplier master record", "supplier master records", "customer", "contract approval sheet", "contract approval sheets", "工程项目", "工程项目表"]
    rows = []
    for i in range(30):
        samples = [rnd.choice(stems) + rnd.choice(["", "", " ", "s", " 2"]) for _ in range(rnd.randint(0, 25))]
        rows.append((f"d{i % 4}", f"O{i}", rnd.choice(stems), samples if i % 7 else None))
    return [*rows, ("d9", "B", "", []), ("d9", "C", "", [" ", "  "])]


@pytest.mark.parametrize(("local", "block"), [(3000, 512), (3, 4)])
def test_sample_groups_against_brute_force(spark, local, block):
    """The second case merges components over the local limit in rounds, over many groups of blocks."""
    rows = sampled_objects()
    df = spark.createDataFrame(rows, "domain string, object_code string, object_name string, samples array<string>")
    flat = [(d, c, n, s.strip(" ")) for d, c, n, samples in rows for s in ((samples or [])[:20] or [n]) if s.strip(" ")]
    weight = Counter(r[3] for r in flat)
    vectors = tfidf_of(sorted(weight))
    want, members = [], set()
    for c in average_linkage(vectors, weight, 0.2):
        own = [r for r in flat if r[3] in c]
        total, n = Counter(), len(own)
        for t in c:
            for g, x in vectors[t].items():
                total[g] += weight[t] * x
        alike = 1.0 if n == 1 else round((sum(x * x for x in total.values()) - n) / (n * (n - 1)), 4)
        want.append((min(c), min(c, key=lambda t: (-weight[t], t)), n, len(c), sorted({r[0] for r in own}), alike))
        held = defaultdict(int)
        for r in own:
            held[r[:3]] += 1
        members |= {(min(c), *k, x) for k, x in held.items()}
    groups, found = fusion.sample_groups(df, 0.2, local=local, block=block)
    got = sorted((r["group_id"], r["repr_name"], r["size"], r["samples"], r["domains"], r["avg_similarity"]) for r in groups.collect())
    assert [x[:5] for x in got] == [x[:5] for x in sorted(want)]
    assert all(abs(a[5] - b[5]) < 2e-4 for a, b in zip(got, sorted(want)))
    assert {tuple(r) for r in found.select("group_id", "domain", "object_code", "object_name", "sample_count").collect()} == members


def test_sample_groups_of_nothing(spark):
    none = spark.createDataFrame([], "domain string, object_code string, object_name string, samples array<string>")
    groups, members = fusion.sample_groups(none)
    assert groups.count() == members.count() == 0


def settle_loop(objects):
    """The merges of one domain after naming, step by step over plain objects."""
    live = [dict(zip(("pos", "code", "name", "size", "samples", "synonyms"), o)) for o in sorted(objects)]
    gone, bare = {}, lambda n: n in ("ab", "abc")
    normal = [o for o in live if "_PENDING_MERGE_" not in o["code"]]
    grams = lambda o: {e[i : i + n] for e in o["samples"] for n in (2, 3) for i in range(len(e) - n + 1)}

    def into(target, o):
        target["size"] += o["size"]
        for s in o["samples"]:
            if s not in target["samples"]:
                target["samples"] = [*target["samples"], s]
        target["samples"] = target["samples"][:20]
        gone[o["code"]] = target["code"]

    for p in [o for o in live if "_PENDING_MERGE_" in o["code"]]:
        if not normal:
            break
        target, top = None, 0
        for n in normal:
            both = len(grams(p) & grams(n))
            if both > top:
                target, top = n, both
        if top == 0:
            target, top = normal[0], 0
            for n in normal:
                both = sum(c in " ".join(n["samples"]) for c in set(" ".join(p["samples"])))
                if both > top:
                    target, top = n, both
        into(target, p)
    rest = [o for o in normal if not bare(o["name"])]
    for o in [o for o in normal if bare(o["name"])]:
        if not rest:
            rest.append(o)
            continue
        target = rest[0]
        for r in rest:
            if r["size"] > target["size"]:
                target = r
        into(target, o)
    removed = set()
    for i in range(len(rest)):
        if i in removed:
            continue
        for j in range(i + 1, len(rest)):
            a, b = rest[i], rest[j]
            if j in removed or not (a["name"] == b["name"] or a["name"] in b["synonyms"] or b["name"] in a["synonyms"]):
                continue
            if a["size"] >= b["size"]:
                into(a, b)
                removed.add(j)
            else:
                into(b, a)
                removed.add(i)
    return [(o["code"], gone.get(o["code"]), o["size"], o["samples"]) for o in live]


def test_settle_against_a_loop(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefxyz中") for _ in range(rnd.randint(1, 5)))
    domains = {}
    for d in range(40):
        pending = 0.3 if d else 1.0  # the first has nothing but pending objects
        domains[f"d{d}"] = [
            (i, f"{'OBJ__PENDING_MERGE_' if rnd.random() < pending else 'OBJ_'}{i}", rnd.choice(["ab", "abc", "project", "device", "asset", "contract"] if d != 1 else ["ab"]), rnd.randint(1, 6), [w for w in dict.fromkeys(word() for _ in range(rnd.choice([0, 1, 3, 12])))], rnd.sample(["project", "device", "asset", "contract"], rnd.randint(0, 2)))
            for i in range(rnd.randint(1, 12))
        ]
    rows = [(d, *o) for d, objects in domains.items() for o in objects]
    df = spark.createDataFrame(rows, "domain string, position int, object_code string, object_name string, cluster_size long, samples array<string>, synonyms array<string>").repartition(3)
    got = {}
    for r in extract.settle(df, lambda n: tx.is_garbage(n, [])).collect():
        got.setdefault(r["domain"], []).append((r["object_code"], r["absorbed_by"], r["cluster_size"], r["samples"]))
    assert {d: sorted(x, key=str) for d, x in got.items()} == {d: sorted(settle_loop(o), key=str) for d, o in domains.items()}


def test_pending_objects_without_overlap_go_to_the_first(spark):
    rows = [("OBJ_B", "bb long name", 5, ["xyz"]), ("OBJ_A", "aa long name", 1, ["uvw"]), ("OBJ__PENDING_MERGE_1", "p", 1, ["123"])]
    df = spark.createDataFrame(rows, "object_code string, object_name string, cluster_size long, samples array<string>")
    got = {r["object_code"]: r["absorbed_by"] for r in extract.absorb(df, tx.is_garbage(F.col("object_name"), [])).collect()}
    assert got == {"OBJ_A": None, "OBJ_B": None, "OBJ__PENDING_MERGE_1": "OBJ_A"}


def test_absorbed_objects_of_equal_samples(spark):
    """Copies of samples cost no pairs of copies: 3,000 pending and 30,000 named objects have few sets of grams."""
    n = 33_000
    pending = F.col("id") % 11 == 0
    samples = F.array(F.concat(F.lit("ring "), (F.col("id") % 7).cast("string")), F.concat(F.lit("Brand#"), (F.col("id") % 5).cast("string")))
    df = spark.range(n).select(F.concat(F.when(pending, "OBJ__PENDING_MERGE_").otherwise("OBJ_"), F.format_string("%05d", "id")).alias("object_code"), F.concat(F.lit("long name "), "id").alias("object_name"), F.lit(1).alias("cluster_size"), samples.alias("samples"))
    got = {r["object_code"]: r["absorbed_by"] for r in extract.absorb(df, F.lit(False)).collect()}
    first = {}
    for i in range(n):
        if i % 11:
            first.setdefault((i % 7, i % 5), f"OBJ_{i:05d}")
    assert all(got[f"OBJ__PENDING_MERGE_{i:05d}"] == first[i % 7, i % 5] for i in range(0, n, 11))


def test_global_dedupe_against_brute_force(spark):
    rnd = random.Random(9)
    stems = ["steel pipe", "steel pipes", "copper wire", "copper wires", "glass"]
    cells = [(rnd.choice("ab"), rnd.choice(["Name", "NAME", "other"]), rnd.choice(stems) + rnd.choice(["", "", " x"])) for _ in range(200)] + [("a", "Name", None)]
    df = spark.createDataFrame(cells, "dataset string, attribute string, raw string")
    canon, mapping = fusion.global_dedupe(df, 0.8, shared_path(spark, "store"))
    encode, freq = embed.hashed_grams(256), Counter(c for c in cells if c[2] is not None)
    want = {}
    for pool in ("name", "other"):
        texts = sorted({c[2] for c in freq if c[1].lower() == pool})
        total = Counter()
        for (_, a, t), n in freq.items():
            if a.lower() == pool:
                total[t] += n
        v = encode(texts)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        label = list(range(len(texts)))
        for i, j in zip(*np.nonzero(v @ v.T >= 0.8)):
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
        for c in set(label):
            own = [t for t, x in zip(texts, label) if x == c]
            want |= {(pool, t): min(own, key=lambda t: (-total[t], len(t), t)) for t in own}
    assert len(set(want.values())) < len({t for _, t in want})
    assert {(r["dataset"], r["attribute"], r["from_text"], r["canonical_text"]) for r in mapping.collect()} == {(d, a, t, want[a.lower(), t]) for d, a, t in freq}
    sizes = Counter((d, a, want[a.lower(), t]) for d, a, t in freq)
    assert {(r["dataset"], r["attribute"], r["canonical_text"]): r["cluster_size"] for r in canon.collect()} == sizes


def test_bridged_relations_carry_business_objects_only(spark):
    """Against loops, with entities of several business objects, known keys and nulls; no row is multiplied by objects before the end."""
    rnd = random.Random(3)
    pick = lambda n, *sides: [tuple(None if rnd.random() < 0.05 else f"{s}{rnd.randrange(k)}" for s, k in sides) for _ in range(n)]
    matches = [(f"o{i}", f"b{j}", round(rnd.random(), 4)) for i in range(4) for j in range(5) if rnd.random() < 0.7] + [("o0", None, 0.9), (None, "b1", 0.3)]
    biz, cl, lp = pick(40, ("b", 6), ("c", 15)), pick(40, ("c", 15), ("l", 12)), pick(40, ("l", 12), ("p", 10))
    known = [(o, x, e) for o in ("o0", "o1", None) for x, e in (("CONCEPT", "c1"), ("LOGICAL", "l2"), ("PHYSICAL", "p3"), ("CONCEPT", "p4"), ("PHYSICAL", None))]
    c = {(o, s, e) for o, b, s in matches for x, e in biz if b is not None and b == x}
    l = {(o, s, e) for o, s, x in c for y, e in cl if x is not None and x == y}
    p = {(o, s, e) for o, s, x in l for y, e in lp if x is not None and x == y}
    want = {}
    for layer, f, rows in (("CONCEPT", 0.75, c), ("LOGICAL", 0.55, l), ("PHYSICAL", 0.45, p)):
        for o, s, e in rows:
            if None in (o, e) or (o, layer, e) not in known:
                want[o, layer, e] = max(want.get((o, layer, e), 0), round(s * f, 4))
    make = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    frames = make(biz, "business concept"), make(cl, "concept logical"), make(lp, "logical physical"), make(known, "object_code layer entity_name")
    out = extract.bridged_relations(spark.createDataFrame(matches, "object_code string, business string, score double"), *frames)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and {r[:3]: r[3] for r in got} == pytest.approx(want, abs=1.01e-4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(object_code#\d+, (layer#\d+, )?(concept|logical|physical)", plan)
