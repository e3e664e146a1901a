"""Clustering queries and operators against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest

from ferrule.operators import clustering, radius, vector
from ferrule.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def parts(rows, group="label"):
    """The clusters as sets of ids, whatever their numbers."""
    out: dict = {}
    for r in rows:
        out.setdefault((r[group], r["cluster"]), set()).add(r["id"])
    return sorted((k[0], sorted(v)) for k, v in out.items())


def brute(groups, **how):
    rows = []
    for g, members in groups.items():
        v = np.array([x for _, x in members])
        args = dict(how)
        if "target" in args:
            args = {"k": vector.target_clusters(len(v), args["target"])}
        rows += [{"label": g, "id": i, "cluster": c} for (i, _), c in zip(members, vector.linkage(v, **args), strict=True)]
    return parts(rows)


def read(spark):
    groups: dict = {}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect():
        groups.setdefault(r["label"], []).append((r["vec_id"], np.array(r["embedding"], float)))
    return groups


def test_agglomerative_covers_all_labels(spark):
    rows = QUERIES["agglomerative"](spark, SF).collect()
    assert parts(rows) == brute(read(spark), target=15)


def test_split_oversized_covers_all_labels(spark):
    groups = read(spark)
    rows = QUERIES["split_oversized"](spark, SF).collect()
    want = []
    for g, members in groups.items():
        v = np.array([x for _, x in members])
        label = vector.linkage(v, vector.target_clusters(len(v), 2)).copy()
        for _ in range(3):
            names, counts = np.unique(label, return_counts=True)
            for c in names[counts > 0.4 * len(v)]:
                mine = np.flatnonzero(label == c)
                part = vector.linkage(v[mine], max(3, min(5, len(mine) // 50)))
                label[mine] = np.where(part == 0, c, label.max() + part)
        want += [(g, i, int(c)) for (i, _), c in zip(members, label, strict=True)]
    assert sorted((r["label"], r["id"], r["cluster"]) for r in rows) == sorted(want)


def test_semantic_groups_covers_all_vectors_at_the_reference_distance(spark):
    rows = QUERIES["semantic_groups"](spark, SF).collect()
    everything = sorted((i, v) for members in read(spark).values() for i, v in members)
    assert parts(rows) == brute({0: everything}, distance=0.15)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 6))
    v = centres[rng.integers(0, 8, 150)] + rng.normal(0, 0.4, (150, 6))
    v[100:110] = v[5]
    groups = {0: [(i, v[i]) for i in range(120)], 1: [(i, v[i]) for i in range(120, 150)]}
    rows = [(g, i, [float(x) for x in u]) for g, m in groups.items() for i, u in m]
    return groups, spark.createDataFrame(rows, "label int, id long, v array<double>")


@pytest.mark.parametrize("how", [{"target": 7}, {"distance": 0.15}])
def test_rounds_equal_brute_force(cloud, monkeypatch, how):
    """Groups over the local limit, in many blocks and rounds, with equal vectors."""
    groups, df = cloud
    monkeypatch.setattr(clustering, "BLOCK", 25)
    monkeypatch.setattr(clustering, "LEAST", 0)
    rows = clustering.agglomerate(df, "label", **how, local=40).collect()
    assert parts(rows) == brute(groups, **how)


def test_more_clusters_than_distinct_vectors(spark):
    df = spark.createDataFrame([(0, i, [1.0, float(i % 2)]) for i in range(30)], "label int, id long, v array<double>")
    rows = clustering.agglomerate(df, "label", 15).collect()
    assert len(rows) == 30 and len({r["cluster"] for r in rows}) == vector.target_clusters(30, 15)


def clouds(n=150, dims=8, spread=0.12, seed=4):
    """Near copies around few centres, copies, an opposite vector and a zero vector."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(9, dims))[rng.integers(0, 9, n)] + rng.normal(0, spread, (n, dims))
    v[7:20], v[20], v[21] = v[3], 0, -v[3]
    return v


def linked(v, t):
    """Components of the graph of cosines by repeated labels."""
    unit = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)
    near = (unit @ unit.T >= t) | np.eye(len(v), dtype=bool)
    label = np.arange(len(v))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label, near
        label = new


@pytest.mark.parametrize("t", [0.93, 0.4, -0.2])
def test_radius_join_against_brute_force(spark, monkeypatch, t):
    """Many pivots, rings and blocks, homes and visitors over several groups each."""
    v = clouds()
    df = spark.createDataFrame([(i, [float(x) for x in u]) for i, u in enumerate(v)], "id long, v array<double>")
    label, near = linked(v, t)
    got = vector.similar_pairs(df, t, block=16).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted((int(i), int(j)) for i, j in zip(*np.nonzero(near)) if i < j)
    monkeypatch.setattr(radius.radius_components, "__defaults__", (16,))
    found = {r["id"]: r["component"] for r in vector.radius_components(df, t).collect()}
    assert [found[i] for i in range(len(v))] == label.tolist()


def test_radius_edges_stay_few(spark):
    """A group of 300 near copies gives spanning edges, not its 45,000 pairs."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1, 6)) + rng.normal(0, 1e-3, (300, 6))
    df = spark.createDataFrame([(0, i, [float(x) for x in u / np.linalg.norm(u)]) for i, u in enumerate(v)], "g int, id long, v array<double>")
    edges = radius.spanning_edges(radius.groups(df, 0.1, block=100), 0.995).count()
    assert edges < 300 * 8  # one forest for each of the pairs of blocks


def test_radius_of_nothing_and_nulls(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    assert vector.radius_components(none, 0.5).count() == vector.similar_pairs(none, 0.5).count() == 0
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.1])], "id long, v array<double>")
    assert {(r["id"], r["component"]) for r in vector.radius_components(some, 0.9).collect()} == {(1, 1), (2, 2), (3, 1)}


@pytest.mark.parametrize("local", [5, 1000])
def test_linkage_by_components_equals_brute_force(spark, monkeypatch, local):
    """Components over the local limit merge in rounds of radius joins."""
    monkeypatch.setattr(clustering, "BLOCK", 20)
    v = clouds(90, spread=0.2)
    df = spark.createDataFrame([(i % 2, i, [float(x) for x in u]) for i, u in enumerate(v)], "label int, id long, v array<double>")
    rows = clustering.agglomerate(df, "label", distance=0.12, local=local).collect()
    assert parts(rows) == brute({g: [(i, v[i]) for i in range(g, 90, 2)] for g in (0, 1)}, distance=0.12)


def test_places_of_vectors_are_not_broadcast(spark):
    """Many rows that are few bytes in files: the join that gives them their vectors, and the labels of components, shuffle."""
    rnd = np.random.default_rng(4)
    df = spark.createDataFrame([(0, i, rnd.normal(size=4).tolist()) for i in range(300)], "g int, id long, v array<double>")
    plan = radius.groups(df, 0.5, block=20)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[g#\d+, id#\d+L?\]", plan)
    assert [radius.block_of(n) for n in (0, 1000, 240_000, 10**7)] == [2048, 2048, 10_000, 16_384] and radius.block_of(300, 20) == 20


def test_splits_are_cut_from_the_tree(cloud, monkeypatch):
    """Splitting by the tree of all vectors gives what clustering each cluster again gives, and clusters nothing again."""
    _, df = cloud
    tree = clustering.tree_of(df, "label", local=40)
    first = clustering.agglomerate(df, "label", 2, tree=tree)
    show = lambda out: sorted((r["label"], r["id"], r["cluster"]) for r in out.collect())
    again = show(clustering.split_oversized(first, df, "label"))
    monkeypatch.setattr(clustering, "merges", None)
    assert show(clustering.split_oversized(first, df, "label", tree=tree)) == again
    assert len({r[:1] + r[2:] for r in again}) > first.select("label", "cluster").distinct().count()


def test_large_groups_make_few_blocks(spark, monkeypatch):
    """A group is dealt to few blocks, not to one for each BLOCK vectors, and rounds end early."""
    monkeypatch.setattr(clustering, "BLOCK", 10)
    rnd = np.random.default_rng(5)
    df = spark.createDataFrame([(0, i, rnd.normal(size=4).tolist(), 1) for i in range(400)], "g int, id long, s array<double>, n long")
    sizes = df.groupBy("g").agg({"id": "count"}).toDF("g", "c")
    seen = []
    monkeypatch.setattr(type(df), "groupBy", lambda self, *k, f=type(df).groupBy: (k == ("g", "lo", "hi") and seen.append(self.count()), f(self, *k))[1])
    clustering._nearest(df, sizes, "int")
    assert seen == [400 * clustering.BLOCKS] and clustering.LEAST >= 0.1
