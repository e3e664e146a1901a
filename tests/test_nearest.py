"""Nearest neighbours of more queries than one block, against brute force."""

from __future__ import annotations

import numpy as np

from ferrule.operators import vector


def test_more_queries_than_a_block(spark):
    v = np.random.default_rng(2).normal(size=(60, 5))
    df = spark.createDataFrame([(i, [float(x) for x in u]) for i, u in enumerate(v)], "id long, v array<double>")
    got = vector.nearest(df, df.where("id % 3 = 0"), 4, limit=6, slice_rows=16).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for q in range(0, 60, 3):
        ranked = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in range(60) if i != q)[:4]
        want |= {(q, i, r) for r, (_, i) in enumerate(ranked, 1)}
    assert {(r["query_id"], r["id"], r["rank"]) for r in got} == want and len(got) == 80
