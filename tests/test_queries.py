"""Every query of the engine's own operators against its SQL twin, and the shape of their plans."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

from ferrule.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


RELATIONAL = ["relation_stats", "domain_stats", "completeness", "defects", "object_relations_topk", "three_tier_graph", "sankey", "eav_melt", "eav_type_vote", "lifecycle_history", "rule_threshold", "merge_objects", "keyword_jaccard"]


@pytest.mark.parametrize("name", RELATIONAL)
def test_plans_are_native(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "Pandas" not in plan


def test_filters_reach_the_scan(spark):
    plan = QUERIES["entity_search"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey" in plan and "c_acctbal" not in plan
    assert "PushedFilters: [IsNotNull" in QUERIES["granularity_report"](spark, SF)._jdf.queryExecution().executedPlan().toString()
