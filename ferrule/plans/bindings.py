"""Logical tables of the engine, derived from the star-schema files.

Each function returns a DataFrame; CTE holds the same tables as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS = ["CONCEPT", "LOGICAL", "PHYSICAL"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strength(key: str) -> Column:
    return (F.col(key) % 101).cast("double") / 100


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, object_code, object_name, domain, object_type: one row a nation."""
    kind = F.element_at(F.array(F.lit("CORE"), F.lit("DERIVED"), F.lit("AUXILIARY")), F.col("n_nationkey") % 3 + 1)
    return (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").cast("long").alias("object_id"), F.concat(F.lit("OBJ_"), "n_name").alias("object_code"), F.col("n_name").alias("object_name"), F.col("r_name").alias("domain"), kind.alias("object_type"))
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, layer, entity_name, entity_code, subdomain, via, strength, relation_type.

    Concepts are customers, logical entities orders, physical entities line items; some
    objects lack layers so that completeness and defects have all their cases.
    """
    customer, orders, lineitem = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    nation = F.col("c_nationkey").cast("long")
    none = F.lit(None).cast("string")
    owner = customer.select("c_custkey", "c_name", "c_nationkey")
    concept = customer.select(nation.alias("object_id"), F.lit("CONCEPT").alias("layer"), F.col("c_name").alias("entity_name"), F.col("c_custkey").cast("string").alias("entity_code"), F.col("c_mktsegment").alias("subdomain"), none.alias("via"), strength("c_custkey").alias("strength"), F.lit("DIRECT").alias("relation_type"))
    order = F.col("o_orderkey").cast("string")
    logical = orders.join(owner, F.col("o_custkey") == F.col("c_custkey")).where(nation % 7 != 3).select(nation.alias("object_id"), F.lit("LOGICAL").alias("layer"), order.alias("entity_name"), order.alias("entity_code"), none.alias("subdomain"), F.col("c_name").alias("via"), strength("o_orderkey").alias("strength"), F.lit("INDIRECT").alias("relation_type"))
    line = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    by_order = orders.select("o_orderkey", "o_custkey").join(owner, F.col("o_custkey") == F.col("c_custkey")).where(nation % 5 != 0)
    physical = lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(by_order, F.col("l_orderkey") == F.col("o_orderkey")).select(nation.alias("object_id"), F.lit("PHYSICAL").alias("layer"), line.alias("entity_name"), line.alias("entity_code"), none.alias("subdomain"), F.col("l_orderkey").cast("string").alias("via"), strength("l_partkey").alias("strength"), F.lit("INDIRECT").alias("relation_type"))
    return concept.unionByName(logical).unionByName(physical).where(F.col("object_id") % 11 != 10)


def local_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """domain, object_name, object_code, cluster_size, samples: brands and types of parts in each supplier nation."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("kind"), "p_name")
    supplier = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    grouped = rows.groupBy(F.col("n_name").alias("domain"), F.col("kind").alias("object_name")).agg(F.count(F.lit(1)).alias("cluster_size"), F.slice(F.array_sort(F.collect_set("p_name")), 1, 20).alias("samples"))
    return grouped.select("domain", "object_name", F.concat(F.lit("OBJ_"), F.upper(F.regexp_replace("object_name", "[^A-Za-z0-9]", "_"))).alias("object_code"), "cluster_size", "samples")


CTE = """
objects AS (
  SELECT CAST(n_nationkey AS BIGINT) AS object_id, 'OBJ_' || n_name AS object_code, n_name AS object_name, r_name AS domain,
         CASE n_nationkey % 3 WHEN 0 THEN 'CORE' WHEN 1 THEN 'DERIVED' ELSE 'AUXILIARY' END AS object_type
  FROM nation JOIN region ON n_regionkey = r_regionkey
), relations AS (
  SELECT * FROM (
    SELECT CAST(c_nationkey AS BIGINT) AS object_id, 'CONCEPT' AS layer, c_name AS entity_name, CAST(c_custkey AS VARCHAR) AS entity_code,
           c_mktsegment AS subdomain, CAST(NULL AS VARCHAR) AS via, CAST(c_custkey % 101 AS DOUBLE) / 100 AS strength, 'DIRECT' AS relation_type
    FROM customer
    UNION ALL
    SELECT c_nationkey, 'LOGICAL', CAST(o_orderkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), NULL, c_name, CAST(o_orderkey % 101 AS DOUBLE) / 100, 'INDIRECT'
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 7 <> 3
    UNION ALL
    SELECT c_nationkey, 'PHYSICAL', l_orderkey || '-' || l_linenumber, l_orderkey || '-' || l_linenumber, NULL, CAST(l_orderkey AS VARCHAR), CAST(l_partkey % 101 AS DOUBLE) / 100, 'INDIRECT'
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 5 <> 0
  ) WHERE object_id % 11 <> 10
), local_objects AS (
  SELECT n_name AS domain, p_brand || ' ' || p_type AS object_name, 'OBJ_' || upper(regexp_replace(p_brand || ' ' || p_type, '[^A-Za-z0-9]', '_', 'g')) AS object_code,
         count(*) AS cluster_size, list_sort(list(DISTINCT p_name))[1:20] AS samples
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY n_name, p_brand, p_type
)"""


def sql(body: str, *more: str) -> str:
    """An oracle statement over the logical tables; more: further common table expressions."""
    head = "WITH " + ",\n".join([CTE, *more])
    return head + (",\n" + body[5:] if body.startswith("WITH ") else "\n" + body)
