"""Registered queries: the entity-attribute-value model and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import text as tx
from ferrule.operators import eav

from .bindings import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


WIDE = """wide AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN '-' WHEN 2 THEN '' ELSE c_name END AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
 CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END AS solvent, c_mktsegment, strftime(DATE '2020-01-01' + CAST(c_custkey % 900 AS INTEGER), '%Y-%m-%d') AS since FROM customer)"""
CELLS = "cells AS (SELECT c_custkey AS entity_id, attribute, trim(raw) AS raw FROM (UNPIVOT wide ON c_name, c_nationkey, solvent, c_mktsegment, since INTO NAME attribute VALUE raw) WHERE lower(trim(raw)) NOT IN ('', 'n/a', '-', 'nan', 'null', 'none', '#n/a', 'na', '—'))"


def wide(spark, sf_dir):
    key = F.col("c_custkey")
    name = F.when(key % 7 == 0, "N/A").when(key % 7 == 1, "-").when(key % 7 == 2, "").otherwise(F.col("c_name"))
    since = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (key % 900).cast("int")), "yyyy-MM-dd")
    return table(spark, sf_dir, "customer").select(key, name.alias("c_name"), F.col("c_nationkey").cast("string").alias("c_nationkey"), F.when(F.col("c_acctbal") > 0, "yes").otherwise("no").alias("solvent"), "c_mktsegment", since.alias("since"))


def cells(spark, sf_dir):
    return eav.melt(wide(spark, sf_dir), "c_custkey")


@query(f"WITH {WIDE}, {CELLS} SELECT * FROM cells")
def eav_melt(spark, sf_dir):
    return cells(spark, sf_dir)


@query("""SELECT l_orderkey AS entity_id, attribute, count(*) AS n FROM (UNPIVOT (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey, CAST(l_suppkey AS VARCHAR) AS l_suppkey, l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_linenumber FROM lineitem)
 ON l_partkey, l_suppkey, l_returnflag, l_linestatus, l_linenumber INTO NAME attribute VALUE raw) GROUP BY ALL""")
def eav_melt_lineitem(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber")
    return eav.melt(rows, "l_orderkey").groupBy("entity_id", "attribute").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {WIDE}, {CELLS} SELECT entity_id, attribute, raw, CASE WHEN regexp_full_match(raw, '\\d+') THEN CAST(raw AS DOUBLE) END AS value_number,
 CASE WHEN regexp_full_match(raw, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST(raw AS TIMESTAMP) END AS value_datetime, CASE WHEN raw IN ('yes', 'no') THEN raw = 'yes' END AS value_bool,
 CASE WHEN NOT (regexp_full_match(raw, '\\d+') OR regexp_full_match(raw, '\\d{{4}}-\\d{{2}}-\\d{{2}}') OR raw IN ('yes', 'no')) THEN raw END AS value_text FROM cells""")
def eav_typed_values(spark, sf_dir):
    return eav.typed(cells(spark, sf_dir)).withColumn("value_number", F.col("value_number").cast("double"))


@query(f"""WITH {WIDE}, {CELLS} SELECT attribute, CASE attribute WHEN 'c_nationkey' THEN 'number' WHEN 'since' THEN 'datetime' WHEN 'solvent' THEN 'bool' ELSE 'text' END AS type, count(*) AS values FROM cells GROUP BY attribute""")
def eav_type_vote(spark, sf_dir):
    return eav.vote(cells(spark, sf_dir))


@query(f"WITH {WIDE}, {CELLS} SELECT entity_id, max(raw) FILTER (WHERE attribute = 'c_name') AS c_name, max(raw) FILTER (WHERE attribute = 'solvent') AS solvent, max(raw) FILTER (WHERE attribute = 'since') AS since FROM cells WHERE attribute IN ('c_name', 'solvent', 'since') GROUP BY entity_id")
def eav_pivot(spark, sf_dir):
    return eav.pivot(cells(spark, sf_dir), ["c_name", "solvent", "since"])


def _hash_sql(columns: list[str]) -> str:
    return "sha1(" + " || ".join(f"coalesce(encode({c}), '\\xFF'::BLOB) || '\\x1F'::BLOB" for c in columns) + ")"


@query("SELECT s_suppkey AS entity_id, " + _hash_sql(["CAST(s_suppkey AS VARCHAR)", "s_name", "CASE WHEN s_nationkey % 4 > 0 THEN CAST(s_nationkey AS VARCHAR) END"]) + " AS row_hash FROM supplier")
def eav_row_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_nationkey") % 4 > 0, F.col("s_nationkey")).alias("s_nationkey"))
    return eav.hashes(rows, "s_suppkey")


@query("""WITH o AS (SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 9 = 0 THEN 'x' ELSE c_name END AS v FROM customer WHERE c_custkey % 10 > 0), n AS (SELECT c_custkey AS entity_id, c_name AS v FROM customer WHERE c_custkey % 11 > 0)
SELECT entity_id, CASE WHEN n.v IS NULL THEN 'KEEP' WHEN o.v IS NULL THEN 'INSERT' WHEN o.v = n.v THEN 'SKIP' ELSE 'UPDATE' END AS action FROM o FULL JOIN n USING (entity_id)""")
def eav_incremental(spark, sf_dir):
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    old = c.where(key % 10 > 0).select(key, F.when(key % 9 == 0, "x").otherwise(F.col("c_name")).alias("v"))
    return eav.incremental(eav.hashes(old, "c_custkey"), eav.hashes(c.where(key % 11 > 0).select(key, F.col("c_name").alias("v")), "c_custkey"))


@query("SELECT 'p_name' AS attribute, p_name AS raw, count(*) AS freq FROM part GROUP BY p_name ORDER BY freq DESC, raw LIMIT 20")
def eav_value_freq(spark, sf_dir):
    return eav.frequency(table(spark, sf_dir, "part").select(F.lit("p_name").alias("attribute"), F.col("p_name").alias("raw")), 20)


MULTI = """c AS (SELECT 'part' AS dataset, 'p_type' AS attribute, p_type AS raw FROM part UNION ALL SELECT 'part', 'p_brand', p_brand FROM part UNION ALL SELECT 'customer', 'c_mktsegment', c_mktsegment FROM customer)"""


@query(f"""WITH {MULTI}, k AS (SELECT dataset, attribute, raw, count(*) AS freq FROM c GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY dataset, attribute ORDER BY freq DESC, raw) AS place FROM k)
SELECT raw, sum(freq) AS total, string_agg(dataset || '.' || attribute || '=' || freq, ';' ORDER BY dataset || '.' || attribute || '=' || freq) AS per_pair FROM t WHERE place <= 6 GROUP BY raw ORDER BY total DESC, raw LIMIT 12""")
def eav_multi_freq(spark, sf_dir):
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    one = lambda df, d, c: df.select(F.lit(d).alias("dataset"), F.lit(c).alias("attribute"), F.col(c).alias("raw"))
    return eav.multi_frequency(one(part, "part", "p_type").unionByName(one(part, "part", "p_brand")).unionByName(one(customer, "customer", "c_mktsegment")), 6, 12)


@query("""SELECT p_partkey AS entity_id, 'p_name' AS attribute, p_name AS raw, CASE WHEN p_name LIKE 'blue %' THEN 'azure ' || p_name[6:] ELSE p_name END AS normalized FROM part""")
def eav_normalized_view(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    mapping = part.where("p_name like 'blue %'").select(F.lit("p_name").alias("map_attribute"), F.col("p_name").alias("from_text"), F.concat(F.lit("azure "), F.substring("p_name", 6, 100)).alias("canonical_text")).distinct()
    return eav.normalized_view(part.select(F.col("p_partkey").alias("entity_id"), F.lit("p_name").alias("attribute"), F.col("p_name").alias("raw")), mapping)


@query("""WITH m AS (SELECT p_partkey, p_brand AS canonical_text FROM part), k AS (SELECT DISTINCT p_brand AS canonical_text FROM part WHERE p_brand NOT LIKE '%3')
SELECT (SELECT count(*) FROM m) AS mappings, (SELECT count(DISTINCT canonical_text) FROM m) AS used, (SELECT count(*) FROM k) AS canon, (SELECT count(*) FROM m WHERE canonical_text NOT IN (SELECT canonical_text FROM k)) AS orphans""")
def semantic_health(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return eav.mapping_health(part.select("p_partkey", F.col("p_brand").alias("canonical_text")), part.where("p_brand not like '%3'").select(F.col("p_brand").alias("canonical_text")).distinct())


@query("""SELECT c_mktsegment, c_custkey, CAST(row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS BIGINT) AS row_number FROM customer""")
def eav_row_numbers(spark, sf_dir):
    return eav.number_rows(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey")


@query("""SELECT p_name, string_agg(DISTINCT g, ',' ORDER BY g) AS grams FROM (SELECT DISTINCT p_name, unnest(list_concat([p_name[i:i+1] FOR i IN range(1, length(p_name))], [p_name[i:i+2] FOR i IN range(1, length(p_name) - 1)])) AS g FROM part) WHERE NOT contains(g, ' ') GROUP BY p_name""")
def char_ngrams(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.array_join(tx.char_grams(F.col("p_name")), ",").alias("grams"))


@query("""SELECT w AS name, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part) WHERE w <> 'rod' AND (regexp_full_match(w, '[A-Za-z]{1,4}') OR regexp_full_match(w, '\\d+') OR regexp_full_match(w, '[A-Za-z0-9_-]{1,3}')) GROUP BY w""")
def garbage_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.explode(F.split("p_name", " ")).alias("name")).unionByName(part.select(F.col("p_size").cast("string").alias("name")))
    return names.where(tx.is_garbage(F.col("name"), ["rod"])).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


ROUTES = [("spam", "JUNK"), ("/en/", "ENGLISH"), ("/de/", "GERMAN"), ("blog", "BLOG")]


@query("""SELECT page_id, CASE WHEN contains(url, 'spam') THEN 'JUNK' WHEN contains(url, '/en/') THEN 'ENGLISH' WHEN contains(url, '/de/') THEN 'GERMAN' WHEN contains(url, 'blog') THEN 'BLOG' END AS domain FROM pages""")
def domain_routing(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.first_match(F.col("url"), ROUTES).alias("domain"))


@query("""WITH s AS (SELECT p_brand, list_sort(list(DISTINCT p_name))[1:20] AS samples FROM part GROUP BY p_brand)
SELECT p_brand, CAST(round(CAST(greatest(CASE WHEN p_brand LIKE '%1' THEN 0.8 ELSE 0.0 END, least(0.95, 0.5 + CAST(len(list_filter(samples, lambda x: contains(x, 'ring'))) AS DOUBLE) / len(samples) * 0.5)) AS DECIMAL(9, 6)), 2) AS DOUBLE) AS confidence FROM s""")
def name_explanation(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.slice(F.array_sort(F.collect_set("p_name")), 1, 20).alias("samples"))
    floor = F.when(F.col("p_brand").endswith("1"), 0.8).otherwise(0.0)
    return rows.select("p_brand", tx.confidence(F.col("samples"), F.lit("ring"), floor).alias("confidence"))


@query("""SELECT w AS token, count(*) AS n FROM (SELECT unnest(string_split(replace(replace(replace(p_name || p_type || '数据' || p_brand || '管理x', '信息', ' 信息'), '数据', ' 数据'), '管理', ' 管理'), ' ')) AS w FROM part) WHERE length(w) >= 2 GROUP BY w ORDER BY n DESC, w LIMIT 10""")
def name_keywords(spark, sf_dir):
    name = F.concat("p_name", "p_type", F.lit("数据"), "p_brand", F.lit("管理x"))
    words = table(spark, sf_dir, "part").select(F.explode(tx.keyword_tokens(name)).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(10)
