"""Registered queries: coverage, totals, domains, naming and merge reports over several tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import text as tx
from ferrule.operators import dedup as dd
from ferrule.operators import eav
from ferrule.operators import extract as ex
from ferrule.operators import governance as g
from ferrule.operators import lineage as ln
from ferrule.operators import maintenance as mt
from ferrule.operators import rules as ru

from .bindings import local_objects, objects, relations, sql, table
from .mining import WORDS, keywords

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(sql("""SELECT *, round(CAST(attributes AS DOUBLE) / objects * 100, 1) AS attributes_rate, round(CAST(lifecycle AS DOUBLE) / objects * 100, 1) AS lifecycle_rate, round(CAST(trace AS DOUBLE) / objects * 100, 1) AS trace_rate FROM (
 SELECT (SELECT count(*) FROM objects) AS objects, (SELECT count(*) FROM objects WHERE object_id IN (SELECT s_nationkey FROM supplier)) AS attributes,
 (SELECT count(*) FROM objects WHERE object_id IN (SELECT user_id % 40 FROM events WHERE event_type = 'signup')) AS lifecycle, (SELECT count(*) FROM objects WHERE object_id IN (SELECT turn * 3 FROM conversations WHERE role <> 'system')) AS trace)"""))
def object_coverage(spark, sf_dir):
    """How many objects have attributes, a lifecycle and a place in a chain."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("object_id"))
    life = table(spark, sf_dir, "events").where("event_type = 'signup'").select((F.col("user_id") % 40).alias("object_id"))
    trace = table(spark, sf_dir, "conversations").select(F.when(F.col("role") != "system", F.col("turn") * 3).alias("object_id"))
    return g.coverage(objects(spark, sf_dir), attributes=own, lifecycle=life, trace=trace)


@query(sql("""SELECT object_code AS key, string_agg(DISTINCT object_name, '/' ORDER BY object_name) AS group_name, count(*) AS members, count(DISTINCT domain) AS domains,
 sum(cluster_size) AS total_concept, sum(len(samples)) AS total_logical, sum(length(domain)) AS total_physical FROM local_objects GROUP BY object_code"""))
def literal_group_totals(spark, sf_dir):
    """Literal groups with the totals of the three layers; an object's logical and physical counts are those of its samples and its domain's letters."""
    lo = local_objects(spark, sf_dir)
    return g.layer_totals(lo.select("domain", "object_code", "object_name", F.col("cluster_size").alias("concept"), F.size("samples").alias("logical"), F.length("domain").alias("physical")))


@query(sql("""SELECT domain, small_code, target_code, similarity FROM (SELECT *, row_number() OVER (PARTITION BY domain, small_code ORDER BY similarity DESC, target_code) AS r FROM (
 SELECT s.domain, s.object_code AS small_code, t.object_code AS target_code, round(CAST(len(list_intersect(s.samples, t.samples)) AS DOUBLE) / (len(s.samples) + len(t.samples) - len(list_intersect(s.samples, t.samples))), 4) AS similarity
 FROM k s JOIN k t ON s.domain = t.domain AND NOT s.big AND t.big) WHERE similarity > 0) WHERE r = 1""", "k AS (SELECT CASE WHEN object_name LIKE 'Brand#1%' THEN 'OBJ_DEVICE' ELSE object_code END AS object_code, domain, samples, cluster_size >= 3 OR object_name LIKE 'Brand#1%' AS big FROM (SELECT * FROM local_objects WHERE object_name NOT LIKE 'Brand#1%' UNION ALL SELECT * FROM (SELECT domain, min(object_name), '', 1, list_sort(list_distinct(flatten(list(samples))))[1:20] FROM local_objects WHERE object_name LIKE 'Brand#1%' GROUP BY domain)))"))
def protected_merge_plan(spark, sf_dir):
    """The merge plan where one protected object of each domain, however small, is a target and never goes."""
    lo = local_objects(spark, sf_dir).select("domain", "object_name", "object_code", "cluster_size", "samples")
    first = F.col("object_name").startswith("Brand#1")
    one = lo.where(first).groupBy("domain").agg(F.min("object_name").alias("object_name"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("samples")))), 1, 20).alias("samples"))
    one = one.select("domain", "object_name", F.lit("OBJ_DEVICE").alias("object_code"), F.lit(1).cast("long").alias("cluster_size"), "samples")
    return dd.small_with_targets(lo.where(~first).unionByName(one), 3, 1).drop("rank")


@query(sql("""SELECT a.object_code AS source, coalesce(t.target, (SELECT arg_min(object_code, object_id) FROM k WHERE big)) AS target, coalesce(t.overlap, 0) AS overlap FROM k a LEFT JOIN (
 SELECT source, target, overlap FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY overlap DESC, object_id) AS r FROM (
  SELECT x.object_code AS source, y.object_code AS target, y.object_id, len(list_intersect(x.samples, y.samples)) AS overlap FROM k x JOIN k y ON NOT x.big AND y.big) WHERE overlap > 0) WHERE r = 1) t ON t.source = a.object_code WHERE NOT a.big""",
 "k AS (SELECT object_id, object_code, object_id % 3 = 0 AS big, coalesce(list(s_name[-2:]) FILTER (WHERE s_name IS NOT NULL), []) AS samples FROM objects LEFT JOIN supplier ON s_nationkey = object_id GROUP BY object_id, object_code)"))
def sample_merge_targets(spark, sf_dir):
    """The target of each small object by common samples, the first large one where there are none."""
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("object_id")).agg(F.collect_list(F.substring("s_name", -2, 2)).alias("samples"))
    o = objects(spark, sf_dir).join(s, "object_id", "left")
    rows = o.select(F.col("object_id").alias("position"), "object_code", F.when(F.col("object_id") % 3 == 0, 9).otherwise(1).alias("cluster_size"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))
    return mt.merge_targets_by_samples(rows, 3)


LATIN, CHINESE = "abcdefghijklmnopqrstuvwxyz", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"


@query(f"""WITH c AS (SELECT CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS cluster_id, translate(p_name, '{LATIN}', '{CHINESE}') AS name FROM part),
g AS (SELECT cluster_id, unnest([x FOR x IN list_distinct(list_concat([name[i:i+1] FOR i IN range(1, length(name))], [name[i:i+2] FOR i IN range(1, length(name) - 1)])) IF NOT contains(x, ' ')]) AS gram FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY freq DESC, gram) AS q FROM (SELECT cluster_id, gram, count(*) AS freq FROM g GROUP BY ALL)),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY freq DESC, gram) AS r FROM f WHERE q <= 20 AND length(gram) = 3) WHERE r = 1)
SELECT cluster_id, CASE WHEN freq >= 3 THEN gram ELSE 'OBJ__PENDING_MERGE_' || cluster_id END AS name, coalesce(freq, 0) AS freq, 0.5 AS confidence FROM (SELECT DISTINCT cluster_id FROM c) LEFT JOIN t USING (cluster_id)""")
def content_naming_garbage(spark, sf_dir):
    """Names from content without garbage: one or two Chinese characters name nothing, and only the 20 most common grams are looked at."""
    name = F.translate("p_name", LATIN, CHINESE)
    c = table(spark, sf_dir, "part").select(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("cluster_id"), name.alias("name"))
    return ex.content_naming(c, ex.NAME_STOP, garbage=lambda x: tx.is_garbage(x, []), top=20)


def domain_entities(spark, sf_dir):
    """Parts as entities of the domains of their brands."""
    layer = F.element_at(F.array(*[F.lit(x) for x in ("CONCEPT", "LOGICAL", "PHYSICAL")]), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("domain"), F.col("p_name").alias("entity_name"), F.col("p_partkey").cast("string").alias("entity_code"), F.col("p_partkey").alias("row"), layer.alias("layer"))


ENTITY = "e AS (SELECT p_brand AS domain, p_name AS entity_name, arg_max(['CONCEPT', 'LOGICAL', 'PHYSICAL'][p_size % 3 + 1], p_partkey) AS layer, CAST(max(p_partkey) AS VARCHAR) AS entity_code FROM part GROUP BY ALL)"


@query(f"""WITH {WORDS}, {ENTITY}, h AS (SELECT DISTINCT domain, object_code, entity_name, layer FROM e JOIN k ON contains(entity_name, keyword))
SELECT domain, object_code, count(*) FILTER (WHERE layer = 'CONCEPT') AS concept, count(*) FILTER (WHERE layer = 'LOGICAL') AS logical, count(*) FILTER (WHERE layer = 'PHYSICAL') AS physical, count(*) AS total FROM h GROUP BY ALL""")
def all_domain_objects(spark, sf_dir):
    """Objects by keyword of all domains in one job, with their entities by layer."""
    return ex.by_domain(domain_entities(spark, sf_dir), keywords(spark))[0]


@query(f"WITH {WORDS}, {ENTITY} SELECT DISTINCT domain, object_code, entity_name, entity_code, 0.8 AS strength FROM e JOIN k ON contains(entity_name, keyword)")
def all_domain_relations(spark, sf_dir):
    """The entities of those objects."""
    return ex.by_domain(domain_entities(spark, sf_dir), keywords(spark))[1]


@query(f"""WITH {WORDS}, e AS (SELECT p_name AS entity_name, arg_max(['CONCEPT', 'LOGICAL', 'PHYSICAL'][p_size % 3 + 1], p_partkey) AS layer FROM part GROUP BY p_name), h AS (SELECT DISTINCT object_code, entity_name, layer FROM e JOIN k ON contains(entity_name, keyword))
SELECT object_code, count(*) FILTER (WHERE layer = 'CONCEPT') AS concept, count(*) FILTER (WHERE layer = 'LOGICAL') AS logical, count(*) FILTER (WHERE layer = 'PHYSICAL') AS physical, count(*) AS total FROM h GROUP BY ALL ORDER BY total DESC, object_code""")
def keyword_objects(spark, sf_dir):
    """Objects by keyword with their entities by layer, most first."""
    return ex.keyword_objects(domain_entities(spark, sf_dir), keywords(spark))


@query(sql("""SELECT object_code, object_name, CAST(n AS BIGINT) AS cluster_size FROM (SELECT object_code, object_name, object_id % 14 AS n, object_id FROM objects) WHERE object_name IN ('NATION_0', 'NATION_3', 'NATION_6', 'NATION_9', 'NATION_12', 'NATION_15', 'NATION_18', 'NATION_21', 'NATION_24') AND (n < 10 OR object_id NOT IN (SELECT object_id FROM relations))"""))
def required_lacking(spark, sf_dir):
    """Required objects that a supplement is for."""
    o = objects(spark, sf_dir).withColumn("cluster_size", F.col("object_id") % 14)
    r = relations(spark, sf_dir).join(o.select("object_id", "object_code"), "object_id")
    return ex.lacking(o, r, [f"NATION_{i}" for i in range(0, 25, 3)]).select("object_code", "object_name", "cluster_size")


@query("""WITH m AS (SELECT p_size % 3 AS dataset_id, 0 AS attribute_id, lower(p_name) AS f, min(p_size) AS canonical_id FROM part WHERE p_name LIKE 'b%' GROUP BY ALL)
SELECT p_partkey AS entity_id, p_size % 3 AS dataset_id, a AS attribute_id, CASE a WHEN 0 THEN 'name' ELSE 'brand' END AS attribute, raw, CASE WHEN canonical_id IS NOT NULL THEN 'canon ' || canonical_id ELSE raw END AS normalized
FROM (SELECT p_partkey, p_size, unnest([0, 1]) AS a, unnest([upper(p_name), p_brand]) AS raw FROM part) v LEFT JOIN m ON dataset_id = p_size % 3 AND attribute_id = a AND f = lower(raw)""")
def normalized_values(spark, sf_dir):
    """Values of four tables joined, with the canonical text of mappings that agree but for case."""
    p = table(spark, sf_dir, "part")
    values = p.select(F.col("p_partkey").alias("entity_id"), F.explode(F.array(F.struct(F.lit(0).alias("attribute_id"), F.upper("p_name").alias("raw")), F.struct(F.lit(1).alias("attribute_id"), F.col("p_brand").alias("raw")))).alias("v")).select("entity_id", "v.*")
    entities = p.select(F.col("p_partkey").alias("entity_id"), (F.col("p_size") % 3).alias("dataset_id"))
    attributes = values.select("attribute_id").distinct().withColumn("attribute", F.when(F.col("attribute_id") == 0, "name").otherwise("brand"))
    mapping = p.where("p_name like 'b%'").select((F.col("p_size") % 3).alias("dataset_id"), F.lit(0).alias("attribute_id"), F.col("p_name").alias("from_text"), F.col("p_size").alias("canonical_id")).distinct()
    canon = p.select(F.col("p_size").alias("canonical_id"), F.concat(F.lit("canon "), F.col("p_size").cast("string")).alias("canonical_text")).distinct()
    return eav.normalized_values(values, entities, attributes, mapping, canon)


@query("""WITH v AS (SELECT o_orderkey AS entity_id, unnest([1, 2, 3]) AS a, unnest([CAST(o_totalprice AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderpriority]) AS raw FROM orders),
h AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY entity_id, name) AS seen FROM (SELECT entity_id, name, raw, rule_id, bound, level FROM v JOIN (VALUES (1, 'total price'), (2, 'customer key'), (3, 'priority of price')) t(i, name) ON i = a JOIN (VALUES ('R1', 'price', 100000.0, 'HIGH'), ('R2', 'key', 700.0, 'LOW')) r(rule_id, field, bound, level) ON contains(name, field) WHERE try_cast(raw AS DOUBLE) IS NOT NULL))
SELECT rule_id, entity_id, name, level, CAST(raw AS DOUBLE) AS value, 'o' || entity_id AS label FROM h WHERE seen <= 100 AND CAST(raw AS DOUBLE) > bound""")
def alert_scan_tables(spark, sf_dir):
    """Alerts over values, attributes and entities as three tables."""
    o = table(spark, sf_dir, "orders")
    each = F.array(*[F.struct(F.lit(i).alias("attribute_id"), F.col(c).cast("string").alias("raw")) for i, c in ((1, "o_totalprice"), (2, "o_custkey"), (3, "o_orderpriority"))])
    values = o.select(F.col("o_orderkey").alias("entity_id"), F.explode(each).alias("v")).select("entity_id", "v.*")
    name = F.element_at(F.array(F.lit("total price"), F.lit("customer key"), F.lit("priority of price")), F.col("attribute_id"))
    attributes = values.select("attribute_id").distinct().withColumn("name", name)
    entities = o.select(F.col("o_orderkey").alias("entity_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("label"))
    rules = spark.createDataFrame([("R1", "price", ">", 100000.0, "HIGH"), ("R2", "key", ">", 700.0, "LOW")], "rule_id string, field string, operator string, bound double, level string")
    return ru.scanned_values(values, attributes, entities, rules).select("rule_id", "entity_id", "name", "level", "value", "label")


@query("""SELECT c_mktsegment AS dataset, c_name AS attribute, CASE WHEN c_acctbal > 0 THEN 'number' ELSE 'text' END AS type, c_nationkey AS place FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY place, attribute""")
def dataset_attributes(spark, sf_dir):
    """The attributes of one dataset in order."""
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("dataset"), F.col("c_name").alias("attribute"), F.when(F.col("c_acctbal") > 0, "number").otherwise("text").alias("type"), F.col("c_nationkey").alias("place"))
    return eav.attribute_list(c, "BUILDING")


@query(sql("""SELECT conv_id AS chain_id, turn AS node_order, coalesce(object_code, '') AS object_code, coalesce(object_name, '') AS object_name FROM conversations LEFT JOIN objects ON object_id = turn * 3"""))
def chain_node_objects(spark, sf_dir):
    """Nodes of chains with the code and name of their object, empty where they have none."""
    nodes = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chain_id"), F.col("turn").alias("node_order"), (F.col("turn") * 3).alias("object_id"))
    return ln.with_objects(nodes, objects(spark, sf_dir)).select("chain_id", "node_order", F.coalesce("object_code", F.lit("")).alias("object_code"), F.coalesce("object_name", F.lit("")).alias("object_name"))


@query()
def settled_objects(spark, sf_dir):
    """Types of parts as objects of their brands' domains after naming: some are pending, some have bare names, some are each other's synonyms."""
    p = table(spark, sf_dir, "part")
    o = p.groupBy(F.col("p_brand").alias("domain"), F.col("p_type").alias("object_name")).agg(F.count(F.lit(1)).alias("cluster_size"), F.slice(F.array_sort(F.collect_set("p_name")), 1, 20).alias("samples"), F.min("p_partkey").alias("position"))
    key = F.col("position")
    code = F.when(key % 4 == 0, F.concat(F.lit("OBJ__PENDING_MERGE_"), key.cast("string"))).otherwise(F.concat(F.lit("OBJ_"), key.cast("string")))
    name = F.when(key % 7 == 1, "abc").otherwise(F.col("object_name"))
    rows = o.select("domain", "position", code.alias("object_code"), name.alias("object_name"), "cluster_size", "samples", F.array(F.when(key % 3 == 0, "PROMO").otherwise("none")).alias("synonyms"))
    return ex.settle(rows, lambda n: tx.is_garbage(n, [])).select("domain", "object_code", "object_name", F.coalesce("absorbed_by", F.lit("")).alias("absorbed_by"), "cluster_size", F.array_join("samples", "/").alias("samples"))
