"""Registered queries: duplicates, merges, graphs, cross-domain fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import text as tx
from ferrule.operators import dedup as dd
from ferrule.operators import graph as gr
from ferrule.operators import relations as rl
from ferrule.operators.eav import number_rows

from .bindings import local_objects, objects, relations, sql, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


JAC = "round(CAST(len(list_intersect(s.samples, t.samples)) AS DOUBLE) / (len(s.samples) + len(t.samples) - len(list_intersect(s.samples, t.samples))), 4)"
TARGETS = f"""targets AS (SELECT *, CAST(row_number() OVER (PARTITION BY domain, small_code ORDER BY similarity DESC, target_code) AS INTEGER) AS rank FROM (
 SELECT s.domain, s.object_code AS small_code, t.object_code AS target_code, {JAC} AS similarity FROM local_objects s JOIN local_objects t ON s.domain = t.domain AND s.cluster_size < 3 AND t.cluster_size >= 3) WHERE similarity > 0)"""


@query(sql("SELECT * FROM targets WHERE rank <= 5", TARGETS))
def small_objects(spark, sf_dir):
    return dd.small_with_targets(local_objects(spark, sf_dir), 3, 5)


@query(sql("SELECT domain, small_code, target_code, similarity FROM targets WHERE rank = 1", TARGETS))
def bulk_merge_plan(spark, sf_dir):
    return dd.small_with_targets(local_objects(spark, sf_dir), 3, 1).drop("rank")


GRAMS = "[x FOR x IN list_distinct(list_concat([{0}[i:i+1] FOR i IN range(1, length({0}))], [{0}[i:i+2] FOR i IN range(1, length({0}) - 1)])) IF NOT regexp_matches(x, '[-0-9_()（）、，。 ]')]"
NAMES = "names AS (SELECT p_partkey AS id, 'P' || (p_partkey // 2) AS code, p_name AS name FROM part), g AS (SELECT *, " + GRAMS.format("name") + " AS g FROM names), decided AS (SELECT doc_id AS a, doc_id + 1 AS b FROM labels WHERE quality = 1)"
SIM = "round(CAST(len(list_intersect(x.g, y.g)) AS DOUBLE) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))), 4)"


def names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("P"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("code"), F.col("p_name").alias("name"))


@query(f"""WITH {NAMES}, k AS (SELECT id, code, name, min(id) OVER (PARTITION BY code) AS c, min(id) OVER (PARTITION BY name) AS n, count(*) OVER (PARTITION BY code) AS nc, count(*) OVER (PARTITION BY name) AS nn, count(*) OVER (PARTITION BY code, name) AS ncn FROM names),
d AS (SELECT x.id AS a, y.id AS b, x.code = y.code AS same_code, x.name = y.name AS same_name, least(x.n, y.n) AS lo, greatest(x.n, y.n) AS hi FROM (SELECT DISTINCT a, b FROM decided) JOIN k x ON x.id = a JOIN k y ON y.id = b),
e AS (SELECT id, count(*) FILTER (WHERE same_code) AS dc, count(*) FILTER (WHERE same_name AND NOT same_code) AS dn FROM (SELECT a AS id, same_code, same_name FROM d UNION ALL SELECT b, same_code, same_name FROM d) GROUP BY id),
m AS (SELECT k.*, coalesce(dc, 0) AS dc, coalesce(dn, 0) AS dn FROM k LEFT JOIN e USING (id)),
t AS (SELECT name, g, min(id) AS n, count(*) AS size FROM g GROUP BY ALL),
s AS (SELECT x.n AS lo, y.n AS hi, x.size * y.size AS links, {SIM} AS similarity FROM t x JOIN t y ON x.n < y.n),
o AS (SELECT x.n AS lo, y.n AS hi, sum(x.size * y.size) AS same FROM (SELECT code, n, count(*) AS size FROM k GROUP BY ALL) x JOIN (SELECT code, n, count(*) AS size FROM k GROUP BY ALL) y ON x.code = y.code AND x.n < y.n GROUP BY ALL),
f AS (SELECT lo, hi, count(*) AS gone FROM d WHERE NOT same_code AND NOT same_name GROUP BY ALL)
SELECT * FROM (SELECT c AS id, id AS other, 'EXACT_CODE' AS match_type, 1.0 AS similarity, nc - 1 - dc AS links FROM m WHERE c <> id
 UNION ALL SELECT n, id, 'EXACT_NAME', 0.95, nn - ncn - dn FROM m WHERE n <> id
 UNION ALL SELECT lo, hi, 'SEMANTIC', similarity, CAST(links - coalesce(same, 0) - coalesce(gone, 0) AS BIGINT) FROM s LEFT JOIN o USING (lo, hi) LEFT JOIN f USING (lo, hi) WHERE similarity >= 0.6) WHERE links > 0""")
def duplicate_candidates(spark, sf_dir):
    decided = table(spark, sf_dir, "labels").where("quality = 1").select((F.col("doc_id") + 1).alias("a"), F.col("doc_id").alias("b"))
    return dd.duplicates(names(spark, sf_dir), decided, 0.6)


@query(f"WITH {NAMES} SELECT id, min(id) OVER (PARTITION BY code) AS code_class, min(id) OVER (PARTITION BY name) AS name_class FROM names")
def duplicate_members(spark, sf_dir):
    """Which class of equal codes, and of equal names, each part is in."""
    return dd.duplicate_classes(names(spark, sf_dir))


@query("WITH n AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT name, " + GRAMS.format("name") + f" AS g FROM n) SELECT x.name AS a, y.name AS b, {SIM} AS similarity FROM g x JOIN g y ON x.name < y.name WHERE len(list_intersect(x.g, y.g)) > 0")
def keyword_jaccard(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("id", F.col("name"))
    return dd.gram_pairs(n, n, True).select(F.col("id").alias("a"), F.col("other").alias("b"), "similarity")


@query(sql("SELECT object_name, count(DISTINCT domain) AS domains, string_agg(DISTINCT domain, ',' ORDER BY domain) AS members, sum(cluster_size) AS total FROM local_objects GROUP BY object_name HAVING count(DISTINCT domain) >= 2"))
def cross_domain_duplicates(spark, sf_dir):
    d = local_objects(spark, sf_dir).groupBy("object_name").agg(F.count_distinct("domain").alias("domains"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("members"), F.sum("cluster_size").alias("total"))
    return d.where("domains >= 2")


@query(sql("SELECT object_code AS key, count(*) AS size, sum(cluster_size) AS total, max(cluster_size) AS largest, arg_max(domain, (cluster_size, domain)) AS largest_domain FROM local_objects GROUP BY object_code ORDER BY size DESC, key"))
def literal_groups(spark, sf_dir):
    return local_objects(spark, sf_dir).groupBy(F.col("object_code").alias("key")).agg(F.count(F.lit(1)).alias("size"), F.sum("cluster_size").alias("total"), F.max("cluster_size").alias("largest"), F.max_by("domain", F.struct("cluster_size", "domain")).alias("largest_domain")).orderBy(F.desc("size"), "key")


@query(sql("""WITH k AS (SELECT object_code, count(*) AS size FROM local_objects GROUP BY object_code) SELECT count(*) AS groups, count(*) FILTER (WHERE size >= 2) AS cross_domain, round(CAST(count(*) FILTER (WHERE size >= 2) AS DOUBLE) / count(*) * 100, 1) AS ratio, max(size) AS largest FROM k"""))
def global_summary(spark, sf_dir):
    k = local_objects(spark, sf_dir).groupBy("object_code").agg(F.count(F.lit(1)).alias("size"))
    cross = F.count_if(F.col("size") >= 2)
    return k.agg(F.count(F.lit(1)).alias("groups"), cross.alias("cross_domain"), rl.ratio(cross, F.count(F.lit(1))).alias("ratio"), F.max("size").alias("largest"))


@query(sql("""SELECT object_id, layer, count(*) AS n, round(sum(strength), 4) AS strength, count(method) AS merged FROM (
 SELECT object_id, layer, strength, NULL AS method FROM relations WHERE object_id <> 6 UNION ALL SELECT 7, layer, round(strength * 0.9, 4), 'MERGE' FROM relations WHERE object_id = 6) GROUP BY ALL"""))
def merge_objects(spark, sf_dir):
    rows = dd.merge(relations(spark, sf_dir).withColumn("method", F.lit(None).cast("string")), 6, 7)
    return rows.groupBy("object_id", "layer").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("strength"), 4).alias("strength"), F.count("method").alias("merged"))


@query(sql("""SELECT object_id, layer, count(*) AS n, round(sum(s), 4) AS strength FROM (SELECT object_id, layer, entity_name, max(s) AS s FROM (
 SELECT CASE WHEN object_id % 2 = 1 AND object_id < 10 THEN object_id - 1 ELSE object_id END AS object_id, layer, entity_name, CASE WHEN object_id % 2 = 1 AND object_id < 10 THEN round(strength * 0.9, 4) ELSE strength END AS s FROM relations) GROUP BY ALL) GROUP BY ALL"""))
def merge_plan_applied(spark, sf_dir):
    plan = objects(spark, sf_dir).where("object_id % 2 = 1 and object_id < 10").select(F.col("object_id").alias("source"), (F.col("object_id") - 1).alias("target"))
    return dd.merge_all(relations(spark, sf_dir), plan).groupBy("object_id", "layer").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("strength"), 4).alias("strength"))


@query("SELECT doc_id AS a, doc_id + 1 AS b, CASE doc_id % 3 WHEN 0 THEN 'MERGED' WHEN 1 THEN 'LINKED' ELSE 'IGNORED' END AS status FROM labels")
def dedup_decisions(spark, sf_dir):
    key = F.col("doc_id")
    labels = table(spark, sf_dir, "labels")
    old = labels.where("doc_id % 2 = 0").select(key.alias("a"), (key + 1).alias("b"), F.lit("IGNORED").alias("status"))
    action = F.when(key % 3 == 0, "merge").when(key % 3 == 1, "link").otherwise("ignore")
    request = labels.select(key.alias("a"), (key + 1).alias("b"), action.alias("action"), F.lit("C").alias("code"), F.lit("D").alias("domain"))
    return dd.decide(old, spark.createDataFrame([], "object_id long, synonym string"), request)[0]


@query("SELECT DISTINCT n_nationkey AS object_id, 'OBJ_' || n_name || '@' || r_name AS synonym FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0")
def dedup_link(spark, sf_dir):
    o = objects(spark, sf_dir)
    request = o.select(F.col("object_id").cast("int").alias("a"), F.lit(-1).alias("b"), F.when(F.col("object_id") % 3 == 0, "link").otherwise("ignore").alias("action"), F.col("object_code").alias("code"), "domain")
    none = spark.createDataFrame([], "a int, b int, status string")
    return dd.decide(none, spark.createDataFrame([], "object_id int, synonym string"), request)[1]


@query(sql("SELECT object_id, object_name AS old_name, lower(object_name) AS new_name FROM objects WHERE object_id % 4 = 0"))
def rename_history(spark, sf_dir):
    o = objects(spark, sf_dir)
    new = F.when(F.col("object_id") % 4 == 0, F.lower("object_name")).otherwise(F.col("object_name"))
    return dd.rename(o, spark.createDataFrame([], "object_id long, old_name string, new_name string"), o.select("object_id", new.alias("new_name")))[1]


@query(sql("SELECT object_id, domain, object_name FROM objects WHERE domain <> 'ASIA' UNION ALL SELECT object_id, domain, object_name || '_v2' FROM objects WHERE domain = 'ASIA'"))
def domain_refresh(spark, sf_dir):
    o = objects(spark, sf_dir).select("object_id", "domain", "object_name")
    return dd.refresh_domain(o, o.withColumn("object_name", F.concat("object_name", F.lit("_v2"))), "ASIA")


@query(sql("SELECT CASE WHEN object_id % 5 = 0 THEN object_id + 100 ELSE object_id END AS object_id, object_name FROM objects"))
def upsert_objects(spark, sf_dir):
    o = objects(spark, sf_dir).select("object_id", "object_name")
    new = o.where("object_id % 5 = 0").withColumn("object_id", F.col("object_id") + 100)
    return dd.upsert(o, new, ["object_name"])


@query(sql("SELECT layer, count(*) AS n FROM relations WHERE object_id % 3 <> 1 GROUP BY layer"))
def cascade_delete(spark, sf_dir):
    o, r = objects(spark, sf_dir), relations(spark, sf_dir)
    return rl.counts_by(dd.cascade_delete(o, [r], o.where("object_id % 3 = 1"))[1], "layer")


@query(sql("""WITH ids AS (SELECT row_number() OVER (ORDER BY domain, object_name) AS object_id, domain, object_name FROM local_objects), keep AS (SELECT object_name, min(domain) AS keep_domain FROM local_objects WHERE object_name LIKE '%1' GROUP BY object_name)
SELECT coalesce(k.object_id, i.object_id) AS object_id, i.object_name AS name, i.domain AS entity FROM ids i LEFT JOIN (SELECT ids.* FROM ids JOIN keep ON ids.object_name = keep.object_name AND ids.domain = keep.keep_domain) k ON i.object_name = k.object_name"""))
def import_redirect(spark, sf_dir):
    lo = local_objects(spark, sf_dir).select("domain", F.col("object_name").alias("name"))
    ids = number_rows(lo, "domain", "name").withColumnRenamed("row_number", "object_id")
    keep = lo.where("name like '%1'").groupBy("name").agg(F.min("domain").alias("keep_domain"))
    return dd.redirect(lo.withColumn("entity", F.col("domain")), ids, keep)


@query("""WITH n AS (SELECT p_partkey AS object_id, split_part(p_name, ' ', 2) AS object_name, p_type AS better FROM part),
m AS (SELECT *, regexp_full_match(object_name, '[A-Za-z]{1,4}') AS bad FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY better ORDER BY object_id) + CASE WHEN better IN (SELECT object_name FROM m WHERE NOT bad) THEN 1 ELSE 0 END AS i FROM m WHERE bad)
SELECT object_id, CASE WHEN i > 1 THEN better || '_' || i ELSE better END AS object_name FROM k UNION ALL SELECT object_id, object_name FROM m WHERE NOT bad""")
def garbage_cleanup(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_id"), F.split("p_name", " ")[1].alias("object_name"), F.col("p_type").alias("better_name"))
    return dd.clean_names(n.drop("better_name"), tx.is_garbage(F.col("object_name"), []), n.select("object_id", "better_name"))


LOGICAL = "lc AS (SELECT object_id, via AS entity_name, count(DISTINCT entity_name) AS logical_count FROM relations WHERE layer = 'LOGICAL' GROUP BY ALL)"
CON = "con AS (SELECT object_id, entity_name, max(strength) AS strength FROM relations WHERE layer = 'CONCEPT' GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY strength DESC, entity_name) AS rank, count(*) OVER (PARTITION BY object_id) AS total FROM con)"


@query(sql("""SELECT object_code AS source, entity_name AS target, greatest(coalesce(logical_count, 0), 1) AS value FROM ranked JOIN objects USING (object_id) LEFT JOIN lc USING (object_id, entity_name) WHERE rank <= 3
 UNION ALL SELECT DISTINCT object_code, 'other ' || (total - 3), total - 3 FROM ranked JOIN objects USING (object_id) WHERE total > 3""", LOGICAL, CON))
def sankey(spark, sf_dir):
    r = relations(spark, sf_dir)
    return gr.sankey(objects(spark, sf_dir), r, rl.logical_per_concept(r))


@query(sql("SELECT object_code AS source, layer AS target, count(*) AS value FROM relations JOIN objects USING (object_id) GROUP BY ALL"))
def sankey_totals(spark, sf_dir):
    return gr.sankey_totals(objects(spark, sf_dir), relations(spark, sf_dir))


def _top(layer: str, k: int, extra: str = "object_id = 6", part: str = "object_id") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY strength DESC, entity_name) AS rank FROM (SELECT object_id, entity_name, via, max(strength) AS strength FROM relations WHERE layer = '{layer}' AND {extra} GROUP BY ALL)) WHERE rank <= {k})"


@query(sql(f"""SELECT o.object_code AS source, entity_name AS target, 'CONCEPT' AS layer, strength FROM {_top('CONCEPT', 15)} c, (SELECT object_code FROM objects WHERE object_id = 6) o
 UNION ALL SELECT CASE WHEN via IN (SELECT entity_name FROM {_top('CONCEPT', 15)}) THEN via ELSE object_code END, entity_name, 'LOGICAL', strength FROM {_top('LOGICAL', 20)}, (SELECT object_code FROM objects WHERE object_id = 6)
 UNION ALL SELECT CASE WHEN via IN (SELECT entity_name FROM {_top('LOGICAL', 20)}) THEN via ELSE object_code END, entity_name, 'PHYSICAL', strength FROM {_top('PHYSICAL', 30)}, (SELECT object_code FROM objects WHERE object_id = 6)"""))
def object_graph(spark, sf_dir):
    return gr.object_graph(objects(spark, sf_dir), relations(spark, sf_dir), 6)


@query(sql(f"""SELECT object_code AS id, 'object' AS kind, least(60, greatest(20, 2 * count(layer))) AS size FROM objects LEFT JOIN relations USING (object_id) GROUP BY object_code
 UNION ALL SELECT DISTINCT entity_name, 'concept', 10 FROM {_top('CONCEPT', 5, 'true')}"""))
def global_graph(spark, sf_dir):
    return gr.global_graph(objects(spark, sf_dir), relations(spark, sf_dir))


@query(sql(f"""WITH c AS {_top('CONCEPT', 8, 'true')}, l AS {_top('LOGICAL', 3, '(object_id, via) IN (SELECT (object_id, entity_name) FROM c)', 'object_id, via')}, p AS {_top('PHYSICAL', 2, '(object_id, via) IN (SELECT (object_id, entity_name) FROM l)', 'object_id, via')}
SELECT object_code AS source, entity_name AS target, 'CONCEPT' AS layer FROM c JOIN objects USING (object_id) UNION ALL SELECT via, entity_name, 'LOGICAL' FROM l UNION ALL SELECT via, entity_name, 'PHYSICAL' FROM p"""))
def three_tier_graph(spark, sf_dir):
    return gr.three_tier(objects(spark, sf_dir), relations(spark, sf_dir))
