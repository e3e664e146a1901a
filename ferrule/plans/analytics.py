"""Registered queries: statistics, listings, governance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import governance as g
from ferrule.operators import relations as r

from .bindings import local_objects, objects, relations, sql, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def both(spark, sf_dir):
    return objects(spark, sf_dir), relations(spark, sf_dir)


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, attribute: objects with a supplier in debt have none."""
    s = table(spark, sf_dir, "supplier")
    return s.groupBy(F.col("s_nationkey").cast("long").alias("object_id")).agg(F.min("s_acctbal").alias("low"), F.min("s_name").alias("attribute")).where("low > -900").select("object_id", "attribute")


ATTR = "attributes AS (SELECT CAST(s_nationkey AS BIGINT) AS object_id, min(s_name) AS attribute FROM supplier GROUP BY 1 HAVING min(s_acctbal) > -900)"
PER = """per AS (
  SELECT object_id, count(DISTINCT entity_name) FILTER (WHERE layer = 'CONCEPT') AS c, count(DISTINCT entity_name) FILTER (WHERE layer = 'LOGICAL') AS l,
         count(DISTINCT entity_name) FILTER (WHERE layer = 'PHYSICAL') AS p, count(DISTINCT entity_name) AS t, count(*) AS n, avg(strength) AS a
  FROM relations GROUP BY object_id
), counts AS (SELECT o.*, coalesce(c, 0) AS c, coalesce(l, 0) AS l, coalesce(p, 0) AS p, coalesce(t, 0) AS t, coalesce(n, 0) AS n, a FROM objects o LEFT JOIN per USING (object_id))"""


@query(sql("SELECT object_code, object_name, domain, c AS concept_entity_count, l AS logical_entity_count, p AS physical_entity_count, t AS total_entity_count, n AS relation_count, round(a, 4) AS avg_strength FROM counts", PER))
def relation_stats(spark, sf_dir):
    return r.relation_stats(*both(spark, sf_dir))


@query(sql("SELECT domain, count(DISTINCT object_id) AS object_count, count(layer) AS relation_count, round(avg(strength), 4) AS avg_strength, string_agg(DISTINCT object_type, ',' ORDER BY object_type) AS types FROM objects LEFT JOIN relations USING (object_id) GROUP BY domain"))
def domain_stats(spark, sf_dir):
    return r.domain_stats(*both(spark, sf_dir))


@query(sql("""SELECT object_code, object_name, domain, object_type, count(*) FILTER (WHERE layer = 'CONCEPT') AS concept_count,
 count(*) FILTER (WHERE layer = 'LOGICAL') AS logical_count, count(*) FILTER (WHERE layer = 'PHYSICAL') AS physical_count
 FROM objects LEFT JOIN relations USING (object_id) GROUP BY ALL"""))
def object_layer_counts(spark, sf_dir):
    return r.layer_counts(*both(spark, sf_dir))


@query(sql("""SELECT object_id, layer, entity_name, via, strength, rank FROM (
 SELECT *, CAST(row_number() OVER (PARTITION BY object_id, layer ORDER BY strength DESC, entity_name, via NULLS FIRST) AS INTEGER) AS rank
 FROM (SELECT object_id, layer, entity_name, via, max(strength) AS strength FROM relations GROUP BY ALL)) WHERE rank <= 5"""))
def object_relations_topk(spark, sf_dir):
    return r.top_relations(relations(spark, sf_dir), 5)


@query(sql("""SELECT c.object_id, c.entity_name, count(DISTINCT l.entity_name) AS logical_count
 FROM (SELECT DISTINCT object_id, entity_name FROM relations WHERE layer = 'CONCEPT') c
 LEFT JOIN relations l ON l.layer = 'LOGICAL' AND l.object_id = c.object_id AND l.via = c.entity_name GROUP BY ALL"""))
def concept_logical_counts(spark, sf_dir):
    return r.logical_per_concept(relations(spark, sf_dir))


@query(sql("""SELECT (SELECT count(*) FROM objects) AS total_objects, (SELECT count(DISTINCT domain) FROM objects) AS total_domains, count(*) AS total_relations,
 count(*) FILTER (WHERE layer = 'CONCEPT') AS concept_relations, count(*) FILTER (WHERE layer = 'LOGICAL') AS logical_relations,
 count(*) FILTER (WHERE layer = 'PHYSICAL') AS physical_relations, round(avg(strength), 4) AS avg_strength FROM relations"""))
def system_stats(spark, sf_dir):
    return r.system_stats(*both(spark, sf_dir))


@query(sql("SELECT object_code, object_name, count(*) AS relation_count FROM objects JOIN relations USING (object_id) GROUP BY ALL ORDER BY 3 DESC, 1 LIMIT 5"))
def summary_top_objects(spark, sf_dir):
    return r.top_objects(*both(spark, sf_dir))


@query(sql("SELECT relation_type, count(*) AS n FROM relations GROUP BY 1"))
def relation_type_counts(spark, sf_dir):
    return r.counts_by(relations(spark, sf_dir), "relation_type")


@query(sql("SELECT layer, count(*) AS n FROM relations GROUP BY 1"))
def layer_totals(spark, sf_dir):
    return r.counts_by(relations(spark, sf_dir), "layer")


@query(sql("SELECT entity_name, entity_code, layer FROM (SELECT DISTINCT entity_name, entity_code, layer FROM relations WHERE contains(lower(entity_name), '#0000001')) ORDER BY layer, entity_name, entity_code LIMIT 500"))
def entity_search(spark, sf_dir):
    return r.search(relations(spark, sf_dir), "#0000001")


@query(sql("SELECT * FROM objects WHERE domain IN ('ASIA', 'EUROPE')"))
def multi_domain_filter(spark, sf_dir):
    return r.in_domains(objects(spark, sf_dir), " ASIA, EUROPE ,")


@query(sql("SELECT domain, max(cluster_size) AS max_size, min(cluster_size) AS min_size, round(avg(cluster_size), 4) AS avg_size, count(*) FILTER (WHERE cluster_size < 3) AS small_objects, count(*) AS objects FROM local_objects GROUP BY domain"))
def granularity_report(spark, sf_dir):
    return r.granularity_summary(local_objects(spark, sf_dir))


@query(sql("SELECT domain, object_code, cluster_size, CASE WHEN cluster_size <= 3 THEN 'SMALL' WHEN cluster_size >= 20 THEN 'LARGE' ELSE 'NORMAL' END AS severity FROM local_objects"))
def severity_bucket(spark, sf_dir):
    return r.granularity(local_objects(spark, sf_dir))


@query(sql("SELECT object_id, coalesce(subdomain, 'OTHER') AS subdomain, count(*) AS n_fields, string_agg(DISTINCT entity_name, ',' ORDER BY entity_name) AS fields FROM relations WHERE layer = 'CONCEPT' GROUP BY 1, 2"))
def object_fields(spark, sf_dir):
    return r.fields_by_subdomain(relations(spark, sf_dir))


@query(sql("SELECT object_code, domain, c AS concept_count, l AS logical_count, p AS physical_count, CASE WHEN least(c, l, p) > 0 THEN 'COMPLETE' WHEN greatest(c, l, p) = 0 THEN 'EMPTY' ELSE 'PARTIAL' END AS status FROM counts", PER))
def completeness(spark, sf_dir):
    return g.completeness(*both(spark, sf_dir))


@query(sql("""SELECT object_code, 'MISSING_LAYER' AS defect_type, 'HIGH' AS severity, CASE WHEN c = 0 THEN 'CONCEPT' WHEN l = 0 THEN 'LOGICAL' ELSE 'PHYSICAL' END AS detail FROM counts WHERE least(c, l, p) = 0
 UNION ALL SELECT object_code, 'WEAK_RELATION', 'MEDIUM', entity_name FROM objects JOIN relations USING (object_id) WHERE layer = 'CONCEPT' AND strength < 0.5
 UNION ALL SELECT object_code, 'NO_ATTRIBUTES', 'LOW', '' FROM objects WHERE object_id NOT IN (SELECT object_id FROM attributes)""", PER, ATTR))
def defects(spark, sf_dir):
    return g.defects(*both(spark, sf_dir), attributes(spark, sf_dir))


@query(sql("""SELECT object_code, CASE WHEN c = 0 THEN 'MISSING_CONCEPT' WHEN l = 0 THEN 'MISSING_LOGICAL' WHEN p = 0 THEN 'MISSING_PHYSICAL' WHEN round(a, 6) < 0.6 THEN 'WEAK' ELSE 'OK' END AS verdict,
 CASE WHEN least(c, l, p) > 0 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS completeness FROM counts""", PER))
def defects_single(spark, sf_dir):
    return g.single_status(*both(spark, sf_dir))


@query(sql("""SELECT count(*) FILTER (WHERE least(c, l, p) > 0) AS complete_objects, count(*) FILTER (WHERE least(c, l, p) = 0 AND greatest(c, l, p) > 0) AS partial_objects,
 count(*) FILTER (WHERE greatest(c, l, p) = 0) AS empty_objects, count(*) AS total_objects, any_value(r.total_relations) AS total_relations, any_value(strong) AS strong_relations,
 any_value(weak) AS weak_relations, any_value(a4) AS avg_strength, any_value(w) AS with_attributes,
 round(CAST(count(*) FILTER (WHERE least(c, l, p) > 0) AS DOUBLE) / count(*) * 100, 1) AS completeness_rate, round(CAST(any_value(strong) AS DOUBLE) / any_value(r.total_relations) * 100, 1) AS strong_rate,
 round(CAST(any_value(w) AS DOUBLE) / count(*) * 100, 1) AS attribute_coverage
 FROM counts, (SELECT count(*) AS total_relations, count(*) FILTER (WHERE strength >= 0.8) AS strong, count(*) FILTER (WHERE strength < 0.5) AS weak, round(avg(strength), 4) AS a4 FROM relations) r,
 (SELECT count(*) AS w FROM objects WHERE object_id IN (SELECT object_id FROM attributes))""", PER, ATTR))
def governance_metrics(spark, sf_dir):
    return g.metrics(*both(spark, sf_dir), attributes(spark, sf_dir))


@query(sql("""SELECT object_code, string_agg(domain, ',' ORDER BY domain) AS present_in,
 coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT domain AS x FROM local_objects) WHERE NOT list_contains(list(p.domain), x)), '') AS missing_in,
 count(*) || '/' || any_value(m) AS coverage, count(*) = any_value(m) AS consistent, round(CAST(count(*) AS DOUBLE) / any_value(m) * 100, 1) AS rate
 FROM (SELECT DISTINCT object_code, domain FROM local_objects) p, (SELECT count(DISTINCT domain) AS m FROM local_objects) GROUP BY object_code"""))
def domain_comparison(spark, sf_dir):
    return g.domain_consistency(local_objects(spark, sf_dir))


#: Endings of the parts' names; the default of suffix_noise has none of them.
PART_SUFFIXES = ["ring", "rod", "widget", "gizmo"]
SUFFIX_CASE = "CASE " + " ".join(f"WHEN p_name LIKE '%{s}' AND length(p_name) > {len(s) + 1} THEN '{s}'" for s in PART_SUFFIXES) + " END"


@query(f"SELECT p_brand, count(*) AS n, count(s) AS noisy, round(CAST(count(s) AS DOUBLE) / count(*) * 100, 1) AS ratio, count(s) > 0.6 * count(*) AS flagged FROM (SELECT p_brand, {SUFFIX_CASE} AS s FROM part) GROUP BY p_brand")
def field_noise_report(spark, sf_dir):
    rows = g.suffix_noise(table(spark, sf_dir, "part"), "p_name", PART_SUFFIXES).groupBy("p_brand")
    n, noisy = F.count(F.lit(1)), F.count("suffix")
    return rows.agg(n.alias("n"), noisy.alias("noisy"), r.ratio(noisy, n).alias("ratio"), (noisy > 0.6 * n).alias("flagged"))


@query(f"SELECT s AS suffix, count(*) AS n FROM (SELECT {SUFFIX_CASE} AS s FROM part) WHERE s IS NOT NULL GROUP BY s")
def suffix_histogram(spark, sf_dir):
    return r.counts_by(g.suffix_noise(table(spark, sf_dir, "part"), "p_name", PART_SUFFIXES).where("suffix is not null"), "suffix")
