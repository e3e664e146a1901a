"""Registered queries: seeds, totals, merge targets, cross-dataset canonical texts, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.operators import maintenance as mt
from ferrule.operators import relations as rl
from ferrule.operators import vector as ve

from .bindings import objects, relations, sql, table
from .mining import CENTRE, UNIT, vectors

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


@query(sql("""SELECT object_id, stage, CAST(DATE '2024-01-01' + CAST(object_id % 30 * 7 + gap AS INTEGER) AS DATE) AS entered, CAST(DATE '2024-01-01' + CAST(object_id % 30 * 7 + until AS INTEGER) AS DATE) AS exited
 FROM objects, (VALUES ('PLANNING', 0, 60), ('DESIGN', 60, 150), ('CONSTRUCTION', 150, 330), ('OPERATION', 330, NULL)) s(stage, gap, until)"""))
def lifecycle_seed(spark, sf_dir):
    return mt.seed_lifecycle(objects(spark, sf_dir), "2024-01-01")


@query("SELECT r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 99, 'NEW'")
def seed_defaults(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    once = mt.seed_missing(r, spark.createDataFrame([(0, "ignored"), (99, "NEW")], "id int, name string"), ["id"])
    return mt.seed_missing(once, spark.createDataFrame([(99, "again")], "id int, name string"), ["id"])


@query(sql("SELECT (SELECT count(*) FROM region) AS domains, count(DISTINCT domain) AS extracted, count(DISTINCT object_id) AS objects, count(layer) AS relations FROM objects LEFT JOIN relations USING (object_id) WHERE domain <> 'ASIA'"))
def overall_stats(spark, sf_dir):
    stats = rl.domain_stats(objects(spark, sf_dir), relations(spark, sf_dir)).where("domain <> 'ASIA'")
    return mt.overall(table(spark, sf_dir, "region").select(F.col("r_name").alias("domain")), stats)


MEAN = "(SELECT count(*) / 10.0 FROM embeddings)"


@query(f"""WITH {CENTRE}, n AS (SELECT label, count(*) AS n FROM u GROUP BY label), s AS (SELECT a.label AS source, b.label AS target, round(list_dot_product(a.c, b.c), 6) AS similarity FROM cu a JOIN n x ON x.label = a.label AND x.n < {MEAN} JOIN cu b ON true JOIN n y ON y.label = b.label AND y.n >= {MEAN})
SELECT source, target, similarity FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, target) AS r FROM s) WHERE r = 1""")
def centroid_merge_targets(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return mt.merge_targets(v, -(-v.count() // 10))


@query("""WITH c AS (SELECT 'a' AS dataset, 'Name' AS attribute, p_name AS raw FROM part UNION ALL SELECT 'b', 'NAME', p_name FROM part WHERE p_partkey % 3 = 0),
k AS (SELECT lower(attribute) AS name, dataset, attribute, raw, count(*) AS freq, lower(attribute) || '|' || split_part(raw, ' ', 1) AS cluster FROM c GROUP BY ALL),
t AS (SELECT cluster, raw, sum(freq) AS f FROM k GROUP BY ALL), canon AS (SELECT cluster, raw AS canonical_text FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY f DESC, length(raw), raw) AS r FROM t) WHERE r = 1)
SELECT dataset, attribute, canonical_text, count(DISTINCT raw) AS cluster_size, sum(freq) AS freq FROM k JOIN canon USING (cluster) GROUP BY cluster, dataset, attribute, canonical_text""")
def cross_dataset_canon(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    one = lambda d, a, m: p.where(F.col("p_partkey") % m == 0).select(F.lit(d).alias("dataset"), F.lit(a).alias("attribute"), F.col("p_name").alias("raw"))
    return mt.global_canon(one("a", "Name", 1).unionByName(one("b", "NAME", 3)), F.split("raw", " ")[0])


@query(f"""WITH {UNIT}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
 SELECT q.id AS query_id, x.id, round(list_dot_product(q.v, x.v), 6) AS score FROM u q JOIN u x ON q.id <> x.id WHERE q.id % 50 = 0)) WHERE rank <= 3)
SELECT query_id, string_agg(p_name, chr(10) ORDER BY rank) AS context FROM r JOIN part ON p_partkey = r.id GROUP BY query_id""")
def retrieval_context(spark, sf_dir):
    v = vectors(spark, sf_dir)
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return mt.retrieve(ve.nearest(v, v.where("id % 50 = 0"), 3), texts, 3)


@query("SELECT user_id AS batch_id, min(CAST(ts AS TIMESTAMP)) AS started, count(*) AS objects FROM events GROUP BY user_id ORDER BY started DESC, batch_id LIMIT 50")
def batch_list(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("batch_id"), F.col("ts").cast("timestamp").alias("ts"))
    return mt.batches(e)
