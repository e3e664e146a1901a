"""Registered queries: vectors, clustering and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.operators import clustering as cl
from ferrule.operators import embed as em
from ferrule.operators import extract as ex
from ferrule.operators import fusion as fu
from ferrule.operators import vector as ve

from ferrule.session import shared_path

from .bindings import local_objects, sql, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("int").alias("label"))


UNIT = "u AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / (sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))) + 1e-12)) AS v FROM embeddings)"


@query(f"""WITH {UNIT} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
 SELECT q.id AS query_id, x.id, round(list_dot_product(q.v, x.v), 6) AS score FROM u q JOIN u x ON q.id <> x.id WHERE q.id % 50 = 0)) WHERE rank <= 10""")
def vector_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return ve.nearest(v, v.where("id % 50 = 0"), 10)


EDGES = f"{UNIT}, edges AS (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.id < y.id WHERE list_dot_product(x.v, y.v) >= 0.4)"
REACH = f"{EDGES}, reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT e.b, r FROM reach JOIN edges e ON reach.id = e.a UNION SELECT e.a, r FROM reach JOIN edges e ON reach.id = e.b), comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"


@query(f"WITH {EDGES} SELECT a, b FROM edges")
def similar_pairs(spark, sf_dir):
    return ve.similar_pairs(vectors(spark, sf_dir), 0.4).select("a", "b")


@query("WITH RECURSIVE " + UNIT + """, edges AS (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.id <> y.id WHERE list_dot_product(x.v, y.v) >= 0.4),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT e.b, r FROM reach JOIN edges e ON reach.id = e.a) SELECT id, min(r) AS component FROM reach GROUP BY id""")
def radius_components(spark, sf_dir):
    return ve.radius_components(vectors(spark, sf_dir), 0.4)


@query("""WITH c AS (SELECT p_brand AS cluster, p_name AS text, count(*) AS freq FROM part GROUP BY ALL) SELECT cluster, text AS canonical_text FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY freq DESC, length(text), text) AS r FROM c) WHERE r = 1""")
def canonical_choice(spark, sf_dir):
    c = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("cluster"), F.col("p_name").alias("text")).agg(F.count(F.lit(1)).alias("freq"))
    return ve.canonical(c)


CENTRE = f"""{UNIT}, cells AS (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u), m AS (SELECT label, i, avg(x) AS x FROM cells GROUP BY ALL),
cen AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label), cu AS (SELECT label, list_transform(c, lambda x: x / (sqrt(list_sum(list_transform(c, lambda y: y * y))) + 1e-12)) AS c FROM cen),
sim AS (SELECT id, u.label, list_dot_product(v, c) AS s FROM u JOIN cu USING (label))"""


@query(f"WITH {CENTRE} SELECT id, label, round(s, 6) AS similarity FROM sim")
def centroid_similarity(spark, sf_dir):
    return ve.member_similarity(vectors(spark, sf_dir), "label").withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {CENTRE} SELECT label, id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, id) AS rank FROM sim) WHERE rank <= 20")
def medoid_samples(spark, sf_dir):
    return ve.medoid_samples(vectors(spark, sf_dir), "label", 20)


@query(f"WITH {UNIT} SELECT a.label, any_value(n) AS n, round(avg(list_dot_product(a.v, b.v)), 6) AS mean_similarity FROM u a JOIN u b ON a.label = b.label AND a.id <> b.id JOIN (SELECT label, count(*) AS n FROM u GROUP BY label) k ON k.label = a.label GROUP BY a.label")
def intra_similarity(spark, sf_dir):
    return ve.intra_similarity(vectors(spark, sf_dir), "label")


@query("""WITH t AS (SELECT p_name AS id, ' ' || unnest(string_split(p_name, ' ')) || ' ' AS w FROM (SELECT DISTINCT p_name FROM part)),
g AS (SELECT id, unnest(list_concat(list_concat([w[i:i+1] FOR i IN range(1, length(w))], [w[i:i+2] FOR i IN range(1, length(w) - 1)]), [w[i:i+3] FOR i IN range(1, length(w) - 2)])) AS gram FROM t),
tf AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram), n AS (SELECT count(DISTINCT p_name) AS n FROM part),
w AS (SELECT id, gram, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (gram), n), l AS (SELECT id, sqrt(sum(w * w)) AS l FROM w GROUP BY id)
SELECT id, gram, round(w / l, 6) AS weight FROM w JOIN l USING (id)""")
def tfidf_vectors(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), F.col("p_name").alias("text")).distinct()
    return ve.tfidf(names)


@query()
def agglomerative(spark, sf_dir):
    return cl.agglomerate(vectors(spark, sf_dir), "label", 15)


@query()
def split_oversized(spark, sf_dir):
    v = vectors(spark, sf_dir)
    tree = cl.tree_of(v, "label")
    return cl.split_oversized(cl.agglomerate(v, "label", 2, tree=tree), v, "label", tree=tree)


@query()
def semantic_groups(spark, sf_dir):
    return cl.agglomerate(vectors(spark, sf_dir).withColumn("label", F.lit(0)), "label", distance=0.15)


@query("SELECT 1 AS run, count(DISTINCT p_name) AS embedded, count(*) AS with_vector FROM part UNION ALL SELECT 2, 0, count(*) FROM part UNION ALL SELECT 3, (SELECT count(DISTINCT p_type) FROM part WHERE p_type NOT IN (SELECT p_name FROM part)), count(*) FROM part")
def embedding_store(spark, sf_dir):
    """Names of parts embedded, the same again, then their types: what the model saw in each run."""
    store, part = shared_path(spark, "embeddings"), table(spark, sf_dir, "part")
    out = None
    for run, column in enumerate(["p_name", "p_name", "p_type"], 1):
        rows, n = em.embed(part.select(F.col(column).alias("text")), store)
        one = rows.select(F.lit(run).alias("run"), F.lit(n).cast("long").alias("embedded"), F.col("vector").isNotNull().alias("v")).groupBy("run", "embedded").agg(F.count_if("v").alias("with_vector"))
        out = one if out is None else out.unionByName(one)
    return out


def embedded_objects(spark, sf_dir) -> DataFrame:
    """Local objects with a number and the default vector of their text; an object's description is its domain."""
    rows = local_objects(spark, sf_dir).withColumn("id", F.xxhash64("domain", "object_name"))
    text = fu.object_text(F.col("object_name"), F.col("domain"), F.col("samples"))
    return em.embed(rows.withColumn("text", text), shared_path(spark, "embeddings"))[0].withColumn("v", F.col("vector").cast("array<double>"))


@query()
def semantic_object_groups(spark, sf_dir):
    """Objects of all domains grouped by meaning, with representative, aliases and mean similarity."""
    return fu.semantic_groups(embedded_objects(spark, sf_dir))[0].select("group_id", "repr_name", F.array_join("aliases", "/").alias("aliases"), F.array_join("domains", ",").alias("domains"), "members", "total_size", "avg_similarity")


@query()
def joint_sample_groups(spark, sf_dir):
    """Samples of all objects clustered jointly."""
    return fu.sample_groups(local_objects(spark, sf_dir))[0].select("group_id", "repr_name", "size", "samples", F.array_join("domains", ",").alias("domains"), "avg_similarity")


@query("""WITH c AS (SELECT 'a' AS dataset, 'Name' AS attribute, p_name AS raw FROM part UNION ALL SELECT 'b', 'NAME', p_name FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'b', 'type', p_type FROM part),
k AS (SELECT lower(attribute) AS pool, dataset, attribute, raw, count(*) AS freq FROM c GROUP BY ALL) SELECT dataset, attribute, raw AS canonical_text, 1 AS cluster_size, freq FROM k""")
def cross_dataset_same(spark, sf_dir):
    """Texts pooled over datasets at a cosine that only equal ones reach."""
    p = table(spark, sf_dir, "part")
    one = lambda d, a, c, m: p.where(F.col("p_partkey") % m == 0).select(F.lit(d).alias("dataset"), F.lit(a).alias("attribute"), F.col(c).alias("raw"))
    cells = one("a", "Name", "p_name", 1).unionByName(one("b", "NAME", "p_name", 3)).unionByName(one("b", "type", "p_type", 1))
    return fu.global_dedupe(cells, 0.99999, shared_path(spark, "embeddings"))[0]


@query()
def cross_dataset_semantic(spark, sf_dir):
    """Names of parts and types pooled over two datasets, alike from a cosine of 0.7 on."""
    p = table(spark, sf_dir, "part")
    one = lambda d, a, c: p.select(F.lit(d).alias("dataset"), F.lit(a).alias("attribute"), F.col(c).alias("raw"))
    cells = one("a", "Name", "p_name").unionByName(one("b", "NAME", "p_type")).unionByName(one("b", "brand", "p_brand"))
    return fu.global_dedupe(cells, 0.7, shared_path(spark, "embeddings"))[1]


KEYWORDS = [("ring", "OBJ_RING"), ("rod", "OBJ_ROD"), ("blue", "OBJ_BLUE"), ("widget", "OBJ_WIDGET"), ("steel", "OBJ_ROD"), ("hot", "OBJ_HEAT")]
WORDS = "k(keyword, object_code, position) AS (VALUES " + ", ".join(f"('{a}', '{b}', {i})" for i, (a, b) in enumerate(KEYWORDS)) + ")"


def keywords(spark):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(KEYWORDS)], "keyword string, object_code string, position int")


@query(f"WITH {WORDS}, e AS (SELECT p_name AS entity_name, CAST(max(p_partkey) AS VARCHAR) AS entity_code FROM part GROUP BY p_name) SELECT DISTINCT object_code, entity_name, entity_code, 0.8 AS strength FROM e JOIN k ON contains(entity_name, keyword)")
def keyword_extract(spark, sf_dir):
    e = table(spark, sf_dir, "part").select(F.col("p_name").alias("entity_name"), F.col("p_partkey").cast("string").alias("entity_code"), F.col("p_partkey").alias("row"))
    return ex.keyword_extract(e, keywords(spark))


def brand_clusters(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"), F.slice(F.array_sort(F.collect_set("p_name")), 1, 20).alias("samples"))


@query(f"""WITH {WORDS}, c AS (SELECT CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS cluster_id, count(*) AS size, list_sort(list(DISTINCT p_name))[1:20] AS samples FROM part GROUP BY 1),
h AS (SELECT cluster_id, size, object_code, count(*) AS hits, min(position) AS position FROM (SELECT cluster_id, size, unnest(samples) AS s FROM c) JOIN k ON contains(s, keyword) GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY hits DESC, position) AS r FROM h) WHERE r = 1)
SELECT cluster_id, object_code, hits, 0.7 AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY object_code ORDER BY size DESC, cluster_id) AS q FROM b) WHERE q = 1""")
def rule_naming(spark, sf_dir):
    return ex.rule_naming(brand_clusters(spark, sf_dir), keywords(spark))


@query("""WITH c AS (SELECT CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS cluster_id, p_name AS name FROM part),
g AS (SELECT cluster_id, unnest([x FOR x IN list_distinct(list_concat([name[i:i+1] FOR i IN range(1, length(name))], [name[i:i+2] FOR i IN range(1, length(name) - 1)])) IF NOT contains(x, ' ')]) AS gram FROM c),
f AS (SELECT cluster_id, gram, count(*) AS freq FROM g WHERE gram NOT IN ('in', 'er') GROUP BY ALL), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY freq DESC, gram) AS r FROM f) WHERE r = 1)
SELECT cluster_id, CASE WHEN freq >= 3 THEN gram ELSE 'OBJ__PENDING_MERGE_' || cluster_id END AS name, coalesce(freq, 0) AS freq, 0.5 AS confidence FROM (SELECT DISTINCT cluster_id FROM c) LEFT JOIN t USING (cluster_id)""")
def content_naming(spark, sf_dir):
    c = table(spark, sf_dir, "part").select(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("cluster_id"), F.col("p_name").alias("name"))
    return ex.content_naming(c, ["in", "er"])


def layers(spark, sf_dir):
    """members, concept-logical and logical-physical pairs over customers, orders and line items."""
    c, o, l = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    members = c.select(F.concat(F.lit("OBJ_"), "c_mktsegment").alias("object_code"), F.col("c_name").alias("concept"), (F.col("c_custkey") % 4 == 0).alias("is_sample"))
    cl = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("concept"), F.col("o_orderkey").cast("string").alias("logical"))
    lp = l.select(F.col("l_orderkey").cast("string").alias("logical"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("physical"))
    return members, cl, lp


@query("""SELECT layer, object_code, count(*) AS n, round(sum(strength), 4) AS strength FROM (
 SELECT 'CONCEPT' AS layer, 'OBJ_' || c_mktsegment AS object_code, CASE WHEN c_custkey % 4 = 0 THEN 0.9 ELSE 0.8 END AS strength FROM customer
 UNION ALL SELECT 'LOGICAL', 'OBJ_' || c_mktsegment, 0.7 FROM customer JOIN orders ON o_custkey = c_custkey
 UNION ALL SELECT 'PHYSICAL', 'OBJ_' || c_mktsegment, 0.6 FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY ALL""")
def hierarchical_relations(spark, sf_dir):
    rows = ex.hierarchical_relations(*layers(spark, sf_dir))
    return rows.groupBy("layer", "object_code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("strength").cast("decimal(10,4)")).cast("double"), 4).alias("strength"))


@query("SELECT p_name || '（推断）' AS entity_name, 'INFERRED_' || min(p_brand) AS entity_code FROM part GROUP BY p_name")
def infer_physical(spark, sf_dir):
    logical = table(spark, sf_dir, "part").select(F.col("p_name").alias("entity_name"), F.col("p_brand").alias("entity_code"))
    return ex.infer_physical(logical, spark.createDataFrame([], "entity_name string, entity_code string"))


BUSINESS = """biz AS (SELECT 'B' || (c_custkey % 7) AS business, c_name AS concept FROM customer), smp AS (SELECT 'OBJ_' || c_mktsegment AS object_code, c_name AS concept FROM customer WHERE c_custkey % 4 = 0),
h AS (SELECT object_code, business, count(*) AS hits FROM smp JOIN biz USING (concept) GROUP BY ALL), bm AS (SELECT object_code, business, round(CAST(hits AS DOUBLE) / max(hits) OVER (PARTITION BY object_code), 4) AS score FROM h)"""


def business(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    biz = c.select(F.concat(F.lit("B"), (F.col("c_custkey") % 7).cast("string")).alias("business"), F.col("c_name").alias("concept"))
    return biz, ex.business_match(layers(spark, sf_dir)[0].where("is_sample").select("object_code", "concept"), biz)


@query(f"WITH {BUSINESS} SELECT * FROM bm")
def business_match(spark, sf_dir):
    return business(spark, sf_dir)[1]


@query(f"""WITH {BUSINESS}, c AS (SELECT object_code, score, concept FROM bm JOIN biz USING (business)), l AS (SELECT object_code, score, CAST(o_orderkey AS VARCHAR) AS logical, o_orderkey FROM c JOIN customer ON c_name = concept JOIN orders ON o_custkey = c_custkey),
p AS (SELECT object_code, score, l_orderkey || '-' || l_linenumber AS physical FROM l JOIN lineitem ON l_orderkey = o_orderkey), r AS (
 SELECT object_code, 'CONCEPT' AS layer, concept AS entity_name, round(max(score) * 0.75, 4) AS strength FROM c GROUP BY ALL UNION ALL SELECT object_code, 'LOGICAL', logical, round(max(score) * 0.55, 4) FROM l GROUP BY ALL UNION ALL SELECT object_code, 'PHYSICAL', physical, round(max(score) * 0.45, 4) FROM p GROUP BY ALL)
SELECT object_code, layer, count(*) AS n, CAST(sum(CAST(strength AS DECIMAL(18, 4))) AS DOUBLE) AS strength FROM r WHERE NOT (layer = 'CONCEPT' AND (object_code, entity_name) IN (SELECT ('OBJ_' || c_mktsegment, c_name) FROM customer)) GROUP BY ALL""")
def bridged_relations(spark, sf_dir):
    members, cl, lp = layers(spark, sf_dir)
    biz, matches = business(spark, sf_dir)
    existing = members.select("object_code", F.lit("CONCEPT").alias("layer"), F.col("concept").alias("entity_name"))
    rows = ex.bridged_relations(matches, biz, cl, lp, existing)
    return rows.groupBy("object_code", "layer").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("strength").cast("decimal(18,4)")).cast("double").alias("strength"))


@query("""WITH r AS (SELECT 'OBJ_' || c_mktsegment AS object_code, 'CONCEPT' AS layer, CASE WHEN c_custkey % 3 = 0 THEN 'BRIDGE' ELSE 'CLUSTER' END AS method FROM customer UNION ALL SELECT 'OBJ_' || c_mktsegment, 'LOGICAL', 'CLUSTER' FROM customer JOIN orders ON o_custkey = c_custkey)
SELECT object_code, count(*) FILTER (WHERE layer = 'CONCEPT') AS concept, count(*) FILTER (WHERE layer = 'LOGICAL') AS logical, 0 AS physical, count(*) AS total, count(*) FILTER (WHERE method = 'CLUSTER') AS cluster_relations, count(*) FILTER (WHERE method = 'BRIDGE') AS bridge_relations FROM r GROUP BY object_code""")
def extraction_stats(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    code = F.concat(F.lit("OBJ_"), "c_mktsegment").alias("object_code")
    a = c.select(code, F.lit("CONCEPT").alias("layer"), F.when(F.col("c_custkey") % 3 == 0, "BRIDGE").otherwise("CLUSTER").alias("method"))
    b = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(code, F.lit("LOGICAL").alias("layer"), F.lit("CLUSTER").alias("method"))
    return ex.extraction_stats(a.unionByName(b))


@query("SELECT p_name AS entity_name, count(*) AS n, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS sources FROM part GROUP BY p_name")
def entity_occurrences(spark, sf_dir):
    return ex.occurrences(table(spark, sf_dir, "part").select(F.col("p_name").alias("entity_name"), F.col("p_type").alias("source")))


@query(f"""WITH {WORDS}, o(object_code, object_name) AS (VALUES ('OBJ_A', 'blue ring'), ('OBJ_B', 'gear'), ('OBJ_ROD', 'nothing'), ('OBJ_C', 'ECONOMY')), e AS (SELECT DISTINCT p_name AS entity_name FROM part),
f AS (SELECT DISTINCT object_code, p_name AS entity_name, 1 AS kind, 0.8 AS strength FROM o JOIN part ON object_name = p_type UNION SELECT object_code, entity_name, 2, 0.65 FROM o JOIN e ON contains(entity_name, object_name)
 UNION SELECT k.object_code, entity_name, 3, 0.5 FROM e JOIN k ON contains(entity_name, keyword) WHERE k.object_code IN (SELECT object_code FROM o))
SELECT object_code, entity_name, strength FROM (SELECT *, row_number() OVER (PARTITION BY object_code ORDER BY entity_name) AS r FROM f WHERE (object_code, kind) IN (SELECT (object_code, min(kind)) FROM f GROUP BY object_code)) WHERE r <= 30""")
def required_supplement(spark, sf_dir):
    objects = spark.createDataFrame([("OBJ_A", "blue ring"), ("OBJ_B", "gear"), ("OBJ_ROD", "nothing"), ("OBJ_C", "ECONOMY")], "object_code string, object_name string")
    part = table(spark, sf_dir, "part")
    return ex.supplement(objects, part.select(F.col("p_name").alias("entity_name")).distinct(), part.select(F.col("p_type").alias("business"), F.col("p_name").alias("concept")), keywords(spark))


@query(sql("""SELECT s AS sample, count(*) AS n, count(DISTINCT object_name) AS objects, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains FROM (SELECT domain, object_name, unnest(samples) AS s FROM local_objects) GROUP BY s"""))
def sample_clusters(spark, sf_dir):
    rows = local_objects(spark, sf_dir).select("domain", "object_name", F.explode("samples").alias("sample"))
    return rows.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("object_name").alias("objects"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"))
