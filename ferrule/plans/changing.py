"""Registered queries: imports and writes that change tables, archives of workbooks, sampled type votes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ferrule.operators import eav, imports, writes
from ferrule.session import shared_path, workers_import
from ferrule.sources import archives
from ferrule.sources.versions import Store

from . import inventory
from .bindings import objects, relations, sql, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def order_cells(spark, sf_dir, run: int):
    """Rows and cells of an import of orders: the first run lacks some orders, the second has them and other prices of some."""
    o = table(spark, sf_dir, "orders")
    o = o.where("o_orderkey % 13 <> 0") if run == 1 else o.where("o_orderkey % 17 <> 0")
    price = F.when((F.col("o_orderkey") % 10 == 0) & F.lit(run > 1), F.lit("free")).otherwise(F.col("o_custkey").cast("string"))
    wide = o.select(F.lit("orders").alias("dataset"), F.col("o_orderkey").alias("row_number"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), price.alias("price"))
    from ferrule.functions import text as tx

    rows = wide.select("dataset", "row_number", F.concat(F.lit("o!"), F.col("row_number").cast("string")).alias("external_id"), tx.row_hash([F.col(c) for c in ("status", "priority", "price")]).alias("row_hash"))
    return rows, wide.unpivot(["dataset", "row_number"], ["status", "priority", "price"], "attribute", "raw").where("raw is not null")


def imported(spark, sf_dir):
    """A store after three imports of orders, the third like the second, and what each did."""
    store = Store(spark, shared_path(spark, "imports"))
    return store, [(run, imports.import_rows(store, *order_cells(spark, sf_dir, run), buckets=16), store.version()) for run in (1, 2, 3)]


@query("""WITH k AS (SELECT DISTINCT o_orderkey AS k FROM orders)
SELECT 1 AS run, count(*) FILTER (WHERE k % 13 <> 0) AS inserted, 0 AS updated, 0 AS skipped, 1 AS version FROM k UNION ALL
SELECT 2, count(*) FILTER (WHERE k % 13 = 0 AND k % 17 <> 0), count(*) FILTER (WHERE k % 13 <> 0 AND k % 17 <> 0 AND k % 10 = 0), count(*) FILTER (WHERE k % 13 <> 0 AND k % 17 <> 0 AND k % 10 <> 0), 2 FROM k UNION ALL
SELECT 3, 0, 0, count(*) FILTER (WHERE k % 17 <> 0), 2 FROM k""")
def incremental_counts(spark, sf_dir):
    """What three imports did, and the store's version after each: the last one writes nothing."""
    _, runs = imported(spark, sf_dir)
    return spark.createDataFrame([(run, c["inserted"], c["updated"], c["skipped"], v) for run, c, v in runs], "run int, inserted long, updated long, skipped long, version int")


@query("""SELECT o_orderkey AS row_number, attribute, raw FROM (UNPIVOT (SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority,
 CASE WHEN o_orderkey % 10 = 0 AND o_orderkey % 17 <> 0 THEN 'free' ELSE CAST(o_custkey AS VARCHAR) END AS price FROM orders WHERE o_orderkey % 13 <> 0 OR o_orderkey % 17 <> 0) ON status, priority, price INTO NAME attribute VALUE raw)""")
def incremental_values(spark, sf_dir):
    """The values after the imports; orders that the second one lacks stay."""
    return imported(spark, sf_dir)[0].table("values").select("row_number", "attribute", "raw")


REFRESHED = """codes AS (SELECT CASE WHEN domain = 'ASIA' THEN object_code || '_v2' ELSE object_code END || '_' || domain AS object_code, domain, object_code AS old FROM objects)"""


@query(sql("""SELECT 'objects' AS kind, domain, object_code, count(*) AS n FROM codes GROUP BY ALL UNION ALL
SELECT 'synonyms', domain, object_code, count(*) FROM codes GROUP BY ALL UNION ALL
SELECT 'relations', o.domain, c.object_code, count(*) FROM relations JOIN objects o USING (object_id) JOIN codes c ON c.old = o.object_code WHERE layer = 'CONCEPT' GROUP BY ALL""", REFRESHED))
def domain_store_refresh(spark, sf_dir):
    """All domains written to a store, then one of them again: its objects, synonyms and relations change together."""
    store = Store(spark, shared_path(spark, "domains"))
    o, r = objects(spark, sf_dir), relations(spark, sf_dir).where("layer = 'CONCEPT'")
    for domain in [x["domain"] for x in o.select("domain").distinct().orderBy("domain").collect()] + ["ASIA"]:
        own = o.where(F.col("domain") == domain)
        if domain == "ASIA" and store.manifest()["tables"].get("objects", {"parts": {}})["parts"].get(domain):
            own = own.withColumn("object_code", F.concat("object_code", F.lit("_v2")))
        rows = r.join(own.select("object_id", "object_code"), "object_id").drop("object_id")
        synonyms = own.select("object_code", F.lower("object_name").alias("synonym"))
        imports.refresh_domain(store, domain, own.drop("domain"), synonyms, rows)
    count = lambda name: store.table(name).groupBy(F.lit(name).alias("kind"), "domain", "object_code").agg(F.count(F.lit(1)).alias("n"))
    return count("objects").unionByName(count("synonyms")).unionByName(count("relations"))


def zipped(spark, sf_dir) -> str:
    """The regions' workbooks in archives 1.zip and 2.zip, with names in GBK and members that no route takes."""
    books, out = inventory.written(spark, sf_dir), shared_path(spark, "archives")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        body = io.BytesIO()
        with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in sorted(zip(frame["name"], frame["content"])):
                info = zipfile.ZipInfo(f"{name}域清单.xlsx".encode("gbk").decode("cp437"))
                info.compress_type = zipfile.ZIP_DEFLATED
                z.writestr(info, bytes(data))
            z.writestr("readme.txt", "no workbook")
        raw = body.getvalue().replace(b"\x00\x08\x08\x00", b"\x00\x00\x08\x00")  # without the mark of UTF-8 names
        store, root = fs.FileSystem.from_uri(out)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{frame['archive'].iloc[0]}.zip") as f:
            f.write(raw)
        return pd.DataFrame({"n": [len(frame)]})

    workers_import(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(books)
    rows = files.select(F.element_at(F.split("path", "/"), -2).alias("name"), "content").withColumn("archive", F.when(F.col("name") < "B", "1").otherwise("2"))
    rows.groupBy("archive").applyInPandas(pack, "n long").count()
    return out


@query(f"""WITH {inventory.BY_REGION}, v AS (SELECT file AS domain, 'DA-01' AS sheet, unnest([nullif(c_mktsegment, 'HOUSEHOLD'), n_name, CAST(c_nationkey AS VARCHAR)]) AS value FROM customer JOIN n ON c_nationkey = n_nationkey
 UNION ALL SELECT file, 'DA-02', unnest([n_name, CASE WHEN s_suppkey % 9 <> 0 THEN s_name END, CAST(s_suppkey AS VARCHAR)]) FROM supplier JOIN n ON s_nationkey = n_nationkey
 UNION ALL SELECT file, 'DA-03', unnest(['L' || c_custkey % 40, 'T' || c_custkey % 7, CAST(c_custkey AS VARCHAR)]) FROM customer JOIN n ON c_nationkey = n_nationkey
 UNION ALL SELECT file, 'BA-04', unnest([n_name, file]) FROM n WHERE file <> 'AFRICA')
SELECT domain, CASE WHEN domain < 'B' THEN '1' ELSE '2' END AS slot, sheet, count(*) AS cells, count(DISTINCT trim(value)) AS texts FROM v WHERE value IS NOT NULL AND domain <> 'EUROPE' GROUP BY ALL""")
def archive_import(spark, sf_dir):
    """Cells of the workbooks in archives, routed by name; one region has no route."""
    routes = [(r["r_name"], r["r_name"]) for r in table(spark, sf_dir, "region").where("r_name <> 'EUROPE'").collect()]
    cells = archives.read_archives(spark, zipped(spark, sf_dir), routes)
    return cells.groupBy("domain", "slot", F.substring("sheet", 1, 5).alias("sheet")).agg(F.count(F.lit(1)).alias("cells"), F.count_distinct(F.trim("value")).alias("texts"))


@query(r"""WITH c AS (SELECT l_linestatus AS file, l_returnflag AS sheet, l_orderkey * 10 + l_linenumber AS r, CASE WHEN l_orderkey < 400 THEN CAST(l_partkey AS VARCHAR) ELSE 'part ' || l_partkey END AS part, CASE WHEN l_linenumber = 1 THEN 'yes' ELSE '' END AS first, CAST(NULL AS VARCHAR) AS never FROM lineitem),
u AS (SELECT file, sheet, r, 'part' AS attribute, part AS raw FROM c UNION ALL SELECT file, sheet, r, 'first', first FROM c UNION ALL SELECT file, sheet, r, 'never', never FROM c),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, sheet, attribute ORDER BY r, raw) AS n FROM u WHERE trim(raw) <> '') WHERE n <= 200),
t AS (SELECT file, attribute, CASE WHEN regexp_full_match(raw, '\d+') THEN 'number' WHEN raw = 'yes' THEN 'bool' ELSE 'text' END AS type, count(*) AS n FROM s GROUP BY ALL),
v AS (SELECT file, attribute, arg_max(type, (n, type = 'number')) AS type, sum(n) AS values FROM t GROUP BY ALL)
SELECT file, attribute, coalesce(type, 'text') AS type, CAST(coalesce(values, 0) AS BIGINT) AS values FROM (SELECT DISTINCT file, attribute FROM u) LEFT JOIN v USING (file, attribute)""")
def sampled_types(spark, sf_dir):
    """Types by the first 200 values of each sheet; all later parts are texts, which would change the vote."""
    line = table(spark, sf_dir, "lineitem")
    part = F.when(F.col("l_orderkey") < 400, F.col("l_partkey").cast("string")).otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
    wide = line.select(F.col("l_linestatus").alias("file"), F.col("l_returnflag").alias("sheet"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), part.alias("part"), F.when(F.col("l_linenumber") == 1, "yes").otherwise("").alias("first"), F.lit(None).cast("string").alias("never"))
    return eav.vote_by_samples(wide.unpivot(["file", "sheet", "row"], ["part", "first", "never"], "attribute", "raw"))


@query("""WITH n AS (SELECT c_mktsegment AS sheet, c_custkey AS r, c_name, c_nationkey, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS i FROM customer)
SELECT 1000 + i - 1 AS entity_id, unnest(['c_name', 'c_nationkey']) AS attribute, unnest([c_name, CAST(c_nationkey AS VARCHAR)]) AS value FROM n""")
def bulk_values(spark, sf_dir):
    """Values of a bulk import, ids in a row from 1000."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("sheet"), F.col("c_custkey").alias("r"), "c_name", "c_nationkey")
    return eav.bulk_import(rows, "sheet", "r", 1000)[1]


@query(sql("""SELECT object_id, layer, count(*) AS n, round(sum(strength), 2) AS strength FROM (
 SELECT object_id, layer, strength FROM relations WHERE object_id % 3 <> 0 UNION ALL
 SELECT object_id, 'CONCEPT', 0.5 FROM objects JOIN supplier ON s_nationkey = object_id WHERE object_id % 3 = 0) GROUP BY ALL"""))
def relations_written(spark, sf_dir):
    """Relations of some objects replaced by their suppliers; codes that nobody knows are left out."""
    old = relations(spark, sf_dir).select("object_id", "layer", "entity_name", "via", "strength")
    o = objects(spark, sf_dir)
    new = table(spark, sf_dir, "supplier").join(o, F.col("s_nationkey") == F.col("object_id"))
    new = new.select("object_code", F.lit("CONCEPT").alias("layer"), F.col("s_name").alias("entity_name"), F.lit("").alias("via"), F.lit(0.5).alias("strength"))
    out = writes.write_relations(old, new, o.where("object_id % 3 = 0"))
    return out.groupBy("object_id", "layer").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("strength"), 2).alias("strength"))


@query("""WITH old AS (SELECT n_nationkey AS batch_id, 'B' || n_nationkey AS batch_code, n_name AS data_domain, 'COMPLETED' AS status, 0 AS objects FROM nation),
new AS (SELECT (SELECT max(batch_id) FROM old) + row_number() OVER (ORDER BY c) AS batch_id, c AS batch_code, r_name AS data_domain, 'RUNNING' AS status FROM (SELECT 'SEMANTIC_' || r_name || '_T' AS c, r_name FROM region)),
one AS (SELECT batch_id, batch_code, data_domain, status, objects FROM old UNION ALL SELECT *, NULL FROM new)
SELECT batch_id, batch_code, data_domain, CASE WHEN data_domain = 'ASIA' THEN 'COMPLETED' WHEN data_domain = 'EUROPE' THEN 'FAILED' ELSE status END AS status,
 coalesce(CASE WHEN data_domain IN ('ASIA', 'EUROPE') THEN length(data_domain) ELSE objects END, -1) AS objects FROM one""")
def batches_run(spark, sf_dir):
    """A batch started for each region, two of them ended."""
    old = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("batch_id"), F.concat(F.lit("B"), F.col("n_nationkey").cast("string")).alias("batch_code"), F.col("n_name").alias("data_domain"), F.lit("COMPLETED").alias("status"), F.lit(0).cast("long").alias("objects"), F.lit(0).cast("long").alias("relations"))
    run = writes.start_batches(old, table(spark, sf_dir, "region").select(F.col("r_name").alias("data_domain")), "T")
    run = writes.start_batches(run, table(spark, sf_dir, "region").select(F.col("r_name").alias("data_domain")), "T")  # again: nothing new
    n = F.length("data_domain").cast("long")
    ended = run.where("data_domain in ('ASIA', 'EUROPE')").select("batch_id", n.alias("objects"), n.alias("relations"), F.when(F.col("data_domain") == "EUROPE", "FAILED").alias("status"))
    return writes.end_batches(run, ended).select("batch_id", "batch_code", "data_domain", "status", F.coalesce("objects", F.lit(-1)).alias("objects"))


@query(sql("""WITH c AS (SELECT DISTINCT conv_id FROM conversations), made AS (SELECT conv_id, 100 + row_number() OVER (ORDER BY 'C' || conv_id) AS chain_id FROM c WHERE conv_id % 4 <> 0)
SELECT chain_id, turn AS node_order, coalesce(object_id, -1) AS object_id, role AS node_label, 'INTERMEDIATE' AS node_type FROM conversations JOIN made USING (conv_id) LEFT JOIN objects ON object_id = turn * 3"""))
def chains_created(spark, sf_dir):
    """Conversations written as chains of nodes; those without a name are refused, objects are found by their code."""
    c = table(spark, sf_dir, "conversations")
    key = F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("chain_code")
    chains = spark.createDataFrame([(100, "OLD", "old", "CUSTOM", "", "")], "chain_id long, chain_code string, chain_name string, chain_type string, data_domain string, description string").where(F.lit(c.count() >= 0))
    nodes = spark.createDataFrame([], "chain_id long, node_order long, object_id long, entity_name string, node_label string, node_type string")
    request = c.select(key, F.when(F.col("conv_id") % 4 != 0, F.lit("chain")).alias("chain_name")).distinct()
    o = objects(spark, sf_dir)
    asked = c.join(o.select("object_id", "object_code"), F.col("object_id") == F.col("turn") * 3, "left").select(key, F.col("turn").alias("node_order"), "object_code", F.col("role").alias("entity_name"), F.lit(None).cast("string").alias("node_label"))
    return writes.create_chains(chains, nodes, request, asked, o)[1].select("chain_id", "node_order", F.coalesce("object_id", F.lit(-1)).alias("object_id"), "node_label", "node_type")


@query("""SELECT event_id AS alert_id, user_id % 3 = 0 AS is_resolved, CASE WHEN user_id % 3 = 0 THEN CASE WHEN user_id % 2 = 0 THEN 'u' || user_id ELSE 'system' END ELSE '' END AS resolved_by, CASE WHEN user_id % 3 = 0 THEN '2024-05-01' ELSE '' END AS day FROM events WHERE event_type = 'error'""")
def alerts_resolved(spark, sf_dir):
    """Error events as alerts; a request resolves those of some users."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    alerts = e.select(F.col("event_id").alias("alert_id"), F.lit(False).alias("is_resolved"), F.lit(None).cast("string").alias("resolved_by"), F.lit(None).cast("timestamp").alias("resolved_at"))
    who = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    out = writes.resolve_alerts(alerts, e.where("user_id % 3 = 0").select(F.col("event_id").alias("alert_id"), who.alias("resolved_by")), "2024-05-01 10:00:00")
    return out.select("alert_id", "is_resolved", F.coalesce("resolved_by", F.lit("")).alias("resolved_by"), F.coalesce(F.date_format("resolved_at", "yyyy-MM-dd"), F.lit("")).alias("day"))


@query("SELECT p_partkey AS func_id, CASE WHEN p_size % 4 = 0 THEN p_size WHEN p_size % 4 = 1 THEN -1 ELSE 7 END AS linked_rule_id FROM part")
def functions_linked(spark, sf_dir):
    """Parts as functions of rule 7; a request links some to another rule and unlinks some."""
    p = table(spark, sf_dir, "part")
    functions = p.select(F.col("p_partkey").alias("func_id"), F.lit(7).alias("linked_rule_id"))
    request = p.where("p_size % 4 < 2").select(F.col("p_partkey").alias("func_id"), F.when(F.col("p_size") % 4 == 0, F.col("p_size")).alias("rule_id"))
    return writes.link_rules(functions, request).select("func_id", F.coalesce("linked_rule_id", F.lit(-1)).alias("linked_rule_id"))


@query(sql("""SELECT object_id, object_code, CASE WHEN object_id % 4 = 0 THEN lower(object_name) ELSE object_name END AS object_name, CASE WHEN object_id % 4 = 1 THEN 'CHANGED' ELSE object_type END AS object_type FROM objects UNION ALL
SELECT (SELECT max(object_id) FROM objects) + row_number() OVER (ORDER BY code), code, name, 'CORE' FROM (SELECT DISTINCT 'OBJ_' || c_mktsegment AS code, c_mktsegment AS name FROM customer)"""))
def objects_edited(spark, sf_dir):
    """Objects created from market segments, others changed in part."""
    o = objects(spark, sf_dir).select("object_id", "object_code", "object_name", "object_type")
    segment = table(spark, sf_dir, "customer").select(F.concat(F.lit("OBJ_"), "c_mktsegment").alias("object_code"), F.col("c_mktsegment").alias("object_name"))
    request = o.where("object_id % 4 < 2").select("object_code", F.when(F.col("object_id") % 4 == 0, F.lower("object_name")).alias("object_name"), F.when(F.col("object_id") % 4 == 1, "CHANGED").alias("object_type"))
    return writes.update(writes.create(o, segment, "object_id", "object_code", object_type="CORE"), request, "object_code")
