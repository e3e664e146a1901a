"""Registered queries: request statistics, streams and round trips through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.session import shared_path
from ferrule.sources import files
from ferrule.streaming import workload as wl

from .bindings import objects, relations, sql, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def folder(spark, name: str) -> str:
    """A new folder that driver and executors share."""
    return shared_path(spark, name)


ROUTES = [("exact", "/purchase", "TP"), ("prefix", "/e", "AP"), ("prefix", "/er", "TP"), ("prefix", "/view", "AP"), ("method", "POST", "TP"), ("method", "GET", "AP")]
REQ = """req AS (SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN event_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method, '/' || event_type AS path, value AS ms FROM events),
cls AS (SELECT *, CASE WHEN path = '/purchase' THEN 'TP' WHEN path LIKE '/e%' THEN 'AP' WHEN path LIKE '/er%' THEN 'TP' WHEN path LIKE '/view%' THEN 'AP' WHEN method = 'POST' THEN 'TP' ELSE 'AP' END AS class FROM req)"""


def shaped(e):
    return e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 4 == 0, "POST").otherwise("GET").alias("method"), F.concat(F.lit("/"), "event_type").alias("path"), F.col("value").alias("ms"))


def requests(spark, sf_dir):
    return wl.classify_columns(shaped(table(spark, sf_dir, "events")), ROUTES)


def request_stream(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    return wl.classify_columns(shaped(spark.readStream.schema(t.schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)), ROUTES)


@query(f"WITH {REQ} SELECT class, count(*) AS requests, round(sum(ms), 2) AS total_ms, round(avg(ms), 4) AS avg_ms FROM cls GROUP BY class")
def workload_stats(spark, sf_dir):
    return wl.stats(requests(spark, sf_dir))


@query(f"WITH {REQ} SELECT event_id, path, class, ms FROM cls ORDER BY ts DESC, event_id DESC LIMIT 50")
def workload_recent(spark, sf_dir):
    return requests(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "path", "class", "ms")


@query(f"WITH {REQ} SELECT date_trunc('day', ts) AS start, class, count(*) AS requests, round(sum(ms), 2) AS total_ms FROM cls GROUP BY ALL")
def workload_windows(spark, sf_dir):
    return wl.windowed(requests(spark, sf_dir))


@query(f"""WITH {REQ}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM cls), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS requests FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf_dir):
    return wl.sessions(requests(spark, sf_dir))


@query(f"WITH {REQ} SELECT class, count(*) AS requests, round(sum(ms), 2) AS total_ms, round(avg(ms), 4) AS avg_ms FROM cls GROUP BY class")
def stream_workload(spark, sf_dir):
    return wl.run_to_folder(wl.stats(request_stream(spark, sf_dir)), folder(spark, "stream"), "complete")


@query(f"WITH {REQ} SELECT event_id, path, ms FROM cls WHERE class = 'AP' AND ms > 40")
def stream_alerts(spark, sf_dir):
    fired = request_stream(spark, sf_dir).where("class = 'AP' and ms > 40").select("event_id", "path", "ms")
    return wl.run_to_folder(fired, folder(spark, "stream"), "append")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def csv_source(spark, sf_dir):
    path = folder(spark, "csv")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.option("header", True).csv(path)
    return files.read_csv(spark, path)


@query("""SELECT r_name AS data_domain, 'OBJ_' || n_name AS object_code, n_name AS object_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def json_source(spark, sf_dir):
    o = objects(spark, sf_dir)
    path = folder(spark, "json")
    o.groupBy(F.col("domain").alias("data_domain")).agg(F.collect_list(F.struct("object_code", "object_name", "object_type")).alias("objects")).repartition(5, "data_domain").write.option("maxRecordsPerFile", 1).json(path)
    return files.extracted_objects(files.read_extractions(spark, path)).select("data_domain", "object_code", "object_name")


@query(sql("""SELECT object_code, object_name, count(layer) AS relations, round(coalesce(sum(strength), 0), 4) AS strength, coalesce(min(layer || '/' || entity_name), '') AS first
 FROM objects LEFT JOIN (SELECT * FROM relations WHERE layer <> 'PHYSICAL') r USING (object_id) GROUP BY ALL"""))
def json_export(spark, sf_dir):
    path = folder(spark, "export")
    files.export_objects(objects(spark, sf_dir), relations(spark, sf_dir).where("layer <> 'PHYSICAL'"), path)
    read = spark.read.schema("object_code string, object_name string, relations array<struct<layer:string,entity_name:string,strength:double>>").json(path)
    rows = read.select("object_code", "object_name", F.explode_outer("relations").alias("r"))
    first = F.min(F.concat_ws("/", "r.layer", "r.entity_name"))
    return rows.groupBy("object_code", "object_name").agg(F.count("r").alias("relations"), F.round(F.coalesce(F.sum("r.strength"), F.lit(0.0)), 4).alias("strength"), F.coalesce(F.when(F.count("r") > 0, first), F.lit("")).alias("first"))


@query(sql("""SELECT domain AS data_domain, object_code, CASE WHEN domain = 'ASIA' THEN lower(object_name) ELSE object_name END AS object_name FROM objects WHERE domain IN ('ASIA', 'EUROPE')"""))
def catalog_objects(spark, sf_dir):
    """Objects of two domains: one from the tables, the other, which these lack, from its extraction, found by an old code."""
    o, path = objects(spark, sf_dir).withColumnRenamed("domain", "data_domain"), folder(spark, "json")
    code = F.when(F.col("data_domain") == "ASIA", "as").otherwise(F.col("data_domain")).alias("data_domain")
    o.groupBy(code).agg(F.collect_list(F.struct("object_code", F.lower("object_name").alias("object_name"))).alias("objects")).repartition(5, "data_domain").write.option("maxRecordsPerFile", 1).json(path)
    found, tables = files.read_extractions(spark, path), o.where("data_domain <> 'ASIA'")
    none = spark.createDataFrame([], "data_domain string, object_code string, entity_name string")
    of = lambda d: files.catalog(tables, none, found, d, {"ASIA": "as"})[0].select(F.lit(d).alias("data_domain"), "object_code", "object_name")
    return of("EUROPE").unionByName(of("ASIA"))
