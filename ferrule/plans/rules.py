"""Registered queries: rule engine and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.operators import lineage as ln
from ferrule.operators import rules as ru

from .bindings import objects, sql, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part")


def column(name: str):
    """A column's value as a number; names that are no column are 0."""
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in ("p_size", "p_retailprice", "p_partkey") else F.lit(0.0)


RULES = [("R1", "p_size", ">", 40.0), ("R2", "p_retailprice", "<=", 905.0), ("R3", "absent", "==", 0.0), ("R4", "p_size", "~", 1.0), ("R5", "p_size", "!=", 7.0), ("R6", "p_retailprice", ">=", 990.0), ("R7", "p_size", "<", 3.0), ("R8", "p_retailprice", ">", 950.5)]
RULE_SQL = "rules(rule_id, field, operator, bound) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', CAST({d} AS DOUBLE))" for a, b, c, d in RULES) + ")"
TEST = "CASE operator WHEN '>' THEN value > bound WHEN '<' THEN value < bound WHEN '>=' THEN value >= bound WHEN '<=' THEN value <= bound WHEN '==' THEN value = bound WHEN '!=' THEN value <> bound ELSE false END"


@query(f"""WITH {RULE_SQL}, v AS (SELECT p_partkey AS row_id, rules.*, CASE field WHEN 'p_size' THEN CAST(p_size AS DOUBLE) WHEN 'p_retailprice' THEN p_retailprice ELSE 0.0 END AS value FROM part, rules)
SELECT row_id, rule_id, value, {TEST} AS fired, CASE WHEN {TEST} THEN concat_ws(' ', field, operator, CASE WHEN bound = floor(bound) THEN CAST(CAST(bound AS BIGINT) AS VARCHAR) ELSE CAST(bound AS VARCHAR) END) END AS message FROM v""")
def rule_threshold(spark, sf_dir):
    rows = parts(spark, sf_dir).select(F.col("p_partkey").alias("row_id"), F.create_map(F.lit("p_size"), F.col("p_size").cast("double"), F.lit("p_retailprice"), "p_retailprice").alias("values"))
    return ru.threshold(rows, spark.createDataFrame(RULES, "rule_id string, field string, operator string, bound double"))


@query("""SELECT p_partkey, p_size * p_retailprice AS product, p_size + p_retailprice AS total, p_retailprice - p_size AS difference,
 CASE WHEN p_size <> 0 THEN p_retailprice / p_size END AS quotient, CAST(NULL AS DOUBLE) AS by_zero, CAST(NULL AS DOUBLE) AS three FROM part""")
def rule_formula(spark, sf_dir):
    f = lambda text: ru.formula(text, column)
    return parts(spark, sf_dir).select("p_partkey", f("p_size * p_retailprice").alias("product"), f("p_size + p_retailprice").alias("total"), f("p_retailprice - p_size").alias("difference"), f("p_retailprice / p_size").alias("quotient"), f("p_size / absent").alias("by_zero"), f("p_size + p_size + p_size").alias("three"))


@query("SELECT p_partkey, p_size > 30 AS big, p_retailprice <= 950.5 AS cheap, false AS bad_operator, false AS bad_number FROM part")
def rule_condition(spark, sf_dir):
    c = lambda text: ru.condition(text, column, ["p_size", "p_retailprice"])
    return parts(spark, sf_dir).select("p_partkey", c("p_size > 30").alias("big"), c("p_retailprice <= 950.5").alias("cheap"), c("p_size ~ 3").alias("bad_operator"), c("p_size > x").alias("bad_number"))


@query("""WITH f AS (SELECT p_partkey, p_size, p_retailprice, p_size * p_retailprice AS v FROM part)
SELECT p_partkey, round(CAST(p_size AS DOUBLE) * p_size * p_retailprice * p_partkey, 2) AS square, round(CASE WHEN p_size <> 0 THEN (p_retailprice - p_partkey) / p_size END, 6) AS per_size,
 round(CASE WHEN p_retailprice <> 0 THEN p_size / p_retailprice * 100 END, 6) AS percent, round(v, 6) AS product, v <= 20000 AS kept, true AS odd_operator, CAST(NULL AS BOOLEAN) AS unreadable,
 p_retailprice > p_size * 30 * (1 + 0.1) AS above, p_size >= 25 AS branch FROM f""")
def rule_freeform(spark, sf_dir):
    f = lambda text, n: F.round(ru.freeform(text, column), n)
    product = ru.freeform("p_size × p_retailprice", column)
    kept = {"kept": "P ≤ 20000", "odd_operator": "P ~ 3", "unreadable": "P <= many"}
    return parts(spark, sf_dir).select("p_partkey", f("p_size² × p_retailprice × p_partkey", 2).alias("square"), f("(p_retailprice - p_partkey) / p_size", 6).alias("per_size"), f("p_size / p_retailprice × 100", 6).alias("percent"), F.round(product, 6).alias("product"), *[ru.satisfied(product, c).alias(n) for n, c in kept.items()], ru.beyond(column("p_retailprice"), ">", column("p_size") * 30, 0.1).alias("above"), ru.branch("if p_size >= 25 then", column, ["p_size", "p_retailprice"]).alias("branch"))


@query("""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s, p_retailprice AS r, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey AS DOUBLE) END AS k FROM part)
SELECT p_partkey, round(s * r * coalesce(k, 1), 4) AS product, round(CASE WHEN r <> 0 AND k IS NOT NULL THEN (s - k) / r END, 4) AS per_size, CAST(NULL AS DOUBLE) AS slash_alone, round(s * s * r * coalesce(k, 0), 4) AS square, CAST(NULL AS DOUBLE) AS square_of_two,
 r > 950 AS business, CAST(NULL AS BOOLEAN) AS business_error, false AS no_sign, CASE WHEN s <> 0 THEN round((r / s - 1) * 100, 1) ELSE 0.0 END AS percent_over, r > s * (1 + 50.0) AS over, r < s * (1 - 0.5) AS under, CASE WHEN r <> 0 THEN round(s / r * 100, 1) END AS derived FROM p""")
def rule_category(spark, sf_dir):
    rows = parts(spark, sf_dir).withColumn("part_no", F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey").cast("double")))
    raw = lambda n: F.col(n).cast("double") if n in ("p_size", "p_retailprice", "part_no") else F.lit(None).cast("double")
    f = lambda *a, **k: ru.categorical(*a, value=lambda n: F.coalesce(raw(n), F.lit(0.0)), raw=raw, **k)
    physical = lambda text: f("PHYSICAL_FORMULA", text)[0]
    over, above = f("THRESHOLD", "p_retailprice", reference="p_size", tolerance=50.0)
    return rows.select("p_partkey", physical("p_size² × p_retailprice × part_no").alias("product"), physical("(p_size - part_no) / p_retailprice").alias("per_size"), physical("p_size / p_retailprice").alias("slash_alone"), physical("p_size² p_retailprice part_no").alias("square"), physical("p_size² p_retailprice").alias("square_of_two"), f("BUSINESS_RULE", "p_retailprice > 950")[1].alias("business"), f("BUSINESS_RULE", "p_retailprice >= 950")[1].alias("business_error"), f("BUSINESS_RULE", "p_retailprice")[1].alias("no_sign"), over.alias("percent_over"), above.alias("over"), f("THRESHOLD", "p_retailprice", reference="p_size", tolerance=0.5, operator="<")[1].alias("under"), f("DERIVED_CALC", "p_size / p_retailprice")[0].alias("derived"))


@query("""WITH s AS (SELECT p_partkey, p_size * p_retailprice AS a FROM part), t AS (SELECT *, a - p_partkey AS b FROM s)
SELECT p_partkey, a AS step1_result, b AS step2_result, CAST(CAST(b > 20000 AS INTEGER) AS DOUBLE) AS step3_result, CAST(b > 20000 AS INTEGER) AS triggered FROM t""")
def formula_chain(spark, sf_dir):
    steps = [("FORMULA", "p_size * p_retailprice", "gross"), ("FORMULA", "gross - p_partkey", "net"), ("CONDITION", "net > 20000", "large")]
    return ru.chain(parts(spark, sf_dir), steps, column).select("p_partkey", "step1_result", "step2_result", "step3_result", "triggered")


@query("""WITH v AS (SELECT c_custkey AS object_id, 'balance' AS name, c_acctbal AS number FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS DOUBLE) FROM customer),
m AS (SELECT c_custkey AS object_id, 'balance' AS name, 0.5 AS number FROM customer WHERE c_custkey % 10 = 0),
w AS (SELECT v.object_id, v.name, coalesce(m.number, v.number) AS number FROM v LEFT JOIN m USING (object_id, name))
SELECT object_id, max(number) FILTER (WHERE name = 'balance') > 1000 AS fired, round(max(number) FILTER (WHERE name = 'balance') * max(number) FILTER (WHERE name = 'nation'), 4) + 0.0 AS product FROM w GROUP BY object_id""")
def rule_with_eav(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    row = lambda name, value: c.select(F.col("c_custkey").alias("object_id"), F.lit(name).alias("name"), F.col(value).cast("double").alias("number"))
    manual = c.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("object_id"), F.lit("balance").alias("name"), F.lit(0.5).alias("number"))
    got = ru.with_eav(row("balance", "c_acctbal").unionByName(row("nation", "c_nationkey")), manual)
    value = lambda n: ru.lookup("values", F.lit(n))
    return got.select("object_id", (value("balance") > 1000).alias("fired"), (F.round(ru.formula("balance * nation", value), 4) + 0.0).alias("product"))


SCAN = [("A1", "acctbal", ">", 9000.0, "CRITICAL"), ("A2", "nationkey", "<", 2.0, "WARNING")]
SCAN_SQL = "scan(rule_id, field, operator, bound, level) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', CAST({d} AS DOUBLE), '{e}')" for a, b, c, d, e in SCAN) + ")"
ALERTS = f"""{SCAN_SQL}, vals AS (SELECT c_custkey AS entity_id, 'c_acctbal' AS name, CAST(c_acctbal AS DOUBLE) AS value FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer),
looked AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY entity_id, name) AS seen FROM vals JOIN scan ON contains(name, field)),
alerts AS (SELECT rule_id, entity_id, name, level, value FROM looked WHERE seen <= 100 AND {TEST})"""


def scanned(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    values = c.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey")).unpivot("c_custkey", ["c_acctbal", "c_nationkey"], "name", "value")
    values = values.select(F.col("c_custkey").alias("entity_id"), "name", F.col("value").cast("string").alias("raw"))
    return ru.alert_scan(values, spark.createDataFrame(SCAN, "rule_id string, field string, operator string, bound double, level string"))


@query(f"WITH {ALERTS} SELECT * FROM alerts")
def alert_scan(spark, sf_dir):
    return scanned(spark, sf_dir)


@query(f"WITH {ALERTS} SELECT level, count(*) AS total, count(*) FILTER (WHERE entity_id % 3 <> 0) AS unresolved FROM alerts GROUP BY level")
def alert_summary(spark, sf_dir):
    return ru.alert_summary(scanned(spark, sf_dir).withColumn("resolved", F.col("entity_id") % 3 == 0))


GRAPH = [("Q1", "OBJ_FRANCE", "OBJ_GERMANY", True), ("Q2", "OBJ_GERMANY", "OBJ_UNKNOWN", True), ("Q3", "OBJ_CHINA", "OBJ_JAPAN", False)]
GRAPH_SQL = "g(rule_code, s, t, is_active) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {str(d).lower()})" for a, b, c, d in GRAPH) + ")"


@query(sql("""SELECT 'NODE' AS kind, e AS a, '' AS b, coalesce(object_name, regexp_replace(e, '^OBJ_', '')) AS label FROM (SELECT s AS e FROM g WHERE is_active UNION SELECT t FROM g WHERE is_active) LEFT JOIN objects ON object_code = e
 UNION ALL SELECT 'EDGE', s, t, rule_code FROM g WHERE is_active""", GRAPH_SQL))
def rule_graph(spark, sf_dir):
    return ln.rule_graph(spark.createDataFrame(GRAPH, "rule_code string, source_code string, target_code string, is_active boolean"), objects(spark, sf_dir))
