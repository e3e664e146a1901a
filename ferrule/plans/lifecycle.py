"""Registered queries: lifecycle, chains and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.operators import lifecycle as lc
from ferrule.operators import lineage as ln

from .bindings import table

QUERIES: dict = {}
ORACLES: dict = {}
ORDER = ["signup", "view", "click", "purchase"]
AS_OF = "2024-03-01 00:00:00"
TEMPLATES = [("signup", ["k"], ["F_HIGH"]), ("view", ["k", "page"], []), ("click", ["k", "target"], ["F_HIGH", "F_LOW"]), ("purchase", ["k", "amount", "currency"], ["F_LOW"])]
FUNCTIONS = [("F_HIGH", "CRITICAL", 100.0), ("F_LOW", "WARNING", 20.0)]


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def entries(spark, sf_dir):
    """Stage entries: users are objects, event types stages; every third entry has notes."""
    e = table(spark, sf_dir, "events")
    notes = F.when(F.col("event_id") % 3 == 0, "because")
    return e.select("event_id", F.col("user_id").alias("object_id"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("entered"), notes.alias("notes"), "value", "props")


def templates(spark):
    return spark.createDataFrame(TEMPLATES, "stage string, required array<string>, triggers array<string>")


E = "e AS (SELECT event_id, user_id AS object_id, event_type AS stage, CAST(ts AS TIMESTAMP) AS entered, CASE WHEN event_id % 3 = 0 THEN 'because' END AS notes, value, props FROM events)"
H = "h AS (SELECT *, lead(entered) OVER (PARTITION BY object_id ORDER BY entered, event_id) AS exited FROM e)"
RANK = "coalesce(list_position(['signup', 'view', 'click', 'purchase'], {}), 0)"


@query(f"WITH {E}, {H} SELECT event_id, object_id, stage, entered, exited FROM h")
def lifecycle_history(spark, sf_dir):
    return lc.history(entries(spark, sf_dir)).select("event_id", "object_id", "stage", "entered", "exited")


@query(f"""WITH {E}, r AS (SELECT *, {RANK.format('stage')} AS rank FROM e), b AS (SELECT *, lag(rank) OVER (PARTITION BY object_id ORDER BY entered, event_id) AS previous_rank FROM r)
SELECT event_id, object_id, stage, previous_rank, CASE WHEN rank = 0 THEN 'UNKNOWN_STAGE' WHEN previous_rank IS NULL OR previous_rank = 0 THEN 'OK' WHEN rank > previous_rank + 1 THEN 'SKIPPED'
 WHEN rank < previous_rank AND notes IS NULL THEN 'BACK_WITHOUT_NOTES' ELSE 'OK' END AS verdict FROM b""")
def transition_check(spark, sf_dir):
    return lc.transitions(entries(spark, sf_dir), ORDER)


@query(f"WITH {E} SELECT stage, count(DISTINCT object_id) AS objects, {RANK.format('stage')} AS position FROM e GROUP BY stage")
def stage_distribution(spark, sf_dir):
    return lc.distribution(entries(spark, sf_dir), ORDER)


DAYS = f"date_diff('day', entered, coalesce(exited, TIMESTAMP '{AS_OF}'))"


@query(f"WITH {E}, {H} SELECT stage, round(avg({DAYS}), 1) AS avg_days, min({DAYS}) AS min_days, max({DAYS}) AS max_days, count(*) AS entries FROM h GROUP BY stage")
def stage_durations(spark, sf_dir):
    return lc.durations(lc.history(entries(spark, sf_dir)), AS_OF)


@query(f"WITH {E}, {H}, d AS (SELECT stage, round(avg({DAYS}), 1) AS avg_days FROM h GROUP BY stage) SELECT stage AS bottleneck, avg_days FROM d ORDER BY avg_days DESC, {RANK.format('stage')}, stage DESC LIMIT 1")
def stage_bottleneck(spark, sf_dir):
    return lc.bottleneck(lc.history(entries(spark, sf_dir)), AS_OF, ORDER)


@query(f"""WITH {E}, {H}, d AS (SELECT *, CAST(floor((epoch_us(coalesce(exited, TIMESTAMP '{AS_OF}')) // 1000000 - epoch_us(entered) // 1000000) / 86400) AS BIGINT) AS days FROM h)
SELECT object_id, sum(days) AS total_days, count(*) AS stages, string_agg(stage || ':' || days, ',' ORDER BY entered, event_id) AS path FROM d GROUP BY object_id""")
def lifecycle_report(spark, sf_dir):
    return lc.report(lc.history(entries(spark, sf_dir)), AS_OF)


T = "t(stage, required, triggers) AS (VALUES ('signup', ['k'], ['F_HIGH']), ('view', ['k', 'page'], []), ('click', ['k', 'target'], ['F_HIGH', 'F_LOW']), ('purchase', ['k', 'amount', 'currency'], ['F_LOW']))"


@query(f"""WITH {E}, {T}, m AS (SELECT event_id, object_id, stage, len(required) AS n, list_sort(list_filter(required, lambda x: coalesce(json_extract_string(props, '$.' || x), '') = '')) AS miss FROM e JOIN t USING (stage))
SELECT event_id, object_id, stage, array_to_string(miss, ',') AS missing, n - len(miss) AS filled, round(CAST(n - len(miss) AS DOUBLE) / n * 100, 1) AS completion FROM m""")
def template_validation(spark, sf_dir):
    rows = entries(spark, sf_dir).withColumn("snapshot", F.from_json("props", "map<string,string>"))
    return lc.validate_templates(rows, templates(spark))


@query(f"""WITH {E}, last AS (SELECT object_id, arg_max(stage, (entered, event_id)) AS current FROM e GROUP BY object_id),
q AS (SELECT c_custkey AS object_id, CASE c_custkey % 5 WHEN 0 THEN 'signup' WHEN 1 THEN 'view' WHEN 2 THEN 'click' WHEN 3 THEN 'purchase' ELSE 'retired' END AS target FROM customer)
SELECT object_id, current, target, CASE WHEN current IS NULL THEN 'UNKNOWN_OBJECT' WHEN {RANK.format('target')} = 0 THEN 'UNKNOWN_STAGE'
 WHEN {RANK.format('current')} > 0 AND {RANK.format('target')} > {RANK.format('current')} + 1 THEN 'SKIPPED' ELSE 'ADVANCED' END AS outcome FROM q LEFT JOIN last USING (object_id)""")
def batch_advance(spark, sf_dir):
    target = F.element_at(F.array(*[F.lit(x) for x in [*ORDER, "retired"]]), (F.col("c_custkey") % 5 + 1).cast("int"))
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object_id"), target.alias("target"))
    return lc.batch_advance(lc.latest(entries(spark, sf_dir)), requests, ORDER)


@query(f"""WITH {E}, {T}, f(func_code, level, threshold) AS (VALUES ('F_HIGH', 'CRITICAL', 100.0), ('F_LOW', 'WARNING', 20.0)), x AS (SELECT e.*, unnest(triggers) AS func_code FROM e JOIN t USING (stage))
SELECT event_id, object_id, stage, func_code, level, value FROM x JOIN f USING (func_code) WHERE value > threshold""")
def trigger_alerts(spark, sf_dir):
    functions = spark.createDataFrame(FUNCTIONS, "func_code string, level string, threshold double")
    return lc.trigger_alerts(entries(spark, sf_dir), templates(spark), functions)


@query("""SELECT conv_id AS chain_id, count(*) AS nodes, string_agg(role, '>' ORDER BY turn) AS path, min(turn) AS first_order, max(turn) AS last_order FROM conversations GROUP BY conv_id""")
def chain_nodes(spark, sf_dir):
    return ln.chains(chains(spark, sf_dir))


def chains(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("chain_id"), F.col("turn").alias("node_order"), F.col("role").alias("node_type"), F.col("text").alias("node_label"))


@query("""SELECT chain_id, node_order, node_type, next_type FROM (SELECT conv_id AS chain_id, turn AS node_order, role AS node_type, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_type FROM conversations) WHERE next_type IS NOT NULL""")
def chain_edges(spark, sf_dir):
    return ln.edges(chains(spark, sf_dir))


@query("""SELECT DISTINCT conv_id AS chain_id, n_name AS object_name FROM conversations JOIN nation ON contains(lower(text), lower(n_name[1:4]))""")
def chains_of_object(spark, sf_dir):
    objects = table(spark, sf_dir, "nation").select("n_name", F.lower(F.substring("n_name", 1, 4)).alias("needle"))
    return ln.chains_through(chains(spark, sf_dir), objects)


@query("""WITH o AS (SELECT chr(97 + CAST(n_nationkey AS INTEGER)) || chr(97 + CAST(n_nationkey * 7 % 26 AS INTEGER)) AS name, min(n_nationkey) AS rank, max(n_nationkey) AS own FROM nation GROUP BY 1),
n AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN -1 END AS given, lower(coalesce(text, '')) AS label FROM conversations)
SELECT conv_id, turn, coalesce(given, (SELECT arg_min(own, rank) FROM o WHERE contains(label, name))) AS object_id FROM n""")
def relinked_nodes(spark, sf_dir):
    """Chain nodes linked to the first object whose name their label holds; every fifth turn has an object already."""
    c = table(spark, sf_dir, "conversations")
    nodes = c.select(F.struct("conv_id", "turn").alias("node_id"), F.lower("text").alias("node_label"), F.when(F.col("turn") % 5 == 4, -1).cast("int").alias("object_id"))
    objects = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("object_id"), F.concat(F.char(97 + F.col("n_nationkey")), F.char(97 + F.col("n_nationkey") * 7 % 26)).alias("object_name"))
    return ln.relink(nodes, objects).select("node_id.conv_id", "node_id.turn", "object_id")


# each part is a field made of its brand and of another part's field; the third of some parts' lineage is broken
LSQL = """l AS (SELECT 'L' || p_partkey AS lineage_code, 'P' || p_partkey AS field, CASE WHEN p_partkey % 7 = 3 THEN 'not json' ELSE '{"formula": "a*b", "sources": ["P' || (p_partkey // 3) || '", "' || p_brand || '"]}' END AS expression FROM part),
s AS (SELECT lineage_code, field, unnest(CAST(CASE WHEN json_valid(expression) THEN json_extract(expression, '$.sources') END AS VARCHAR[])) AS source FROM l)"""


def part_lineage(spark, sf_dir):
    key = F.col("p_partkey")
    made = F.concat(F.lit('{"formula": "a*b", "sources": ["P'), F.floor(key / 3).cast("string"), F.lit('", "'), "p_brand", F.lit('"]}'))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("L"), key.cast("string")).alias("lineage_code"), F.concat(F.lit("P"), key.cast("string")).alias("field"), F.when(key % 7 == 3, "not json").otherwise(made).alias("expression"))


@query(f"WITH {LSQL} SELECT lineage_code, field, source, source IN (SELECT field FROM l) AS derived FROM s")
def lineage_trace(spark, sf_dir):
    return ln.sources(part_lineage(spark, sf_dir))


@query(f"""WITH RECURSIVE {LSQL}, w AS (SELECT field, source, 1 AS depth FROM s UNION ALL SELECT w.field, s.source, depth + 1 FROM w JOIN s ON w.source = s.field WHERE depth < 10)
SELECT field, source, min(depth) AS depth FROM w GROUP BY field, source""")
def lineage_upstream(spark, sf_dir):
    return ln.upstream(part_lineage(spark, sf_dir))
