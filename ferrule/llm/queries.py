"""Registered queries of the training-data operators, under their contracts, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt_dedup, common, decontaminate, exact_topk, filter_audit, jaccard_join, line_dedup, mixing, phrases, quality, storage, substring_dedup, tokens, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The rules of the contract.
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_topk.pivot_topk(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=10, scale=1024)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), win AS (
  SELECT r, i, sha256(array_to_string(w[i : i + 34], ' ')) AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN again USING (s)) GROUP BY r),
merged AS (SELECT doc_id, w, coalesce(ps, []) AS ps FROM d LEFT JOIN gone USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(ps, i)), ' ')) AS kept_sha256
FROM merged
"""


def op9_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = bwt_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

#: Source weights of the contract, repeating in the order of the sources' names.
MIX_WEIGHTS = [3.0, 1.0, 2.0]
END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, share=1.5, repeat=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


OP4_SQL = r"""
WITH abc AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), u, l), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark, abc
), windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM item_words WHERE len(w) > 0)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), u, l), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents, abc
), doc_windows AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows))
), hits AS (SELECT d.r, d.i, d.n, x.item FROM doc_windows d JOIN windows x ON d.n = x.n AND d.s = x.s),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    held = (quality.fold(F.col("doc_id")) == 0).alias("held_out")
    score = F.col("quality_score")
    return quality.score(docs, model, ("doc_id",)).select("doc_id", held, score.alias("score"), (score >= quality.CUT).cast("int").alias("predicted"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    folder = storage.make_folder(common.shared_path(spark, "warc"))
    warc.write(warc.with_types(table(spark, sf_dir, "pages")), folder).agg(F.sum("records")).collect()
    back = warc.read(spark, folder, payload=False)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT h, max(page_id) AS chief FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM chief THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM chief THEN chief END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""


def op7_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    folder = storage.make_folder(common.shared_path(spark, "tokens"))
    manifest = tokens.write(table(spark, sf_dir, "documents"), folder, tokenizer_path(), END_ID)
    return tokens.documents_of(spark, manifest)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (
  SELECT r, doc_id, i, lines[i] AS line,
         translate(trim(lines[i], concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)
), shared AS (SELECT k, max(doc_id) AS last FROM x WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT x.r, x.doc_id, i, line, coalesce(x.doc_id <> last, false) AS gone FROM x LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS p, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), spans AS (
  SELECT lang, k, w[i : i + k - 1] AS w
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k))
), f AS (SELECT lang, k, w, count(*) AS a FROM spans GROUP BY lang, k, w HAVING count(*) >= 100),
totals AS (SELECT lang, count(*) AS n FROM spans WHERE k = 1 GROUP BY lang),
longer AS (
  SELECT lang, w[i : i + k - 1] AS w, max(a) AS longer
  FROM (SELECT lang, w, a, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, a, unnest(range(2, len(w))) AS k FROM f))
  GROUP BY ALL
), cuts AS (
  SELECT lang, w, x.a, n, c, f1.a AS l, f2.a AS r, (1000::HUGEINT * x.a * n) // (f1.a::HUGEINT * f2.a) AS score
  FROM (SELECT lang, w, f.a, n, unnest(range(1, len(w))) AS c FROM f JOIN totals USING (lang) WHERE len(w) > 1) AS x
  JOIN (SELECT lang, w AS left_w, a FROM f) AS f1 USING (lang)
  JOIN (SELECT lang, w AS right_w, a FROM f) AS f2 USING (lang)
  WHERE left_w = w[1 : c] AND right_w = w[c + 1 :]
), best AS (
  SELECT lang, w, a, n, arg_min(l, (score, c)) AS l, arg_min(r, (score, c)) AS r, min(score) AS score FROM cuts GROUP BY lang, w, a, n
), ranked AS (
  SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank
  FROM best ANTI JOIN (SELECT lang, w FROM f JOIN longer USING (lang, w) WHERE 100 * longer >= 100 * a) AS inside USING (lang, w)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = filter_audit.quality_flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(flags, list(filter_audit.FILTERS), ["good", "toxic"])


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
j AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         map {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
              'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
              'E': coalesce(doc_id > first, false)} AS fails
  FROM w LEFT JOIN marks USING (doc_id)
), kinds AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM j GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS f, filter_order[1 : step - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)
), told AS (
  SELECT part, filter_order, step, f, n, g, x, fails[f] AS fail,
         len(list_filter(map_entries(fails), lambda e: e.value AND contains(earlier, e.key))) > 0 AS before,
         len(list_filter(map_entries(fails), lambda e: e.value)) AS failed
  FROM kinds, steps
), summed AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (NOT before AND NOT fail), 0) AS kept, coalesce(sum(n) FILTER (NOT before AND fail), 0) AS removed,
         coalesce(sum(n) FILTER (before AND fail), 0) AS redundant, coalesce(sum(n) FILTER (fail AND failed = 1), 0) AS unique_fails,
         coalesce(sum(g) FILTER (NOT before AND fail), 0) AS good_lost, coalesce(sum(x) FILTER (NOT before AND fail), 0) AS toxic_lost
  FROM told GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed
"""


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_url_filter": op3_url_filter,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality": op5_quality,
    "op6_warc": op6_warc,
    "op7_token_codes": op7_token_codes,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_bwt_dedup": op9_bwt_dedup,
    "op10_exact_topk": op10_exact_topk,
    "op11_line_dedup": op11_line_dedup,
    "op12_phrases": op12_phrases,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES = {"op4_decontaminate": OP4_SQL, "op6_warc": OP6_SQL, "op8_substring_dedup": OP8_SQL, "op10_exact_topk": OP10_SQL, "op11_line_dedup": OP11_SQL, "op12_phrases": OP12_SQL, "op13_filter_audit": OP13_SQL}
