"""The queries op1 to op10 over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, language_id, licenses, mixing, quality, simhash, suffix_dedup, token_output, url_filters
from .common import table

URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filters.RULE_SCHEMA)
    return url_filters.judge(table(spark, sf_dir, "pages"), rules)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("spans", F.to_json("spans"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.filter(~out))
    return language_id.predict(docs, model).select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_benchmark_decontamination, op3_source_mixing, op4_token_ids, op5_quality_rules, op6_url_filters, op7_license_scan, op8_language_id,
    op9_html_extraction, op10_suffix_dedup,
)}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)

SQL = {}
SQL["op6_url_filters"] = f"""
WITH rules(h, p, a) AS (VALUES {_RULES_SQL}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
t AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM s),
g AS (SELECT DISTINCT host, path FROM t),
best AS (SELECT g.host, g.path, arg_max(struct_pack(rule := h || p, action := a), length(h || p)) AS b FROM g
  JOIN rules ON (g.host = h OR ends_with(g.host, '.' || h)) AND starts_with(g.path, p) GROUP BY g.host, g.path)
SELECT t.page_id, t.host, t.path, b.rule AS rule, coalesce(b.action, 'allow') AS verdict FROM t LEFT JOIN best USING (host, path)"""

#: Without seeds: every diagonal on which enough words are equal is laid out.
SQL["op2_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d), y AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM b),
hits AS (SELECT doc_id, item_id, i - j AS diag FROM x JOIN y USING (word) GROUP BY ALL HAVING count(*) >= ceil(least({decontaminate.WINDOW}, max(n)) * {decontaminate.AGREE})),
eq AS (SELECT doc_id, item_id, diag, len(b.w) AS len,
  [CASE WHEN d.w[k + 1] = b.w[k - diag + 1] THEN 1 ELSE 0 END FOR k IN range(greatest(diag, 0), least(len(d.w), diag + len(b.w)))] AS e
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)),
ok AS (SELECT *, least({decontaminate.WINDOW}, len) AS win FROM eq)
SELECT doc_id, item_id, CAST(greatest(diag, 0) AS BIGINT) AS start_word, CAST(len(e) AS BIGINT) AS compared, CAST(list_sum(e) AS BIGINT) AS matched FROM ok
WHERE len(e) >= win AND list_max([list_sum(e[s:s + win - 1]) FOR s IN range(1, len(e) - win + 2)]) >= ceil(win * {decontaminate.AGREE})"""

#: The mix as one schedule over whole tables: water-filled targets, golden-ratio slots, blocks of each source's shuffled documents.
SQL["op3_source_mixing"] = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM d GROUP BY source),
w AS (SELECT *, CAST([{", ".join(map(str, mixing.WEIGHTS))}][src % {len(mixing.WEIGHTS)} + 1] AS DOUBLE) AS weight, {mixing.EPOCHS} * source_size AS cap FROM s),
v AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS DOUBLE) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS free FROM w
  WINDOW before AS (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, weight * (rest / free) > cap AS capped FROM v),
l AS (SELECT CAST(sum(source_size) - coalesce(sum(cap) FILTER (capped), 0) AS DOUBLE) / sum(weight) FILTER (NOT capped) AS level FROM c),
t AS (SELECT src, source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight * level END AS target FROM c, l),
a AS (SELECT list(target ORDER BY src) AS ts FROM t),
e AS (SELECT src, list_reduce(ts[1:src + 1], lambda x, y: x + y) AS upto, list_reduce(ts, lambda x, y: x + y) AS total, len(ts) AS n FROM t, a),
r AS (SELECT src, total, CASE WHEN src = n - 1 THEN {mixing.RING} WHEN total = 0 THEN 0 ELSE CAST(floor({float(mixing.RING)!r}::DOUBLE * upto / total) AS BIGINT) END AS hi FROM e),
z AS (SELECT src, coalesce(lag(hi) OVER (ORDER BY src), 0) AS lo, hi FROM r),
p AS (SELECT slot, (slot % {mixing.RING}) * {mixing.STEP} % {mixing.RING} AS point FROM (SELECT unnest(range(0, (SELECT CAST(ceil(max(total) / {mixing.BLOCK}) AS BIGINT) FROM r))) AS slot)),
k AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS nth FROM p JOIN z ON point >= lo AND point < hi),
b AS (SELECT src, nth % n_blocks AS block, count(*) AS times FROM k JOIN (SELECT src, (source_size + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS n_blocks FROM t WHERE source_size > 0) USING (src)
  WHERE nth < n_blocks * {mixing.EPOCHS} GROUP BY ALL),
o AS (SELECT d.doc_id, d.size, t.src, t.source_size, t.target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT src, doc_id, size, sum(size) OVER (PARTITION BY src ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM o WHERE size > 0),
u AS (SELECT src, doc_id, size, start, unnest(range(start // {mixing.BLOCK}, (start + size - 1) // {mixing.BLOCK} + 1)) AS block FROM (SELECT src, doc_id, size, CAST(start AS BIGINT) AS start FROM f)),
g AS (SELECT src, doc_id, sum((least(start + size, (block + 1) * {mixing.BLOCK}) - greatest(start, block * {mixing.BLOCK})) * times) AS got FROM u JOIN b USING (src, block) GROUP BY ALL)
SELECT o.doc_id, o.size, o.source_size, o.target,
  CAST(least(coalesce(got, 0) * o.size // greatest(sum(o.size) OVER (PARTITION BY o.src, o.doc_id), 1), {mixing.EPOCHS} * o.size) AS BIGINT) AS taken
FROM o LEFT JOIN g ON o.src = g.src AND o.doc_id IS NOT DISTINCT FROM g.doc_id"""
