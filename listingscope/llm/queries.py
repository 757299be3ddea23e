"""Registered queries of the ten operators, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingscope.llm import decontaminate, html_paths, langid, licenses, line_templates, merkle, minhash, mixing, sharding, topk, toxicity, url_rules, whitening

FOLDS = 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str = "doc_id"):
    """crc32 of the id as text leaves remainder 0."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"))


def is_contaminated():
    """At least one word in twenty lies inside a benchmark window."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    dicts = langid.dictionaries(docs.where(~held_out()).select("text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), dicts)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_templates.drop_recurring_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    vectors = rows.where(topk.usable(F.col("embedding"))).select("vec_id", topk.in_units(F.col("embedding")).alias("vec"))
    return topk.top_products(vectors, F.col("id") % 50 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic")
    chosen, share = toxicity.choose(labels)
    model = toxicity.learn(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), share_toxic=share)   # at most about 2 * LABELLED rows
    found = toxicity.score(docs, model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                        F.size("passages").cast("bigint").alias("n_passages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    own, more = F.transform("places", lambda x: x["label"]), F.transform("blocks", lambda x: x["label"])
    starts = F.transform("places", lambda x: x["first"])
    best = F.array_max(F.transform("blocks", lambda x: x["share"]))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(own, more)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    vectors = rows.where(topk.usable(F.col("embedding"))).select("vec_id", F.col("embedding").alias("vec"))
    model = whitening.fit(vectors)
    error = whitening.identity_error(vectors, model)
    return whitening.whiten(vectors, model).withColumn("identity_error", F.lit(error))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(held_out(), merkle.leaf_digest(*map(F.col, ("doc_id", "source", "lang", "n_chars")), low))
    found = merkle.manifest(docs, claim=tampered)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_near_duplicates, op2_main_text, op3_contamination, op4_language, op5_mixing, op6_line_templates, op7_top_products, op8_toxicity,
        op9_url_filter, op10_sharding, op11_license_scan, op12_whitening, op13_merkle_manifest)}

TOP_PRODUCTS_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""

CONTAMINATION_SQL = f"""
WITH doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT item_id, w, least({decontaminate.WINDOW}, len(w)) AS m, unnest(range(1, len(w) - least({decontaminate.WINDOW}, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
places AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc_words, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
found AS (SELECT doc_id, item_id, m, i FROM places JOIN windows USING (m, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""


def _url_sql() -> str:
    hosts = " UNION ALL ".join(
        f"SELECT '{r.name}' AS rule, '{r.name[:r.name.index('/')]}' AS rule_host, '{r.name[r.name.index('/'):]}' AS rule_path, '{r.verdict}' AS rule_verdict"
        for r in url_rules.HOST_RULES)
    words = " OR ".join(f"regexp_matches(lower(host || path), '{r.pattern}')" for r in url_rules.PATTERN_RULES)
    return f"""
WITH rules AS ({hosts}),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, CASE WHEN contains(rest, '/') THEN substr(rest, instr(rest, '/')) ELSE '' END AS path FROM cut),
fit AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(rule_verdict, length(rule)) AS rule_verdict
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN {words} THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN fit USING (page_id)"""


SQL: dict[str, str] = {
    "op3_contamination": CONTAMINATION_SQL,
    "op6_line_templates": line_templates.recurring_lines_sql(),
    "op7_top_products": TOP_PRODUCTS_SQL,
    "op9_url_filter": _url_sql(),
    "op10_sharding": sharding.shards_sql(),
    "op11_license_scan": licenses.scan_sql(),
    "op13_merkle_manifest": merkle.manifest_sql(),
}
