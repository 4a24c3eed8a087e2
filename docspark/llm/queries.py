"""Queries over the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import byte_bpe, exact_dedup, html_extract, mixing, near_dedup, quality, secrets, substring_dedup, tool_calls, toxicity
from docspark.llm.common import documents, materialise


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), keep=["page_id", "url"])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))
    return left.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir).select("doc_id", "text"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in secrets.KINDS), F.sha2(secrets._joined(F.col("base")), 256).alias("base_sha256"), secrets._joined(F.col("spans")).alias("spans"), F.size("live").cast("long").alias("n_live"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    coded = byte_bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(name), public_tokenizers.PATTERN, keep=["doc_id"], round_trip=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, context = tool_calls.from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return tool_calls.link(calls, results, tool_calls.REPLY, context)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, n = quality.with_features(documents(spark, sf_dir), keep=["doc_id", "lang"])
    features = materialise(features)
    cutoffs = quality.fit_cutoffs(features, n, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    failed = quality.base_failed(n)
    return features.select("doc_id", *(n[f] for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed.alias("base_failed"), (~failed & quality.verdict(cutoffs, n)).alias("kept"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.memberships(documents(spark, sf_dir))


QUERIES = {"op1_html_extract": op1_html_extract, "op2_substring_dedup": op2_substring_dedup, "op3_near_dedup": op3_near_dedup, "op6_tool_calls": op6_tool_calls, "op9_toxicity": op9_toxicity, "op4_secret_scan": op4_secret_scan, "op5_byte_bpe": op5_byte_bpe, "op7_mixing": op7_mixing, "op8_quality": op8_quality, "op10_exact_dedup": op10_exact_dedup}

ORACLES = {
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op7_mixing": """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS spot
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos
  FROM d GROUP BY source
), c AS (
  SELECT *, CAST([3, 1, 2][(pos - 1) % 3 + 1] AS BIGINT) AS weight, source_size * 2 AS cap FROM s
), l AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER b, 0) AS DOUBLE))
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM c WINDOW b AS (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o AS (
  SELECT *, first_value(CASE WHEN level * weight <= cap THEN level END IGNORE NULLS)
            OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_level
  FROM l
), t AS (
  SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), open_level * weight), CAST(cap AS DOUBLE)) AS target FROM o
), q AS (
  SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY spot, doc_id, size ROWS UNBOUNDED PRECEDING) AS served
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r AS (
  SELECT q.*, round, CAST(served + round * source_size AS DOUBLE) / target AS finish
  FROM q, (VALUES (0), (1)) v(round) WHERE size > 0
), p AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, spot, doc_id, size, round ROWS UNBOUNDED PRECEDING) AS passed FROM r
), k AS (
  SELECT doc_id, count(*) AS times FROM p WHERE passed <= (SELECT sum(target) FROM t) + 0.5 GROUP BY doc_id
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(k.times, 0) AS BIGINT) AS taken
FROM q LEFT JOIN k USING (doc_id)
""",
}
