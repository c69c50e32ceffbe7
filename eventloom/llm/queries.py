"""The driver's queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import lsa_decontam, partenum, quality_rules, raking, rule_ensemble, secret_forest, token_store, toxicity, url_filter, warc
from eventloom.llm.common import scratch_path, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    token_store.write_token_store(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return token_store.token_digest(token_store.read_token_store(spark, path))


def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rule_ensemble.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op4_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = raking.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", "probability", "sampled")


def op5_lsa_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    marked = lsa_decontam.with_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.inline("contamination"))


def op6_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan_secrets(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("reject_reasons", ",").alias("reasons"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path, scratch_path(spark, "warc-records"))


def queries() -> dict:
    return {
        "op1_token_ids": op1_token_ids,
        "op2_rule_ensemble": op2_rule_ensemble,
        "op3_partenum": op3_partenum,
        "op4_raking": op4_raking,
        "op5_lsa_decontam": op5_lsa_decontam,
        "op6_secret_forest": op6_secret_forest,
        "op7_quality_rules": op7_quality_rules,
        "op8_toxicity": op8_toxicity,
        "op9_url_filter": op9_url_filter,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a whole query; the tests hold the others against plain Python."""
    return {
        "op10_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
              g AS (SELECT h, min(page_id) AS first_id FROM p WHERE strlen(h) >= 100 GROUP BY 1)
            SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
              CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
              CASE WHEN page_id > first_id THEN first_id END AS refers_to
            FROM p LEFT JOIN g USING (h)""",
    }
