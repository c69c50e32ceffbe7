"""From raw documents to token ids: five stages, each an operator of ``eventloom.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept.  Documents ride
along as one struct where an operator adds columns, so no name of theirs can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import lsa_decontam, partenum, quality_rules, queries, raking, token_store
from eventloom.llm.common import materialize, scratch_path, table, without


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """``names`` and the whole row as ``_doc``."""
    return docs.select(*names, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules.judge_quality(_packed(docs, "doc_id", "text", "lang"), table(spark, sf_dir, "labels"), keep=("_doc",))
    return judged.where("kept").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    groups = materialize(partenum.near_components(docs, words=5, num=80, den=100), "near-groups")
    others = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = without(docs, others, "doc_id")
    again = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if not again:
        return kept
    # rows with equal ids are one document: that with the smallest hash stays, however they are dealt out
    columns = [F.col(f"`{c}`") for c in docs.columns]
    first = kept.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_doc")).select("_doc.*")
    return first.unionByName(kept.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    marked = lsa_decontam.with_contamination(_packed(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.where(F.size("contamination") == 0).select("_doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens have the target shares of source, language and topic."""
    return raking.mix(_packed(docs, "doc_id", "text", "source", "lang")).where("sampled").select("_doc.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids are in the token store that this writes, with their count and checksum."""
    path = scratch_path(spark, "token-store")
    token_store.write_token_store(docs, path, queries.tokenizer_path(), end_id=2)
    return token_store.token_digest(token_store.read_token_store(spark, path))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("token ids", token_ids),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
