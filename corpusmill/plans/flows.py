"""End-to-end flows over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.storage import materialize
from corpusmill.functions.text import digest, strip
from corpusmill.operators import classify, dedup
from corpusmill.operators.cleaning import CleaningLimits, clean_documents, cleaning_report

TASK_ID = "00000000-0000-4000-8000-000000000001"


def deduplicate(docs: DataFrame, mapping: DataFrame, request_id: str, task_id: str) -> tuple[DataFrame, DataFrame]:
    """Business result and violations of ``(uid, text)`` with its mapping."""
    decisions, _ = materialize(dedup.dedup_decisions(docs, request_id), "decisions")
    return dedup.business_result(decisions, mapping, task_id), dedup.validate_decisions(decisions, docs.select("uid"))


def surviving_by_language(docs: DataFrame) -> DataFrame:
    """``lang, total, kept``: documents per language, and how many stay after exact de-duplication, of a group the one of
    the least id. Rows of one group and id count as one that stays, under each of their languages."""
    groups = docs.select(F.unhex(digest(strip(F.col("text")))).alias("key"), "doc_id", "lang").groupBy("key", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    best = groups.groupBy("key").agg(F.min("first").alias("best"))
    return groups.join(best, "key").groupBy("lang").agg(F.sum("n").alias("total"), F.count_if(F.col("first").eqNullSafe(F.col("best"))).alias("kept"))


def clean_and_report(docs: DataFrame, by: list[str], limits: CleaningLimits = CleaningLimits()) -> tuple[DataFrame, DataFrame]:
    cleaned, _ = materialize(clean_documents(docs, limits), "cleaned")
    return cleaned, cleaning_report(cleaned, by)


def classify_documents(docs: DataFrame, top_scores: DataFrame, end_scores: DataFrame, release_id: str) -> DataFrame:
    """Tags of documents from the chunk scores of the two heads."""
    top, end = classify.aggregate_scores(top_scores), classify.aggregate_scores(end_scores)
    return docs.select("doc_id").join(classify.compose_tags(top, end, release_id), "doc_id", "left")
