"""Corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secret scans, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``, whatever
else they hold: columns may have any type, dots in their names, or the names of an operator's own results.

In every stage null and empty texts are texts without words, very long texts are read whole, an empty table gives no
rows, and rows are judged by their text; where an id matters, rows of equal id and different text are told apart.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import byte_bpe, decontamination, near_duplicates, quality, secrets
from corpusmill.llm.support import materialize, new_path, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands reject go; so do null and empty texts, which have no words.
    Repeated rows stay or go together. Learned limits come from the labelled rows among ``docs``; where there are none, the
    fixed limits decide."""
    learned = quality.learn_limits(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(quality.keep_text(learned=learned)("text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document of the smallest id stays, once, and of its documents without an id one.

    Rows are told apart by id and text, as ids may be null or stand for different texts; of rows equal in both the one
    least as JSON stays. Texts without words, null ones included, are copies of each other."""
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), secrets.blob_id(F.col("text")).alias("blob"))
    found = materialize(near_duplicates.near_duplicates(docs.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id"), "near-duplicates")
    unnamed = found.where("key.unnamed")
    first = unnamed.groupBy("component_id").agg(F.min("key").alias("first"))
    extra = found.where("NOT key.unnamed AND key <> component_id").select("key.*").unionByName(unnamed.join(first, "component_id").where("key <> first").select("key.*")).distinct()
    kept = docs.join(extra, same_row(docs, extra), "left_anti")
    repeated = materialize(found.groupBy("key").count().where("count > 1").select("key.*"), "repeated-rows")
    if repeated.isEmpty():
        return kept
    whole = F.struct(*(docs[quoted(c)].alias(c) for c in docs.columns))
    again = kept.join(repeated, same_row(docs, repeated), "left_semi").select(docs["doc_id"].alias("id"), secrets.blob_id(docs["text"]).alias("blob"), whole.alias("row"))
    once = again.groupBy("id", "blob").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return kept.join(repeated, same_row(docs, repeated), "left_anti").unionByName(once)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def same_row(docs: DataFrame, keys: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(keys["doc_id"]) & (secrets.blob_id(docs["text"]) == keys["blob"])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go, whatever their ids: the text alone decides, so repeated rows and
    copies go together. Null and empty texts stay."""
    addressed = docs.select(secrets.blob_id(F.col("text")).alias("doc_id"), "text")
    found = decontamination.decontaminate(addressed, read_table(spark, sf_dir, "benchmark"))
    hit = found.where("contaminated").select(F.col("doc_id").alias("blob")).distinct()
    return docs.join(hit, secrets.blob_id(docs["text"]) == hit["blob"], "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret found is replaced in the text, whatever its document's id; ``n_chars`` follows. Overlapping secrets are
    replaced as one. No row goes; texts without a secret, null ones included, stay as they are."""
    found = secrets.scan_increment(docs, new_path(spark, "ledger")).where("size(spans) > 0")
    spans = found.groupBy("blob").agg(F.first("spans").alias("found"))
    hit, text = spans["found"].isNotNull(), secrets.redact_expr(docs["text"], spans["found"])
    new = {"text": F.when(hit, text).otherwise(docs["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    joined = docs.join(spans, secrets.blob_id(docs["text"]) == spans["blob"], "left")
    return joined.select(*(new[c].alias(c) if c in new else docs[quoted(c)] for c in docs.columns))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, token ids, their number, and digests of the ids and of what they decode to, one row per row; null and
    empty texts have no tokens."""
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scan", secret_scan),
    ("byte BPE", encode_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
