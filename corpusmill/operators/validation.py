"""Input checks: budgets, record lines, Markdown files, texts to classify, batch fingerprints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.digests import listed_digest
from corpusmill.functions.text import BOM, is_blank
from corpusmill.operators.structure import unclosed_fence


@dataclass(frozen=True)
class BatchLimits:
    documents: int = 100_000
    document_bytes: int = 100 << 20
    total_bytes: int = 10 << 30


def enforce_batch_budget(docs: DataFrame, limits: BatchLimits = BatchLimits()) -> DataFrame:
    """``code, uid`` of ``(uid, size_bytes)``: documents too large, the first (by uid) that takes the running total over
    the limit, and a batch of too many documents (uid null).

    The first offender is looked for level by level, in blocks of uids, then in the block that crosses the limit: no
    window ever runs over more rows than a level has blocks."""
    large = docs.where(F.col("size_bytes") > limits.document_bytes).select(F.lit("DOCUMENT_TOO_LARGE").alias("code"), "uid")
    many = docs.agg(F.count("*").alias("n")).where(F.col("n") > limits.documents).select(F.lit("TOO_MANY_DOCUMENTS").alias("code"), F.lit(None).cast("long").alias("uid"))
    rows = docs.select("uid", F.col("size_bytes").cast("long").alias("size"), F.lit(0).cast("long").alias("ahead"))
    for width in (1 << 36, 1 << 24, 1 << 12, 1):
        block = F.expr(f"uid DIV {width}")
        totals = rows.groupBy("ahead", block.alias("block")).agg(F.sum("size").alias("total"))
        run = F.sum("total").over(Window.orderBy("block"))
        crossing = totals.withColumn("upto", F.col("ahead") + run).where(F.col("upto") > limits.total_bytes).agg(F.min(F.struct("block", (F.col("upto") - F.col("total")).alias("before"))).alias("c")).where("c IS NOT NULL")
        rows = rows.join(F.broadcast(crossing), block == F.col("c.block")).select("uid", "size", F.col("c.before").alias("ahead"))
    return large.unionByName(many).unionByName(rows.select(F.lit("BATCH_TOO_LARGE").alias("code"), "uid").distinct())


def parse_samples(lines: DataFrame) -> DataFrame:
    """``line_no, uid, text, error_code`` of JSON lines ``(line_no, value)`` that must hold exactly uid and text."""
    body = F.when(F.col("line_no") == 1, F.when(F.col("value").startswith(BOM), F.expr("substring(value, 2)")).otherwise(F.col("value"))).otherwise(F.col("value"))
    parsed = lines.select("line_no", body.alias("value")).withColumn("_v", F.try_parse_json("value"))
    keys = F.json_object_keys("value")
    uid, text = F.try_variant_get("_v", "$.uid", "long"), F.try_variant_get("_v", "$.text", "string")
    kind = lambda p: F.schema_of_variant(F.try_variant_get("_v", p, "variant"))
    shape = F.schema_of_variant("_v")
    code = (
        F.when(F.col("value").isNull() | ~F.is_valid_utf8("value"), "INVALID_UTF8")
        .when(F.regexp_replace("value", r"[\r\n]+\z", "") == "", "BLANK_LINE")
        .when(F.col("_v").isNull(), "INVALID_JSON")
        .when(~shape.startswith("OBJECT"), "INVALID_RECORD")
        .when(F.array_sort(keys) != F.array(F.lit("text"), F.lit("uid")), "UNKNOWN_FIELDS")
        .when(F.coalesce(kind("$.uid") != "BIGINT", F.lit(True)) | (uid < 0), "INVALID_UID")
        .when(F.coalesce(kind("$.text") != "STRING", F.lit(True)), "INVALID_TEXT")
    )
    return parsed.select("line_no", uid.alias("uid"), text.alias("text"), code.alias("error_code"))


def validate_samples(lines: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good rows ``(uid, text)`` and violations ``(line_no, error_code)``; repeated uids count from the second line.

    ``strict`` raises on the first violation, as a batch job would; otherwise all of them are returned.
    """
    rows = parse_samples(lines)
    first = rows.where("error_code IS NULL").groupBy("uid").agg(F.min("line_no").alias("_first"))
    checked = rows.join(first, "uid", "left").withColumn("error_code", F.coalesce("error_code", F.when(F.col("line_no") > F.col("_first"), "DUPLICATE_UID")))
    bad = checked.where("error_code IS NOT NULL").select("line_no", "error_code")
    if strict and (worst := bad.orderBy("line_no").head()) is not None:
        raise ValueError(f"{worst.error_code} in line {worst.line_no}")
    return checked.where("error_code IS NULL").select("uid", "text"), bad


def validate_markdown_input(name: Column, data: Column, max_bytes: int = 4 << 20) -> Column:
    """Error code of a Markdown file, else null."""
    text = F.try_validate_utf8(data.cast("string"))
    body = F.when(text.startswith(BOM), F.substring(text, 2, 2147483647)).otherwise(text)
    return (
        F.when(~F.lower(name).rlike(r"\.(?:md|markdown)\z"), "UNSUPPORTED_INPUT_FORMAT")
        .when(F.octet_length(data) > max_bytes, "INPUT_TOO_LARGE")
        .when(text.isNull() | F.contains(body, F.lit(BOM)), "INVALID_UTF8")
        .when(body.rlike(r"[\p{Cc}&&[^\t\n\r]]"), "INVALID_CONTROL_CHARACTER")
        .when(body == "", "EMPTY_INPUT")
        .when(unclosed_fence(body), "INVALID_MARKDOWN")
    )


def validate_classifier_text(text: Column, max_chars: int = 500_000, max_bytes: int = 2_000_000) -> Column:
    return F.when(text.isNull() | is_blank(text), "INVALID_TEXT").when((F.char_length(text) > max_chars) | (F.octet_length(text) > max_bytes), "TEXT_TOO_LARGE")


def batch_fingerprint(docs: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """``by, documents, fingerprint, set_digest``: SHA-256 of the sorted paths, one per line, however many there are; and
    an order-free digest from partial aggregates. Rows without a path count, and have no line."""
    key = F.struct(*(F.col(c) for c in by))
    listed = listed_digest(docs.select(key.alias("batch"), F.col(path).alias("path")), "batch", "path", separator="\n")
    facts = docs.groupBy(*by).agg(F.count("*").alias("documents"), F.bit_xor(F.xxhash64(path)).alias("set_digest"))
    joined = facts.join(listed, F.struct(*(facts[c] for c in by)).eqNullSafe(listed["batch"]), "left")
    return joined.select(*(facts[c] for c in by), "documents", F.coalesce("digest", F.sha2(F.lit(b""), 256)).alias("fingerprint"), "set_digest")
