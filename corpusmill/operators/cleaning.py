"""Markdown cleaning: paragraph de-duplication, redaction, formatting, guards, digests, reports.

``clean_documents`` is one narrow stage of expressions: no shuffle, no Python, so the same function serves batch and
stream.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import alignment, markdown
from corpusmill.functions.arrays import let
from corpusmill.functions.text import BOM, digest, drop_bom
from corpusmill.operators import pii
from corpusmill.operators.structure import CONTAINERS

# Fixed value: marks that belong to a cleaner's inside and must not be published.
INTERNAL_MARKER = r"__MD_INTERNAL_\d+__|\x{E000}MD_CLEAN_\d+\x{E001}"
COUNTERS = ["duplicate_paragraphs_removed", *pii.COUNTERS.values(), "formatting_changes"]


@dataclass(frozen=True)
class CleaningLimits:
    max_input_bytes: int = 4 << 20
    max_output_bytes: int = 4 << 20
    max_blocks: int = 2000
    max_protected_spans: int = 2000
    max_block_chars: int = 1_000_000
    max_pii_candidates: int = 2000


def dedup_paragraphs(text: Column) -> Column:
    """``struct<text,duplicate_paragraphs_removed>``: the first of equal top-level paragraphs stays."""
    done = lambda d: F.struct(d["text"].alias("text"), d["removed"].alias("duplicate_paragraphs_removed"))
    return let(let(markdown.blocks(F.coalesce(text, F.lit(""))), markdown.without_repeated_paragraphs), done)


def normalize_markdown(text: Column) -> Column:
    """Formatting at the level of text; see ``markdown.formatted_values``."""
    return let(markdown.blocks(drop_bom(F.coalesce(text, F.lit("")))), lambda b: markdown.formatted(b, markdown.formatted_values(b)))


def count_format_changes(versions: DataFrame) -> DataFrame:
    """``doc_id, changes`` of ``(doc_id, before, after)``: in how many stretches of lines the texts differ, beside their
    longest common stretches. Null texts are empty. Only digests of lines leave the JVM, one row at a time."""
    digests = [alignment.line_digests(F.coalesce(c, F.lit(""))).alias(c) for c in ("before", "after")]
    key = versions.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lines = ([np.asarray(x.as_py(), np.int64).view(np.uint64) for x in batch.column(i)] for i in (1, 2))
            counts = [alignment.changes(a, b) for a, b in zip(*lines, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], names=["doc_id", "changes"])

    return versions.select("doc_id", *digests).mapInArrow(run, f"doc_id {key}, changes int")


def formatting_changes(text: Column) -> Column:
    """The same for a text and what formatting makes of it, by the formatter's own alignment of blocks: no Python."""
    return let(markdown.blocks(drop_bom(F.coalesce(text, F.lit("")))), lambda b: markdown.changed_stretches(b, markdown.formatted_values(b)))


def normalize_table_delimiters(text: Column) -> Column:
    return let(markdown.blocks(F.coalesce(text, F.lit(""))), lambda b: markdown.joined(markdown.table_form(b)))


def content_preserved(versions: DataFrame) -> DataFrame:
    """``doc_id, violation`` of ``(doc_id, before, after)``: what formatting must not change."""
    types = lambda b: F.transform(F.filter(b, lambda x: x["type"] != "blank"), lambda x: x["type"])
    blocks = versions.select("doc_id", *(markdown.blocks(F.coalesce(c, F.lit(""))).alias(c) for c in ("before", "after")))
    read = blocks.select("*", *(markdown.protected_units(F.col(c)).alias(f"{c}_units") for c in ("before", "after")))  # three checks read them
    checks = {"BLOCK_TYPES": (types, ""), "VISIBLE_TEXT": (markdown.visible_text, ""), "LINK_TARGETS": (markdown.unit_targets, "_units"), "INLINE_LEAVES": (markdown.unit_leaves, "_units"), "PROTECTED_UNITS": (lambda u: u, "_units")}
    differing = [F.when(~f(F.col(f"before{of}")).eqNullSafe(f(F.col(f"after{of}"))), code) for code, (f, of) in checks.items()]
    return read.select("doc_id", F.explode(F.array_compact(F.array(*differing))).alias("violation"))


def protected_regions_preserved(source: Column, output: Column) -> Column:
    """Ordered (kind, block, content) of the protected units are the same."""
    units = lambda text: let(markdown.blocks(F.coalesce(text, F.lit(""))), markdown.protected_units)
    return units(source).eqNullSafe(units(output))


def resource_guard(text: Column, blocks: Column, spans: Column, limits: CleaningLimits = CleaningLimits()) -> Column:
    """Error code of a document beyond the limits, else null."""
    return _guard(text, F.size(blocks), F.size(spans), _widest(blocks), limits)


def _widest(blocks: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(blocks, lambda b: b["end"] - b["start"])), F.lit(0))


def _block_count(places: Column) -> Column:
    """Located blocks and those inside containers; blank ones don't count."""
    sizes = F.transform(places, lambda b: F.when(b["type"] == "blank", 0).when(b["type"].isin(*CONTAINERS), 1 + F.size(markdown.nested_blocks(b))).otherwise(1))
    return F.aggregate(sizes, F.lit(0), lambda acc, n: acc + n)


def _guard(text: Column, blocks: Column, spans: Column, widest: Column, limits: CleaningLimits) -> Column:
    return (
        F.when(F.octet_length(text) > limits.max_input_bytes, "INPUT_TOO_LARGE")
        .when(blocks > limits.max_blocks, "TOO_MANY_BLOCKS")
        .when(spans > limits.max_protected_spans, "TOO_MANY_PROTECTED_SPANS")
        .when(widest > limits.max_block_chars, "BLOCK_TOO_LARGE")
    )


def check_clean_output(text: Column, limits: CleaningLimits = CleaningLimits()) -> Column:
    """Error code of an output unfit to publish, else null."""
    return (
        F.when(text.isNull() | (text == ""), "EMPTY_OUTPUT")
        .when(F.octet_length(text) > limits.max_output_bytes, "OUTPUT_TOO_LARGE")
        .when(F.contains(text, F.lit("\0")) | text.startswith(BOM) | F.contains(text, F.lit("\r")), "INVALID_ENCODING")
        .when(~text.endswith("\n") | text.endswith("\n\n"), "INVALID_TERMINAL_NEWLINE")
        .when(text.rlike(INTERNAL_MARKER), "INTERNAL_MARKER")
    )


def content_digest(text: Column, prefix: str) -> list[Column]:
    return [digest(text).alias(f"{prefix}_sha256"), F.octet_length(text).cast("long").alias(f"{prefix}_bytes")]


def clean_documents(docs: DataFrame, limits: CleaningLimits = CleaningLimits()) -> DataFrame:
    """``doc_id, text``, the seven counters, digests and sizes, ``status`` and ``error_code``.

    Order: structure, guards, paragraph de-duplication, candidate guard, redaction outside protected spans,
    formatting, output checks. A rejected document has its code, no text and zero counters; the others go on.
    Null texts are rejected as empty; extra columns ride along, ahead of the new ones, and may have any name. Each step
    is a projection of its own, so that what later steps name several times is computed once.
    """
    made = {"doc_id", "text", "status", "error_code", *COUNTERS, "input_sha256", "input_bytes", "output_sha256", "output_bytes"}
    extra = [c for c in docs.columns if c not in made]
    source = docs.select(F.struct("doc_id", *(F.col("`" + c.replace("`", "``") + "`") for c in extra)).alias("row"), F.col("text").alias("source"))
    large = F.octet_length("source") > limits.max_input_bytes  # never parsed
    read = source.withColumn("blocks", markdown.blocks(F.when(large | F.col("source").isNull(), "").otherwise(F.col("source"))))
    spans = markdown.protected(F.col("places"))
    placed = read.withColumn("places", markdown.located(F.col("blocks"))).withColumn("spans", spans)
    guard = F.when(F.col("source").isNull() | (F.col("source") == ""), "EMPTY_INPUT").when(markdown.unclosed_fence(F.col("source")), "INVALID_MARKDOWN").otherwise(
        _guard(F.col("source"), _block_count(F.col("places")), F.size("spans"), _widest(F.col("places")), limits)
    )
    unique = placed.select("row", "source", "blocks", "places", "spans", guard.alias("code"), markdown.without_repeated_paragraphs(F.col("blocks")).alias("kept"))
    fewer = F.col("kept.removed") > 0
    again = unique.withColumn("blocks", F.when(fewer, markdown.blocks(F.col("kept.text"))).otherwise(F.col("blocks")))
    raw = {e: m.alias(e) for e, m in pii.raw_matches(F.col("kept.text")).items()}
    moved = again.withColumn("places", F.when(fewer, markdown.located(F.col("blocks"))).otherwise(F.col("places")))
    searched = moved.withColumn("raw", F.struct(*raw.values())).withColumn("spans", F.when(fewer, spans).otherwise(F.col("spans")))
    hits = {e: F.col(f"raw.{e}") for e in raw}
    crowded = F.when(pii.count_outside(hits, F.col("spans")) > limits.max_pii_candidates, "TOO_MANY_PII_CANDIDATES")
    found = searched.withColumn("code", F.coalesce("code", crowded)).withColumn("matches", F.when(F.col("code").isNull(), pii.resolve_overlaps(pii.exclude_protected(pii.validated(hits), F.col("spans")))))
    redacted = found.withColumn("clean", F.when(F.col("code").isNull(), drop_bom(pii.redact(F.col("kept.text"), F.col("matches")))))
    formed = redacted.withColumn("blocks", F.when((F.size("matches") > 0) | F.col("source").startswith(BOM), markdown.blocks(F.col("clean"))).otherwise(F.col("blocks")))
    formatted = formed.withColumn("values", markdown.formatted_values(F.col("blocks")))
    done = formatted.withColumn("text", F.when(F.col("code").isNull(), markdown.formatted(F.col("blocks"), F.col("values"))))
    checked = done.withColumn("code", F.coalesce("code", check_clean_output(F.col("text"), limits)))
    ok = F.col("code").isNull()
    zero = lambda c: F.when(ok, c).otherwise(0).cast("int")
    out = F.when(ok, F.col("text"))
    return checked.select(
        "row.*", out.alias("text"), zero(F.col("kept.removed")).alias("duplicate_paragraphs_removed"),
        *(zero(c).alias(n) for c, n in zip(pii.counts(F.col("matches")), pii.COUNTERS.values(), strict=True)),
        zero(markdown.changed_stretches(F.col("blocks"), F.col("values"))).alias("formatting_changes"),
        *content_digest(F.col("source"), "input"), *content_digest(out, "output"),
        F.when(ok, "succeeded").otherwise("rejected").alias("status"), F.col("code").alias("error_code"),
    )


def cleaning_report(cleaned: DataFrame, by: list[str]) -> DataFrame:
    """Totals of the counters per ``by``, with a grand total (nulls)."""
    return cleaned.rollup(*by).agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), *(F.sum(c).alias(c) for c in COUNTERS))


def check_summary(cleaned: DataFrame, source: DataFrame) -> DataFrame:
    """``doc_id, error_code`` where a counter is negative or missing, or the input digest or size isn't the text's."""
    actual = source.select(F.col("doc_id").alias("id"), *content_digest(F.col("text"), "actual"))
    bad = F.lit(False)
    for c in COUNTERS:
        bad = bad | F.col(c).isNull() | (F.col(c) < 0)
    code = F.when(bad, "INVALID_SUMMARY").when(~F.col("input_sha256").eqNullSafe(F.col("actual_sha256")), "INPUT_DIGEST_MISMATCH").when(~F.col("input_bytes").eqNullSafe(F.col("actual_bytes")), "INPUT_SIZE_MISMATCH")
    own = cleaned.select("doc_id", *COUNTERS, "input_sha256", "input_bytes")
    return own.join(actual, F.col("doc_id") == F.col("id")).select("doc_id", code.alias("error_code")).where("error_code IS NOT NULL")
