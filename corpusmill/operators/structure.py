"""Markdown structure as tables and columns: blocks, protected spans, line offsets, merged spans, blank runs.

All of it is expressions of one narrow stage; only operators over rows of spans or lines shuffle, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import markdown
from corpusmill.functions.arrays import let, running_totals

CONTAINERS = markdown.CONTAINERS
#: SQL over rows of ``segment_blocks``: paragraphs not inside a list item, quote or table.
IS_TOP_LEVEL_PARAGRAPH = "type = 'paragraph' AND top_level"


def place_blocks(text: Column) -> Column:
    """Located blocks of a text, blank ones included; see ``markdown.located``."""
    return let(markdown.blocks(text), markdown.located)


def blocks_of(text: Column) -> Column:
    """``array<struct<type,line_start,line_end,start,end,top_level,depth,parent>>`` without blank blocks, in order of (start,
    depth): the blocks of the text, and those that block quotes and list items hold, at all depths, with the start of the
    container around them."""
    return let(place_blocks(text), placed_blocks)


def placed_blocks(places: Column) -> Column:
    """The same of located blocks."""
    fields = ("start", "depth", "end", "type", "line_start", "line_end", "parent")

    def rows(b):
        value = {"depth": F.lit(0), "parent": F.lit(None).cast("int")}
        own = F.struct(*(value.get(c, b[c] if c not in value else None).alias(c) for c in fields))
        inner = F.transform(markdown.nested_blocks(b), lambda n: F.struct(*(n[c].alias(c) for c in fields)))
        return F.when(b["type"].isin(*CONTAINERS), F.concat(F.array(own), inner)).otherwise(F.array(own))

    found = F.array_sort(F.flatten(F.transform(F.filter(places, lambda b: b["type"] != "blank"), rows)))
    shown = ("type", "line_start", "line_end", "start", "end")
    return F.transform(found, lambda b: F.struct(*(b[c].alias(c) for c in shown), (b["depth"] == 0).alias("top_level"), b["depth"].alias("depth"), b["parent"].alias("parent")))


def protected_spans(text: Column) -> Column:
    """``array<struct<kind,start,end>>``, left to right and disjoint."""
    return let(place_blocks(text), markdown.protected)


def link_targets(text: Column) -> Column:
    return let(markdown.blocks(text), markdown.link_targets)


def block_type_signature(text: Column) -> Column:
    """Types of the blocks, those inside containers too."""
    return F.transform(blocks_of(text), lambda b: b["type"])


def visible_text(text: Column) -> Column:
    return let(markdown.blocks(text), markdown.visible_text)


def segment_blocks(docs: DataFrame) -> DataFrame:
    """``doc_id, block_ix, type, line_start, line_end, start, end, top_level, depth, parent``, in order of (start, depth);
    ``parent`` is the start of the container around a block."""
    return docs.select("doc_id", F.posexplode(blocks_of(F.col("text"))).alias("block_ix", "b")).select("doc_id", "block_ix", "b.*")


def text_lines(text: Column) -> Column:
    """Lines without their ends; CRLF, CR and LF only."""
    return F.split(text, r"\r\n|\r|\n", -1)


def line_offsets(text: Column) -> Column:
    """Code-point offset at which each line starts."""
    ends = F.regexp_extract_all(text, F.lit(r"(\r\n|\r|\n)"), F.lit(1))
    lengths = let(text_lines(text), lambda lines: F.zip_with(F.slice(lines, F.lit(1), F.size(lines) - 1), ends, lambda x, e: F.char_length(x) + F.char_length(e)))
    return F.concat(F.array(F.lit(0)), running_totals(lengths))


def lines_to_span(text: Column, line_start: Column, line_end: Column) -> Column:
    """Span of the half-open range of lines."""
    return let(line_offsets(text), lambda at: F.struct(F.get(at, line_start).alias("start"), F.coalesce(F.get(at, line_end), F.char_length(text)).alias("end")))


def merge_spans(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Overlapping spans of a key as one; spans that only touch stay apart."""
    order = Window.partitionBy("key").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.select(F.col(key).alias("key"), "start", "end").withColumn("fresh", F.when(F.col("start") < reach, 0).otherwise(1))
    island = flagged.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(F.col("key").alias(key), "start", "end")


def unclosed_fence(text: Column) -> Column:
    """True if a fence stays open; only texts that hold a fence mark are searched."""
    return markdown.unclosed_fence(text)


def blank_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, line_start, line_end``: maximal runs of white-space-only lines, half open."""
    lines = docs.select("doc_id", F.posexplode(text_lines(F.col("text"))).alias("line", "content")).where(~F.col("content").rlike(r"(?U)\S"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    return lines.select("doc_id", "line", (F.col("line") - rank).alias("run")).groupBy("doc_id", "run").agg(F.min("line").alias("line_start"), (F.max("line") + 1).alias("line_end")).drop("run")


def top_level_paragraphs(blocks: DataFrame) -> DataFrame:
    """Paragraph blocks not inside a list item, quote or table of their document. Blocks that say so themselves, as those
    of ``segment_blocks`` do, are read once; others are joined with the containers."""
    if "top_level" in blocks.columns:
        return blocks.where(IS_TOP_LEVEL_PARAGRAPH)
    box = blocks.where(F.col("type").isin(*CONTAINERS, "table")).select(F.col("doc_id").alias("box_doc"), F.col("start").alias("box_start"), F.col("end").alias("box_end"))
    inside = (blocks["doc_id"] == box["box_doc"]) & (blocks["start"] >= box["box_start"]) & (blocks["end"] <= box["box_end"])
    return blocks.where("type = 'paragraph'").join(box, inside, "left_anti")
