"""Structured extraction: format detection, archive checks, document features, routing, conversion to Markdown."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.functions import markdown
from corpusmill.functions.arrays import let
from corpusmill.functions.text import BOM, strip

# Extensions and the formats they promise.
TEXT_EXTENSIONS = {"txt": "text", "log": "text", "md": "markdown", "markdown": "markdown", "json": "json", "xml": "xml", "yaml": "yaml", "yml": "yaml", "csv": "csv", "tsv": "tsv"}
BINARY_EXTENSIONS = {"pdf": "pdf", "doc": "doc", "docx": "docx", "ppt": "ppt", "pptx": "pptx", "xls": "xls", "xlsx": "xlsx", "epub": "epub", "png": "image", "jpg": "image", "jpeg": "image"}
NEVER = ("wps", "et", "dps", "ofd")
OLE = {"doc": "doc", "ppt": "ppt", "xls": "xls"}
# Processors by format.
ROUTES = {
    "mineru": ("pdf", "image", "pptx"),
    "docling": ("xls", "xlsx", "html", "epub"),
    "plain_text": ("json", "xml", "yaml", "csv", "tsv", "markdown", "text", "unknown_text"),
}
PRODUCTION_FORMATS = ("text", "markdown", "json", "xml", "yaml", "csv", "tsv")
SAMPLE_BYTES = 64 * 1024
# Archive limits.
MAX_ENTRIES, MAX_ENTRY_BYTES, MAX_TOTAL_BYTES = 1000, 10 << 20, 50 << 20
ENTRY = T.StructType().add("name", T.StringType()).add("size", T.LongType()).add("data", T.BinaryType())
#: Bytes of members that a task gathers before it hands them on.
OUTPUT_BYTES = 4 << 20


def extension_of(name: Column) -> Column:
    """Lower-case extension of the last path part, without its dot; empty if there is none."""
    last = F.substring_index(name, "/", -1)
    return F.lower(F.regexp_extract(last, r"[^.]\.([^.]+)\z", 1))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


@F.pandas_udf(T.StringType())
def _decode_gb18030(data: pd.Series) -> pd.Series:
    def one(raw):
        if raw is None:
            return None
        try:
            return bytes(raw).decode("gb18030")
        except UnicodeDecodeError:
            return None

    return data.map(one)


def decode_with_fallback(data: Column) -> Column:
    """``struct<text,encoding,error>``: UTF-8 with an optional BOM, else GB18030, both strict; content untouched.

    Only bytes that are not UTF-8 go to the codec outside the JVM, which has no GB18030 decoder of its own.
    """
    utf8 = F.try_validate_utf8(data.cast("string"))
    other = _decode_gb18030(F.when(utf8.isNull(), data))
    text = F.coalesce(F.when(utf8.startswith(BOM), F.substring(utf8, 2, 2147483647)).otherwise(utf8), other)
    encoding = F.when(utf8.isNotNull(), F.when(utf8.startswith(BOM), "utf-8-sig").otherwise("utf-8")).when(other.isNotNull(), "gb18030")
    return F.struct(text.alias("text"), encoding.alias("encoding"), F.when(data.isNotNull() & text.isNull(), "UNDECODABLE").alias("error"))


def detect_text_format(text: Column, extension: Column) -> Column:
    """Format of a decoded text: HTML by how it starts, else by extension; null where control characters stand."""
    start = F.lower(F.regexp_replace(F.substring(text, 1, SAMPLE_BYTES), r"(?U)\A[\s\x1c-\x1f]+", ""))
    html = start.rlike(r"\A(?:<!doctype html|<html|<head|<body)")
    return F.when(F.substring(text, 1, SAMPLE_BYTES).rlike(r"[\x00-\x08\x0e-\x1f]"), None).when(html, "html").otherwise(F.coalesce(_lookup(extension, TEXT_EXTENSIONS), F.lit("unknown_text")))


def detect_format(docs: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Add ``format, extension, error``. ``content`` is binary, or text already decoded.

    Archives come out as ``zip``: ``detect_zip_format`` tells which kind. A signature that contradicts the extension
    is unsupported.
    """
    ext = extension_of(F.col(name))
    if docs.schema[content].dataType.simpleString() == "binary":
        head = F.hex(F.substring(F.col(content), 1, 8))
        text = decode_with_fallback(F.substring(F.col(content), 1, SAMPLE_BYTES))["text"]
        found = (
            F.when(head.startswith("255044462D"), "pdf")
            .when((head == "89504E470D0A1A0A") | head.startswith("FFD8FF"), "image")
            .when(head == "D0CF11E0A1B11AE1", _lookup(ext, OLE))
            .when(head.startswith("504B0304"), "zip")
            .otherwise(detect_text_format(text, ext))
        )
    else:
        found = detect_text_format(F.col(content), ext)
    kept = docs.withColumn("extension", ext).withColumn("_f", found)
    promised, f = _lookup(F.col("extension"), BINARY_EXTENSIONS), F.col("_f")
    in_zip = promised.isin("docx", "pptx", "xlsx", "epub") & (f == "zip")
    typed = _lookup(F.col("extension"), TEXT_EXTENSIONS)
    conflict = (promised.isNotNull() & (f != promised) & ~in_zip) | (typed.isNotNull() & (f != typed) & (f != "html"))
    bad = F.when(F.col("extension").isin(*NEVER) | f.isNull(), True).otherwise(F.coalesce(conflict, F.lit(False)))
    return kept.withColumn("error", F.when(bad, "UNSUPPORTED_INPUT_FORMAT")).withColumn("format", F.when(~bad, f)).drop("_f")


def members(raw: bytes | None) -> Iterator[tuple[str | None, int | None, bytes | None, str | None]]:
    """``name, size, data, error`` of each member, one at a time; one row without a name if there is none. Data of members
    or archives beyond the limits isn't read, and none of an archive in which a member can't be read."""
    if raw is None:
        yield None, None, None, None
        return
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            infos = z.infolist()
            small = len(infos) <= MAX_ENTRIES and sum(i.file_size for i in infos) <= MAX_TOTAL_BYTES
            found = [(i.filename.replace("\\", "/"), i.file_size, z.read(i) if small and i.file_size <= MAX_ENTRY_BYTES else None, None) for i in infos]
    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError):
        found = [(None, None, None, "INVALID_ARCHIVE")]
    yield from found or [(None, None, None, None)]


def entry_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of members, the first two columns of their archives ahead: a new one as soon as ``OUTPUT_BYTES`` are held."""
    types = [(f.name, to_arrow_type(f.dataType)) for f in ENTRY.fields] + [("error", pa.string())]

    def batch_of(batch, at, rows):
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)]
        taken = batch.select([0, 1]).take(pa.array(at))
        return pa.RecordBatch.from_arrays([*taken.columns, *columns], names=[*batch.schema.names[:2], *(n for n, _ in types)])

    for batch in batches:
        at, rows, held = [], [], 0
        for i in range(batch.num_rows):
            for row in members(batch.column(2)[i].as_py()):
                at.append(i)
                rows.append(row)
                held += len(row[2] or b"") + 64
                if held > OUTPUT_BYTES:
                    yield batch_of(batch, at, rows)
                    at, rows, held = [], [], 0
        if rows:
            yield batch_of(batch, at, rows)


def archive_entries(docs: DataFrame, key: str = "doc_id", content: str = "content", file_name: str | None = None) -> DataFrame:
    """``key, extension, name, size, data, error``: a row per member. An archive that cannot be read, or holds nothing,
    is one row without a member. ``file_name`` names the column of the archives' own names. A task holds one archive's
    members and ``OUTPUT_BYTES`` of those before, however many rows come in."""
    named = extension_of(F.col(file_name)) if file_name else F.lit(None).cast("string")
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("extension", T.StringType()), *ENTRY.fields, T.StructField("error", T.StringType())])
    return docs.select(key, named.alias("extension"), F.col(content).alias("content")).mapInArrow(entry_batches, schema)


def _archive_facts() -> list[Column]:
    unsafe = F.col("name").startswith("/") | F.array_contains(F.split("name", "/"), "..")
    return [F.count("name").alias("n"), F.max("size").alias("largest"), F.sum("size").alias("total"), F.bool_or(unsafe).alias("unsafe")]


def _beyond_limits() -> Column:
    return (
        F.when(F.col("unsafe"), "UNSAFE_PATH").when(F.col("n") > MAX_ENTRIES, "TOO_MANY_ENTRIES")
        .when(F.col("largest") > MAX_ENTRY_BYTES, "ENTRY_TOO_LARGE").when(F.col("total") > MAX_TOTAL_BYTES, "ARCHIVE_TOO_LARGE")
    )


def archive_violations(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, error`` of archives that cannot be read, are beyond the limits, or hold absolute or parent paths."""
    facts = entries.groupBy(key).agg(*_archive_facts(), F.max("error").alias("unreadable"))
    return facts.select(key, F.coalesce("unreadable", _beyond_limits()).alias("error")).where("error IS NOT NULL")


def detect_zip_format(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, format, error``, one row per archive: EPUB by its ``mimetype`` member, else exactly one office structure.

    Archives that cannot be read or break the limits are invalid; where the archive's own extension is known, an office
    structure other than it promises is unsupported."""
    has = lambda n: F.coalesce(F.bool_or(F.col("name") == n), F.lit(False))
    facts = entries.groupBy(key).agg(
        F.coalesce(F.bool_or((F.col("name") == "mimetype") & (F.col("data").cast("string") == "application/epub+zip")), F.lit(False)).alias("epub"),
        has("[Content_Types].xml").alias("types"), has("word/document.xml").alias("docx"), has("ppt/presentation.xml").alias("pptx"), has("xl/workbook.xml").alias("xlsx"),
        *_archive_facts(), F.max("error").alias("unreadable"), F.max("extension").alias("extension"),
    )
    kinds = F.array_compact(F.array(*(F.when(F.col(k), k) for k in ("docx", "pptx", "xlsx"))))
    bad = F.coalesce("unreadable", _beyond_limits()).isNotNull()
    office = F.when(F.col("types") & (F.size(kinds) == 1), F.get(kinds, F.lit(0)))
    promised = F.coalesce(_lookup(F.col("extension"), BINARY_EXTENSIONS) == office, F.col("extension").isNull())
    error = F.when(bad, "INVALID_ARCHIVE").when(F.col("epub"), None).when(office.isNull(), "INVALID_ARCHIVE").when(~promised, "UNSUPPORTED_INPUT_FORMAT")
    return facts.select(key, F.when(error.isNull(), F.when(F.col("epub"), "epub").otherwise(office)).alias("format"), error.alias("error"))


def docx_counts(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """Element and member counts of each document's package."""
    name = F.col("name")
    body = F.when(name == "word/document.xml", F.col("data").cast("string"))
    tags = lambda local: F.coalesce(F.sum(F.size(F.regexp_extract_all(body, F.lit(rf"(<(?:\w+:)?{local}(?=[\s/>]))"), F.lit(1)))), F.lit(0)).cast("int")
    runs = F.regexp_extract_all(body, F.lit(r"<(?:\w+:)?t(?:\s[^>]*)?>([^<]*)</"), F.lit(1))
    chars = F.aggregate(F.transform(runs, lambda r: F.char_length(F.regexp_replace(r, "&[#A-Za-z0-9]+;", "x"))), F.lit(0), lambda a, n: a + n)
    member = lambda cond: F.count_if(cond).cast("int")
    return entries.groupBy(key).agg(
        F.coalesce(F.sum(chars), F.lit(0)).cast("int").alias("text_character_count"),
        member(name.startswith("word/media/") & ~name.endswith("/")).alias("image_count"),
        (tags("drawing") + tags("pict")).alias("drawing_count"),
        tags("anchor").alias("anchored_object_count"),
        tags("txbxContent").alias("text_box_count"),
        tags("cols").alias("column_section_count"),
        member(name.startswith("word/charts/") & name.endswith(".xml")).alias("chart_count"),
        member(name.startswith("word/embeddings/") & ~name.endswith("/")).alias("embedded_object_count"),
    )


def docx_features(counted: DataFrame) -> DataFrame:
    """Add ``image_dominant, scanned_page_likelihood, visual_complexity_score, reasons`` to the counts."""
    images, chars = F.col("image_count"), F.col("text_character_count")
    dominant = (images > 0) & (chars < images * 200)
    likelihood = F.when(images > 0, F.least(F.lit(1.0), images * 200 / F.greatest(chars, F.lit(1)))).otherwise(0.0)
    weights = {"drawing_count": 1, "anchored_object_count": 2, "text_box_count": 2, "column_section_count": 1, "chart_count": 2, "embedded_object_count": 2}
    names = ("drawings", "anchored_objects", "text_boxes", "column_sections", "charts", "embedded_objects")
    score = F.when(dominant, 2).otherwise(0)
    reasons = [F.when(dominant, "image_dominant_document")]
    for (column, weight), name in zip(weights.items(), names, strict=True):
        score = score + weight * F.col(column)
        reasons.append(F.when(F.col(column) > 0, F.concat(F.lit(f"{name}="), F.col(column).cast("string"))))
    return counted.select("*", dominant.alias("image_dominant"), likelihood.alias("scanned_page_likelihood"), score.cast("int").alias("visual_complexity_score"), F.array_compact(F.array(*reasons)).alias("reasons"))


def route_documents(docs: DataFrame, threshold: int = 5, allowed: tuple[str, ...] = PRODUCTION_FORMATS) -> DataFrame:
    """Add ``processor, route_reasons, route_error`` by ``format``; ``docx`` by ``visual_complexity_score``, ``reasons``."""
    fmt = F.col("format")
    fixed = F.coalesce(*(F.when(fmt.isin(*formats), p) for p, formats in ROUTES.items()))
    scored = "visual_complexity_score" in docs.columns
    score = F.col("visual_complexity_score") if scored else F.lit(None).cast("int")
    why = F.col("reasons") if "reasons" in docs.columns else F.array().cast("array<string>")
    docx = F.when((fmt == "docx") & score.isNotNull(), F.when(score >= threshold, "mineru").otherwise("docling"))
    processor = F.when(fmt.isin(*allowed) & ~fmt.isin("doc", "ppt"), F.coalesce(fixed, docx))
    visual = F.when(F.size(why) > 0, why).otherwise(F.array(F.concat(F.lit("visual_complexity_score="), score.cast("string"))))
    reasons = F.when(fmt == "docx", F.when(score >= threshold, visual).otherwise(F.array(F.lit("ordinary_docx")))).otherwise(F.array(F.concat(F.lit("fixed_route="), fmt)))
    return docs.withColumn("processor", processor).withColumn("route_reasons", F.when(processor.isNotNull(), reasons)).withColumn("route_error", F.when(processor.isNull(), "UNSUPPORTED_ROUTE"))


def content_list_to_markdown(items: Column) -> Column:
    """Markdown of a JSON list of ``{type, text}``: images out, texts stripped, titles marked, blank lines between; null
    if nothing is left or the JSON isn't a list."""
    parsed = F.from_json(items, "array<struct<type:string,text:string>>")
    kept = F.filter(F.transform(F.filter(parsed, lambda x: F.coalesce(x["type"], F.lit("")) != "image"), lambda x: F.struct(x["type"].alias("type"), strip(x["text"]).alias("text"))), lambda x: F.coalesce(x["text"], F.lit("")) != "")
    parts = F.transform(kept, lambda x: F.when(x["type"] == "title", F.concat(F.lit("# "), x["text"])).otherwise(x["text"]))
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, "\n\n"), F.lit("\n")))


def _image_marks(text: Column) -> Column:
    return F.contains(text, F.lit("![")) | text.rlike("(?i)<img|data:image")


def strip_images(text: Column) -> Column:
    """Images as their alternative text; texts without an image mark are not read as Markdown."""
    return F.when(_image_marks(text), let(markdown.blocks(text), markdown.strip_images)).otherwise(text)


def has_forbidden_image_content(text: Column) -> Column:
    return F.when(_image_marks(text), let(markdown.blocks(text), markdown.has_forbidden_image)).otherwise(False)


def check_extraction_output(text: Column, max_bytes: int = 50 << 20) -> Column:
    """Error code of an output unfit to publish, else null."""
    return F.when(text.isNull() | (text == ""), "EMPTY_OUTPUT").when(text.startswith(BOM), "UNEXPECTED_BOM").when(F.octet_length(text) > max_bytes, "OUTPUT_TOO_LARGE").when(~F.is_valid_utf8(text), "INVALID_UTF8")
