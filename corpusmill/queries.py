"""Registered queries of the library's own operators, and the SQL that gives the same rows.

Every query reads the given tables. Where the tables lack what an operator looks for (images, fences, phone numbers),
the query adds a mark made of the row's own values to every row, and the SQL does the same.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import markdown
from corpusmill.functions import text as T
from corpusmill.functions.ordering import spread, with_positions
from corpusmill.functions.storage import materialize, new_path
from corpusmill.operators import classify, cleaning, components, dedup, extract, intake, pii, structure, validation
from corpusmill.plans import flows
from corpusmill.sources import files, sinks
from corpusmill.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

REQUEST, TASK = "request-1", flows.TASK_ID


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("uid"), "text")


DOC_PATH = "concat(source, '/', doc_id, '.txt')"
SQL_PATH = "source || '/' || doc_id || '.txt'"
SPACED = "replace(text, '\\n', '\\n\\n')"
SQL_STRIP = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160))"
# Marks made of the text's own words: code, links and images; and two blanks behind the lines that begin with T.
MARKED = "replace(replace(text, ' the ', ' `the` '), ' of ', ' [of](u/of) ')"
MARKED_SHOWN = "replace(text, ' the ', ' `the` ')"
SQL_UNSTRESSED = "{text}"
for _pair in (r"\*\*([^*\r\n]+)\*\*", r"__([^_\r\n]+)__", r"\*([^*\r\n]+)\*", r"_([^_\r\n]+)_", r"~~([^~\r\n]+)~~"):
    SQL_UNSTRESSED = f"regexp_replace({SQL_UNSTRESSED}, '{_pair}', '\\1', 'g')"
IMAGED = "replace(replace(text, ' the ', ' `![x](y)` '), ' of ', ' ![of](p.png) ')"
BLANKED, SQL_BLANKED = "regexp_replace(text, '(?m)^(T.*)$', '$1  ')", "regexp_replace(text, '(?m)^(T.*)$', '\\1  ', 'g')"
SQL_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.surviving_by_language(documents(spark, sf_dir))


_queries["surviving_by_language"] = flagship
_sql["surviving_by_language"] = f"""
SELECT lang, count(*) AS total, count(*) FILTER (WHERE doc_id = rep) AS kept
FROM (SELECT lang, doc_id, min(doc_id) OVER (PARTITION BY {SQL_STRIP}) AS rep FROM documents) GROUP BY lang"""

# --- sources and validation -------------------------------------------------------------------------------------


@query("""
SELECT source, count(*) AS lines, CAST(sum(strlen(replace(text, chr(10), ' ')) + 1) AS BIGINT) AS bytes, true AS named FROM documents GROUP BY source""")
def a1_scan_documents(spark, sf_dir):
    """The texts, a line each, written as text files below one folder per source, and scanned."""
    path = new_path(spark, "scan")
    documents(spark, sf_dir).select("source", F.replace(F.col("text"), F.lit("\n"), F.lit(" ")).alias("value")).write.partitionBy("source").text(path)
    found = files.scan_documents(spark, path).select(F.regexp_extract("path", "^source=([^/]*)/", 1).alias("source"), "content", "size_bytes", (F.col("file_id") == F.sha2("path", 256)).alias("named"))
    breaks = F.octet_length("content") - F.octet_length(F.regexp_replace(F.col("content").cast("string"), "\n", ""))
    return found.groupBy("source").agg(F.sum(breaks).cast("long").alias("lines"), F.sum("size_bytes").alias("bytes"), F.bool_and("named").alias("named"))


@query("""
SELECT 'INVALID_ENTRY' AS code, CAST(doc_id AS VARCHAR) AS file_id FROM documents WHERE length(text) % 50 = 0
UNION ALL SELECT 'DUPLICATE_FILE_ID', CAST(doc_id AS VARCHAR) FROM documents WHERE length(text) % 50 = 1
UNION ALL SELECT 'TOO_MANY_DOCUMENTS', NULL FROM documents HAVING count(*) + count(*) FILTER (WHERE length(text) % 50 = 1) > 500""")
def a3_load_manifest(spark, sf_dir):
    """A manifest of all documents, an entry a line: some without a path, some twice."""
    path, kind = new_path(spark, "manifest"), F.char_length("text") % 50
    docs = documents(spark, sf_dir).select(F.explode(F.sequence(F.lit(0), F.when(kind == 1, 1).otherwise(0))), F.col("doc_id").cast("string").alias("fileId"), F.when(kind == 0, " ").otherwise(F.expr(DOC_PATH)).alias("fileStoragePath"), F.lit(1).alias("other"))
    docs.drop("col").write.json(path)
    return files.load_manifest(spark, path, 500)[1]


@query("""
WITH r AS (SELECT doc_id, 'd' || doc_id % 16 AS name, text FROM documents),
f AS (SELECT name, count(*) AS lines, CAST(sum(strlen(replace(replace(text, chr(10), ' '), chr(13), ' ')) + 1) AS BIGINT) AS size_bytes FROM r GROUP BY name)
SELECT name || '-here' AS file_id, lines, size_bytes, CAST(NULL AS VARCHAR) AS error_code FROM f
UNION ALL SELECT name || '-gone', NULL, NULL, 'DOCUMENT_NOT_FOUND' FROM f UNION ALL SELECT name || '-out', NULL, NULL, 'DOCUMENT_PATH_NOT_ALLOWED' FROM f UNION ALL SELECT name || '-other', NULL, NULL, 'UNSUPPORTED_DOCUMENT_FORMAT' FROM f""")
def a3_manifest_documents(spark, sf_dir):
    """The texts, a line each, dealt into text files in folders by id; a manifest names the files that are there, and for
    each folder one that is missing, one outside the root, and one of another format. Followed to the files, by folder."""
    root, manifest = new_path(spark, "followed"), new_path(spark, "manifest")
    name = F.concat(F.lit("d"), (F.col("doc_id") % 16).cast("string"))
    documents(spark, sf_dir).select(name.alias("name"), F.translate("text", "\n\r", "  ").alias("value")).write.partitionBy("name").text(root)
    listed = files.scan_documents(spark, root).select("path")
    folders = documents(spark, sf_dir).select(name.alias("name")).distinct()
    entry = lambda kind, path: F.struct(F.concat("name", F.lit(f"-{kind}")).alias("fileId"), path.alias("fileStoragePath"))
    others = folders.select(F.explode(F.array(entry("gone", F.concat(F.lit("name="), "name", F.lit("/none.txt"))), entry("out", F.concat(F.lit("../"), "name", F.lit(".txt"))), entry("other", F.concat("name", F.lit(".pdf"))))).alias("e")).select("e.*")
    here = listed.select(F.concat(F.regexp_extract("path", "^name=([^/]*)/", 1), F.lit("-here")).alias("fileId"), F.col("path").alias("fileStoragePath"))
    here.unionByName(others).write.json(manifest)
    found = files.follow_manifest(files.load_manifest(spark, manifest)[0], root)
    breaks = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))
    return found.groupBy("file_id", "error_code").agg(F.sum(breaks).cast("long").alias("lines"), F.sum("size_bytes").alias("size_bytes"))


@query(f"""
SELECT doc_id, CASE WHEN lang = 'en' THEN 's3a://' || source || '/' || doc_id WHEN lang = 'de' THEN {SQL_PATH} WHEN source = first THEN 's3a://' || source || '/' || doc_id END AS path,
  CASE WHEN lang IN ('es', 'fr') AND source <> first THEN 'BUCKET_NOT_ALLOWED' END AS error FROM documents, (SELECT min(source) AS first FROM documents) WHERE lang <> 'en' OR source = first""")
def a10_object_store_read(spark, sf_dir):
    """Object-store paths in the bucket of the first source are allowed, those in others are not; plain paths are."""
    docs = documents(spark, sf_dir)
    first = docs.agg(F.min("source")).head()[0]
    path = F.when(F.col("lang") == "de", F.expr(DOC_PATH)).otherwise(F.concat(F.when(F.col("lang") == "en", "s3a://").otherwise("s3://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")))
    return docs.where((F.col("lang") != "en") | (F.col("source") == first)).select("doc_id", files.allowed_location(path, (first,)).alias("l")).select("doc_id", "l.*")


@query(f"SELECT {SQL_PATH} AS path, doc_id, row_number() OVER (ORDER BY {SQL_PATH}) - 1 AS uid FROM documents")
def a2_assign_uids(spark, sf_dir):
    return with_positions(documents(spark, sf_dir).select(F.expr(DOC_PATH).alias("path"), "doc_id"), ["path"])


@query("SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents")
def a4_normalize_text(spark, sf_dir):
    marked = F.concat(F.lit(T.BOM), F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))).cast("binary")
    return documents(spark, sf_dir).select("doc_id", T.normalize_text(marked).alias("text"))


@query("SELECT doc_id, text, 'utf-8' AS encoding, CAST(NULL AS VARCHAR) AS error FROM documents")
def a5_decode_with_fallback(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", extract.decode_with_fallback(F.col("text").cast("binary")).alias("d")).select("doc_id", "d.*")


@query("""
SELECT 'DOCUMENT_TOO_LARGE' AS code, doc_id AS uid FROM documents WHERE strlen(text) > 20000
UNION ALL SELECT 'BATCH_TOO_LARGE', min(doc_id) FROM (SELECT doc_id, sum(strlen(text)) OVER (ORDER BY doc_id) AS run FROM documents) WHERE run > 400000 HAVING count(*) > 0
UNION ALL SELECT 'TOO_MANY_DOCUMENTS', NULL FROM documents HAVING count(*) > 500""")
def a6_enforce_batch_budget(spark, sf_dir):
    sized = documents(spark, sf_dir).select(F.col("doc_id").alias("uid"), F.octet_length("text").cast("long").alias("size_bytes"))
    return validation.enforce_batch_budget(sized, validation.BatchLimits(documents=500, document_bytes=20_000, total_bytes=400_000))


@query("""
SELECT doc_id + 1 AS line_no, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 IN (1, 2) THEN NULL ELSE doc_id END AS uid,
  CASE WHEN doc_id % 10 = 0 THEN 'INVALID_JSON' WHEN doc_id % 10 = 1 THEN 'UNKNOWN_FIELDS' WHEN doc_id % 10 = 2 THEN 'INVALID_UID' END AS error_code FROM documents""")
def a7_validate_samples(spark, sf_dir):
    good = F.to_json(F.struct(F.col("doc_id").alias("uid"), "text"))
    kind = F.col("doc_id") % 10
    line = F.when(kind == 0, F.concat(F.lit("{"), good)).when(kind == 1, F.to_json(F.struct(F.col("doc_id").alias("uid"), "text", "lang"))).when(kind == 2, F.to_json(F.struct(F.lit("x").alias("uid"), "text"))).otherwise(good)
    rows, bad = validation.validate_samples(documents(spark, sf_dir).select((F.col("doc_id") + 1).alias("line_no"), line.alias("value")))
    ok = rows.select((F.col("uid") + 1).alias("line_no"), "uid", F.lit(None).cast("string").alias("error_code"))
    return ok.unionByName(bad.select("line_no", F.lit(None).cast("long").alias("uid"), "error_code"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'UNSUPPORTED_INPUT_FORMAT' WHEN strlen(text) > 9000 THEN 'INPUT_TOO_LARGE' WHEN doc_id % 5 = 0 THEN 'INVALID_CONTROL_CHARACTER' WHEN doc_id % 3 = 0 THEN 'INVALID_MARKDOWN' END AS error_code FROM documents""")
def a8_validate_markdown_input(spark, sf_dir):
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".pdf").otherwise(".MD"))
    body = F.concat(F.when(F.col("doc_id") % 5 == 0, F.lit("\x07")).otherwise(""), F.when(F.col("doc_id") % 3 == 0, "~~~\n").otherwise(""), F.col("text"))
    code = F.when(F.octet_length("text") > 9000, validation.validate_markdown_input(name, F.col("text").cast("binary"), 9000)).otherwise(validation.validate_markdown_input(name, body.cast("binary"), 9010))
    return documents(spark, sf_dir).select("doc_id", code.alias("error_code"))


@query(f"SELECT doc_id, CASE WHEN {SQL_STRIP} = '' THEN 'INVALID_TEXT' WHEN length(text) > 3000 OR strlen(text) > 3100 THEN 'TEXT_TOO_LARGE' END AS error_code FROM documents")
def a9_validate_classifier_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", validation.validate_classifier_text(F.col("text"), 3000, 3100).alias("error_code"))


@query(f"SELECT source, count(*) AS documents, sha256(string_agg({SQL_PATH}, chr(10) ORDER BY {SQL_PATH})) AS fingerprint FROM documents GROUP BY source")
def a11_batch_fingerprint(spark, sf_dir):
    return validation.batch_fingerprint(documents(spark, sf_dir).select("source", F.expr(DOC_PATH).alias("path")), ["source"]).drop("set_digest")


# --- extraction ---------------------------------------------------------------------------------------------------

FORMATS = "pdf image pptx xls xlsx html epub json xml yaml csv tsv markdown text unknown_text docx doc ppt".split()
SQL_FORMATS = "[" + ", ".join(f"'{f}'" for f in FORMATS) + "]"


@query(r"""
SELECT page_id, lower(regexp_extract(list_extract(string_split(url, '/'), -1), '[^.]\.([^.]+)$', 1)) AS extension,
  CASE WHEN regexp_matches(lower(ltrim(html)), '^(<!doctype html|<html|<head|<body)') THEN 'html' ELSE 'unknown_text' END AS format, CAST(NULL AS VARCHAR) AS error FROM pages""")
def b1_detect_format(spark, sf_dir):
    return extract.detect_format(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "url", "html").select("page_id", "extension", "format", "error")


def _package(i: int, body: str) -> bytes:
    """A small word-processor package around a text: the archive operators' input."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        body = body.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        z.writestr("word/document.xml", f"<w:document><w:t>{body}</w:t>{'<w:drawing/>' * (i % 4)}{'<wp:anchor/>' * (i % 3)}</w:document>")
        for k in range(i % 5):
            z.writestr(f"word/media/{k}.png", "x" * (k + 1))
    return out.getvalue()


def _archive(lang: str, body: str) -> bytes:
    """An archive around a text, its kind by the language."""
    members = {"en": ["word/document.xml"], "de": ["xl/workbook.xml"], "fr": [], "es": ["ppt/presentation.xml"]}[lang]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip" if lang == "fr" else body)
        z.writestr("[Content_Types].xml", "<Types/>")
        for name in members:
            z.writestr(name, body)
    return out.getvalue()[: 40 if lang == "es" and len(body) % 2 == 0 else None]


def _packed(docs: DataFrame, kind: str, make: Callable[[object, str], bytes], rows: int = 64) -> DataFrame:
    """``doc_id, content``: an archive around each text, made of it and of the column ``kind``, a few rows at a time."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = [make(k, t or "") for k, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["doc_id", "content"])

    return docs.select("doc_id", F.col(kind).alias("kind"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, content binary")


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.archive_entries(_packed(documents(spark, sf_dir), "doc_id", _package))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'docx' WHEN 'fr' THEN 'epub' END AS format,
  CASE lang WHEN 'de' THEN 'UNSUPPORTED_INPUT_FORMAT' WHEN 'es' THEN CASE WHEN length(text) % 2 = 0 THEN 'INVALID_ARCHIVE' ELSE 'UNSUPPORTED_INPUT_FORMAT' END END AS error FROM documents""")
def b2_detect_zip_format(spark, sf_dir):
    """English: documents; German: a workbook named as a document; French: a book; Spanish: cut short, or a show named so."""
    named = _packed(documents(spark, sf_dir), "lang", _archive).withColumn("file", F.lit("x.docx"))
    return extract.detect_zip_format(extract.archive_entries(named, file_name="file"))


@query("""
SELECT doc_id, '[Content_Types].xml' AS name, CAST(8 AS BIGINT) AS size FROM documents
UNION ALL SELECT doc_id, 'word/document.xml', strlen('<w:document><w:t></w:t></w:document>') + strlen(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + (doc_id % 4) * 12 + (doc_id % 3) * 12 FROM documents
UNION ALL SELECT doc_id, 'word/media/' || k || '.png', k + 1 FROM (SELECT doc_id, unnest(range(doc_id % 5)) AS k FROM documents)""")
def b3_archive_entries(spark, sf_dir):
    return packages(spark, sf_dir).select("doc_id", "name", "size")


@query("""
WITH c AS (SELECT doc_id, length(text) AS chars, doc_id % 5 AS images, doc_id % 4 AS drawings, doc_id % 3 AS anchors FROM documents)
SELECT doc_id, CAST(chars AS INT) AS text_character_count, CAST(images AS INT) AS image_count, images > 0 AND chars < 200 * images AS image_dominant,
  CASE WHEN images > 0 THEN least(1.0::DOUBLE, images * 200 / greatest(chars, 1)::DOUBLE) ELSE 0.0::DOUBLE END AS scanned_page_likelihood,
  CAST(CASE WHEN images > 0 AND chars < 200 * images THEN 2 ELSE 0 END + drawings + 2 * anchors AS INT) AS visual_complexity_score,
  concat_ws(',', CASE WHEN images > 0 AND chars < 200 * images THEN 'image_dominant_document' END, CASE WHEN drawings > 0 THEN 'drawings=' || drawings END, CASE WHEN anchors > 0 THEN 'anchored_objects=' || anchors END) AS reasons FROM c""")
def b4_docx_features(spark, sf_dir):
    found = extract.docx_features(extract.docx_counts(packages(spark, sf_dir)))
    return found.select("doc_id", "text_character_count", "image_count", "image_dominant", "scanned_page_likelihood", "visual_complexity_score", F.array_join("reasons", ",").alias("reasons"))


@query(f"""
WITH f AS (SELECT doc_id, {SQL_FORMATS}[doc_id % 18 + 1] AS format, n_chars % 9 AS score FROM documents),
p AS (SELECT *, CASE WHEN format IN ('pdf', 'image', 'pptx') THEN 'mineru' WHEN format IN ('xls', 'xlsx', 'html', 'epub') THEN 'docling'
  WHEN format IN ('doc', 'ppt') THEN NULL WHEN format = 'docx' THEN CASE WHEN score >= 5 THEN 'mineru' ELSE 'docling' END ELSE 'plain_text' END AS processor FROM f)
SELECT doc_id, format, processor, CASE WHEN processor IS NULL THEN NULL WHEN format = 'docx' THEN CASE WHEN score >= 5 THEN 'visual_complexity_score=' || score ELSE 'ordinary_docx' END ELSE 'fixed_route=' || format END AS reasons,
  CASE WHEN processor IS NULL THEN 'UNSUPPORTED_ROUTE' END AS route_error FROM p""")
def b5_route_documents(spark, sf_dir):
    fmt = F.element_at(F.array(*map(F.lit, FORMATS)), (F.col("doc_id") % 18 + 1).cast("int"))
    docs = documents(spark, sf_dir).select("doc_id", fmt.alias("format"), (F.col("n_chars") % 9).alias("visual_complexity_score"))
    return extract.route_documents(docs, 5, tuple(FORMATS)).select("doc_id", "format", "processor", F.array_join("route_reasons", ",").alias("reasons"), "route_error")


@query("""
SELECT conv_id, string_agg(CASE WHEN turn = 0 THEN '# ' || t ELSE t END, chr(10) || chr(10) ORDER BY turn, t) FILTER (WHERE turn % 5 <> 4 AND t <> '') || chr(10) AS markdown
FROM (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations) GROUP BY conv_id""")
def b6_content_list_to_markdown(spark, sf_dir):
    kind = F.when(F.col("turn") % 5 == 4, "image").when(F.col("turn") == 0, "title").otherwise("text")
    items = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", kind.alias("type"), "text"))).alias("i"))
    return items.select("conv_id", extract.content_list_to_markdown(F.to_json("i")).alias("markdown"))


@query("SELECT doc_id, replace(text, ' the ', ' `![x](y)` ') AS text FROM documents")
def b7_strip_images(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", extract.strip_images(F.expr(IMAGED)).alias("text"))


@query("SELECT doc_id, contains(replace(text, ' the ', ' `![x](y)` '), ' of ') AS forbidden FROM documents")
def b8_has_forbidden_image_content(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", extract.has_forbidden_image_content(F.expr(IMAGED)).alias("forbidden"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 'EMPTY_OUTPUT' WHEN strlen(text) > 4000 THEN 'OUTPUT_TOO_LARGE' END AS error_code FROM documents")
def b9_check_extraction_output(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", extract.check_extraction_output(F.col("text"), 4000).alias("error_code"))


# --- structure ----------------------------------------------------------------------------------------------------


@query(f"""
SELECT doc_id, CAST(line AS INT) AS block_ix, 'paragraph' AS type, CAST(2 * line AS INT) AS line_start,
  CAST(coalesce(sum(length(content) + 2) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start, CAST(length(content) AS INT) AS size FROM ({SQL_LINES})""")
def c1_segment_blocks(spark, sf_dir):
    blocks = structure.segment_blocks(documents(spark, sf_dir).select("doc_id", F.expr(SPACED).alias("text")))
    return blocks.select("doc_id", "block_ix", "type", "line_start", "start", (F.col("end") - F.col("start")).alias("size"))


#: Each line as a list item in a quote, and again in a fence in that item.
SQL_CONTAINED = f"SELECT *, CAST(coalesce(sum(2 * length(content) + 27) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS s, CAST(length(content) AS INT) AS n, CAST(5 * line AS INT) AS l FROM ({SQL_LINES})"


def _contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda c: F.concat(F.lit("> - "), c, F.lit("\n>   ~~~\n>   "), c, F.lit("\n>   ~~~\n\n")))
    return documents(spark, sf_dir).select("doc_id", F.array_join(lines, "").alias("text"))


@query(f"""
SELECT doc_id, type, line_start, line_end, start, "end", depth, parent FROM (SELECT doc_id, unnest([
  {{'type': 'blockquote', 'line_start': l, 'line_end': l + 4, 'start': s, 'end': s + 2 * n + 25, 'depth': 0, 'parent': NULL}},
  {{'type': 'list_item', 'line_start': l, 'line_end': l + 4, 'start': s + 2, 'end': s + 2 * n + 25, 'depth': 1, 'parent': s}},
  {{'type': 'paragraph', 'line_start': l, 'line_end': l + 1, 'start': s + 4, 'end': s + 4 + n, 'depth': 2, 'parent': s + 2}},
  {{'type': 'fence', 'line_start': l + 1, 'line_end': l + 4, 'start': s + n + 9, 'end': s + 2 * n + 25, 'depth': 2, 'parent': s + 2}}], recursive := true) FROM ({SQL_CONTAINED}))""")
def c1_nested_blocks(spark, sf_dir):
    """Blocks of list items in quotes, with the container around each."""
    return structure.segment_blocks(_contained(spark, sf_dir)).select("doc_id", "type", "line_start", "line_end", "start", "end", "depth", "parent")


@query(f"""
SELECT doc_id, CAST(line AS INT) AS line, CAST(coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start FROM ({SQL_LINES})""")
def c2_line_offsets(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(structure.line_offsets(F.col("text"))).alias("line", "start"))


SQL_PLACES = """SELECT doc_id, '{kind}' AS kind, CAST(ahead + {first} AS INT) AS start, CAST(ahead + {last} AS INT) AS "end" FROM (
  SELECT doc_id, list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * {size} AS ahead FROM (SELECT doc_id, parts, unnest(range(1, len(parts))) AS i FROM (SELECT doc_id, string_split({body}, '{mark}') AS parts FROM documents)))"""


def _places(body: str, mark: str, kind: str, first: int, last: int) -> str:
    return SQL_PLACES.format(body=body, mark=mark, kind=kind, first=first, last=last, size=len(mark))


@query(_places(MARKED, "`the`", "code", 0, 5) + " UNION ALL " + _places(MARKED, "(u/of)", "destination", 1, 5))
def c3_protected_spans(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.explode(structure.protected_spans(F.expr(MARKED))).alias("s")).select("doc_id", "s.kind", "s.start", "s.end")


@query(f"""SELECT doc_id, 'fence' AS kind, s + n + 9 AS start, s + 2 * n + 25 AS "end" FROM ({SQL_CONTAINED})""")
def c3_protected_in_containers(spark, sf_dir):
    return _contained(spark, sf_dir).select("doc_id", F.explode(structure.protected_spans(F.col("text"))).alias("s")).select("doc_id", "s.kind", "s.start", "s.end")


@query(f"""
WITH o AS (SELECT doc_id, coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, length(content) AS n, line FROM ({SQL_LINES})),
s AS (SELECT doc_id, start, start + CASE WHEN line % 3 = 0 THEN 2 * n ELSE n END AS fin FROM o),
f AS (SELECT *, CASE WHEN start < max(fin) OVER (PARTITION BY doc_id ORDER BY start, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, fin ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT doc_id, CAST(min(start) AS INT) AS start, CAST(max(fin) AS INT) AS "end" FROM g GROUP BY doc_id, island""")
def c4_merge_spans(spark, sf_dir):
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.arrays_zip(structure.line_offsets(F.col("text")).alias("start"), structure.text_lines(F.col("text")).alias("content"))).alias("line", "x"))
    n = F.char_length("x.content")
    return structure.merge_spans(lines.select("doc_id", "x.start", (F.col("x.start") + F.when(F.col("line") % 3 == 0, 2 * n).otherwise(n)).alias("end")))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: x[1] = 'T')) % 2 = 1 AS unclosed FROM documents")
def c5_unclosed_fence(spark, sf_dir):
    """A fence mark before each line that begins with T: each second one closes."""
    return documents(spark, sf_dir).select("doc_id", structure.unclosed_fence(F.expr("regexp_replace(text, '(?m)^T', '```\nT')")).alias("unclosed"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10))) AS content, generate_subscripts(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10)), 1) - 1 AS line FROM documents),
b AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM l WHERE trim(content) = '')
SELECT doc_id, CAST(min(line) AS INT) AS line_start, CAST(max(line) + 1 AS INT) AS line_end FROM b GROUP BY doc_id, run""")
def c6_blank_runs(spark, sf_dir):
    return structure.blank_runs(documents(spark, sf_dir).select("doc_id", F.expr(SPACED).alias("text")))


@query(f"""
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN x[1] = 'T' THEN 'heading' ELSE 'paragraph' END), ',') AS signature,
  array_to_string(list_transform(range(1, len(string_split({MARKED}, '(u/of)'))), lambda i: 'u/of'), ',') AS targets, replace({MARKED_SHOWN}, chr(10), ' ') AS visible FROM documents WHERE NOT regexp_matches(text, '[*_]')
UNION ALL SELECT doc_id, NULL, NULL, trim(regexp_replace({SQL_UNSTRESSED.format(text=MARKED_SHOWN)}, '[ \n]+', ' ', 'g')) FROM documents WHERE regexp_matches(text, '[*_]')""")
def c7_signature_and_targets(spark, sf_dir):
    """Lines that begin with T as headings. Texts with emphasis marks: what a reader sees alone."""
    body = F.expr(f"regexp_replace(replace({MARKED}, '\n', '\n\n'), '(?m)^T', '# T')")
    marked = documents(spark, sf_dir).select("doc_id", body.alias("t"), (~F.col("text").rlike("[*_]")).alias("plain"))
    read = marked.select("doc_id", "plain", markdown.blocks(F.col("t")).alias("b"))  # parsed once for the three
    signature = F.transform(structure.placed_blocks(F.col("p")), lambda x: x["type"])
    placed = read.select("*", F.when(F.col("plain"), markdown.located(F.col("b"))).alias("p"))
    return placed.select("doc_id", F.when(F.col("plain"), F.array_join(signature, ",")).alias("signature"), F.when(F.col("plain"), F.array_join(markdown.link_targets(F.col("b")), ",")).alias("targets"), markdown.visible_text(F.col("b")).alias("visible"))


# --- paragraphs ---------------------------------------------------------------------------------------------------


@query("SELECT doc_id, trim(regexp_replace(replace(text, chr(10), ' '), '[ \t]+', ' ', 'g')) AS key FROM documents")
def d1_paragraph_key(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.paragraph_key(F.col("text")).alias("key"))


@query("SELECT doc_id, count(*) AS paragraphs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents) GROUP BY doc_id")
def d2_top_level_paragraphs(spark, sf_dir):
    body = F.concat(F.lit("> quoted\n\n- item\n\n| a | b |\n| --- | --- |\n| c | d |\n\n"), F.expr(SPACED))
    blocks = structure.segment_blocks(documents(spark, sf_dir).select("doc_id", body.alias("text")))
    return blocks.groupBy("doc_id").agg(F.count_if(F.expr(structure.IS_TOP_LEVEL_PARAGRAPH)).alias("paragraphs"))  # texts without any too


@query(f"""
WITH l AS (SELECT *, trim(regexp_replace(content, '[ \t]+', ' ', 'g')) AS key FROM ({SQL_LINES})),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY line) AS rank, max(line) OVER (PARTITION BY doc_id) AS last FROM l)
SELECT doc_id, string_agg(content || CASE WHEN line < last THEN chr(10) || chr(10) ELSE '' END, '' ORDER BY line) FILTER (WHERE rank = 1) AS text, CAST(count(*) FILTER (WHERE rank > 1) AS INT) AS duplicate_paragraphs_removed FROM r GROUP BY doc_id""")
def d3_dedup_paragraphs(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", cleaning.dedup_paragraphs(F.expr(SPACED)).alias("d")).select("doc_id", "d.*")


# --- personal data ------------------------------------------------------------------------------------------------

SQL_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,63}"
SQL_IPS = r"list_filter(regexp_extract_all(text, '[0-9.]+'), lambda x: regexp_full_match(x, '([0-9]{1,3}\.){3}[0-9]{1,3}\.?') AND list_max(list_transform(list_filter(string_split(x, '.'), lambda o: o <> ''), lambda o: TRY_CAST(o AS INT))) <= 255)"
SQL_CARDS = "list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN (length(x) - i) % 2 = 0 THEN CAST(x[i] AS INT) ELSE (2 * CAST(x[i] AS INT)) // 10 + (2 * CAST(x[i] AS INT)) % 10 END)) % 10 = 0)"


def _values(matches):
    return F.array_join(F.transform(matches, lambda m: m["value"]), ",").alias("found")


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{SQL_EMAIL}'), ',') AS found FROM documents")
def e1_find_emails(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", _values(pii.find_emails(F.col("text"))))


SQL_PHONES = "regexp_extract_all('x' || {body}, '[^0-9](1[3-9](?:[ -]?[0-9]){{9}})(?:[^0-9]|$)', 1)"


@query(f"SELECT doc_id, array_to_string({SQL_PHONES.format(body='text')} || ['138 ' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || '-1234'], ',') AS found FROM documents")
def e2_find_cn_phones(spark, sf_dir):
    body = F.concat(F.col("text"), F.lit(" x138 "), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"), F.lit("-1234 x"), F.lit("23800138000 x1280013800"))
    return documents(spark, sf_dir).select("doc_id", _values(pii.find_cn_phones(body)))


SQL_CHECK = "substr('10X98765432', CAST(list_sum(list_transform(range(1, 18), lambda i: CAST({b}[i] AS INT) * [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2][i])) % 11 + 1 AS INT), 1)"


@query(f"""
WITH b AS (SELECT doc_id, regexp_extract_all('x' || text || ' x11010519491231' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || 'X, x11010519490231' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || 'X', '[^0-9]([0-9]{{17}}[0-9Xx])(?:[^0-9]|$)', 1) AS c FROM documents)
SELECT doc_id, array_to_string(list_filter(c, lambda x: try_strptime(substr(x, 7, 8), '%Y%m%d') IS NOT NULL AND upper(x[18]) = {SQL_CHECK.format(b='x')} AND substr(x, 1, 2) IN ('11', '12', '13', '14', '15', '21', '22', '23', '31', '32', '33', '34', '35', '36', '37', '41', '42', '43', '44', '45', '46', '50', '51', '52', '53', '54', '61', '62', '63', '64', '65', '71', '81', '82') AND substr(x, 3, 4) <> '0000'), ',') AS found FROM b""")
def e3_find_cn_ids(spark, sf_dir):
    serial = F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0")
    body = F.concat(F.col("text"), F.lit(" x11010519491231"), serial, F.lit("X, x11010519490231"), serial, F.lit("X"))
    return documents(spark, sf_dir).select("doc_id", _values(pii.find_cn_ids(body)))


@query(f"SELECT doc_id, array_to_string({SQL_CARDS}, ',') AS found FROM documents")
def e4_find_bank_cards(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", _values(pii.find_bank_cards(F.col("text"))))


@query(f"SELECT doc_id, array_to_string(list_transform({SQL_IPS}, lambda x: rtrim(x, '.')), ',') AS found FROM documents")
def e5_find_ipv4(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", _values(pii.find_ipv4(F.col("text"))))


SQL_COUNTS = f"len(regexp_extract_all(text, '{SQL_EMAIL}')) AS email_redactions, 0 AS id_card_redactions, 0 AS phone_redactions, len({SQL_CARDS}) AS bank_card_redactions, len({SQL_IPS}) AS ipv4_redactions"


@query(f"SELECT doc_id, 1 + len(regexp_extract_all(text, '{SQL_EMAIL}')) AS email_redactions, 1 AS id_card_redactions, len({SQL_CARDS}) AS bank_card_redactions, len({SQL_IPS}) AS ipv4_redactions FROM documents")
def e6_resolve_overlaps(spark, sf_dir):
    """Before the text an id whose digits look like a card, and an e-mail that begins with an address: the first entity wins."""
    found = documents(spark, sf_dir).select("doc_id", pii.find_pii(F.concat(F.lit("11010519491231002X 1.2.3.4@sample.org x "), F.col("text"))).alias("m"))
    return found.select("doc_id", *pii.counts(F.col("m"))).drop("phone_redactions")


@query(f"""
SELECT doc_id, 'EMAIL_ADDRESS' AS entity, 11 AS start, 18 AS "end" FROM documents
UNION ALL SELECT doc_id, 'EMAIL_ADDRESS', CAST(19 + list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS INT),
  CAST(19 + list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(hits[1:i], lambda x: length(x))) AS INT)
FROM (SELECT doc_id, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '{SQL_EMAIL}') AS gaps, regexp_extract_all(text, '{SQL_EMAIL}') AS hits FROM documents))""")
def e7_exclude_protected(spark, sf_dir):
    marked = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("`a@b.org`: c@d.org "), F.col("text")).alias("t")).withColumn("s", structure.protected_spans(F.col("t")))
    kept = F.filter(pii.exclude_protected(pii.candidates(F.col("t")), F.col("s")), lambda m: m["entity"] == "EMAIL_ADDRESS")
    return marked.select("doc_id", F.explode(kept).alias("m")).select("doc_id", "m.entity", "m.start", "m.end")


SQL_CARD_RUN = SQL_CARDS.replace("regexp_extract_all(text, '[0-9]+')", "[r]").replace("CAST(", "TRY_CAST(")
SQL_IP_RUN = SQL_IPS.replace("regexp_extract_all(text, '[0-9.]+')", "[r]")


def _sql_redacted(text: str) -> str:
    """E-mails, cards and addresses replaced in turn; the tables hold no ids or phone numbers of the other kinds."""
    mail = f"regexp_replace({text}, '{SQL_EMAIL}', '[EMAIL]', 'g')"
    card = f"array_to_string(list_transform(regexp_extract_all({mail}, '[0-9]+|[^0-9]+'), lambda r: CASE WHEN regexp_full_match(r, '[0-9]{{12,19}}') THEN CASE WHEN len({SQL_CARD_RUN}) > 0 THEN '[BANK_CARD]' ELSE r END ELSE r END), '')"
    return f"array_to_string(list_transform(regexp_extract_all({card}, '[0-9.]+|[^0-9.]+'), lambda r: CASE WHEN length(r) BETWEEN 7 AND 16 AND len({SQL_IP_RUN}) > 0 THEN '[IPV4]' || CASE WHEN r LIKE '%.' THEN '.' ELSE '' END ELSE r END), '')"


@query(f"SELECT doc_id, {_sql_redacted('text')} AS text FROM documents")
def e8_redact(spark, sf_dir):
    found = documents(spark, sf_dir).select("doc_id", "text", pii.find_pii(F.col("text")).alias("m"))
    return found.select("doc_id", pii.redact(F.col("text"), F.col("m")).alias("text"))


@query(f"SELECT lang, source, sum(email_redactions) AS email_redactions, sum(id_card_redactions) AS id_card_redactions, sum(phone_redactions) AS phone_redactions, sum(bank_card_redactions) AS bank_card_redactions, sum(ipv4_redactions) AS ipv4_redactions, count(*) AS documents FROM (SELECT lang, source, {SQL_COUNTS} FROM documents) GROUP BY lang, source")
def e9_pii_summary(spark, sf_dir):
    return pii.pii_summary(documents(spark, sf_dir).select("lang", "source", "text"), ["lang", "source"])


SQL_IP_SHAPES = r"len(list_filter(regexp_extract_all(text, '[0-9.]+'), lambda x: regexp_full_match(x, '([0-9]{1,3}\.){3}[0-9]{1,3}\.?')))"


@query(f"""SELECT doc_id, len(regexp_extract_all(text, '{SQL_EMAIL}')) + len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) BETWEEN 12 AND 19))
  + len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) = 18)) + len({SQL_PHONES.format(body='text')}) + {SQL_IP_SHAPES} > 0 AS rejected FROM documents""")
def e10_pii_candidate_guard(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", pii.too_many_candidates(F.col("text"), limit=0).alias("rejected"))


# --- formatting and cleaning ------------------------------------------------------------------------------------


@query(r"SELECT doc_id, regexp_replace(regexp_replace(trim(text, chr(10)), '[ \t]+(\n|$)', '\1', 'g'), '([^\s])[ \t]{2,}([^\s])', '\1 \2', 'g') || chr(10) AS text FROM documents")
def f1_normalize_markdown(spark, sf_dir):
    body = F.concat(F.replace(F.col("text"), F.lit("\n"), F.lit("  \r\n")), F.lit("\n\n\n"))
    return documents(spark, sf_dir).select("doc_id", cleaning.normalize_markdown(body).alias("text"))


@query("""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: x[1] = 'T') AS t FROM documents), f AS (SELECT doc_id, list_append(t[1:-2], true) AS f FROM l)
SELECT doc_id, CAST(len(list_filter(range(1, len(f) + 1), lambda i: f[i] AND (i = 1 OR NOT f[i - 1]))) AS INT) AS changes FROM f""")
def f2_count_format_changes(spark, sf_dir):
    """Two blanks behind the lines that begin with T go, and the last line gets its end."""
    return cleaning.count_format_changes(documents(spark, sf_dir).select("doc_id", F.expr(BLANKED).alias("before"), cleaning.normalize_markdown(F.expr(BLANKED)).alias("after")))


@query(f"""
SELECT doc_id, CAST(len(regexp_extract_all(string_agg(CASE length(content) % 7 WHEN 0 THEN 'x' WHEN 1 THEN 'x' WHEN 2 THEN '=x' ELSE '=' END, '' ORDER BY line), 'x+')) AS INT) AS changes FROM ({SQL_LINES}) GROUP BY doc_id""")
def f2_changes_of_edits(spark, sf_dir):
    """Numbered lines, of which some are missing, changed, or followed by a new one in the second text."""
    line = lambda c, i: F.concat(i.cast("string"), F.lit(" "), c, F.lit("\n"))
    kind = lambda c: F.char_length(c) % 7
    edited = lambda c, i: F.when(kind(c) == 0, "").when(kind(c) == 1, F.concat(F.lit("new "), line(c, i))).when(kind(c) == 2, F.concat(line(c, i), F.lit("more "), line(c, i))).otherwise(line(c, i))
    text = lambda f: F.array_join(F.transform(F.split("text", "\n"), f), "")
    return cleaning.count_format_changes(documents(spark, sf_dir).select("doc_id", text(line).alias("before"), text(edited).alias("after")))


#: Each line a table row, each word a cell; bars and more than one blank between words are taken out before.
WORDED = "trim(regexp_replace(replace(text, '|', ' '), ' +', ' '))"


@query(f"""
WITH cells AS (SELECT doc_id, list_prepend(['a', 'b'], list_transform(string_split(trim(regexp_replace(replace(text, '|', ' '), ' +', ' ', 'g')), chr(10)), lambda x: string_split(trim(x), ' '))) AS r FROM documents),
sized AS (SELECT doc_id, r, list_max(list_transform(r, lambda x: len(x))) AS n FROM cells),
wide AS (SELECT doc_id, r, n, list_transform(range(1, n + 1), lambda c: greatest(3, list_max(list_transform(r, lambda x: coalesce(length(x[c]), 0))))) AS w FROM sized),
rows AS (SELECT doc_id, list_transform(r, lambda x: '| ' || array_to_string(list_transform(range(1, n + 1), lambda c: rpad(coalesce(x[c], ''), CAST(w[c] AS INT), ' ')), ' | ') || ' |') AS t, '| :' || repeat('-', w[1] - 1) || ' | ' || array_to_string(list_transform(w[2:], lambda x: repeat('-', x)), ' | ') || ' |' AS rule FROM wide)
SELECT doc_id, array_to_string(list_concat([t[1], rule], t[2:]), chr(10)) || chr(10) AS text FROM rows""")
def f1_format_tables(spark, sf_dir):
    """The words of each line as a row of a table: padded to the widest of their column."""
    rows = F.transform(F.split(F.expr(WORDED), "\n"), lambda c: F.concat(F.lit("|"), F.replace(F.trim(c), F.lit(" "), F.lit("|")), F.lit("|")))
    return documents(spark, sf_dir).select("doc_id", cleaning.normalize_markdown(F.concat(F.lit("|a|b|\n|:--|---|\n"), F.array_join(rows, "\n"))).alias("text"))


@query("""
SELECT doc_id, 'a b' || chr(10) || 'TABLE_DELIMITER:left,center' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(replace(x, '|', ' '), ' +', ' ', 'g'))), chr(10)) AS text FROM documents""")
def f3_normalize_table_delimiters(spark, sf_dir):
    """Each line a table row, each word a cell."""
    rows = F.expr("concat('| ', replace(replace(text, ' ', ' | '), '\n', ' |\n| '), ' |')")
    return documents(spark, sf_dir).select("doc_id", cleaning.normalize_table_delimiters(F.concat(F.lit("| a | b |\n|:---|:-:|\n"), rows)).alias("text"))


@query(f"""
SELECT doc_id, unnest(list_concat(CASE WHEN contains({MARKED}, '(u/of)') THEN ['LINK_TARGETS', 'PROTECTED_UNITS'] ELSE [] END, CASE WHEN contains(text, 'anon') OR doc_id % 3 = 0 THEN ['VISIBLE_TEXT'] ELSE [] END)) AS violation FROM documents
UNION ALL SELECT doc_id, unnest(CASE WHEN doc_id % 3 <> 1 THEN [] WHEN contains({MARKED}, '(u/of)') THEN ['INLINE_LEAVES', 'VISIBLE_TEXT'] ELSE ['INLINE_LEAVES', 'VISIBLE_TEXT', 'PROTECTED_UNITS'] END) AS violation FROM documents WHERE NOT (doc_id % 3 = 1 AND contains(text, 'anon'))
UNION ALL SELECT doc_id, unnest(CASE WHEN contains({MARKED}, '(u/of)') THEN ['INLINE_LEAVES'] ELSE ['INLINE_LEAVES', 'PROTECTED_UNITS'] END) FROM documents WHERE doc_id % 3 = 1 AND contains(text, 'anon')""")
def f4_content_preserved(spark, sf_dir):
    """Other link destinations and other words are changes, and so are a lost mark of snake case and code that is none any
    more; two blanks behind a line and marks of emphasis are none."""
    after = F.expr(f"concat(replace(replace({MARKED}, '(u/of)', '(v/of)'), 'anon', 'ANON'), '  \n')")
    pick = lambda *tails: F.element_at(F.array(*map(F.lit, tails)), (F.col("doc_id") % 3 + 1).cast("int"))
    before, end = F.concat(F.expr(MARKED), F.lit("\n\n"), pick("call snake_case", "use `it`", "*so* there\n")), F.concat(after, F.lit("\n\n"), pick("call snakecase", "use it", "so there\n"))
    return cleaning.content_preserved(documents(spark, sf_dir).select("doc_id", before.alias("before"), end.alias("after")))


CLEAN_COLUMNS = ["doc_id", "status", "text", *cleaning.COUNTERS, "input_sha256", "input_bytes", "output_sha256", "output_bytes"]
SPREAD, SQL_SPREAD = f"replace({BLANKED}, '\\n', '\\n\\n')", f"replace({SQL_BLANKED}, chr(10), chr(10) || chr(10))"
#: Each line a paragraph: the first of equal ones stays; personal data goes; blanks behind lines that begin with T go.
SQL_CLEAN = f"""
SELECT doc_id, lang, source, 'succeeded' AS status, clean AS text, n - len(lines) AS duplicate_paragraphs_removed, email_redactions, id_card_redactions, phone_redactions, bank_card_redactions, ipv4_redactions,
  CAST(len(list_filter(lines[1:-2], lambda x: x[1] = 'T')) + 1 AS INT) AS formatting_changes, sha256(body) AS input_sha256, strlen(body) AS input_bytes, sha256(clean) AS output_sha256, strlen(clean) AS output_bytes
FROM (SELECT *, {_sql_redacted("array_to_string(lines, chr(10) || chr(10))")} || chr(10) AS clean, {SQL_COUNTS.replace("(text,", "(array_to_string(lines, chr(10) || chr(10)),")}
  FROM (SELECT doc_id, lang, source, len(string_split(text, chr(10))) AS n, {SQL_SPREAD} AS body,
    list_transform(list_filter(list_zip(string_split(text, chr(10)), range(1, len(string_split(text, chr(10))) + 1)), lambda z: list_position(list_transform(string_split(text, chr(10)), lambda y: trim(y)), trim(z[1])) = z[2]), lambda z: z[1]) AS lines FROM documents))"""


@query(f"SELECT {', '.join(CLEAN_COLUMNS)} FROM ({SQL_CLEAN})")
def g1_clean_documents(spark, sf_dir):
    return cleaning.clean_documents(documents(spark, sf_dir).select("doc_id", F.expr(SPREAD).alias("text"))).select(*CLEAN_COLUMNS)


@query(f"""
SELECT doc_id, CASE WHEN strlen(text) > 6000 THEN 'INPUT_TOO_LARGE' WHEN len(string_split(text, chr(10))) > 8 THEN 'TOO_MANY_BLOCKS'
  WHEN len(string_split({MARKED}, '`the`')) + len(string_split({MARKED}, '(u/of)')) - 2 > 12 THEN 'TOO_MANY_PROTECTED_SPANS'
  WHEN list_max(list_transform(string_split({MARKED}, chr(10)), lambda x: length(x))) > 700 THEN 'BLOCK_TOO_LARGE' END AS error_code FROM documents""")
def g2_resource_guard(spark, sf_dir):
    limits = cleaning.CleaningLimits(max_input_bytes=6000, max_blocks=8, max_protected_spans=12, max_block_chars=700)
    body = F.expr(f"replace({MARKED}, '\n', '\n\n')")
    placed = documents(spark, sf_dir).select("doc_id", "text", structure.place_blocks(body).alias("p"))  # parsed once for both
    docs = placed.select("doc_id", "text", structure.placed_blocks(F.col("p")).alias("b"), markdown.protected(F.col("p")).alias("s"))
    return docs.select("doc_id", cleaning.resource_guard(F.col("text"), F.col("b"), F.col("s"), limits).alias("error_code"))


@query("""SELECT doc_id, CASE WHEN lang = 'fr' THEN 'INVALID_ENCODING' WHEN lang IN ('de', 'es') THEN 'INVALID_TERMINAL_NEWLINE' WHEN contains(text, ' of ') THEN 'INTERNAL_MARKER' END AS error_code FROM documents""")
def g3_check_clean_output(spark, sf_dir):
    tail = F.when(F.col("lang") == "de", "\n\n").when(F.col("lang") == "fr", "\r\n").when(F.col("lang") == "es", "").otherwise("\n")
    body = F.concat(F.expr("replace(text, ' of ', ' __MD_INTERNAL_7__ ')"), tail)
    return documents(spark, sf_dir).select("doc_id", cleaning.check_clean_output(body).alias("error_code"))


@query(f"SELECT doc_id, NOT contains({MARKED}, '`the`') AS preserved FROM documents")
def g4_protected_regions_preserved(spark, sf_dir):
    after = F.expr(f"concat(replace({MARKED}, '`the`', '`The`'), '  \n')")
    return documents(spark, sf_dir).select("doc_id", F.expr(MARKED).alias("x"), after.alias("y")).select("doc_id", cleaning.protected_regions_preserved(F.col("x"), F.col("y")).alias("preserved"))


@query("SELECT doc_id, sha256(text) AS input_sha256, CAST(strlen(text) AS BIGINT) AS input_bytes FROM documents")
def g5_content_digest(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", *cleaning.content_digest(F.col("text"), "input"))


@query(f"""
SELECT lang, source, count(*) AS documents, count(*) AS succeeded, {', '.join(f'sum({c}) AS {c}' for c in cleaning.COUNTERS)} FROM ({SQL_CLEAN}) GROUP BY ROLLUP (lang, source)""")
def g6_cleaning_report(spark, sf_dir):
    cleaned = cleaning.clean_documents(documents(spark, sf_dir).select("doc_id", F.expr(SPREAD).alias("text"), "lang", "source"))
    return cleaning.cleaning_report(cleaned, ["lang", "source"])


@query("SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'INPUT_DIGEST_MISMATCH' ELSE 'INVALID_SUMMARY' END AS error_code FROM documents WHERE doc_id % 50 IN (0, 1)")
def g7_check_summary(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = docs.select("doc_id", *(F.when((F.col("doc_id") % 50 == 1) & F.lit(c == "formatting_changes"), -1).otherwise(0).alias(c) for c in cleaning.COUNTERS), *cleaning.content_digest(F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "input"))
    return cleaning.check_summary(counted, docs)


# --- de-duplication ----------------------------------------------------------------------------------------------

SQL_EXACT = f"SELECT doc_id AS uid, source, min(doc_id) OVER w AS rep, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY {SQL_STRIP})"


def _sql_uuid(space: str, name: str) -> str:
    """SQL for a name-based UUID; ``name`` is a BLOB expression."""
    h = f"sha1(from_hex('{space.replace('-', '')}') || {name})"
    return f"""(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr({h}, 17, 1))::INT % 4 + 1 AS INT), 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"""


SQL_MEMBERS = "encode(string_agg(CAST(uid AS VARCHAR), ',' ORDER BY uid))"
SQL_CLUSTER_ID = _sql_uuid("f02873a0-e739-4e4b-a0ce-285f47b87923", f"encode('{REQUEST}') || from_hex('00') || {SQL_MEMBERS}")
SQL_DECISIONS = f"""SELECT uid, source, CASE WHEN n > 1 THEN cluster_id END AS cluster_id, uid = rep AS representative, CASE WHEN n > 1 THEN 'exact' END AS method
FROM ({SQL_EXACT}) JOIN (SELECT rep, {SQL_CLUSTER_ID} AS cluster_id FROM ({SQL_EXACT}) GROUP BY rep) USING (rep)"""


@query(f"SELECT uid, rep AS exact_rep, n AS group_size FROM ({SQL_EXACT})")
def h1_exact_groups(spark, sf_dir):
    return dedup.exact_groups(samples(spark, sf_dir)).select("uid", "exact_rep", "group_size")


@query("SELECT doc_id, len(list_distinct(list_transform(range(1, greatest(1, length(text) - 3)), lambda i: substr(lower(text), i, 5)))) AS shingles FROM documents")
def h2_char_shingles(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(dedup.char_shingles(F.col("text"))).cast("long").alias("shingles"))


#: A family small enough for SQL to compute over whole tables: bands of few rows, the same arithmetic.
SMALL = dedup.MinHashConfig(permutations=12, threshold=0.7)
SMALL_BANDS, SMALL_ROWS = dedup.lsh_parameters(SMALL.threshold, SMALL.permutations)
SQL_FAMILY = ", ".join(f"({k}, {a}::HUGEINT, {b}::HUGEINT)" for k, (a, b) in enumerate(zip(*dedup.hash_family(SMALL.permutations, SMALL.seed), strict=True)) if k < SMALL_BANDS * SMALL_ROWS)
SQL_BANDS = f"""
SELECT uid, k // {SMALL_ROWS} AS band, string_agg(printf('%08x', least), '' ORDER BY k) AS key FROM (
  SELECT uid, k, min((((h * a + b) % 18446744073709551616) % 2305843009213693951 % 4294967296)::BIGINT) AS least
  FROM (SELECT DISTINCT doc_id AS uid, ('0x' || substr(d, 7, 2) || substr(d, 5, 2) || substr(d, 3, 2) || substr(d, 1, 2))::BIGINT::HUGEINT AS h
    FROM (SELECT doc_id, sha1(unnest(list_distinct(list_transform(range(1, greatest(1, length(text) - 3)), lambda i: substr(lower(text), i, 5))))) AS d FROM documents)),
    (VALUES {SQL_FAMILY}) AS family(k, a, b) GROUP BY uid, k) GROUP BY uid, band"""
SQL_EDGES = "SELECT DISTINCT src, uid AS dst FROM (SELECT uid, min(uid) OVER (PARTITION BY band, key) AS src FROM bands) WHERE uid <> src"
SQL_ROOTED = f"""RECURSIVE bands AS ({SQL_BANDS}), groups AS (SELECT doc_id AS uid, min(doc_id) OVER w AS exact_rep, count(*) OVER w AS group_size, length({SQL_STRIP}) AS n FROM documents WINDOW w AS (PARTITION BY {SQL_STRIP})),
edges AS (SELECT DISTINCT src, uid AS dst FROM (SELECT b.uid, min(b.uid) OVER (PARTITION BY band, key) AS src FROM bands b JOIN groups g ON b.uid = g.uid AND g.uid = g.exact_rep) WHERE uid <> src),
both_ways AS (SELECT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges),
reached AS (SELECT x AS node, x AS root FROM both_ways UNION SELECT y, root FROM reached JOIN both_ways ON node = x WHERE root < y),
components AS (SELECT node, min(root) AS component FROM reached GROUP BY node),
members AS (SELECT uid, coalesce(component, CASE WHEN group_size > 1 THEN exact_rep END) AS cluster, component IS NOT NULL AS by_minhash, group_size, n FROM groups LEFT JOIN components ON exact_rep = node)"""


@query(f"SELECT uid, CAST(band AS INT) AS band, key FROM ({SQL_BANDS})")
def h3_minhash_signature(spark, sf_dir):
    return dedup.minhash_signatures(samples(spark, sf_dir), SMALL).select("uid", F.posexplode("bands").alias("band", "key")).select("uid", "band", F.lower(F.hex("key")).alias("key"))


@query()
def h3_production_signature(spark, sf_dir):
    return dedup.minhash_signatures(samples(spark, sf_dir)).select("uid", F.size("bands").alias("bands"), F.md5(F.array_join(F.transform("bands", F.hex), "").cast("binary")).alias("signature_md5"))


@query("""
WITH wanted AS (SELECT DISTINCT (1 + doc_id % 9) / 10.0::DOUBLE AS threshold, 8 * (1 + length(text) % 3) AS permutations FROM documents), grid AS (SELECT range / 2000.0::DOUBLE AS s FROM range(2001)),
choices AS (SELECT w.*, bands, unnest(range(1, permutations // bands + 1)) AS band_rows FROM (SELECT *, unnest(range(1, permutations + 1)) AS bands FROM wanted) w),
areas AS (SELECT threshold, permutations, bands, band_rows,
  coalesce(sum((s - before) * ((1 - pow(1 - pow(s, band_rows), bands)) + (1 - pow(1 - pow(before, band_rows), bands))) / 2) FILTER (s <= threshold), 0)
  + coalesce(sum((s - before) * (pow(1 - pow(s, band_rows), bands) + pow(1 - pow(before, band_rows), bands)) / 2) FILTER (before >= threshold), 0) AS cost
  FROM choices, (SELECT s, lag(s) OVER (ORDER BY s) AS before FROM grid) WHERE before IS NOT NULL GROUP BY ALL)
SELECT threshold, CAST(permutations AS INT) AS permutations, CAST(bands AS INT) AS bands, CAST(band_rows AS INT) AS band_rows
FROM (SELECT *, row_number() OVER (PARTITION BY threshold, permutations ORDER BY round(cost, 12), bands, band_rows) AS r FROM areas) WHERE r = 1""")
def h4_lsh_parameters(spark, sf_dir):
    """Requests that the documents make: their ids give thresholds, their lengths numbers of permutations."""
    wanted = documents(spark, sf_dir).select(((1 + F.col("doc_id") % 9) / 10).alias("threshold"), (8 * (1 + F.char_length("text") % 3)).cast("int").alias("permutations"))
    return dedup.lsh_parameter_table(wanted)


@query(f"WITH bands AS ({SQL_BANDS}) {SQL_EDGES}")
def h5_lsh_edges(spark, sf_dir):
    return dedup.lsh_edges(dedup.minhash_signatures(samples(spark, sf_dir), SMALL))


@query(f"SELECT doc_id AS node, rep AS component FROM (SELECT doc_id, min(doc_id) OVER w AS rep, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY {SQL_STRIP})) WHERE n > 1")
def h6_connected_components(spark, sf_dir):
    """Stars: each document linked to the first one of the same text."""
    groups = dedup.exact_groups(samples(spark, sf_dir))
    return components.connected_components(groups.select(F.col("exact_rep").alias("src"), F.col("uid").alias("dst")))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = samples(spark, sf_dir)
    groups, _ = materialize(dedup.exact_groups(docs), "exact-groups")
    edges = dedup.lsh_edges(dedup.representative_signatures(docs, groups, SMALL))
    return materialize(dedup.expand_clusters(groups, components.connected_components(edges)), "cluster-members")[0]


@query(f"WITH {SQL_ROOTED} SELECT uid, cluster, by_minhash FROM members")
def h7_expand_clusters(spark, sf_dir):
    return _members(spark, sf_dir).select("uid", "cluster", "by_minhash")


@query(f"""WITH {SQL_ROOTED} SELECT cluster, CASE WHEN NOT bool_or(by_minhash) THEN 'exact' WHEN max(group_size) > 1 THEN 'exact_minhash' ELSE 'minhash' END AS method FROM members WHERE cluster IS NOT NULL GROUP BY cluster""")
def h8_cluster_method(spark, sf_dir):
    return dedup.named_clusters(_members(spark, sf_dir), REQUEST).select("cluster", "method")


@query(f"WITH {SQL_ROOTED} SELECT cluster, arg_min(uid, (-n, uid)) AS representative FROM members WHERE cluster IS NOT NULL GROUP BY cluster")
def h9_pick_representative(spark, sf_dir):
    return dedup.named_clusters(_members(spark, sf_dir), REQUEST).select("cluster", F.col("best").alias("representative"))


@query(f"SELECT rep AS exact_rep, {SQL_CLUSTER_ID} AS cluster_id FROM ({SQL_EXACT}) GROUP BY rep HAVING count(*) > 1")
def h10_cluster_id(spark, sf_dir):
    none = spark.createDataFrame([], "node long, component long")
    members, _ = materialize(dedup.expand_clusters(dedup.exact_groups(samples(spark, sf_dir)), none), "cluster-members")
    return dedup.named_clusters(members, REQUEST).select(F.col("cluster").alias("exact_rep"), "cluster_id")


@query()
def h11_dedup_decisions(spark, sf_dir):
    """Includes the cluster methods (H8)."""
    return dedup.dedup_decisions(samples(spark, sf_dir), REQUEST)


@query(f"""
WITH {SQL_ROOTED}, named AS (SELECT cluster, arg_min(uid, (-n, uid)) AS best, CASE WHEN NOT bool_or(by_minhash) THEN 'exact' WHEN max(group_size) > 1 THEN 'exact_minhash' ELSE 'minhash' END AS method, {SQL_CLUSTER_ID} AS cluster_id FROM members WHERE cluster IS NOT NULL GROUP BY cluster)
SELECT uid, cluster_id, cluster IS NULL OR uid = best AS representative, method FROM members LEFT JOIN named USING (cluster)""")
def h11_small_family_decisions(spark, sf_dir):
    """The whole of the decisions over a hash family that SQL can follow."""
    return dedup.dedup_decisions(samples(spark, sf_dir), REQUEST, SMALL)


@query(f"SELECT uid, cluster_id, representative, method FROM ({SQL_DECISIONS})")
def h11_exact_decisions(spark, sf_dir):
    return dedup.exact_decisions(samples(spark, sf_dir), REQUEST)


@query(f"SELECT 'MISSING_UID' AS code, uid, CAST(NULL AS VARCHAR) AS cluster_id FROM ({SQL_DECISIONS}) WHERE cluster_id IS NULL AND uid % 97 = 0")
def h12_validate_decisions(spark, sf_dir):
    docs = samples(spark, sf_dir)
    decisions = dedup.exact_decisions(docs, REQUEST).where("cluster_id IS NOT NULL OR uid % 97 <> 0")
    return dedup.validate_decisions(decisions, docs.select("uid"))


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.concat_ws("/", "source", F.concat((F.col("doc_id") % 50).cast("string"), F.lit(".txt")))
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("uid"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_id"), named.alias("file_storage_path"))
    return dedup.mapping_table(docs)


def _business(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.business_result(dedup.exact_decisions(samples(spark, sf_dir), REQUEST), _mapping(spark, sf_dir), TASK)


SQL_BUSINESS = f"""SELECT 'f' || uid AS file_id, source || '/' || (uid % 50) || '.txt' AS file_storage_path, CASE WHEN n > 1 THEN group_id END AS group_id, uid = rep AS keep
FROM ({SQL_EXACT}) JOIN (SELECT rep, {_sql_uuid(TASK, SQL_MEMBERS)} AS group_id FROM ({SQL_EXACT}) GROUP BY rep) USING (rep)"""


@query(SQL_BUSINESS)
def h13_business_result(spark, sf_dir):
    return _business(spark, sf_dir)


@query(f"SELECT count(*) AS total_files, count(*) FILTER (WHERE keep) AS unique_files, count(*) FILTER (WHERE NOT keep) AS moved_duplicates, count(DISTINCT group_id) AS groups FROM ({SQL_BUSINESS})")
def h14_dedup_summary(spark, sf_dir):
    return dedup.dedup_summary(_business(spark, sf_dir))


@query(f"""
WITH d AS (SELECT file_id, file_storage_path AS source, 'duplicate/' || list_extract(string_split(file_storage_path, '/'), -1) AS destination FROM ({SQL_BUSINESS}) WHERE NOT keep),
r AS (SELECT *, row_number() OVER (PARTITION BY destination ORDER BY source, file_id) AS rank FROM d)
SELECT file_id, source, destination, CASE WHEN rank = 1 THEN 'planned' ELSE 'failed' END AS state, CASE WHEN rank > 1 THEN 'OUTPUT_CONFLICT' END AS code FROM r""")
def h15_quarantine_plan(spark, sf_dir):
    return dedup.quarantine_plan(_business(spark, sf_dir))


@query("""SELECT 'DUPLICATE_UID' AS code, doc_id AS uid FROM documents WHERE doc_id % 100 = 0 UNION ALL SELECT 'BLANK_FIELD', doc_id FROM documents WHERE doc_id % 100 = 1
UNION ALL SELECT 'SCHEMA_VERSION', doc_id FROM documents WHERE length(text) % 64 = 2 UNION ALL SELECT 'SCHEMA_VERSION', doc_id FROM documents WHERE length(text) % 64 = 2 AND doc_id % 100 = 0
UNION ALL SELECT 'TASK_ID', doc_id FROM documents WHERE length(text) % 64 = 3 UNION ALL SELECT 'TASK_ID', doc_id FROM documents WHERE length(text) % 64 = 3 AND doc_id % 100 = 0""")
def h16_mapping_table(spark, sf_dir):
    """One mapping file per version and task, written as JSON and read back: some of another version or task."""
    folder, kind = new_path(spark, "mapping"), F.char_length("text") % 64
    heads = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.when(kind == 2, 2).otherwise(1).alias("schema_version"), F.when(kind == 3, "other").otherwise(TASK).alias("task_id"))
    rows = _mapping(spark, sf_dir).withColumn("file_id", F.when(F.col("uid") % 100 == 1, " ").otherwise(F.col("file_id")))
    marked = rows.union(rows.where("uid % 100 = 0")).join(heads, F.col("uid") == F.col("id")).drop("id")
    files.write_mapping(marked, folder)
    return dedup.check_mapping(files.read_mapping(spark, folder), TASK)


# --- classification ----------------------------------------------------------------------------------------------

CHUNKS = classify.ChunkConfig(tokens=66, overlap=16, windows=16, special_tokens=2)
SQL_TOKENS = r"SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS tokens FROM documents"
SQL_STARTS = f"""SELECT doc_id, tokens, list_distinct_last AS starts FROM (SELECT doc_id, tokens, CASE WHEN len(tokens) = 0 THEN [] WHEN s[-1] < last THEN list_append(s, last) ELSE s END AS list_distinct_last
  FROM (SELECT doc_id, tokens, last, range(0, last + 1, 48) AS s FROM (SELECT doc_id, tokens, greatest(len(tokens) - 64, 0) AS last FROM ({SQL_TOKENS}))))"""
SQL_SAMPLED = f"""SELECT doc_id, tokens, CASE WHEN len(starts) <= 16 THEN starts ELSE list_transform(range(0, 16), lambda i: starts[CAST(round_even(i * (len(starts) - 1) / 15.0::DOUBLE, 0) AS INT) + 1]) END AS starts FROM ({SQL_STARTS})"""
SQL_WINDOWS = f"SELECT doc_id, tokens, unnest(starts) AS start, generate_subscripts(starts, 1) - 1 AS chunk_ix FROM ({SQL_SAMPLED})"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", classify.whitespace_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, CAST(unnest(starts) AS INT) AS start FROM ({SQL_STARTS})")
def i1_window_starts(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", F.explode(classify.window_starts(F.col("tokens"), CHUNKS)).alias("start"))


@query(f"SELECT doc_id, CAST(chunk_ix AS INT) AS chunk_ix, CAST(start AS INT) AS start FROM ({SQL_WINDOWS})")
def i2_sample_windows(spark, sf_dir):
    return classify.token_windows(_tokens(spark, sf_dir), CHUNKS)


@query(f"SELECT doc_id, CAST(chunk_ix AS INT) AS chunk_ix, array_to_string(list_slice(tokens, start + 1, start + 64), ' ') AS chunk FROM ({SQL_WINDOWS})")
def i3_chunk_text(spark, sf_dir):
    return classify.chunk_text(_tokens(spark, sf_dir), CHUNKS)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four chunks a document, three labels; weights are whole numbers of the row's own values."""
    chunks = documents(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("chunk_ix"))
    weights = F.array(*((F.col("doc_id") * (l + 1) + F.col("chunk_ix") * l) % 4 + 1 for l in range(3)))
    named = chunks.select("doc_id", "chunk_ix", weights.alias("w")).select("doc_id", "chunk_ix", F.posexplode("w").alias("label_ix", "x"), (F.get("w", F.lit(0)) + F.get("w", F.lit(1)) + F.get("w", F.lit(2))).alias("s"))
    return named.select("doc_id", "chunk_ix", "label_ix", F.concat(F.lit("l"), F.col("label_ix").cast("string")).alias("label"), (F.col("x") / F.col("s")).alias("score"))


SQL_SCORES = """SELECT doc_id, chunk_ix, label_ix, 'l' || label_ix AS label, ((doc_id * (label_ix + 1) + chunk_ix * label_ix) % 4 + 1)::DOUBLE / sum((doc_id * (label_ix + 1) + chunk_ix * label_ix) % 4 + 1) OVER (PARTITION BY doc_id, chunk_ix) AS score
FROM documents, (SELECT unnest(range(4)) AS chunk_ix), (SELECT unnest(range(3)) AS label_ix)"""
SQL_BEST = f"""SELECT doc_id, label, confidence FROM (SELECT doc_id, label, label_ix, avg(score) AS confidence, row_number() OVER (PARTITION BY doc_id ORDER BY round(avg(score), 12) DESC, label_ix) AS r FROM ({SQL_SCORES}) GROUP BY doc_id, label, label_ix) WHERE r = 1"""


@query("SELECT doc_id, CAST(c AS INT) AS chunk_ix, CASE WHEN doc_id % 10 = 0 THEN 'SHAPE' ELSE 'SUM' END AS code FROM documents, (SELECT unnest(range(4)) AS c) WHERE doc_id % 10 IN (0, 1)")
def i4_validate_scores(spark, sf_dir):
    scores = _scores(spark, sf_dir).where("NOT (doc_id % 10 = 0 AND label_ix = 2)")
    return classify.validate_scores(scores.withColumn("score", F.when(F.col("doc_id") % 10 == 1, F.col("score") / 2).otherwise(F.col("score"))), 3)


@query(f"SELECT doc_id, label, round(confidence, 9) AS confidence FROM ({SQL_BEST})")
def i5_aggregate_scores(spark, sf_dir):
    rounded = _scores(spark, sf_dir).withColumn("score", F.round("score", 12))
    return classify.aggregate_scores(rounded).select("doc_id", "label", F.round("confidence", 9).alias("confidence"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang || '|' || source || '|' || doc_id END AS levels FROM documents")
def i6_split_label_path(spark, sf_dir):
    label = F.concat_ws(" > ", "lang", "source", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("doc_id").cast("string")))
    return documents(spark, sf_dir).select("doc_id", F.array_join(classify.split_label_path(label), "|").alias("levels"))


@query(f"SELECT doc_id, 'a|b|' || label || '|' || label AS tags, round(confidence, 9) AS top_triple_confidence, round(confidence, 9) AS end_doc_confidence, 'r1' AS release_id, CAST(NULL AS VARCHAR) AS error_code FROM ({SQL_BEST})")
def i7_compose_tags(spark, sf_dir):
    scores = _scores(spark, sf_dir).withColumn("score", F.round("score", 12))
    end = classify.aggregate_scores(scores)
    top = end.withColumn("label", F.concat(F.lit("a > b > "), "label"))
    tags = classify.compose_tags(top, end, "r1")
    return tags.select("doc_id", F.array_join("tags", "|").alias("tags"), F.round("top_triple_confidence", 9).alias("top_triple_confidence"), F.round("end_doc_confidence", 9).alias("end_doc_confidence"), "release_id", "error_code")


@query()
def i8_score_chunks(spark, sf_dir):
    """Trained on the labelled documents' chunks, applied to all chunks."""
    chunks = classify.chunk_text(_tokens(spark, sf_dir), CHUNKS)
    labelled = chunks.join(table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", "quality"), "doc_id")
    return classify.score_chunks(chunks, classify.fit_chunk_model(labelled, "quality", 1 << 12), ["low", "high"])


@query("""
WITH m AS (SELECT 'top' AS model, lang || ' > ' || source || ' > ' || (length(text) % 7) AS label FROM documents UNION ALL SELECT 'end', source FROM documents UNION ALL SELECT 'other', lang FROM documents),
f AS (SELECT model, count(*) AS n, count(DISTINCT label) AS names FROM m GROUP BY model)
SELECT model, 'LABEL_COUNT' AS code FROM f WHERE model <> 'other' AND n <> CASE model WHEN 'top' THEN 18 ELSE 6 END
UNION ALL SELECT model, 'UNKNOWN_MODEL' FROM f WHERE model = 'other' UNION ALL SELECT model, 'DUPLICATE_LABEL' FROM f WHERE n <> names""")
def i9_validate_label_manifest(spark, sf_dir):
    docs = documents(spark, sf_dir)
    top = docs.select(F.lit("top").alias("model"), F.concat_ws(" > ", "lang", "source", (F.char_length("text") % 7).cast("string")).alias("label"))
    rest = docs.select(F.lit("end").alias("model"), "source").union(docs.select(F.lit("other"), "lang")).toDF("model", "label")
    return classify.validate_label_manifest(top.union(rest), {"top": 18, "end": 6}, "top")


@query("""
WITH p AS (SELECT toxic AS prediction, quality AS label FROM labels), c AS (SELECT DISTINCT prediction AS c FROM p UNION SELECT DISTINCT label FROM p),
e AS (SELECT c, count(*) FILTER (WHERE prediction = c AND label = c) AS tp, count(*) FILTER (WHERE label = c) AS a, count(*) FILTER (WHERE prediction = c) AS n FROM p, c GROUP BY c)
SELECT round((SELECT avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END) FROM p), 9) AS accuracy, round(avg(2.0 * tp / (a + n)), 9) AS macro_f1 FROM e""")
def i10_offline_metrics(spark, sf_dir):
    pairs = table(spark, sf_dir, "labels").select(F.col("toxic").alias("prediction"), F.col("quality").alias("label"))
    return classify.offline_metrics(pairs).select(F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


# --- intake, sinks, streams ------------------------------------------------------------------------------------

SQL_FINGERPRINT = """sha256('{"event_type":"' || event_type || '","props":' || coalesce('"' || replace(props, '"', '\\"') || '"', 'null') || '}')"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.with_fingerprint(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props"), ["props", "event_type"])


@query(f"SELECT event_id, {SQL_FINGERPRINT} AS fingerprint FROM events")
def j1_request_fingerprint(spark, sf_dir):
    return _requests(spark, sf_dir).select("event_id", "fingerprint")


@query(f"""
WITH e AS (SELECT event_id, ts, user_id, {SQL_FINGERPRINT} AS f FROM events), w AS (SELECT *, row_number() OVER k AS r, first_value(f) OVER k AS f0 FROM e WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN r = 1 THEN 'accepted' WHEN f = f0 THEN 'replay' ELSE 'conflict' END AS decision FROM w""")
def j2_resolve_intake(spark, sf_dir):
    return intake.resolve_intake(_requests(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select("event_id", "decision")


@query(f"""SELECT uid, '{{"uid":' || uid || ',"clusterId":' || coalesce('"' || cluster_id || '"', 'null') || ',"representative":' || representative || ',"method":' || coalesce('"' || method || '"', 'null') || '}}' AS value FROM ({SQL_DECISIONS})""")
def k1_decision_lines(spark, sf_dir):
    return sinks.decision_lines(dedup.exact_decisions(samples(spark, sf_dir), REQUEST))


@query(f"SELECT uid, rep AS exact_rep, 'recovered' AS state FROM ({SQL_EXACT})")
def k2_write_once(spark, sf_dir):
    path, out = new_path(spark, "published"), dedup.exact_groups(samples(spark, sf_dir)).select("uid", "exact_rep")
    sinks.write_once(out, path)
    return spark.read.parquet(path).withColumn("state", F.lit(sinks.write_once(out, path)))


@query("SELECT 'documents' AS profile, 1 AS schema_version, count(*) AS records FROM documents")
def k3_run_manifest(spark, sf_dir):
    path = new_path(spark, "manifest")
    n, mark = sinks.table_digest(documents(spark, sf_dir).select("doc_id"))
    sinks.append_run_manifest(spark, path, TASK, "documents", {"records": n}, {"rows": str(mark)})
    return spark.read.parquet(path).select("profile", "schema_version", F.col("counts")["records"].alias("records"))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    whole = spark.read.parquet(path)
    if any(f.rstrip("/").endswith(f"/{name}.parquet") for f in whole.inputFiles()):
        return streams.file_stream(spark, sf_dir, whole.schema, f"{name}.parquet")
    return streams.file_stream(spark, path, whole.schema)


@query(f"SELECT {', '.join(CLEAN_COLUMNS)} FROM ({SQL_CLEAN})")
def l1_stream_clean(spark, sf_dir):
    out = new_path(spark, "stream-clean")
    cleaned = streams.stream_clean(_stream(spark, sf_dir, "documents").select("doc_id", F.expr(SPREAD).alias("text"))).select(*CLEAN_COLUMNS)
    streams.run_available(cleaned, f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data")


@query(f"""
WITH e AS (SELECT event_id, ts, user_id, {SQL_FINGERPRINT} AS f FROM events), w AS (SELECT *, row_number() OVER k AS r, first_value(f) OVER k AS f0 FROM e WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, CASE WHEN r = 1 THEN 'accepted' WHEN f = f0 THEN 'replay' ELSE 'conflict' END AS decision FROM w""")
def l2_stream_intake(spark, sf_dir):
    """The table's own span as delay: no request is late, however many batches the table makes."""
    out, events = new_path(spark, "stream-intake"), table(spark, sf_dir, "events")
    seconds = F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))
    span = events.agg(seconds).head()[0] or 0
    requests = intake.with_fingerprint(_stream(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props"), ["props", "event_type"])
    requests = requests.select("event_id", "ts", "user_id", "fingerprint")  # keyed state needs no more of a request
    decided = streams.stream_intake(requests, ["user_id"], order=["event_id"], delay=f"{span + 1} seconds")
    streams.run_available(decided.select("event_id", "user_id", "decision"), f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
