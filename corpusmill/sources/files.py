"""Document files, manifests and record lines as DataFrames. Any Hadoop path works, object stores included."""

from __future__ import annotations

from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.storage import materialize
from corpusmill.functions.text import normalize_text

SUFFIXES = ("md", "txt", "json")


def check_location(path: str, allowed_buckets: tuple[str, ...] = ()) -> str:
    """The path, with ``s3://`` as ``s3a://``; object-store paths must name an allowed bucket."""
    parts = urlsplit(path)
    if parts.scheme in ("s3", "s3a"):
        if parts.netloc not in allowed_buckets:
            raise ValueError(f"bucket {parts.netloc!r} is not allowed")
        return path.replace("s3://", "s3a://", 1)
    return path


def scan_documents(spark: SparkSession, path: str, allowed_buckets: tuple[str, ...] = ()) -> DataFrame:
    """``file_id, path, content, size_bytes`` of the ``.md``, ``.txt`` and ``.json`` files below ``path``.

    ``path`` is relative to the folder; ``file_id`` is a digest of it. No files: ``EMPTY_DOCUMENT_LIST``.
    """
    root = check_location(path, allowed_buckets).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    wanted = files.where(F.col("path").rlike(rf"(?i)\.(?:{'|'.join(SUFFIXES)})\z"))
    if wanted.select("path").isEmpty():
        raise ValueError("EMPTY_DOCUMENT_LIST")
    inside = urlsplit(root).path + "/"
    relative = F.substring(F.col("path"), F.locate(inside, F.col("path")) + len(inside), F.char_length("path"))
    return wanted.select(F.sha2(relative, 256).alias("file_id"), relative.alias("path"), "content", F.col("length").alias("size_bytes"))


def allowed_location(path: Column, allowed_buckets: tuple[str, ...] = ()) -> Column:
    """Of a column of paths: ``struct<path,error>``, as ``check_location`` decides it."""
    bucket = F.regexp_extract(path, r"\As3a?://([^/]*)", 1)
    stored = path.rlike(r"\As3a?://")
    ok = ~stored | bucket.isin(*allowed_buckets)
    return F.struct(F.when(ok, F.regexp_replace(path, r"\As3://", "s3a://")).alias("path"), F.when(~ok, "BUCKET_NOT_ALLOWED").alias("error"))


def load_manifest(spark: SparkSession, path: str, max_documents: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Manifest rows ``(file_id, file_storage_path)`` and violations ``(code, file_id)``; other keys are ignored. A
    manifest is a ``.json`` file that holds an array, or a folder of part files with one entry a line."""
    raw = spark.read.schema("fileId string, fileStoragePath string").option("multiLine", path.endswith(".json")).json(path)
    rows = raw.select(F.col("fileId").alias("file_id"), F.col("fileStoragePath").alias("file_storage_path"))
    blank = rows.where("trim(coalesce(file_id, '')) = '' OR trim(coalesce(file_storage_path, '')) = ''").select(F.lit("INVALID_ENTRY").alias("code"), "file_id")
    twice = rows.where("file_id IS NOT NULL").groupBy("file_id").count().where("count > 1").select(F.lit("DUPLICATE_FILE_ID").alias("code"), "file_id")
    nobody = F.lit(None).cast("string").alias("file_id")
    total = rows.agg(F.count("*").alias("n"))
    empty = total.where("n = 0").select(F.lit("EMPTY_DOCUMENT_LIST").alias("code"), nobody)
    many = total.where(F.col("n") > max_documents).select(F.lit("TOO_MANY_DOCUMENTS").alias("code"), nobody)
    return rows, blank.unionByName(twice).unionByName(empty).unionByName(many)


def follow_manifest(rows: DataFrame, root: str, max_document_bytes: int = 100 << 20, part_bytes: int = 64 << 20, allowed_buckets: tuple[str, ...] = ()) -> DataFrame:
    """``file_id, file_storage_path, text, size_bytes, error_code`` of manifest rows ``(file_id, file_storage_path)``: the
    files they name below ``root``, one row per row, in tasks of about ``part_bytes``.

    The folder's listing, without contents, gives sizes; running sums of them over path-ordered blocks deal the files out,
    and only files that are named are opened. A file named twice is opened twice. Codes: ``INVALID_ENTRY`` (blank fields),
    ``DOCUMENT_PATH_NOT_ALLOWED`` (a path that leads out of the root), ``UNSUPPORTED_DOCUMENT_FORMAT``, ``DOCUMENT_NOT_FOUND``, ``DOCUMENT_TOO_LARGE``,
    ``DOCUMENT_DECODE_FAILED``; rows with a code have no text. Files must be of a file system that Arrow opens.
    """
    spark, folder = rows.sparkSession, check_location(root, allowed_buckets).rstrip("/")
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("path").alias("uri"), F.col("length").alias("size"))
    inside = urlsplit(folder).path + "/"
    listed = listing.select(F.substring("uri", F.locate(inside, F.col("uri")) + len(inside), F.char_length("uri")).alias("name"), "uri", "size")
    named = rows.select("file_id", "file_storage_path", F.trim("file_storage_path").alias("name"))
    blank = F.expr("trim(coalesce(file_id, '')) = '' OR coalesce(name, '') = ''")
    outside = F.col("name").rlike(r"\A/|\A[A-Za-z0-9+.-]+:|(?:\A|/)\.\.(?:/|\z)")
    kind = ~F.col("name").rlike(rf"(?i)\.(?:{'|'.join(SUFFIXES)})\z")
    found = named.join(listed, "name", "left")
    code = F.when(blank, "INVALID_ENTRY").when(outside, "DOCUMENT_PATH_NOT_ALLOWED").when(kind, "UNSUPPORTED_DOCUMENT_FORMAT").when(F.col("size") > max_document_bytes, "DOCUMENT_TOO_LARGE")
    base = folder if urlsplit(folder).scheme else f"file:{folder}"  # the listing leaves out empty files; the task that opens a file knows
    uri = F.coalesce("uri", F.concat(F.lit(f"{base}/"), "name")).alias("uri")
    coded, _ = materialize(found.select("file_id", "file_storage_path", "name", uri, F.coalesce("size", F.lit(0)).alias("size"), code.alias("code")), "manifest-files")
    width = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = coded.where("code IS NULL").repartitionByRange(width, "name", "file_id").select("file_id", "file_storage_path", "uri", "size", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("seq"))
    blocks, _ = materialize(wanted, "manifest-blocks")
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    offsets = blocks.groupBy("block").agg(F.sum("size").alias("bytes")).select("block", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("ahead"))
    run = Window.partitionBy("block").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = blocks.withColumn("reached", F.sum("size").over(run)).join(F.broadcast(offsets), "block").select("file_id", "file_storage_path", "uri", "size", ((F.col("ahead") + F.col("reached") - F.col("size")) / part_bytes).cast("long").alias("part"))
    parts = 1 + (dealt.agg(F.max("part")).head()[0] or 0)
    contents = dealt.repartition(parts, "part").select("file_id", "file_storage_path", "uri").mapInArrow(_open_files, "file_id string, file_storage_path string, content binary, missing boolean")
    text = normalize_text(F.col("content"))
    read = contents.select("file_id", "file_storage_path", text.alias("text"), F.octet_length("content").cast("long").alias("size_bytes"), F.when(F.col("missing"), "DOCUMENT_NOT_FOUND").when(text.isNull(), "DOCUMENT_DECODE_FAILED").alias("error_code"))
    failed = coded.where("code IS NOT NULL").select("file_id", "file_storage_path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("size_bytes"), F.col("code").alias("error_code"))
    return read.unionByName(failed)


def _open_files(batches):
    """One file at a time; a file that is gone by now has no content."""
    for batch in batches:
        for file_id, path, uri in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            try:
                system, place = pafs.FileSystem.from_uri(quote(uri, safe=":/%?&=@"))
                with system.open_input_stream(place) as stream:
                    content = stream.read()
            except FileNotFoundError:
                content = None
            columns = [pa.array([file_id]), pa.array([path]), pa.array([content], pa.binary()), pa.array([content is None])]
            yield pa.RecordBatch.from_arrays(columns, names=["file_id", "file_storage_path", "content", "missing"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, value`` of one text file, read in splits: a line's number is the number of lines in the splits before
    its own, plus its place there."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"))
    counts = lines.groupBy("split").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per split
    offsets = counts.select("split", "first", ahead.alias("ahead"))
    return lines.join(F.broadcast(offsets), "split").select((F.col("ahead") + F.col("seq") - F.col("first") + 1).alias("line_no"), "value")


def write_mapping(mapping: DataFrame, path: str) -> None:
    """Mapping files of ``uid, file_id, file_storage_path, schema_version, task_id``: one JSON object a line, in part files
    of any number, so that no mapping need fit one row."""
    document = F.struct("uid", F.col("file_id").alias("fileId"), F.col("file_storage_path").alias("fileStoragePath"))
    rows = mapping.select(F.col("schema_version").alias("schemaVersion"), F.col("task_id").alias("taskId"), F.array(document).alias("documents"))
    rows.write.mode("errorifexists").json(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """``uid, file_id, file_storage_path, schema_version, task_id`` of a mapping: a file that holds one object, or a folder
    of files that hold one a line."""
    schema = "schemaVersion int, taskId string, documents array<struct<uid:long,fileId:string,fileStoragePath:string>>"
    lines = spark.read.text(path, wholetext=path.endswith(".json")).select(F.from_json("value", schema).alias("m"))
    rows = lines.select("m.schemaVersion", "m.taskId", F.inline("m.documents"))
    return rows.select("uid", F.col("fileId").alias("file_id"), F.col("fileStoragePath").alias("file_storage_path"), F.col("schemaVersion").alias("schema_version"), F.col("taskId").alias("task_id"))
