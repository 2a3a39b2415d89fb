"""Sources, validation, extraction, classification, intake, sinks, streams."""

import datetime
import io
import json
import math
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__
from corpusmill import queries
from corpusmill.functions.ordering import with_positions
from corpusmill.operators import classify, dedup, extract, intake, validation
from corpusmill.sources import files, sinks
from corpusmill.streaming import streams


def test_scan_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, body in (("a/x.md", b"one"), ("b.txt", b"two"), ("c.JSON", b"{}"), ("d.pdf", b"no")):
        (tmp_path / name).write_bytes(body)
    got = files.scan_documents(spark, str(tmp_path))
    assert sorted(r.path for r in got.collect()) == ["a/x.md", "b.txt", "c.JSON"]
    numbered = {r.path: r.uid for r in with_positions(got.select("path"), ["path"]).collect()}
    assert numbered == {"a/x.md": 0, "b.txt": 1, "c.JSON": 2}
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty/z.bin").write_bytes(b"")
    with pytest.raises(ValueError, match="EMPTY_DOCUMENT_LIST"):
        files.scan_documents(spark, str(tmp_path / "empty"))


def test_buckets():
    assert files.check_location("s3://ok/x", ("ok",)) == "s3a://ok/x"
    with pytest.raises(ValueError):
        files.check_location("s3://other/x", ("ok",))


def test_manifest_and_mapping(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"fileId": "1", "fileStoragePath": "a", "x": 1}, {"fileId": "1", "fileStoragePath": "b"}, {"fileId": " ", "fileStoragePath": "c"}]))
    rows, bad = files.load_manifest(spark, str(tmp_path / "m.json"), 2)
    assert rows.count() == 3 and {r.code for r in bad.collect()} == {"DUPLICATE_FILE_ID", "INVALID_ENTRY", "TOO_MANY_DOCUMENTS"}
    (tmp_path / "map.json").write_text(json.dumps({"schemaVersion": 1, "taskId": "t", "documents": [{"uid": 0, "fileId": "f", "fileStoragePath": "p"}]}))
    assert files.read_mapping(spark, str(tmp_path / "map.json")).head() == (0, "f", "p", 1, "t")


def test_sample_lines(spark, tmp_path):
    lines = ['\ufeff{"uid": 0, "text": "a"}', "", "{bad", "[1]", '{"uid": 1}', '{"uid": -1, "text": "x"}', '{"uid": true, "text": "x"}', '{"uid": 2, "text": 3}', '{"uid": 0, "text": "again"}', '{"uid": 7, "text": ""}']
    (tmp_path / "s.jsonl").write_text("\n".join(lines) + "\n")
    good, bad = validation.validate_samples(files.read_lines(spark, str(tmp_path / "s.jsonl")))
    assert sorted(map(tuple, good.collect())) == [(0, "a"), (7, "")]
    assert dict(map(tuple, bad.collect())) == {2: "BLANK_LINE", 3: "INVALID_JSON", 4: "INVALID_RECORD", 5: "UNKNOWN_FIELDS", 6: "INVALID_UID", 7: "INVALID_UID", 8: "INVALID_TEXT", 9: "DUPLICATE_UID"}
    with pytest.raises(ValueError, match="BLANK_LINE in line 2"):
        validation.validate_samples(files.read_lines(spark, str(tmp_path / "s.jsonl")), strict=True)


def test_encodings_and_markdown_input(spark):
    rows = [(1, "é".encode()), (2, b"\xef\xbb\xbfx"), (3, "中文".encode("gb18030")), (4, b"\x81"), (5, None)]
    got = {r.i: tuple(r.d) for r in spark.createDataFrame(rows, "i int, b binary").select("i", extract.decode_with_fallback(F.col("b")).alias("d")).collect()}
    assert got == {1: ("é", "utf-8", None), 2: ("x", "utf-8-sig", None), 3: ("中文", "gb18030", None), 4: (None, None, "UNDECODABLE"), 5: (None, None, None)}
    rows = [("a.md", b"ok"), ("a.txt", b"ok"), ("a.md", b"\xff"), ("a.md", b"x\xef\xbb\xbf"), ("a.md", b"a\x00"), ("a.md", b"\xef\xbb\xbf"), ("a.MARKDOWN", b"```\n")]
    codes = [r.c for r in spark.createDataFrame(rows, "n string, b binary").select(validation.validate_markdown_input(F.col("n"), F.col("b")).alias("c")).collect()]
    assert codes == [None, "UNSUPPORTED_INPUT_FORMAT", "INVALID_UTF8", "INVALID_UTF8", "INVALID_CONTROL_CHARACTER", "EMPTY_INPUT", "INVALID_MARKDOWN"]


def office(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def test_formats_and_features(spark):
    body = '<w:document><w:body><w:t xml:space="preserve">13 characters</w:t><w:drawing><wp:anchor/></w:drawing><w:txbxContent/><w:cols/></w:body></w:document>'
    docx = office({"[Content_Types].xml": "<T/>", "word/document.xml": body, "word/media/a.png": "x", "word/charts/c.xml": "<c/>", "word/embeddings/e.bin": "e"})
    rows = [(1, "a.docx", docx), (2, "b.epub", office({"mimetype": "application/epub+zip"})), (3, "c.zip", office({"x": "y"})), (4, "d.pdf", b"%PDF-1.7"), (5, "e.txt", b"%PDF-1.7"), (6, "f.wps", b"x"), (7, "g.csv", b"a,b"), (8, "h.dat", b"\x00"), (9, "i.txt", b" <HTML>"), (10, "j.doc", bytes.fromhex("D0CF11E0A1B11AE1")), (11, "k", b"PK\x03\x04broken")]
    frame = spark.createDataFrame(rows, "doc_id long, name string, content binary")
    got = {r.doc_id: r.format for r in extract.detect_format(frame).collect()}
    assert got == {1: "zip", 2: "zip", 3: "zip", 4: "pdf", 5: None, 6: None, 7: "csv", 8: None, 9: "html", 10: "doc", 11: "zip"}
    entries = extract.archive_entries(frame.where("doc_id IN (1, 2, 3, 11)"), file_name="name")
    assert {r.doc_id: (r.format, r.error) for r in extract.detect_zip_format(entries).collect()} == {1: ("docx", None), 2: ("epub", None), 3: (None, "INVALID_ARCHIVE"), 11: (None, "INVALID_ARCHIVE")}
    book = office({"[Content_Types].xml": "<T/>", "xl/workbook.xml": "w"})
    named = spark.createDataFrame([(1, "a.docx", book), (2, "a.xlsx", book), (3, "a.docx", office({"../x": "a", "[Content_Types].xml": "", "word/document.xml": ""})), (4, "a.epub", office({}))], "doc_id long, name string, content binary")
    got = {r.doc_id: (r.format, r.error) for r in extract.detect_zip_format(extract.archive_entries(named, file_name="name")).collect()}
    assert got == {1: (None, "UNSUPPORTED_INPUT_FORMAT"), 2: ("xlsx", None), 3: (None, "INVALID_ARCHIVE"), 4: (None, "INVALID_ARCHIVE")}
    row = extract.docx_features(extract.docx_counts(entries.where("doc_id = 1"))).head()
    assert (row.text_character_count, row.visual_complexity_score) == (13, 2 + 1 + 2 + 2 + 1 + 2 + 2)
    assert row.reasons == ["image_dominant_document", "drawings=1", "anchored_objects=1", "text_boxes=1", "column_sections=1", "charts=1", "embedded_objects=1"]
    unsafe = extract.archive_entries(spark.createDataFrame([(1, office({"../x": "a"})), (2, office({"ok": "a"}))], "doc_id long, content binary"))
    assert [tuple(r) for r in extract.archive_violations(unsafe).collect()] == [(1, "UNSAFE_PATH")]
    assert [tuple(r) for r in extract.archive_violations(entries.where("doc_id = 11")).collect()] == [(11, "INVALID_ARCHIVE")]


def test_members_leave_a_task_before_all_are_read():
    """Many archives in one batch: what a task gathers is bounded, and nothing is lost."""
    raws = [office({"a": "x" * 700_000, "b": "y"})] * 40 + [None, b"broken", office({})]
    batch = pa.RecordBatch.from_arrays([pa.array(range(43)), pa.array([None] * 43, pa.string()), pa.array(raws, pa.binary())], names=["id", "extension", "content"])
    found = list(extract.entry_batches([batch]))
    assert len(found) > 5 and max(b.nbytes for b in found) < extract.OUTPUT_BYTES + 1_000_000
    rows = [r for b in found for r in b.to_pylist()]
    assert [(r["id"], r["name"], r["size"]) for r in rows[:80]] == [(i, n, k) for i in range(40) for n, k in (("a", 700_000), ("b", 1))]
    assert [(r["id"], r["name"], r["error"]) for r in rows[80:]] == [(40, None, None), (41, None, "INVALID_ARCHIVE"), (42, None, None)]


def test_windows(spark):
    cfg = classify.ChunkConfig()
    rows = spark.createDataFrame([(n, ["t"] * n) for n in (0, 10, 476, 4472)], "doc_id long, tokens array<string>")
    starts = {r.doc_id: r.s for r in rows.select("doc_id", classify.window_starts(F.col("tokens"), cfg).alias("s")).collect()}
    assert starts[0] == [] and starts[10] == [0] and starts[476] == [0, 222] and len(starts[4472]) == 20
    picked = rows.where("doc_id = 4472").select(classify.sample_windows(classify.window_starts(F.col("tokens"), cfg)).alias("s")).head().s
    assert [starts[4472].index(s) for s in picked] == [0, 1, 3, 4, 5, 6, 8, 9, 10, 11, 13, 14, 15, 16, 18, 19]


def test_scores(spark):
    schema = "doc_id long, chunk_ix int, label_ix int, label string, score double"
    rows = [(1, 0, 0, "a", 0.8), (1, 0, 1, "b", 0.2), (1, 1, 0, "a", 0.4), (1, 1, 1, "b", 0.6), (2, 0, 0, "a", 0.5), (2, 0, 1, "b", 0.5)]
    got = {r.doc_id: (r.label, round(r.confidence, 9)) for r in classify.aggregate_scores(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("a", 0.6), 2: ("a", 0.5)}
    bad = [(1, 0, 0, "a", float("nan")), (1, 0, 1, "b", 1.0), (2, 0, 0, "a", 0.7), (2, 0, 1, "b", 0.7), (3, 0, 0, "a", 1.0)]
    assert {r.doc_id: r.code for r in classify.validate_scores(spark.createDataFrame(bad, schema), 2).collect()} == {1: "RANGE", 2: "SUM", 3: "SHAPE"}


def test_intake(spark):
    rows = [("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b"), ("j", 1, "b")]
    frame = intake.with_fingerprint(spark.createDataFrame(rows, "key string, ts long, body string"), ["body"])
    got = sorted((r.key, r.ts, r.decision) for r in intake.resolve_intake(frame, ["key"], ["ts"]).collect())
    assert got == [("j", 1, "accepted"), ("k", 1, "accepted"), ("k", 2, "replay"), ("k", 3, "conflict")]


def test_sinks(spark, tmp_path):
    decisions = spark.createDataFrame([(2, None, True, None), (1, "c", False, "exact")], "uid long, cluster_id string, representative boolean, method string")
    sinks.write_decisions(decisions, str(tmp_path / "d"))
    lines = [line for f in sorted((tmp_path / "d").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == ['{"uid":1,"clusterId":"c","representative":false,"method":"exact"}', '{"uid":2,"clusterId":null,"representative":true,"method":null}']
    assert [sinks.write_once(decisions, str(tmp_path / "o")) for _ in range(2)] == ["published", "recovered"]
    with pytest.raises(FileExistsError):
        sinks.write_once(decisions.limit(1), str(tmp_path / "o"))


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    source = str(tmp_path / "in")
    clean = lambda: streams.stream_clean(streams.file_stream(spark, source, "doc_id long, text string"))
    for i in range(2):
        spark.createDataFrame([(i, f"mail a{i}@b.org")], "doc_id long, text string").write.mode("append").parquet(source)
        streams.run_available(clean(), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, "mail [EMAIL]\n"), (1, "mail [EMAIL]\n")]


def test_registry(spark, sf):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 4
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_stream_intake_decides_forgets_and_drops_late_requests(spark, tmp_path):
    schema, at = "key string, ts timestamp, event_id long, fingerprint string", lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streams.stream_intake(streams.file_stream(spark, f"{tmp_path}/in", schema), ["key"], order=["event_id"], delay="1 hour")
        streams.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
        return {r.event_id: r.decision for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    provider = spark.conf.get(streams.STATE_STORE[0])
    got = arrive([("k", at(0), 2, "A"), ("k", at(0, 10), 3, "A"), ("k", at(0), 1, "A"), ("k", at(0, 20), 4, "B")])
    assert got == {1: "accepted", 2: "replay", 3: "replay", 4: "conflict"}
    got = arrive([("k", at(0, 30), 5, "B"), ("z", at(5), 6, "Z")])
    assert got[5] == "conflict" and got[6] == "accepted"  # known from the batch before; the watermark is now 4:00
    got = arrive([("k", at(5, 10), 7, "B"), ("k", at(0, 40), 8, "A"), ("z", at(5, 20), 9, "Z")])
    assert got[7] == "accepted" and got[9] == "replay" and 8 not in got  # forgotten; late
    assert spark.conf.get(streams.STATE_STORE[0]) == provider


def test_intake_of_a_key_asks_its_state_once():
    """Rows as they come, without a table for each key; one question to the state, and one answer if the key is new."""
    asked = []

    class State:
        value = None

        def get(self):
            asked.append("get")
            return self.value

        def update(self, value):
            asked.append("update")
            self.value = value

    class Handle:
        def getValueState(self, *_):
            return State()

        def registerTimer(self, ms):
            asked.append(ms)

    first, row, at = streams.FirstRequests("ts", ["event_id"], 1000), Row("ts", "event_id", "fingerprint"), datetime.datetime(2024, 1, 1)
    first.init(Handle())
    got = list(first.handleInputRows(("k",), iter([row(at, None, "B"), row(at, 2, "A"), row(at, 1, "A")]), None))
    assert [(r.event_id, r.decision) for r in got] == [(1, "accepted"), (2, "replay"), (None, "conflict")]
    assert asked == ["get", "update", int(at.timestamp() * 1000) + 1000]
    assert [r.decision for r in first.handleInputRows(("k",), iter([row(at, 3, "B")]), None)] == ["conflict"] and asked[3:] == ["get"]


def test_publishing_compares_recorded_digests(spark, tmp_path):
    path, frame = str(tmp_path / "o"), spark.range(10).withColumn("a.b", F.lit("x")).repartition(3)
    assert sinks.write_once(frame, path) == "published" and spark.read.parquet(path).count() == 10
    for part in tmp_path.glob("o/*.parquet"):
        part.unlink()  # a second publication reads nothing of the first
    assert sinks.write_once(frame.orderBy(F.desc("id")), path) == "recovered"
    for other in (frame.limit(9), frame.union(frame), frame.withColumn("a.b", F.lit("y"))):
        with pytest.raises(FileExistsError, match="OUTPUT_CONFLICT"):
            sinks.write_once(other, path)
    (tmp_path / "foreign").mkdir()
    with pytest.raises(FileExistsError, match="OUTPUT_CONFLICT"):
        sinks.write_once(frame, str(tmp_path / "foreign"))
    lines = spark.createDataFrame([(2, None, True, None), (1, "c", False, "exact")], "uid long, cluster_id string, representative boolean, method string")
    assert [sinks.write_decisions(lines, str(tmp_path / "d")) for _ in range(2)] == ["published", "recovered"]
    assert [json.loads(r.value)["uid"] for r in spark.read.text(str(tmp_path / "d")).collect()] == [1, 2]


def test_a_broken_publication_leaves_nothing(spark, tmp_path):
    broken = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise("x").alias("v"), "id").repartition(4)
    with pytest.raises(Exception, match="broken"):
        sinks.write_once(broken, str(tmp_path / "o"))
    assert [p for p in tmp_path.iterdir()] == []
    assert sinks.write_once(broken.where("id < 99"), str(tmp_path / "o")) == "published"


def test_manifest_followed_to_its_documents(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "a b").mkdir(parents=True)
    (root / "a b" / "one é.md").write_bytes(b"\xef\xbb\xbfx\r\ny")
    (root / "bad.txt").write_bytes(b"\xff\xfe")
    (root / "big.txt").write_bytes(b"b" * 300)
    (root / "empty.json").write_bytes(b"")
    names = ["a b/one é.md", "a b/one é.md", "bad.txt", "big.txt", "empty.json", "none.txt", "../out.txt", "/etc/passwd.txt", "x.pdf", " ", None]
    (tmp_path / "m.json").write_text(json.dumps([{"fileId": str(i), "fileStoragePath": n, "more": 1} for i, n in enumerate(names)]))
    rows, _ = files.load_manifest(spark, str(tmp_path / "m.json"))
    got = {r.file_id: (r.text, r.size_bytes, r.error_code) for r in files.follow_manifest(rows, str(root), max_document_bytes=200, part_bytes=4).collect()}
    assert got["0"] == got["1"] == ("x\ny", 7, None) and got["4"] == ("", 0, None)
    codes = {"2": "DOCUMENT_DECODE_FAILED", "3": "DOCUMENT_TOO_LARGE", "5": "DOCUMENT_NOT_FOUND", "6": "DOCUMENT_PATH_NOT_ALLOWED", "7": "DOCUMENT_PATH_NOT_ALLOWED", "8": "UNSUPPORTED_DOCUMENT_FORMAT", "9": "INVALID_ENTRY", "10": "INVALID_ENTRY"}
    assert {i: got[i][2] for i in codes} == codes and all(got[i][0] is None for i in codes)
    assert files.follow_manifest(rows.limit(0), str(root)).count() == 0


def test_scratch_tables_go_with_their_block(spark):
    from corpusmill.functions import storage

    with storage.scratch(spark):
        kept, path = storage.materialize(spark.range(3), "outer")
        with pytest.raises(KeyError), storage.scratch(spark):
            _, inner = storage.materialize(spark.range(3), "inner")
            raise KeyError
        assert storage.path_exists(spark, path) and not storage.path_exists(spark, inner) and kept.count() == 3
    assert not storage.path_exists(spark, path)
    _, lasting = storage.materialize(spark.range(3), "lasting")
    assert storage.path_exists(spark, lasting)


def test_mapping_files_and_their_checks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "f1", "p1", 1, "t"), (1, "f2", "p2", 1, "t"), (-3, "f", "p", 2, "t"), (4, " ", "p", 1, "other"), (5, "f", "p", 1, "t")], "uid long, file_id string, file_storage_path string, schema_version int, task_id string")
    files.write_mapping(rows, str(tmp_path / "m"))
    read = files.read_mapping(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, rows.collect()))
    found = {(r.code, r.uid) for r in dedup.check_mapping(read, "t").collect()}
    assert found == {("DUPLICATE_UID", 1), ("INVALID_UID", -3), ("SCHEMA_VERSION", -3), ("BLANK_FIELD", 4), ("TASK_ID", 4)}


def test_scores_of_the_model_from_its_coefficients(spark):
    """Each score once more: hashed terms counted and weighed by hand, times the coefficients, through the logistic."""
    from pyspark.ml.feature import HashingTF

    rows = [(i, i % 2, f"Word{i % 5} word{i % 3} other tail{i % 2}" + " word1" * (i % 4), i % 2) for i in range(60)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_ix int, chunk string, quality int")
    model = classify.fit_chunk_model(chunks, "quality", 64)
    _, _, weigh, logistic = model.stages
    bucket = HashingTF(numFeatures=64).indexOf
    weights, coefficients = weigh.idf.toArray(), logistic.coefficients.toArray()
    got = {(r.doc_id, r.label_ix): (r.label, r.score) for r in classify.score_chunks(chunks, model, ["low", "high"]).collect()}
    for doc_id, _, text, _ in rows:
        total = logistic.intercept + sum(weights[bucket(t)] * coefficients[bucket(t)] for t in text.lower().split())
        high = 1 / (1 + math.exp(-total))
        assert got[doc_id, 1] == ("high", pytest.approx(high, abs=1e-12)) and got[doc_id, 0] == ("low", pytest.approx(1 - high, abs=1e-12))
    documents = [math.log((60 + 1) / (1 + sum(any(bucket(t) == b for t in text.lower().split()) for _, _, text, _ in rows))) for b in range(64)]
    assert list(weights) == pytest.approx(documents)
