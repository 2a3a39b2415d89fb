"""De-duplication: vectors, invariants, and the regression numbers of the small tables."""

import hashlib
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import digests, ordering
from corpusmill.functions.text import strip, uuid5
from corpusmill.operators import dedup, validation
from corpusmill.operators.components import connected_components
from corpusmill.plans import flows


@pytest.fixture
def texts(spark):
    return lambda rows: spark.createDataFrame(rows, "uid long, text string")


def exact(frame):
    return {r.uid: (r.exact_rep, r.group_size) for r in dedup.exact_groups(frame).collect()}


def test_only_outer_white_space_is_ignored(texts):
    got = exact(texts([(0, "  A 1!\n"), (1, "A 1!"), (2, "a 1!"), (3, "A1!"), (4, "\u3000A 1!\x1f\x85"), (5, "")]))
    assert got == {0: (0, 3), 1: (0, 3), 4: (0, 3), 2: (2, 1), 3: (3, 1), 5: (5, 1)}


def test_groups_do_not_depend_on_order(texts):
    assert exact(texts([(8, "x"), (5, "y"), (3, "x"), (1, "z"), (2, "z")])) == {8: (3, 2), 3: (3, 2), 5: (5, 1), 1: (1, 2), 2: (1, 2)}


def test_strip_agrees_with_python(spark):
    values = ["\x1c a \x1d", "\u2003b\u00a0", " \u200bc ", "\n", "", "d"]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select(strip(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == [v.strip() for v in values]


def test_lsh_parameters_and_uuid(spark):
    assert dedup.lsh_parameters(0.7, 256) == (25, 10)
    space = uuid.UUID(dedup.CLUSTER_NAMESPACE)
    for name in ("r\x001,2", "é", ""):
        got = spark.range(1).select(uuid5(dedup.CLUSTER_NAMESPACE, F.lit(name)).alias("u")).head().u
        assert got == str(uuid.uuid5(space, name))


def test_band_keys_match_direct_arithmetic():
    text, cfg = "Some short text to hash", dedup.MinHashConfig()
    a, b = dedup.hash_family(cfg.permutations, cfg.seed)
    grams = {text.lower()[i : i + 5] for i in range(len(text) - 4)}
    low = [int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "little") for g in grams]
    least = [min(((h * int(x) + int(y)) % 2**64) % (2**61 - 1) & 0xFFFFFFFF for h in low) for x, y in zip(a, b, strict=True)]
    keys, short = dedup.band_keys([text, "abcd"], cfg)
    assert short == []
    assert len(keys) == 25 and b"".join(keys) == b"".join(v.to_bytes(4, "big") for v in least[:250])


def _direct(text, cfg):
    """Bands by plain arithmetic on each window."""
    a, b = dedup.hash_family(cfg.permutations, cfg.seed)
    bands, rows = dedup.lsh_parameters(cfg.threshold, cfg.permutations)
    folded = text.lower() if cfg.lowercase else text
    low = [int.from_bytes(hashlib.sha1(folded[i : i + cfg.window].encode()).digest()[:4], "little") for i in range(len(folded) - cfg.window + 1)]
    least = [min(((h * int(x) + int(y)) % 2**64) % (2**61 - 1) & 0xFFFFFFFF for h in low).to_bytes(4, "big") for x, y in zip(a, b, strict=True)]
    return [b"".join(least[k * rows : (k + 1) * rows]) for k in range(bands)]


def test_windows_that_texts_share_are_hashed_once(monkeypatch):
    hashed = Counter()
    real = hashlib.sha1
    monkeypatch.setattr(dedup.hashlib, "sha1", lambda w: (hashed.update([w]), real(w))[1])
    text, cfg = "the same words in every text", dedup.MinHashConfig(permutations=12)
    keys = dedup.band_keys([text] * 50, cfg)
    assert set(hashed.values()) == {1} and len(hashed) == len(text) - 4
    assert all(k == keys[0] for k in keys)


def test_bands_of_odd_texts_and_of_full_tables(monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_WINDOWS", 64)
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 300)))
    rows = ["ab\0cd\0\0\0e", "\0" * 9, "\U0001f600" * 7, "İstanbul Σας", "short", "abcd", "", wide, "aab" * 40, wide + wide[::-1]]
    for cfg in (dedup.MinHashConfig(permutations=12), dedup.MinHashConfig(permutations=12, window=2, lowercase=False), dedup.MinHashConfig(permutations=12, window=9)):
        known = dedup.WindowHashes(cfg.window, bits=3)  # windows take each other's places
        for _ in range(2):
            assert dedup.band_keys(rows, cfg, known) == [_direct(t, cfg) if len(t) >= cfg.window else [] for t in rows]


def test_values_at_the_modulus(monkeypatch):
    """Sums of 2^61 - 1 and a few more are 0 and a few."""
    x = int.from_bytes(hashlib.sha1(b"abcde").digest()[:4], "little")
    offsets = [(2**61 - 1 + d - x) % 2**64 for d in (-1, 0, 1, 2)] + [(2**64 - 1 - x) % 2**64]
    monkeypatch.setattr(dedup, "hash_family", lambda *_: (dedup.np.ones(5, "u8"), dedup.np.array(offsets, "u8")))
    assert dedup.signatures_of(["abcde"], dedup.MinHashConfig(permutations=5)).tolist() == [[0xFFFFFFFE, 0, 1, 2, 7]]


def test_near_duplicates_by_minhash(texts):
    long = "这是一段用于近似去重的很长的中文文本，" * 12
    english = "The quick brown fox jumps over the lazy dog near the river bank. " * 6
    rows = [(0, long), (1, long + "多"), (2, english), (3, english + "!"), (4, english.upper()), (5, "abc"), (6, "abd"), (7, "completely different words stand here")]
    got = {r.node: r.component for r in dedup.minhash_clusters(texts(rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2}


def test_decisions_expand_exact_groups_into_clusters(texts):
    english = "The quick brown fox jumps over the lazy dog near the river bank. " * 6
    rows = [(0, english + "!"), (1, english), (2, " " + english), (3, "alone in the world"), (4, "twice the same"), (5, "twice the same ")]
    frame = texts(rows)
    got = {r.uid: r for r in dedup.dedup_decisions(frame, "req").collect()}
    assert [got[i].method for i in range(6)] == ["exact_minhash"] * 3 + [None, "exact", "exact"]
    assert [got[i].representative for i in range(6)] == [True, False, False, True, True, False]
    space = uuid.UUID(dedup.CLUSTER_NAMESPACE)
    assert got[1].cluster_id == str(uuid.uuid5(space, "req\x000,1,2")) and got[5].cluster_id == str(uuid.uuid5(space, "req\x004,5"))
    assert dedup.validate_decisions(dedup.dedup_decisions(frame, "req"), frame.select("uid")).count() == 0


def test_regression_numbers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("uid"), "text")
    rows = dedup.dedup_decisions(docs, "req").collect()
    methods = Counter(m for _, m in {(r.cluster_id, r.method) for r in rows if r.cluster_id})
    assert methods == {"exact": 54, "minhash": 44, "exact_minhash": 8}
    assert sum(r.representative for r in rows) == 869
    assert max(Counter(r.cluster_id for r in rows if r.cluster_id).values()) == 8


def test_violations_are_all_named(spark):
    schema = "uid long, cluster_id string, representative boolean, method string"
    rows = [(1, "a", True, "exact"), (1, "a", True, "minhash"), (2, None, False, "exact"), (3, "b", True, "odd"), (9, None, True, None), (-1, None, True, None)]
    codes = {r.code for r in dedup.validate_decisions(spark.createDataFrame(rows, schema), spark.createDataFrame([(1,), (4,)], "uid long")).collect()}
    assert codes == {"DUPLICATE_UID", "MISSING_UID", "UNEXPECTED_UID", "INVALID_TYPE", "INVALID_SINGLETON", "INVALID_METHOD", "CLUSTER_TOO_SMALL", "REPRESENTATIVE_COUNT", "MIXED_METHODS"}


def test_ids_of_clusters_of_any_size(spark, monkeypatch):
    """More members than a chunk, a partition, or the old limit of listed members holds: the same definition."""
    monkeypatch.setattr(digests, "CHUNK_BYTES", 1000)
    members = spark.range(0, 120_000).selectExpr("CASE WHEN id % 7 = 0 THEN 1L ELSE 0L END AS cluster", "id AS uid")
    got = {r.cluster: r.cluster_id for r in dedup.cluster_ids(members, "req").collect()}
    listed = {c: ",".join(str(i) for i in range(120_000) if (i % 7 == 0) == c) for c in (0, 1)}
    assert got == {c: str(uuid.uuid5(uuid.UUID(dedup.CLUSTER_NAMESPACE), f"req\0{names}")) for c, names in listed.items()}


@pytest.mark.parametrize("chunk", [1, 5, 1 << 20])
def test_listed_digests(spark, chunk):
    rows = [("a", v) for v in (5, 5, 5, 6, 40, -1)] + [("b", 7), (None, 1), ("c", None)]
    got = digests.listed_digest(spark.createDataFrame(rows, "k string, v long").withColumn("p", F.lit(b"x")), "k", "v", "p", chunk_bytes=chunk).collect()
    assert {r.k: r.digest for r in got} == {"a": hashlib.sha256(b"x-1,5,5,5,6,40").hexdigest(), "b": hashlib.sha256(b"x7").hexdigest()}


def test_batch_fingerprint_of_many_paths(spark):
    rows = spark.range(0, 110_000).selectExpr("CASE WHEN id % 2 = 0 THEN 'x' END AS source", "concat('p', id) AS path")
    got = {r.source: r.fingerprint for r in validation.batch_fingerprint(rows, ["source"]).collect()}
    paths = lambda odd: "\n".join(sorted(f"p{i}" for i in range(odd, 110_000, 2)))
    assert got == {"x": hashlib.sha256(paths(0).encode()).hexdigest(), None: hashlib.sha256(paths(1).encode()).hexdigest()}


def test_copies_are_left_out_in_the_scan(spark, texts):
    frame = texts([(i, f"text number {i % 5}") for i in range(0, 70_000, 1000)])
    groups = dedup.exact_groups(frame)
    once = dedup.without_uids(frame, groups.where("uid <> exact_rep").select("uid"))
    assert sorted(r.uid for r in once.collect()) == sorted(r.exact_rep for r in groups.select("exact_rep").distinct().collect())
    assert "Exchange hashpartitioning(text" not in once._jdf.queryExecution().toString()
    assert dedup.without_uids(frame, groups.select("uid"), max_bytes=0) is None
    few = dedup.representative_signatures(frame, groups).collect()
    assert sorted(r.uid for r in few) == sorted(r.uid for r in once.collect())


def test_lsh_parameter_table(spark):
    rows = spark.createDataFrame([(0.7, 24), (0.5, 16), (0.9, 30), (0.7, 24)], "threshold double, permutations int")
    got = {(r.threshold, r.permutations): (r.bands, r.band_rows) for r in dedup.lsh_parameter_table(rows).collect()}
    assert got == {k: dedup.lsh_parameters(*k) for k in ((0.7, 24), (0.5, 16), (0.9, 30))}


def test_small_tables_are_dealt_out_and_nothing_runs_for_it(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    frame, tracker = spark.read.parquet(f"{tmp_path}/one"), spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    dealt = ordering.spread(frame.join(frame.withColumnRenamed("id", "other"), F.col("id") == F.col("other")).where("id > 1"))
    assert set(tracker.getJobIdsForGroup(None)) == before
    full = ordering.spread(frame).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(full) == spark.sparkContext.defaultParallelism and dealt.count() == 998


def test_flow_and_quarantine(spark, texts):
    frame = texts([(0, "x"), (1, "x"), (2, "x"), (3, "y")])
    mapping = spark.createDataFrame([(i, f"f{i}", f"d{i}/same.txt") for i in range(4)], "uid long, file_id string, file_storage_path string")
    result, violations = flows.deduplicate(frame, mapping, "req", flows.TASK_ID)
    assert violations.count() == 0
    assert {r.file_id: r.keep for r in result.collect()} == {"f0": True, "f1": False, "f2": False, "f3": True}
    plan = {r.file_id: (r.state, r.code) for r in dedup.quarantine_plan(result).collect()}
    assert plan == {"f1": ("planned", None), "f2": ("failed", "OUTPUT_CONFLICT")}
    assert dedup.dedup_summary(result).head().asDict() == {"total_files": 4, "unique_files": 2, "moved_duplicates": 2, "groups": 1}


def test_components_join_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(139, 40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert set(got.values()) == {0} and len(got) == 81
