"""Global de-duplication: exact groups, character 5-gram MinHash with banding, components, decisions.

Documents are rows ``(uid, text)``. Text leaves the plan as early as it can: exact groups travel as digests, MinHash
reads only one text per exact group, bands travel as 16-byte digests, and everything after them is ids.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.digests import listed_uuid
from corpusmill.functions.ordering import spread
from corpusmill.functions.storage import drop_path, materialize
from corpusmill.functions.text import digest, namespace_bytes, strip
from corpusmill.operators.components import connected_components

# The namespace of cluster ids, and the hash family's modulus and range.
CLUSTER_NAMESPACE = "f02873a0-e739-4e4b-a0ce-285f47b87923"
PRIME = np.uint64((1 << 61) - 1)
RANGE = np.uint64((1 << 32) - 1)


@dataclass(frozen=True)
class MinHashConfig:
    window: int = 5
    lowercase: bool = True
    permutations: int = 256
    threshold: float = 0.7
    seed: int = 42


@cache
def lsh_parameters(threshold: float = 0.7, permutations: int = 256) -> tuple[int, int]:
    """Bands and rows that minimise the mean of the false-positive and false-negative areas, by the trapezoid rule."""
    grid = np.linspace(0.0, 1.0, 2001)
    below, above = grid[grid <= threshold], grid[grid >= threshold]
    choices = [(b, r) for b in range(1, permutations + 1) for r in range(1, permutations // b + 1)]

    def cost(b: int, r: int) -> float:
        return float(np.trapezoid(1 - (1 - below**r) ** b, below) + np.trapezoid((1 - above**r) ** b, above))

    return min(choices, key=lambda c: cost(*c))


def lsh_parameter_table(requests: DataFrame, grid: int = 2001) -> DataFrame:
    """``threshold, permutations, bands, band_rows`` of each distinct request ``(threshold, permutations)``, as
    ``lsh_parameters`` chooses them: bands and rows within the permutations, both areas by the trapezoid rule over the same
    grid. Every candidate is one row, so that requests of many permutations spread over tasks."""
    wanted = requests.select("threshold", "permutations").distinct()
    bands = wanted.select("*", F.explode(F.expr("sequence(1, permutations)")).alias("bands"))
    choices = bands.select("*", F.explode(F.expr("sequence(1, permutations DIV bands)")).alias("band_rows"))
    points = f"transform(sequence(0, {grid - 1}), k -> k / {grid - 1}D)"
    hit = "pow(1 - pow(s, band_rows), bands)"
    area = lambda chosen, value: f"aggregate(slice(filter({points}, s -> {chosen}), 2, {grid}), named_struct('last', filter({points}, s -> {chosen})[0], 'sum', 0D), (acc, s) -> named_struct('last', s, 'sum', acc.sum + (s - acc.last) * ({value} + {value.replace('s,', 'acc.last,')}) / 2), acc -> acc.sum)"
    cost = F.round(F.expr(area("s <= threshold", f"(1 - {hit})")) + F.expr(area("s >= threshold", hit)), 12)
    best = choices.groupBy("threshold", "permutations").agg(F.min(F.struct(cost.alias("cost"), "bands", "band_rows")).alias("best"))
    return best.select("threshold", "permutations", "best.bands", "best.band_rows")


@cache
def hash_family(permutations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets, drawn in turn."""
    draw = np.random.RandomState(seed).randint
    pairs = [(draw(1, PRIME, dtype=np.uint64), draw(0, PRIME, dtype=np.uint64)) for _ in range(permutations)]
    return np.array([a for a, _ in pairs], np.uint64), np.array([b for _, b in pairs], np.uint64)


#: Characters hashed together, windows permuted at a time, and the logarithm of the windows whose hashes are remembered.
BATCH_CHARS = 1 << 17
BLOCK_WINDOWS = 1 << 16
KNOWN_BITS = 20


class WindowHashes:
    """The first four bytes of the SHA-1 of windows. A corpus has few different windows beside its characters, so hashes are
    remembered in a table of fixed size, where a window's code points, three to a word, give its place; one whose place
    another has taken is hashed again."""

    def __init__(self, width: int, bits: int = KNOWN_BITS) -> None:
        self.width, self.shift = width, np.uint64(64 - bits)
        self.words = [np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64) for _ in range(0, width, 3)]
        self.hashes = np.zeros(1 << bits, np.uint32)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all windows, text by text, and how many each text has: at least one."""
        counts = np.fromiter(map(len, texts), np.int64, len(texts)) - (self.width - 1)
        starts = np.arange(counts.sum()) + np.repeat(np.arange(len(texts)) * (self.width - 1), counts)
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        count, words, place = len(points) - self.width + 1, [], np.zeros(len(starts), np.uint64)
        for k in range(0, self.width, 3):
            word = points[k : k + count].copy()
            for j in range(k + 1, min(k + 3, self.width)):
                word |= points[j : j + count] << np.uint64(21 * (j - k))
            words.append(word[starts])  # without windows across two texts
            place = (place ^ (place >> np.uint64(32)) ^ words[-1]) * np.uint64(0x9E3779B97F4A7C15)
        place = (place >> self.shift).astype(np.int64)
        found = self.hashes[place]
        known = np.ones(len(starts), bool)
        for own, word in zip(self.words, words, strict=True):
            known &= own[place] == word
        missing = np.flatnonzero(~known)
        if len(missing):
            windows = [joined[i : i + self.width] for i in starts[missing].tolist()]
            fresh = {w: int.from_bytes(hashlib.sha1(w.encode("utf-8", "replace")).digest()[:4], "little") for w in set(windows)}
            found[missing] = [fresh[w] for w in windows]
            at = place[missing]
            for own, word in zip(self.words, words, strict=True):
                own[at] = word[missing]  # of two windows for one place the last stays, in every array
            self.hashes[at] = found[missing]
        return found, counts


def signatures_of(texts: list[str], cfg: MinHashConfig, known: WindowHashes | None = None) -> np.ndarray:
    """Least hash values per permutation, one row per text; every text holds a window. Permutations run over the different
    hashes of a few texts at a time, which stay near the core."""
    found, counts = (known or WindowHashes(cfg.window)).of([t.lower() for t in texts] if cfg.lowercase else texts)
    ends = np.cumsum(counts)
    out = np.empty((len(texts), cfg.permutations), ">u4")
    low = 0
    while low < len(texts):
        begin = ends[low] - counts[low]
        high = max(low + 1, int(np.searchsorted(ends, begin + BLOCK_WINDOWS, "right")))
        owner = np.arange(high - low, dtype=np.uint64) << np.uint64(32)
        own = np.sort(np.repeat(owner, counts[low:high]) | found[begin : ends[high - 1]])
        own = own[np.append(True, own[1:] != own[:-1])]
        out[low:high] = _least(own & RANGE, np.searchsorted(own, owner), cfg).T
        low = high
    return out


def _least(x: np.ndarray, begins: np.ndarray, cfg: MinHashConfig) -> np.ndarray:
    """Per permutation the least values of the stretches that begin so."""
    value, over, low = np.empty_like(x), np.empty_like(x), np.empty(len(x), np.uint32)
    out = np.empty((cfg.permutations, len(begins)), np.uint32)
    for k, (a, b) in enumerate(zip(*hash_family(cfg.permutations, cfg.seed), strict=True)):
        np.multiply(x, a, out=value)  # modulo 2^64, then 2^61 - 1, by definition of the family
        value += b
        np.right_shift(value, np.uint64(61), out=over)
        value &= PRIME
        value += over
        if value.max() >= PRIME:
            value[value >= PRIME] -= PRIME
        np.copyto(low, value, casting="unsafe")  # the range: 32 bits
        np.minimum.reduceat(low, begins, out=out[k])
    return out


def band_keys(texts: list[str], cfg: MinHashConfig, known: WindowHashes | None = None) -> list[list[bytes]]:
    """Per text the bands of its signature, each of its minima as 4 big-endian bytes; none for texts without a window."""
    bands, rows = lsh_parameters(cfg.threshold, cfg.permutations)
    out: list[list[bytes]] = [[] for _ in texts]
    whole = [i for i, t in enumerate(texts) if len(t) >= cfg.window]
    for row, i in zip(signatures_of([texts[i] for i in whole], cfg, known) if whole else (), whole, strict=True):
        out[i] = [row[k * rows : (k + 1) * rows].tobytes() for k in range(bands)]
    return out


def exact_groups(docs: DataFrame) -> DataFrame:
    """``uid, exact_rep, group_size, stripped_length``: texts equal after stripping, named by their smallest uid."""
    stripped = strip(F.col("text"))
    keyed = docs.select("uid", F.unhex(digest(stripped)).alias("key"), F.char_length(stripped).alias("stripped_length"))
    groups = keyed.groupBy("key").agg(F.min("uid").alias("exact_rep"), F.count("*").alias("group_size"))
    return keyed.join(groups, "key").select("uid", "exact_rep", "group_size", "stripped_length")


def char_shingles(text: Column, window: int = 5) -> Column:
    """Distinct lower-case windows of code points; none for shorter texts."""
    chars = F.split(F.lower(text), "")
    count = F.size(chars) - (window - 1)
    shifted = F.arrays_zip(*(F.slice(chars, k + 1, count).alias(f"c{k}") for k in range(window)))  # no indexing inside the lambda
    grams = F.transform(shifted, lambda z: F.concat(*(z[f"c{k}"] for k in range(window))))
    return F.when(F.char_length(text) < window, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def minhash_signatures(docs: DataFrame, cfg: MinHashConfig = MinHashConfig()) -> DataFrame:
    """``uid, bands`` (array of binary) for texts of at least one window, hashed where they are read: no text of a large
    table is shuffled."""
    lsh_parameters(cfg.threshold, cfg.permutations)

    def run(batches):
        known = WindowHashes(cfg.window)
        for batch in batches:
            chars = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy())
            at = 0
            while at < batch.num_rows:  # at least one text
                end = max(at + 1, int(np.searchsorted(chars, BATCH_CHARS + (chars[at - 1] if at else 0), "right")))
                part = batch.slice(at, end - at)
                bands = band_keys([t or "" for t in part.column(1).to_pylist()], cfg, known)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bands, pa.list_(pa.binary()))], names=["uid", "bands"])
                at = end

    return spread(docs.select(F.col("uid").cast("long").alias("uid"), "text")).mapInArrow(run, "uid long, bands array<binary>").where(F.size("bands") > 0)


def lsh_edges(signatures: DataFrame) -> DataFrame:
    """``src, dst``: star edges from the smallest uid of each (band, key) bucket; linear in the bucket's size."""
    rows = signatures.select("uid", F.posexplode("bands").alias("band", "key")).select("uid", "band", F.unhex(F.md5("key")).alias("key"))
    rows, _ = materialize(rows, "bands")
    buckets = rows.groupBy("band", "key").agg(F.min("uid").alias("src"), F.count("*").alias("n")).where("n > 1").select("band", "key", "src")
    return rows.join(buckets, ["band", "key"]).where("uid <> src").select("src", F.col("uid").alias("dst")).distinct()


def minhash_clusters(docs: DataFrame, cfg: MinHashConfig = MinHashConfig()) -> DataFrame:
    """``node, component`` over the uids that share a bucket with another."""
    return connected_components(lsh_edges(minhash_signatures(docs, cfg)))


def expand_clusters(groups: DataFrame, components: DataFrame) -> DataFrame:
    """``uid, cluster`` plus the columns of ``groups``: clusters over exact representatives, back on all members.

    ``cluster`` is the cluster's smallest uid, null for a document alone.
    """
    by_rep = components.select(F.col("node").alias("exact_rep"), F.col("component").alias("found"))
    joined = groups.join(by_rep, "exact_rep", "left")
    return joined.select("uid", F.coalesce("found", F.when(F.col("group_size") > 1, F.col("exact_rep"))).alias("cluster"), "group_size", "stripped_length", F.col("found").isNotNull().alias("by_minhash"))


def cluster_ids(members: DataFrame, request_id: str, namespace: str = CLUSTER_NAMESPACE) -> DataFrame:
    """``cluster, cluster_id`` of ``(cluster, uid)``: UUIDs over the request and the sorted members, comma-joined. Members
    are a sorted stream, so that a cluster may be of any size."""
    head = F.concat(namespace_bytes(namespace), F.lit(request_id + "\0").cast("binary"))
    return listed_uuid(members.select("cluster", "uid", head.alias("head")), "cluster", "uid", "head").withColumnRenamed("uuid", "cluster_id")


#: Bits of a bitmap's row, and the bytes of bitmaps that may be sent to the tasks.
BITMAP_BITS = 32768
MAX_BITMAP_BYTES = 64 << 20


def uid_bitmaps(uids: DataFrame) -> DataFrame:
    """``bucket, bitmap`` of a set of uids: one bit each, in rows of ``BITMAP_BITS``; empty rows are not there."""
    bucket, bit = F.floor(F.col("uid") / BITMAP_BITS).alias("bucket"), F.pmod("uid", F.lit(BITMAP_BITS)).alias("bit")
    return uids.select(bucket, bit).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def bit_is_set(bitmap: Column, uid: Column) -> Column:
    bit = F.pmod(uid, F.lit(BITMAP_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte.cast("long"), bit % 8) == 1


def without_uids(docs: DataFrame, uids: DataFrame, max_bytes: int = MAX_BITMAP_BYTES) -> DataFrame | None:
    """The rows of ``docs`` whose uid is not among ``uids``, tested in the scan: the uids travel as bitmaps, no text is
    shuffled. None if the bitmaps come to more than ``max_bytes``: their number is counted before they are sent."""
    bitmaps, path = materialize(uid_bitmaps(uids), "bitmaps")
    if bitmaps.count() * (BITMAP_BITS // 8) > max_bytes:
        drop_path(docs.sparkSession, path)
        return None
    bucket = F.floor(docs["uid"] / BITMAP_BITS) == bitmaps["bucket"]
    found = docs.join(F.broadcast(bitmaps), bucket, "left")
    return found.where(F.col("bitmap").isNull() | ~bit_is_set(F.col("bitmap"), F.col("uid"))).select(*(docs[c] for c in docs.columns))


def representative_signatures(docs: DataFrame, groups: DataFrame, cfg: MinHashConfig = MinHashConfig()) -> DataFrame:
    """Signatures of one text per exact group. Copies are left out in the scan; only where their bitmaps would be too large
    to send are they hashed too, and their signatures dropped, as no text should be shuffled."""
    slim = docs.select("uid", "text")
    once = without_uids(slim, groups.where("uid <> exact_rep").select("uid"))
    if once is not None:
        return minhash_signatures(once, cfg)
    return minhash_signatures(slim, cfg).join(groups.where("uid = exact_rep").select("uid"), "uid", "left_semi")


def dedup_decisions(docs: DataFrame, request_id: str, cfg: MinHashConfig = MinHashConfig()) -> DataFrame:
    """``uid, cluster_id, representative, method``, one row per document.

    The representative of a cluster is its longest stripped text, then the smallest uid. ``method`` is ``exact``,
    ``minhash`` or ``exact_minhash``; a document alone has neither id nor method and represents itself.
    """
    groups, _ = materialize(exact_groups(docs), "exact-groups")
    components = connected_components(lsh_edges(representative_signatures(docs, groups, cfg)))
    members, _ = materialize(expand_clusters(groups, components), "cluster-members")
    return decide(members, request_id)


def exact_decisions(docs: DataFrame, request_id: str) -> DataFrame:
    """The same decisions where only equal texts count as duplicates; no MinHash."""
    none = docs.sparkSession.createDataFrame([], "node long, component long")
    members, _ = materialize(expand_clusters(exact_groups(docs), none), "cluster-members")
    return decide(members, request_id)


def decide(members: DataFrame, request_id: str) -> DataFrame:
    """Cluster ids, methods and representatives of clustered members."""
    chosen = named_clusters(members, request_id)
    return members.join(chosen, "cluster", "left").select("uid", "cluster_id", (F.col("cluster").isNull() | (F.col("uid") == F.col("best"))).alias("representative"), "method")


def named_clusters(members: DataFrame, request_id: str) -> DataFrame:
    """``cluster, best, method, cluster_id`` of the clusters."""
    grouped = members.where("cluster IS NOT NULL")
    chosen = grouped.groupBy("cluster").agg(
        F.min(F.struct((-F.col("stripped_length")).alias("l"), F.col("uid").alias("u")))["u"].alias("best"),
        F.when(~F.bool_or("by_minhash"), "exact").when(F.max("group_size") > 1, "exact_minhash").otherwise("minhash").alias("method"),
    )
    return chosen.join(cluster_ids(grouped, request_id), "cluster")


def validate_decisions(decisions: DataFrame, expected: DataFrame) -> DataFrame:
    """``code, uid, cluster_id``: one row per violation; no rows for decisions fit to publish."""
    null_id, null_uid = F.lit(None).cast("string"), F.lit(None).cast("long")
    row = lambda df, code, uid=F.col("uid"), cid=null_id: df.select(F.lit(code).alias("code"), uid.cast("long").alias("uid"), cid.alias("cluster_id"))
    alone = F.col("cluster_id").isNull()
    sizes = decisions.where(~alone).groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_if("representative").alias("reps"), F.count_distinct("method").alias("methods"))
    in_cluster = lambda cond, code: row(sizes.where(cond), code, null_uid, F.col("cluster_id"))
    found = [
        row(decisions.groupBy("uid").count().where("count > 1"), "DUPLICATE_UID"),
        row(expected.select("uid").distinct().join(decisions, "uid", "left_anti"), "MISSING_UID"),
        row(decisions.join(expected.select("uid").distinct(), "uid", "left_anti"), "UNEXPECTED_UID"),
        row(decisions.where(F.col("uid").isNull() | (F.col("uid") < 0) | F.col("representative").isNull()), "INVALID_TYPE"),
        row(decisions.where(alone & (F.col("method").isNotNull() | ~F.col("representative"))), "INVALID_SINGLETON"),
        row(decisions.where(~alone & ~F.coalesce(F.col("method").isin("exact", "minhash", "exact_minhash"), F.lit(False))), "INVALID_METHOD", cid=F.col("cluster_id")),
        in_cluster("n < 2", "CLUSTER_TOO_SMALL"),
        in_cluster("reps <> 1", "REPRESENTATIVE_COUNT"),
        in_cluster("methods > 1", "MIXED_METHODS"),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def mapping_table(docs: DataFrame) -> DataFrame:
    """``uid, file_id, file_storage_path`` of the input documents."""
    return docs.select(F.col("uid").cast("long").alias("uid"), "file_id", "file_storage_path")


def check_mapping(mapping: DataFrame, task_id: str | None = None) -> DataFrame:
    """``code, uid``: duplicate or negative uids, and blank ids or paths; of a mapping with ``schema_version`` and
    ``task_id``, as ``sources.files.read_mapping`` gives it, also another version than 1 and another task."""
    twice = mapping.groupBy("uid").count().where("count > 1").select(F.lit("DUPLICATE_UID").alias("code"), "uid")
    codes = [F.when(F.col("uid").isNull() | (F.col("uid") < 0), "INVALID_UID"), F.when(F.expr("trim(coalesce(file_id, '')) = '' OR trim(coalesce(file_storage_path, '')) = ''"), "BLANK_FIELD")]
    if "schema_version" in mapping.columns:
        codes.append(F.when(~F.col("schema_version").eqNullSafe(F.lit(1)), "SCHEMA_VERSION"))
    if task_id is not None:
        codes.append(F.when(~F.col("task_id").eqNullSafe(F.lit(task_id)), "TASK_ID"))
    return twice.unionByName(mapping.select(F.explode(F.array_compact(F.array(*codes))).alias("code"), "uid"))


def business_result(decisions: DataFrame, mapping: DataFrame, task_id: str) -> DataFrame:
    """``file_id, file_storage_path, group_id, keep``: decisions on files; a group's id is over the task and its uids."""
    grouped = decisions.where("cluster_id IS NOT NULL").select("cluster_id", "uid", namespace_bytes(task_id).alias("space"))
    groups = listed_uuid(grouped, "cluster_id", "uid", "space").withColumnRenamed("uuid", "group_id")
    return mapping.join(decisions, "uid").join(groups, "cluster_id", "left").select("file_id", "file_storage_path", "group_id", F.col("representative").alias("keep"))


def dedup_summary(result: DataFrame) -> DataFrame:
    """One row: total, unique and dropped files, and groups."""
    return result.agg(
        F.count("*").alias("total_files"), F.count_if("keep").alias("unique_files"), F.count_if(~F.col("keep")).alias("moved_duplicates"), F.count_distinct("group_id").alias("groups")
    )


def quarantine_plan(result: DataFrame, folder: str = "duplicate") -> DataFrame:
    """``file_id, source, destination, state, code`` for dropped files: by base name, first come first served."""
    dropped = result.where(~F.col("keep")).select("file_id", F.col("file_storage_path").alias("source"), F.concat(F.lit(f"{folder}/"), F.substring_index("file_storage_path", "/", -1)).alias("destination"))
    first = dropped.groupBy("destination").agg(F.min(F.struct("source", "file_id")).alias("first"))
    taken = F.struct("source", "file_id") == F.col("first")
    return dropped.join(first, "destination").select("file_id", "source", "destination", F.when(taken, "planned").otherwise("failed").alias("state"), F.when(~taken, "OUTPUT_CONFLICT").alias("code"))
