"""Secret scans: incremental blob ledger. DataFrame functions only.

Every historical version of every path is content-addressed: its blob id is the SHA-256 of its text. The ledger holds
the pairs (blob, rule version) already scanned and what was found. A run finds the pairs not in the ledger, reads each
blob's text from one of its paths, scans it with the rules it lacks, appends to the ledger, and joins the findings back
to all paths. Texts travel once, keyed by path and blob, so a blob with a third of all paths is one row there.

Positions come from ``split`` and ``regexp_extract_all``: a match ends after all gaps and matches up to it.

Ledger layout, below one folder: ``scanned/`` (blob, rule_key) and ``findings/`` (blob, spans), both append-only Parquet.

Defined results: null and empty texts are one blob without findings; very long texts are scanned whole, in time linear
in their length and matches; spans of equal start are in rule order; repeated rows get equal results; null paths are
paths like any other; an empty table gives no rows and appends nothing; extra columns, whatever their names, are
ignored. A run that dies between the two appends leaves findings without their pairs: the next run scans these blobs
again, and equal findings count once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrays import let
from corpusmill.functions.regex_spans import positioned

from .support import materialize, path_exists


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; those whose ``group`` is shorter than ``least`` are dropped.
    ``hint`` is a pattern that every text with a surviving match contains."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


KEYWORDS = "password|passwd|secret|token|api_?key"
BASE_RULES = (
    Rule("assign", 1, rf"""(?i:({KEYWORDS}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, rf"""(?i:{KEYWORDS})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{{12}}"""),
    Rule("access", 1, r"(AKIA[A-Z0-9]+)", 1, 18, r"AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, r"([0-9a-f]+)", 1, 16, r"[0-9a-f]{16}"),
)
#: The method's own rules: public formats with fixed prefixes.
PREFIX_RULES = (
    Rule("privkey", 1, r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", 1, r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, 40, r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", 1, r"(xox[abprs]-[A-Za-z0-9-]{10,})", 1, 15, r"xox[abprs]-[A-Za-z0-9-]{10}"),
    Rule("jwt", 1, r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 30, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ"),
)
RULES = BASE_RULES + PREFIX_RULES
SALTS = 32
SPAN = "struct<rule_key:string,start:int,end:int>"


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256))


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of ``(rule_key, start, end)`` in code points."""
    part = lambda group: F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(group))
    pairs = F.arrays_zip(positioned(part(1), text, rule.pattern).alias("m"), part(rule.group + 1).alias("v"))
    kept = F.filter(pairs, lambda x: F.char_length(x["v"]) >= rule.least)
    found = F.transform(kept, lambda x: F.struct(F.lit(rule.key).alias("rule_key"), x["m"]["start"].alias("start"), x["m"]["end"].alias("end")).cast(SPAN))
    return F.when(text.rlike(rule.hint), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan_increment(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, path_col: str = "doc_id") -> DataFrame:
    """Scan what the ledger at ``ledger`` lacks of ``versions(path_col, text)``; return one row per version:
    ``path_col, blob, spans`` with the spans ordered by start, then rule order."""
    spark = versions.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    addressed = versions.select(F.col(path_col).alias("path"), blob_id(F.col("text")).alias("blob"))
    # one path per blob; nulls last, so that a path is null only where all are
    holders = addressed.groupBy("blob").agg(F.min("path").alias("path"))
    pairs = holders.withColumn("rule_key", F.explode(F.array(*(F.lit(r.key) for r in rules))))
    if not path_exists(spark, f"{ledger}/scanned"):
        todo = holders.withColumn("rules", F.array(*(F.lit(r.key) for r in rules)))
    else:
        known = spark.read.schema("blob binary, rule_key string").parquet(f"{ledger}/scanned")
        fresh = pairs.join(known, ["blob", "rule_key"], "left_anti")
        todo = fresh.groupBy("blob", "path").agg(F.collect_set("rule_key").alias("rules"))
    todo = materialize(todo, "pending-blobs")
    texts = versions.select(F.col(path_col).alias("path"), blob_id(F.col("text")).alias("blob"), text.alias("text"))
    on = texts["path"].eqNullSafe(todo["path"]) & (texts["blob"] == todo["blob"])
    pending = texts.join(todo, on).select(todo["blob"], "rules", "text")
    scanned = pending.select("blob", F.flatten(F.array(*(F.when(F.array_contains("rules", r.key), spans_of(F.col("text"), r)).otherwise(F.array().cast(f"array<{SPAN}>")) for r in rules))).alias("spans"))
    scanned.where(F.size("spans") > 0).dropDuplicates(["blob"]).write.mode("append").parquet(f"{ledger}/findings")
    todo.select("blob", F.explode("rules").alias("rule_key")).write.mode("append").parquet(f"{ledger}/scanned")
    return findings_by_path(addressed, ledger, rules, path_col)


def findings_by_path(addressed: DataFrame, ledger: str, rules: Sequence[Rule], path_col: str) -> DataFrame:
    """Ledger findings of the given rules, joined to every ``(path, blob)``."""
    keys = F.array(*(F.lit(r.key) for r in rules))
    found = addressed.sparkSession.read.schema(f"blob binary, spans array<{SPAN}>").parquet(f"{ledger}/findings").select("blob", F.explode("spans").alias("s"))
    ranked = found.select("blob", "s.*", F.array_position(keys, F.col("s.rule_key")).alias("rank")).where("rank > 0")
    ordered = ranked.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", "rank", "end", F.substring_index("rule_key", "@", 1).alias("kind")))).alias("spans"))
    shown = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    # one blob may stand at a third of all paths: its paths are dealt over salts, its one row of findings is copied to each
    salted = addressed.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    copies = ordered.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # merged, never broadcast: Spark takes the copies for as small as the findings they are made of
    return salted.join(copies.hint("merge"), ["blob", "salt"], "left").select(F.col("path").alias(path_col), "blob", F.coalesce(shown, F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("spans"))


def digest_columns(found: DataFrame, path_col: str = "doc_id") -> DataFrame:
    """Counts, base digest and span list as the query reports them."""
    base = [r.kind for r in BASE_RULES]
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(path_col, *map(count, base), F.sha2(show(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"))


def redact_expr(text: Column, spans: Column) -> Column:
    """The text with each span replaced by ``[SECRET]``; overlapping spans go as one."""
    joined = F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<gap:int,start:int>>").alias("cuts")), _cut)

    def rebuild(done):
        pieces = F.transform(done["cuts"], lambda c: F.concat(F.substring(text, c["gap"] + 1, c["start"] - c["gap"]), F.lit("[SECRET]")))
        return F.concat(F.array_join(pieces, ""), F.substring(text, done["end"] + 1, F.char_length(text)))

    return let(joined, rebuild)


def _cut(acc: Column, s: Column) -> Column:
    """Adds the gap before a span that begins at or after the end of those before it."""
    one = F.struct(acc["end"].alias("gap"), s["start"].alias("start")).cast("struct<gap:int,start:int>")
    cuts = F.when(s["start"] >= acc["end"], F.array_append(acc["cuts"], one)).otherwise(acc["cuts"])
    return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), cuts.alias("cuts"))


# DuckDB: the same positions from its own split and extract functions; the method's prefix rules are fixed in length
# or run to the end of their class, so they read the same in both dialects.
def _oracle_kind(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank,
      list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(hits, 1, i - 1), lambda x: length(x))), 0) AS a, length(hits[i]) AS n, length(vals[i]) AS v, {least} AS least
      FROM (SELECT doc_id, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT doc_id, regexp_split_to_array(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}') AS hits, regexp_extract_all(t, '{quoted}', {group}) AS vals FROM texts
        WHERE regexp_matches(t, '{quoted}')))"""


def oracle_sql() -> str:
    parts = []
    for i, r in enumerate(RULES):
        pattern = r.pattern if r.kind != "hex" else "([0-9a-f]{16,})"  # the same runs; shorter ones would be dropped
        parts.append(_oracle_kind(r.kind, i, pattern, r.group, r.least))
    union = "\nUNION ALL\n".join(parts)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, kind, rank, CAST(a AS BIGINT) AS a, CAST(a + n AS BIGINT) AS b FROM ({union}) WHERE v >= least)
SELECT t.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank), '') AS spans
FROM texts t LEFT JOIN found f ON t.doc_id = f.doc_id GROUP BY t.doc_id
"""
