"""Benchmark decontamination: distributed positional inverted index.

1. Corpus frequencies of the benchmark's terms are counted over all documents.
2. Each benchmark window gets its terms ranked from the rarest; the rarest is its anchor.
3. The index stores postings ``(row_id, pos, term)`` of training tokens: those of benchmark terms within reach of an
   anchor occurrence (no other posting can take part in an occurrence). It is written once to the shared folder.
4. Lists are intersected from the rarest term on: anchor postings give candidate starts ``pos - offset``; these meet
   the second rarest term's postings at ``start + offset``, and the survivors all remaining terms'. A start at which
   every term stands is an exact phrase occurrence. Proximity search relaxes the offsets to a gap.

Rows are keyed by a ``row_id`` fixed in the written index, so repeated or null ids need no care, and every later
shuffle is by ``(row_id, pos)``: a passage shared by a third of all documents spreads over all tasks.

Defined results: null and empty texts have no words and are not contaminated; very long texts are read whole; repeated
rows get equal results; of terms equally rare the least number anchors; items without words are ignored, items of equal
id count once, a null item_id counts as the empty string; an empty table gives no rows, an empty benchmark marks
nothing; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import materialize, per_text


@dataclass(frozen=True)
class IndexConfig:
    window: int = 10
    #: Benchmark terms sent to the tasks that read the corpus; beyond it, terms are matched by a join instead.
    max_broadcast_terms: int = 1_000_000


#: A-Z to a-z; bytes outside words to a blank. Bytes from 0x80 on belong to words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def word_column(text: str):
    """The same words by DataFrame functions, for the benchmark side."""
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(folded, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


def benchmark_windows(benchmark: DataFrame, cfg: IndexConfig = IndexConfig()) -> DataFrame:
    """``item_id`` (string), ``terms``: each distinct window once per item; a short item is one window."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), word_column("text").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (cfg.window - 1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, cfg.window))).alias("terms")).distinct()


def corpus_frequencies(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``term_no, freq`` over all documents, counted in the tasks that read them and then summed."""
    shared = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)})

    def run(batches):
        known, counts = shared.value, [0] * len(shared.value)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for no in map(known.get, words_of(text)):
                    if no is not None:
                        counts[no] += 1
        hits = [i for i, c in enumerate(counts) if c]
        yield pa.RecordBatch.from_arrays([pa.array(hits, pa.int32()), pa.array([counts[i] for i in hits], pa.int64())], names=["term_no", "freq"])

    text = docs.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("t"))
    return text.mapInArrow(run, "term_no int, freq long").groupBy("term_no").agg(F.sum("freq").alias("freq"))


def build_index(docs: DataFrame, terms: list[str], anchors: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """The written index, one row per document: ``row_id, doc_id, n_words, positions, term_nos`` (ascending positions).

    ``anchors`` maps a term number to how far before and after it other postings matter; None stores every posting of
    the given terms.
    """
    shared = docs.sparkSession.sparkContext.broadcast(({t.encode(): i for i, t in enumerate(terms)}, anchors))

    def make():
        known, near = shared.value

        def one(text: bytes):
            words = words_of(text)
            numbers = list(map(known.get, words))
            if near is None:
                at = [p for p, n in enumerate(numbers) if n is not None]
            else:
                wanted = bytearray(len(words))  # a later anchor may reach back before an earlier one's range
                for p, n in enumerate(numbers):
                    if n is not None and (reach := near.get(n)):
                        lo, hi = max(0, p - reach[0]), min(len(words), p + reach[1] + 1)
                        wanted[lo:hi] = b"\x01" * (hi - lo)
                at = [p for p, n in enumerate(numbers) if n is not None and wanted[p]]
            return len(words), at, [numbers[p] for p in at]

        return lambda texts: list(map(list, zip(*map(one, texts), strict=True)))

    keyed = docs.select(F.struct(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id")).alias("key"), "text")
    fields = [("n_words", T.LongType()), ("positions", T.ArrayType(T.IntegerType())), ("term_nos", T.ArrayType(T.IntegerType()))]
    return materialize(per_text(keyed, "key", "text", fields, make).select("key.*", "n_words", "positions", "term_nos"), "positional-index")


def postings(index: DataFrame) -> DataFrame:
    return index.where(F.size("positions") > 0).select("row_id", F.inline(F.arrays_zip(F.col("positions").alias("pos"), F.col("term_nos").alias("term_no"))))


def full_index(docs: DataFrame, distinct_terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Index, postings and numbered terms when the terms are too many to send to every task: all words are stored,
    then matched to the terms by a join."""
    keyed = docs.select(F.struct(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id")).alias("key"), "text")
    fields = [("words", T.ArrayType(T.BinaryType()))]
    index = materialize(per_text(keyed, "key", "text", fields, lambda: lambda texts: [list(map(words_of, texts))]).select("key.*", F.size("words").cast("long").alias("n_words"), "words"), "positional-index")
    numbered = materialize(distinct_terms.select(F.monotonically_increasing_id().alias("term_no"), "term"), "benchmark-terms")
    tokens = index.select("row_id", F.posexplode("words").alias("pos", "word")).withColumn("term", F.col("word").cast("string"))
    return index, materialize(tokens.join(numbered, "term").select("row_id", "pos", "term_no"), "postings"), numbered


def phrase_occurrences(posting: DataFrame, ranked: DataFrame) -> DataFrame:
    """``row_id, start, window_no``: where every term of a window stands at its offset.

    ``ranked``: ``window_no, n_terms, by_rarity`` with ``by_rarity`` an array of ``(term_no, offset)``, rarest first.
    """
    first = ranked.select("window_no", "n_terms", "by_rarity", F.get("by_rarity", F.lit(0)).alias("a"))
    starts = posting.join(first, F.col("term_no") == F.col("a.term_no")).select("row_id", (F.col("pos") - F.col("a.offset")).alias("start"), "window_no", "n_terms", "by_rarity").where("start >= 0")
    single = starts.where("n_terms = 1").select("row_id", "start", "window_no")
    second = starts.where("n_terms > 1").select("*", F.get("by_rarity", F.lit(1)).alias("b"), (F.col("start") + F.get("by_rarity", F.lit(1))["offset"]).alias("pos"))
    pair = second.join(posting.withColumnRenamed("term_no", "found"), ["row_id", "pos"]).where("found = b.term_no").select("row_id", "start", "window_no", "n_terms", "by_rarity")
    rest = pair.where("n_terms > 2").select("row_id", "start", "window_no", "n_terms", F.inline(F.expr("slice(by_rarity, 3, n_terms - 2)")))
    checked = (
        rest.withColumn("pos", F.col("start") + F.col("offset"))
        .join(posting.withColumnRenamed("term_no", "found"), ["row_id", "pos"])
        .where("found = term_no")
        .groupBy("row_id", "start", "window_no").agg(F.count("*").alias("n"), F.first("n_terms").alias("n_terms"))
        .where("n = n_terms - 2")
        .select("row_id", "start", "window_no")
    )
    return single.unionByName(pair.where("n_terms = 2").select("row_id", "start", "window_no")).unionByName(checked)


def proximity_matches(index: DataFrame, terms: list[int], max_gap: int) -> DataFrame:
    """``row_id, start, end``: positions of the first and last term where the terms stand in order with at most
    ``max_gap`` other words between neighbours. ``index`` must hold every posting of the terms."""
    posting = postings(index)
    found = posting.where(F.col("term_no") == terms[0]).select("row_id", F.col("pos").alias("start"), F.col("pos").alias("end"))
    for term in terms[1:]:
        nxt = posting.where(F.col("term_no") == term).select("row_id", F.col("pos").alias("next"))
        steps = found.select("row_id", "start", F.explode(F.sequence(F.col("end") + 1, F.col("end") + 1 + max_gap)).alias("next"))
        found = steps.join(nxt, ["row_id", "next"]).select("row_id", "start", F.col("next").alias("end")).distinct()
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, cfg: IndexConfig = IndexConfig()) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per document."""
    windows = materialize(benchmark_windows(benchmark, cfg), "benchmark-windows")
    distinct_terms = windows.select(F.explode("terms").alias("term")).distinct()
    small = distinct_terms.count() <= cfg.max_broadcast_terms
    if small:
        terms = [r.term for r in distinct_terms.orderBy("term").collect()]  # at most max_broadcast_terms
        numbered = docs.sparkSession.createDataFrame(list(enumerate(terms)), "term_no int, term string")
        counts = corpus_frequencies(docs, terms)
    else:
        index, posting, numbered = full_index(docs, distinct_terms)
        counts = posting.groupBy("term_no").agg(F.count("*").alias("freq"))
    freq = numbered.join(counts, "term_no", "left").select("term_no", "term", F.coalesce("freq", F.lit(0)).alias("freq"))
    per_window = (
        windows.select(F.xxhash64("terms").alias("h"), "terms").groupBy("terms").agg(F.first("h").alias("h"))
        .select("terms", F.posexplode("terms").alias("offset", "term"))
        .join(freq, "term")
        .groupBy("terms").agg(F.array_sort(F.collect_list(F.struct("freq", "term_no", "offset"))).alias("r"))
        .where(F.get("r", F.lit(0))["freq"] > 0)
    )
    ranked = materialize(
        per_window.select(F.monotonically_increasing_id().alias("window_no"), "terms", F.size("r").alias("n_terms"), F.transform("r", lambda x: F.struct(x["term_no"].alias("term_no"), x["offset"].alias("offset"))).alias("by_rarity")),
        "ranked-windows",
    )
    if small:
        reach = ranked.select(F.get("by_rarity", F.lit(0)).alias("a"), "n_terms").groupBy("a.term_no").agg(F.max("a.offset").alias("back"), F.max(F.col("n_terms") - 1 - F.col("a.offset")).alias("ahead"))
        anchors = {r.term_no: (r.back, r.ahead) for r in reach.collect()}  # no more than the terms
        index = build_index(docs, terms, anchors)
        posting = postings(index)
    hits = materialize(phrase_occurrences(posting, ranked.select("window_no", "n_terms", "by_rarity")), "phrase-hits")
    lengths = ranked.select("window_no", "n_terms")
    covered = hits.join(lengths, "window_no").select("row_id", F.explode(F.expr("sequence(start, start + n_terms - 1)")).alias("pos")).distinct().groupBy("row_id").agg(F.count("*").alias("n_hit"))
    owners = windows.join(ranked.select("window_no", "terms"), "terms").select("window_no", "item_id")
    items = hits.select("row_id", "window_no").distinct().join(owners, "window_no").select("row_id", "item_id").distinct().groupBy("row_id").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    return (
        index.select("row_id", "doc_id", "n_words")
        .join(covered, "row_id", "left")
        .join(items, "row_id", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


ORACLE = r"""
WITH item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS terms FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM item_words WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT len(terms) AS n FROM windows),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), grams AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS terms FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, lengths WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (terms)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS joined FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
