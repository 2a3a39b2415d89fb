"""Quality rules: compression bands.

A text is rejected when its zstandard ratio (bytes over compressed bytes) leaves the band for its length: above it the
text repeats itself, below it the text is close to random. The ratio is taken over the whole document and over fixed
chunks, each against the band for its own length: a document goes when more than a given share of its chunks leaves
their bands, so that repetitive or random stretches inside a long document show, but one odd chunk of many does not
cost it. A last chunk shorter than half a chunk joins the one before it.

The limits are of two kinds, and a piece must keep both. Fixed ones lie well above real prose of each length (licences,
manuals and Markdown reach 2.5 at 2 KB and 3.3 at 64 KB); their lower ends depend on the alphabet: ASCII must exceed
random base64 (1.35 at most), other texts only random bytes of the upper half (1.14), as Chinese prose goes down to 1.28.
Learned ones are quantiles of the ratios of labelled good texts and their chunks, for each half octave of length, with a
margin; and of the gain, the bytes that a raw-content dictionary of labelled good texts saves: decorated or shuffled
words compress as well as prose, but prose helps little with them. ``learn_limits`` takes them from all labelled rows of
the folds it may read, as counts of values; lengths with too few of those have no learned limit. The verdict is compression alone.

Defined results: null and empty texts have no words and fail the base rule; of a text under 256 bytes only one that
compression makes longer counts as incompressible; very long texts are judged chunk by chunk in linear time; the limits
belong to their bands, so a ratio equal to one passes; repeated rows get equal verdicts; an empty table gives no rows;
labels that are null, or of no document, are left out; without labels the fixed limits decide; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import materialize, per_text


@dataclass(frozen=True)
class CompressionBands:
    level: int = 3
    #: (bytes below, lowest ratio, lowest ratio of ASCII, highest ratio); the last band is open.
    bands: tuple[tuple[float, float, float, float], ...] = (
        (256, 1.0, 1.0, 2.8),
        (512, 1.1, 1.2, 2.8),
        (1024, 1.15, 1.36, 3.0),
        (2048, 1.2, 1.38, 3.3),
        (4096, 1.2, 1.4, 3.6),
        (8192, 1.2, 1.4, 3.8),
        (16384, 1.2, 1.4, 4.0),
        (65536, 1.2, 1.4, 4.5),
        (float("inf"), 1.2, 1.4, 5.0),
    )
    chunk_bytes: int = 2048
    #: Share of chunks that may leave their bands.
    chunk_share: float = 0.2
    #: Up to this share of bytes from 0x80 on, a text or chunk counts as ASCII.
    ascii_share: float = 0.05
    min_words: int = 50


@dataclass(frozen=True)
class LearningConfig:
    #: All labelled rows are learned from but those of the fold left out.
    folds: int = 4
    held_out_fold: int = 2
    #: Share of good pieces beyond each limit, margin added to it, and pieces that a length needs for a limit of its own.
    tail: float = 0.001
    decimals: int = 4
    margin: float = 0.01
    #: Over the root of the pieces: the margin where few of them were seen, whose extremes say less.
    few_margin: float = 0.2
    min_pieces: int = 40
    dictionary_bytes: int = 112 << 10
    #: Bytes of one text that the dictionary takes.
    passage_bytes: int = 1500


@dataclass(frozen=True)
class LearnedLimits:
    """``(lowest ratio, highest ratio, lowest gain)`` by half octaves of length, and the dictionary of good texts."""

    limits: dict[int, tuple[float, float, float]]
    dictionary: bytes


SYMBOLS = b"#*$%&|<>"
LOWER_HALF = bytes(range(128))
REPORT = [
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()),
    ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("ratio", T.DoubleType()), ("chunk_ratio_min", T.DoubleType()), ("chunk_ratio_max", T.DoubleType()), ("gain", T.DoubleType()),
]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)[1].astype(np.int64)
    _, inverse, times = np.unique(pair[:-1] * len(ids) + code[2:], return_inverse=True, return_counts=True)
    again = times[inverse] > 1
    marked = np.zeros(len(words), bool)
    for j in range(3):
        marked[j : j + n] |= again
    return int(marked.sum())


def duplicate_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    count = 0
    for line in text.split(b"\n"):
        if line in seen:
            count += 1
        elif line and not line.isspace():
            seen.add(line)
    return count


def code_points(data: bytes) -> int:
    """Characters of UTF-8 data: bytes that don't continue one."""
    if data.isascii():
        return len(data)
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def chunks_of(text: bytes, chunk: int) -> list[bytes]:
    cuts = list(range(0, len(text), chunk))
    if len(cuts) > 1 and len(text) - cuts[-1] < chunk // 2:
        cuts.pop()
    return [text[a:b] for a, b in pairwise([*cuts, len(text)])]


def is_ascii(text: bytes, share: float) -> bool:
    return text.isascii() or len(text.translate(None, LOWER_HALF)) <= share * len(text)


def half_octave(size: int) -> int:
    return int(2 * math.log2(size)) if size else 0


class Gauge:
    """Ratios and gains of pieces, and whether they lie in the bands for their lengths."""

    def __init__(self, bands: CompressionBands, learned: LearnedLimits | None) -> None:
        self.bands, self.limits = bands, learned.limits if learned else {}
        make = lambda **more: zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False, **more).compress
        self.squeeze = make()
        self.aided = make(dict_data=zstandard.ZstdCompressionDict(learned.dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) if learned and len(learned.dictionary) >= 256 else self.squeeze

    def measure(self, piece: bytes) -> tuple[float, float]:
        size = len(self.squeeze(piece))
        return len(piece) / size, size / len(self.aided(piece)) if self.aided is not self.squeeze else 1.0

    def fits(self, piece: bytes, ratio: float, gain: float) -> bool:
        """The piece lies in the fixed band for its length, and in the learned one if there is one."""
        least, least_ascii, most = next(limits for below, *limits in self.bands.bands if len(piece) < below)
        low, high, helped = self.limits.get(half_octave(len(piece)), (0.0, math.inf, 0.0))
        return max(least, low) <= ratio <= min(most, high) and gain >= helped and (ratio >= least_ascii or not is_ascii(piece, self.bands.ascii_share))


def base_rule(words: list[bytes], bands: CompressionBands) -> tuple[int, bool]:
    repeats = repeated_words(words)
    return repeats, len(words) < bands.min_words or 100 * repeats > 50 * len(words)


def judge(text: bytes, gauge: Gauge) -> tuple:
    bands, words = gauge.bands, text.split()
    repeats, failed = base_rule(words, bands)
    parts = chunks_of(text, bands.chunk_bytes)
    each = [gauge.measure(p) for p in parts]
    whole = gauge.measure(text) if len(parts) > 1 else each[0] if each else (0.0, 0.0)
    outside = sum(not gauge.fits(p, *m) for p, m in zip(parts, each, strict=True))
    kept = not failed and gauge.fits(text, *whole) and outside <= bands.chunk_share * len(each)
    ratios = [r for r, _ in each]
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), code_points(b"".join(words)), n_symbols, duplicate_lines(text), repeats, failed, kept, whole[0], min(ratios, default=0.0), max(ratios, default=0.0), whole[1]


def quality_report(docs: DataFrame, bands: CompressionBands = CompressionBands(), learned: LearnedLimits | None = None) -> DataFrame:
    """One row per document with the base counts, the ratios, the gain and the verdict."""

    def make():
        gauge = Gauge(bands, learned)
        return lambda texts: list(map(list, zip(*(judge(t, gauge) for t in texts), strict=True)))

    return per_text(docs, "doc_id", "text", REPORT, make, scan=True)


def keep_text(bands: CompressionBands = CompressionBands(), learned: LearnedLimits | None = None) -> Column:
    """The verdict as a boolean function of a text column, for filters that keep all other columns."""

    @F.pandas_udf(T.BooleanType())
    def kept(texts: pd.Series) -> pd.Series:
        gauge = Gauge(bands, learned)
        return pd.Series([judge(bytes(t), gauge)[6] for t in texts], dtype=bool)

    return lambda text: kept(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))


def labelled_texts(docs: DataFrame, labels: DataFrame, cfg: LearningConfig) -> DataFrame:
    """``doc_id, text, quality`` of the rows learned from: all that have a label, one per id, not of the fold left out."""
    marked = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % cfg.folds != cfg.held_out_fold)
    once = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return texts.join(once, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))


def learn_limits(docs: DataFrame, labels: DataFrame, bands: CompressionBands = CompressionBands(), cfg: LearningConfig = LearningConfig()) -> LearnedLimits:
    """Limits by half octaves from all texts labelled good that pass the base rule. Quantiles are those of the values to
    ``decimals`` places, counted before they are ranked, so that no task holds a value per piece. The driver gets passages
    up to the dictionary's size, and two rows per half octave."""
    good = materialize(labelled_texts(docs, labels, cfg).where("quality = 1").select("doc_id", "text"), "good-texts")
    order = [F.xxhash64(F.lit("dictionary"), "doc_id"), "doc_id"]
    passages = good.where(F.octet_length("text") >= 256).orderBy(*order).limit(cfg.dictionary_bytes // cfg.passage_bytes + 1)
    rows = passages.select("doc_id", F.substring("text", 1, cfg.passage_bytes).alias("text")).collect()
    dictionary, used = b"".join(bytes(r.text) for r in rows)[-cfg.dictionary_bytes :], [r.doc_id for r in rows]
    start = LearnedLimits({}, dictionary)

    def pieces(batches):
        gauge = Gauge(bands, start)
        for batch in batches:
            found = []
            for text in (t.as_py() for t in batch.column(1)):
                if base_rule(text.split(), bands)[1]:
                    continue
                parts = chunks_of(text, bands.chunk_bytes)
                found += [(half_octave(len(p)), *gauge.measure(p)) for p in ([text, *parts] if len(parts) > 1 else parts)]
            sizes, ratios, gains = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(ratios, pa.float64()), pa.array(gains, pa.float64())], names=["size", "ratio", "gain"])

    measured = good.where(~F.col("doc_id").isin(used)).mapInArrow(pieces, "size int, ratio double, gain double")
    values = measured.select("size", F.explode(F.create_map(F.lit("ratio"), "ratio", F.lit("gain"), "gain")).alias("kind", "value")).withColumn("value", F.round("value", cfg.decimals))
    counted = values.groupBy("size", "kind", "value").agg(F.count("*").alias("n"))
    ends = counted.groupBy("size", "kind").agg(F.sum("n").alias("n"), F.percentile("value", F.array(F.lit(cfg.tail), F.lit(1 - cfg.tail)), F.col("n")).alias("ends"))
    found, limits = {(r.size, r.kind): r for r in ends.collect()}, {}
    for size in {size for size, _ in found}:
        ratio, gain = found[size, "ratio"], found[size, "gain"]
        margin = max(cfg.margin, cfg.few_margin / math.sqrt(ratio.n))
        if ratio.n >= cfg.min_pieces:
            limits[size] = (ratio.ends[0] * (1 - margin), ratio.ends[1] * (1 + margin), gain.ends[0] * (1 - margin))
    return LearnedLimits(limits, dictionary)
