"""Language ID: compression classification.

Each language has a zstandard raw-content dictionary: its most frequent normalised words of a bounded training sample,
the commonest last (nearest to the data). The whole normalised text (lower case, letters and the marks on them) is cut into chunks and
encoded once per language; the language with the fewest bytes wins. ``accepted`` is false when the runner-up is within
``min_margin`` of it.

The training sample takes about ``max_rows_per_lang`` rows per language, drawn by a hash of the id, each with its whole
text, and of each language at most ``dict_bytes`` of words are kept; words are counted on the executors, so the model
has ``dict_bytes`` for each language. More than ``max_langs`` languages are an error, not a loss.

Defined results: null texts and texts without a letter get ``und`` and score 0 (figures, fractions and Roman numeral
signs are no letters); equal sizes go to the language first in alphabetical order and are not accepted; very long texts
are encoded whole, chunk by chunk; repeated rows get equal results; rows of equal id are drawn or left out together; an
empty table, or one without a known language, gives ``und`` for every row; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import decode, materialize, per_text

UNKNOWN = "und"
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")


@dataclass(frozen=True)
class LanguageConfig:
    level: int = 7
    chunk_bytes: int = 1024
    dict_bytes: int = 1 << 16
    max_rows_per_lang: int = 1000
    max_langs: int = 1000
    min_margin: float = 0.01


def normalise(text: str) -> str:
    """Words of letters with their marks, lower case, single blanks between."""
    return " ".join(WORD.findall(text.lower()))


def train_dictionaries(docs: DataFrame, cfg: LanguageConfig = LanguageConfig()) -> dict[str, bytes]:
    """Dictionary per value of ``lang``, from ``docs(doc_id, text, lang)``."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    sizes = materialize(known.groupBy("lang").count(), "language-sizes")
    if sizes.count() > cfg.max_langs:
        raise ValueError(f"more than {cfg.max_langs} languages")
    # a hash threshold per language admits about max_rows_per_lang of its rows, so nothing is sorted or gathered
    share = F.least(F.lit(1.0), cfg.max_rows_per_lang / F.col("count"))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(sizes), "lang").where(drawn)
    words = per_text(sample.select(F.struct("doc_id", "lang").alias("key"), "text"), "key", "text", [("norm", T.StringType())], lambda: lambda texts: [[normalise(decode(t)) for t in texts]])
    counts = words.select("key.lang", F.explode(F.split("norm", " ")).alias("word")).where("word <> ''").groupBy("lang", "word").count()
    rank = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    sized = counts.withColumn("used", F.sum(F.octet_length("word") + 1).over(rank.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= cfg.dict_bytes)
    rows = sized.groupBy("lang").agg(F.array_join(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("used", "word"))), lambda s: s["word"])), " ").alias("content")).collect()
    return {r.lang: f" {r.content} ".encode() for r in sorted(rows, key=lambda r: r.lang)}


def coders(dictionaries: dict[str, bytes], level: int) -> list:
    """``(language, encoder)`` in alphabetical order."""
    out = []
    for lang, content in sorted(dictionaries.items()):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress))
    return out


def predict(docs: DataFrame, dictionaries: dict[str, bytes], cfg: LanguageConfig = LanguageConfig()) -> DataFrame:
    """``doc_id, lang_pred, score, accepted``; score is 1 - best / runner-up, stretched to 0..1."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def make():
        known = coders(shared.value, cfg.level)

        def one(raw: bytes) -> tuple[str, float, bool]:
            text = normalise(decode(raw))
            if not text or not known:
                return UNKNOWN, 0.0, False
            data = f" {text} ".encode()
            chunks = [data[i : i + cfg.chunk_bytes] for i in range(0, len(data), cfg.chunk_bytes)]
            sizes = sorted((sum(len(squeeze(c)) for c in chunks), i) for i, (_, squeeze) in enumerate(known))
            margin = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
            return known[sizes[0][1]][0], min(1.0, 0.5 + 2 * margin), margin >= cfg.min_margin

        return lambda texts: list(map(list, zip(*map(one, texts), strict=True)))

    return per_text(docs, "doc_id", "text", [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("accepted", T.BooleanType())], make, scan=True)


def language_id(docs: DataFrame, cfg: LanguageConfig = LanguageConfig()) -> DataFrame:
    """Learn from the rows outside the held-out fold, predict all rows."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    dictionaries = train_dictionaries(docs.where(~held).select("doc_id", "text", "lang"), cfg)
    return predict(docs, dictionaries, cfg).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
