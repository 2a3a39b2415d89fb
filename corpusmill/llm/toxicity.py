"""Toxicity: character n-gram linear classifier over naive-Bayes log-count ratios.

Features are the character n-grams inside words (each word with one blank on both sides, lower case), hashed into
``buckets``. Presence of a bucket counts once per text and is scaled by its naive-Bayes log-count ratio
``log((pos+1)/(P+2)) - log((neg+1)/(N+2))``; logistic regression with an L2 penalty is fitted over the ``keep``
buckets whose ratio is best supported.

Training reads a bounded sample of whole texts: at most ``max_train_rows`` labelled rows, the smallest by a hash of the
id. Buckets are counted where the texts are read and summed by bucket; only the chosen buckets of a text travel on, so
the task that fits holds at most ``max_train_rows * keep`` small integers, however long the texts are. Scoring reads
every text.

Defined results: null and empty texts get the score of the intercept alone; very long texts count each bucket once;
repeated rows get equal scores; an empty table gives no rows; when no row can be learnt from, every score is the
smoothed base rate; labels whose ``toxic`` is null are not learnt from; of texts that share an id the least is learnt
from, once, as toxic if any of its labels is; among equally supported buckets the least numbers are kept; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import decode, materialize, per_text


@dataclass(frozen=True)
class ToxicityConfig:
    orders: tuple[int, ...] = (5, 6, 7)
    buckets: int = 1 << 18
    keep: int = 3000
    min_docs: int = 3
    penalty: float = 10.0
    rounds: int = 150
    max_train_rows: int = 12_000
    threshold: float = 0.3


def ngram_buckets(text: str, cfg: ToxicityConfig) -> np.ndarray:
    """Hashed n-grams of the padded words, with repeats."""
    points = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    blanks = np.concatenate(([0], np.cumsum(points == 32)))
    found = [np.zeros(0, np.int64)]
    for n in cfg.orders:
        width = len(points) - n + 1
        if width < 1:
            continue
        inside = blanks[n - 1 : n - 1 + width] == blanks[1 : 1 + width]  # no blank strictly inside
        h = np.full(width, n, np.uint64)
        for j in range(n):
            h = (h + points[j : j + width]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        found.append((h[inside] % np.uint64(cfg.buckets)).astype(np.int64))
    return np.concatenate(found)


def fit_coefficients(rows: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray, intercept: float, cfg: ToxicityConfig) -> np.ndarray:
    """Logistic regression over the chosen features (``rows``: their numbers per text); the intercept comes last."""
    n, width = len(rows), len(ratio)
    cols, at = np.concatenate([np.zeros(0, np.int64), *rows]), np.repeat(np.arange(n), [len(r) for r in rows])
    value, y = ratio[cols], toxic.astype(float)
    coef, moment, spread = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    coef[-1] = intercept
    for step in range(1, cfg.rounds + 1):  # Adam on the full sample
        z = np.bincount(at, value * coef[cols], n) + coef[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        slope = np.append(np.bincount(cols, value * error[at], width) + cfg.penalty * coef[:-1], error.sum()) / n
        moment = 0.9 * moment + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope**2
        coef -= 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return coef


def training_rows(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``max_train_rows`` ids, written once."""
    sample = (
        labels.select("doc_id", "toxic")
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(cfg.max_train_rows)
    )
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    # one text per id, so that repeated ids can't swell the sample
    return materialize(texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "toxicity-sample")


def chosen_buckets(rows: DataFrame, total: int, toxic: int, cfg: ToxicityConfig) -> DataFrame:
    """``bucket, ratio`` of the ``keep`` best supported buckets: counted in the tasks that read the texts, then summed."""

    def count(batches):
        seen, bad = np.zeros(cfg.buckets, np.int64), np.zeros(cfg.buckets, np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.unique(ngram_buckets(decode(text or b""), cfg))
                seen[found] += 1
                bad[found] += bool(label)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at]), pa.array(bad[at])], names=["bucket", "seen", "bad"])

    counts = rows.select("text", "toxic").mapInArrow(count, "bucket int, seen long, bad long").groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    ratio = F.log((F.col("bad") + 1) / (toxic + 2)) - F.log((F.col("seen") - F.col("bad") + 1) / (total - toxic + 2))
    support = F.abs(ratio) * F.sqrt(F.least(F.col("seen"), total - F.col("seen")).cast("double"))
    known = counts.where(F.col("seen") >= cfg.min_docs).select("bucket", ratio.alias("ratio"), F.round(support, 9).alias("support")).where("support > 0")
    return known.orderBy(F.desc("support"), "bucket").limit(cfg.keep).select("bucket", "ratio")


def train(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> tuple[np.ndarray, float]:
    """Weights per bucket (ratio times learnt coefficient) and the intercept, from ``labels(doc_id, toxic)``."""
    rows = training_rows(docs, labels, cfg)
    weights, facts = np.zeros(cfg.buckets, np.float32), rows.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") != 0).alias("bad")).head()
    if not facts.n:
        return weights, 0.0
    intercept = float(np.log((facts.bad + 1) / (facts.n - facts.bad + 1)))
    chosen = sorted(chosen_buckets(rows, facts.n, facts.bad, cfg).collect()) if 0 < facts.bad < facts.n else []  # at most cfg.keep
    if not chosen:
        return weights, intercept
    buckets, ratio = np.array([r.bucket for r in chosen]), np.array([r.ratio for r in chosen])

    def pick(batches):
        for batch in batches:
            found = [np.flatnonzero(np.isin(buckets, ngram_buckets(decode(t or b""), cfg))).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), batch.column(2)], names=["doc_id", "features", "toxic"])

    def fit(batches):
        names = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.int32())), ("toxic", pa.int32())])
        table = pa.Table.from_batches(list(batches), schema=names).sort_by("doc_id")
        coef = fit_coefficients([np.asarray(f, np.int64) for f in table["features"].to_pylist()], table["toxic"].to_numpy() != 0, ratio, intercept, cfg)
        yield pa.RecordBatch.from_arrays([pa.array([coef.tolist()], pa.list_(pa.float64()))], names=["coef"])

    picked = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic").mapInArrow(pick, "doc_id long, features array<int>, toxic int")
    coef = np.array(picked.repartition(1).mapInArrow(fit, "coef array<double>").head().coef)
    weights[buckets] = ratio * coef[:-1]
    return weights, float(coef[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, float], cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text. The broadcast model has ``cfg.buckets`` floats."""
    shared = docs.sparkSession.sparkContext.broadcast((np.asarray(model[0], np.float64), model[1]))

    def make():
        weights, intercept = shared.value

        def one(raw: bytes) -> float:
            z = intercept + float(weights[np.unique(ngram_buckets(decode(raw), cfg))].sum())
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        def work(texts: list[bytes]) -> list[list]:
            scores = [one(t) for t in texts]
            return [scores, [int(s >= cfg.threshold) for s in scores]]

        return work

    return per_text(docs, "doc_id", "text", [("score", T.DoubleType()), ("predicted", T.IntegerType())], make, scan=True)


def toxicity(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """Train on the rows outside the held-out fold, score all rows."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = train(docs, labels.where(~held), cfg)
    return score(docs, model, cfg).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
