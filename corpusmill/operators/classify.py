"""Text classification: token windows, chunk scores, aggregation into four tags, release checks and metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChunkConfig:
    tokens: int = 256
    overlap: int = 32
    windows: int = 16
    special_tokens: int = 2

    @property
    def budget(self) -> int:
        return self.tokens - self.special_tokens


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def window_starts(tokens: Column, cfg: ChunkConfig = ChunkConfig()) -> Column:
    """Starts of overlapping windows; a last one flush to the end is added where the steps miss it; none for no tokens."""
    n, step = F.size(tokens), cfg.budget - cfg.overlap
    last = F.greatest(n - cfg.budget, F.lit(0))
    steps = F.sequence(F.lit(0), last, F.lit(step))
    full = F.when(F.element_at(steps, -1) < last, F.array_append(steps, last)).otherwise(steps)
    return F.when(n > 0, full).otherwise(F.array().cast("array<int>"))


def sample_windows(starts: Column, limit: int = 16) -> Column:
    """At most ``limit`` of the windows at even distances, rounding half to even."""
    n = F.size(starts)
    if limit == 1:
        return F.slice(starts, 1, 1)
    picked = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.element_at(starts, F.bround(i * (n - 1) / F.lit(limit - 1)).cast("int") + 1))
    return F.when(n <= limit, starts).otherwise(picked)


def token_windows(docs: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """``doc_id, chunk_ix, start`` of the sampled windows of ``(doc_id, tokens)``."""
    return docs.select("doc_id", F.posexplode(sample_windows(window_starts(F.col("tokens"), cfg), cfg.windows)).alias("chunk_ix", "start"))


def chunk_text(docs: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """``doc_id, chunk_ix, chunk`` of ``(doc_id, tokens)``, blank chunks dropped; a narrow stage."""
    windows = docs.select("doc_id", "tokens", F.posexplode(sample_windows(window_starts(F.col("tokens"), cfg), cfg.windows)).alias("chunk_ix", "start"))
    chunk = F.array_join(F.slice("tokens", F.col("start") + 1, F.lit(cfg.budget)), " ")
    return windows.select("doc_id", "chunk_ix", chunk.alias("chunk")).where("trim(chunk) <> ''")


def validate_scores(scores: DataFrame, labels: int, rtol: float = 1e-5, atol: float = 1e-6) -> DataFrame:
    """``doc_id, chunk_ix, code`` of chunks whose scores are not a distribution over all labels."""
    bad = F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0.0, 1.0)
    facts = scores.groupBy("doc_id", "chunk_ix").agg(F.count("*").alias("n"), F.count_distinct("label").alias("names"), F.sum("score").alias("total"), F.bool_or(bad).alias("bad"))
    code = F.when((F.col("n") != labels) | (F.col("names") != labels), "SHAPE").when(F.col("bad"), "RANGE").when(F.abs(F.col("total") - 1) > atol + rtol, "SUM")
    return facts.select("doc_id", "chunk_ix", code.alias("code")).where("code IS NOT NULL")


def aggregate_scores(scores: DataFrame) -> DataFrame:
    """``doc_id, label, confidence``: the greatest mean over chunks, the first in label order among equals."""
    means = scores.groupBy("doc_id", "label_ix", "label").agg(F.avg("score").alias("confidence"))
    best = F.max(F.struct("confidence", (-F.col("label_ix")).alias("o"), "label")).alias("b")
    return means.groupBy("doc_id").agg(best).select("doc_id", F.col("b.label").alias("label"), F.col("b.confidence").alias("confidence"))


def split_label_path(label: Column) -> Column:
    """The three levels of ``a > b > c``; null unless there are exactly three, none empty."""
    levels = F.split(label, " > ", -1)
    return F.when((F.size(levels) == 3) & F.forall(levels, lambda x: x != ""), levels)


def compose_tags(top: DataFrame, end: DataFrame, release_id: str) -> DataFrame:
    """``doc_id, tags, top_triple_confidence, end_doc_confidence, release_id, error_code`` of two heads."""
    joined = top.select("doc_id", F.col("label").alias("_t"), F.col("confidence").alias("top_triple_confidence")).join(end.select("doc_id", F.col("label").alias("_e"), F.col("confidence").alias("end_doc_confidence")), "doc_id")
    levels = split_label_path(F.col("_t"))
    fits = levels.isNotNull() & (F.coalesce("_e", F.lit("")) != "") & F.col("top_triple_confidence").between(0, 1) & F.col("end_doc_confidence").between(0, 1)
    fits = F.coalesce(fits, F.lit(False))
    return joined.select("doc_id", F.when(fits, F.array_append(levels, F.col("_e"))).alias("tags"), "top_triple_confidence", "end_doc_confidence", F.lit(release_id).alias("release_id"), F.when(~fits, "INVALID_PREDICTION").alias("error_code"))


def fit_chunk_model(chunks: DataFrame, label: str, features: int = 1 << 15):
    """A fitted pipeline over ``chunk`` texts: hashed terms, inverse document frequency, logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    stages = [
        RegexTokenizer(inputCol="chunk", outputCol="_terms", pattern=r"\s+"),
        HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label, probabilityCol="_p", maxIter=20, regParam=0.01),
    ]
    model = Pipeline(stages=stages).fit(chunks)
    # the training summary holds the session, which can't be sent to tasks once it has observed a write
    model.stages[-1]._java_obj.setSummary(chunks.sparkSession._jvm.scala.Option.empty())
    return model


def score_chunks(chunks: DataFrame, model, labels: list[str]) -> DataFrame:
    """``doc_id, chunk_ix, label_ix, label, score``."""
    from pyspark.ml.functions import vector_to_array

    named = F.array(*map(F.lit, labels))
    scored = model.transform(chunks).select("doc_id", "chunk_ix", F.posexplode(vector_to_array("_p")).alias("label_ix", "score"))
    return scored.select("doc_id", "chunk_ix", "label_ix", F.get(named, F.col("label_ix")).alias("label"), "score")


def validate_label_manifest(labels: DataFrame, expected: dict[str, int], path_model: str) -> DataFrame:
    """``model, code``: wrong counts, repeated or empty labels, leaves of other than three levels."""
    facts = labels.groupBy("model").agg(F.count("*").alias("n"), F.count_distinct("label").alias("names"), F.bool_or(F.coalesce("label", F.lit("")) == "").alias("empty"), F.bool_or(split_label_path(F.col("label")).isNull()).alias("flat"))
    want = F.create_map(*(F.lit(x) for pair in expected.items() for x in pair))[F.col("model")]
    codes = F.array_compact(F.array(F.when(want.isNull(), "UNKNOWN_MODEL"), F.when(F.col("n") != want, "LABEL_COUNT"), F.when(F.col("names") != F.col("n"), "DUPLICATE_LABEL"), F.when(F.col("empty"), "EMPTY_LABEL"), F.when((F.col("model") == path_model) & F.col("flat"), "INVALID_PATH")))
    return facts.select("model", F.explode(codes).alias("code"))


def offline_metrics(predicted: DataFrame) -> DataFrame:
    """One row ``accuracy, macro_f1`` of ``(prediction, label)``; classes are all values of either column."""
    cells = predicted.groupBy("prediction", "label").agg(F.count("*").alias("n"))
    hit = F.when(F.col("prediction") == F.col("label"), F.col("n")).otherwise(0)
    by_label = cells.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("actual"), F.sum(hit).alias("tp"))
    by_prediction = cells.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("named"))
    each = by_label.join(by_prediction, "c", "full").select(F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("actual", F.lit(0)).alias("actual"), F.coalesce("named", F.lit(0)).alias("named"))
    return each.agg((F.sum("tp") / F.sum("actual")).alias("accuracy"), F.avg(2 * F.col("tp") / (F.col("actual") + F.col("named"))).alias("macro_f1"))
