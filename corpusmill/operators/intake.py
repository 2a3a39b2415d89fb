"""Intake: the first request of a key wins; equal ones are replays, others conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import request_fingerprint


def with_fingerprint(requests: DataFrame, columns: list[str]) -> DataFrame:
    return requests.withColumn("fingerprint", request_fingerprint({c: F.col(c) for c in columns}))


def resolve_intake(requests: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``decision``: ``accepted``, ``replay`` or ``conflict``. First requests come from a partial aggregate, so a
    key with very many requests isn't gathered in one task to be ordered."""
    first = requests.groupBy(*keys).agg(F.min(F.struct(*order, "fingerprint")).alias("first")).alias("f")
    col = lambda side, c: F.col(f"{side}.`{c}`")
    same = F.lit(True)
    for k in keys:
        same = same & col("r", k).eqNullSafe(col("f", k))
    own = F.struct(*(col("r", c) for c in (*order, "fingerprint")))
    decision = F.when(own == F.col("f.first"), "accepted").when(col("r", "fingerprint") == F.col("f.first.fingerprint"), "replay").otherwise("conflict")
    return requests.alias("r").join(first, same).select(*(col("r", c) for c in requests.columns if c != "decision"), decision.alias("decision"))
