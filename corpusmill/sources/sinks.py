"""Publishing results: ordered decision lines, write-once tables with digests, run manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.storage import drop_path, path_exists, read_note, rename_path, write_note


def decision_lines(decisions: DataFrame) -> DataFrame:
    """``uid, value``: compact JSON with nulls present and no text."""
    body = F.struct("uid", F.col("cluster_id").alias("clusterId"), "representative", "method")
    return decisions.select("uid", F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def digest_columns(df: DataFrame) -> list[Column]:
    """Aggregates: rows, and two order-free digests of them."""
    mark = F.xxhash64(F.to_json(F.struct(*(F.col(_quoted(c)) for c in sorted(df.columns))), {"ignoreNullFields": "false"}))
    return [F.count("*").alias("rows"), F.coalesce(F.bit_xor(mark), F.lit(0)).alias("xor"), F.coalesce(F.sum(mark.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def table_digest(df: DataFrame) -> tuple[int, int]:
    """Rows and an order-free digest of them."""
    row = df.agg(*digest_columns(df)).head()
    return row.rows, row.xor


def publish(df: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> str:
    """``published``, or ``recovered`` if the same rows were published there before; other rows there are an error.

    The digest is joined from the tasks that write, as they write, and recorded beside the rows. They are written to a
    folder of their own and moved when all of it is there, so a broken attempt leaves nothing at ``path``. A second
    publication runs its own plan once and compares with the recorded digest; what is there already is not read. Of two
    at the same time one is moved first; the other compares with it."""
    spark, seen = df.sparkSession, Observation()
    marked = df.observe(seen, *digest_columns(df))
    digest = lambda: json.dumps({k: seen.get[k] for k in ("rows", "xor", "sum")}, sort_keys=True)
    if not path_exists(spark, path):
        staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
        try:
            write(marked, staging)
            write_note(spark, f"{staging}/{DIGEST_FILE}", digest())
            if rename_path(spark, staging, path):
                return "published"
        finally:
            if path_exists(spark, staging):
                drop_path(spark, staging)
    else:
        marked.write.format("noop").mode("overwrite").save()
    if recorded_digest(spark, path) != digest():
        raise FileExistsError(f"OUTPUT_CONFLICT: {path}")
    return "recovered"


DIGEST_FILE = "_digest.json"


def recorded_digest(spark: SparkSession, path: str) -> str | None:
    """The digest recorded at ``path``; None if rows were put there by other means."""
    note = f"{path.rstrip('/')}/{DIGEST_FILE}"
    return read_note(spark, note) if path_exists(spark, note) else None


def write_decisions(decisions: DataFrame, path: str) -> str:
    """JSON lines in uid order: part files hold consecutive ranges, each sorted. Published once."""
    lines = decision_lines(decisions).repartitionByRange("uid").sortWithinPartitions("uid").select("value")
    return publish(lines, path, lambda df, where: df.write.text(where))


def write_once(df: DataFrame, path: str) -> str:
    """Rows as Parquet, published once."""
    return publish(df, path, lambda rows, where: rows.write.parquet(where))


def append_run_manifest(spark: SparkSession, path: str, task_id: str, profile: str, counts: dict[str, int], digests: dict[str, str], processor: str = "", reasons: list[str] | None = None) -> None:
    """One row per run: schema version, task, profile, counts, digests, processor, routing reasons."""
    schema = "schema_version int, task_id string, profile string, counts map<string,long>, digests map<string,string>, processor string, reasons array<string>"
    spark.createDataFrame([(1, task_id, profile, counts, digests, processor, reasons or [])], schema).write.mode("append").parquet(path)
