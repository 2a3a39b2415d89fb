"""Global positions without one global window, and small scans on all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize


def with_positions(df: DataFrame, order: list[str], name: str = "uid") -> DataFrame:
    """Add the 0-based position in the order of ``order`` (nulls first).

    Rows are range-partitioned and written once; block counts (one row per block) give each block's offset, and the
    generated sequence, which has no gaps within a block, does the rest. Ties take consecutive positions. Columns may have
    any names.
    """
    blocks = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    row = F.struct(*(ranged["`" + c.replace("`", "``") + "`"] for c in df.columns))
    written, _ = materialize(ranged.select(row.alias("row"), F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("seq")), "positions")
    counts = written.groupBy("block").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    offsets = counts.select("block", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return written.join(F.broadcast(offsets), "block").select("row.*", (F.col("ahead") + F.col("seq") - F.col("first")).alias(name))


#: Bytes that one core reads in about the time that dealing them out costs.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table is dealt out to all cores, whatever its files and row groups; a larger one stays as it is, so that no
    text of a large table is shuffled. The plan's own estimate of its bytes decides; nothing runs for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if estimate < cores * SPREAD_BYTES else df
