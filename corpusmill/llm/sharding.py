"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets. DataFrame functions only.

Rows are range-partitioned by ``doc_id`` (ties: checksum, size) into blocks and written once to the shared folder, so
that block membership and order stay fixed whatever is recomputed. A block's total is summed per block; the prefix over
blocks runs over one row per block. Within a block a window adds the running sum. Row ``r`` whose bytes span
``[p, p + size)`` of ``total`` goes to shard ``floor((2p + size) * shards / 2 total)``: shards are contiguous in doc_id
order and differ from an equal share by less than one document at either end. No text is shuffled.

Defined results: null texts have size 16 and checksum 0 (that of the empty text); null ids come first; rows equal in
id, checksum and size are interchangeable and get consecutive slots; a document larger than a shard's share leaves
shards after it empty; of a very long text only length and checksum are kept; an empty table gives no rows; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import materialize


@dataclass(frozen=True)
class ShardingConfig:
    shards: int = 40
    row_overhead: int = 16
    #: Blocks per shuffle partition of the session; more blocks make each window smaller.
    blocks_per_partition: int = 4
    min_blocks: int = 64


def block_count(docs: DataFrame, cfg: ShardingConfig) -> int:
    return max(cfg.min_blocks, cfg.blocks_per_partition * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def prefix_sums(docs: DataFrame, cfg: ShardingConfig = ShardingConfig()) -> DataFrame:
    """``doc_id, size, text_crc32`` with ``bytes_before``, ``rows_before`` and the grand ``total``."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    slim = docs.select("doc_id", (F.octet_length(text) + cfg.row_overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    ranged = slim.repartitionByRange(block_count(docs, cfg), *order).sortWithinPartitions(*order)
    blocks = materialize(ranged.select("*", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("seq")), "shard-blocks")
    totals = blocks.groupBy("block").agg(F.sum("size").alias("block_bytes"), F.count("*").alias("block_rows"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over one row per block
    offsets = totals.select(
        "block",
        F.coalesce(F.sum("block_bytes").over(before), F.lit(0)).alias("bytes_ahead"),
        F.coalesce(F.sum("block_rows").over(before), F.lit(0)).alias("rows_ahead"),
        F.sum("block_bytes").over(Window.partitionBy()).alias("total"),
    )
    run = Window.partitionBy("block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    inside = blocks.select("*", (F.sum("size").over(run) - F.col("size")).alias("bytes_in"), (F.row_number().over(Window.partitionBy("block").orderBy("seq")) - 1).alias("rows_in"))
    return inside.join(F.broadcast(offsets), "block").select(
        "doc_id", "size", "text_crc32", "total", (F.col("bytes_ahead") + F.col("bytes_in")).alias("bytes_before"), (F.col("rows_ahead") + F.col("rows_in")).alias("rows_before")
    )


def balanced_shards(docs: DataFrame, cfg: ShardingConfig = ShardingConfig()) -> DataFrame:
    placed = prefix_sums(docs, cfg).withColumn("shard", F.expr(f"CAST((2 * bytes_before + size) * {cfg.shards} DIV (2 * total) AS INT)"))
    firsts = placed.groupBy("shard").agg(F.min("rows_before").alias("first_row"))  # at most cfg.shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rows_before") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "bytes_before"
    )


ORACLE = """
WITH hexed AS (
  SELECT doc_id, coalesce(text, '') AS t, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents
), crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda acc, k: CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))
), sized AS (
  SELECT doc_id, CAST(len(bytes) + 16 AS BIGINT) AS size,
         xor(list_reduce(list_concat([4294967295], bytes), lambda acc, b: xor(acc >> 8, tab[CAST(xor(acc, b) & 255 AS INT) + 1])), 4294967295) AS text_crc32
  FROM hexed, crc_table
), summed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS bytes_before, sum(size) OVER () AS total,
         row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS rows_before FROM sized
), placed AS (
  SELECT *, CAST((2 * bytes_before + size) * 40 // (2 * total) AS INT) AS shard FROM summed
)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(rows_before - min(rows_before) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, CAST(bytes_before AS BIGINT) AS bytes_before
FROM placed
"""
