"""Digests over sorted lists of any length, and name-based UUIDs over them.

A digest of a joined list takes its bytes in order. Values are range-sorted by (key, value), so that a key of many values
lies in several tasks; each task joins its stretch of a key into chunks of bounded size, and the chunks of a key, few as
they are, go through one hash state in order. No list is ever held whole, and there is one definition at every size.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import uuid_of_sha1

CHUNK_BYTES = 256 << 10


def listed_digest(rows: DataFrame, key: str, value: str, prefix: str | None = None, algorithm: str = "sha256", separator: str = ",", chunk_bytes: int | None = None) -> DataFrame:
    """``key, digest`` (lowercase hex): per key the digest of ``prefix`` and the values, ascending and joined by
    ``separator``.

    ``value`` is sorted by its own type and written as Spark casts it to text; equal values stay as often as they come,
    null values and null keys are left out. ``prefix`` names a binary column, the same in all rows of a key. An empty
    table gives no rows.
    """
    limit = chunk_bytes or CHUNK_BYTES
    own = rows.select(F.col(key).alias("key"), F.col(value).alias("value"), (F.col(prefix) if prefix else F.lit(b"")).alias("prefix")).where("key IS NOT NULL AND value IS NOT NULL")
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = own.repartitionByRange(width, "key", "value").sortWithinPartitions("key", "value").select("key", "prefix", "value", F.col("value").cast("string").alias("shown"))
    kind, item = (own.schema[c].dataType for c in ("key", "value"))
    chunk_type = T.StructType([T.StructField("key", kind), T.StructField("prefix", T.BinaryType()), T.StructField("first", item), T.StructField("last", item), T.StructField("chunk", T.StringType())])
    digest_type = T.StructType([T.StructField("key", kind), T.StructField("digest", T.StringType())])
    chunked = ranged.mapInArrow(lambda batches: _chunks(batches, separator, limit), chunk_type)
    ordered = chunked.repartition(width, "key").sortWithinPartitions("key", "first", "last")
    return ordered.mapInArrow(lambda batches: _folds(batches, algorithm, separator.encode()), digest_type).withColumnRenamed("key", key)


def listed_uuid(rows: DataFrame, key: str, value: str, prefix: str, separator: str = ",") -> DataFrame:
    """``key, uuid``: name-based UUIDs (version 5); ``prefix`` holds the namespace's bytes and the head of the name."""
    return listed_digest(rows, key, value, prefix, "sha1", separator).select(key, uuid_of_sha1(F.col("digest")).alias("uuid"))


def _chunks(batches, separator: str, limit: int):
    """Consecutive rows of a key as chunks of about ``limit`` bytes."""
    held: tuple | None = None  # key, prefix, first, last, parts, bytes
    names = ["key", "prefix", "first", "last", "chunk"]
    for batch in batches:
        done = []
        columns = (batch.column(i).to_pylist() for i in range(4))
        for key, run in groupby(zip(*columns, strict=True), key=lambda r: r[0]):
            items = list(run)
            for at in range(0, len(items), 4096):
                part = items[at : at + 4096]
                if held and held[0] != key:
                    done.append(held)
                    held = None
                if held is None:
                    held = (key, part[0][1], part[0][2], part[0][2], [], 0)
                shown = separator.join(r[3] for r in part)
                held = (*held[:3], part[-1][2], [*held[4], shown], held[5] + len(shown))
                if held[5] >= limit:
                    done.append(held)
                    held = None
        if done:
            yield _chunk_batch(done, batch.schema, names, separator)
        schema = batch.schema
    if held:
        yield _chunk_batch([held], schema, names, separator)


def _chunk_batch(done: list[tuple], schema: pa.Schema, names: list[str], separator: str) -> pa.RecordBatch:
    key, prefix, first, last, parts, _ = zip(*done, strict=True)
    types = [schema.field(0).type, pa.binary(), schema.field(2).type, schema.field(2).type, pa.string()]
    values = [key, prefix, first, last, [separator.join(p) for p in parts]]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)


def _folds(batches, algorithm: str, separator: bytes):
    """One digest per key of chunks in order; the state alone is held between rows."""
    key, state, schema = None, None, None
    for batch in batches:
        schema, done = batch.schema, []
        for k, prefix, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if state is not None and k == key:
                state.update(separator + chunk.encode())
                continue
            if state is not None:
                done.append((key, state.hexdigest()))
            key, state = k, hashlib.new(algorithm, bytes(prefix) + chunk.encode())
        if done:
            yield _digest_batch(done, schema)
    if state is not None:
        yield _digest_batch([(key, state.hexdigest())], schema)


def _digest_batch(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    keys, digests = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array(digests, pa.string())], names=["key", "digest"])
