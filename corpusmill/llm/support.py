"""Shared plumbing of the operators in this subpackage: reading, row-wise Arrow maps, cutting lineage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.functions import storage
from corpusmill.functions.ordering import spread
from corpusmill.functions.storage import drop_path, new_path, path_exists

#: Rows handed to a per-text function at a time, so that a task never holds many decoded texts at once.
SLICE_ROWS = 128


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, so a lost executor costs no upstream work."""
    return storage.materialize(df, tag)[0]


def per_text(df: DataFrame, key: str, text: str, fields: Sequence[tuple[str, T.DataType]], make: Callable[[], Callable[[list[bytes]], list[list]]], scan: bool = False) -> DataFrame:
    """Row-wise map over whole texts.

    ``make()`` runs once per task and returns a function from a list of UTF-8 texts (null: empty) to one list per
    output field. Only ``key`` and ``text`` leave the JVM; other columns, whatever their names, are pruned. The key
    comes back under its own name, then the fields. ``scan`` says that ``df`` reads a table and no more: a scan of fewer
    splits than cores is then dealt out to all of them.
    """
    source = df.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    source = spread(source) if scan else source
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(n, t) for n, t in fields)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                columns = work(part.column(1).to_pylist())
                arrays = [part.column(0).cast(arrow.field(0).type), *(pa.array(c, arrow.field(i + 1).type) for i, c in enumerate(columns))]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return source.mapInArrow(run, schema)


def decode(text: bytes) -> str:
    """Code points of a UTF-8 text; malformed bytes become U+FFFD."""
    return text.decode("utf-8", "replace")
