"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it names none a local folder serves, but only if driver and
    executors are one process; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if "dir" not in _own:
            _own["dir"] = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        root = _own["dir"]
    return root.rstrip("/")


_own: dict[str, str] = {}


_scopes: list[list[str]] = []


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write to the shared folder inside the block are dropped at its end, also after an error.
    Results are lazy and read them, so write the result inside too. Blocks nest; one is for one thread."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            drop_path(spark, path)


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write and read back: a lost executor costs nothing upstream of the written table."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more, by Spark's own file system layer."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def rename_path(spark: SparkSession, source: str, target: str) -> bool:
    """Move a folder in one step; false if something is there already."""
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    system = source.getFileSystem(spark._jsc.hadoopConfiguration())
    return not system.exists(target) and system.rename(source, target)


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """A small file of its own."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_note(spark: SparkSession, path: str) -> str:
    """The text of a small file, hidden ones too."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
