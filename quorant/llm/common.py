"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word contract: words are `[^\x20\x09-\x0D]+`.
WHITE = " \t\n\x0b\f\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"

_own_dir: str | None = None
#: Paths handed out within each `scratch` that is open.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on one machine (tests)."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = f"file://{tempfile.mkdtemp(prefix='quorant-')}"
    return _own_dir


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Notes the paths handed out inside, for `discard` once what they led to is written."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back; its path is in the attribute `written_to`.

    Cuts lineage like checkpoint(), survives lost executors, prunes columns on
    later reads and gives Catalyst the real size for its join choice.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))
