"""Versions of a table in one folder, and streams written to several sinks once.

A version is data under a name of its own and a manifest `versions/<number>` that names it. The manifest is written beside
and put in its place by a rename, which takes place wholly or not at all and fails if the number is taken: a run that
stops before it leaves the version before as the last. Readers hold on to the version they were given. Old versions go
manifest first, then data that no manifest names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class _Files:
    """The file system of a folder, through Spark's own access to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.path = path.rstrip("/")
        self.system = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.system.listStatus(self.at(folder))] if self.system.exists(self.at(folder)) else []

    def write(self, name: str, text: str) -> None:
        out = self.system.create(self.at(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        stream = self.system.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.system.delete(self.at(name), True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that there are, ascending."""
    return sorted(int(n) for n in _Files(spark, path).names("versions") if n.isdigit())


def write_data(df: DataFrame, path: str) -> str:
    """The data of a version to come, under a name of its own; no reader sees it yet."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{path.rstrip('/')}/data/{name}")
    return name


def publish(spark: SparkSession, path: str, data: str) -> int:
    """Make written data the last version; its number."""
    files = _Files(spark, path)
    files.system.mkdirs(files.at("versions"))
    beside = f"versions/.{uuid.uuid4().hex}"
    files.write(beside, data)
    while True:
        number = max(versions(spark, path), default=0) + 1
        if files.system.rename(files.at(beside), files.at(f"versions/{number}")):
            return number
        if number not in versions(spark, path):
            raise OSError(f"version {number} of {path} could not be put in place")


def save_version(df: DataFrame, path: str) -> int:
    return publish(df.sparkSession, path, write_data(df, path))


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """A version, by default the last."""
    found = versions(spark, path)
    number = number if number is not None else max(found, default=0)
    if number not in found:
        raise FileNotFoundError(f"no version {number} of {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/data/{_Files(spark, path).read(f'versions/{number}')}")


def restore(spark: SparkSession, path: str, number: int) -> int:
    """Make an earlier version the last one, as a new version of the same data."""
    return publish(spark, path, _Files(spark, path).read(f"versions/{number}"))


def keep_versions(spark: SparkSession, path: str, newest: int, every: int = 0) -> list[int]:
    """Delete all versions but the newest and, if given, each `every`-th; then data that no version names. The numbers left.

    Data being written has no version yet: call this where nothing is written meanwhile.
    """
    files, found = _Files(spark, path), versions(spark, path)
    kept = [v for i, v in enumerate(found) if i >= len(found) - newest or every and v % every == 0]
    for v in set(found) - set(kept):
        files.delete(f"versions/{v}")
    named = {files.read(f"versions/{v}") for v in kept}
    for name in set(files.names("data")) - named:
        files.delete(f"data/{name}")
    return kept


Sink = Callable[[DataFrame, str], None]


def to_files(path: str, kind: str = "parquet") -> Sink:
    """A sink of files, in a folder for each key of a batch: written again, they replace themselves."""

    def write(batch: DataFrame, key: str) -> None:
        batch.write.mode("overwrite").format(kind).save(f"{path.rstrip('/')}/batch={key}")

    return write


def fan_out(stream: DataFrame, sinks: dict[str, Sink], name: str, checkpoint: str) -> StreamingQuery:
    """Write what is there of a stream to every sink. A batch's key is (name, number): one that is made again, after a failure in between, replaces what it wrote, so each sink has it once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()  # so that all sinks get the same rows from one reading
        try:
            for sink in sinks.values():
                sink(batch, f"{name}-{number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_sink(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """Rows of a sink of files, without its keys."""
    return spark.read.schema(schema).format(kind).load(f"{path.rstrip('/')}/*").select([F.col(c.split()[0]) for c in schema.split(", ")])
