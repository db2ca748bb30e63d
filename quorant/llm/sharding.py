r"""Sharding: a two-pass external shuffle under the `rows` law.

Pass 1 sizes the table from a narrow copy (a seeded hash and a byte count per
record) and counts the records of each bucket. Pass 2 scatters the records
uniformly to memory-sized buckets by that hash, Fisher-Yates shuffles each
bucket (Spark's seeded `shuffle`) and writes it. A record's global place is its
bucket's first place plus its place in the bucket; shard s holds places
[ceil(s*N/S), ceil((s+1)*N/S)), so counts are at most one apart.

Only built-in functions are used. The hash is of the whole record, so no id,
source, text or group of copies of a text is hot. Records that are equal in
every column share a hash; where their bytes pass a small part of a bucket they
are counted, and each of the copies is dealt to a bucket by the hash of its
number, so however many there are, buckets divide them. Null texts stay null and
weigh one byte. An empty table gives no rows. The input's columns travel inside
one struct column, so their names clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, materialise, shared_path, text_or_empty

SHARDS = 8
SEED = 20240131
#: Text bytes of a bucket; a task holds about five copies of one.
BUCKET_BYTES = 16 << 20
#: Buckets that one task handles at most, one after the other.
BUCKETS_A_TASK = 4
#: Equal records that weigh more than this part of a bucket are counted and dealt by number.
HEAVY = 1 / 16
#: Copies that one row makes at once.
COPIES = 10_000


def _size() -> Column:
    return (F.octet_length(text_or_empty()) + 1).cast("long")


def _comparable(docs: DataFrame) -> list[Column]:
    """The columns of `docs` as values that can be hashed and grouped by."""
    plain = lambda f: not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))
    return [F.col(f"`{f.name}`") if plain(f) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in docs.schema]


def _hashed(docs: DataFrame) -> DataFrame:
    """h, the seeded hash of the whole record, size and doc, a struct of all columns."""
    return docs.select(F.xxhash64(F.lit(SEED), *_comparable(docs)).alias("h"), _size().alias("size"), F.struct("*").alias("doc"))


def _heavy(docs: DataFrame, narrow: DataFrame, least: int) -> DataFrame:
    """(h, doc, n): each record whose copies weigh more than `least` bytes, once, with the number of its copies."""
    keys = materialise(narrow.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).filter(f"n > 1 AND bytes > {least}").select("h"), "shard-heavy-keys")
    whole = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_comparable(docs))])
    hashed = docs.select(F.xxhash64(F.lit(SEED), *_comparable(docs)).alias("h"), F.struct("*").alias("doc"), whole.alias("whole"))
    # Copies become one row map-side, compared by all their columns.
    counted = hashed.join(keys, "h", "left_semi").groupBy("h", "whole").agg(F.first("doc").alias("doc"), F.count("*").alias("n"))
    return materialise(counted.select("h", "doc", "n"), "shard-heavy")


def _copies(heavy: DataFrame, buckets: int) -> DataFrame:
    """A row (bucket, h, and the other columns) for each copy."""
    some = heavy.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    each = some.withColumn("nth", F.explode(F.sequence("start", F.least(F.col("start") + COPIES, "n") - 1)))
    return each.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "h", "nth"), F.lit(buckets)).cast("int")).drop("n", "start", "nth")


@contextmanager
def _sorted_groups(spark: SparkSession) -> Iterator[None]:
    """Groups are aggregated in sorted order, one at a time: a task holds one bucket, and the seeded shuffle meets its buckets in the same order on every run."""
    name = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> None:
    """Write the records of `docs` to `path`/shard=<n>, as columns doc (all of the input's) and slot."""
    narrow = materialise(_hashed(docs).select("h", "size"), "shard-sizes")
    rows, size = narrow.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, -(-size // bucket_bytes))
    heavy = _heavy(docs, narrow, int(bucket_bytes * HEAVY))
    dealt = F.pmod("h", F.lit(buckets)).cast("int").alias("bucket")
    keys = heavy.select("h").distinct()
    counts = narrow.join(keys, "h", "left_anti").select(dealt).unionByName(_copies(heavy.select("h", "n"), buckets).select("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    # As many rows as there are buckets, whatever the number of records.
    first = F.coalesce(F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    plan = materialise(counts.select("bucket", first.alias("first")), "shard-plan")

    light = _hashed(docs).join(keys, "h", "left_anti").select(dealt, "h", "doc")
    placed = light.unionByName(_copies(heavy, buckets).select("bucket", "h", "doc"))
    tasks = max(min(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-buckets // BUCKETS_A_TASK))
    by_task = placed.select(F.expr(f"bucket % {tasks}").alias("task"), "bucket", F.struct("h", "doc").alias("r")).repartitionById(tasks, F.col("task"))
    grouped = by_task.groupBy("task", "bucket").agg(F.collect_list("r").alias("rs"))
    # Sorted first, so that the shuffle starts from the same order on every run; records of equal hash are equal.
    ordered = F.array_sort("rs", lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0))
    shuffled = grouped.join(plan, "bucket").select("first", F.posexplode(F.shuffle(ordered, F.lit(seed))).alias("at", "r"))
    place = F.expr("first + at")
    shard = F.expr(f"CAST((first + at) * {shards} div {max(rows, 1)} AS INT)")
    out = shuffled.select("r.doc", place.alias("place"), shard.alias("shard"))
    out = out.select("doc", F.expr(f"place - (CAST(shard AS BIGINT) * {rows} + {shards - 1}) div {shards}").alias("slot"), "shard")
    with _sorted_groups(docs.sparkSession):
        out.write.partitionBy("shard").option("compression", "lz4_raw").parquet(path)


def read_shards(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    schema = docs.select(F.struct("*").alias("doc"), F.lit(0).cast("long").alias("slot"), F.lit(0).alias("shard")).schema
    return spark.read.schema(schema).parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    path = shared_path(spark, "shards")
    write_shards(docs, path)
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    return read_shards(spark, path, docs).select(
        "doc.doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
