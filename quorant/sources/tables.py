"""Sources, sinks and state tables."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, as_completed
from concurrent.futures import wait as first_done
from dataclasses import fields, replace

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_dir: str | None = None

SCORED_SHARD = "question STRING, answer STRING, score DOUBLE, results ARRAY<STRING>"
EVAL_RESULT = "question STRING, answer STRING, response STRING, score DOUBLE, average_score DOUBLE"
REGRADE = "model STRING, dataset STRING, n INT, raw DOUBLE, ours DOUBLE, paper DOUBLE"
FINAL_RESULTS = "model STRING, dataset STRING, score DOUBLE, accuracy DOUBLE"
WALLCLOCK = "iter INT, phase STRING, seconds INT, minutes DOUBLE, start STRING, end STRING"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on one machine."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = f"file://{tempfile.mkdtemp(prefix='quorant-')}"
    return _own_dir


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """`df` as a Parquet table in the shared folder: short lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_json_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_shards(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All shards that a glob finds; missing ones are skipped, and a glob that finds none gives no rows."""
    try:
        return spark.read.schema(schema).options(multiLine=True, ignoreMissingFiles=True).json(pattern)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str) -> None:
    """Replaces what is there."""
    df.write.mode("overwrite").json(path)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """A file for each partition, a JSON array of its rows; replaces what is there."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = "["
        for rows in batches:
            told = rows["value"].tolist()
            if told:
                yield pd.DataFrame({"value": [before + told[0], *("," + x for x in told[1:])]})
                before = ","
        yield pd.DataFrame({"value": ["]" if before == "," else "[]"]})

    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).mapInPandas(lines, "value string").write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, path: str, step: int) -> None:
    """One line of metrics a row, with its step, after those there."""
    append_json(metrics.withColumn("step", F.lit(step)), path)


def write_samples(samples: DataFrame, path: str, step: int, key: str, most: int, seed: int = 42) -> None:
    """At most `most` samples of a step, those that hash first, after those there."""
    drawn = samples.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(most)
    append_json(drawn.withColumn("step", F.lit(step)), path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _objects(text: str) -> Iterator[str]:
    """The JSON objects of a text that may hold them one after the other, indented, with or without line breaks between."""
    decoder, at = json.JSONDecoder(), 0
    while (at := text.find("{", at)) >= 0:
        try:
            _, end = decoder.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        yield text[at:end]
        at = end


def read_mixed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects however they are laid out in a file; a file is one value, so for result files, not corpora."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"value": [o for text in batch["value"] for o in _objects(text)]}, dtype=object)

    return spark.read.text(path, wholetext=True).mapInPandas(split, "value string").select(F.from_json("value", schema).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=sep, header=header, multiLine=True, escape='"')


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """Parquet at `path`, or at `folder@split`."""
    folder, _, split = path.partition("@")
    return spark.read.parquet(f"{folder}/{split}" if split else folder)


def publish(df: DataFrame, path: str, split: str = "train") -> None:
    """Write a split; an empty result is an error."""
    df = written(df, "publish")
    if df.isEmpty():
        raise ValueError("nothing to publish")
    df.write.mode("overwrite").parquet(f"{path}/{split}")


def consume_once(spark: SparkSession, folder: str, schema: str, archive: str | None = None):
    """Stream of JSON files that are deleted (or moved to `archive`) once they are read."""
    source = spark.readStream.schema(schema).option("multiLine", True).option("cleanSource", "archive" if archive else "delete")
    return (source.option("sourceArchiveDir", archive) if archive else source).json(folder)


def write_timing(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, sep="\t", header=False)


def seconds_by_iteration(timing: DataFrame) -> DataFrame:
    return timing.groupBy("iter").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("phases"))


def keep_newest(states: DataFrame, limit: int, order: str = "step", *keys: str) -> DataFrame:
    """The newest `limit` rows of each key by `order`."""
    return states.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).filter(F.col("_nth") <= limit).drop("_nth")


def save_state(df: DataFrame, path: str, iteration: int) -> None:
    """Idempotent: an iteration written again replaces itself alone."""
    df.write.mode("overwrite").parquet(f"{path}/iter={iteration}")


def saved_iterations(spark: SparkSession, path: str) -> list[int]:
    """Completed iterations, in order of number."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    done = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("iter=")]
    return sorted(int(p.getName()[5:]) for p in done if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def union_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows side by side by `key`; shared columns must be equal, and both sides must have the same keys."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    l, r = left.alias("l"), right.alias("r")  # noqa: E741
    both = l.join(r, F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer")
    same = F.col(f"l.{key}").isNotNull() & F.col(f"r.{key}").isNotNull()
    for c in shared:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    checked = both.filter(F.when(same, True).otherwise(F.raise_error(F.lit("columns differ")).cast("boolean")))
    return checked.select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in right.columns if c not in left.columns])


def flattened(df: DataFrame, sep: str = "/") -> DataFrame:
    """Fields of struct columns, at any depth, as columns named by their path."""

    def fields(column: Column, kind: T.DataType, path: str) -> list[Column]:
        if not isinstance(kind, T.StructType):
            return [column.alias(path)]
        return [c for f in kind for c in fields(column.getField(f.name), f.dataType, f"{path}{sep}{f.name}")]

    return df.select(*[c for f in df.schema for c in fields(F.col(f"`{f.name}`"), f.dataType, f.name)])


def nested(df: DataFrame, sep: str = "/") -> DataFrame:
    """The way back from flattened()."""

    def struct(paths: list[tuple[str, ...]], depth: int) -> list[Column]:
        heads = dict.fromkeys(p[depth] for p in paths)
        own = {h: [p for p in paths if p[depth] == h] for h in heads}
        return [(F.col(f"`{sep.join(ps[0])}`") if len(ps[0]) == depth + 1 else F.struct(*struct(ps, depth + 1))).alias(h) for h, ps in own.items()]

    return df.select(*struct([tuple(c.split(sep)) for c in df.columns], 0))


def checked_columns(df: DataFrame, schema: str) -> DataFrame:
    """`df` with exactly the columns of `schema`; other types are an error."""
    want = T._parse_datatype_string(schema)
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in want if have.get(f.name) != f.dataType]
    if wrong:
        raise TypeError(f"columns missing or of another type: {wrong}")
    return df.select(*want.names)


Client = Callable[[list[str]], list[str]]


def _attempt(call: Client, prompts: list[str], seconds: float | None) -> list[str]:
    """The client's answers, one for each prompt; too few, or none within `seconds`, is an error."""
    if seconds is None:
        found = call(prompts)
    else:
        pool = ThreadPoolExecutor(1)
        try:
            found = pool.submit(call, prompts).result(seconds)
        finally:
            pool.shutdown(wait=False)
    if len(found) != len(prompts):
        raise ValueError(f"{len(found)} answers to {len(prompts)} prompts")
    return list(found)


#: Rows of answers that go back to Spark together; what a batch of a few rows costs on its way is then paid once for many.
GATHERED = 1_000


def gathered(parts: Iterator[pd.DataFrame], rows: int = GATHERED) -> Iterator[pd.DataFrame]:
    """The rows of `parts` in as many frames as `rows` of them, or more, make each."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def complete(prompts: DataFrame, client: Callable[[], Client], batch: int = 64, tries: int = 3, fallback: str | None = None, wait: float = 0.0, seconds: float | None = None, in_flight: int = 1) -> DataFrame:
    """(qid, sample_idx, prompt) with response: a model behind `client`, built once per task, called by batch.

    Up to `in_flight` batches of a task are called at once, and their rows come out in the order of the answers (GATHERED at a
    time), each with its own keys; the next batch is read only when one is done, so a slow service holds back what feeds it. A task that ends
    early cancels what has not begun; the client is shared by the calls.

    A call that fails, takes more than `seconds` or answers too few prompts is made again, after `wait` seconds, then twice
    that, and so on; after `tries` calls the batch gets `fallback`.
    """

    def answered(call: Client, rows: pd.DataFrame) -> pd.DataFrame:
        part = rows["prompt"].tolist()
        for n in range(1, tries + 1):
            try:
                return rows.assign(response=_attempt(call, part, seconds))
            except Exception:  # noqa: BLE001  (any failure of the service)
                if n < tries:
                    time.sleep(wait * n)
        return rows.assign(response=[fallback] * len(part))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, pending = client(), set()
        parts = (rows.iloc[i : i + batch] for rows in batches for i in range(0, len(rows), batch))
        if in_flight == 1:
            yield from gathered(answered(call, rows) for rows in parts)
            return
        pool = ThreadPoolExecutor(in_flight)

        def arrivals() -> Iterator[pd.DataFrame]:
            nonlocal pending
            for rows in parts:
                pending.add(pool.submit(answered, call, rows))
                if len(pending) == in_flight:
                    done, pending = first_done(pending, return_when=FIRST_COMPLETED)
                    yield from (f.result() for f in done)
            yield from (f.result() for f in as_completed(pending))

        try:
            yield from gathered(arrivals())
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return prompts.mapInPandas(run, T.StructType([*prompts.schema.fields, T.StructField("response", T.StringType())]))


# Data sets and the places of their question and answer; times: how often the set is replicated.
DATASETS = {
    "math": {"question": "problem", "answer": "answer"},
    "gsm8k": {"question": "question", "answer": "answer", "after": "#### "},
    "amc": {"question": "question", "answer": "answer", "times": 32},
    "minerva": {"question": "question", "answer": "answer"},
    "olympiad": {"question": "question", "answer": "final_answer", "first": True},
    "aime2024": {"question": "problem", "answer": "answer", "times": 32},
    "aime2025": {"question": "problem", "answer": "answer", "times": 32},
    "mmlu_pro": {"question": "question", "answer": "answer", "options": "options", "sample": 1000},
    "bbeh": {"question": "question", "answer": "answer"},
    "super_gpqa": {"question": "question", "answer": "answer_letter", "options": "options"},
    "gpqa": {"question": "question", "answer": "answer", "options": "options"},
    "mydataset": {"question": "problem", "answer": "answer"},
}


def shape_dataset(df: DataFrame, name: str) -> DataFrame:
    """question, answer of a registered data set."""
    from ..functions.text import multiple_choice

    spec = DATASETS[name]
    answer: Column = F.col(spec["answer"])
    if spec.get("first"):
        answer = answer.getItem(0)
    if after := spec.get("after"):
        answer = F.element_at(F.split(answer.cast("string"), after), -1)
    question = multiple_choice(F.col(spec["question"]), F.col(spec["options"])) if "options" in spec else F.col(spec["question"])
    out = df.select(question.alias("question"), answer.cast("string").alias("answer"))
    if n := spec.get("sample"):
        out = out.orderBy(F.xxhash64("question", F.lit(42)), "question").limit(n)
    if times := spec.get("times"):
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("copy")
    return out


Loader = Callable[[SparkSession, str], DataFrame]
#: Loaders by name of a data set, beside those that its registered shape gives.
LOADERS: dict[str, Loader] = {}


def loader(name: str) -> Callable[[Loader], Loader]:
    """Registers a function (spark, path) -> question, answer for a data set."""

    def keep(function: Loader) -> Loader:
        LOADERS[name] = function
        return function

    return keep


def loader_of(name: str) -> Loader:
    """The loader of a data set: its own, or one that reads a table by path and shapes it; an unknown name is an error."""
    if name in LOADERS:
        return LOADERS[name]
    if name not in DATASETS:
        raise ValueError(f"unknown data set {name}")
    return lambda spark, path: shape_dataset(spark.read.parquet(path), name)


def merged_columns(df: DataFrame, defaults, *layers: dict[str, Column]) -> DataFrame:
    """`df` with a column for each field of a dataclass: the last layer's value that is not null, or the default; unknown keys are an error."""
    known = [f.name for f in fields(defaults)]
    for layer in layers:
        if unknown := set(layer) - set(known):
            raise KeyError(f"unknown settings: {sorted(unknown)}")
    return df.withColumns({k: F.coalesce(*[layer[k] for layer in reversed(layers) if k in layer], F.lit(getattr(defaults, k))) for k in known})


def merged(defaults, *layers: dict):
    """A dataclass with each layer's known keys over the one before; unknown keys are an error."""
    known = {f.name for f in fields(defaults)}
    for layer in layers:
        if unknown := set(layer) - known:
            raise KeyError(f"unknown settings: {sorted(unknown)}")
        defaults = replace(defaults, **layer)
    return defaults
