"""Shard sets closed by a timer, calls in flight, table functions."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from quorant.functions import tablefunctions
from quorant.operators import stats
from quorant.sources import tables
from quorant.streaming import shards


def test_a_timer_closes_a_set_after_its_first_shard(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "set_id long, shard string, arrived timestamp"
    drop = lambda *rows: spark.createDataFrame([(*r, datetime(2024, 1, 1)) for r in rows], schema).coalesce(1).write.mode("append").parquet(folder)
    drop((1, "a"), (2, "a"))
    stream = shards.decide_shards(shards.read_arrivals(spark, folder, schema), 4.0, timer=True)
    query = stream.writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="300 milliseconds").start()

    def seen(n):
        until = time.time() + 60
        while spark.table("decided").count() < n and time.time() < until:
            time.sleep(0.2)
        return {(r.set_id, r.shard): (r.accepted, r.late) for r in spark.table("decided").collect()}

    try:
        assert seen(2) == {("1", "a"): (True, 0), ("2", "a"): (True, 0)}
        time.sleep(9)  # the timer closes both, though nothing comes
        drop((1, "b"), (3, "a"))
        drop((1, "c"))
        found = seen(5)
        assert found["1", "b"] == (False, 1) and found["1", "c"] == (False, 2) and found["3", "a"] == (True, 0)
    finally:
        query.stop()


@pytest.mark.parametrize("in_flight", [1, 3, 16])
def test_answers_keep_their_prompts_in_any_order(spark, in_flight):
    def client():
        from threading import Lock

        running, most, lock = [0], [0], Lock()

        def call(prompts):
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
            time.sleep((hash(prompts[0]) % 5) / 500)
            with lock:
                running[0] -= 1
            if most[0] > in_flight:
                raise AssertionError("too many calls at once")
            if "7" in prompts[0]:
                raise ConnectionError
            return [p[::-1] for p in prompts]

        return call

    asked = spark.range(400, numPartitions=2).select("id", F.concat(F.lit("p"), "id").alias("prompt"))
    found = tables.complete(asked, client, batch=1, tries=2, fallback="none", in_flight=in_flight).collect()
    assert {(r.id, r.response) for r in found} == {(i, "none" if "7" in str(i) else f"p{i}"[::-1]) for i in range(400)} and len(found) == 400


def test_table_functions_of_odd_rows(spark):
    tablefunctions.register(spark)
    said = spark.createDataFrame([(1, r"\boxed{a} \boxed{b{c}}"), (2, None), (3, "")], "id int, said string")
    assert [tuple(r) for r in spark.sql("SELECT id, g.nth, g.body FROM {said}, LATERAL boxed_groups(said) g ORDER BY id, nth", said=said).collect()] == [(1, 0, "a"), (1, 1, "b{c}")]
    votes = spark.createDataFrame([("q", 3, "1/2"), ("q", 1, "0.5"), ("q", 2, None), ("q", 4, "No way"), ("q", 5, "there is no answer"), (None, 1, "x"), ("r", 1, "")], "qid string, sample_idx long, answer string")
    got = sorted((str(r.qid), r.sample_idx, r["class"], r.first) for r in spark.sql("SELECT * FROM answer_classes(TABLE({votes}))", votes=votes).collect())
    assert got == [("None", 1, 0, True), ("q", 1, 0, True), ("q", 3, 0, False), ("q", 4, 1, True), ("q", 5, 1, False)]


def test_settings_of_each_row_and_unknown_ones(spark):
    from quorant.operators.walk import WalkSettings

    df = spark.createDataFrame([(1, None), (2, 0.5)], "id int, b double")
    assert [tuple(r) for r in tables.merged_columns(df, WalkSettings(), {"beta": F.lit(0.2)}, {"beta": F.col("b")}).select("id", "beta", "seed").orderBy("id").collect()] == [(1, 0.2, 7), (2, 0.5, 7)]
    with pytest.raises(KeyError):
        tables.merged_columns(df, WalkSettings(), {"nothing": F.lit(1)})
    tokens = spark.createDataFrame([(1, 1.0, 0), (2, 3.0, 1), (2, 5.0, 1)], "s int, x double, mask int")
    assert tuple(stats.token_metrics(tokens, x=F.col("x")).first()) == (4.0, 5.0, 3.0)
