"""Small groups: as many as there are reach Python in common batches; customers of many orders."""

import pytest
from pyspark.sql import functions as F
from quorant.operators import partition
from quorant.plans.catalogue import ORACLE_SQL, QUERIES

from tests.oracle import assert_same


def test_batches_of_customers_with_many_orders(spark, tmp_path):
    rows = spark.range(300).selectExpr("id AS o_orderkey", "CAST(pow(id % 17, 2) AS BIGINT) % 5 AS o_custkey")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    assert rows.groupBy("o_custkey").agg(F.sum(F.col("o_orderkey") % 97 + 1).alias("n")).filter("n > 2100").count() >= 2
    for name in ("token_batches", "differencing_spread", "greedy_parts"):
        assert_same(QUERIES[name](spark, str(tmp_path)), ORACLE_SQL[name], str(tmp_path))


@pytest.mark.parametrize("method", ["differencing", "greedy"])
def test_groups_are_dealt_in_common_batches(spark, method):
    rows = spark.range(100).selectExpr("id", "id div 7 AS g", "id * 37 % 11 + 1 AS n")
    found = partition.balance(rows, "g", "id", "n", 3, method)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    got = {r.id: r.part for r in found.collect()}
    for g in range(15):
        ids = [i for i in range(100) if i // 7 == g]
        for p, members in enumerate(getattr(partition, method)([i * 37 % 11 + 1 for i in ids], 3)):
            assert all(got[ids[m]] == p for m in members)
    assert len(got) == 100


def test_equality_of_a_pair_is_found_once():
    from quorant.functions import text

    text._known_equal.cache_clear()
    assert [text.known_equal("x + 71", "71 + x", True) for _ in range(50)] == [True] * 50
    assert (text._known_equal.cache_info().misses, text._known_equal.cache_info().hits) == (1, 49)
    long = "1" * text.SHORT
    assert text.known_equal(long, long + ".0") and text._known_equal.cache_info().misses == 1


def test_questions_are_voted_on_in_common_batches(spark):
    from quorant.operators import vote

    rows = [(q, i, a) for q in range(40) for i, a in enumerate(["0.5", None, "1/2", "", "x"][: q % 6])]
    found = vote.equivalence_vote(spark.createDataFrame(rows, "qid long, sample_idx long, answer string"))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    want = {1: ("0.5", 1, 1), 2: ("0.5", 1, 1), 3: ("0.5", 2, 2), 4: ("0.5", 2, 2), 5: ("0.5", 2, 3)}
    assert {r.qid: (r.label, r.n_votes, r.n_samples) for r in found.collect()} == {q: want[q % 6] for q in range(40) if q % 6}


def test_advantages_compute_their_input_once(spark):
    from quorant.operators import advantage

    spent = advantage.gae(F.col("given_rewards"), F.col("given_values"), 0.5, 0.9)[0]
    assert str(spent).count("given_rewards") == 1


def test_answers_in_flight_come_back_together(spark):
    import pandas as pd
    from quorant.sources import tables

    parts = [pd.DataFrame({"x": range(i, i + 16)}) for i in range(0, 4800, 16)]
    found = list(tables.gathered(iter(parts)))
    assert len(found) == 5 and pd.concat(found)["x"].tolist() == list(range(4800)) and list(tables.gathered(iter([]))) == []
