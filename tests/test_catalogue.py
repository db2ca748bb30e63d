import pytest
from quorant.plans import answers, batches  # noqa: F401  (they register their queries)
from quorant.plans.catalogue import ORACLE_SQL, QUERIES

from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


def test_near_duplicates_are_those_of_brute_force(spark):
    from quorant.operators.dedup import bleu

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    least = {}
    for d in sorted(docs):
        least.setdefault(tuple(d.text.split()), d.doc_id)
    reps = sorted((i, list(t)) for t, i in least.items())
    links = dict.fromkeys(least.values(), 0)
    for a, (i, hyp) in enumerate(reps):
        for j, ref in reps[a + 1 :]:
            if 0.5 < len(ref) / max(1, len(hyp)) < 1.7 and bleu(hyp, ref) > 0.5:
                links[i] += 1
                links[j] += 1
    want = {(d.doc_id, least[tuple(d.text.split())], links[least[tuple(d.text.split())]]) for d in docs}
    assert {tuple(r) for r in QUERIES["near_dup_documents"](spark, SF).collect()} == want


def test_walk_keeps_the_pool_and_repeats_itself(spark):
    one, two = (sorted(map(tuple, QUERIES["mh_walk"](spark, SF).collect()), key=repr) for _ in range(2))
    assert one == two and len(one) == spark.read.parquet(f"{SF}/benchmark.parquet").count()
    assert all(r[4] is None or 0 <= r[4] <= 1 for r in one)
