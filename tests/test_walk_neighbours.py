"""Neighbours of a chain's texts are found within the chain: the text of its lower id is the hypothesis, whatever copies other chains hold."""

from quorant.operators import dedup, walk


def test_copies_in_other_chains_change_nothing(spark):
    long = [f"w{k}" for k in range(24)]
    short = long[:14]
    assert dedup.bleu(long, short) > dedup.NEAR > dedup.bleu(short, long)
    said = {0: long, 40: short, 41: long, 80: long, 81: short, 82: long, 83: ["a", "b"], 84: ["a", "b"], 85: None, 120: short}
    pool = spark.createDataFrame([(k // 40, k, None if t is None else " ".join(t)) for k, t in said.items()], "chain long, id long, text string")
    near = {r.id: r.near for r in walk.with_neighbours(pool).collect()}
    want = {k: sorted({k} | {j for j in said if j // 40 == k // 40 and dedup.bleu(said[min(j, k)] or [], said[max(j, k)] or []) > dedup.NEAR}) for k in said}
    assert near == want and near[40] == [40] and near[80] == [80, 81, 82]
    # Only what meets in a chain becomes a candidate: of the copies in other chains none does.
    own = dedup.written(pool.select("id", dedup.tokens_of(pool.text).alias("tokens"), pool.chain.alias("within")), "texts")
    assert {r.i // 40 - r.j // 40 for r in dedup.candidate_pairs(own).collect()} == {0}


def test_a_step_shuffles_each_text_once_and_drops_proposals_without_a_row(spark):
    schema = "chain long, id long, text string, answers array<string>"
    pool = spark.createDataFrame([(0, k, f"a b c d e f g{k}", ["1", "2"]) for k in range(6)] + [(1, 6, "x y z", ["1"]), (None, None, "n o", ["1"])], schema)
    proposals = spark.createDataFrame([(0, k, f"a b c q{k}", ["2"]) for k in (1, 3, 9)] + [(2, 20, "p", ["1"]), (None, None, "o", ["2"])], schema)
    moved = walk.walk_step(pool, proposals, 0)
    assert moved._jdf.queryExecution().executedPlan().toString().count("Join") == 0
    got = moved.collect()
    assert {(r.chain, r.id) for r in got} == {(r.chain, r.id) for r in pool.collect()} and len(got) == 8
    assert {r.id for r in got if r.alpha is not None} == {1, 3}
