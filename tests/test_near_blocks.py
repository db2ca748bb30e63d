"""Near pairs counted in blocks of texts: the same scores, whatever the blocks, and each text sent once for a pair of blocks."""

import random

import numpy as np
import pytest
from quorant.operators import dedup


def families(seed, n, size, words=400):
    """n families of `size` near copies of 40 tokens each."""
    at, out = random.Random(seed), []
    for _ in range(n):
        first = [f"w{at.randrange(words)}" for _ in range(40)]
        for _ in range(size):
            t = list(first)
            for _ in range(at.randrange(1, 5)):
                t[at.randrange(40)] = f"w{at.randrange(words)}"
            out.append(t)
    return out


def table(spark, own):
    return dedup.written(dedup.classes(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(own)], "id long, text string"), "id", "text"), "classes")


@pytest.mark.parametrize("seed", range(4))
def test_scores_of_many_pairs_are_those_of_each(seed):
    at = random.Random(seed)
    own = [[f"w{at.randrange(6)}" for _ in range(at.choice([0, 1, 2, 3, 4, 5, 9, 30]))] for _ in range(30)] + families(seed, 3, 8, 20)
    hyp, ref = np.nonzero(~np.eye(len(own), dtype=bool))
    for above in (0.5, 0.8):
        got = dedup.bleus(own, hyp, ref, above)
        want = np.array([dedup.bleu(own[i], own[j]) for i, j in zip(hyp, ref, strict=True)])
        assert (got[want > above] == want[want > above]).all() and (want > above).any() and not (got[want <= above] > above).any()


def test_each_text_is_sent_once_for_a_pair_of_blocks(spark):
    own = table(spark, families(1, 5, 40))
    pairs = dedup.written(dedup.candidate_pairs(own), "candidates")
    rows = dedup.pair_blocks(own, pairs).collect()
    assert pairs.count() >= 5 * 40 * 39 / 2 == sum(len(set(zip(r.i, r.j, strict=True))) for r in rows)
    assert sum(len(r.ids) for r in rows) < 2 * own.count() and all({*r.i, *r.j} == set(r.ids) and len(set(r.ids)) == len(r.ids) for r in rows)


def test_pairs_do_not_depend_on_the_parts(spark):
    texts = families(2, 6, 12, 60) + [["a", "b", "c"], ["a", "b", "c", "d"], [], ["a"]]
    own = table(spark, texts)
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if dedup.bleu(texts[i], texts[j]) > dedup.NEAR}
    assert {(r.i, r.j) for r in dedup.near_pairs(own).collect()} == want and len(want) > 200
    rows = lambda df: sorted(map(tuple, df.collect()))
    places = lambda df: rows(df.select("id", "c", "t", "rest"))  # noqa: E731  (numbers of 3-grams, which order ties, depend on the parts)
    assert places(dedup.prefixes(own, held=7)) == places(dedup.prefixes(own)) != []
    pairs = dedup.written(dedup.candidate_pairs(own), "candidates")
    for tokens, most in ((1, 256), (10**6, 2), (90, 5)):
        blocks = dedup.pair_blocks(own, pairs, tokens, most).collect()
        assert sorted(p for r in blocks for p in zip(r.i, r.j, strict=True)) == rows(pairs)
        assert most == 256 or max(len(r.ids) for r in blocks) < 40


@pytest.mark.parametrize("name", ["near_dup_energy", "chunk_energy"])
def test_pairs_are_scored_once(spark, name):
    """Both ends of a pair come from the table of pairs, not from scoring all of them twice; and no text is shuffled to its class."""
    from quorant.plans.catalogue import QUERIES

    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapIn" not in plan and "digest" in plan and found.count() > 0
