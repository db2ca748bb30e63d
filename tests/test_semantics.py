"""White space, numbers, negations, empty sequences and silent answers; U-statistics against all subsets."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from quorant.functions import text
from quorant.operators import advantage, stats, vote


def of(spark, said, f):
    return spark.createDataFrame([(said,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "said", "want"),
    [
        (text.question_text, "<question>\nWhat is 2?\n</question>", "What is 2?"),
        (text.question_text, "<question>\n\t \n</question>", None),
        (text.solution_text, "Assistant: x\nFinal Answer: P\n", None),
        (text.solution_text, "The answer is: B\n</s>x", None),
        (text.solution_text, "The answer is: B\nso</s>x", " B"),
        (text.solution_text, "Final Answer: P\n", " P"),
        (text.spaceless, "5\n", "5"),
        (text.reference_text, "\nA, b\t", "a,b"),
        (text.prediction_text, "\nThe answer is: 7.\n", "7"),
        (text.prediction_text, "\n5.\nbecause", "5"),
        (text.bare_answer, "5.\n", "5.\n"),
    ],
)
def test_white_space_of_any_kind_is_taken_off(spark, f, said, want):
    assert of(spark, said, f) == want


@pytest.mark.parametrize(("said", "truth", "want"), [("1d", "1", False), ("1_000", "1000", True), ("1__0", "10", False), (" 2e0\n", "2", True), ("nan", "nan ", False), ("inf", "Infinity", True), (".5", "0.5", True), ("0x10", "16", False), ("5", "5f", False)])
def test_numbers_in_decimal_notation_alone(spark, said, truth, want):
    row = spark.createDataFrame([(said, truth)], "a string, b string").select(text.fuzzy_match(F.col("a"), F.col("b")).alias("x")).first()
    assert row.x is want


def test_negations_in_either_case():
    assert vote.same_answer("No solution", "there is no answer") and not vote.same_answer("Nothing", "no answer")


def test_advantages_of_empty_and_null_sequences(spark):
    df = spark.createDataFrame([(1, [], []), (2, [1.0], [0.5]), (3, None, None)], "id int, r array<double>, v array<double>")
    adv, ret = advantage.gae(F.col("r"), F.col("v"))
    assert [tuple(r) for r in df.select(adv, ret).orderBy("id").collect()] == [([], []), ([0.5], [1.0]), (None, None)]


def by_subsets(answers, share, m):
    def mean(some):
        found = []
        for subset in itertools.combinations(some, m):
            told = [a for a in subset if a not in (None, "", text.FAIL_FORMAT)]
            p = max((told.count(a) for a in told), default=0) / m
            found.append(max(0.0, max(0.0, 1 - 2 * abs(p - 0.5)) - share))
        return sum(found) / len(found)

    n = len(answers)
    if n < m:
        return 0.0, 0.0
    if n == m:
        return mean(answers), 0.0
    left = [mean(answers[:j] + answers[j + 1 :]) for j in range(n)]
    return mean(answers), (n - 1) / n * sum((x - sum(left) / n) ** 2 for x in left)


@pytest.mark.parametrize("seed", range(40))
def test_u_statistics_against_all_subsets(seed):
    at = random.Random(seed)
    answers = [at.choice(["a", "b", "c", "d", None, "", text.FAIL_FORMAT]) for _ in range(at.randrange(3, 11))]
    m, share = at.randrange(1, 8), at.choice([0.0, 0.1, 0.4])
    assert np.allclose(stats.u_statistic(answers, share, m), by_subsets(answers, share, m), atol=1e-12)


def test_u_statistics_of_many_samples():
    answers = [str(i % 7) for i in range(50)] + [None] * 14
    stats.u_statistic(answers, 0.1, 32)
    began = time.perf_counter()
    u, v = stats.u_statistic(answers, 0.1, 32)
    assert time.perf_counter() - began < 0.5 and 0 < u < 1 and v >= 0
    wide = [str(i % 40) for i in range(200)]  # counts beyond 64 bits
    assert 0 < stats.u_statistic(wide, 0.0, 60)[0] < 1
