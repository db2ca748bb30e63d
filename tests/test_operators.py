import math
import time
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quorant.functions import text
from quorant.functions.rewards import SCALAR
from quorant.operators import advantage, dedup, filters, partition, stats, vote, walk
from quorant.sources import tables
from quorant.streaming import votes as stream


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*[c(F.col("t")) for c in columns]).first()


def test_majority_edges(spark):
    rows = [(1, i, a) for i, a in enumerate("abab")] + [(2, i, None) for i in range(3)] + [(3, 0, "x")] + [(4, i, a) for i, a in enumerate(["None", "None", "y"])]
    got = {r.qid: (r.label, r.p_hat) for r in vote.majority(spark.createDataFrame(rows, "qid long, sample_idx int, answer string")).collect()}
    assert got == {1: ("a", 0.5), 2: (None, 0.0), 3: ("x", 1.0), 4: ("None", 2 / 3)}
    strict = vote.majority(spark.createDataFrame(rows, "qid long, sample_idx int, answer string"), invalid=("None",), denominator="nonempty")
    assert {r.qid: r.p_hat for r in strict.collect()}[4] == 1.0


def test_equivalence_vote_follows_sample_order(spark):
    near = lambda a, b: abs(int(a) - int(b)) <= 1  # noqa: E731  (not transitive)
    label = lambda answers: vote.equivalence_vote(spark.createDataFrame([(1, i, a) for i, a in enumerate(answers)], "qid long, sample_idx int, answer string"), near).first()
    assert tuple(label(["1", "2", "3", ""]))[1:4] == ("1", 2, 3)
    assert tuple(label(["2", "1", "3"]))[1:4] == ("2", 3, 3)


def test_band_edges(spark):
    ps = [0.3, 0.8, 1 / 3, 7 / 9, 0.8 + 1e-12, None]
    kept = [r.p for r in spark.createDataFrame([(p,) for p in ps], "p double").filter(vote.in_band(F.col("p"))).collect()]
    assert kept == ps[:4]


def test_funnel_counts_each_row_once(spark):
    df = spark.range(100)
    n = {r.reason: r.n for r in filters.funnel(df, {"low": F.col("id") < 10, "even": F.col("id") % 2 == 0}).collect()}
    assert n == {"low": 10, "even": 45, "kept": 45}


@pytest.mark.parametrize(
    ("said", "last", "deep"),
    [(r"\boxed{1} \boxed{2}", "2", "2"), ("none", None, None), (r"\boxed{a{b{c}}}", "a{b{c}}", "a{b{c}}"), (r"\boxed{a{b{c{d}}}}", None, "a{b{c{d}}}"), (r"\boxed{1", None, None), (r"\boxed{}", "", "")],
)
def test_boxed(spark, said, last, deep):
    assert tuple(one(spark, said, text.last_boxed, text.last_boxed_any_depth)) == (last, deep)


@pytest.mark.parametrize(
    ("said", "want"),
    [("<question>a</question><question> b </question>", "b"), ("<question>x <question>y</question>", "y"), ("<question> </question>", None), ("<question>a\nb</question>", "a\nb"), ("", None)],
)
def test_question_tag(spark, said, want):
    assert one(spark, said, text.question_text)[0] == want


def test_answers_verdicts_and_rewards(spark):
    assert one(spark, "so the answer is: 42", text.challenger_answer, text.solver_answer)[:] == ("42", "42")
    assert one(spark, "word " * 60, text.solver_answer)[0] == text.FAIL_FORMAT
    assert [one(spark, v, text.verdict)[0] for v in ("VALID", "INVALID", "so INVALID", "?", None)] == [True, False, False, True, True]
    df = spark.createDataFrame([(r"<think>x</think> \boxed{3.0}", "3"), ("3", "3")], "r string, t string")
    assert [round(r[0].overall, 6) for r in df.select(SCALAR["math"](F.col("r"), F.col("t"))).collect()] == [1.0, 0.0]
    assert one(spark, "The answer is: $\\boxed{7}$.", text.prediction_text)[0] == "7"


def test_number_equality():
    assert text.equal_values(r"\frac{1}{2}", "0.5") and text.equal_values(r"2\sqrt{4}", "4") and text.equal_values("50%", "1/2")
    assert text.equal_values("1,000", "1000") and text.equal_values("2", "3") is False and text.equal_values("x", "x+1") is None


def test_group_advantages(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", 2.0), ("c", 2.0)], "uid string, score double")
    g = sorted((r.uid, round(r.advantage, 4)) for r in advantage.grpo(df).collect())
    assert g == [("a", -0.7071), ("a", 0.7071), ("c", 0.0), ("c", 0.0)]
    assert sorted(r.advantage for r in advantage.rloo(df).filter("uid = 'a'").collect()) == [-2.0, 2.0]
    with pytest.raises(Exception, match="group of one"):
        advantage.grpo(df, strict=True).collect()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.floats(-5, 5), st.floats(-5, 5), st.booleans()), min_size=1, max_size=8))
def test_gae_and_returns(spark, rows):
    r, v, m = ([float(x[k]) for x in rows] for k in range(3))
    df = spark.createDataFrame([(r, v, m)], "r array<double>, v array<double>, m array<double>")
    adv, ret = advantage.gae(F.col("r"), F.col("v"), 0.9, 0.8)
    got = df.select(adv, ret, advantage.discounted_returns(F.col("r"), F.col("m"), 0.9)).first()
    carry, want = 0.0, []
    for t in reversed(range(len(r))):
        carry = r[t] + 0.9 * (v[t + 1] if t + 1 < len(v) else 0.0) - v[t] + 0.9 * 0.8 * carry
        want.insert(0, carry)
    run, back = 0.0, []
    for t in reversed(range(len(r))):
        back.insert(0, r[t] + 0.9 * run)
        run = back[0] * m[t]
    assert np.allclose(got[0], want) and np.allclose(got[1], np.add(want, v)) and np.allclose(got[2], back)


def test_masks(spark):
    df = spark.createDataFrame([([5, 9, 2, 9],), ([9],), ([1, 2],), ([],)], "t array<int>")
    got = [tuple(r) for r in df.select(advantage.response_mask(F.col("t"), F.lit(9)), advantage.position_ids(F.transform("t", lambda x: (x > 1).cast("int")))).collect()]
    assert got == [([1, 1, 0, 0], [0, 1, 2, 3]), ([1], [0]), ([1, 1], [0, 0]), ([], [])]


@pytest.mark.parametrize("n", [1, 2, 4, 5, 11])
def test_rank_rules(spark, n):
    df = spark.range(n).withColumn("x", F.col("id").cast("double"))
    assert stats.upper_median(df, "x").first()[0] == sorted(range(n))[n // 2]
    assert walk.top_half(df, "x", "id").count() == max(1, n // 2)
    parts = Counter(r.part for r in stats.quintile(df, [F.col("x"), F.col("id")]).collect())
    size = max(1, n // 5)
    assert parts == Counter(min(i // size, 4) for i in range(n))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=24), st.integers(1, 4))
def test_balance_covers_and_is_even(lengths, k):
    for equal in (False, True):
        if equal and len(lengths) % k:
            continue
        for split in (partition.differencing, partition.greedy):
            parts = split(lengths, k, equal)
            assert sorted(i for p in parts for i in p) == list(range(len(lengths))) and len(parts) == k
            assert not equal or {len(p) for p in parts} == {len(lengths) // k}
    best = partition.differencing(lengths, k)
    assert max(sum(lengths[i] for i in p) for p in best) - min(sum(lengths[i] for i in p) for p in best) <= max(lengths)
    batches = partition.micro_batches(lengths, 60)
    assert len(batches) == -(-sum(lengths) // 60)


@pytest.mark.parametrize("n", [0, 1, 10, 12])
def test_shards_and_padding(spark, n):
    df = spark.range(n).withColumnRenamed("id", "idx")
    shards = Counter(r[0] for r in df.select(partition.even_shard(F.col("idx"), n, 3)).collect())
    assert shards == Counter({i: n // 3 + (i < n % 3) for i in range(3) if n // 3 + (i < n % 3)})
    padded = [r.idx for r in partition.pad_to_divisor(df, "idx", n, 8).collect()]
    assert sorted(padded) == list(range(n + -n % 8 if n else 0)) and partition.unpad(partition.pad_to_divisor(df, "idx", n, 8)).count() == n
    assert sorted(r.idx for r in partition.repeat(df, "idx", 2, n).collect()) == list(range(2 * n))


def test_fit_length(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1],)], "t array<int>")
    fit = lambda **k: [r[0] for r in df.select(partition.fit_length(F.col("t"), 2, F.lit(0), **k)).collect()]
    assert fit() == [[1, 2], [1, 0]] and fit(left=True, truncate="left") == [[2, 3], [0, 1]]
    with pytest.raises(Exception, match="too long"):
        fit(truncate="error")


def test_u_statistic_by_hand():
    answers = ["a", "b", "a", "a", None, "b"]
    u, v = stats.u_statistic(answers, 0.1, 3)
    value = lambda s: max(0.0, max(0.0, 1 - 2 * abs(max(Counter(x for x in s if x).values(), default=0) / 3 - 0.5)) - 0.1)
    mean = lambda rows: np.mean([value(s) for s in combinations(rows, 3)])
    left = np.array([mean(answers[:j] + answers[j + 1 :]) for j in range(6)])
    assert math.isclose(u, mean(answers)) and math.isclose(v, 5 / 6 * ((left - left.mean()) ** 2).sum())
    assert stats.u_statistic(answers, 0.1, 7) == (0.0, 0.0) and stats.u_statistic(answers, 0.1, 6)[1] == 0.0


def test_average_linkage_and_bleu():
    d = np.array([[0, 0.2, 0.9], [0.2, 0, 0.6], [0.9, 0.6, 0]])
    assert dedup.average_linkage(d, 0.5) == [0, 0, 2]
    assert math.isclose(dedup.bleu("a b c d e".split(), "a b c d e".split()), 1.0) and dedup.bleu([], ["a"]) == 0.0
    assert dedup.bleu("a b c d".split(), "a b c x d".split()) != dedup.bleu("a b c x d".split(), "a b c d".split())


def test_dual_update_clamps(spark):
    assert walk.dual_update(0.5, 1.0, 0.2, 0.0)[0] == 2.0 and walk.dual_update(0.5, 1.0, 0.2, 100.0)[0] == 0.02
    row = walk.dual_updates(spark.createDataFrame([(0.3, 0.2)], "v_mean double, cov double"), 0.5, 1.0).first()
    assert np.allclose((row.beta_new, row.lambda_new), walk.dual_update(0.5, 1.0, 0.3, 0.2))


def test_iterations_resume(spark, tmp_path):
    add = lambda s, pool, i: pool.withColumn("x", F.col("x") + i + 1)
    start = spark.createDataFrame([(0,)], "x int")
    walk.run_iterations(spark, start, [add], 2, str(tmp_path / "s"))
    assert walk.run_iterations(spark, start, [add], 4, str(tmp_path / "s")).first().x == 10
    assert tables.saved_iterations(spark, str(tmp_path / "s")) == [0, 1, 2, 3]


def test_sources(spark, tmp_path):
    (tmp_path / "mixed.jsonl").write_text('{"model": "a", "score": 1}\n{\n  "model": "b{}",\n  "score": 2\n}{"model": "c", "score": 3}')
    assert {r.model for r in tables.read_mixed_json(spark, str(tmp_path / "mixed.jsonl"), tables.FINAL_RESULTS).collect()} == {"a", "b{}", "c"}
    (tmp_path / "r.json").write_text('[{"question": "q", "answer": "1", "score": 0.0}, {"average_score": 0.5}]')
    assert filters.without_trailer(tables.read_json_array(spark, str(tmp_path / "r.json"), tables.EVAL_RESULT)).count() == 1
    with pytest.raises(ValueError, match="nothing"):
        tables.publish(spark.range(0), str(tmp_path / "p"))
    tables.publish(spark.range(3), str(tmp_path / "p"))
    assert tables.read_split(spark, f"{tmp_path}/p@train").count() == 3
    said = tables.complete(spark.createDataFrame([(1, 0, "x")], "qid long, sample_idx int, prompt string"), lambda: lambda ps: [p.upper() for p in ps])
    assert said.first().response == "X"
    left, right = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b")], "k int, v string")
    with pytest.raises(Exception, match="differ"):
        tables.union_columns(left, right, "k").collect()


def test_stream_of_votes(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id, 0, 0) AS ts, id % 2 AS qid, id AS sample_idx, 'a' AS answer FROM range(8)")
    rows.write.parquet(str(tmp_path / "in"))
    events = stream.read_events(spark, str(tmp_path / "in"), rows.schema)
    stream.run_available(stream.windowed_votes(events), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 6  # the last two windows stay open


def test_boxed_groups_of_any_depth(spark):
    assert text.boxed_bodies(r"\boxed{a \boxed{b}} x \boxed{c{d}}") == [r"a \boxed{b}", "c{d}"]
    assert text.boxed_bodies(r"\boxed{a} \boxed{open {e") == ["a", "open {"] and text.boxed_bodies(None) == text.boxed_bodies("none") == []
    assert text.last_boxed_body(r"\boxed{a} then {b") == "a" and text.last_boxed_body(r"\boxed{a} \boxed{b") is None
    assert one(spark, r"\boxed{1} so \boxed{ a{b{c{d}}} }", text.challenger_answer, text.solver_answer, lambda c: text.last_boxed_any_depth(c, True))[:] == ("a{b{c{d}}}",) * 3
    assert one(spark, r"\boxed{}", text.solver_answer, lambda c: text.last_boxed_any_depth(c, True))[:] == ("", None)
    began = time.perf_counter()
    text.boxed_bodies(r"\boxed{" * 100_000), text.last_boxed_body(r"\boxed{" * 100_000)
    assert time.perf_counter() - began < 5


def _trees():
    """(LaTeX, value) of arithmetic expressions."""

    def join(made):
        sign, (a, x), (b, y) = made
        told = {"+": f"({a}+{b})", "-": rf"\left({a}-{b}\right)", "*": rf"({a})\cdot({b})", "/": rf"\frac{{{a}}}{{{b}}}", "i": f"({a})({b})", "%": rf"({a})\%"}[sign]
        value = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y if y and x is not None else None, "i": lambda: x * y, "%": lambda: x / 100}
        return told, None if x is None or y is None and sign != "%" else value[sign]()

    leaves = st.integers(0, 5000).map(lambda n: (f"{n:,}", Fraction(n)))
    return st.recursive(leaves, lambda inner: st.tuples(st.sampled_from("+-*/i%"), inner, inner).map(join), max_leaves=10)


@given(_trees())
@settings(max_examples=2000, deadline=None)
def test_number_of_any_expression(pair):
    said, value = pair
    assert text.number(said) == value and text.number(rf"\boxed{{{said}}}") == value
    if value is not None:
        assert text.number(text.infix(said)) == value


def test_expressions():
    for said, value in {r"\sqrt2": 2**0.5, r"2\sqrt{4}": 4, "2^10": 1024, r"2^{-1}": 0.5, r"45^{\circ}": 45, "90°": 90, "-2^2": -4, r"\$5": 5, "2pi": 2 * math.pi, "2**3": 8, "+".join(["1"] * 400): 400}.items():
        assert math.isclose(text.number(said), value), said
    for said in ("", "x+1", "1 2", "1/0", "(" * 5000, "2 +", r"\text{no}", r"\int x", None, "3)", "a_b"):
        assert text.number(said) is None, said
    assert text.infix(r"\frac{1}{2}x") == "((1/2)*x)" and text.infix(r"\int") is None


def test_estimators_by_name(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 2.0), ("b", 4.0)], "uid string, score double")
    assert sorted(r.advantage for r in advantage.advantages(df, "rloo", group="uid", score="score").collect()) == [-2.0, -1.0, 1.0, 2.0]
    base = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "uid string, baseline double")
    assert sorted(r.advantage for r in advantage.advantages(df, "remax", baselines=base).collect()) == [-1.0, -1.0, 0.0, 1.0]
    tokens = spark.createDataFrame([([0.0, 1.0], [0.5, 0.5], [1, 1])], "r array<double>, v array<double>, m array<int>")
    assert advantage.advantages(tokens, "gae", rewards="r", values="v").first()[3:] == ([0.5, 0.5], [1.0, 1.0])
    assert advantage.advantages(tokens, "reinforce_plus_plus", rewards="r", mask="m", gamma=0.5).first().advantage == [0.5, 1.0]
    with pytest.raises(ValueError):
        advantage.advantages(df, "other")


def test_position_ids_of_long_sequences(spark):
    mask = [int(i % 7 > 1) for i in range(5000)]
    df = spark.createDataFrame([(mask,), ([],), ([1],), ([0, 0, 1, 1],)], "m array<int>").coalesce(1)
    found = [r[0] for r in df.select(advantage.position_ids(F.col("m"))).collect()]
    assert found == [[max(int(x) - 1, 0) for x in np.cumsum(mask)], [], [0], [0, 0, 0, 1]]


@pytest.mark.parametrize("n", [1, 2, 4, 5, 11, 500])
def test_upper_median_over_ranges(spark, n):
    xs = np.random.default_rng(n).normal(size=n).round(1).tolist()
    assert stats.upper_median(spark.createDataFrame([(x,) for x in [*xs, None]], "x double").repartition(3), "x").first()[0] == sorted(xs)[n // 2]


def test_schedules_samples_and_topics(spark):
    assert [walk.schedule([1.0, 0.5], i) for i in (0, 1, 5)] == [1.0, 0.5, 0.5]
    assert math.isclose(walk.kl_coefficient(0.1, 6.0, 3.0, 10, 100), 0.1 * 1.02) and math.isclose(walk.kl_coefficient(0.1, 0.0, 3.0, 10, 100), 0.1 * 0.98)
    df = spark.range(100)
    one_, two = ([r.id for r in walk.sampled(d, "id", 10).collect()] for d in (df, df.repartition(7)))
    assert one_ == two and len(set(one_)) == 10 and one_ != [r.id for r in walk.sampled(df, "id", 10, seed=1).collect()]
    assert {r[0] for r in df.select(text.topic_of(F.col("id"))).collect()} == set(text.TOPICS)
    assert text.option_letter is not None and {r[0] for r in df.select(text.option_letter(F.lit("none"), F.col("id"))).collect()} == set("ABCDEFGHIJ")
    assert [r.score for r in filters.candidates_for_recheck(spark.createDataFrame([(0.0,), (0.5,), (None,)], "score double")).collect()] == [0.0]
    pool = spark.createDataFrame([(1, "a b c d e f g h"), (2, "x y z"), (3, None)], "id long, t string")
    assert [r.id for r in dedup.one_against(pool, "id", "t", "a b c d e f g i").collect()] == [1]


def test_energy_against_brute_force(spark):
    rows = [(i, t, (i % 10) / 10) for i, t in enumerate(["a b c d e f g h", "a b c d e f g i", "q r s t u v w", "a b c d e f g h", "x", "m n o p q r s t u v"])]
    df = spark.createDataFrame(rows, "id long, text string, r_unc double")
    own = dedup.written(dedup.classes(df, "id", "text"), "classes")
    degree = dedup.degrees(own, dedup.near_pairs(own)).join(own.select("id", "tokens"), "id")
    pool = df.withColumn("tokens", F.split("text", " ")).join(degree.drop("id"), "tokens").select("r_unc", "degree")
    toks = [r[1].split() for r in rows]
    near = lambda i, j: i == j or dedup.bleu(toks[min(i, j)], toks[max(i, j)]) > 0.5
    want = sum(max(0.0, r[2] - sum(near(i, j) for j in range(len(rows))) / len(rows)) for i, r in enumerate(rows))
    assert math.isclose(stats.energy(pool).first().energy, want)


def test_differencing_on_known_sets():
    """The largest differencing method on the textbook set, and never worse than half of greedy's spread on random ones."""
    parts = partition.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts) == [14, 16]


def test_readers_and_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b,\"c\"\nd")], "x long, y string")
    tables.write_json(df, f"{tmp_path}/j")
    tables.write_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    tables.append_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 4
    (tmp_path / "s_1.json").write_text('[{"x": 1, "y": "a"}, {"x": 2, "y": null}]')
    assert tables.read_shards(spark, f"{tmp_path}/s_*.json", "x long, y string").count() == 2
    assert tables.read_shards(spark, f"{tmp_path}/none_*.json", "x long, y string").count() == 0
    df.coalesce(1).write.csv(f"{tmp_path}/c", header=True, escape='"')
    assert sorted(map(tuple, tables.read_csv(spark, f"{tmp_path}/c", "x long, y string").collect())) == sorted(map(tuple, df.collect()))
    tables.write_metrics(df, f"{tmp_path}/m", 3)
    tables.write_samples(spark.range(50), f"{tmp_path}/p", 3, "id", 5)
    assert {r.step for r in spark.read.json(f"{tmp_path}/m").collect()} == {3} and spark.read.json(f"{tmp_path}/p").count() == 5
    timing = spark.createDataFrame([(1, "walk", 10), (1, "train", 5)], "iter int, phase string, seconds int")
    tables.write_timing(timing, f"{tmp_path}/t")
    assert tables.seconds_by_iteration(spark.read.schema("iter int, phase string, seconds int").csv(f"{tmp_path}/t", sep="\t")).first()[:] == (1, 15, 2)
    assert tables.checked_columns(df, "y string").columns == ["y"]
    with pytest.raises(TypeError):
        tables.checked_columns(df, "x string")


def test_files_are_consumed_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    run = lambda: tables.consume_once(spark, f"{tmp_path}/in", "x long").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(60)
    run()
    (tmp_path / "in" / "b.json").write_text('[{"x": 3}]')
    run()
    assert sorted(r.x for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]


def test_shaping_and_settings(spark):
    gsm = spark.createDataFrame([("q", "so 1 + 1 = 2 #### 2")], "question string, answer string")
    assert tables.shape_dataset(gsm, "gsm8k").first()[:] == ("q", "2")
    assert tables.shape_dataset(spark.createDataFrame([("q", "7")], "question string, answer string"), "amc").count() == 32
    settings_ = tables.merged(walk.WalkSettings(), {"beta": 0.1}, {"seed": 3})
    assert (settings_.beta, settings_.seed, settings_.samples) == (0.1, 3, 9)
    with pytest.raises(KeyError):
        tables.merged(walk.WalkSettings(), {"other": 1})


def test_model_calls_are_retried_and_fall_back(spark, tmp_path):
    path = str(tmp_path / "calls")

    def client():
        def call(prompts):
            with open(path, "a") as f:
                f.write("x")
            n = len(open(path).read())
            if n == 1:
                raise OSError("down")
            if n == 2:
                return ["too few"]
            if n == 3:
                time.sleep(3)
            return [p.upper() for p in prompts]

        return call

    prompts = spark.createDataFrame([(i, 0, f"p{i}") for i in range(3)], "qid long, sample_idx int, prompt string").coalesce(1)
    done = tables.complete(prompts, client, tries=4, wait=0.01, seconds=1.0)
    assert [r.response for r in done.collect()] == ["P0", "P1", "P2"]

    def broken():
        return lambda prompts: []

    assert {r.response for r in tables.complete(prompts, broken, tries=2, fallback="-1").collect()} == {"-1"}


def test_rewards_and_plugins(spark):
    from quorant.functions import rewards

    df = spark.createDataFrame([(r"<think>a</think> \boxed{3}", "3"), ("3", "3"), ("<think>a</think><answer> 3 </answer>", "3")], "r string, t string")
    found = [tuple(x[0]) for x in df.select(rewards.load("quorant.functions.rewards:math_reward")(F.col("r"), F.col("t"))).collect()]
    assert found[0] == (1.0, 1.0, 1.0) and found[1][2] == 0.0
    assert [tuple(x[0]) for x in df.select(rewards.answer_tag_reward(F.col("r"), F.col("t"))).collect()][2] == (1.0, 1.0, 1.0)
    batch = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "b long, x double")
    centred = rewards.apply_batch(batch, "b", lambda rows: rows.assign(x=rows["x"] - rows["x"].mean()), "b long, x double")
    assert sorted(r.x for r in centred.collect()) == [-1.0, 0.0, 1.0]


def test_optional_parts_hide_no_other_error():
    """A missing dependency of the training-data operators is an error; their absence is not."""
    import re
    from pathlib import Path

    source = (Path(__file__).parent.parent / "__spark_entry__.py").read_text()
    assert len(re.findall(r"except ImportError as error:\n    if error.name not in _OPTIONAL:\n        raise", source)) == 2


@pytest.mark.parametrize("corrected", [False, True])
def test_walk_carries_its_neighbours(spark, corrected):
    """Three steps with the neighbours carried along give the rows of three steps that compare all pairs, with and without the correction."""
    rng = np.random.default_rng(5)
    words = "a b c d e f g h".split()
    say = lambda: " ".join(rng.choice(words[:4], 5)) if rng.random() < 0.5 else " ".join(rng.choice(words, rng.integers(1, 8)))
    answers = lambda: rng.choice(["1", "2", "3"], 6).tolist()
    schema = "chain long, id long, text string, answers array<string>"
    plain = spark.createDataFrame([(i % 2, i, say(), answers()) for i in range(40)], schema)
    carried = walk.with_neighbours(plain)
    toks = {r.id: r.text.split() for r in plain.collect()}
    for r in carried.collect():
        want = [j for j in toks if j % 2 == r.id % 2 and (j == r.id or dedup.bleu(toks[min(j, r.id)], toks[max(j, r.id)]) > dedup.NEAR)]
        assert r.near == sorted(want)
    settings_ = walk.WalkSettings(beta=0.3, samples=5, corrected=corrected)
    accepted = 0
    for step in range(3):
        proposals = spark.createDataFrame([(i % 2, i, say(), answers()) for i in range(40) if rng.random() < 0.8], schema)
        plain = tables.written(walk.walk_step(plain.select(*schema.replace(" long", "").replace(" string", "").replace(" array<string>", "").split(", ")), proposals, step, settings_), "plain")
        carried = tables.written(walk.walk_step(carried.select("chain", "id", "text", "answers", "near"), proposals, step, settings_), "carried")
        key = lambda r: r.id
        a, b = sorted(plain.collect(), key=key), sorted(carried.collect(), key=key)
        assert [(r.text, r.answers, r.accepted) for r in a] == [(r.text, r.answers, r.accepted) for r in b]
        assert all(x.alpha is y.alpha is None or math.isclose(x.alpha, y.alpha) for x, y in zip(a, b))
        accepted += sum(bool(r.accepted) for r in a)
    assert 0 < accepted < 90


def test_micro_batches_of_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(g, i, int(rng.integers(1, 100))) for g in range(3) for i in range(50)]
    size = {(g, i): n for g, i, n in rows}
    found = partition.micro_batch_rows(spark.createDataFrame(rows, "g long, i long, n int"), "g", "i", "n", 400).collect()
    assert len(found) == len(rows)
    for g in range(3):
        sums = Counter()
        for r in found:
            if r.g == g:
                sums[r.micro_batch] += size[g, r.i]
        total = sum(n for h, _, n in rows if h == g)
        assert sorted(sums) == list(range(len(sums))) and len(sums) == -(-total // 400) and max(sums.values()) - min(sums.values()) <= 100


def test_batches_to_cluster_are_bounded(spark):
    df = spark.createDataFrame([(0, i, f"text {i}") for i in range(5)], "b long, i long, t string")
    assert dedup.cluster_share(df, "b", "i", "t", most=5).count() == 5
    with pytest.raises(Exception, match="at most 4"):
        dedup.cluster_share(df, "b", "i", "t", most=4).count()


def test_polluters_in_any_case(spark):
    said = ["MONGOCLIENT here", "see \\[最终答案", "clean", "a \\BOXED{} b", None, "[add] and User:"]
    df = spark.createDataFrame([(s,) for s in said], "t string").coalesce(1)
    found = df.select(text.is_polluted(F.col("t")), text.first_polluter(F.col("t"))).collect()
    assert [r[0] for r in found] == [True, True, False, True, None, True]
    assert [r[1] for r in found] == ["MONGOCLIENT", "\\[最终答案", None, "\\BOXED{}", None, "[add]"]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    asked = lambda master: tables.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master)))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(RuntimeError):
            asked(master)
    assert asked("local[4]").startswith("file:") and asked("local").startswith("file:")


def test_returns_of_long_and_empty_sequences(spark):
    r, m = [float(i * 7919 % 13) for i in range(5000)], [int(i % 11 != 7) for i in range(5000)]
    df = spark.createDataFrame([(0, r, m), (1, [], []), (2, [1.0, None, 2.0], [1, 1, 1]), (3, None, None)], "k int, r array<double>, m array<int>")
    got = [x[1] for x in df.select("k", advantage.discounted_returns(F.col("r"), F.col("m"), 0.99)).orderBy("k").collect()]
    run, want = 0.0, []
    for x, keep in zip(reversed(r), reversed(m), strict=True):
        want.append(x + 0.99 * run)
        run = want[-1] * keep
    assert np.allclose(got[0], want[::-1]) and got[1:] == [[], [None, None, 2.0], None]


def test_bleu_over_a_threshold(spark):
    texts = [["a b c d e f g h", "a b c d e f g h"], ["a b c d e f g h", "a b c d x f g h"], ["a b", "a b"], ["a", "b"], ["", "a"], ["a b c d e", "a b c d e f g h i j k"], ["x y z w v", "x y z w u"]]
    for hyp, ref in texts:
        whole = dedup.bleu(hyp.split(), ref.split())
        for above in (0.1, 0.3, 0.5, 0.7):
            assert (dedup.bleu(hyp.split(), ref.split(), above) > above) == (whole > above)
