"""Votes over sampled answers: a long table (qid, sample_idx, answer) in, one row per question out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.losses import uncertainty
from ..functions.text import known_equal


def majority(votes: DataFrame, invalid: tuple[str, ...] = (), denominator: str = "all", keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """qid, label, n_votes, n_samples, p_hat, r_unc.

    Exact strings; nulls and `invalid` strings don't vote; ties go to the answer seen first by
    sample_idx. p_hat divides by all samples, or with denominator="nonempty" by those that vote.
    Two hash aggregates, partial map-side: (question, answer), then question.
    """
    valid = F.col("answer").isNotNull() & ~F.col("answer").isin(*invalid) if invalid else F.col("answer").isNotNull()
    counted = votes.groupBy(*keys, F.when(valid, F.col("answer")).alias("answer")).agg(F.count("*").alias("n"), F.min("sample_idx").alias("first"))
    voted = F.col("answer").isNotNull()
    best = F.max(F.when(voted, F.struct("n", (-F.col("first")).alias("early"), "answer")))
    total = F.sum("n") if denominator == "all" else F.sum(F.when(voted, F.col("n")))
    out = counted.groupBy(*keys).agg(best.alias("best"), total.alias("n_samples"))
    p = F.coalesce(F.try_divide(F.col("best.n").cast("double"), F.col("n_samples")), F.lit(0.0))
    return out.select(*keys, F.col("best.answer").alias("label"), F.coalesce("best.n", F.lit(0)).cast("long").alias("n_votes"), F.coalesce("n_samples", F.lit(0)).cast("long").alias("n_samples"), p.alias("p_hat"), uncertainty(p).alias("r_unc"))


def replicate(questions: DataFrame, m: int) -> DataFrame:
    """Each question m times, with sample_idx."""
    return questions.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))


def first_samples(votes: DataFrame, m: int, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    nth = F.row_number().over(W.partitionBy(*keys).orderBy("sample_idx"))
    return votes.withColumn("_nth", nth).filter(F.col("_nth") <= m).drop("_nth")


def same_answer(a: str, b: str) -> bool:
    """Equal, both a negation in either case, or equal in value."""
    return a == b or ("no " in a.lower() and "no " in b.lower()) or bool(known_equal(a, b))


def equivalence_vote(votes: DataFrame, same: Callable[[str, str], bool] = same_answer, denominator: str = "nonempty") -> DataFrame:
    """qid, label, n_votes, n_samples, p_hat by greedy classes of equivalent answers.

    Answers join the first class, in order of sample_idx, whose representative (its first
    member) is the same; the relation need not be transitive, so order is part of the result.
    A question's distinct answers with counts and first places are enough, so repeats are
    aggregated before they reach Python.
    """
    answers = votes.groupBy("qid", "answer").agg(F.count("*").alias("n"), F.min("sample_idx").alias("first"))

    lists = answers.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("first", "answer", "n"))).alias("told"))
    # Questions reach Python as rows of arrays, many at once.
    lists = lists.select("qid", F.col("told.answer").alias("answers"), F.col("told.n").alias("counts"))

    def decide(answers: list[str | None], counts: list[int]) -> tuple[str | None, int, int, float]:
        classes: list[list] = []
        told = [(a, n) for a, n in zip(answers, counts, strict=True) if a]
        for answer, n in told:
            home = next((c for c in classes if same(answer, c[0]) or same(c[0], answer)), None)
            if home:
                home[1] += n
            else:
                classes.append([answer, n])
        best = max(classes, key=lambda c: c[1], default=[None, 0])
        samples = sum(counts) if denominator == "all" else sum(n for _, n in told)
        return best[0], best[1], samples, best[1] / samples if samples else 0.0

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [decide(a.as_py(), n.as_py()) for a, n in zip(b.column(1), b.column(2), strict=True)]
            label, votes, samples, p = zip(*found, strict=True) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label, pa.string()), pa.array(votes, pa.int64()), pa.array(samples, pa.int64()), pa.array(p, pa.float64())], names=["qid", "label", "n_votes", "n_samples", "p_hat"])

    kind = answers.schema["qid"].dataType.simpleString()
    return lists.mapInArrow(group, f"qid {kind}, label string, n_votes long, n_samples long, p_hat double")


def majority_confidence(votes: DataFrame, labels: DataFrame, logprob: str = "mean_logprob") -> DataFrame:
    """qid, conf: mean log-probability of the samples that agree with the label; null if none does."""
    agreeing = votes.join(labels.select("qid", "label"), "qid").filter(F.col("answer") == F.col("label"))
    return labels.select("qid").join(agreeing.groupBy("qid").agg(F.avg(logprob).alias("conf")), "qid", "left")


def in_band(p: Column, low: float = 0.3, high: float = 0.8) -> Column:
    return p.between(low, high)
