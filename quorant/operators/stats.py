"""Grouped statistics and reports over graded rows, pools and token batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import FAIL_FORMAT
from ..sources.tables import written

# The seven sets of a report row, in order, and the five hard ones.
SEVEN_SETS = ["math", "gsm8k", "amc", "minerva", "olympiad", "aime2024", "aime2025"]
HARD_SETS = ["amc", "minerva", "olympiad", "aime2024", "aime2025"]


def energy(pool: DataFrame, weight: float = 1.0) -> DataFrame:
    """Sum over a pool (r_unc, degree) of max(0, r_unc - weight * degree / N); the degree counts the row itself."""
    n = pool.agg(F.count("*").alias("n"))
    return pool.crossJoin(F.broadcast(n)).agg(F.sum(F.greatest(F.lit(0.0), F.col("r_unc") - weight * F.col("degree") / F.col("n"))).alias("energy"))  # one row


def _times(p: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Row by row, the product of two series, to the same number of terms."""
    out = np.zeros_like(p)
    for j in range(p.shape[1]):
        out[:, j:] += f[:, j : j + 1] * p[:, : p.shape[1] - j]
    return out


def _without(p: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Row by row, the series that times `f`, which begins with 1, gives `p`."""
    out = p.copy()
    for j in range(1, p.shape[1]):
        for i in range(1, j + 1):
            out[:, j] -= f[:, i] * out[:, j - i]
    return out


class _Largest:
    """How many m-subsets of samples have a largest class of at most 0, 1, ... m members.

    That is the coefficient of x^m in a product with one factor for each class, the sum of C(n, j) x^j over the j
    it may have, and one for the samples that don't vote. A sample is left out by dividing its class's factor out and
    multiplying by that of a class one smaller. Counts are integers throughout, so division is exact.
    """

    def __init__(self, classes: list[int], silent: int, m: int):
        self.m, self.classes, self.silent = m, classes, silent
        n = sum(classes) + silent
        self.kind = np.int64 if comb(n, min(m, n // 2)) < 1 << 63 else object
        product = self.factor(silent, False)
        for c in classes:
            product = _times(product, self.factor(c, True))
        self.product = product

    def factor(self, n: int, votes: bool) -> np.ndarray:
        """A row for each bound on the largest class."""
        whole = np.array([comb(n, j) for j in range(self.m + 1)], self.kind)
        rows = np.tile(whole, (self.m + 1, 1))
        if votes:
            rows[np.arange(self.m + 1)[None, :] > np.arange(self.m + 1)[:, None]] = 0
        return rows

    def mean(self, product: np.ndarray, n: int, utility: np.ndarray) -> float:
        upto = [int(x) for x in product[:, self.m]]
        total = comb(n, self.m)
        return sum(float(u) * ((a - b) / total) for u, a, b in zip(utility, upto, [0, *upto], strict=False))

    def left_out(self, n: int, votes: bool) -> np.ndarray:
        return _times(_without(self.product, self.factor(n, votes)), self.factor(n - 1, votes))


#: Answers that never vote.
SILENT = {"", FAIL_FORMAT}


def u_statistic(answers: list[str | None], share: float, m: int = 9) -> tuple[float, float]:
    """Mean over all m-subsets of max(0, r_unc(p) - share), p the share of the subset's majority; and its delete-one jackknife variance. (0, 0) below m answers.

    Null, empty and formless answers are samples but never vote.
    """
    n = len(answers)
    if n < m:
        return 0.0, 0.0
    counts = Counter(a for a in answers if a is not None and a not in SILENT)
    p = np.arange(m + 1) / m
    utility = np.maximum(0.0, np.maximum(0.0, 1 - 2 * np.abs(p - 0.5)) - share)
    largest = _Largest(list(counts.values()), n - counts.total(), m)
    mean = largest.mean(largest.product, n, utility)
    if n == m:
        return mean, 0.0
    # Left-out samples of classes of one size all give the same mean.
    sizes = Counter(counts.values())
    means = [(c * times, largest.mean(largest.left_out(c, True), n - 1, utility)) for c, times in sizes.items()]
    if largest.silent:
        means.append((largest.silent, largest.mean(largest.left_out(largest.silent, False), n - 1, utility)))
    centre = sum(k * x for k, x in means) / n
    return mean, (n - 1) / n * sum(k * (x - centre) ** 2 for k, x in means)


def u_statistics(votes: DataFrame, m: int = 9) -> DataFrame:
    """qid, u, variance from (qid, sample_idx, answer, share). A group is one question's samples."""

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sample_idx")
        u, v = u_statistic([None if pd.isna(a) else a for a in rows["answer"]], float(rows["share"].iloc[0]), m)
        return pd.DataFrame({"qid": [rows["qid"].iloc[0]], "u": [u], "variance": [v]})

    return votes.groupBy("qid").applyInPandas(group, f"qid {votes.schema['qid'].dataType.simpleString()}, u double, variance double")


def accuracy(graded: DataFrame, *keys: str) -> DataFrame:
    return graded.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("n_correct"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def micro_macro(graded: DataFrame, category: str) -> DataFrame:
    """Counts by category, then micro (all rows) and macro (mean of the non-empty categories) accuracy."""
    by = accuracy(graded, category)
    return by.agg(F.sum("n_correct").alias("n_correct"), F.sum("n").alias("n"), F.count("*").alias("n_categories"), (F.sum("n_correct") / F.sum("n")).alias("micro"), F.avg("accuracy").alias("macro"))


def monotone_recheck(graded: DataFrame, says_yes: str, *keys: str) -> DataFrame:
    """Averages before and after, where only rows below 0.5 may rise, to 1."""
    bumped = F.when((F.col("score") < 0.5) & F.coalesce(F.col(says_yes), F.lit(False)), 1.0).otherwise(F.col("score"))
    return graded.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((bumped > F.col("score")).cast("long")).alias("bumps"), F.avg("score").alias("raw"), F.avg(bumped).alias("rechecked"))


def dual_grade(graded: DataFrame, says_yes: str, *keys: str) -> DataFrame:
    """Percentages with two decimals: raw, ours ((n raw + bumps) / n); what a failed grader left open is counted, not graded."""
    out = monotone_recheck(graded, says_yes, *keys)
    errors = graded.groupBy(*keys).agg(F.count_if(F.col(says_yes).isNull() & (F.col("score") < 0.5)).alias("grader_errors"))
    pct = lambda c: F.floor(10000 * c + F.lit(0.5)) / 100
    out = out.select(*keys, "n", pct(F.col("raw")).alias("raw"), pct((F.col("n") * F.col("raw") + F.col("bumps")) / F.col("n")).alias("ours"))
    return out.join(errors, list(keys)) if keys else out.crossJoin(F.broadcast(errors))  # one row each


def report_grid(scores: DataFrame, rows: str, columns: str, value: str, names: list[str]) -> DataFrame:
    """A row for each of `rows`, a column for each of `names` (null if missing) and the mean of those present."""
    wide = scores.groupBy(rows).pivot(columns, names).agg(F.first(value))
    present = F.array_compact(F.array(*[F.col(f"`{n}`") for n in names]))
    total = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
    return wide.withColumn("mean", F.try_divide(total, F.size(present)))


def quintile(df: DataFrame, order: list[Column], parts: int = 5, out: str = "part") -> DataFrame:
    """Equal parts of n div parts rows by `order` (which must end in a unique key); the last takes the rest.

    The rank is a range partition's offset plus a row number within it, so no task holds the whole table.
    """
    ranked = with_rank(df, order)
    n = ranked.agg(F.count("*").alias("_n"))
    size = F.greatest(F.expr(f"_n div {parts}"), F.lit(1))
    return ranked.crossJoin(F.broadcast(n)).withColumn(out, F.least(F.floor(F.col("_rank") / size), F.lit(parts - 1)).cast("int")).drop("_n", "_rank")  # one row


def with_rank(df: DataFrame, order: list[Column], out: str = "_rank") -> DataFrame:
    """Global 0-based rank by `order`: range partitions, their counts, and a row number within each."""
    # Written before it is read twice: the partition ids must be those of one run.
    spread = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranks")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    first = spread.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))  # a row per partition
    nth = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return spread.withColumn("_nth", nth).join(first, "_part").withColumn(out, F.col("_first") + F.col("_nth")).drop("_part", "_first", "_nth")


def upper_median(df: DataFrame, x: str) -> DataFrame:
    """median_<x>: sorted[n // 2], not interpolated; from the counts of the distinct values, added up range by range as in `with_rank`."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("_c"))
    spread = written(counts.repartitionByRange(x).withColumn("_part", F.spark_partition_id()), "medians")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    first = spread.groupBy("_part").agg(F.sum("_c").alias("_s")).select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_first"))  # a row per partition
    upto = spread.join(first, "_part").withColumn("_upto", F.col("_first") + F.sum("_c").over(W.partitionBy("_part").orderBy(x)))
    upto = upto.crossJoin(F.broadcast(spread.agg(F.sum("_c").alias("_n"))))  # one row
    return upto.filter(F.expr("_upto > _n div 2")).agg(F.min(x).alias(f"median_{x}"))


def by_majority_count(rows: DataFrame, votes: str = "n_votes", correct: str = "correct", logprob: str = "logprob") -> DataFrame:
    """n, n_correct, accuracy and mean log-probability of the questions of each size of majority."""
    return rows.groupBy(votes).agg(
        F.count("*").alias("n"),
        F.sum(F.col(correct).cast("long")).alias("n_correct"),
        F.avg(F.col(correct).cast("double")).alias("accuracy"),
        F.avg(logprob).alias("mean_logprob"),
    )


def regrade_records(graded: DataFrame, ours: str, paper: str, *keys: str) -> DataFrame:
    """n and percentages with two decimals: raw, and with the rows below 0.5 that either grader accepts counted as right."""
    bumps = lambda c: F.count_if((F.col("score") < 0.5) & F.coalesce(F.col(c), F.lit(False)))
    pct = lambda c: F.floor(10000 * c + F.lit(0.5)) / 100
    raw, n = F.avg("score"), F.count("*")
    out = graded.groupBy(*keys).agg(n.alias("n"), raw.alias("raw"), bumps(ours).alias("ours"), bumps(paper).alias("paper"))
    return out.select(*keys, "n", pct(F.col("raw")).alias("raw"), *[pct((F.col("n") * F.col("raw") + F.col(c)) / F.col("n")).alias(c) for c in ("ours", "paper")])


def alignment(rows: DataFrame, label: str, stored: str, p: str) -> DataFrame:
    """n, matches, rate, rows without a label, mean and upper median of p."""
    return rows.agg(  # one row beside one row
        F.count("*").alias("n"),
        F.count_if(F.col(label) == F.col(stored)).alias("n_match"),
        F.count_if(F.col(label).isNull()).alias("n_none"),
        F.avg(p).alias("mean_p"),
    ).crossJoin(F.broadcast(upper_median(rows, p))).withColumn("match_rate", F.col("n_match") / F.greatest("n", F.lit(1)))


def histogram(df: DataFrame, x: str, bins: int = 11) -> DataFrame:
    """bin, n: equal widths from least to greatest, the last bin closed."""
    ends = df.agg(F.min(x).alias("_a"), F.max(x).alias("_b"))
    at = F.when(F.col("_a") == F.col("_b"), F.lit(bins // 2)).otherwise(F.least(F.floor((F.col(x) - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1)))
    return df.filter(F.col(x).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # one row


def rounded_counts(df: DataFrame, x: str, digits: int = 2) -> DataFrame:
    return df.groupBy(F.bround(x, digits).alias(x)).agg(F.count("*").alias("n"))


def confusion(df: DataFrame, truth: str, said: str) -> DataFrame:
    """Positive: invalid. Columns are booleans; a null verdict is ambiguous and counts as not invalid."""
    t, s = F.col(truth), F.coalesce(F.col(said), F.lit(False))
    out = df.agg(F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"), F.count_if(~t & ~s).alias("tn"))
    safe = lambda a, b: F.expr(a) / F.greatest(F.expr(b), F.lit(1))
    return out.select("*", safe("tp", "tp + fn").alias("recall"), safe("tp", "tp + fp").alias("precision"), safe("tp + tn", "tp + fp + fn + tn").alias("accuracy"))


def recall_by(df: DataFrame, kind: str, truth: str, said: str) -> DataFrame:
    caught = F.coalesce(F.col(said), F.lit(False))
    return df.filter(F.col(truth)).groupBy(kind).agg(F.count("*").alias("n"), F.count_if(caught).alias("caught"), F.avg(caught.cast("double")).alias("recall"))


def chunk_statistics(rows: DataFrame, rank: str, n: int, chunk: int, inside: Column, reward: Column) -> DataFrame:
    """chunk_id, n, v (share inside), r (sum of max(0, reward)): max(2, n // chunk) chunks by rank, the last takes the rest, those below two rows are left out."""
    chunks = max(2, n // chunk)
    at = F.least(F.floor(F.col(rank) / chunk), F.lit(chunks - 1)).cast("long")
    out = rows.groupBy(at.alias("chunk_id")).agg(F.count("*").alias("n"), F.avg(inside.cast("double")).alias("v"), F.sum(F.greatest(F.lit(0.0), reward)).alias("r"))
    return out.filter("n >= 2")


def chunk_energies(rows: DataFrame, weight: float = 1.0, low: float = 0.3, high: float = 0.8) -> DataFrame:
    """chunk_id, n, v, r of rows (chunk_id, r_unc, degree): the share of r_unc within the band, and the sum of max(0, r_unc - weight * degree / n)."""
    sizes = rows.groupBy("chunk_id").agg(F.count("*").alias("n"))
    held = rows.join(sizes, "chunk_id")
    kept = F.greatest(F.lit(0.0), F.col("r_unc") - weight * F.col("degree") / F.col("n"))
    return held.groupBy("chunk_id", "n").agg(F.avg(F.col("r_unc").between(low, high).cast("double")).alias("v"), F.sum(kept).alias("r")).filter("n >= 2")


def covariance(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("k"), F.avg("v").alias("v_mean"), F.avg("r").alias("r_mean"), F.coalesce(F.covar_samp("v", "r"), F.lit(0.0)).alias("cov"))


def batch_metrics(rows: DataFrame, longest: int) -> DataFrame:
    """mean, max, min of scores and lengths, and the share of rows at the longest length, of (score, length) rows."""
    three = lambda c: [f(c).alias(f"{c}_{n}") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    return rows.agg(*three("score"), *three("length"), F.avg((F.col("length") >= longest).cast("double")).alias("clip_ratio"))


def token_metrics(tokens: DataFrame, **measures: Column) -> DataFrame:
    """mean, max and min of each measure over the tokens whose mask is 1, as <name>_mean and so on."""
    three = [f(c).alias(f"{name}_{n}") for name, c in measures.items() for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    return tokens.filter("mask = 1").agg(*three)


def batch_divergence(tokens: DataFrame, sequence: str, kl: str) -> DataFrame:
    """kl: the mean over sequences of the mean over their tokens whose mask is 1. Partial sums of a sequence are added before they are shuffled."""
    m = F.col("mask").cast("double")
    own = tokens.groupBy(sequence).agg((F.sum(F.col(kl) * m) / (F.sum(m) + 1e-8)).alias("own"))
    return own.agg(F.avg("own").alias("kl"))


def explained_variance(tokens: DataFrame) -> DataFrame:
    return tokens.filter("mask = 1").agg((1 - F.var_samp(F.col("ret") - F.col("value")) / (F.var_samp("ret") + 1e-5)).alias("explained_variance"))


def time_per_token(sections: DataFrame, tokens: DataFrame) -> DataFrame:
    """section, ms_per_token from (section, basis, seconds) and (basis, n_tokens)."""
    return sections.join(tokens, "basis").select("section", (F.col("seconds") * 1000 / F.col("n_tokens")).alias("ms_per_token"))


def imbalance(rows: DataFrame, part: str, length: str) -> DataFrame:
    sums = rows.groupBy(part).agg(F.sum(length).alias("s"))
    return sums.agg(F.min("s").alias("least"), F.max("s").alias("most"), (F.max("s") - F.min("s")).alias("spread"), F.avg("s").alias("mean"))


def flops(lengths: DataFrame, parameters: int, layers: int, width: int) -> DataFrame:
    """Training operations of a decoder: 6 per parameter and token, 12 per layer, width and squared length."""
    return lengths.agg((6.0 * parameters * F.sum("length") + 12.0 * layers * width * F.sum(F.col("length") * F.col("length"))).alias("flops"))


def coverage(df: DataFrame, label: str) -> DataFrame:
    return df.agg((100.0 * F.count_if(F.col(label).isNotNull()) / F.greatest(F.count("*"), F.lit(1))).alias("coverage"))


def difficulty_bands(df: DataFrame, p: str, *keys: str, low: float = 0.3, high: float = 0.8) -> DataFrame:
    c = F.col(p)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((c < low).cast("double")).alias("hard"), F.avg(c.between(low, high).cast("double")).alias("inside"), F.avg((c > high).cast("double")).alias("easy"), F.avg(c).alias("mean_p"))


def judged_accuracy(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.col("correct").cast("double")).alias("acc"), F.count("correct").alias("n_judged"), F.count("*").alias("n"))


def validated(rows: DataFrame, idx: str, n: int, divisor: int, score: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """key, n and the mean of each of its metrics, after scoring `rows` padded to whole batches; key null: all rows together.

    `score` gives the rows back with the array-free double columns reward and any others named metric_*.
    """
    from .partition import pad_to_divisor, unpad

    scored = unpad(score(pad_to_divisor(rows, idx, n, divisor)))
    metrics = ["reward", *(c for c in scored.columns if c.startswith("metric_"))]
    return scored.groupingSets([[key], []], key).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])


def mean_metrics(lists: DataFrame, *names: str) -> DataFrame:
    """One row: the mean over all values of each array column."""
    return lists.agg(*[F.try_divide(F.sum(F.aggregate(n, F.lit(0.0), lambda a, x: a + x)), F.sum(F.size(n))).alias(n) for n in names])
