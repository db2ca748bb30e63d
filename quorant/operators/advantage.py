"""Group-relative and sequence advantages.

Row-level estimators take (uid, score) rows; sequence estimators take arrays of
a row's tokens and run as higher-order functions inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def grpo(df: DataFrame, group: str = "uid", score: str = "score", eps: float = 1e-6, strict: bool = False) -> DataFrame:
    """(s - mean) / (std + eps) in each group of two or more; with strict, smaller groups are an error."""
    w = W.partitionBy(group)
    out = df.withColumn("_k", F.count(score).over(w))
    out = out.filter(F.when(F.col("_k") > 1, True).otherwise(F.raise_error(F.lit("group of one")).cast("boolean"))) if strict else out.filter("_k > 1")
    return out.withColumn("advantage", (F.col(score) - F.avg(score).over(w)) / (F.stddev_samp(score).over(w) + eps)).drop("_k")


def rloo(df: DataFrame, group: str = "uid", score: str = "score") -> DataFrame:
    """s minus the mean of the others in its group."""
    w = W.partitionBy(group)
    held = df.withColumns({"_k": F.count(score).over(w), "_sum": F.sum(score).over(w)}).filter("_k > 1")
    return held.withColumn("advantage", F.col(score) - (F.col("_sum") - F.col(score)) / (F.col("_k") - 1)).drop("_k", "_sum")


def remax(df: DataFrame, baselines: DataFrame, group: str = "uid", score: str = "score") -> DataFrame:
    return df.join(baselines.select(group, "baseline"), group).withColumn("advantage", F.col(score) - F.col("baseline")).drop("baseline")


def _backward(xs: Column, factors: Column) -> Column:
    """v[i] = x[i] + factor[i] * v[i + 1], 0 after the end; by doubling, so that n values cost n log n."""
    later = lambda z, i, name: F.when(i < F.size(z), F.get(z, i)[name]).otherwise(0.0)

    def joined(z: Column, k: Column) -> Column:
        # Before: v[i] = x[i] + f[i] * v[i + k]. After: the same with 2k.
        return F.transform(z, lambda p, i: F.struct((p["x"] + p["f"] * later(z, i + k, "x")).alias("x"), (p["f"] * later(z, i + k, "f")).alias("f")))

    def summed(pairs: Column) -> Column:
        spans = F.filter(F.array(*[F.lit(1 << j) for j in range(31)]), lambda k: k < F.size(pairs))
        return F.transform(F.aggregate(spans, pairs, joined), lambda p: p["x"])

    pairs = F.zip_with(xs, factors, lambda x, f: F.struct(x.cast("double").alias("x"), f.cast("double").alias("f")))
    # Bound once: what a lambda refers to outside itself is evaluated for each of its elements.
    return F.transform(F.array(pairs), summed)[0]


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Reversed discounted sums; the running value, not the written one, is masked."""
    return _backward(rewards, F.transform(mask, lambda _, i: gamma * F.coalesce(F.get(mask, i + 1).cast("double"), F.lit(0.0))))


def gae(rewards: Column, values: Column, gamma: float = 1.0, lam: float = 1.0) -> tuple[Column, Column]:
    """Advantages and returns (advantages + values) of a token sequence; the value after the end is 0. An empty sequence has none."""
    after = F.slice(F.concat(values, F.array(F.lit(0.0))), 2, F.greatest(F.size(values), F.lit(0)))
    delta = F.zip_with(F.zip_with(rewards, after, lambda r, n: r + gamma * n), values, lambda d, v: d - v)
    advantages = _backward(delta, F.array_repeat(F.lit(gamma * lam), F.size(values)))
    return advantages, F.zip_with(advantages, values, lambda a, v: a + v)


def whiten(df: DataFrame, x: str, mask: str, out: str = "whitened") -> DataFrame:
    """Masked whitening of rows over the whole table: one aggregate, joined back as a single row."""
    m, v = F.col(mask).cast("double"), F.col(x)
    n = F.sum(m)
    stats = df.agg((F.sum(v * m) / (n + 1e-8)).alias("_mean"), n.alias("_n"), F.sum(v * v * m).alias("_sq"), F.sum(v * m).alias("_s"))
    spread = F.greatest((F.col("_sq") - 2 * F.col("_mean") * F.col("_s") + F.col("_mean") * F.col("_mean") * F.col("_n")) / (F.col("_n") + 1e-8), F.lit(0.0)) * F.col("_n") / F.greatest(F.col("_n") - 1, F.lit(1.0))
    whole = stats.select("_mean", F.sqrt(spread + 1e-8).alias("_sd"))
    return df.crossJoin(F.broadcast(whole)).withColumn(out, (v - F.col("_mean")) / F.col("_sd")).drop("_mean", "_sd")  # one row


def response_mask(tokens: Column, eos: Column) -> Column:
    """1 up to and including the first end token."""
    end = F.coalesce(F.nullif(F.array_position(tokens, eos), F.lit(0)), F.size(tokens).cast("long"))
    return F.transform(tokens, lambda _, i: (i < end).cast("int"))


def response_mask_rows(df: DataFrame, group: str, order: str, is_eos: Column) -> DataFrame:
    before = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("mask", (F.coalesce(F.sum(is_eos.cast("int")).over(before), F.lit(0)) == 0).cast("int"))


def running_sums(xs: Column) -> Column:
    """Running sums of an array of integers: each pass joins windows twice as long as the one before, so n values cost n log n."""

    def joined(k: int) -> Callable[[Column], Column]:
        return lambda a: F.when(F.size(a) <= k, a).otherwise(F.transform(a, lambda x, i: x + F.when(i >= k, F.get(a, i - k)).otherwise(0)))

    for k in (1 << j for j in range(24)):
        xs = F.transform(F.array(xs), joined(k))[0]
    return xs


def position_ids(mask: Column) -> Column:
    return F.transform(running_sums(F.transform(mask, lambda x: x.cast("int"))), lambda x: F.greatest(x - 1, F.lit(0)))


def outcome_rewards(score: Column, mask: Column) -> Column:
    """The score at the last valid token, 0 elsewhere."""
    last = F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int")) - 1
    return F.transform(mask, lambda _, i: F.when(i == last, score.cast("double")).otherwise(0.0))


def penalised_rewards(scores: Column, kl: Column, mask: Column, beta: float) -> Column:
    return F.zip_with(scores, F.zip_with(kl, mask, lambda k, m: k * m), lambda s, k: s - beta * k)


ESTIMATORS = {"grpo": grpo, "rloo": rloo, "remax": remax}
SEQUENCE_ESTIMATORS = {"reinforce_plus_plus": discounted_returns, "gae": gae}


def advantages(df: DataFrame, estimator: str, **columns: str) -> DataFrame:
    """`df` with `advantage` by the estimator of this name; `columns` names the estimator's inputs.

    grpo, rloo: group, score. remax: also baselines, a table. reinforce_plus_plus: rewards, mask, gamma (arrays of a row's
    tokens; the advantage is the return). gae: rewards, values, gamma, lam; adds `returns` too.
    """
    if estimator in ESTIMATORS:
        return ESTIMATORS[estimator](df, **columns)
    if estimator not in SEQUENCE_ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator}")
    given = {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    found = SEQUENCE_ESTIMATORS[estimator](**given)
    if estimator != "gae":
        return df.withColumn("advantage", found)
    # The returns from the advantages' column, which is then computed once.
    return df.withColumn("advantage", found[0]).withColumn("returns", F.zip_with("advantage", given["values"], lambda a, v: a + v))
