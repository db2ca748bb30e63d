"""Rewards, divergences and clipped losses as Column functions, token by token."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uncertainty(p: Column) -> Column:
    """max(0, 1 - 2 |p - 0.5|)"""
    return F.greatest(F.lit(0.0), 1 - 2 * F.abs(p - 0.5))


def challenger_reward(score: Column, share: Column, question: Column) -> Column:
    """min(s, 1 - s), or -1 without a question, less the share of the question's cluster."""
    return F.when(F.coalesce(question, F.lit("")) != "", F.least(score, 1 - score)).otherwise(-1.0) - share


def divergence(log_p: Column, log_q: Column, kind: str = "kl") -> Column:
    """Estimators of KL(p, q) from log-probabilities of the sampled token; full: from arrays over the vocabulary."""
    d = log_p - log_q if kind != "full" else None
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return 0.5 * d * d
    if kind == "low_var_kl":
        return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(-d) + d - 1))
    if kind == "full":
        return F.aggregate(F.zip_with(log_p, log_q, lambda a, b: F.exp(a) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    raise ValueError(f"unknown divergence {kind}")


def policy_loss(old: Column, new: Column, advantage: Column, low: float = 0.2, high: float = 0.3, dual: float = 3.0) -> dict[str, Column]:
    """Dual-clip loss of a token, whether it was clipped to higher and to lower, and the approximate divergence."""
    d = new - old
    clipped = F.exp(F.least(F.lit(math.log(1 + high)), F.greatest(F.lit(math.log(1 - low)), d)))
    free, bound, floor = -advantage * F.exp(d), -advantage * clipped, -advantage * dual
    upper = F.greatest(free, bound)
    return {
        "loss": F.when(advantage < 0, F.least(upper, floor)).otherwise(upper),
        "clipped_higher": (free < bound).cast("double"),
        "clipped_lower": ((upper > floor) & (advantage < 0)).cast("double"),
        "kl": -d,
    }


def value_loss(predicted: Column, returns: Column, values: Column, clip: float) -> dict[str, Column]:
    bound = F.least(values + clip, F.greatest(values - clip, predicted))
    free, held = (predicted - returns) * (predicted - returns), (bound - returns) * (bound - returns)
    return {"loss": 0.5 * F.greatest(free, held), "clipped": (free < held).cast("double")}


def masked_mean(x: Column, mask: Column) -> Column:
    """Aggregate: sum(x m) / (sum(m) + 1e-8)."""
    return F.sum(x * mask) / (F.sum(mask) + 1e-8)


def acceptance(delta: Column, beta: Column) -> Column:
    """min(1, exp(delta / beta)), without overflow."""
    return F.exp(F.least(F.lit(0.0), delta / beta))


def penalised_acceptance(delta: Column, variance: Column, beta: Column) -> Column:
    return F.exp(F.least(F.lit(0.0), delta / beta - variance / (2 * beta * beta)))


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("long")
