"""Seeded Metropolis-Hastings walk over a pool, its schedules, and the resumable loop around it.

Proposals and scores of a step are a table, made in parallel; only acceptance
is sequential, in one group per chain. Every random number is a hash of (seed,
step, id), so a step gives the same result wherever and how often it runs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import save_state, saved_iterations, written
from .dedup import NearIndex, near_pairs, tokens_of
from .stats import SILENT, u_statistic


def uniform(seed: int, step: int | Column, key: Column) -> Column:
    """In [0, 1), from 53 bits of a hash."""
    step = F.lit(step) if isinstance(step, int) else step
    return F.pmod(F.xxhash64(F.lit(seed), step, key), F.lit(1 << 53)) / float(1 << 53)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def sampled(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows without replacement, those that hash first."""
    return shuffled(df, key, seed).limit(k)


def epoch(df: DataFrame, key: str, batch: int, seed: int | None = None, drop_last: bool = True) -> DataFrame:
    """`df` with batch_id, in order of key or, with a seed, of its hash."""
    from .stats import with_rank

    order = [F.col(key)] if seed is None else [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)]
    out = with_rank(df, order).withColumn("batch_id", F.floor(F.col("_rank") / batch))
    if drop_last:
        out = out.filter(F.col("batch_id") < df.count() // batch)
    return out.drop("_rank")


def top_half(df: DataFrame, score: str, key: str) -> DataFrame:
    """The better max(1, n div 2) rows by score, ties by key; rows without a finite score are left out first."""
    from .stats import with_rank

    held = df.filter(F.col(score).isNotNull() & (F.col(score) > float("-inf")))
    ranked = with_rank(held, [F.desc(score), F.col(key)])
    return ranked.crossJoin(F.broadcast(held.agg(F.count("*").alias("_n")))).filter("_rank < greatest(1, _n div 2)").drop("_n", "_rank")  # one row


@dataclass(frozen=True)
class WalkSettings:
    weight: float = 1.0
    beta: float = 0.05
    seed: int = 7
    samples: int = 9
    corrected: bool = False


def walk_step(pool: DataFrame, proposals: DataFrame, step: int, settings: WalkSettings = WalkSettings()) -> DataFrame:
    """One step of every chain.

    pool: chain, id, text, answers (array of samples); proposals: chain, id, text, answers, at most one for an
    id. Returns the pool with accepted proposals in place, `accepted` and `alpha`, null where nothing was
    proposed. Energy is the sum of max(0, r_unc - weight * degree / N); a proposal changes its own row's
    uncertainty and every degree that its near texts have. Proposals equal to the incumbent are skipped.
    With settings.corrected, utilities are U-statistics and alpha takes their variance off.

    If the pool has a column near (ids of the texts near a text, itself included, as `with_neighbours` makes it), it is
    carried along; without it a chain finds its own. A proposal meets its chain through an index of 4-grams that follows
    what is accepted.
    """
    carried = "near" in pool.columns
    new = proposals.select("chain", "id", F.col("text").alias("new_text"), F.col("answers").alias("new_answers"), uniform(settings.seed, step, F.col("id")).alias("draw"), F.xxhash64(F.lit(settings.seed + 1), F.lit(step), "id").alias("turn"))
    own, new = pool.select("chain", "id", "text", "answers", *(["near"] if carried else [])), new.filter("chain IS NOT NULL AND id IS NOT NULL")

    def utility(answers: list[str], share: float) -> tuple[float, float]:
        if settings.corrected:
            return u_statistic(list(answers), share, settings.samples)
        told = [a for a in answers if a is not None and a not in SILENT]
        p = max((told.count(a) for a in set(told)), default=0) / max(1, len(answers))
        return max(0.0, max(0.0, 1 - 2 * abs(p - 0.5)) - share), 0.0

    def chain(rows: pd.DataFrame, proposed: pd.DataFrame) -> pd.DataFrame:
        # Rows and proposals meet here, so that their texts are shuffled once.
        rows = rows.sort_values("id").merge(proposed.drop(columns="chain"), on="id", how="left")
        n = len(rows)
        texts, answers = rows["text"].tolist(), [list(a) for a in rows["answers"]]
        tokens = [t.split() for t in texts]
        if carried:
            place = {k: i for i, k in enumerate(rows["id"].tolist())}
            near = [{i} | {place[k] for k in ks} for i, ks in enumerate(rows["near"])]
        else:
            near = [{i} for i in range(n)]
            later = NearIndex([])
            for i in reversed(range(n)):  # the lower id is the hypothesis
                for j in later.near(tokens[i]):
                    near[i].add(j)
                    near[j].add(i)
                later.add(i, tokens[i])
        index = NearIndex(tokens)
        value = lambda k: utility(answers[k], settings.weight * len(near[k]) / n)
        alphas: list[float | None] = [None] * n
        taken: list[bool | None] = [None] * n
        for k in rows.index[rows["new_text"].notna()][rows.loc[rows["new_text"].notna(), "turn"].argsort(kind="stable")]:
            text, said = rows.at[k, "new_text"], list(rows.at[k, "new_answers"])
            if text == texts[k]:
                continue
            hyp = text.split()
            now = {k} | index.near(hyp)
            touched = {k} | near[k] ^ now
            before = [value(j) for j in touched]
            old = near[k], answers[k]
            for j in (near[k] ^ now) - {k}:
                near[j] ^= {k}
            near[k], answers[k] = now, said
            after = [value(j) for j in touched]
            gain = sum(u for u, _ in after) - sum(u for u, _ in before)
            noise = sum(v for _, v in after) + sum(v for _, v in before)
            alphas[k] = math.exp(min(0.0, gain / settings.beta - noise / (2 * settings.beta**2)))
            taken[k] = bool(rows.at[k, "draw"] < alphas[k])
            if taken[k]:
                texts[k], tokens[k] = text, hyp
                index.remove(k)
                index.add(k, hyp)
            else:
                for j in (old[0] ^ now) - {k}:
                    near[j] ^= {k}
                near[k], answers[k] = old
        lists = lambda found: pd.Series(found, rows.index, object)  # noqa: E731  (also of a chain without rows)
        out = pd.DataFrame({"chain": rows["chain"], "id": rows["id"], "text": lists(texts), "answers": lists(answers)})
        if carried:
            ids = rows["id"].tolist()
            out["near"] = lists([[ids[j] for j in sorted(own)] for own in near])
        out["accepted"], out["alpha"] = pd.array(taken, "boolean"), pd.array(alphas, "Float64")
        return out

    return own.groupBy("chain").cogroup(new.groupBy("chain")).applyInPandas(chain, f"chain long, id long, text string, answers array<string>, {'near array<long>, ' if carried else ''}accepted boolean, alpha double")


def with_neighbours(pool: DataFrame) -> DataFrame:
    """`pool` (chain, id, text, ...) with near: the ids of its chain's texts near a text, itself included. One exact join of what meets in a chain; an id is in one chain only."""
    own = written(pool.select("id", tokens_of(F.col("text")).alias("tokens"), F.col("chain").alias("within")), "texts", "zstd")
    pairs = written(near_pairs(own), "pairs")
    ends = pairs.selectExpr("i AS id", "j AS other").unionByName(pairs.selectExpr("j AS id", "i AS other"))
    lists = ends.groupBy("id").agg(F.collect_set("other").alias("near"))
    return pool.join(lists, "id", "left").withColumn("near", F.array_sort(F.array_union(F.coalesce("near", F.array().cast("array<long>")), F.array(F.col("id").cast("long")))))


# Step sizes, bounds and number of micro-steps of the temperature update.
@dataclass(frozen=True)
class DualSettings:
    rate_beta: float = 0.1
    rate_lambda: float = 0.1
    beta_min: float = 0.02
    beta_max: float = 2.0
    delta: float = 0.5
    micro_steps: int = 20


def dual_update(beta: float, lam: float, v_mean: float, cov: float, s: DualSettings = DualSettings()) -> tuple[float, float]:
    """Projected gradient descent on beta and ascent on lambda, beta first."""
    for _ in range(s.micro_steps):
        beta = min(s.beta_max, max(s.beta_min, beta - s.rate_beta * (lam * cov / (beta * beta) - 1 / beta)))
        lam = max(0.0, lam + s.rate_lambda * (1 - v_mean - s.delta))
    return beta, lam


def dual_updates(df: DataFrame, beta: float, lam: float, s: DualSettings = DualSettings()) -> DataFrame:
    """The same as columns beta_new, lambda_new of rows (v_mean, cov), by a fold."""
    step = lambda a, _: F.transform(
        F.array(F.least(F.lit(s.beta_max), F.greatest(F.lit(s.beta_min), a["b"] - s.rate_beta * (a["l"] * F.col("cov") / (a["b"] * a["b"]) - 1 / a["b"])))),
        lambda b: F.struct(b.alias("b"), F.greatest(F.lit(0.0), a["l"] + s.rate_lambda * (1 - F.col("v_mean") - s.delta)).alias("l")),
    )[0]
    end = F.aggregate(F.sequence(F.lit(1), F.lit(s.micro_steps)), F.struct(F.lit(beta).alias("b"), F.lit(lam).alias("l")), step)
    return df.withColumn("_end", end).withColumns({"beta_new": F.col("_end.b"), "lambda_new": F.col("_end.l")}).drop("_end")


def schedules(iteration: Column, values: list[float], observed: Column, value: float, target: float, steps: int, horizon: int) -> tuple[Column, Column]:
    """`schedule` and `kl_coefficient` of each row."""
    at = F.element_at(F.array(*[F.lit(v) for v in values]), (F.least(iteration, F.lit(len(values) - 1)) + 1).cast("int"))
    error = F.least(F.lit(0.2), F.greatest(F.lit(-0.2), observed / target - 1))
    return at, value * (1 + error * steps / horizon)


def schedule(values: list[float], iteration: int) -> float:
    """The value of an iteration; the last one repeats."""
    return values[min(iteration, len(values) - 1)]


def kl_coefficient(value: float, observed: float, target: float, steps: int, horizon: int) -> float:
    """Adaptive controller: the relative error is clipped to 0.2."""
    return value * (1 + min(0.2, max(-0.2, observed / target - 1)) * steps / horizon)


Stage = Callable[[SparkSession, DataFrame, int], DataFrame]


def run_iterations(spark: SparkSession, start: DataFrame, stages: list[Stage], iterations: int, path: str) -> DataFrame:
    """Apply `stages` in turn, `iterations` times, writing each iteration's pool; a rerun goes on after the last one written.

    A variant of the loop is another list of stages.
    """
    done = saved_iterations(spark, path)
    at = max(done, default=-1)
    pool = spark.read.parquet(f"{path}/iter={at}") if done else start
    for i in range(at + 1, iterations):
        for stage in stages:
            pool = stage(spark, pool, i)
        save_state(pool, path, i)
        pool = spark.read.parquet(f"{path}/iter={i}")
    return pool
