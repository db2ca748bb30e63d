"""Filter cascades: the first stage that a row fails is its reason; survivors have none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SENTINELS, with_grade
from .vote import in_band


def cascade(df: DataFrame, stages: dict[str, Column], out: str = "reason") -> DataFrame:
    """`df` with `out`, the name of the first stage whose column is true (a drop), or null. Null conditions don't drop."""
    return df.withColumn(out, F.coalesce(*[F.when(bad, name) for name, bad in stages.items()]))


def survivors(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    return cascade(df, stages, "_reason").filter("_reason IS NULL").drop("_reason")


def funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """reason, n: rows that each stage drops, and `kept`."""
    return cascade(df, stages, "reason").groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def has_label(label: Column) -> Column:
    return F.coalesce(label.isNotNull() & ~label.isin(*SENTINELS[:2]), F.lit(False))


def training_rows(pool: DataFrame, low: float = 0.3, high: float = 0.8) -> DataFrame:
    """problem, answer, score of the pool's labelled rows within the band."""
    kept = pool.filter(in_band(F.col("p_hat"), low, high) & has_label(F.col("label")))
    return kept.select(F.col("question").alias("problem"), F.col("label").alias("answer"), F.col("p_hat").alias("score"))


def agreeing(ours: DataFrame, theirs: DataFrame, canonical=lambda c: F.replace(F.trim(c), F.lit(" "), F.lit(""))) -> DataFrame:
    """Rows of `ours` (qid, label) whose label equals theirs in canonical form: a semi-join on both keys."""
    key = lambda d: d.withColumn("_label", canonical(F.col("label")))
    return key(ours).join(key(theirs).select("qid", "_label"), ["qid", "_label"], "left_semi").drop("_label")


def agreeing_graded(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Rows of `ours` (qid, label) whose label the grader holds equal to theirs: an equi-join on qid, then the grader on labels that differ as text."""
    both = ours.join(theirs.select("qid", F.col("label").alias("_theirs")), "qid").filter("label IS NOT NULL AND _theirs IS NOT NULL")
    return with_grade(both, "label", "_theirs", "_grade").filter("_grade").select(*ours.columns)


def relabelled(stored: DataFrame, **labelers: DataFrame) -> DataFrame:
    """`stored` (qid, label, ...) with <name>_label, <name>_p_hat and <name>_matches of each labeler (qid, label, p_hat); without a label nothing matches."""
    canonical = lambda c: F.lower(F.replace(F.trim(c), F.lit(" "), F.lit("")))
    out = stored
    for name, votes in labelers.items():
        out = out.join(votes.select("qid", F.col("label").alias(f"{name}_label"), F.col("p_hat").alias(f"{name}_p_hat")), "qid", "left")
        out = out.withColumn(f"{name}_matches", F.coalesce(canonical(F.col(f"{name}_label")) == canonical(F.col("label")), F.lit(False)))
    return out


def pending(rows: DataFrame, score: str = "score") -> DataFrame:
    """Rows that no one has scored yet: their score is 0."""
    return rows.filter(F.col(score) == 0)


def finite(conf: Column) -> Column:
    return conf > float("-inf")


def candidates_for_recheck(graded: DataFrame, below: float = 0.5) -> DataFrame:
    return graded.filter(F.col("score") < below)


def without_trailer(rows: DataFrame) -> DataFrame:
    """Result rows without the trailing average, whether or not the file has one."""
    return rows.filter("average_score IS NULL") if "average_score" in rows.columns else rows


def fill_to(df: DataFrame, n: int, *arrival: str) -> DataFrame:
    """The first n rows in order of arrival (columns that end in a unique key)."""
    return df.orderBy(*arrival).limit(n)


def merge_back(rows: DataFrame, scored: DataFrame, key: str, score: str = "score", missing: float = -1.0) -> DataFrame:
    """All of `rows` with the score of those that were scored, `missing` for the others."""
    return rows.join(scored.select(key, score), key, "left").withColumn(score, F.coalesce(F.col(score), F.lit(missing)))
