"""Queries over the driver's tables, and the SQL that DuckDB can run for the same rows.

The tables hold no model outputs, so columns take roles: a user's events are the
samples of a question, event types its answers, labels are grades. Doubles are
compared after floor(x * 1e6 + 0.5) / 1e6, which both engines compute alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import losses, text
from ..operators import advantage, dedup, filters, partition, stats, vote, walk
from ..sources.tables import keep_newest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column) -> Column:
    return F.floor(x * 1e6 + F.lit(0.5)) / 1e6


def _r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("sample_idx"), F.col("event_type").alias("answer"))


_NINE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events) WHERE nth <= 9)"


def _majority(source: str = "events") -> str:
    return f"""(SELECT qid, label, n_votes, n_samples, n_votes::DOUBLE / n_samples AS p_hat, greatest(0, 1 - 2 * abs(n_votes::DOUBLE / n_samples - 0.5)) AS r_unc FROM (
      SELECT user_id AS qid, event_type AS label, count(*)::BIGINT AS n_votes, (sum(count(*)) OVER (PARTITION BY user_id))::BIGINT AS n_samples,
        row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS place
      FROM {source} GROUP BY user_id, event_type) WHERE place = 1)"""


_VOTE_COLUMNS = f"qid, label, n_votes, n_samples, {_r6('p_hat')} AS p_hat, {_r6('r_unc')} AS r_unc"


@query(f"SELECT {_VOTE_COLUMNS} FROM {_majority(_NINE)} WHERE p_hat BETWEEN 0.3 AND 0.8")
def vote_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = vote.majority(vote.first_samples(_votes(spark, sf_dir), 9))
    return _rounded(voted.filter(vote.in_band(F.col("p_hat"))), "p_hat", "r_unc")


@query(f"SELECT {_VOTE_COLUMNS} FROM {_majority()}")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vote.majority(_votes(spark, sf_dir)), "p_hat", "r_unc")


@query(f"SELECT 'user ' || qid AS problem, label AS answer, {_r6('p_hat')} AS score FROM {_majority(_NINE)} WHERE p_hat BETWEEN 0.3 AND 0.8 AND label NOT IN ('', 'None')")
def band_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = vote.majority(vote.first_samples(_votes(spark, sf_dir), 9)).withColumn("question", F.concat(F.lit("user "), "qid"))
    return _rounded(filters.training_rows(pool), "score")


@query("""
SELECT coalesce(CASE WHEN regexp_matches(text, '(?i)license') THEN 'pattern' WHEN length(text) < 300 THEN 'short' WHEN quality IS NULL THEN 'no_label' WHEN quality = 0 THEN 'bad' END, 'kept') AS reason, count(*)::BIGINT AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    c = F.col
    return filters.funnel(docs, {"pattern": text.is_polluted(c("text"), ["license"]), "short": F.length("text") < 300, "no_label": c("quality").isNull(), "bad": c("quality") == 0})


@query(f"""
WITH a AS (SELECT qid, label FROM {_majority('(SELECT * FROM events WHERE event_id % 2 = 1)')}), b AS (SELECT qid, label FROM {_majority('(SELECT * FROM events WHERE event_id % 2 = 0)')})
SELECT a.qid, a.label FROM a JOIN b ON a.qid = b.qid AND a.label = b.label""")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _votes(spark, sf_dir)
    odd, even = (vote.majority(votes.filter(F.col("sample_idx") % 2 == k)).select("qid", "label") for k in (1, 0))
    return filters.agreeing(odd, even)


@query(f"""
WITH a AS (SELECT qid, label FROM {_majority('(SELECT * FROM events WHERE event_id % 2 = 1)')}), b AS (SELECT qid, label, p_hat FROM {_majority('(SELECT * FROM events WHERE event_id % 2 = 0)')}),
m AS (SELECT a.label AS ours, b.label AS stored, p_hat, row_number() OVER (ORDER BY p_hat) - 1 AS rank, count(*) OVER () AS total FROM a JOIN b USING (qid))
SELECT count(*)::BIGINT AS n, (count(*) FILTER (ours = stored))::BIGINT AS n_match, (count(*) FILTER (ours IS NULL))::BIGINT AS n_none,
  {_r6('avg(p_hat)')} AS mean_p, {_r6('max(p_hat) FILTER (rank = total // 2)')} AS median_p_hat, {_r6('(count(*) FILTER (ours = stored)) / count(*)')} AS match_rate FROM m""")
def alignment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _votes(spark, sf_dir)
    ours = vote.majority(votes.filter("sample_idx % 2 = 1")).select("qid", F.col("label").alias("ours"))
    stored = vote.majority(votes.filter("sample_idx % 2 = 0")).select("qid", F.col("label").alias("stored"), "p_hat")
    return _rounded(stats.alignment(ours.join(stored, "qid"), "ours", "stored", "p_hat"), "mean_p", "median_p_hat", "match_rate")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("uid"), F.col("value").alias("score"))


@query(f"""
SELECT event_id, uid, score, {_r6('(score - m) / (s + 1e-6)')} AS advantage FROM (
  SELECT event_id, user_id AS uid, value AS score, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, count(*) OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id)) WHERE k > 1""")
def grpo_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(advantage.grpo(_scores(spark, sf_dir)), "advantage")


@query(f"""
SELECT event_id, uid, score, {_r6('score - (s - score) / (k - 1)')} AS advantage FROM (
  SELECT event_id, user_id AS uid, value AS score, sum(value) OVER w AS s, count(*) OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id)) WHERE k > 1""")
def rloo_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(advantage.rloo(_scores(spark, sf_dir)), "advantage")


@query(f"""
SELECT e.event_id, user_id AS uid, value AS score, {_r6('value - b')} AS advantage
FROM events e JOIN (SELECT user_id, max(value) AS b FROM events WHERE event_type = 'error' GROUP BY 1) USING (user_id)""")
def remax_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy(F.col("user_id").alias("uid")).agg(F.max("value").alias("baseline"))
    return _rounded(advantage.remax(_scores(spark, sf_dir), base), "advantage")


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per user: ids, rewards and, as value estimates, the rewards before them, in order of event_id."""
    before = F.lag("value", 1, 0.0).over(W.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").withColumn("v", before)
    grouped = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value", "v", "event_type"))).alias("t"))
    return grouped.select("user_id", F.col("t.event_id").alias("ids"), F.col("t.value").alias("rewards"), F.col("t.v").alias("vs"), F.col("t.event_type").alias("types"))


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events),
r AS (SELECT user_id, event_id, k, value + 0.9 * 0.0 AS ret FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, e.value + 0.9 * r.ret FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, {_r6('ret')} AS ret FROM r""")
def discounted_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = _sequences(spark, sf_dir)
    ones = F.transform("rewards", lambda _: F.lit(1.0))
    out = seq.select("user_id", F.explode(F.arrays_zip("ids", advantage.discounted_returns(F.col("rewards"), ones, 0.9).alias("ret"))).alias("x"))
    return out.select("user_id", F.col("x.ids").alias("event_id"), r6(F.col("x.ret")).alias("ret"))


@query(f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, value, coalesce(lag(value) OVER b, 0.0) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k
  FROM events WINDOW b AS (PARTITION BY user_id ORDER BY event_id)),
d AS (SELECT *, value + 0.99 * coalesce(lead(v) OVER (PARTITION BY user_id ORDER BY event_id), 0.0) - v AS delta FROM e),
r AS (SELECT user_id, event_id, k, v, delta AS adv FROM d WHERE k = 1 UNION ALL SELECT d.user_id, d.event_id, d.k, d.v, d.delta + 0.99 * 0.95 * r.adv FROM r JOIN d ON d.user_id = r.user_id AND d.k = r.k + 1)
SELECT user_id, event_id, {_r6('adv')} AS advantage, {_r6('adv + v')} AS ret FROM r""")
def gae_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    adv, ret = advantage.gae(F.col("rewards"), F.col("vs"), 0.99, 0.95)
    out = _sequences(spark, sf_dir).select("user_id", F.explode(F.arrays_zip("ids", adv.alias("adv"), ret.alias("ret"))).alias("x"))
    return out.select("user_id", F.col("x.ids").alias("event_id"), r6(F.col("x.adv")).alias("advantage"), r6(F.col("x.ret")).alias("ret"))


@query("""
SELECT user_id, event_id, CASE WHEN coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS mask
FROM events""")
def response_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return advantage.response_mask_rows(events, "user_id", "event_id", F.col("event_type") == "error").drop("event_type")


@query(f"""
WITH m AS (SELECT *, CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END AS w FROM events),
s AS (SELECT sum(value * w) / (sum(w) + 1e-8) AS mean, sum(w) AS n FROM m),
v AS (SELECT mean, sum((value - mean) * (value - mean) * w) / (any_value(n) + 1e-8) * any_value(n) / greatest(any_value(n) - 1, 1.0) AS var FROM m, s GROUP BY mean)
SELECT event_id, {_r6('(value - mean) / sqrt(var + 1e-8)')} AS whitened FROM m, v""")
def whitened_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "value", (F.col("event_type") != "error").alias("m"))
    return _rounded(advantage.whiten(events, "value", "m"), "whitened").select("event_id", "whitened")


@query(f"""
WITH v AS {_majority()}, c AS (SELECT user_id AS qid, avg(value) AS conf FROM events JOIN v ON user_id = qid AND event_type = label GROUP BY 1)
SELECT qid, {_r6('conf')} AS conf FROM (SELECT *, row_number() OVER (ORDER BY floor(conf * 1e6 + 0.5) / 1e6 DESC, qid) AS nth, count(*) OVER () AS n FROM c) WHERE nth <= greatest(1, n // 2)""")
def confidence_top_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = vote.majority(_votes(spark, sf_dir))
    votes = table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("answer"), F.col("value").alias("mean_logprob"))
    return walk.top_half(_rounded(vote.majority_confidence(votes, labels), "conf"), "conf", "qid")


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")


@query(f"""
SELECT part, count(*)::BIGINT AS n, sum(quality)::BIGINT AS n_correct, {_r6('avg(quality)')} AS accuracy FROM (
  SELECT quality, least((row_number() OVER (ORDER BY n_chars, doc_id) - 1) // greatest(count(*) OVER () // 5, 1), 4)::INT AS part FROM labels JOIN documents USING (doc_id)) GROUP BY 1""")
def quintile_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _graded(spark, sf_dir).select("doc_id", "n_chars", F.col("quality").alias("correct"))
    return _rounded(stats.accuracy(stats.quintile(rows, [F.col("n_chars"), F.col("doc_id")]), "part"), "accuracy")


@query(f"""
WITH c AS (SELECT lang, count(*) AS n, sum(quality) AS k FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT sum(k)::BIGINT AS n_correct, sum(n)::BIGINT AS n, count(*)::BIGINT AS n_categories, {_r6('sum(k) / sum(n)')} AS micro, {_r6('avg(k / n)')} AS macro FROM c""")
def micro_macro_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _graded(spark, sf_dir).select("lang", F.col("quality").alias("correct"))
    return _rounded(stats.micro_macro(rows, "lang"), "micro", "macro")


@query(f"""
WITH s AS (SELECT source, lang, {_r6('avg(quality)')} AS q FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2),
w AS (SELECT source, max(q) FILTER (lang = 'de') AS de, max(q) FILTER (lang = 'en') AS en, max(q) FILTER (lang = 'es') AS es, max(q) FILTER (lang = 'fr') AS fr FROM s GROUP BY 1)
SELECT source, de, en, es, fr, {_r6("(coalesce(de, 0) + coalesce(en, 0) + coalesce(es, 0) + coalesce(fr, 0)) / ((de IS NOT NULL)::INT + (en IS NOT NULL)::INT + (es IS NOT NULL)::INT + (fr IS NOT NULL)::INT)")} AS mean FROM w""")
def benchmark_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _graded(spark, sf_dir).groupBy("source", "lang").agg(r6(F.avg("quality")).alias("q"))
    return _rounded(stats.report_grid(scores, "source", "lang", "q", ["de", "en", "es", "fr"]), "mean")


@query(f"""
SELECT lang, count(*)::BIGINT AS n, (count(*) FILTER (quality = 0 AND toxic = 0))::BIGINT AS bumps, {_r6('avg(quality)')} AS raw, {_r6('avg(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE quality END)')} AS rechecked
FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def monotone_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _graded(spark, sf_dir).select("lang", F.col("quality").cast("double").alias("score"), (F.col("toxic") == 0).alias("yes"))
    return _rounded(stats.monotone_recheck(rows, "yes", "lang"), "raw", "rechecked")


@query("""
SELECT lang, n, floor(10000 * (k / n) + 0.5) / 100 AS raw, floor(10000 * ((n * (k / n) + b) / n) + 0.5) / 100 AS ours, 0::BIGINT AS grader_errors
FROM (SELECT lang, count(*)::BIGINT AS n, sum(quality)::DOUBLE AS k, count(*) FILTER (quality = 0 AND toxic = 0) AS b FROM labels JOIN documents USING (doc_id) GROUP BY 1)""")
def dual_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _graded(spark, sf_dir).select("lang", F.col("quality").cast("double").alias("score"), (F.col("toxic") == 0).alias("yes"))
    return stats.dual_grade(rows, "yes", "lang")


_RULE = "(length(text) < 300 OR regexp_matches(text, '(?i)(\\Qlicense\\E)'))"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = (F.length("text") < 300) | text.is_polluted(F.col("text"), ["license"])
    return _graded(spark, sf_dir).select("lang", (F.col("quality") == 0).alias("bad"), rule.alias("said"))


@query(f"""
WITH j AS (SELECT quality = 0 AS t, {_RULE} AS s FROM labels JOIN documents USING (doc_id)),
c AS (SELECT (count(*) FILTER (t AND s))::BIGINT AS tp, (count(*) FILTER (NOT t AND s))::BIGINT AS fp, (count(*) FILTER (t AND NOT s))::BIGINT AS fn, (count(*) FILTER (NOT t AND NOT s))::BIGINT AS tn FROM j)
SELECT *, {_r6('tp / greatest(tp + fn, 1)')} AS recall, {_r6('tp / greatest(tp + fp, 1)')} AS precision, {_r6('(tp + tn) / greatest(tp + fp + fn + tn, 1)')} AS accuracy FROM c""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.confusion(_judged(spark, sf_dir), "bad", "said"), "recall", "precision", "accuracy")


@query(f"SELECT lang, count(*)::BIGINT AS n, (count(*) FILTER {_RULE})::BIGINT AS caught, {_r6(f'avg({_RULE}::INT)')} AS recall FROM labels JOIN documents USING (doc_id) WHERE quality = 0 GROUP BY 1")
def recall_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.recall_by(_judged(spark, sf_dir), "lang", "bad", "said"), "recall")


_LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
_CHUNKS = f"""(SELECT least(rank // 64, greatest(2, total // 64) - 1) AS chunk_id, count(*)::BIGINT AS n, avg((l_discount BETWEEN 0.03 AND 0.07)::INT) AS v, sum(greatest(0, 0.05 - l_tax)) AS r FROM (
  SELECT *, row_number() OVER (ORDER BY {_LINE_ORDER}) - 1 AS rank, count(*) OVER () AS total FROM lineitem) GROUP BY 1 HAVING count(*) >= 2)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(*_LINE_ORDER.split(", "), "l_discount", "l_tax")
    ranked = stats.with_rank(lines, [F.col(c) for c in _LINE_ORDER.split(", ")], "rank")
    return stats.chunk_statistics(ranked, "rank", lines.count(), 64, F.col("l_discount").between(0.03, 0.07), 0.05 - F.col("l_tax"))


@query(f"SELECT chunk_id, n, {_r6('v')} AS v, {_r6('r')} AS r FROM {_CHUNKS}")
def chunk_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_chunks(spark, sf_dir), "v", "r")


@query(f"""
WITH RECURSIVE c AS (SELECT count(*)::BIGINT AS k, avg(v) AS v_mean, coalesce(covar_samp(v, r), 0) AS cov FROM {_CHUNKS}),
f AS (SELECT 0 AS i, 0.5::DOUBLE AS b, 1.0::DOUBLE AS l, k, v_mean, cov FROM c
  UNION ALL SELECT i + 1, least(2.0, greatest(0.02, b - 0.1 * (l * cov / (b * b) - 1 / b))), greatest(0.0, l + 0.1 * (1 - v_mean - 0.5)), k, v_mean, cov FROM f WHERE i < 20)
SELECT k, {_r6('v_mean')} AS v_mean, {_r6('cov')} AS cov, {_r6('b')} AS beta_new, {_r6('l')} AS lambda_new FROM f WHERE i = 20""")
def beta_lambda_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = walk.dual_updates(stats.covariance(_chunks(spark, sf_dir)), 0.5, 1.0)
    return _rounded(new, "v_mean", "cov", "beta_new", "lambda_new").select("k", "v_mean", "cov", "beta_new", "lambda_new")


@query(f"""
WITH v AS {_majority(_NINE)}, e AS (SELECT min(p_hat) AS a, max(p_hat) AS b FROM v)
SELECT (CASE WHEN a = b THEN 5 ELSE least(floor((p_hat - a) / (b - a) * 11), 10) END)::INT AS bin, count(*)::BIGINT AS n FROM v, e GROUP BY 1""")
def phat_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(vote.majority(vote.first_samples(_votes(spark, sf_dir), 9)), "p_hat", 11)


@query(f"""
SELECT label, count(*)::BIGINT AS n, {_r6('avg((p_hat < 0.3)::INT)')} AS hard, {_r6('avg((p_hat BETWEEN 0.3 AND 0.8)::INT)')} AS inside, {_r6('avg((p_hat > 0.8)::INT)')} AS easy, {_r6('avg(p_hat)')} AS mean_p
FROM {_majority(_NINE)} GROUP BY 1""")
def difficulty_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = vote.majority(vote.first_samples(_votes(spark, sf_dir), 9))
    return _rounded(stats.difficulty_bands(voted, "p_hat", "label"), "hard", "inside", "easy", "mean_p")


@query(f"SELECT source, {_r6('avg(quality)')} AS acc, count(quality)::BIGINT AS n_judged, count(*)::BIGINT AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def judged_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("source", F.col("quality").alias("correct"))
    return _rounded(stats.judged_accuracy(rows, "source"), "acc")


@query(f"SELECT {_r6('100.0 * count(quality) / greatest(1, count(*))')} AS coverage FROM documents LEFT JOIN labels USING (doc_id)")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.coverage(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), "quality"), "coverage")


_BAD = "(?i)(" + "|".join(f"\\Q{x}\\E" for x in [*text.BAD_LITERALS, "license"]) + ")"


@query(f"""
SELECT 'documents' AS origin, doc_id AS id, nullif(regexp_extract(text, '{_BAD}', 1), '') AS pattern FROM documents WHERE regexp_matches(text, '{_BAD}')
UNION ALL SELECT 'pages', page_id, nullif(regexp_extract(html, '{_BAD}', 1), '') FROM pages WHERE regexp_matches(html, '{_BAD}')""")
def blacklist_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    literals = [*text.BAD_LITERALS, "license"]
    found = [
        table(spark, sf_dir, t).filter(text.is_polluted(F.col(c), literals)).select(F.lit(t).alias("origin"), F.col(k).alias("id"), text.first_polluter(F.col(c), literals).alias("pattern"))
        for t, k, c in (("documents", "doc_id", "text"), ("pages", "page_id", "html"))
    ]
    return found[0].unionByName(found[1])


@query(r"""
SELECT p_partkey, list_last(regexp_extract_all(t, '\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}', 1)) AS answer FROM (
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '\boxed{' || p_name || '} or \boxed{a{' || p_brand || '}}' WHEN 1 THEN p_name WHEN 2 THEN '\boxed{' || p_name ELSE '\boxed{{{' || p_type || '}}}' END AS t FROM part)""")
def regex_boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr(r"CASE p_partkey % 4 WHEN 0 THEN concat('\\boxed{', p_name, '} or \\boxed{a{', p_brand, '}}') WHEN 1 THEN p_name WHEN 2 THEN concat('\\boxed{', p_name) ELSE concat('\\boxed{{{', p_type, '}}}') END")
    return table(spark, sf_dir, "part").select("p_partkey", text.last_boxed(said).alias("answer"))


_QUOTE = "chr(39)"
#: Pairs of what was said and what is true, by the key modulo their number.
_COMPARED = [
    ("p_brand", "p_brand"), ("'[' || p_brand || ']'", "p_brand"), ("p_brand || '?'", "p_brand"), ("p_size || '.0'", "p_size || ''"), ("'(a)'", "'a'"), ("p_name", "p_brand"), (f"{_QUOTE} || p_brand", "p_brand"),
    ("p_size || 'd'", "p_size || ''"), ("'1_' || p_size", "'1' || p_size || '.'"), ("' ' || p_size || 'e1 '", "(p_size * 10) || ''"), ("'nan'", "'nan '"), ("p_size || '__0'", "p_size || '0'"), ("'-Infinity'", "'-inf'"), ("'.5'", "'0.50'"), ("'1e5f'", "'100000'"),
]
_SAID, _TRUE = (f"CASE p_partkey % {len(_COMPARED)} " + " ".join(f"WHEN {i} THEN {pair[k]}" for i, pair in enumerate(_COMPARED)) + " END" for k in (0, 1))


def _number_sql(t: str) -> str:
    """SQL: a text as a number, where its form is that of decimal notation."""
    return f"CASE WHEN regexp_full_match(trim({t}), '[+-]?(([0-9]+(_[0-9]+)*[.]?([0-9]+(_[0-9]+)*)?|[.][0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?|(?i)(inf|infinity))') THEN replace(trim({t}), '_', '')::DOUBLE END"


@query(f"""
SELECT p_partkey, CASE WHEN said = truth THEN true WHEN length(said) = 3 AND said[1] = '(' AND said[3] = ')' THEN said[2] = truth WHEN length(truth) = 3 AND truth[1] = '(' AND truth[3] = ')' THEN truth[2] = said
  ELSE coalesce({_number_sql('said')} = {_number_sql('truth')}, false) OR replace(said, {_QUOTE}, '') = replace(truth, {_QUOTE}, '') OR '[' || truth || ']' = said OR '[' || said || ']' = truth OR said = truth || '?' END AS same
FROM (SELECT p_partkey, {_SAID} AS said, {_TRUE} AS truth FROM part)""")
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select("p_partkey", F.expr(_SAID).alias("said"), F.expr(_TRUE).alias("truth"))
    return pairs.select("p_partkey", text.fuzzy_match(F.col("said"), F.col("truth")).alias("same"))


def _ranked_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return stats.with_rank(orders, [F.col("o_orderkey")], "idx"), orders.count()


_IDX = "(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders)"


@query(f"""
SELECT o_orderkey, idx, (CASE WHEN idx < (n % 7) * (n // 7 + 1) THEN idx // (n // 7 + 1) ELSE n % 7 + (idx - (n % 7) * (n // 7 + 1)) // (n // 7) END)::INT AS shard FROM {_IDX}""")
def even_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, n = _ranked_orders(spark, sf_dir)
    return ranked.withColumn("shard", partition.even_shard(F.col("idx"), n, 7))


@query(f"SELECT o_orderkey, idx, false AS is_pad FROM {_IDX} UNION ALL SELECT o_orderkey, idx + n, true FROM {_IDX} WHERE idx < (64 - n % 64) % 64")
def pad_divisor(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, n = _ranked_orders(spark, sf_dir)
    return partition.pad_to_divisor(ranked, "idx", n, 64)


@query(f"SELECT o_orderkey, idx * 3 + r AS idx FROM {_IDX}, (SELECT unnest([0, 1, 2]) AS r)")
def repeat_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.repeat(_ranked_orders(spark, sf_dir)[0], "idx", 3)


@query(f"SELECT idx // 8 AS fold, string_agg(o_orderkey, ',' ORDER BY idx) AS keys FROM {_IDX} GROUP BY 1")
def fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = partition.fold(_ranked_orders(spark, sf_dir)[0], "idx", 8, "o_orderkey")
    return folded.select("fold", F.array_join(F.transform("o_orderkey", lambda k: k.cast("string")), ",").alias("keys"))


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS k FROM customer) WHERE k <= 3")
def newest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_newest(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), 3, "c_custkey", "c_nationkey")


@query(f"""
SELECT l_returnflag, {_r6('avg(d)')} AS kl, {_r6('avg(abs(d))')} AS abs_kl, {_r6('avg(0.5 * d * d)')} AS mse, {_r6('avg(greatest(-10, least(10, exp(-d) + d - 1)))')} AS low_var_kl
FROM (SELECT l_returnflag, l_discount - l_tax AS d FROM lineitem) GROUP BY 1""")
def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"kl": "kl", "abs": "abs_kl", "mse": "mse", "low_var_kl": "low_var_kl"}
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[r6(F.avg(losses.divergence(F.col("l_discount"), F.col("l_tax"), k))).alias(n) for k, n in kinds.items()])


@query(f"""
WITH t AS (SELECT l_returnflag, l_linestatus = 'F' AS m, l_tax * 10 - l_discount * 10 AS d, l_quantity - 25 AS a FROM lineitem),
u AS (SELECT *, -a * exp(d) AS free, -a * exp(least(ln(1.3), greatest(ln(0.8), d))) AS bound, -a * 3.0 AS low FROM t),
x AS (SELECT *, greatest(free, bound) AS upper FROM u)
SELECT l_returnflag, {_r6('sum((CASE WHEN a < 0 THEN least(upper, low) ELSE upper END) * m::INT) / (sum(m::INT) + 1e-8)')} AS loss,
  {_r6('sum((free < bound)::INT * m::INT) / (sum(m::INT) + 1e-8)')} AS clipped_higher, {_r6('sum((upper > low AND a < 0)::INT * m::INT) / (sum(m::INT) + 1e-8)')} AS clipped_lower, {_r6('sum(-d * m::INT) / (sum(m::INT) + 1e-8)')} AS kl
FROM x GROUP BY 1""")
def policy_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = losses.policy_loss(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") - 25)
    mask = (F.col("l_linestatus") == "F").cast("int")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[r6(losses.masked_mean(c, mask)).alias(n) for n, c in terms.items()])


@query(f"""
SELECT {", ".join(f"{_r6(f'{f}({c})')} AS {n}_{g}" for c, n in (('value', 'score'), ('length(props)', 'length')) for f, g in (('avg', 'mean'), ('max', 'max'), ('min', 'min')))}, {_r6('avg((length(props) >= 20)::INT)')} AS clip_ratio FROM events""")
def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.batch_metrics(table(spark, sf_dir, "events").select(F.col("value").alias("score"), F.length("props").alias("length")), 20)
    return _rounded(out, *out.columns)


# --- no SQL: sequential or approximate by nature, tested against brute force --------------------


@query()
def kk_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 512 documents, each dealt to 8 parts of near equal length."""
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 512).alias("batch"), "doc_id", "n_chars")
    return partition.balance(docs, "batch", "doc_id", "n_chars", 8)


def _grams(own: str) -> str:
    return f"""
words AS (SELECT id, unnest(w) AS g1, generate_subscripts(w, 1) AS pos FROM {own}),
runs AS (SELECT id, g1, lead(g1, 1) OVER t AS b, lead(g1, 2) OVER t AS c, lead(g1, 3) OVER t AS d FROM words WINDOW t AS (PARTITION BY id ORDER BY pos)),
grams AS (SELECT id, k, g, count(*) AS m FROM (
    SELECT id, 1 AS k, g1 AS g FROM runs UNION ALL SELECT id, 2, g1 || ' ' || b FROM runs WHERE b IS NOT NULL
    UNION ALL SELECT id, 3, g1 || ' ' || b || ' ' || c FROM runs WHERE c IS NOT NULL UNION ALL SELECT id, 4, g1 || ' ' || b || ' ' || c || ' ' || d FROM runs WHERE d IS NOT NULL) GROUP BY ALL)"""


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
_BLEU = f"""
hits AS (SELECT i, j, a.k, sum(least(a.m, b.m)) AS n FROM candidates JOIN grams a ON a.id = i JOIN grams b ON b.id = j AND b.k = a.k AND b.g = a.g GROUP BY ALL),
scores AS (SELECT i, j, least(1, exp(1 - any_value(r.n_words) / any_value(h.n_words))) * exp(({' + '.join(f"ln(coalesce(max(n) FILTER (k = {k}), 0.1::DOUBLE) / greatest(1, any_value(h.n_words) - {k - 1}))" for k in (1, 2, 3, 4))}) / 4) AS bleu
  FROM hits JOIN own h ON h.id = i JOIN own r ON r.id = j GROUP BY i, j)"""
_NEAR = f"""
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
own AS (SELECT min(doc_id) AS id, count(*) AS n_copies, w, len(w) AS n_words FROM docs GROUP BY w), {_grams('own')},
candidates AS (SELECT DISTINCT a.id AS i, b.id AS j FROM grams a JOIN grams b ON a.k = b.k AND a.g = b.g AND a.id < b.id JOIN own h ON h.id = a.id JOIN own r ON r.id = b.id
  WHERE a.k = CASE WHEN h.n_words < 5 THEN 1 ELSE 4 END AND 2 * r.n_words > h.n_words AND r.n_words < 1.7 * h.n_words), {_BLEU},
ends AS (SELECT i AS id, j AS other FROM scores WHERE bleu > 0.5 UNION ALL SELECT j, i FROM scores WHERE bleu > 0.5)"""


@query(f"""
WITH own AS (SELECT doc_id AS id, w, len(w) AS n_words FROM (SELECT doc_id, {_WORDS} AS w FROM documents)), {_grams('own')},
candidates AS (SELECT (SELECT min(doc_id) FROM documents) AS i, doc_id AS j FROM documents), {_BLEU}
SELECT j AS doc_id, {_r6('bleu')} AS bleu FROM scores WHERE bleu > 0.5""")
def near_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents near the first one, which is the hypothesis."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = docs.agg(F.min_by("text", "doc_id")).first()[0]
    return _rounded(dedup.one_against(docs, "doc_id", "text", first), "bleu")


@query(f"""
WITH {_NEAR}
SELECT doc_id, id AS class_id, (SELECT count(*) FROM ends WHERE ends.id = own.id) AS n_links FROM docs JOIN own USING (w)""")
def near_dup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = dedup.written(dedup.classes(docs, "doc_id", "text"), "classes", "zstd")
    return dedup.membership(docs, "doc_id", "text", own, dedup.written(dedup.near_pairs(own), "pairs"))


@query(f"""
WITH {_NEAR},
degrees AS (SELECT id, w, CASE WHEN n_words >= 3 THEN n_copies ELSE 1 END + coalesce((SELECT sum(o.n_copies) FROM ends JOIN own o ON o.id = ends.other WHERE ends.id = own.id), 0) AS degree FROM own),
pool AS (SELECT greatest(0, 1 - 2 * abs(doc_id % 10 / 10.0::DOUBLE - 0.5::DOUBLE)) - degree::DOUBLE / (SELECT count(*) FROM docs) AS utility FROM docs JOIN degrees USING (w))
SELECT {_r6('sum(greatest(0, utility))')} AS energy FROM pool""")
def near_dup_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = dedup.written(dedup.classes(docs, "doc_id", "text"), "classes", "zstd")
    degree = dedup.degrees(own, dedup.written(dedup.near_pairs(own), "pairs"))
    digest = lambda tokens: F.sha2(F.concat_ws(" ", tokens), 256).alias("digest")  # noqa: E731  (so that no text is shuffled)
    members = docs.select(digest(dedup.tokens_of(F.col("text"))), losses.uncertainty(F.pmod(F.col("doc_id"), F.lit(10)) / 10).alias("r_unc"))
    pool = members.join(own.select("id", digest("tokens")).join(degree, "id"), "digest").select("r_unc", "degree")
    return _rounded(stats.energy(pool), "energy")


@query(f"""
WITH docs AS (SELECT doc_id, doc_id // 50 AS chunk, {_WORDS} AS w FROM documents),
own AS (SELECT min(doc_id) AS id, chunk, count(*) AS n_copies, w, len(w) AS n_words FROM docs GROUP BY chunk, w), {_grams('own')},
candidates AS (SELECT DISTINCT a.id AS i, b.id AS j FROM grams a JOIN grams b ON a.k = b.k AND a.g = b.g AND a.id < b.id JOIN own h ON h.id = a.id JOIN own r ON r.id = b.id
  WHERE h.chunk = r.chunk AND a.k = CASE WHEN h.n_words < 5 THEN 1 ELSE 4 END AND 2 * r.n_words > h.n_words AND r.n_words < 1.7 * h.n_words), {_BLEU},
ends AS (SELECT i AS id, j AS other FROM scores WHERE bleu > 0.5 UNION ALL SELECT j, i FROM scores WHERE bleu > 0.5),
degrees AS (SELECT id, chunk, w, CASE WHEN n_words >= 3 THEN n_copies ELSE 1 END + coalesce((SELECT sum(o.n_copies) FROM ends JOIN own o ON o.id = ends.other WHERE ends.id = own.id), 0) AS degree FROM own),
pool AS (SELECT docs.chunk, greatest(0, 1 - 2 * abs(doc_id % 10 / 10.0::DOUBLE - 0.5::DOUBLE)) AS r_unc, degree::DOUBLE / count(*) OVER (PARTITION BY docs.chunk) AS share FROM docs JOIN degrees ON docs.chunk = degrees.chunk AND docs.w = degrees.w)
SELECT chunk AS chunk_id, count(*)::BIGINT AS n, {_r6('avg((r_unc BETWEEN 0.3::DOUBLE AND 0.8::DOUBLE)::INT)')} AS v, {_r6('sum(greatest(0, r_unc - share))')} AS r FROM pool GROUP BY chunk HAVING count(*) >= 2""")
def chunk_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share in the band and energy of each chunk of 50 documents, whose degrees count the near texts of the chunk."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr("doc_id div 50").alias("chunk"))
    own = dedup.written(dedup.classes(docs, "doc_id", "text", "chunk"), "classes", "zstd")
    degree = dedup.degrees(own, dedup.written(dedup.near_pairs(own), "pairs"))
    digest = lambda tokens: F.sha2(F.concat_ws(" ", tokens), 256).alias("digest")
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda t: t != "")
    members = docs.select("chunk", digest(tokens), losses.uncertainty(F.pmod(F.col("doc_id"), F.lit(10)) / 10).alias("r_unc"))
    named = own.select("id", F.col("within").alias("chunk"), digest("tokens")).join(degree, "id")
    pool = members.join(named, ["chunk", "digest"]).select(F.col("chunk").alias("chunk_id"), "r_unc", "degree")
    return _rounded(stats.chunk_energies(pool), "v", "r")


@query(f"""
WITH s AS (SELECT qid, a, k FROM (SELECT user_id AS qid, event_type AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 12),
n AS (SELECT qid, max(k) AS n FROM s GROUP BY 1),
subsets AS (SELECT qid, n, m FROM n JOIN (SELECT m FROM (SELECT unnest(range(4096)) AS m) WHERE bit_count(m) = 9) ON m < (1 << n)),
counts AS (SELECT b.qid, m, count(*) AS c FROM subsets b JOIN s ON s.qid = b.qid AND ((m >> (k - 1)) & 1) = 1 GROUP BY b.qid, m, a),
u AS (SELECT qid, m, greatest(0, greatest(0, 1 - 2 * abs(max(c)::DOUBLE / 9 - 0.5::DOUBLE)) - 0.1::DOUBLE) AS u FROM counts GROUP BY 1, 2),
left_out AS (SELECT u.qid, n, k, avg(u) AS l FROM u JOIN n ON u.qid = n.qid JOIN s ON s.qid = u.qid AND ((m >> (k - 1)) & 1) = 0 GROUP BY 1, 2, 3),
jack AS (SELECT qid, (n - 1) / n * sum((l - whole) * (l - whole)) AS v FROM (SELECT *, avg(l) OVER (PARTITION BY qid) AS whole FROM left_out) GROUP BY qid, n),
mean AS (SELECT qid, avg(u) AS u FROM u GROUP BY 1)
SELECT n.qid, {_r6('coalesce(u, 0)')} AS u, {_r6('coalesce(v, 0)')} AS variance FROM n LEFT JOIN mean ON n.qid = mean.qid LEFT JOIN jack ON n.qid = jack.qid""")
def ustat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-9 U-statistics over the first 12 samples of each question."""
    votes = vote.first_samples(_votes(spark, sf_dir), 12).withColumn("share", F.lit(0.1))
    return _rounded(stats.u_statistics(votes, 9), "u", "variance")


@query(f"""
WITH c AS (SELECT user_id AS qid, left(event_type, 1) AS class, arg_min(event_type, event_id) AS label, min(event_id) AS first, count(*)::BIGINT AS n_votes FROM events GROUP BY 1, 2)
SELECT qid, label, n_votes, n_samples, {_r6('n_votes / n_samples')} AS p_hat
FROM (SELECT *, (sum(n_votes) OVER (PARTITION BY qid))::BIGINT AS n_samples, row_number() OVER (PARTITION BY qid ORDER BY n_votes DESC, first) AS place FROM c) WHERE place = 1""")
def equiv_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vote.equivalence_vote(_votes(spark, sf_dir), lambda a, b: a[:1] == b[:1]), "p_hat")


@query()
def cluster_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 64).alias("batch"), "item_id", "text")
    return _rounded(dedup.cluster_share(items, "batch", "item_id", "text"), "share")


def _walked(spark: SparkSession, items: DataFrame, carried: bool) -> DataFrame:
    """One step of chains of 32 of the items (id, text); the proposal for an item is the text of the next one."""
    draw = lambda seed: F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(3)).cast("string"))
    chain = F.floor(F.col("id") / 32).alias("chain")
    pool = items.select(chain, "id", "text", draw(1).alias("answers"))
    following = items.select((F.col("id") - 1).alias("id"), "text")
    proposals = following.select(chain, "id", "text", draw(2).alias("answers"))
    moved = walk.walk_step(walk.with_neighbours(pool) if carried else pool, proposals, 0)
    return _rounded(moved, "alpha").select("chain", "id", F.sha2("text", 256).alias("text_sha256"), "accepted", "alpha")


@query()
def mh_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), False)


@query()
def mh_walk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over documents, whose neighbours come from one join."""
    return _walked(spark, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), True)
