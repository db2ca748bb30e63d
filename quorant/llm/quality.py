"""Quality rules: adaptive thresholds from mergeable quantile sketches.

Every document gets integer measures. Per (lang, source) and measure a sketch
counts the documents in log-linear buckets (the top 7 bits of the value, so a
quantile is at most 1/64 too low); sketches merge by adding counts, so partial
aggregation runs map-side and a hot source costs no more than a cold one.
Small groups use the sketch of their language, merged from its sources, or the
merge of all. Fences lie `reach` spreads beyond the quartiles; a document is
kept if every measure lies within its group's fences (a join).

Only built-in expressions are used. Nulls: a null text has no words; null
lang and source form groups of their own. Repeated rows each count and each
get a row. An empty table gives no rows. Whole texts are measured, however long.
Extra columns of the input are ignored by `measures` and kept by `apply_rules`;
its own columns start with `q_`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, materialise

#: measure -> least spread (per mille), so that a measure that hardly varies keeps some room.
SPREADS = {"word_len": 500, "symbols": 25, "dup_lines": 70, "repeats": 50, "capitals": 40}
#: Fences lie this many spreads beyond the quartiles.
REACH = 6
#: Groups of fewer documents use their language's sketch, and fewer again the whole corpus's.
LEAST_GROUP = 100
KEYS = ["q_lang", "q_source"]

_WHITE = r"[\\x20\\x09-\\x0D]"
_WORDS = rf"""
  CASE WHEN btrim(coalesce(text, ''), ' \t\n\u000b\u000c\r') = '' THEN array()
  ELSE split(btrim(text, ' \t\n\u000b\u000c\r'), '{_WHITE}+') END"""
_LINES = rf"filter(split(coalesce(text, ''), '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"
#: Words of q_words that lie in a 3-word window found twice; windows are sorted by 64-bit hash, those of equal hash by their words.
_WINDOWS = """
  CASE WHEN size(q_words) < 4 THEN array()
  ELSE transform(sequence(0, size(q_words) - 3), i -> xxhash64(q_words[i], q_words[i + 1], q_words[i + 2])) END"""
_SORTED = """
  CASE WHEN size(array_distinct(q_windows)) = size(q_windows) THEN array()
  ELSE sort_array(transform(q_windows, (h, i) -> struct(h AS h, q_words[i] AS a, q_words[i + 1] AS b, q_words[i + 2] AS c, i AS i))) END"""
_SAME = " AND ".join(f"q_sorted[k].{x} = q_sorted[{{0}}].{x}" for x in "habc").format
_PLACES = f"""
  CASE WHEN size(q_sorted) = 0 THEN array()
  ELSE sort_array(transform(filter(sequence(0, size(q_sorted) - 1), k ->
      (k > 0 AND {_SAME("greatest(k - 1, 0)")})
      OR (k < size(q_sorted) - 1 AND {_SAME("least(k + 1, size(q_sorted) - 1)")})), k -> q_sorted[k].i)) END"""
_COVERED = """
  aggregate(transform(q_places, (x, j) -> CASE WHEN j = size(q_places) - 1 THEN 3L
      ELSE CAST(least(3, q_places[least(j + 1, size(q_places) - 1)] - x) AS BIGINT) END), 0L, (a, x) -> a + x)"""


def measures(docs: DataFrame, *carry: str) -> DataFrame:
    """`carry` columns, the base counts and the adaptive measures (all long) of each document."""
    ws = docs.select(*carry, "text", F.col("lang").alias("q_lang"), F.col("source").alias("q_source"))
    ws = ws.withColumns({"q_words": F.expr(_WORDS), "q_lines": F.expr(_LINES)})
    ws = ws.withColumn("q_windows", F.expr(_WINDOWS))
    ws = ws.withColumn("q_sorted", F.expr(_SORTED))
    ws = ws.withColumn("q_places", F.expr(_PLACES))
    counted = ws.select(
        *carry, "q_lang", "q_source",
        F.size("q_words").cast("long").alias("n_words"),
        F.length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        F.length(F.expr(r"regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '')")).cast("long").alias("n_symbols"),
        F.expr("CAST(size(q_lines) - size(array_distinct(q_lines)) AS BIGINT)").alias("n_dup_lines"),
        F.expr(_COVERED).alias("n_repeat_words"),
        F.size("q_lines").cast("long").alias("q_n_lines"),
        F.length(F.expr(r"regexp_replace(coalesce(text, ''), '[^\\p{Lu}]+', '')")).cast("long").alias("q_n_capitals"),
    )
    per_mille = "1000 * {} div greatest({}, 1)".format
    return counted.select(
        "*",
        F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words").alias("base_failed"),
        F.expr(per_mille("word_chars", "n_words")).alias("word_len"),
        F.expr(per_mille("n_symbols", "n_words")).alias("symbols"),
        F.expr(per_mille("n_dup_lines", "q_n_lines")).alias("dup_lines"),
        F.expr(per_mille("n_repeat_words", "n_words")).alias("repeats"),
        F.expr(per_mille("q_n_capitals", "word_chars")).alias("capitals"),
    ).drop("q_n_lines", "q_n_capitals")


def sketches(measured: DataFrame) -> DataFrame:
    """Counts by group, measure and bucket, of the documents that pass the base rules."""
    stack = ", ".join(f"'{m}', {m}" for m in SPREADS)
    tall = measured.filter("NOT base_failed").selectExpr(*KEYS, f"stack({len(SPREADS)}, {stack}) AS (measure, value)")
    shift = "greatest(length(bin(value)) - 7, 0)"
    bucket = F.expr(f"shiftleft(shiftright(value, {shift}), {shift})")
    return tall.groupBy(*KEYS, "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Total and quartile buckets of the sketches merged to `keys`."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "measure")
    ranked = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)})
    return ranked.groupBy(*keys, "measure").agg(
        F.max("total").alias("total"),
        F.min(F.when(F.expr("4 * upto >= total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.expr("4 * upto >= 3 * total"), F.col("bucket"))).alias("q3"),
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source) with the struct columns lo and hi, a field for each measure.

    A group takes the finest of its own, its language's and the overall sketch
    that holds LEAST_GROUP documents; the overall one otherwise.
    """
    own, lang, overall = _quartiles(sketch, *KEYS).alias("o"), _quartiles(sketch, "q_lang").alias("l"), _quartiles(sketch).alias("a")
    picked = own.join(lang, F.expr("o.measure = l.measure AND o.q_lang <=> l.q_lang")).join(overall, F.expr("o.measure = a.measure"))
    level = "CASE WHEN o.total >= {0} THEN o.{1} WHEN l.total >= {0} THEN l.{1} ELSE a.{1} END".format
    least = "element_at(map({}), o.measure)".format(", ".join(f"'{m}', {v}L" for m, v in SPREADS.items()))
    fences = picked.selectExpr("o.q_lang", "o.q_source", "o.measure", f"{level(LEAST_GROUP, 'q1')} AS q1", f"{level(LEAST_GROUP, 'q3')} AS q3", f"{least} AS least")
    fences = fences.withColumn("room", F.expr(f"{REACH} * greatest(q3 - q1, least)"))
    one = "max(CASE WHEN measure = '{0}' THEN {1} END) AS {0}".format
    fields = [F.expr(one(m, edge)).alias(f"{name}_{m}") for name, edge in (("lo", "q1 - room"), ("hi", "q3 + room")) for m in SPREADS]
    return fences.groupBy(*KEYS).agg(*fields)


def verdicts(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """`measured` with kept: not failed, and every measure within its group's fences."""
    m, t = measured.alias("m"), limits.alias("t")
    within = " AND ".join(f"m.{x} BETWEEN t.lo_{x} AND t.hi_{x}" for x in SPREADS)
    joined = m.join(t, F.expr("m.q_lang <=> t.q_lang AND m.q_source <=> t.q_source"), "left")
    return joined.select("m.*", F.expr(f"NOT m.base_failed AND coalesce({within}, false)").alias("kept"))


def judge(docs: DataFrame, *carry: str) -> DataFrame:
    """`carry` columns, base counts, measures and kept of each document.

    The measures are written once; the sketch pass then reads only its few narrow
    columns. The fences are written too, so that Spark knows their size and
    broadcasts them only if they are below its threshold.
    """
    measured = materialise(measures(docs, *carry), "quality-measures")
    limits = materialise(thresholds(sketches(measured)).coalesce(1), "quality-limits")
    return verdicts(measured, limits)


def apply_rules(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with the same columns."""
    packed = docs.select(F.struct("*").alias("q_row"), "text", "lang", "source")
    return judge(packed, "q_row").filter("kept").select("q_row.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), "doc_id").drop(*KEYS)


def _oracle() -> str:
    measures_sql = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS value FROM m WHERE NOT base_failed" for m in SPREADS)
    least = " ".join(f"WHEN '{m}' THEN {v}" for m, v in SPREADS.items())
    quart = """
      SELECT {keys} measure, max(total) AS total, min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket) FILTER (4 * upto >= 3 * total) AS q3
      FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys} measure) AS total
            FROM (SELECT {keys} measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL""".format
    pick = "CASE WHEN o.total >= {0} THEN o.{1} WHEN l.total >= {0} THEN l.{1} ELSE a.{1} END".format
    outside = " OR ".join(f"(f.measure = '{m}' AND NOT m.{m} BETWEEN f.q1 - f.room AND f.q3 + f.room)" for m in SPREADS)
    return rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
wins AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times FROM (
    SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3))),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM wins, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY doc_id),
c AS (
  SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_capitals
  FROM w LEFT JOIN cover ON w.doc_id = cover.doc_id),
m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    1000 * word_chars // greatest(n_words, 1) AS word_len, 1000 * n_symbols // greatest(n_words, 1) AS symbols,
    1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats,
    1000 * n_capitals // greatest(word_chars, 1) AS capitals
  FROM c),
sketch AS (
  SELECT lang, source, measure, (value >> s) << s AS bucket, count(*) AS n
  FROM (SELECT *, greatest(length(bin(value)) - 7, 0) AS s FROM ({measures_sql})) GROUP BY ALL),
f AS (
  SELECT o.lang, o.source, o.measure, {pick(LEAST_GROUP, 'q1')} AS q1, {pick(LEAST_GROUP, 'q3')} AS q3,
    {REACH} * greatest({pick(LEAST_GROUP, 'q3')} - {pick(LEAST_GROUP, 'q1')}, CASE o.measure {least} END) AS room
  FROM ({quart(keys='lang, source,')}) o JOIN ({quart(keys='lang,')}) l ON o.measure = l.measure AND o.lang IS NOT DISTINCT FROM l.lang
  JOIN ({quart(keys='')}) a ON o.measure = a.measure),
bad AS (
  SELECT DISTINCT m.doc_id FROM m JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source WHERE {outside})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, word_len, symbols, dup_lines, repeats, capitals,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM m"""


ORACLE_SQL = _oracle()
