r"""Secret scans: base patterns, and high entropy in sliding windows of candidate strings.

A candidate is a maximal run of 20 or more characters of [A-Za-z0-9+/_=-] with a
digit and a letter, outside base spans and what the allow-list matches: those cut
a run into parts, each a candidate of its own, so a key joined to either is found.
It has a character class, hex or mixed. Character counts of a 20-character window
move along it: each step takes one from the count of the character that leaves
and adds one to that of the one that enters, and so keeps S = sum(c * log2(c));
the window's Shannon entropy is log2(20) - S / 20. A candidate whose highest
window reaches its class's threshold becomes an `entropy` span.

Only built-in functions are used; S is kept in millionths, as an integer, and the
65 counts in six integers, five bits each, so a step costs the same however long
the candidate. Null texts count as empty; a text without a span has empty
strings; repeated rows each get a row; an empty table gives no rows; very long
texts take time in proportion; other columns are ignored by `find_secrets` and
kept by `redact`, whatever their names. Positions are code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a character that the best window must reach, by class.
THRESHOLDS = {"hex": 2.9, "mixed": 3.6}
#: Stand-ins, in either case.
STAND_INS = ["example", "sample", "placeholder", "changeme", "dummy", "xxxx", "0000000", "1234567", "abcdef0"]
#: What no secret holds: stand-ins, UUIDs, and digests named as such. A candidate ends before it and begins anew after it.
ALLOWED = "|".join([*("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in STAND_INS), "-".join(f"[0-9A-Fa-f]{{{n}}}" for n in (8, 4, 4, 4, 12)), "[sS][hH][aA](?:1|256|512)[-_=][A-Za-z0-9+/]+={0,2}"])
_UNIT = 1_000_000
_CLOG = [0, *(round(c * math.log2(c) * _UNIT) for c in range(1, WINDOW + 1))]
_NONE = "CAST(array() AS ARRAY<STRUCT<at: INT, kind: INT, upto: INT>>)"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(array: str, step: str) -> str:
    """SQL: the running values of `array` under `step` of x and y. Each pass joins windows twice as long as the one before, so n values cost n log n."""
    for k in (1 << j for j in range(30)):  # a text has fewer spans
        joined = step.format(x="x", y=f"a[i - {k}]")
        array = f"transform(array({array}), a -> CASE WHEN size(a) <= {k} THEN a ELSE transform(a, (x, i) -> CASE WHEN i >= {k} THEN {joined} ELSE x END) END)[0]"
    return array


def _met(pattern: str, least: str, col: str = "text") -> str:
    """SQL array of (gap, len, ok) of the matches of `pattern` in `col`."""
    return f"""zip_with(slice(split({col}, {_sql(pattern)}, -1), 1, size(regexp_extract_all({col}, {_sql(pattern)}, 0))), {least},
          (gap, m) -> struct(char_length(gap) AS gap, char_length(m.whole) AS len, m.ok AS ok))"""


def _spans(met: str, kind: int, when: str) -> str:
    """SQL array of (at, kind, upto) of those of `met` that are ok; `when`: a condition that texts with such matches meet."""
    return f"""
      CASE WHEN {when} THEN transform(array({met}),
        ms -> transform(filter(zip_with({_running("transform(ms, m -> m.gap + m.len)", "{x} + {y}")}, ms, (upto, m) -> struct(upto - m.len AS at, upto AS upto, m.ok AS ok)), s -> s.ok),
          s -> struct(s.at AS at, {kind} AS kind, s.upto AS upto)))[0] ELSE {_NONE} END"""


def _matches(pattern: str, ok: str, col: str = "text") -> str:
    return f"transform(regexp_extract_all({col}, {_sql(pattern)}, 0), m -> struct(m AS whole, {ok} AS ok))"


#: The characters of candidates, and where each of them is by its code.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Counts in one integer, of five bits each: none is above WINDOW.
_COUNTS, _WIDTH = 12, 5


def _best_window() -> str:
    """SQL: the least S over the windows of m, by incremental counts."""
    f = f"array({', '.join(map(str, _CLOG))})"
    code = f"array({', '.join(str(max(ALPHABET.find(chr(c)), 0)) for c in range(128))})"
    held = f"CAST(shiftright({{a}}[{{c}} div {_COUNTS}], {_WIDTH} * ({{c}} % {_COUNTS})) & 31 AS INT)".format
    # The leaving character's count falls first, then the entering one's rises; s follows both.
    one = f"CASE WHEN j = {{c}} div {_COUNTS} THEN shiftleft(1L, {_WIDTH} * ({{c}} % {_COUNTS})) ELSE 0L END".format
    left = f"CASE WHEN i >= {WINDOW} THEN transform(a.counts, (n, j) -> n - {one(c=f'cs[i - {WINDOW}]')}) ELSE a.counts END"
    fall = f"CASE WHEN i >= {WINDOW} THEN f[{held(a='a.counts', c=f'cs[i - {WINDOW}]')}] - f[{held(a='a.counts', c=f'cs[i - {WINDOW}]')} - 1] ELSE 0 END"
    rise = f"f[{held(a='l', c='cs[i]')} + 1] - f[{held(a='l', c='cs[i]')}]"
    step = f"""transform(transform(array({left}), l -> struct(transform(l, (n, j) -> n + {one(c='cs[i]')}) AS counts, a.s - {fall} + {rise} AS s)),
      n -> struct(n.counts AS counts, n.s AS s, CASE WHEN i >= {WINDOW - 1} THEN least(a.best, n.s) ELSE a.best END AS best))[0]"""
    whole = f"aggregate(sequence(0, size(cs) - 1), struct(array_repeat(0L, {-(-len(ALPHABET) // _COUNTS)}) AS counts, 0 AS s, {2**31 - 1} AS best), (a, i) -> {step}, a -> a.best)"
    return f"transform(array(transform(split(m, ''), c -> {code}[ascii(c)])), cs -> transform(array({f}), f -> {whole})[0])[0]"


def _entropy_ok() -> str:
    most = {k: math.floor(WINDOW * (math.log2(WINDOW) - v) * _UNIT) for k, v in THRESHOLDS.items()}
    limit = f"CASE WHEN m rlike '^([0-9a-f]+|[0-9A-F]+)$' THEN {most['hex']} ELSE {most['mixed']} END"
    return f"CASE WHEN m rlike '[0-9]' AND m rlike '[A-Za-z]' THEN {_best_window()} <= {limit} ELSE false END"


def _outside() -> str:
    """SQL: the text with blanks in the place of base spans, so that places stay the same; `ends`: where the spans up to each one have ended."""
    # Four bytes a code point: a part is found without counting from the start.
    part = "decode(substring(wide, 4 * {0} + 1, 4 * ({1} - {0})), 'UTF-32')".format
    past = "CASE WHEN i = 0 THEN 0 ELSE ends[i - 1] END"
    return f"""CASE WHEN size(base) = 0 THEN text ELSE transform(array(encode(text, 'UTF-32')), wide -> concat(
        array_join(transform(base, (s, i) -> concat(CASE WHEN s.at > {past} THEN {part(past, "s.at")} ELSE '' END, repeat(' ', s.upto - greatest(s.at, {past})))), ''),
        {part("ends[size(ends) - 1]", "char_length(text)")}))[0] END"""


def _allowed_out() -> str:
    """SQL: `outside` with blanks in the place of what is allowed."""
    allowed = _sql(ALLOWED)
    return f"""CASE WHEN outside rlike {allowed} THEN array_join(zip_with(split(outside, {allowed}, -1), regexp_extract_all(outside, {allowed}, 0),
        (gap, m) -> concat(gap, repeat(' ', coalesce(char_length(m), 0)))), '') ELSE outside END"""


def find_secrets(docs: DataFrame) -> DataFrame:
    """`docs` reduced to doc (a struct of all columns) with arrays `base` and `spans` of (at, kind, upto), ordered by at, then kind."""
    ws = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    least = f"char_length(regexp_extract(m, {_sql(ASSIGN)}, 1)) >= 6"
    like = lambda tested: f"text rlike {_sql(tested)}"
    base = ws.withColumn("base", F.expr(f"""sort_array(concat(
        {_spans(_met(ASSIGN, _matches(ASSIGN, least)), 0, like(ASSIGN))},
        {_spans(_met(ACCESS, _matches(ACCESS, 'char_length(m) >= 20')), 1, like('AKIA[A-Z0-9]{16}'))},
        {_spans(_met(HEX, _matches(HEX, 'char_length(m) >= 24')), 2, like('[0-9a-f]{24}'))}))"""))  # fmt: skip
    tested = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20}"  # looks ahead once a run
    # Column by column: Spark resolves nested functions a level at a time, and at most a hundred levels.
    ends = base.withColumn("ends", F.expr(f"CASE WHEN size(base) > 0 AND {like(tested)} THEN {_running('transform(base, s -> s.upto)', 'greatest({x}, {y})')} END"))
    outside = ends.withColumn("outside", F.expr(f"CASE WHEN {like(tested)} THEN {_outside()} END"))
    opened = outside.withColumn("open", F.expr(_allowed_out()))
    met = opened.withColumn("met", F.expr(f"CASE WHEN open IS NOT NULL THEN {_met(CANDIDATE, _matches(CANDIDATE, _entropy_ok(), 'open'), 'open')} END"))
    added = met.withColumn("added", F.expr(_spans("met", 3, "open IS NOT NULL")))
    return added.select("doc", "text", "base", F.sort_array(F.concat("base", "added")).alias("spans"))


def written(spans: str) -> Column:
    names = f"array({', '.join(map(repr, KINDS))})"
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', {names}[s.kind], s.at, s.upto)), ',')")


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every secret in text replaced by [SECRET] and n_chars, if there, counted anew."""
    found = find_secrets(docs)
    # What is kept before a span starts where the spans before it have ended. Four bytes a code point: a part is found without counting from the start.
    ends = _running("transform(spans, s -> s.upto)", "greatest({x}, {y})")
    part = "decode(substring(t.wide, 4 * {0} + 1, 4 * ({1} - {0})), 'UTF-32')".format
    past = "t.ends[greatest(i - 1, 0)]"
    cut = F.expr(f"""transform(array(struct({ends} AS ends, encode(text, 'UTF-32') AS wide)), t -> concat(
        array_join(transform(spans, (s, i) -> CASE WHEN i = 0 THEN concat({part("0", "s.at")}, '[SECRET]') WHEN s.at >= {past} THEN concat({part(past, "s.at")}, '[SECRET]') ELSE '' END), ''),
        {part("t.ends[size(t.ends) - 1]", "char_length(text)")}))[0]""")
    clean = F.when(F.size("spans") > 0, cut).otherwise(F.col("doc.text"))
    done = found.select("doc", clean.alias("clean"))
    columns = [F.col("clean").alias("text") if c == "text" else F.length("clean").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    return done.select(*columns)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.expr(f"CAST(size(filter(base, s -> s.kind = {k})) AS BIGINT)")
    return found.select("doc.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    # A run of 24 characters or more is found at its start either way, and so is an access key.
    patterns = [ASSIGN, "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"]
    spans = lambda p, k, table: f"SELECT doc_id, {k} AS kind, regexp_extract_all(t, {q(p)}, 0) AS m, regexp_extract_all(t, {q(p)}, {int(k == 0)}) AS v, string_split_regex(t, {q(p)}) AS p FROM {table}"
    placed = lambda found: f"""
  SELECT doc_id, kind, m[k] AS said, v[k] AS val, {KINDS}[kind + 1] AS name,
    (list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::BIGINT AS pos
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM ({found}))"""  # noqa: E731
    most = {k: math.floor(WINDOW * (math.log2(WINDOW) - v) * _UNIT) for k, v in THRESHOLDS.items()}
    best = f"""list_min(list_transform(range(1, length(said) - {WINDOW - 2}), lambda i: list_sum(list_transform(list_distinct(string_split(substr(said, i, {WINDOW}), '')),
      lambda c: {_CLOG}[{WINDOW + 1} - length(replace(substr(said, i, {WINDOW}), c, ''))]))))"""
    told = "string_agg(name || ':' || pos || ':' || upto, ',' ORDER BY pos, kind)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc_id, doc_id AS given_id, coalesce(text, '') AS t FROM documents),
s AS ({placed(" UNION ALL ".join(spans(p, k, "d") for k, p in enumerate(patterns)))}),
base AS (SELECT *, pos + length(said) AS upto FROM s WHERE kind > 0 OR length(val) >= 6),
-- base spans that touch or overlap as one, then blanks in their place
reach AS (SELECT doc_id, pos, upto, coalesce(max(upto) OVER (PARTITION BY doc_id ORDER BY pos, upto ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM base),
islands AS (SELECT doc_id, pos, upto, sum(CASE WHEN pos > past THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos, upto) AS island FROM reach),
joined AS (SELECT doc_id, min(pos) AS pos, max(upto) AS upto FROM islands GROUP BY doc_id, island),
gaps AS (SELECT doc_id, pos, upto, coalesce(lag(upto) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS past FROM joined),
outside AS (
  SELECT d.doc_id, string_agg(substr(t, past + 1, pos - past) || repeat(' ', upto - pos), '' ORDER BY pos) || substr(any_value(t), max(upto) + 1) AS o
  FROM gaps JOIN d ON gaps.doc_id = d.doc_id GROUP BY d.doc_id),
unmarked AS (SELECT d.doc_id, coalesce(o, t) AS o FROM d LEFT JOIN outside ON d.doc_id = outside.doc_id),
parts AS (SELECT doc_id, o, string_split_regex(o, {q(ALLOWED)}) AS p, regexp_extract_all(o, {q(ALLOWED)}) AS m FROM unmarked),
opened AS (SELECT doc_id, CASE WHEN len(m) = 0 THEN o ELSE array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || repeat(' ', coalesce(length(m[i]), 0))), '') END AS t FROM parts),
entropy AS ({placed(spans(CANDIDATE, 3, "opened"))}),
added AS (
  SELECT *, pos + length(said) AS upto FROM entropy WHERE regexp_matches(said, '[0-9]') AND regexp_matches(said, '[A-Za-z]')
    AND {best} <= CASE WHEN regexp_matches(said, '^([0-9a-f]+|[0-9A-F]+)$') THEN {most['hex']} ELSE {most['mixed']} END),
b AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, {told} AS told FROM base GROUP BY 1),
e AS (SELECT doc_id, {told} AS told FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY 1)
SELECT given_id AS doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(b.told, '')) AS base_sha256, coalesce(e.told, '') AS spans
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN e ON d.doc_id = e.doc_id"""


ORACLE_SQL = _oracle()
