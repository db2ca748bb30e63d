"""Queries over texts in the shape of model responses, made from the part table, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import losses, rewards, text
from ..operators import vote
from .catalogue import _r6, query, r6, table

_NL = "chr(10)"
#: SQL: white space of Unicode, by code.
_SPACES = " || ".join(f"chr({c})" for c in [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])


def _bare_ends(sql: str) -> str:
    return f"trim({sql}, {_SPACES})"



def _cases(key: str, *said: str) -> str:
    """SQL that both engines run: the text of a row by its key modulo the number of texts."""
    return f"CASE {key} % {len(said)} " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(said)) + " END"


def _duck(cases: str) -> str:
    return f"(SELECT p_partkey, p_size, {cases} AS t FROM part)"


def _said(spark: SparkSession, sf_dir: str, cases: str, **columns: Column) -> DataFrame:
    """p_partkey and `columns`, which read the text as t."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.expr(cases.replace("\\", "\\\\")).alias("t"))
    return rows.select("p_partkey", *[c.alias(n) for n, c in columns.items()])


def _t() -> Column:
    return F.col("t")


_GREEDY = _cases("p_partkey", r"'so \BOXED{' || p_name || '} or {' || p_brand || '}'", "p_name", r"'\boxed{}'")


@query(rf"SELECT p_partkey, nullif(regexp_extract(t, '(?i)\\boxed\{{(.*)\}}', 1), '') AS answer FROM {_duck(_GREEDY)}")
def boxed_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, _GREEDY, answer=text.first_boxed_greedy(_t()))


_TAGGED = _cases(
    "p_partkey",
    "'<question>' || p_name || '</question> and <question> a <question> ' || p_brand || ' </question>'",
    "p_name || '<question>' || p_type",
    f"'<question>' || p_type || {_NL} || p_brand || '</question>'",
    "'<question> </question>'",
    f"'<question>' || {_NL} || chr(9) || p_name || {_NL} || p_type || chr(13) || {_NL} || '</question>'",
    f"'<question>' || {_NL} || chr(9) || chr(160) || '</question>'",
    f"'<question>a</question><question> b' || {_NL} || '<question>' || {_NL} || p_brand || chr(12) || '</question>'",
)


@query(f"SELECT p_partkey, nullif({_bare_ends("list_last(string_split(list_last(regexp_extract_all(t, '(?s)<question>(.*?)</question>', 1)), '<question>'))")}, '') AS question FROM {_duck(_TAGGED)}")
def question_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, _TAGGED, question=text.question_text(_t()))


def _told(exactly: str = "") -> str:
    return rf"nullif(trim(regexp_extract(right(t, 200), '(?i)(?:answer is|equals|value is{exactly})[\s:]*([0-9a-zA-Z.\-\\/]+)', 1)), '')"


_TOLD = _cases("p_partkey", "p_name || '. The answer is: ' || p_size", "'value is exactly ' || p_size || ' and it EQUALS ' || p_brand", "p_name", "'the value is exactly ' || p_size", "'It equals ' || repeat('7', 150)")


@query(f"SELECT p_partkey, CASE WHEN length({_told()}) <= 100 THEN {_told()} END AS challenger, {_told('|is exactly')} AS solver FROM {_duck(_TOLD)}")
def told_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, _TOLD, challenger=text.challenger_answer(_t()), solver=text.solver_answer(_t()))


@query(rf"""
SELECT doc_id, coalesce(list_last(regexp_extract_all(t, '\\boxed\{{((?:[^{{}}]|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*)\}}', 1)), {_told('|is exactly')}, CASE WHEN len(regexp_extract_all(t, '[^\s\x0B]+')) > 50 THEN 'GUESSED_FAIL_FORMAT' END) AS answer
FROM (SELECT doc_id, text AS t FROM documents)""")
def solver_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.solver_answer(F.col("text")).alias("answer"))


_TAGS = _cases("p_partkey", "'<strategy> ' || substr('aBcDe', p_size % 5 + 1, 1) || ' </strategy>'", "p_name", "'<STRATEGY>F</STRATEGY>'")


@query(rf"SELECT p_partkey, nullif(upper(regexp_extract(t, '(?i)<strategy>\s*([A-E])\s*</strategy>', 1)), '') AS tag FROM {_duck(_TAGS)}")
def strategy_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, _TAGS, tag=text.strategy_tag(_t()))


_LABELS = _cases("p_partkey", "p_name || ' Text'", "repeat(p_name, 12)", "p_brand", "NULL")


@query(f"SELECT p_partkey, CASE WHEN NOT (contains(lower(t), 'text') OR length(t) > 100) THEN t END AS label FROM {_duck(_LABELS)}")
def clean_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, _LABELS, label=text.clean_label(_t()))


_ASKED = _cases("p_partkey", "'Show THAT ' || p_name || ' is made of ' || p_type", "p_brand", "p_name || ' has what size, of those in ' || p_type", "'True or false: ' || p_name || ' is ' || p_type")


@query(f"""
SELECT p_partkey, t AS question FROM {_duck(_ASKED)}
WHERE length(t) > 30 AND NOT ({" OR ".join(f"contains(lower(t), '{w}')" for w in text.FORBIDDEN)})""")
def well_formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, _ASKED, question=_t()).filter(text.is_well_formed(F.col("question")))


_LOOSE = _cases("p_partkey", r"'$\left( \dfrac{' || p_size || '}{7} \right)$'", r"' ' || p_type || ' \text{ cm} '", "p_name", f"{_NL} || ' ' || p_size || ' ' || p_brand || chr(9) || {_NL}")


@query(rf"""
SELECT p_partkey, replace({_bare_ends('t')}, ' ', '') AS tight,
  lower(regexp_replace(replace(replace(regexp_replace(t, '\\(left|right|,|!|;|displaystyle|mathrm|text)', '', 'g'), '\dfrac', '\frac'), '$', ''), '\s+', '', 'g')) AS loose
FROM {_duck(_LOOSE)}""")
def loose_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, _LOOSE, tight=text.spaceless(_t()), loose=text.loose_latex(_t()))


_THOUGHT = _cases(
    "p_partkey",
    r"'<think>' || p_name || '</think> so \boxed{' || p_size || '}'",
    f"'< think >' || p_name || {_NL} || '< / think ><answer>' || p_brand || '</answer>'",
    "'<think>' || p_name",
    r"'x <think></think>\boxed{1}'",
)
_TIGHT = r"regexp_replace(t, '\s*(<|>|/)\s*', '\1', 'g')"


@query(rf"""
SELECT p_partkey, boxed, tagged, {_r6('(1 - 0.1::DOUBLE) * accuracy + 0.1::DOUBLE * boxed')} AS reward FROM (
  SELECT p_partkey, (p_size % 2)::DOUBLE AS accuracy, regexp_matches({_TIGHT}, '(?s)^<think>.*</think>.*\\boxed\{{.*\}}.*$')::INT::DOUBLE AS boxed, regexp_matches({_TIGHT}, '(?s)^<think>.*</think>.*<answer>.*</answer>$')::INT::DOUBLE AS tagged
  FROM {_duck(_THOUGHT)})""")
def format_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxed = text.format_score(_t())
    reward = text.weighted_reward((F.col("p_size") % 2).cast("double"), boxed)
    return _said(spark, sf_dir, _THOUGHT, boxed=boxed, tagged=text.format_score(_t(), "<answer>.*</answer>"), reward=r6(reward))


_JUDGED = _cases("p_partkey", "'Valid, as ' || p_name", "' invalid: ' || p_name", "'it is INVALID'", "NULL", "'Yes, valid'", "p_name")


@query(f"""
SELECT p_partkey, NOT (contains(first, 'INVALID') OR (NOT starts_with(first, 'VALID') AND contains(substr(up, 1, 12), 'INVALID'))) AS kept, contains(lower(t), 'yes') AS yes
FROM (SELECT *, string_split(up, ' ')[1] AS first FROM (SELECT *, upper(trim(coalesce(t, ''))) AS up FROM {_duck(_JUDGED)}))""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, _JUDGED, kept=text.verdict(_t()), yes=text.says_yes(_t()))


_NAMED = _cases("p_partkey", "'org/model_iter_' || p_size", "'org/model_v' || p_size", "'org/model_base'")


@query(rf"SELECT p_partkey, replace(t, '/', '_') AS stem, nullif(regexp_extract(t, '(?:iter|v)_?(\d+)', 1), '')::INT AS iteration FROM {_duck(_NAMED)}")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, _NAMED, stem=text.file_stem(_t()), iteration=text.iteration_of(_t()))


@query(f"""
SELECT * FROM (SELECT p_partkey, 'Q' || p_partkey || ': ' || p_name || {_NL} || 'A. ' || p_brand || {_NL} || 'B. ' || p_type || {_NL} || '{{left}}' AS prompt FROM part) WHERE length(prompt) <= 60""")
def question_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = text.multiple_choice(F.col("p_name"), F.array("p_brand", "p_type"))
    made = text.prompt("Q{n}: {q}\n{left}", n=F.col("p_partkey"), q=asked)
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("prompt")).filter(text.fits(F.col("prompt"), 60))


_WRAPPED = _cases("p_partkey", "'The answer is: ' || p_name || '.'", "'$' || p_size || '$'", r"'\text{' || p_name || '}'", "'The final answer is ' || p_type", r"'\boxed{\text{' || p_brand || '}}'", "NULL", f"'The answer is:' || {_NL} || p_name || '.' || {_NL}", f"p_name || '.' || {_NL}")

def _bare(t: str) -> str:
    out = f"(SELECT p_partkey, coalesce(t, '') AS t FROM {t})"
    for p in text.ANSWER_PREFIXES:
        out = f"(SELECT p_partkey, CASE WHEN contains(t, '{p}') THEN {_bare_ends(f"list_last(string_split(t, '{p}'))")} ELSE t END AS t FROM {out})"
    out = rf"(SELECT p_partkey, regexp_replace(regexp_replace(t, '\.\z', ''), '(?s)^\$(.*)\$\z', '\1') AS t FROM {out})"
    for w in ("boxed{", "text{", "texttt{"):
        out = rf"(SELECT p_partkey, CASE WHEN contains(t, '{w}') AND ends_with(t, '}}') THEN string_split(regexp_replace(t, '\}}\z', ''), '{w}')[2] ELSE t END AS t FROM {out})"
    return out


@query(f"SELECT p_partkey, t AS answer FROM {_bare(_duck(_WRAPPED))}")
def bare_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, _WRAPPED, answer=text.bare_answer(_t()))


_PREDICTED = _cases(
    "p_partkey",
    f"{_NL} || {_NL} || 'The answer is: **' || p_name || ', ' || p_brand || '**.' || {_NL} || 'Because.'",
    f"chr(9) || p_type || '.' || {_NL}",
    "'The answer is: $' || p_size || '$.'",
    f"p_brand || '.' || {_NL} || p_size",
    "NULL",
)


@query(rf"""
WITH a AS (SELECT p_partkey, t AS answer FROM {_bare(f"(SELECT p_partkey, {_bare_ends('t')} AS t FROM {_duck(_PREDICTED)})")}),
p AS (SELECT p_partkey, string_split(replace(replace(lower(answer), ', ', ','), '**', ''), chr(10))[1] AS p FROM a)
SELECT p.p_partkey, CASE WHEN ends_with(p, '.') THEN left(p, length(p) - 1) ELSE p END AS prediction, replace(lower({_bare_ends('t')}), ', ', ',') AS truth
FROM p JOIN {_duck(_PREDICTED)} d ON p.p_partkey = d.p_partkey""")
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and references as they are compared."""
    return _said(spark, sf_dir, _PREDICTED, prediction=text.prediction_text(_t()), truth=text.reference_text(_t()))


_SOLVED = _cases(
    "p_partkey",
    r"'<|im_start|>user \boxed{0}<|im_start|>assistant so \boxed{' || p_size || '}<|im_end|> \boxed{1}'",
    f"'Assistant: x' || {_NL} || 'Final Answer: ' || p_name || {_NL}",
    f"'The answer is: ' || p_brand || {_NL} || '</s>Final Answer: none' || {_NL}",
    "p_name",
    f"'Assistant: x' || {_NL} || 'Final Answer: ' || p_name || {_NL} || 'that is all' || {_NL}",
    f"'The answer is: ' || p_brand || {_NL} || 'so it is</s>Final Answer: none' || {_NL}",
    f"'Final Answer: ' || p_type || {_NL}",
)


def _until(stop: str, rows: str) -> str:
    return f"(SELECT p_partkey, CASE WHEN contains(t, '{stop}') THEN {_bare_ends(f"string_split(t, '{stop}')[1]")} ELSE t END AS t FROM {rows})"


_SPOKEN = rf"""(SELECT p_partkey, CASE WHEN contains(t, '<|im_start|>user') THEN regexp_replace(t, '(?s)^.*?<\|im_start\|>assistant', '')
  WHEN contains(t, 'Assistant:') THEN {_bare_ends("list_last(string_split(t, 'Assistant:'))")} ELSE t END AS t FROM {_duck(_SOLVED)})"""


@query(rf"""
SELECT p_partkey, coalesce(nullif(list_last(regexp_extract_all(t, '\\boxed\{{((?:[^{{}}]|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*)\}}', 1)), ''),
  list_last(regexp_extract_all(t, 'Final Answer:((?:[^<]|<[^<])*?)\n', 1)), list_last(regexp_extract_all(t, 'The answer is:((?:[^<]|<[^<])*?)\n', 1))) AS answer
FROM {_until('<|endoftext|>', _until('<|im_end|>', _until('</s>', _SPOKEN)))}""")
def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, _SOLVED, answer=text.solution_text(_t()))


_DEEP = _cases(
    "p_partkey",
    r"'\boxed{' || p_size || '} so \boxed{a{b{c{' || p_brand || '}}}}'",
    r"'\boxed{a} then {' || p_name",
    r"'\boxed{open ' || p_name || '. The answer is: ' || p_size",
    "p_name",
    r"'x \boxed{ ' || p_name || ' } y } z'",
    r"'\boxed{} is exactly ' || p_size",
)
_DEEP_DUCK = rf"""(SELECT p_partkey, t, CASE WHEN contains(t, '\boxed{{') THEN trim(left(tail, list_min(list_filter(range(1, length(tail) + 1),
  lambda i: 1 + (i - length(replace(left(tail, i), '{{', ''))) = i - length(replace(left(tail, i), '}}', '')))) - 1)) END AS body
  FROM (SELECT *, list_last(string_split(t, '\boxed{{')) AS tail FROM {_duck(_DEEP)}))"""


@query(f"SELECT p_partkey, body AS answer FROM {_DEEP_DUCK}")
def boxed_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, _DEEP, answer=text.last_boxed_any_depth(_t()))


@query(f"SELECT p_partkey, coalesce(nullif(body, ''), {_told()}) AS challenger, coalesce(body, {_told('|is exactly')}) AS solver FROM {_DEEP_DUCK}")
def deep_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, _DEEP, challenger=text.challenger_answer(_t()), solver=text.solver_answer(_t()))


_GRADED = [
    (r"'\frac{' || p_size || '}{4}'", "p_size || '*0.25'", "true"),
    (r"'\sqrt{' || p_size * p_size || '}'", "p_size || ''", "true"),
    (r"p_size || '\%'", "p_size || '/100'", "true"),
    ("p_size || ''", "(p_size + 1) || ''", "false"),
    ("'x + ' || p_size", "p_size || ''", "NULL"),
    ("p_name", "p_name", "true"),
    (r"'\boxed{2^{' || p_size % 10 || '}}'", "'2^' || p_size % 10", "true"),
    ("' ' || p_size || ' '", "p_size || '.0'", "true"),
]


_FORMS = [
    ("'x+' || p_size", "p_size || '+x'", "true"),
    ("'2x'", "'x*2'", "true"),
    (r"'\frac12'", "'0.5'", "true"),
    ("'3!'", "'6'", "true"),
    (r"'\{' || p_size || ', 99\}'", r"'\{99, ' || p_size || '\}'", "true"),
    (r"'\sin(0)'", "'0'", "true"),
    (r"'(x+' || p_size || ')^2'", r"'x^2+' || 2 * p_size || 'x+' || p_size * p_size", "true"),
    (r"'\frac{x^2-' || p_size * p_size || '}{x-' || p_size || '}'", "'x+' || p_size", "true"),
    (r"'\sqrt{' || 2 * p_size * p_size || '}y'", r"p_size || '\sqrt{2}y'", "true"),
    ("'x+' || p_size", "'x+' || (p_size + 1)", "false"),
    ("'(' || p_size || ', 1)'", "'(1, ' || (p_size + 1) || ')'", "false"),
    ("'[0, ' || p_size || ')'", r"'\left[0, \frac{' || 2 * p_size || '}{2}\right)'", "true"),
    (r"'\sin x'", r"'\cos x'", "NULL"),
    ("p_name", "p_type", "NULL"),
]


@query(f"SELECT p_partkey, ({_cases('p_partkey', *[g for _, _, g in _FORMS])})::BOOLEAN AS grade FROM part")
def graded_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether expressions with names, tuples, intervals and sets in different written forms are the same."""
    columns = [F.expr(_cases("p_partkey", *said).replace("\\", "\\\\")) for said in list(zip(*_FORMS, strict=True))[:2]]
    rows = table(spark, sf_dir, "part").select("p_partkey", columns[0].alias("said"), columns[1].alias("truth"))
    return text.with_grade(rows, "said", "truth", decide=True).select("p_partkey", "grade")


#: Answers in several written forms, and the class that each is in; a negation is one in either case.
_WRITTEN = [("1/2", 0), ("0.5", 0), (r"\frac12", 0), (r"\frac{2}{4}", 0), ("x+1", 1), ("1+x", 1), (r"\frac{2x+2}{2}", 1), ("No solution", 2), ("there is no answer", 2), ("NO way", 2), ("(1, 2)", 3), ("(1, 4/2)", 3), ("17", 4), ("seventeen", 5)]


def _written_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.element_at(F.array(*[F.lit(a) for a, _ in _WRITTEN]), (F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(len(_WRITTEN))) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("sample_idx"), F.when(F.col("event_id") % 11 > 0, answer).alias("answer"))


@query(f"""
WITH forms(k, answer, class) AS (VALUES {", ".join(f"({i}, '{a}', {c})" for i, (a, c) in enumerate(_WRITTEN))}),
v AS (SELECT user_id AS qid, event_id, answer, class FROM events JOIN forms ON k = (event_id * 7 + user_id) % {len(_WRITTEN)} WHERE event_id % 11 > 0),
c AS (SELECT qid, class, arg_min(answer, event_id) AS label, min(event_id) AS first, count(*)::BIGINT AS n_votes FROM v GROUP BY 1, 2),
p AS (SELECT *, (sum(n_votes) OVER (PARTITION BY qid))::BIGINT AS n_samples, row_number() OVER (PARTITION BY qid ORDER BY n_votes DESC, first) AS place FROM c)
SELECT e.qid, label, coalesce(n_votes, 0)::BIGINT AS n_votes, coalesce(n_samples, 0)::BIGINT AS n_samples, {_r6('coalesce(n_votes / n_samples, 0)')} AS p_hat
FROM (SELECT DISTINCT user_id AS qid FROM events) e LEFT JOIN p ON e.qid = p.qid AND place = 1""")
def graded_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes by classes of answers that the grader takes for the same."""
    found = vote.equivalence_vote(_written_votes(spark, sf_dir))
    return found.withColumn("p_hat", r6(F.col("p_hat")))


@query(f"SELECT p_partkey, ({_cases('p_partkey', *[g for _, _, g in _GRADED])})::BOOLEAN AS grade FROM part")
def graded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an answer equals the true one as text or in value; null where that can't be told."""
    columns = [F.expr(_cases("p_partkey", *said).replace("\\", "\\\\")) for said in list(zip(*_GRADED, strict=True))[:2]]
    rows = table(spark, sf_dir, "part").select("p_partkey", columns[0].alias("said"), columns[1].alias("truth"))
    return text.with_grade(rows, "said", "truth").select("p_partkey", "grade")


_OPTIONS = _cases("p_partkey", "'the answer is (' || chr(65 + p_size % 10) || ')'", "'J or ' || chr(66 + p_size % 8)", "lower(p_name) || ' C, not A'")


@query(f"SELECT p_partkey, list_filter(string_split('A,B,C,D,E,F,G,H,I,J', ','), lambda c: contains(t, c))[1] AS letter FROM {_duck(_OPTIONS)}")
def option_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, _OPTIONS, letter=text.option_letter(_t(), F.col("p_partkey")))


@query(f"""
SELECT p_partkey, {_r6("CASE WHEN coalesce(q, '') <> '' THEN least(s, 1 - s) ELSE -1 END - share")} AS reward
FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS s, (p_partkey % 5) / 10.0::DOUBLE AS share, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_name END AS q FROM part)""")
def challenger_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertain questions are worth more, those of a large cluster less, missing ones -1."""
    asked = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.col("p_name"))
    reward = losses.challenger_reward(F.col("p_size") / 50, (F.col("p_partkey") % 5) / 10, asked)
    return table(spark, sf_dir, "part").select("p_partkey", r6(reward).alias("reward"))


_PROOFS = _cases("p_partkey", "'证明 ' || p_name", "'a BOX of ' || p_name", "p_name", "p_brand")


@query(f"SELECT p_partkey, NOT (contains(t, '证明') OR contains(lower(t), 'box') OR p_size % 7 = 0) AS kept FROM {_duck(_PROOFS)}")
def row_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, _PROOFS, kept=text.can_be_graded(_t(), F.when(F.col("p_size") % 7 == 0, "some Text").otherwise("5")))


_BOXES = _cases("p_partkey", r"'\boxed{' || p_name || '} and \boxed{' || p_size || '}'", "p_name", r"'\boxed{}'", r"'x \boxed{' || p_brand || '} y'")
_BODIES = r"regexp_extract_all(t, '\\boxed\{([^{}]*)\}', 1)"


@query(f"SELECT p_partkey, array_to_string({_BODIES}, '|') AS bodies, len({_BODIES})::INT AS n FROM {_duck(_BOXES)}")
def all_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, _BOXES, bodies=F.array_join(text.all_boxed(_t()), "|"), n=F.size(text.all_boxed(_t())))


_REPLIES = _cases(
    "p_partkey",
    r"'<think>a</think> \boxed{' || p_size || '}'",
    r"'<think>a</think> \boxed{' || (p_size + 1) || '}'",
    r"'\boxed{' || p_size || '.0}'",
    "'<think>a</think><answer> ' || p_size || ' </answer>'",
)


@query(f"SELECT p_partkey, {_cases('p_partkey', '1.0', '0.1', '0.9', '0.0')}::DOUBLE AS math, {_cases('p_partkey', '0.0', '0.0', '0.0', '1.0')}::DOUBLE AS tagged FROM part")
def plugin_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overall reward of the two registered plugins."""
    truth = F.col("p_size").cast("string")
    return _said(spark, sf_dir, _REPLIES, math=r6(rewards.SCALAR["math"](_t(), truth)["overall"]), tagged=r6(rewards.SCALAR["answer_tag"](_t(), truth)["overall"]))


_INFIX = [
    (r"'\frac{' || p_size || '}{4}x'", "'((' || p_size || '/4)*x)'"),
    (r"'\sqrt{' || p_size || '}'", "'sqrt(' || p_size || ')'"),
    ("'2x^{3}-' || p_size", "'((2*(x**3))-' || p_size || ')'"),
    (r"'' || p_size || '\%'", "'(' || p_size || '/100)'"),
    (r"'\left(' || p_size || ' \cdot 7\right)'", "'(' || p_size || '*7)'"),
    (r"'\frac12'", "'(1/2)'"),
    (r"'\int x'", "NULL"),
    ("'-' || p_size || '+1.5'", "'((-' || p_size || ')+(3/2))'"),
]


@query(f"SELECT p_partkey, {_cases('p_partkey', *[plain for _, plain in _INFIX])} AS infix FROM part")
def infix_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions in LaTeX written out in plain infix form."""

    @F.pandas_udf("string")
    def plain(said: pd.Series) -> pd.Series:
        return said.map(text.infix)

    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_cases("p_partkey", *[said for said, _ in _INFIX]).replace("\\", "\\\\")).alias("said"))
    return rows.select("p_partkey", plain("said").alias("infix"))
