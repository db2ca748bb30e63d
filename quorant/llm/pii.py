r"""Personal data by weak supervision.

Candidate spans come from the base patterns (email, ip, card, phone), from
further patterns (masked e-mail addresses, social security and bank account
numbers, local phone numbers, dates of birth) and from a gazetteer (first names
and honorifics before a capitalised word). Labelers vote on every candidate:
pattern, gazetteer, context before, context after, shape. Each says private
(1), not private (-1) or nothing (0).

1. One pass writes each document's base spans and its candidates, each with its
   votes and its shape: how long it is, how many digits and words it has, what
   stands beside it, and hashes of the words before and after.
2. Votes are counted by pattern of votes and kind over the whole corpus: at
   most 3^5 x 10 rows. Expectation-maximisation on these counts estimates each
   labeler's reliability (how often it says what, given the truth) and every
   pattern's posterior.
3. A logistic regression on kind, votes and shape is trained on the posteriors,
   weighted by count, and decides on the candidates: on all distinct patterns of
   votes and shape, or the TRAINED that hash first. Its spans are added; base
   spans stay.

Null texts count as empty. Texts without spans have empty strings. Repeated
rows each get a row and count in the estimates. Without candidates no
classifier is needed. An empty table gives no rows. Whole texts are searched, in
time that grows with their length alone. Other columns are ignored. Positions are code points;
digits are those of ASCII.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise

BASE = ["email", "ip", "card", "phone"]
ADDED = ["masked_email", "ssn", "iban", "local_phone", "birth_date", "person"]
KINDS = BASE + ADDED
LABELERS = ["pattern", "gazetteer", "before", "after", "shape"]

#: An e-mail address is searched from its @, so that long runs without one cost no more than their length.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never starts within a run of digits: what follows the run is the same for all its digits.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MASKED = re.compile(r"[A-Za-z0-9._%+-]{2,64} ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]{2,64}(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]{2,32}){1,4}", re.IGNORECASE)
#: Part of every masked address.
AT = re.compile(r"[\[({] ?[aA][tT] ?[\])}]")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])")
BIRTH = re.compile(r"(?<![0-9])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9])|(?<![0-9/])(?:0?[1-9]|[12][0-9]|3[01])[/.](?:0?[1-9]|1[0-2])[/.](?:19|20)[0-9]{2}(?![0-9])")
#: Gazetteers; a longer list of first names can be given to `find_private`.
FIRST_NAMES = frozenset(
    "James Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Donald Steven Andrew Kenneth Joshua Kevin Brian George Timothy Ronald Jason Edward Jeffrey "
    "John Mark Paul Peter Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Frank Raymond Jack Dennis Henry Adam Simon Oliver Martin "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Lisa Betty Sandra Ashley Dorothy Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie "
    "Anna Maria Julia Laura Rebecca Sharon Cynthia Kathleen Amy Angela Shirley Brenda Emma Olivia Pamela Nicole Helen Samantha Katherine Christine Rachel Catherine Alice Ruth Sophie Eva Clara "
    "Hans Jürgen Wolfgang Klaus Günter Ursula Monika Sabine Stefan Andreas Matthias Thorsten Uwe Heinz Karl Dieter Petra Claudia Birgit Heike Katrin Ingrid Renate Anja "
    "Pierre Jacques François Françoise Nathalie Jean Michel Philippe Alain Nicolas Laurent Julien Antoine Camille Isabelle Sylvie Valérie Élodie Céline "
    "José Francisco Javier Carmen Josefa Dolores Miguel Juan Manuel Antonio Carlos Pedro Luis Jorge Diego Pablo Lucía Pilar Teresa Elena Marta Rosa Isabel".split()
)
HONORIFICS = frozenset("Mr Mrs Ms Dr Prof Mme Mlle Herr Frau Señor Señora Mr. Mrs. Ms. Dr. Prof. Mme. Sr. Sra.".split())
_MARKS = FIRST_NAMES | HONORIFICS
CAPITALISED = re.compile(r"[A-ZÀ-Þ]\w+")
_STEMS = sorted({h.rstrip(".") for h in HONORIFICS})
PERSON = re.compile(r"(?<!\w)(?:(?:%s)\.? )*[A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+)+" % "|".join(_STEMS))
#: Runs after which a match of PERSON can go on, with what follows: a capitalised word, or the full stop of an honorific.
GOES_ON = re.compile(r"(?<![\w'-])[\w'-]++(?=( [A-ZÀ-Þ][\w'-])|\. )")
CAPITAL = re.compile(r"(?<!\w)[A-ZÀ-Þ]")
TITLE = re.compile(r"(?<!\w)(?:%s)\. " % "|".join(_STEMS))
TITLES = re.compile(r"(?:(?:%s)\.? )*" % "|".join(_STEMS))
BEFORE = re.compile(r"(?:e-?mail|contact|phone|tel|call|fax|mobile|reach|write to|card|ssn|social security|iban|account|born|birth|dob|name is|named|signed|patient|dear|by|ip|address|from)\W{0,4}(?:is|at|no|on)?\W{0,3}$", re.IGNORECASE)
NOT_BEFORE = re.compile(r"(?:version|v|release|isbn|issn|section|chapter|figure|table|order|invoice|ticket|page|pp|doi|lot|part|build|revision)\W{0,3}(?:no|nr|number)?\W{0,3}$", re.IGNORECASE)
AFTER = re.compile(r"^\W{0,3}(?:for (?:details|questions|help)|or call|expires|exp\b|ext\b|lives|born|@|\(home\)|\(mobile\)|wrote|said)", re.IGNORECASE)
NOT_AFTER = re.compile(r"^\W{0,3}(?:pages|units|items|EUR|USD|km|kg|mm|percent|%)", re.IGNORECASE)
#: Characters of context that a labeler sees.
CONTEXT = 32
#: Most distinct patterns of votes and shape that the classifier is trained on.
TRAINED = 20_000
#: What a shape holds, with the number of its values: length in fives, digits in fours, words, character before and after, hash of the word before and after.
SHAPE = {"length": 8, "digits": 5, "words": 4, "left": 4, "right": 4, "word_before": 8, "word_after": 8}
SHAPES = math.prod(SHAPE.values())
_DIGITS = frozenset("0123456789")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def emails(text: str) -> list[Span]:
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((0, begin, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[Span]:
    found = emails(text)
    found += [(1, *m.span()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
    for m in CARD.finditer(text):
        if len(m[0]) >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def _valid_iban(said: str) -> bool:
    s = said.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _pattern_vote(kind: int, said: str) -> int:
    if kind < 4 or KINDS[kind] in ("masked_email", "ssn"):
        return 1
    if KINDS[kind] == "iban":
        return 1 if _valid_iban(said) else -1
    return 0


def _shape_vote(kind: int, said: str) -> int:
    digits = [c for c in said if c in _DIGITS]
    if digits and (len(set(digits)) == 1 or len(digits) > 3 and all(int(b) - int(a) == 1 for a, b in pairwise(digits))):
        return -1  # a stand-in: one digit over and over, or counting up
    if KINDS[kind] == "person":
        return 1 if 2 <= len(said.split()) <= 4 else -1
    return 1 if len(digits) >= 7 or "@" in said else 0


def votes(text: str, span: Span, names: frozenset[str] = FIRST_NAMES) -> list[int]:
    """One of -1, 0, 1 by each labeler."""
    kind, a, b = span
    said, before, after = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    words = said.split()
    named = any(w in names for w in words) + any(w in HONORIFICS for w in words)
    return [
        _pattern_vote(kind, said),
        (1 if named and words[-1] not in names and words[-1] not in HONORIFICS else -1) if KINDS[kind] == "person" else 0,
        1 if BEFORE.search(before) else -1 if NOT_BEFORE.search(before) else 0,
        1 if AFTER.search(after) else -1 if NOT_AFTER.search(after) else 0,
        _shape_vote(kind, said),
    ]


def shape(text: str, span: Span) -> int:
    """What the span and its surroundings look like, as one number below SHAPES."""
    _, a, b = span
    said, before, after = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    beside = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3
    word = lambda ws, n: zlib.crc32(ws[0].strip(".,:;()[]").lower().encode()) % (n - 1) + 1 if ws else 0
    found = {
        "length": min(len(said) // 5, 7),
        "digits": min(sum(c in _DIGITS for c in said) // 4, 4),
        "words": min(said.count(" "), 3),
        "left": beside(before[-1:]),
        "right": beside(after[:1]),
        "word_before": word(before.split()[-1:], SHAPE["word_before"]),
        "word_after": word(after.split()[:1], SHAPE["word_after"]),
    }
    code = 0
    for name, n in SHAPE.items():
        code = code * n + found[name]
    return code


def persons(text: str) -> list[tuple[int, int]]:
    """The matches of PERSON, leftmost and non-overlapping, in time linear in the text.

    A match starts at a capital of a run that another capitalised word follows, or at an honorific with a full stop. Of a
    chain of honorifics that starts no match, none does.
    """
    found, end, dead = [], 0, 0
    for run in GOES_ON.finditer(text):
        if run.end() <= end:
            continue
        starts = CAPITAL.finditer(text, max(run.start(), end), run.end()) if run[1] else TITLE.finditer(text, max(run.start(), end, dead), run.end() + 2)
        for start in starts:
            if m := PERSON.match(text, start.start()):
                found.append(m.span())
                end = m.end()
                break
            if not run[1]:
                dead = TITLES.match(text, start.start()).end()
    return found


def added_candidates(text: str, base: list[Span], names: frozenset[str] = FIRST_NAMES) -> list[Span]:
    """Further candidates, none overlapping a base span or one before it."""
    found: list[Span] = []
    if AT.search(text):
        found += [(4, *m.span()) for m in MASKED.finditer(text)]
    for kind, pattern in ((5, SSN), (6, IBAN), (7, LOCAL_PHONE), (8, BIRTH)):
        found += [(kind, *m.span()) for m in pattern.finditer(text)]
    # A name or honorific within a match of PERSON has no word character beside it, so it is among the text's words (or ends of words) with a capital.
    words = CAPITALISED.findall(text)
    if not names.isdisjoint(words) or any(w in HONORIFICS for w in words):
        found += [(9, a, b) for a, b in persons(text) if not names.isdisjoint(said := text[a:b].split()) or not HONORIFICS.isdisjoint(said)]
    taken: list[tuple[int, int]] = []  # disjoint, in order
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(b, taken[-1][1])
        else:
            taken.append((a, b))
    kept: list[Span] = []
    for kind, a, b in found:
        i = bisect.bisect_left(taken, (a, b))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
            taken.insert(i, (a, b))
            kept.append((kind, a, b))
    return kept


def _code(kind: int, vs: list[int]) -> int:
    for v in vs:
        kind = kind * 3 + v + 1
    return kind


def _uncode(code: int) -> tuple[int, list[int]]:
    vs = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        vs.append(v - 1)
    return code, vs[::-1]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base", pa.list_(pa.int32())), ("added", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32()))])


def label(docs: DataFrame, names: frozenset[str] = FIRST_NAMES) -> DataFrame:
    """doc_id, counts, base spans and candidates (flat kind, start, end), and of each base span and candidate a code: its votes' times SHAPES, plus its shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                base = base_spans(text)
                added = added_candidates(text, base, names)
                codes = [_code(s[0], votes(text, s, names)) * SHAPES + shape(text, s) for s in base + added]
                rows.append((doc, *(sum(s[0] == k for s in base) for k in range(4)), [x for s in base for x in s], [x for s in added for x in s], codes))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(FOUND), FOUND, strict=True)], schema=FOUND)

    counts = ", ".join(f"n_{k} long" for k in BASE)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {counts}, base array<int>, added array<int>, codes array<int>")


def estimate(counts: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of each vote code, and P(vote | truth) as [truth, labeler, vote for], by expectation-maximisation. A labeler that abstains says nothing."""
    codes = sorted(counts)
    v = np.array([_uncode(c)[1] for c in codes])
    n = np.array([counts[c] for c in codes], float)
    posterior = np.where(v.sum(axis=1) > 0, 0.9, np.where(v.sum(axis=1) < 0, 0.1, 0.5))
    said = np.stack([v == k for k in (-1, 1)], axis=2)  # [code, labeler, vote]
    # A labeler is taken to be better than chance: pseudo-counts say so until data do.
    prior = np.array([[4.0, 1.0], [1.0, 4.0]])
    rates = np.zeros((2, len(LABELERS), 2))
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * n, posterior * n])
        rates = np.einsum("tc,clv->tlv", weight, said) + prior[:, None, :]
        rates /= rates.sum(axis=2, keepdims=True)
        share = (weight.sum(axis=1) + 1) / (n.sum() + 2)
        logs = np.log(share)[:, None] + np.einsum("clv,tlv->tc", said, np.log(rates))
        now = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(now - posterior).max() < 1e-6:
            break
        posterior = now
    return dict(zip(codes, posterior.tolist(), strict=True)), rates


_STARTS = list(accumulate(SHAPE.values(), initial=1 + len(KINDS) + 2 * len(LABELERS)))


def _features(code: int) -> np.ndarray:
    """Of a code as `label` makes it: one value for each kind, vote of each labeler and value of the shape."""
    pattern, said = divmod(code, SHAPES)
    kind, vs = _uncode(pattern)
    x = np.zeros(_STARTS[-1])
    x[0] = 1
    x[1 + kind] = 1
    for i, v in enumerate(vs):
        if v:
            x[1 + len(KINDS) + 2 * i + (v > 0)] = 1
    for start, n in zip(reversed(_STARTS[:-1]), reversed(SHAPE.values()), strict=True):
        said, value = divmod(said, n)
        x[start + value] = 1
    return x


def train(patterns: dict[int, int], counts: dict[int, int]) -> np.ndarray:
    """Weights of the span classifier: logistic regression, by Newton steps with a ridge, on the posteriors that EM finds from `patterns` (counts of votes), for `counts` (of votes and shapes)."""
    posterior, _ = estimate(patterns)
    x = np.array([_features(c) for c in counts])
    y = np.array([posterior[c // SHAPES] for c in counts])
    n = np.log1p(np.array([counts[c] for c in counts], float))  # tempered, so that rare patterns count
    # Shapes get a stronger ridge than votes: they refine what the labelers say.
    ridge = np.where(np.arange(x.shape[1]) < _STARTS[0], 0.05, 2.0)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + ridge * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w -= np.linalg.solve(curve, slope)
    return w


class _Decisions(dict):
    """Codes -> whether the classifier says private."""

    def __init__(self, weights: np.ndarray | None) -> None:
        self.weights = weights

    def __missing__(self, code: int) -> bool:
        if len(self) > 1 << 16:
            self.clear()
        self[code] = found = bool(_features(code) @ self.weights >= 0)
        return found


def find_private(docs: DataFrame, names: frozenset[str] = FIRST_NAMES, trained: int = TRAINED) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 and spans of each document."""
    found = materialise(label(docs, names), "pii-votes")
    codes = found.select(F.explode("codes").alias("code"))
    patterns = dict(codes.groupBy(F.expr(f"code div {SHAPES}").alias("pattern")).count().collect())  # 3^5 patterns x kinds at most
    w = None
    if patterns:
        counts = dict(codes.groupBy("code").count().orderBy(F.xxhash64("code"), "code").limit(trained).collect())
        w = train(patterns, counts)

    names = [*(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        private = _Decisions(w)
        triples = lambda flat: [tuple(flat[i : i + 3]) for i in range(0, len(flat), 3)]
        for batch in batches:
            digests, spans = [], []
            for base, added, codes in zip(*(batch.column(i).to_pylist() for i in (5, 6, 7)), strict=True):
                base = triples(base)
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(base + [s for s, c in zip(triples(added), codes[len(base) :], strict=True) if private[c]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *names])

    return found.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(documents(spark, sf_dir))
