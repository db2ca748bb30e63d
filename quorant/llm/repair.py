r"""Conversation structure repair by weighted finite-state composition.

Three machines are composed lazily: an acceptor of a conversation's rows, a
transducer of edits, and an acceptor of role initials, `(s?(ua)+)?`. Edits are
Keep, Rerole to user or assistant, Delete, and Insert of an empty user or
assistant row. A weight is a pair (cost, labels) in lexicographic order, labels
being the edits' initials in turn; the shortest path is the repair, and among
equal costs the one whose labels are least in ASCII. Three inserts in a row would
go through a role state twice, so the transducer stops at three and the
composition has no cycle. Relaxing it in reverse topological order prepends
labels, which keeps the order of strings even where one begins another.

1. Damage and faults are built-in functions. Equal rows become one with a count,
   map-side first; whether a role and text came before is a join with their least
   turn.
2. Rows are dealt by ranges of (conversation, turn, role, text), so a long
   conversation spreads over many tasks. Each piece of at most `PIECE` rows gives
   the weights of the shortest paths from each role state to each other one.
3. A conversation's pieces meet first, multiplied from the last to the first,
   then its rows stream past once, in order, through the edits into the digest of
   the repaired text. A task holds one conversation's labels (a byte a row, 16
   times while they are multiplied) and one batch of texts. The digest is one
   chain over a conversation's text, so one task reads it, without holding it.

Defined results: nulls count as one space; rows of one turn come in order of role
and text; the initial of an empty role is a space; null turns come first; rows
with null conv_id are one conversation. Every conversation of the input has a row;
without rows after damage it has zeros, no labels and the digest of an empty
text. Repeated rows are rows of their own. An empty table gives no rows. Very long
texts pass by; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Rows of a piece.
PIECE = 2_048
DAMAGES = 20
_SEEN = r"[^\x20\x09-\x0D]"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3

#: The role grammar: state -> initial -> state. Accepting: START, AFTER_A.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
GRAMMAR = {START: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
ACCEPTING = (START, AFTER_A)
LEGAL = {"su", "ua", "au"}
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED_COST, MOST_INSERTS = 3, 3
NAMES = {"u": "user", "a": "assistant"}

Weight = tuple[int, str]
Vector = dict[int, Weight]


@lru_cache(maxsize=4096)
def row_arcs(initial: str, fault: int) -> list[tuple[int, str, int, int]]:
    """The composition's arcs (cost, label, role state, role state after) over one row."""
    arcs = [(COSTS["D"], "D", q, q) for q in GRAMMAR]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED_COST * (fault == TRUNCATED)
        for q, after in GRAMMAR.items():
            arcs += [(COSTS["K"] + more, "K", q, after[initial])] if initial in after else []
            arcs += [(COSTS["R"] + more, "R", q, after[to]) for to in NAMES if to in after]
    return arcs


#: Arcs (role state, role state after) of one insert.
INSERTS = [(q, after[to]) for q, after in GRAMMAR.items() for to in NAMES if to in after]


def _lesser(found: Vector, q: int, weight: Weight) -> None:
    if q not in found or weight < found[q]:
        found[q] = weight


def before_inserts(rest: Vector) -> Vector:
    """The least weights from each role state to the end, given those after at most MOST_INSERTS inserts."""
    layer, found = rest, dict(rest)
    for _ in range(MOST_INSERTS):
        earlier: Vector = {}
        for q, to in INSERTS:
            if to in layer:
                cost, labels = layer[to]
                _lesser(earlier, q, (cost + COSTS["I"], "I" + labels))
        for q, weight in earlier.items():
            _lesser(found, q, weight)
        layer = earlier
    return found


def before_row(rest: Vector, initial: str, fault: int) -> Vector:
    """As `before_inserts`, given the weights after one row and the inserts before it."""
    found: Vector = {}
    for more, label, q, to in row_arcs(initial, fault):
        if to in rest:
            cost, labels = rest[to]
            _lesser(found, q, (cost + more, label + labels))
    return before_inserts(found)


def piece_paths(rows: list[tuple[str, int]]) -> dict[int, Vector]:
    """For each role state after the rows (initial, fault): the least weight from each state before them."""
    found = {}
    for end in GRAMMAR:
        rest: Vector = {end: (0, "")}
        for initial, fault in reversed(rows):
            rest = before_row(rest, initial, fault)
        found[end] = rest
    return found


def before_piece(rest: Vector, paths: dict[int, Vector]) -> Vector:
    found: Vector = {}
    for end, starts in paths.items():
        if end in rest:
            cost, labels = rest[end]
            for q, (own, said) in starts.items():
                _lesser(found, q, (own + cost, said + labels))
    return found


def last_vector() -> Vector:
    """The weights after all rows: inserts, then an accepting state."""
    return before_inserts({q: (0, "") for q in ACCEPTING})


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (1 or 2) of the rows left by the damage, which the crc32 of `conv_id:turn` decides."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % DAMAGES
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(kind == 4, "user").otherwise(spaced("role"))
    left = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"), kind.alias("kind"))
    return left.filter("kind != 0").drop("kind")


def faulted(rows: DataFrame) -> DataFrame:
    """Equal rows (conv_id, turn, role, text, copies) as one, with the initial of the role and the fault of the first copy."""
    text_hash = F.sha2("text", 256)
    equal = materialise(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("said", text_hash), "repair-rows")
    # A null turn comes before all others.
    first = equal.groupBy("conv_id", "role", "said").agg(F.min(F.struct(F.col("turn").isNotNull().alias("there"), "turn")).alias("first"))
    met = equal.alias("r").join(first.alias("f"), F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.role") == F.col("f.role")) & (F.col("r.said") == F.col("f.said")))
    blank = ~F.col("text").rlike(_SEEN)
    again = ~F.col("r.turn").eqNullSafe(F.col("first.turn"))
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, BLANK).when(again, DUPLICATE).when(cut, TRUNCATED).otherwise(0)
    initial = F.when(F.col("r.role") == "", " ").otherwise(F.substring("r.role", 1, 1))
    return met.select("r.conv_id", "r.turn", "r.role", "text", "copies", initial.alias("initial"), fault.alias("fault"))


ORDER = ["conv_id", "turn", "role", "text"]
_COUNTS = "blank long, duplicate long, truncated long, illegal long"
#: least, most, turns: of the turns that are not null, the last being their number.
_PIECES = f"conv_id long, nth long, rows long, first string, last string, least long, most long, turns long, {_COUNTS}, ends array<int>, starts array<int>, costs array<long>, labels array<string>"


def pieces(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """A row for each piece of a conversation, nth numbering them in order of turn: counts, edges and shortest paths."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in ORDER]
    ranged = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
    ranged = ranged.select("conv_id", "turn", "initial", "fault", "copies", F.spark_partition_id().cast("long").alias("part"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int]] = []
        turns: list[int] = []
        now, number, part = None, 0, 0

        def told() -> dict:
            nonlocal held, turns, number
            paths = piece_paths(held)
            cells = [(end, q, *weight) for end, starts in paths.items() for q, weight in starts.items()]
            faults, initials = [f for _, f in held], [i for i, _ in held]
            row = {
                "conv_id": now, "nth": part << 32 | number, "rows": len(held), "first": initials[0], "last": initials[-1], "least": turns[0] if turns else None, "most": turns[-1] if turns else None, "turns": len(turns),
                "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
                "ends": [c[0] for c in cells], "starts": [c[1] for c in cells], "costs": [c[2] for c in cells], "labels": [c[3] for c in cells],
            }
            held, turns, number = [], [], number + 1
            return row

        for batch in batches:
            out = []
            for conv, turn, initial, fault, copies, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007
                if held and conv != now:
                    out.append(told())
                now = conv
                for copy in range(copies):
                    held.append((initial, fault if not copy or fault == BLANK else DUPLICATE))
                    if turn is not None and (not turns or turns[-1] != turn):
                        turns.append(turn)
                    if len(held) >= piece:
                        out.append(told())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([told()], schema=schema)

    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": ints, "array<long>": longs, "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in _PIECES.split(", "))])
    return ranged.mapInArrow(cut, _PIECES)


_RESULT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def summary(parts: list[dict]) -> dict:
    """gaps, the counts, cost and audit of a conversation from its pieces in order."""
    out = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    rest, after = last_vector(), None
    for p in reversed(parts):
        paths: dict[int, Vector] = {}
        for end, q, cost, labels in zip(p["ends"], p["starts"], p["costs"], p["labels"], strict=True):
            paths.setdefault(end, {})[q] = cost, labels
        rest = before_piece(rest, paths)
        if after:
            out["illegal"] += p["last"] + after["first"] not in LEGAL
            out["turns"] -= p["most"] is not None and p["most"] == after["least"]
        after = p
    # Turns are in order: nulls first.
    known = [p for p in parts if p["most"] is not None]
    turns = out.pop("turns")
    gaps = known[-1]["most"] - known[0]["least"] + 1 - turns if known else 0
    cost, audit = rest[START]
    return out | {"gaps": gaps, "cost": cost, "audit": audit}


class _Repaired:
    """The digest of a conversation's repaired rows, fed row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.begun = audit, 0, START, hashlib.sha256(), False

    def _say(self, role: str, text: str, initial: str) -> None:
        self.digest.update(f"{chr(10) * self.begun}{role}:{text}".encode())
        self.begun, self.state = True, GRAMMAR[self.state][initial]

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            initial = next(i for i in NAMES if i in GRAMMAR[self.state])
            self._say(NAMES[initial], "", initial)
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            initial = role[0] if edit == "K" else next(i for i in NAMES if i in GRAMMAR[self.state])
            self._say(role if edit == "K" else NAMES[initial], text, initial)


def repair(conversations: DataFrame, damage: bool = True, piece: int = PIECE) -> DataFrame:
    """A row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. damage: apply `damaged` first."""
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(1).alias("copies"))
    rows = materialise(faulted(damaged(conversations) if damage else plain), "repair-faults")
    cut = materialise(pieces(rows, piece), "repair-pieces")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    # Of a conversation come first its row without a piece, then its pieces, then its rows.
    none: list[Column] = [F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("copies")]
    no_piece = F.lit(None).cast(cut.drop("conv_id").schema.simpleString()).alias("piece")
    at = lambda c: c.cast("long").alias("at")
    stream = every.select("conv_id", F.lit(0).alias("kind"), at(F.lit(0)), no_piece, *none)
    stream = stream.unionByName(cut.select("conv_id", F.lit(1).alias("kind"), at(F.col("nth")), F.struct(*cut.columns[1:]).alias("piece"), *none))
    stream = stream.unionByName(rows.select("conv_id", F.lit(2).alias("kind"), at(F.col("turn")), no_piece, "role", "text", F.col("copies").cast("long").alias("copies")))
    ordered = stream.repartition(n, "conv_id").sortWithinPartitions("conv_id", "kind", F.col("at").asc_nulls_first(), "role", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, fed, begun = None, [], None, False

        def begin() -> tuple[dict, _Repaired]:
            told = summary(parts)
            return told, _Repaired(told["audit"])

        def done() -> dict:
            told, digest = fed or begin()
            digest.inserts()
            return told | {"conv_id": now, "repaired_sha256": digest.digest.hexdigest()}

        for batch in batches:
            out = []
            for conv, kind, piece, role, text, copies in zip(*(batch[c] for c in ("conv_id", "kind", "piece", "role", "text", "copies")), strict=True):
                if kind.as_py() == 0:
                    if begun:
                        out.append(done())
                    now, parts, fed, begun = conv.as_py(), [], None, True
                elif kind.as_py() == 1:
                    parts.append(piece.as_py())
                else:
                    fed = fed or begin()
                    for _ in range(copies.as_py()):
                        fed[1].row(role.as_py(), text.as_py())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_RESULT)
        if begun:
            yield pa.RecordBatch.from_pylist([done()], schema=_RESULT)

    return ordered.mapInArrow(read, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _RESULT))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
