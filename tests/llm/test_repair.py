"""Conversation repair against a plain search over single edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from quorant.llm import registry, repair

SF = "/root/testdata/sf0.01"
WHITE = " \t\n\x0b\f\r"


def plain(conv, rows, damage=True):
    """The result for one conversation's rows (turn, role, text), by Dijkstra's search over edits."""
    spaced = lambda v: " " if v is None else str(v)
    left = []
    for turn, role, text in rows:
        role, text = spaced(role), spaced(text)
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        left += [(turn, "user" if kind == 4 else role, text)] * ((kind != 0) + (kind == 3))
    left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in left:
        faults.append("B" if not text.strip(WHITE) else "D" if (role, text) in seen else "T" if text.strip(WHITE)[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [(r[1] or " ")[0] for r in left]
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}  # by the last initial that was said
    names = {"u": "user", "a": "assistant"}
    heap, closed = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, said = heapq.heappop(heap)
        if i == len(left) and last in ("", "a"):
            break
        if (i, last) in closed:
            continue
        closed.add((i, last))
        for to in set(follow[last]) & {"u", "a"}:
            heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*said, names[to] + ":")))
        if i < len(left):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, said))
            if faults[i] not in ("B", "D"):
                more, (_, role, text) = 3 * (faults[i] == "T"), left[i]
                if initials[i] in follow[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, initials[i], (*said, f"{role}:{text}")))
                for to in set(follow[last]) & {"u", "a"}:
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, to, (*said, f"{names[to]}:{text}")))
    turns = {t for t, _, _ in left if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (conv, gaps, faults.count("B"), faults.count("D"), faults.count("T"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def by_conversation(rows):
    out = defaultdict(list)
    for conv, *row in rows:
        out[conv].append(row)
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def same(df, rows, damage=True):
    assert sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr) == sorted((plain(c, rs, damage) for c, rs in by_conversation(rows).items()), key=repr)


def test_every_conversation_of_the_table(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    same(registry.QUERIES["op13_repair"](spark, SF), rows)


@pytest.mark.parametrize(("damage", "piece"), [(True, 2_048), (False, 1), (False, 3)])
def test_random_conversations(spark, damage, piece):
    """Nulls anywhere, repeated rows, turns far apart, odd roles, one long conversation with a third of the rows."""
    at = random.Random(piece)
    rows = []
    for i in range(600):
        conv = 1 if i % 3 == 0 else at.choice([None, *range(2, 90)])
        rows.append((conv, at.choice([None, i, i, at.randrange(12), 2**40]), at.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "usher"]), at.choice(["yes.", "no!", "so it is", "why?  \n", "", None, " \t", "ends. not", f"said {i}."])))
    rows += rows[:9] + [rows[3]] * 5
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, kind string, copies int").repartition(4)
    same(repair.repair(df, damage, piece), rows, damage)


def test_least_labels_over_all_edit_strings():
    """Every string of edits over up to three rows: the cheapest, the least in ASCII among equals."""
    symbols = [("u", 0), ("a", 0), ("s", 0), ("u", repair.TRUNCATED), ("a", repair.DUPLICATE)]
    for n in range(4):
        for rows in itertools.product(symbols, repeat=n):
            found = []
            gaps = ["", "u", "a", "ua", "au"]
            options = [[("D", "")] + ([("K", i)] + [("R", r) for r in "ua"] if f != repair.DUPLICATE else []) for i, f in rows]
            for edits in itertools.product(*options):
                for inserts in itertools.product(gaps, repeat=n + 1) if n < 3 else itertools.product(gaps[:4], gaps[:3], gaps[:3], gaps[:4]):
                    said, audit, cost = inserts[0], "I" * len(inserts[0]), 3 * len(inserts[0])
                    for (label, initial), more, (_, fault) in zip(edits, inserts[1:], rows, strict=True):
                        said, audit = said + initial + more, audit + label + "I" * len(more)
                        cost += repair.COSTS[label] + 3 * (fault == repair.TRUNCATED and label != "D") + 3 * len(more)
                    if re.fullmatch("(s?(ua)+)?", said):
                        found.append((cost, audit))
            assert repair.before_piece(repair.last_vector(), repair.piece_paths(list(rows)))[repair.START] == min(found)


def test_tables_without_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(none).count() == 0
    gone = next(i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = repair.repair(spark.createDataFrame([(gone, 0, "user", "yes.")], none.schema)).collect()
    assert tuple(row[c] for c in COLUMNS) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
