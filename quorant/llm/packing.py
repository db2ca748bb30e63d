"""Best-fit packing by bin completion.

Whether documents fit together depends on their lengths alone, so the plan is
made from the histogram of piece lengths: at most MAX_TOKENS rows on the driver
whatever the size of the corpus. Best-fit decreasing over runs of equal lengths
gives the incumbent. If it is above the lower bound, a branch-and-bound over
bins looks for one bin fewer. It takes the largest remaining length and goes
through the undominated fillings of the rest of its bin, least waste first; sets
of reachable sums lead it to every filling of a given waste and to nothing
else. Each filling is applied as often as the histogram allows, later once, so
that no packing is out of reach, and a branch whose waste exceeds what one bin
fewer can hold is left. Exhausted without a packing, the search proves that
there is none; it stops undecided only after NODES turns back or TRIED tests of
fillings, and the incumbent stands. The plan (runs of equal bins) has a few rows per length; the pieces find
their places in it by their rank among the pieces of their length.

Tokenising keeps a bounded cache of the ids of pieces of text in each worker. A
rank is a row number within (length, bucket) plus the counts of the buckets
before. Every row is dealt to a bucket by the hash of its place in the written
table, and a length has as many buckets as its rows ask for, so neither a length
that a third of all pieces share nor rows that are all alike are a hot key.

Null and empty texts are one piece of the end id. Repeated rows are packed
each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, materialise

MAX_TOKENS = 4096
END_ID = 1
#: Strings whose ids a worker keeps; at more the cache starts anew.
CACHE = 500_000
#: Turns back of the branch-and-bound; then the incumbent stands.
NODES = 2_000
#: Nodes of the branch-and-bound whose options are held in memory.
AWAKE = 4
#: Steps in which one filling is tested against another; undecided, it is kept, which costs time alone.
TESTED = 2_000
#: Fillings found, and tests of one against another, in one search: with very short pieces there are more of them than could be gone through.
TRIED = 1_000_000
#: Pieces that one window group ranks, about.
RANKED = 1_000


#: Texts of these characters alone are split here, as the tokenizer's own pattern does; others go through it string by string.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_WORD_END = "</w>"


@cache
def _tokenizer(path: str):
    """The tokenizer, and of each id whether it ends a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    vocabulary = made.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    for piece, i in vocabulary.items():
        ends[i] = piece.endswith(_WORD_END)
    return made, ends


class _Ids(dict):
    """Strings without white space -> their token ids, as little-endian uint32 bytes."""

    def __init__(self, path: str) -> None:
        self.tokenizer, self.ends = _tokenizer(path)

    def learn(self, words: list[str], pieces: bool) -> None:
        """Takes the words in. pieces: each is one piece of the tokenizer's pattern, so its last id alone ends a word."""
        for i in range(0, len(words), 5_000):
            part = words[i : i + 5_000]
            if pieces:
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
                cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                if len(cuts) == len(part):
                    data = ids.tobytes()
                    self.update(zip(part, [data[a:b] for a, b in zip([0, *cuts], cuts)], strict=True))  # noqa: B905
                    continue
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self[w] = np.array(e.ids, "<u4").tobytes()


_ids: dict[tuple[str, bool], _Ids] = {}


def _encoder(path: str, pieces: bool) -> _Ids:
    if (path, pieces) not in _ids:
        _ids[path, pieces] = _Ids(path)
    return _ids[path, pieces]


def _split(text: str | None) -> tuple[bool, list[str]]:
    """Whether the text is plain, and its pieces, or else its space-separated strings.

    The tokenizer drops white space, and no token and no composed character spans ASCII white space.
    """
    if not text:
        return True, []
    if _PLAIN.fullmatch(text) and "<|" not in text:
        return True, _PIECE.findall(text.lower())
    return False, [w.decode() for w in text.encode().split()]


def encode_texts(texts: list[str | None], path: str) -> Iterator[bytes]:
    """The ids of each text as little-endian uint32 bytes."""
    at = 0
    while at < len(texts):
        size, upto = 0, at
        while upto < len(texts) and (upto == at or size < 1 << 20):
            size, upto = size + len(texts[upto] or ""), upto + 1
        split = [_split(t) for t in texts[at:upto]]
        found: list[list[bytes | None]] = [list(map(_encoder(path, plain).get, ws)) for plain, ws in split]
        for kind in (True, False):
            ids = _encoder(path, kind)
            new = {w for (plain, ws), out in zip(split, found, strict=True) if plain == kind and None in out for w, o in zip(ws, out, strict=True) if o is None}
            if len(ids) + len(new) > CACHE:
                ids.clear()
            ids.learn(list(new), kind)
        for (plain, ws), out in zip(split, found, strict=True):
            if None in out:
                ids = _encoder(path, plain)
                out = [ids[w] if o is None else o for w, o in zip(ws, out, strict=True)]
            yield b"".join(out)
        at = upto


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
LOT = pa.field("lot", pa.int64())


def tokenise(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document, and lot, its place in this table."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1).to_pylist(), tokenizer), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[at : at + 4 * max_tokens]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), lot))
                    lot += 1
            both = pa.schema([*PIECES, LOT])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(both), both, strict=True)], schema=both)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, lot long")


Pattern = tuple[tuple[int, int], ...]  # (length, times) in one bin


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Best-fit decreasing over runs: (bins, pattern)."""
    rooms: list[int] = []
    groups: dict[int, list[list]] = {}
    done: list[tuple[int, Pattern]] = []

    def put(room: int, bins: int, pattern: Pattern) -> None:
        if not room:
            done.append((bins, pattern))
            return
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append([bins, pattern])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                times = capacity // length
                if left >= times:
                    put(capacity - times * length, left // times, ((length, times),))
                if left % times:
                    put(capacity - left % times * length, 1, ((length, left % times),))
                break
            room = rooms[at]
            bins, pattern = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            times = room // length
            full = min(bins, left // times)
            if full:
                put(room - times * length, full, (*pattern, (length, times)))
                left -= full * times
                bins -= full
            if bins and left and left < times:
                put(room - left * length, 1, (*pattern, (length, left)))
                left, bins = 0, bins - 1
            if bins:
                put(room, bins, pattern)
    return done + [(bins, pattern) for gs in groups.values() for bins, pattern in gs]


def _dominates(big: tuple[int, ...], small: tuple[int, ...]) -> bool:
    """Whether the items of `small` are found to fit into bins of the sizes in `big` (Martello and Toth); items of both are set against each other."""
    return _covers(Counter(big), Counter(small))


def _covers(big: dict[int, int], small: dict[int, int]) -> bool:
    """As `_dominates`, of how often each length occurs. Equal items go together: a step puts as many of a run as fit into a bin, and a turn back takes one of them out."""
    runs = sorted(((x, n - big.get(x, 0)) for x, n in small.items() if n > big.get(x, 0)), reverse=True)
    rooms = [(x, n - small.get(x, 0)) for x, n in big.items() if n > small.get(x, 0)]
    if sum(x * n for x, n in rooms) < sum(x * n for x, n in runs) or runs and (not rooms or runs[0][0] > max(rooms)[0]):
        return False
    room = sorted(x for x, n in rooms for _ in range(n))
    steps, i, j, left = TESTED, 0, 0, runs[0][1] if runs else 0
    taken: list[tuple[int, int, int, int]] = []  # run, bin, how many, how many there were
    while i < len(runs):
        length = runs[i][0]
        j = next((k for k in range(j, len(room)) if room[k] >= length), len(room))
        if j < len(room):
            n = min(left, room[j] // length)
        elif taken:
            i, j, n, left = taken.pop()
            length = runs[i][0]
            room[j] += n * length
            n -= 1
        else:
            return False
        steps -= 1
        if steps < 0:
            return False
        if n:
            taken.append((i, j, n, left))
            room[j] -= n * length
            left -= n
        j += 1
        if not left:
            i, j = i + 1, 0
            left = runs[i][1] if i < len(runs) else 0
    return True


def _reached(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """For each k, the sums up to `room` that the first k lengths can make, as the bits of an integer."""
    mask, sums = (1 << room + 1) - 1, 1
    found = [sums]
    for length in lengths:
        left, times = min(counts[length], room // length), 1
        while left:
            times = min(times, left)
            sums |= sums << times * length & mask
            left -= times
            times *= 2
        found.append(sums)
    return found


def _exactly(counts: dict[int, int], lengths: list[int], reached: list[int], size: int, k: int) -> Iterator[Pattern]:
    """Items from the first k lengths of this total size, large ones first."""
    if not size:
        yield ()
    for j in range(min(k, bisect.bisect_right(lengths, size)) - 1, -1, -1):
        length = lengths[j]
        for times in range(min(counts[length], size // length), 0, -1):
            if reached[j] >> size - times * length & 1:
                for rest in _exactly(counts, lengths, reached, size - times * length, j):
                    yield ((length, times), *rest)
        if not reached[j] >> size & 1:
            return


class _Effort:
    """What a search may still spend on finding fillings and setting them against each other."""

    def __init__(self, left: int):
        self.left = left


def _fillings(counts: dict[int, int], lengths: list[int], room: int, most_waste: int, effort: _Effort) -> Iterator[Pattern]:
    """As `fillings`, as lengths and how often they occur; ends where the effort does."""
    usable = lengths[: bisect.bisect_right(lengths, room)]
    reached = _reached(counts, usable, room)
    kept: list[dict[int, int]] = []
    for waste in range(min(most_waste, room) + 1):
        if reached[-1] >> room - waste & 1:
            for pattern in _exactly(counts, usable, reached, room - waste, len(usable)):
                found = dict(pattern)
                more = next((x for x in usable if counts[x] > found.get(x, 0)), waste + 1)
                effort.left -= 1 + len(kept)
                if effort.left < 0:
                    return
                if more > waste and not any(_covers(g, found) for g in kept):
                    kept.append(found)
                    yield pattern


def fillings(counts: dict[int, int], lengths: list[int], room: int, most_waste: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of `room` that leave at most `most_waste`, least waste first; `lengths`: ascending, those in counts."""
    for pattern in _fillings(counts, lengths, room, most_waste, _Effort(1 << 62)):
        yield tuple(x for x, n in pattern for _ in range(n))


def complete_bins(counts: dict[int, int], capacity: int, most_waste: int, nodes: int = NODES, tried: int = TRIED) -> list[tuple[int, Pattern]] | None:
    """Branch-and-bound: bins whose total waste is at most `most_waste`; None if there are none, or none is found within `nodes` turns back and `tried` tests of fillings."""
    left, waste = dict(counts), 0
    lengths, effort = sorted(left), _Effort(tried)
    path: list[tuple[int, Pattern, int]] = []  # times, pattern, waste
    # Options of each node on the way, and how many were taken; only the last AWAKE nodes hold theirs, others find them again.
    stack: list[list] = []

    def take(times: int, pattern: Pattern, sign: int) -> None:
        for x, n in pattern:
            if not left.get(x, 0) and sign > 0:
                bisect.insort(lengths, x)
            left[x] = left.get(x, 0) + sign * times * n
            if not left[x]:
                del lengths[bisect.bisect_left(lengths, x)]

    def branch() -> Iterator[tuple[Pattern, bool]]:
        """Fillings of a bin with the largest length left, first all of them as often as can be, then once."""
        top = lengths[-1]
        now = {x: left[x] - (x == top) for x in lengths}
        own = [x for x in lengths if now[x]]
        seen = []
        for filling in _fillings(now, own, capacity - top, most_waste - waste, effort):
            more = filling[0][1] if filling and filling[0][0] == top else 0
            seen.append(((top, 1 + more), *filling[bool(more) :]))
            yield seen[-1], True
        for pattern in seen:
            if min(left[x] // n for x, n in pattern) > 1:
                yield pattern, False

    if not lengths:
        return []
    stack.append([branch(), 0])
    while stack and nodes and effort.left >= 0:
        nodes -= 1
        node = stack[-1]
        if node[0] is None:
            node[0] = islice(branch(), node[1], None)
        pattern, often = next(node[0], (None, False))
        node[1] += 1
        if pattern is None:
            stack.pop()
            if path:
                times, pattern, lost = path.pop()
                waste -= lost
                take(times, pattern, 1)
            continue
        lost = capacity - sum(x * n for x, n in pattern)
        times = min(left[x] // n for x, n in pattern) if often else 1
        if lost:
            times = min(times, (most_waste - waste) // lost)
        if times < 1:
            continue
        take(times, pattern, -1)
        waste += times * lost
        path.append((times, pattern, times * lost))
        if not lengths:
            return [(t, p) for t, p, _ in path]
        nodes += 1  # only turns back count: a straight dive always ends
        if len(stack) >= AWAKE:
            stack[-AWAKE][0] = None
        stack.append([branch(), 0])
    return None


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The greatest bound of Martello and Toth's second kind: items over capacity - k have bins of their own, those over half have one each, and the others down to k fill what these leave."""
    sizes = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        sizes[length] = n
    number, total = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(sizes * np.arange(capacity + 1))])  # of lengths below k
    half = capacity // 2 + 1
    best = -(-int(total[-1]) // capacity)
    for k in range(capacity // 2 + 1):
        alone, over = int(number[-1] - number[capacity - k + 1]), int(number[capacity - k + 1] - number[half])
        spare = over * capacity - int(total[capacity - k + 1] - total[half])
        best = max(best, alone + over + max(0, -((spare - int(total[half] - total[k])) // capacity)))
    return best


def plan_bins(counts: dict[int, int], capacity: int = MAX_TOKENS) -> list[tuple[int, Pattern]]:
    """Runs of equal bins for the histogram `counts`."""
    full = [(counts[capacity], ((capacity, 1),))] if counts.get(capacity) else []
    counts = {k: v for k, v in counts.items() if v and k < capacity}
    best = best_fit(counts, capacity)
    while (bins := sum(b for b, _ in best)) > lower_bound(counts, capacity):
        total = sum(k * v for k, v in counts.items())
        fewer = complete_bins(counts, capacity, (bins - 1) * capacity - total, NODES, TRIED)
        if fewer is None:
            break
        best = fewer
    return full + best


def _slots(plan: list[tuple[int, Pattern]], capacity: int) -> list[np.ndarray]:
    """Columns key (length * 2**44 + first rank), times in a bin, first bin, offset of the first; by key."""
    rows, used, first = [], dict[int, int](), 0
    for bins, pattern in plan:
        offset = 0
        for length, times in pattern:
            at = used.get(length, 0)
            rows.append(((length << 44) + at, times, first, offset))
            used[length] = at + bins * times
            offset += length * times
        assert offset <= capacity
        first += bins
    rows.sort()
    return [np.array(c, np.int64) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 4


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """`pieces` (as tokenise() makes them, written) with sequence_id and offset."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # max_tokens rows at most
    key, times, first, offset = _slots(plan_bins(histogram, max_tokens), max_tokens)
    # One literal for each length: how many buckets its pieces are dealt to.
    buckets = f"element_at(array({', '.join(str(1 + histogram.get(k, 0) // RANKED) for k in range(1, max_tokens + 1))}), CAST(length AS INT))"
    dealt = pieces.withColumn("bucket", F.expr(f"pmod(xxhash64(lot), {buckets})"))
    own = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "lot")
    sizes = dealt.groupBy("length", "bucket").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn("nth", F.row_number().over(own) - 1).join(sizes.select("length", "bucket", before.alias("before")), ["length", "bucket"]).withColumn("rank", F.col("nth") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 5))
            at = np.searchsorted(key, (length << 44) + rank, "right") - 1
            nth = rank - (key[at] & ((1 << 44) - 1))
            sequence, place = first[at] + nth // times[at], offset[at] + nth % times[at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(place)], names=[*PIECES.names, "sequence_id", "offset"])

    return ranked.select(*PIECES.names, F.col("rank").cast("long")).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(materialise(tokenise(docs, tokenizer, max_tokens), "pieces"), max_tokens)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
