r"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

A sequence of tokens is what BPE makes of its text if and only if that holds for
every two neighbours in it, because merges run in one order of priority and the
first one across a boundary would happen in that pair alone as well. So every
prefix of a text has one last token: the one that ends there, matches the text
and is compatible with the last token of the prefix before it.

1. An automaton of all tokens that BPE makes of their own text reports the
   tokens that end at each place.
2. The table stores, place by place, the first of them that is compatible with
   the last token of the place where it begins. Compatibility of two tokens is
   tested by replaying the merges of both side by side, and remembered.
3. Ids are recovered backwards from the end of the table, each token leading to
   the place where it begins.

This takes time in proportion to the text, whatever the length of a word. No
piece of the model holds a character before a space mark, so a text falls into
parts at such places; a part that is not long is encoded once as long as a
bounded memory of parts keeps it. Characters that are no piece become their
bytes. Decoding joins the pieces of the ids and drops the mark that encoding
puts first.

One row for each row of the input: null and empty texts have no ids and the
digest of an empty text, repeated rows each get a row, an empty table gives
none, very long texts are one part after another, and other columns are ignored.
The vocabulary's file is a parameter; each Python worker reads it once.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

MARK = "▁"
#: Parts longer than this are encoded anew each time; so many shorter ones, and so many pairs, are remembered. These bound a worker's memory, not what is encoded.
PART_CHARS, PARTS, PAIRS = 64, 500_000, 400_000
_PART = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_BYTE = re.compile("<0x([0-9A-F]{2})>")


class PrefixTable:
    """The tokens of a model, ready to encode and decode."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" x  y ") != f"{MARK * 2}x{MARK * 2}y{MARK}":
            raise ValueError("only models that leave the text as it is and put a mark first")
        size = model.get_piece_size()
        names, kinds = [model.id_to_piece(i) for i in range(size)], [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.byte_ids = {int(m[1], 16): i for i in range(size) if model.is_byte(i) and (m := _BYTE.fullmatch(names[i]))}
        self.ids = {names[i]: i for i in range(size) if not kinds[i] and not model.is_byte(i)}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.decoded = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else b"" if kinds[i] else names[i].replace(MARK, " ").encode() for i in range(size)]
        if any(c not in self.ids for p in self.ids for c in p) or any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids) or len(self.byte_ids) < 256:
            raise ValueError("only models whose pieces consist of pieces, with a mark at the front alone, and with all bytes")
        self.automaton, self.steps = ahocorasick.Automaton(), {}
        for piece, i in self.ids.items():
            symbols, self.steps[i] = self.merged(piece)
            if symbols == [piece]:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.names = names
        self.pairs: dict[tuple[int, int], bool] = {}
        self.parts: dict[str, tuple[int, str, bytes]] = {}
        self.singles = {p for p in self.ids if len(p) == 1}
        self.unknown = re.compile(f"[^{re.escape(''.join(self.singles))}]")

    def merged(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """`text` by the rule itself: the pair whose union scores most is merged, the leftmost among equals, until none is left. For short texts.

        Also the steps: what each one costs (the negative score) and the first and last symbol before it; the last is endless.
        """
        symbols, steps = list(text), []
        while True:
            found = [(-self.scores[a + b], i) for i, (a, b) in enumerate(pairwise(symbols)) if a + b in self.scores]
            cost, i = min(found, default=(math.inf, 0))
            steps.append((cost, symbols[0], symbols[-1]))
            if not found:
                return symbols, steps
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE makes these two tokens of their joined text: no merge across the boundary comes before the next one on either side."""
        known = self.pairs.get((left, right))
        if known is None:
            a, b, i, j = self.steps[left], self.steps[right], 0, 0
            while known is None:
                (cost_a, _, last), (cost_b, first, _) = a[i], b[j]
                across = -self.scores[last + first] if last + first in self.scores else math.inf
                # Of equal costs the leftmost comes first: the left token's, the one across, the right token's.
                if across < cost_a and across <= cost_b:
                    known = False
                elif cost_a == cost_b == math.inf:
                    known = True
                elif cost_a <= cost_b:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def encode_known(self, text: str) -> list[int]:
        """The ids of a text whose characters are all pieces."""
        last, width, known, compatible = [-1] * (len(text) + 1), [0] * (len(text) + 1), self.pairs.get, self.compatible
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                if length == end:
                    last[end], width[end] = token, length
                elif (left := last[end - length]) >= 0:
                    fits = known((left, token))
                    if compatible(left, token) if fits is None else fits:
                        last[end], width[end] = token, length
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= width[at]
        return ids[::-1]

    def encode_part(self, part: str) -> list[int]:
        if self.singles.issuperset(part):
            return self.encode_known(part)
        ids, at = [], 0
        for m in self.unknown.finditer(part):
            ids += self.encode_known(part[at : m.start()])
            ids += [self.byte_ids[b] for b in m[0].encode()]
            at = m.end()
        return ids + self.encode_known(part[at:])

    def told(self, part: str) -> tuple[int, str, bytes]:
        """Of a part: the number of its ids, the ids as text, and what they decode to."""
        found = self.parts.get(part)
        if found is None:
            ids = self.encode_part(part)
            found = len(ids), ",".join(map(str, ids)), b"".join([self.decoded[i] for i in ids])
            if len(part) <= PART_CHARS:
                if len(self.parts) >= PARTS:
                    self.parts.clear()
                self.parts[part] = found
        return found

    def encode(self, text: str) -> list[int]:
        return [i for part in self.split(text) for i in self.encode_part(part)]

    def split(self, text: str) -> list[str]:
        return _PART.findall(MARK + text.replace(" ", MARK)) if text else []

    def decode(self, ids: list[int]) -> str:
        return _unmarked(b"".join([self.decoded[i] for i in ids]))


def _unmarked(data: bytes) -> str:
    return data.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=1)
def prefix_table(path: str) -> PrefixTable:
    return PrefixTable(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of every row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(path)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = table.encode(text.as_py() or "")
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([ids], pa.list_(pa.int32())), pa.array([table.decode(ids)])], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids array<int>, decoded string")


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the decoded text of every row, without the ids themselves."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(path)
        known, told = table.parts.get, table.told
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [known(p) or told(p) for p in table.split(text.as_py() or "")]
                ids, decoded = ",".join([f[1] for f in found]), _unmarked(b"".join([f[2] for f in found]))
                rows.append((doc, sum(f[0] for f in found), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), DIGESTS, strict=True)], schema=DIGESTS)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
