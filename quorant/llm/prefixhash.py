"""Document fingerprints from prefix polynomial hashes.

For the code points c of a text, P[i] = sum of (c[j] + 1) * B^j over j < i,
modulo a prime; two primes give 62 bits. P answers the hash of any span,
(P[j] - P[i]) * B^-i, hence whether two spans are equal, and by binary search
the longest common extension of two places.

A fingerprint is the text's length, the hash of the whole text, and the
smallest KEEP distinct values of the mixed hashes of its spans of SPAN code
points (a shorter text is one span). The likeness of two fingerprints is 1 if
length and whole hash agree, else the Dice coefficient of their spans as
estimated from the smallest values.

The query pairs every document with the next one in descending doc_id. Spark
deals the documents into ranges of that order and sorts each; a range is read in
one stream that holds two documents at a time. The first and the last document
of each range are written beside its rows and meet those of the ranges next to
it, so texts are shuffled once, in whatever order they are stored.

Null texts count as empty; an empty text has no spans and is like only empty
texts. A null doc_id comes last. Rows of the same doc_id follow each other by
the XXH64 of their texts, and equal rows by place of storage, so however many
rows share a doc_id, ranges divide them. A table of one row follows itself, an
empty one gives no rows. Texts are hashed whole, however long. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, materialise

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
SPAN = 12
KEEP = 32
#: Most text bytes of a range, on average; there are as many ranges as shuffle partitions at least.
RANGE_BYTES = 256 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)

_powers: list[list[np.ndarray]] = []  # [prime][0: powers, 1: inverse powers]


def _tables(size: int) -> list[list[np.ndarray]]:
    """Powers and inverse powers of the bases, for exponents below `size` at least."""
    if not _powers:
        _powers.extend([np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in PRIMES)
    for prime, base, tables in zip(PRIMES, BASES, _powers, strict=True):
        for k, unit in enumerate((base, pow(base, -1, prime))):
            while len(tables[k]) < size:
                tables[k] = np.concatenate([tables[k], tables[k] * np.uint64(pow(unit, len(tables[k]), prime)) % np.uint64(prime)])
    return _powers


class PrefixHashes:
    """Prefix arrays of a text."""

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        self.size = len(codes)
        self.tables = _tables(self.size + 1)
        self.prefix = []
        for prime, (powers, _) in zip(PRIMES, self.tables, strict=True):
            sums = np.zeros(self.size + 1, np.uint64)
            np.cumsum(codes * powers[: self.size] % np.uint64(prime), out=sums[1:])
            self.prefix.append(sums % np.uint64(prime))

    def span(self, i: int, j: int) -> int:
        """Hash of the span [i, j), the same wherever the span lies."""
        high, low = ((int(p[j]) - int(p[i])) * int(t[1][i]) % prime for prime, p, t in zip(PRIMES, self.prefix, self.tables, strict=True))
        return high << 31 | low

    def common_extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """Length of the longest common prefix of the texts from i on and from j on in `other`."""
        low, high = 0, min(self.size - i, other.size - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                low = mid
            else:
                high = mid - 1
        return low

    def spans(self, length: int) -> np.ndarray:
        """Mixed hashes of all spans of `length`."""
        n = self.size - length + 1
        high, low = ((p[length:] + np.uint64(prime) - p[:n]) % np.uint64(prime) * t[1][:n] % np.uint64(prime) for prime, p, t in zip(PRIMES, self.prefix, self.tables, strict=True))
        return ((high << np.uint64(31) | low) * _MIX) >> np.uint64(32)

    def fingerprint(self) -> tuple[int, int, np.ndarray]:
        if not self.size:
            return 0, 0, np.zeros(0, np.uint64)
        spans = self.spans(min(SPAN, self.size))
        most = KEEP
        while True:  # more than KEEP of the smallest values if some repeat
            least = np.unique(np.partition(spans, most)[:most] if most < len(spans) else spans)
            if len(least) >= KEEP or most >= len(spans):
                return self.size, self.span(0, self.size), least[:KEEP]
            most *= 4


def written(fingerprint: tuple[int, int, np.ndarray]) -> str:
    size, whole, least = fingerprint
    return f"{size:x}-{whole:016x}-{least.astype('>u4').tobytes().hex()}"


def likeness(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    if a[:2] == b[:2]:
        return 1.0
    union = np.union1d(a[2], b[2])[:KEEP]
    both = len(np.intersect1d(np.intersect1d(a[2], b[2], True), union, True))
    return 2 * both / (len(union) + both) if len(union) else 1.0


FOUND = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string())]
    + [("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix", pa.int64())]
)
COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
#: Rows at the ends of a range: its number, whether it is the range's last document, and the document.
ENDS = [("block", pa.int32()), ("last", pa.bool_()), ("text", pa.string())]


class _Document:
    def __init__(self, doc_id: int | None, text: str | None) -> None:
        self.doc_id, self.text = doc_id, text or ""
        self.hashes = PrefixHashes(self.text)
        self.fingerprint = self.hashes.fingerprint()

    def before(self, following: _Document) -> tuple:
        """The row of this document if `following` comes next."""
        half = len(self.text) // 2
        edited = self.text[: len(self.text) - half] + following.text[:half]
        hashes = PrefixHashes(edited)
        new = hashes.fingerprint()
        told = hashlib.sha256(edited.encode()).hexdigest(), written(self.fingerprint), written(new)
        return self.doc_id, len(self.text), *told, likeness(self.fingerprint, new), likeness(self.fingerprint, following.fingerprint), self.hashes.common_extension(0, hashes, 0)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text, dealt into ranges of descending doc_id and sorted within each."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = ids.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    keyed = ids.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("nth"))
    order = [F.desc_nulls_last("doc_id"), F.asc("h"), F.asc("nth")]
    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")


def compare_with_next(docs: DataFrame) -> DataFrame:
    both = pa.schema([*FOUND, *ENDS])
    none, no_ends = (None,) * (len(FOUND) - 1), (None,) * len(ENDS)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waits = TaskContext.get().partitionId(), None
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = _Document(doc_id, text)
                rows.append((*waits.before(now), *no_ends) if waits else (doc_id, *none, block, False, text))
                waits = now
            if rows:
                yield _batch(rows, both)
        if waits:
            yield _batch([(waits.doc_id, *none, block, True, waits.text)], both)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_Document(doc_id, text).before(_Document(None, after)) for doc_id, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield _batch(rows, FOUND)

    ends = ", block int, last boolean, text string"
    found = materialise(in_order(docs).mapInArrow(within, COLUMNS + ends), "fingerprints")
    first = found.filter("NOT last").select(F.col("block").alias("at"), F.col("text").alias("after"))
    # One narrow row for each range, whatever the number of documents.
    blocks = found.filter("NOT last").select("block")
    following = blocks.select(F.col("block").alias("from"), F.coalesce(F.lead("block").over(W.orderBy("block")), F.min("block").over(W.partitionBy(F.lit(0)))).alias("at"))
    met = found.filter("last").join(following, F.col("block") == F.col("from")).join(first, "at").select("doc_id", "text", "after")
    return found.filter("block IS NULL").select(*FOUND.names).unionByName(met.mapInArrow(across, COLUMNS))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir))
