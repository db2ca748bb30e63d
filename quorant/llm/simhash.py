r"""SimHash near-duplicates with anchor points from a covering code.

Two fingerprints link if they differ in at most 2 of 64 bits. The anchors are
the words of a direct sum of perfect codes: two binary Golay codes [23, 12] over
the low 46 bits and, if there are more than ANCHORED distinct fingerprints, a
Hamming code [15, 11] over the next 15, so that the anchors grow with the
fingerprints. Every word has exactly one anchor with at most the code's radius
of errors in each part (covering radius 3 + 3 + 1), its home. If two
fingerprints differ in t bits, the home of one lies within radius + a, + b, + c
errors of the parts of the other, a + b + c <= t. So each distinct fingerprint
goes to its home and, as a replica, to every anchor within the covering radius
plus the threshold (61 of 2^24 on average with two codes); homes and replicas
meet per anchor in one equi-join that compares all 64 bits. No link is lost and
none is found twice.

Joins are sort-merge joins, which Spark splits where a key is hot, whatever the
sizes: nothing is broadcast. Copies share a fingerprint and are one row before any of this. Links between
distinct fingerprints are bounded (at most 2080 each) and go to connected
components. Nulls and empty texts have fingerprint 0. Repeated rows get a row
each; a null doc_id is never the least of a component. `keep_first` keeps the
first row of each component by doc_id (nulls last), then the text's digest, then
the other columns, so rows that share a doc_id, or have none, are compared like
all others. An empty table gives no rows. A fingerprint is of the whole text,
however long. Other columns are ignored by `near_duplicates` and kept by
`keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise
from .components import connected_components

THRESHOLD = 2
SEED = 42
WORDS = 3
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Perfect codes over consecutive bits from the low end: generator polynomial (bit i: coefficient of x^i), length, check bits, radius.
CODES = ((0b110001110101, 23, 11, 3), (0b110001110101, 23, 11, 3), (0b10011, 15, 4, 1))
#: Distinct fingerprints for which the first two codes have anchors enough.
ANCHORED = 1 << 26


def fingerprint(text: str | None, shingle: int = WORDS) -> int:
    """64 bits by majority over the hashes of the shingles of `shingle` words, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    hashes = [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :])]  # noqa: B905
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame, *others: Column, shingle: int = WORDS) -> DataFrame:
    """doc_id, fp, the fingerprint as a signed long, and the string columns `others`."""
    names = docs.select(*others).columns

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *batch.columns[2:]], names=["doc_id", "fp", *names])

    return docs.select(F.col("doc_id").cast("long"), "text", *others).mapInArrow(compute, ", ".join(["doc_id long, fp long", *(f"{n} string" for n in names)]))


def _remainder(word: int, code: tuple[int, int, int, int]) -> int:
    generator, length, check, _ = code
    for i in range(length - 1, check - 1, -1):
        if word >> i & 1:
            word ^= generator << (i - check)
    return word


@cache
def _code(code: tuple[int, int, int, int], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes by byte [3, 256]; errors in order of syndrome, then weight; where a syndrome's begin; how many have weight radius + k at most [k, syndrome]."""
    _, length, check, radius = code
    bits = [_remainder(1 << i, code) for i in range(length)]
    by_byte = np.zeros((3, 256), np.int64)
    for byte in range(3):
        for value in range(256):
            for i in range(8):
                if value >> i & 1 and 8 * byte + i < length:
                    by_byte[byte, value] ^= bits[8 * byte + i]
    rows = []
    for weight in range(radius + threshold + 1):
        for at in combinations(range(length), weight):
            syndrome = 0
            for i in at:
                syndrome ^= bits[i]
            rows.append((syndrome, weight, sum(1 << i for i in at)))
    table = np.array(sorted(rows), np.int64)
    begin = np.searchsorted(table[:, 0], np.arange(1 << check))
    upto = np.array([np.bincount(table[table[:, 1] <= radius + k, 0], minlength=1 << check) for k in range(threshold + 1)])
    assert (upto[0] == 1).all()  # the code is perfect
    return by_byte, table, begin, upto


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each of sum(counts) items and its place among its row's."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def anchors(fps: np.ndarray, threshold: int, codes: tuple = CODES[:2]) -> tuple[np.ndarray, np.ndarray]:
    """(row of fps, anchor) for every anchor within the covering radius plus `threshold`; 0: the homes alone."""
    words = fps.view(np.uint64)
    row, spare, anchor, at = np.arange(len(fps)), np.full(len(fps), threshold), np.zeros(len(fps), np.int64), 0
    for code in codes:
        _, length, _, radius = code
        by_byte, table, begin, upto = _code(code, threshold)
        part = (words >> np.uint64(at) & np.uint64((1 << length) - 1)).astype(np.int64)
        syndrome = by_byte[0, part & 255] ^ by_byte[1, part >> 8 & 255] ^ by_byte[2, part >> 16]
        of, nth = _expand(upto[spare, syndrome[row]])
        error = table[begin[syndrome[row[of]]] + nth]
        row, spare = row[of], spare[of] - np.maximum(error[:, 1] - radius, 0)
        anchor = anchor[of] | (part[row] ^ error[:, 2]) << at
        at += length
    return row, anchor


def _at_anchors(fps: DataFrame, threshold: int, codes: tuple) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                fp = batch.column(0).to_numpy(zero_copy_only=False)[i : i + 4096]
                of, anchor = anchors(fp, threshold, codes)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[of])], names=["anchor", "fp"])

    return fps.mapInArrow(spread, "anchor long, fp long")


def links(fps: DataFrame, threshold: int = THRESHOLD, codes: tuple = CODES[:2]) -> DataFrame:
    """Pairs (u, v) of the distinct fingerprints `fps` within the threshold, each pair once."""
    home, near = _at_anchors(fps, 0, codes).alias("h"), _at_anchors(fps, threshold, codes).alias("r")
    met = home.hint("merge").join(near, F.expr(f"h.anchor = r.anchor AND h.fp < r.fp AND bit_count(h.fp ^ r.fp) <= {threshold}"))
    return met.select(F.col("h.fp").alias("u"), F.col("r.fp").alias("v"))


def components(found: DataFrame, rank: str | Column, threshold: int = THRESHOLD) -> DataFrame:
    """fp and component_id, the least `rank` of the rows of `found` in its component, of each distinct fp."""
    classes = materialise(found.groupBy("fp").agg(F.min(rank).alias("least")), "classes")
    codes = CODES if classes.count() > ANCHORED else CODES[:2]
    parts = connected_components(links(classes.select("fp"), threshold, codes))
    # Written before they are joined, so that Spark splits a component that many fingerprints share.
    linked = materialise(classes.join(parts.hint("merge"), F.col("fp") == F.col("node")).select("fp", "least", "component"), "linked")
    lowest = materialise(linked.groupBy("component").agg(F.min("least").alias("lowest")), "lowest")
    of_linked = linked.join(lowest.hint("merge"), "component").select(F.col("fp").alias("linked_fp"), "lowest")
    return classes.join(of_linked.hint("merge"), F.col("fp") == F.col("linked_fp"), "left").select("fp", F.coalesce("lowest", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = WORDS) -> DataFrame:
    """doc_id, fp, component_id of each document."""
    found = materialise(fingerprints(docs, shingle=shingle), "fingerprints")
    # Written, so that both sides of the last join come straight from an exchange: then Spark splits the fingerprint of a large group of copies.
    named = materialise(components(found, "doc_id", threshold), "components")
    return found.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = WORDS) -> DataFrame:
    """The first row of each group of near-duplicates, by doc_id (nulls last), digest of the text and the other columns."""
    # Rows of the same doc_id and text share a key; there is no doc_id in the key of a row without one.
    key = F.concat_ws(":", F.col("doc_id").cast("long"), F.sha2(F.coalesce("text", F.lit("")), 256))
    found = materialise(fingerprints(docs, key.alias("key"), shingle=shingle), "fingerprints")
    rank = F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "key")
    kept = components(found, rank, threshold).select("component_id.key").distinct()
    others = F.to_json(F.struct(*[f"`{c}`" for c in docs.columns if c != "text"]))
    packed = docs.select(key.alias("key"), F.struct("*").alias("doc"), F.struct(F.isnull("text").alias("null_text"), others.alias("others")).alias("order"))
    # One row of each key before the join: copies meet map-side.
    return packed.groupBy("key").agg(F.min_by("doc", "order").alias("doc")).join(kept.hint("merge"), "key", "left_semi").select("doc.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
