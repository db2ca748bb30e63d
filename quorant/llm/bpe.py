"""BPE encoding and decoding through a distinct-word table.

A word is white space and what follows it up to the next white space: no token
of the byte-level vocabulary spans the place between a visible character and
white space, so a text's ids are its words' ids in turn (special tokens hold no
white space and are found inside a word).

1. Split: documents are read in blocks of bounded size. A block keeps each of
   its distinct words once; its documents become positions in that list.
2. Distinct-word table: the blocks' word lists are dealt to buckets by hash and
   read there one after the other. A word that its bucket has not seen gets the
   next number, is encoded and becomes a row (bucket, number, word, ids); a list
   becomes its words' numbers. A worker holds the distinct words of one bucket
   and one list, whatever the number of blocks.
3. Decoding: the table's ids join the table of the vocabulary's pieces, and a
   word's pieces are put together in order of place.
4. Join by position: numbers give each block its words' ids and decoded bytes,
   and a block's positions give each document's.

A list of words, numbers or ids travels as one compressed value per (block,
bucket), not as a row for each word, which keeps what is written and shuffled
below the disk budget. A frequent word occurs once per block at most, so no
bucket is hot. Null and empty texts have no ids. Repeated rows each get a row,
and so do rows without a doc_id. Empty tables give no rows. Other columns are
ignored.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shared_path

#: Characters of text in a block.
BLOCK_CHARS = 16 << 20
#: Bytes of input for each bucket of words at most, so that what a bucket holds does not grow with the corpus.
BUCKET_BYTES = 6 << 20
#: Files that Spark lets a table be dealt to.
MOST_TASKS = 25_000
#: Unicode White_Space.
_WHITE = r"\t-\r \x85\xa0  -     　"
WORD = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")

def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def _give_back() -> None:
    """Free memory goes back to the system: else every worker that waits for its next task keeps the most it ever held."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def pieces(path: str) -> list[bytes]:
    """The bytes of every id, by the byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for the code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    vocabulary = _tokenizer(path).get_vocab(with_added_tokens=True)
    found = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        found[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    return found


def _packed(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed; the high planes are nearly constant."""
    import zstandard

    planes = values.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=9).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_words(words: list[bytes]) -> bytes:
    import zstandard

    sizes = _packed(np.array([len(w) for w in words], np.uint32))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(level=9).compress(b"".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    import zstandard

    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(_unpacked(data[4 : 4 + n])).tolist()
    text = zstandard.ZstdDecompressor().decompress(data[4 + n :])
    return [text[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


def _ranks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in order of rank, and the rank of each word."""
    order = np.argsort(-counts.astype(np.int64), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return order, rank


class _Places(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


BLOCKS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("counts", pa.binary()), ("data", pa.binary())])


def split_blocks(docs: DataFrame, buckets: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """For each block a row (doc_ids, sizes, counts, data) without a bucket, and a row (bucket, data) for each of its word lists.

    counts run through a block's lists in order of bucket; data of the block are its documents' positions, `sizes` of them
    each. A position is the word's rank by count, so frequent words have small numbers, which compress well.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, ids, rows, size = _Places(), [], [], 0
        partition, nth = TaskContext.get().partitionId(), 0

        def flush() -> pa.RecordBatch:
            words = list(places)
            places.clear()
            for i, word in enumerate(words):  # in place, so that few words are held twice
                words[i] = word.encode()
            of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            by_word = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
            order = by_word[np.argsort(of[by_word], kind="stable")]
            moved = np.empty(len(words), np.uint32)
            moved[order] = np.arange(len(words), dtype=np.uint32)
            at = moved[np.concatenate(rows)]
            counts = np.bincount(at, minlength=len(words))
            # A block's name is its partition and its place there: no two blocks share it, and a repeated task gives the same rows.
            block = partition << 32 | nth
            ends = np.searchsorted(of[order], np.arange(buckets + 1)).tolist()
            lists = [(b, _pack_words([words[i] for i in order[lo:hi].tolist()])) for b, (lo, hi) in enumerate(pairwise(ends)) if lo < hi]
            data = _packed(_ranks(counts)[1].astype("<u4")[at])
            row = {"block": block, "doc_ids": ids, "sizes": _packed(np.array([len(r) for r in rows])), "counts": _packed(counts), "data": data}
            return pa.RecordBatch.from_pylist([row, *({"block": block, "bucket": b, "data": d} for b, d in lists)], schema=BLOCKS)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if rows and size + len(text) > block_chars:
                    yield flush()
                    places, ids, rows, size, nth = _Places(), [], [], 0, nth + 1
                ids.append(doc)
                rows.append(np.fromiter(map(places.__getitem__, WORD.findall(text)), np.uint32))
                size += len(text)
        if rows:
            yield flush()
        rows.clear()
        _give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(split, "block long, bucket int, doc_ids array<long>, sizes binary, counts binary, data binary")


WORD_TABLE = pa.schema([("bucket", pa.int32()), ("number", pa.int32()), ("word", pa.string()), ("ids", pa.list_(pa.int32())), ("block", pa.int64()), ("numbers", pa.binary())])
TABLE = "bucket int, number int, word string, ids array<int>, block long, numbers binary"


def number_words(lists: DataFrame, path: str) -> DataFrame:
    """From the word lists (block, bucket, data): a row (bucket, number, word, ids) for each distinct word, and a row (bucket, block, numbers) for each list."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, current, tokenizer = _Places(), None, None
        for batch in batches:
            for block, bucket, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != current:
                    places, current = _Places(), bucket
                known = len(places)
                words = _unpack_words(data)
                numbers = np.fromiter(map(places.__getitem__, words), np.uint32, len(words))
                new = [words[i].decode() for i in np.flatnonzero(numbers >= known).tolist()]
                tokenizer = tokenizer or _tokenizer(path)
                for i in range(0, len(new), 20_000):
                    part = new[i : i + 20_000]
                    ids = [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                    n = len(part)
                    columns = [np.full(n, bucket, np.int32), np.arange(known + i, known + i + n, dtype=np.int32), part, ids, [None] * n, [None] * n]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, WORD_TABLE, strict=True)], schema=WORD_TABLE)
                yield pa.RecordBatch.from_pylist([{"bucket": bucket, "block": block, "numbers": _packed(numbers)}], schema=WORD_TABLE)
        del places, tokenizer
        _give_back()

    return lists.select("block", "bucket", "data").mapInArrow(number, TABLE)


def with_pieces(words: DataFrame, pieces_table: DataFrame) -> DataFrame:
    """(word_bucket, number, ids, decoded) of the distinct words (bucket, number, ids), through a join of each id to its piece (id, piece)."""
    # As many pieces as the vocabulary has, whatever the corpus.
    placed = words.select(F.col("bucket").alias("word_bucket"), "number", F.posexplode("ids").alias("at", "id")).join(F.broadcast(pieces_table), "id")
    spelled = placed.groupBy("word_bucket", "number").agg(F.sort_array(F.collect_list(F.struct("at", "id", F.hex("piece").alias("piece")))).alias("ps"))
    return spelled.select("word_bucket", "number", F.col("ps.id").alias("ids"), F.unhex(F.array_join("ps.piece", "")).alias("decoded"))


def _pack_all(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unpack_all(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        yield data[at + 4 : at + 4 + n]
        at += 4 + n


def spell_lists(lists: DataFrame, words: DataFrame) -> DataFrame:
    """(block, bucket, data): the counts of ids, the ids and the decoded bytes of the words of each list (bucket, block, numbers)."""

    def spell(held: pa.Table, table: pa.Table) -> pa.Table:
        numbers = table["number"].to_numpy()
        order = np.argsort(numbers)
        assert (numbers[order] == np.arange(len(order))).all()  # every word has its row
        ids = table["ids"].take(pa.array(order)).combine_chunks()
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        decoded = table["decoded"].take(pa.array(order)).to_pylist()
        out = []
        for data in held["numbers"].to_pylist():
            own = _unpacked(data).astype(np.int64)
            sizes = ends[own + 1] - ends[own]
            at = np.repeat(ends[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            out.append(_pack_all(_packed(sizes), _packed(flat[at]), _pack_words([decoded[i] for i in own.tolist()])))
        del decoded, ids, flat
        _give_back()
        return pa.table([held["block"], held["bucket"], pa.array(out, pa.binary())], names=["block", "bucket", "data"])

    return lists.groupBy("bucket").cogroup(words.groupBy("word_bucket")).applyInArrow(spell, "block long, bucket int, data binary")


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def join_back(placed: DataFrame, spelled: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text of each document."""

    def join(rows: pa.Table, lists: pa.Table) -> pa.Table:
        block, *others = rows.to_pylist()
        assert not others
        order = _ranks(_unpacked(block["counts"]))[0]
        parts = [tuple(_unpack_all(data)) for data in lists.sort_by("bucket")["data"].to_pylist()]
        del lists
        places, upto = _unpacked(block["data"]), np.cumsum(_unpacked(block["sizes"])).tolist()
        spans = list(pairwise([0, *upto]))
        # The texts first, then the ids: a block's words are held as bytes or as numbers, not as both.
        spelled = [w for _, _, words in parts for w in _unpack_words(words)]
        texts = [hashlib.sha256(b"".join([spelled[i] for i in order[places[a:b]].tolist()]).decode("utf-8", "replace").encode()).hexdigest() for a, b in spans]
        del spelled
        numbers, counts = [], [np.zeros(0, np.uint32)]
        for sizes, ids, _ in parts:
            counts.append(_unpacked(sizes))
            ends, ids = np.cumsum(counts[-1]).tolist(), _unpacked(ids).tolist()
            numbers += [",".join(map(str, ids[a:b])) for a, b in pairwise([0, *ends])]
        count, out = np.concatenate(counts), []
        for doc, text, (a, b) in zip(block["doc_ids"], texts, spans, strict=True):
            at = order[places[a:b]]
            told = ",".join([numbers[i] for i in at.tolist()])
            out.append((doc, int(count[at].sum(dtype=np.int64)), hashlib.sha256(told.encode()).hexdigest(), text))
        del numbers
        _give_back()
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), DOCUMENTS, strict=True)], schema=DOCUMENTS)

    spelled = spelled.withColumnRenamed("block", "of_block")
    return placed.groupBy("block").cogroup(spelled.groupBy("of_block")).applyInArrow(join, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _bucketed(df: DataFrame, by: str, parts: int, name: str, codec: str) -> DataFrame:
    """`df` written to the shared folder in buckets of `by`, so that what meets by it is not shuffled again."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, by).options(path=shared_path(spark, name), compression=codec).saveAsTable(table)
    found = spark.table(table)
    found.schema  # noqa: B018  (analysed while the name is there)
    spark.sql(f"DROP TABLE {table}")  # the name alone: the files stay in the shared folder
    return found


def encode_documents(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The size that Spark plans with: of files their bytes; over a petabyte where it knows none.
    size = int(str(docs.select("text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(parts, min(-(-size // (2 * BUCKET_BYTES)), MOST_TASKS)) if size < 1 << 50 else parts
    # More buckets than tasks that run at once, so that few blocks share one; a block is written to one file all the same.
    blocks = _bucketed(split_blocks(docs, 2 * tasks, block_chars), "block", 4 * tasks, "word_blocks", "none")
    lists = blocks.filter("bucket IS NOT NULL").select("block", "bucket", "data").repartition(tasks, "bucket").sortWithinPartitions("bucket", "block")
    table = _bucketed(number_words(lists, path), "bucket", tasks, "word_table", "zstd")
    pieces_table = spark.createDataFrame(list(enumerate(map(bytearray, pieces(path)))), "id int, piece binary")
    words = with_pieces(table.filter("block IS NULL").select("bucket", "number", "ids"), pieces_table)
    spelled = spell_lists(table.filter("block IS NOT NULL").select("bucket", "block", "numbers"), words)
    return join_back(blocks.filter("bucket IS NULL").drop("bucket"), spelled)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
