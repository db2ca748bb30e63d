"""SentencePiece encoding by the prefix table against the library and against plain merging."""

import hashlib
import random
import time

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from quorant.llm import pieces, registry

PATH = public_tokenizers.path("piece_bpe_32k.model")
library = sentencepiece.SentencePieceProcessor(model_file=PATH)
SF = "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want(text):
    ids = library.encode(text or "")
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))


@given(st.lists(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(["▁", " ", " " * 17, "the", "in", "\n", "==", "</s>", "<0x0A>", "é", "\x00", "日本"])), max_size=30).map("".join))
@settings(max_examples=500, deadline=None)
def test_ids_are_the_librarys(text):
    table = pieces.prefix_table(PATH)
    ids = library.encode(text)
    assert table.encode(text) == ids
    assert table.decode(ids) == library.decode(ids)


def test_pairs_are_compatible_if_merging_keeps_them():
    table, at = pieces.prefix_table(PATH), random.Random(3)
    own = [i for p, i in table.ids.items() if table.merged(p)[0] == [p]]
    short = [i for i in own if len(table.names[i]) <= 3]
    for _ in range(20_000):
        a, b = at.choice(short if at.random() < 0.7 else own), at.choice(short if at.random() < 0.7 else own)
        names = [table.names[a], table.names[b]]
        assert table.compatible(a, b) == (table.merged("".join(names))[0] == names)


def test_every_document_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r)[1:] for r in registry.QUERIES["op12_pieces"](spark, SF).collect()}
    assert len(found) == len(docs)
    assert found == {r.doc_id: want(r.text) for r in docs}


def test_nulls_empty_long_and_repeated_texts(spark, monkeypatch):
    said = [None, "", " ", "▁", "x" * 50_000, "ab " * 20_000, " " * 5_000, "日\U0001f600" * 9_000, "a\nb", "a\nb"]
    rows = [(i if i != 1 else None, t, "x", 1) for i, t in enumerate(said)]
    docs = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, n_tokens string, ids int").repartition(3)
    found = sorted(((r.doc_id is None, r.doc_id, *tuple(r)[1:]) for r in pieces.digest_documents(docs, PATH).collect()), key=str)
    assert found == sorted(((d is None, d, *want(t)) for d, t, _, _ in [*rows, rows[-1]]), key=str)
    for r in pieces.encode_documents(docs, PATH).collect():
        text = said[1 if r.doc_id is None else r.doc_id]
        assert r.ids == library.encode(text or "") and r.decoded == library.decode(r.ids)
    assert pieces.digest_documents(docs.limit(0), PATH).count() == 0


def test_memories_are_bounded_and_change_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "PARTS", 50)
    monkeypatch.setattr(pieces, "PAIRS", 20)
    table, at = pieces.PrefixTable(PATH), random.Random(5)
    for _ in range(300):
        text = "".join(at.choice("abcdeinrst  é日") for _ in range(40))
        assert ",".join(table.told(p)[1] for p in table.split(text)) == ",".join(map(str, library.encode(text)))
        assert len(table.parts) <= 50 and len(table.pairs) <= 20


def test_time_of_one_long_part():
    table, at = pieces.prefix_table(PATH), random.Random(7)
    text = "".join(at.choice("abcdefghijklmnopqrstuvwxyz0123=/") for _ in range(400_000))
    began = time.perf_counter()
    ids = table.encode(text)
    assert time.perf_counter() - began < 20
    assert ids == library.encode(text)


def test_a_missing_model_is_an_error(tmp_path):
    with pytest.raises((OSError, RuntimeError)):
        pieces.PrefixTable(str(tmp_path / "none.model"))
