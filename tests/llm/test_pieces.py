"""Ids and texts by chunks against the library on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from boundlake.llm import pieces, queries

from .common import docs, empty, rows

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = [" ", "  ", "▁", "\n", "\t", "a", "b", "é", "漢", "😀", "the", "ing", "　", "\xa0", "\0", ".", "1", "Zq", " x", "<s>", "<0x41>"]


def texts(n=3000):
    rng = random.Random(7)
    return ["", " ", "▁", "  ", "x" * 5000, "a " * 900] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def plain(text):
    return MODEL.encode(text or "", add_bos=True, add_eos=True)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_rows_equal_the_library(spark):
    encoded = pieces.encode(docs(spark, False), PATH, begin=True, end=True)
    got = {r.doc_id: r for r in pieces.decode(encoded, PATH).collect()}
    assert len(got) == len(rows())
    for i, text, *_ in rows():
        want = plain(text)
        assert (bytes(got[i].ids), got[i].n_tokens, got[i].decoded) == (packed(want), len(want), MODEL.decode(want))
    assert pieces.decode(pieces.encode(empty(spark), PATH), PATH).count() == 0
    assert pieces.encode(docs(spark), PATH).count() == len(rows()) + 1


@pytest.mark.parametrize("most,kept", [(1 << 19, 64), (50, 64), (1 << 19, 2)])
def test_tables_of_any_size_give_the_same_ids(monkeypatch, most, kept):
    monkeypatch.setattr(pieces, "MOST_CHUNKS", most)
    monkeypatch.setattr(pieces, "KEPT_CHARS", kept)
    p, some = pieces.Pieces(PATH), texts()
    assert p.by_chunk
    got = [x for i in range(0, len(some), 100) for x in p.encode(some[i : i + 100])]
    assert got == [packed(x) for x in MODEL.encode(some)]


def test_each_distinct_chunk_is_segmented_once(monkeypatch):
    p, asked = pieces.Pieces(PATH), []
    model = p.model
    monkeypatch.setattr(p, "model", type("M", (), {"encode": lambda _, x, num_threads: asked.extend(x) or model.encode(x), "unk_id": model.unk_id})())
    for _ in range(3):
        p.encode(["one two one", "two one two  three", "one"])
    assert sorted(asked) == ["one", "two", " three"] or sorted(asked) == [" three", "one", "two"]


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(pieces, "PART_CHARS", 5)
    monkeypatch.setattr(pieces, "PART_TOKENS", 4)
    p = pieces.Pieces(PATH)
    for text in texts(2000):
        ids = MODEL.encode(text)
        assert p.encode_long(text) == packed(ids)
        assert p.decode(packed(ids)) == MODEL.decode(ids)


def test_models_whose_pieces_cross_markers_take_whole_texts():
    p, some = pieces.Pieces(PATH), texts(200)
    p.by_chunk = False
    assert p.encode(some) == [packed(x) for x in MODEL.encode(some)] and not p.table


def test_query(spark, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["op11_sentencepiece"](spark, str(tmp_path)).collect())
    want = [(i, len(plain(t)), hashlib.sha256(packed(plain(t))).hexdigest(), hashlib.sha256(MODEL.decode(plain(t)).encode()).hexdigest()) for i, t, *_ in [*rows(), rows()[3]]]
    assert got == sorted(want)
