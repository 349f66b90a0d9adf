import collections
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from boundlake.llm import packing, tokens

from .common import docs, empty, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(spark):
    got = {r.doc_id: r for r in tokens.count_tokens(docs(spark, False), PATH, 100).collect()}
    for i, text, *_ in rows():
        want = len(plain(text))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), want, want > 100)
    assert tokens.count_tokens(empty(spark), PATH).count() == 0
    assert tokens.count_tokens(docs(spark), PATH).count() == len(rows()) + 1


def test_cutting_long_texts_keeps_their_tokens():
    enc = tokens.encoder(PATH)
    for text in ("ab cd  ef\n gh'll 12 " * 300, " " * 900, "x" * 900, "a  b " * 200, "é 漢 😀 " * 150):
        parts = tokens.parts(text, 50)
        assert "".join(parts) == text
        assert [i for p in parts for i in plain(p)] == plain(text)
        assert enc.ids(text).tolist() == plain(text)


def test_other_library_agrees_on_every_character_it_is_used_for():
    enc = tokens.encoder(PATH)
    ranges = [(9, 11), (13, 14), (0x20, 0x7F), (0xA1, 0x250), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0)]
    for a, b in ranges:
        for c in map(chr, range(a, b)):
            text = f"a{c}b 1{c}2 {c} {c}{c} .{c}, x{c}"
            assert not tokens._OTHERS.search(text)
            assert enc.ids(text).tolist() == plain(text), hex(ord(c))


def test_sentencepiece_models_count_whole_texts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs(spark, False), path).collect()}
    assert got == {i: len(model.encode(text or "")) for i, text, *_ in rows()}


def test_packing_round_trip(spark):
    capacity = 64
    found = packing.pack(docs(spark), PATH, capacity, 2).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for i, text, *_ in rows():
        whole = [*plain(text), 2]
        pieces = sorted(by_doc[i], key=lambda r: (r.piece, r.sequence_id))[:: 2 if i == 3 else 1]
        assert [x for r in pieces for x in r.ids] == whole
        assert [r.start for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces])[:-1])
        assert all(r.length == capacity for r in pieces[1:])
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces])[:-1])
        assert sum(r.length for r in pieces) <= capacity
    assert packing.pack(empty(spark), PATH).count() == 0


def test_best_fit_decreasing_equals_a_plain_search():
    rng = np.random.default_rng(1)
    for capacity in (1, 7, 100):
        lengths = rng.integers(1, capacity + 1, 400)
        bins, offsets, made = packing.best_fit_decreasing(lengths, capacity)
        left = []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [x for x in left if x >= lengths[i]]
            if fits:
                left.remove(min(fits))
                left.append(min(fits) - lengths[i])
            else:
                left.append(capacity - lengths[i])
        assert made == len(left)
        total = np.bincount(bins, lengths)
        assert total.max() <= capacity and sorted(capacity - total) == sorted(left)
