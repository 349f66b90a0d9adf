"""What a fit gathers stays within its bounds, however rows repeat."""

import pickle
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boundlake.llm import langid, quality_pu, textnp
from boundlake.llm.tokens import Encoder

from .common import sentence


def test_equal_rows_count_as_one_language_sample(spark, monkeypatch):
    rows = [(1, sentence(1), "en")] * 3000 + [(i, sentence(i), "en") for i in range(2, 900)] + [(i, f"le chat noir {i} dort ici", "fr") for i in range(900, 940)]
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda langs, buckets, shares: seen.update(langs=langs, buckets=buckets))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    langid.train(df, F.lit(True), per_lang=600)
    assert seen["langs"].count("fr") == 40 and 500 <= seen["langs"].count("en") <= 600
    one = seen["buckets"]
    langid.train(df.repartition(3), F.lit(True), per_lang=600)
    assert len(one) == len(seen["buckets"]) and all(np.array_equal(a, b) for a, b in zip(one, seen["buckets"]))
    langid.train(df.where("doc_id = 1"), F.lit(True), per_lang=600)
    assert seen["langs"] == ["en"]


def test_repeated_ids_count_once_for_quality(spark, monkeypatch):
    docs = [(1, sentence(1))] * 5000 + [(i, sentence(i)) for i in range(2, 400)]
    labels = [(i, 1) for i in range(1, 200)] * 3
    seen = []
    monkeypatch.setattr(quality_pu, "fit", lambda positive, unlabelled: seen.append((positive, unlabelled)))
    quality_pu.train(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True), most=100)
    positive, unlabelled = seen[0]
    assert len(positive) == 100 and len(unlabelled) == 100


def test_limits_of_languages_need_no_python_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i, sentence(i), "en") for i in range(20)] + [(20, "le chat noir dort ici", "fr")], "doc_id long, text string, lang string").cache()
    assert df.count() == 21
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda langs, buckets, shares: seen.update(langs=langs))
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *_: pytest.fail("rows go through Python workers of their own"))
    langid.train(df, F.lit(True))
    assert seen["langs"] == ["en"] * 20 + ["fr"]


def test_workers_get_the_small_table_of_the_languages(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = langid.BUCKETS * len(langid.GRAMS)
    model = langid.Model(["en", "fr"], rng.normal(size=(rows, langid.DIM)).astype(np.float32), rng.normal(size=(langid.DIM, 2)).astype(np.float32), np.zeros(2, np.float32), 1.5, 0.5)
    sent = []
    real = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or real(self, value))
    predict = langid._predictor(spark, model)
    assert len(pickle.dumps(sent[0])) < model.embedding.nbytes / 4
    texts = [sentence(i, 40) for i in range(30)] + ["", "12 34"]
    lang, score, rejected = predict(pa.array(texts))
    for text, name, p, out in zip(texts, lang, score, rejected):
        if not any(map(str.isalpha, text)):
            assert (name, p, out) == ("und", 0.0, True)
            continue
        mean = model.embedding[np.concatenate(langid.gram_buckets(np.frombuffer(text.encode(), np.uint8)))].mean(axis=0, dtype=float)
        logits = mean @ model.weights / 1.5
        wanted = np.exp(logits) / np.exp(logits).sum()
        assert name == model.langs[wanted.argmax()] and abs(p - wanted.max()) < 1e-5 and out == (p < 0.5)


def peak_mb(run) -> float:
    """Most that a call holds beyond what was there."""
    run()  # tables that stay are made
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_wide_temporaries_stay_small(spark):
    texts = pa.array([sentence(i, 600) for i in range(1000)])
    raw, offsets = textnp.utf8(texts)
    assert len(raw) > 3_000_000
    starts, ends, _ = textnp.word_spans(raw, offsets, textnp.NON_SPACE)
    assert peak_mb(lambda: textnp.word_hashes(raw, starts, ends)) < 3 * 8 * len(starts) / 1e6 + 10
    rows = langid.BUCKETS * len(langid.GRAMS)
    model = langid.Model(["en", "fr"], np.ones((rows, langid.DIM), np.float32), np.ones((langid.DIM, 2), np.float32), np.zeros(2, np.float32), 1.0, 0.5)
    predict = langid._predictor(spark, model)
    assert peak_mb(lambda: predict(texts)) < 2 * len(raw) / 1e6 + 12


def test_plain_texts_load_one_tokenizer():
    enc = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    found = enc.ids("The quick brown fox, 123 times.").tolist()
    assert "tokenizer" not in vars(enc)
    assert not any(isinstance(x, dict) and x for x in vars(enc).values())
    assert found == enc.encode_many(["The quick brown fox, 123 times."])[0]
    assert enc.ids("слова").tolist() == enc.encode_many(["слова"])[0]
