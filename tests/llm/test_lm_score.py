import collections
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boundlake.llm import lm_score
from boundlake.llm.textnp import pack, unpack

from .common import blank_words, docs, empty, lower, rows

END = object()


def test_scores_equal_a_plain_model(spark):
    frame = docs(spark, False)
    got = {r.doc_id: r for r in lm_score.score(frame, F.col("doc_id") % 4 != 1, F.col("doc_id") % 4 == 2, owners=5).collect()}
    texts = {i: [*blank_words(lower(t)), END] for i, t, *_ in rows()}
    uni, pair, main1, main2, apart = (collections.Counter() for _ in range(5))
    for i, w in texts.items():
        if i % 4 != 1:
            before = [END, *w[:-1]]
            uni.update(w)
            pair.update(zip(before, w))
            if i % 4 == 2:
                apart.update(zip(before, w))
            else:
                main1.update(w)
                main2.update(zip(before, w))
    total, vocabulary = sum(uni.values()), len(uni)
    cells = collections.Counter()
    for (a, b), n in apart.items():
        scale = lambda x: round(8 * math.log2(x)) if x > 0 else lm_score.ZERO
        bucket = int(math.log2(main1[a])) + 1 if main1[a] else 0
        cells[bucket, scale(main2[a, b] / max(main1[a], 1)), scale(main1[b])] += n
    weights = lm_score.learn([(*k, n) for k, n in cells.items()], sum(main1.values()), vocabulary)
    for i, w in texts.items():
        base = sum(math.log10((uni[x] + 1) / (total + vocabulary + 1)) for x in w)
        full = 0.0
        for a, b in zip([END, *w[:-1]], w):
            l2, l1, l0 = weights[int(math.log2(uni[a])) + 1 if uni[a] else 0]
            full += math.log10(l2 * pair[a, b] / max(uni[a], 1) + l1 * uni[b] / total + l0 / (vocabulary + 1))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 4 == 1, len(w), sum(uni[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(full, rel=1e-9)


def test_awkward_tables(spark):
    assert lm_score.score(empty(spark), F.lit(True), F.lit(False)).count() == 0
    assert lm_score.score(docs(spark), F.lit(True), F.col("doc_id") % 3 == 0).count() == len(rows()) + 1
    untrained = lm_score.score(docs(spark), F.lit(False), F.lit(False)).collect()
    assert all(np.isfinite(r.score) and r.n_known == 0 and r.train_tokens == 0 for r in untrained)


def test_model_beats_the_base_on_unseen_texts(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    r = lm_score.score(frame, fold != 2, fold == 5).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > 0.95 * r.b


def test_weights_are_distributions():
    weights = lm_score.learn([(3, -8, 40, 10), (3, lm_score.ZERO, 40, 5), (0, lm_score.ZERO, lm_score.ZERO, 2)], 1000, 100)
    assert len(weights) == 64 and all(abs(sum(w) - 1) < 1e-9 and w[2] > 0 for w in weights.values())


@pytest.mark.parametrize("main, apart", [(5, 7), (3 << 30, 0), ((1 << 31) - 1, (1 << 31) - 1), (1 << 40, 3), (0, 1 << 33)])
def test_totals_past_32_bits(main, apart):
    words, ids, counts = lm_score.tokens(pa.array(["a b a", ""]))
    end = int(np.searchsorted(words, lm_score.END))
    pairs = len(set(zip(lm_score.contexts(ids, end).tolist(), ids.tolist())))
    role = np.array([lm_score.APART, lm_score.SCORED], np.uint8)
    own = pack(counts.astype(np.int64), role, np.diff(words >> np.uint64(lm_score.WORD_SHIFT), prepend=np.uint64(0)), ids.astype(np.int64), np.array([end]))
    answers = [pack(np.full(n, main), np.full(n, apart)) for n in (len(words), pairs)]
    pdf = pd.DataFrame({"block": 0, "kind": [2, 0, 1], "owner": 0, "payload": [own, *answers], "fresh": 0, "ids": [[1, 2], None, None]})
    found = lm_score._merged(pdf)
    _, _, _, uni, pair, _ = unpack(found["payload"][0])
    assert len(uni) == len(words) and len(pair) == len(ids)
    assert set(uni.tolist()) == set(pair.tolist()) == {main + apart}
    assert {c[0] for c in found["cells"][0]} == {int(lm_score.bucket(np.array([main]))[0])}


def test_packing_is_lossless():
    arrays = [np.array([], np.int64), np.array([1, 70000, 3], np.int64), np.array([2**63, 5], np.uint64), np.arange(300, dtype=np.uint8)]
    assert all((a == b).all() for a, b in zip(arrays, unpack(pack(*arrays))))
