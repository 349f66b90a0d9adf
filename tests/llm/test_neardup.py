import random

import numpy as np
import pyarrow as pa
import pytest

from boundlake.llm import neardup
from boundlake.llm.textnp import utf8

from .common import blank_words, docs, empty, lower, rows


def sets(texts):
    out = {}
    for i, t in texts:
        w = blank_words(lower(t))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(texts):
    s = sets(texts)
    parent = {i: i for i in s}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(s)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s[i]), root(i)) for i in ids}


def compare(spark, texts):
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in neardup.find(frame).collect()}
    want = brute(texts)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_awkward_rows(spark):
    compare(spark, [(r[0], r[1]) for r in rows()])
    assert neardup.find(docs(spark)).count() == len(rows()) + 1
    assert neardup.find(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_planted_groups(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for size, length, edits in ((40, 300, 6), (25, 60, 2), (30, 12, 1), (30, 400, 12), (20, 8, 1)):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(15):  # each like the one before it, the ends unlike each other
        chain = chain[12:] + [rng.choice(vocabulary) for _ in range(12)]
        texts.append(" ".join(chain))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    rng.shuffle(texts)
    compare(spark, list(enumerate(texts)))


def test_short_texts_that_share_no_band_are_linked(spark):
    texts = []
    for i in (12251, 18606, 23456, 33831, 56855, 112740):  # found among 400 000
        words = [f"n{i}x{k}" for k in range(8)]
        texts += [" ".join(words), " ".join(words[:-1])]
    hashes, begin = neardup.shingles(*utf8(pa.array(texts)))
    bands = neardup.densified(neardup.registers(hashes, begin)).reshape(-1, 2, neardup.BANDS, neardup.ROWS)
    assert not (bands[:, 0] == bands[:, 1]).all(axis=2).any()
    compare(spark, list(enumerate(texts)))


def test_similar_small_sets_share_a_subset():
    rng, pool = random.Random(3), np.random.default_rng(3).integers(0, 2**64, 12, dtype=np.uint64)
    small = [np.sort(pool[rng.sample(range(12), rng.randint(0, 9))]) for _ in range(1500)]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in small])])
    keys = [set(x) for x in neardup.subset_keys(np.concatenate(small), begin).to_pylist()]
    assert all(not k for k, x in zip(keys, small) if len(x) > neardup.SMALL)
    seen = set()
    for i, a in enumerate(small):
        for j, b in enumerate(small[:i]):
            both = len(np.intersect1d(a, b, assume_unique=True)) if abs(len(a) - len(b)) < 3 else 0
            if 0 < max(len(a), len(b)) <= 8 and 100 * both >= 75 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                assert keys[i] & keys[j]
                seen.add(tuple(sorted((len(a), len(b)))))
    assert seen == {(3, 4), (4, 5), (5, 6), (6, 7), (6, 8), (7, 7), (7, 8), (8, 8)}


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**64, 6000, dtype=np.uint64)
    for shared in (1000, 3000, 4500):
        a, b = np.unique(pool[: 3000 + shared // 2]), np.unique(pool[3000 - shared // 2 :])
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        found = neardup.densified(np.concatenate([neardup.registers(x, np.array([0, len(x)])) for x in (a, b)]))
        assert abs(neardup.estimate(found[:1], found[1:])[0] - truth) < 0.13


def test_keep_one_leaves_clean_rows_and_all_columns(spark):
    kept = neardup.keep_one(docs(spark, False))
    assert kept.columns == docs(spark).columns
    want = {i for i, (_, c) in brute([(r[0], r[1]) for r in rows()]).items() if i == c}
    assert {r.doc_id for r in kept.collect()} == want
