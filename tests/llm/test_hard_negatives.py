"""Packed products and mined rows against plain arithmetic."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boundlake.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score string, anchor string, v string"


@pytest.mark.parametrize("most,dims", [(130, 64), (3, 5), (0, 4), (2000, 64), (10**7, 16), (2**30, 3)])
def test_packed_products_are_exact(most, dims):
    rng = np.random.default_rng(most + dims)
    a, y = (rng.integers(-most, most + 1, (n, dims)).astype(float) for n in (23, 37))
    want = [[sum(int(p) * int(q) for p, q in zip(r, s)) for s in y] for r in a]
    assert hard_negatives.packed_scores(a, y).tolist() == want
    width, fields = hard_negatives.layout(dims, most, most)
    assert fields >= 2 and (2 * most) ** 2 * dims < 1 << width


def test_scores_beyond_64_bits_are_an_error():
    big = np.full((1, 4), 2.0**40)
    with pytest.raises(OverflowError):
        hard_negatives.packed_scores(big, big)


def plain(rows, every, positives, negatives):
    kept = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        item = ((label + 1) % 10 if i % 7 == 0 else label, [float(np.float32(x)) for x in v])
        kept[i] = min(kept.get(i, item), item)
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in kept.items()}
    out = []
    for a, (label, v) in whole.items():
        if a % every:
            continue
        scores = {i: sum(p * q for p, q in zip(v, w)) for i, (_, w) in whole.items() if i != a}
        best = sorted((-s, i) for i, s in scores.items() if whole[i][0] == label)[:positives]
        for s, p in best:
            fit = sorted((-n, i) for i, n in scores.items() if whole[i][0] != label and 50 * -s <= 100 * n <= 95 * -s)[:negatives]
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(fit, 1)]
    return sorted(out)


def table(dims=6, n=300, seed=3):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() for _ in range(dims)] if rng.random() < 0.6 else [0.5, 0.25, -0.125, 0.5, 0.5, 0.5][:dims], rng.randrange(4)) for i in range(n)]
    rows += [(None, [1.0] * dims, 1), (n, None, 1), (n + 1, [1.0] * dims, None), (n + 2, [1.0, None, 2.0], 1), (n + 3, [float("nan")] * dims, 1), (n + 4, [float("inf"), 1.0], 2)]
    rows += [(n + 50 - n % 50, [], 1), (n + 10, [0.9, 0.8], 1), (n + 11, [0.3] * (dims + 3), 2), (7, [0.1] * dims, 0), rows[9], rows[10], (n + 12, [90.0, -70.0, 3.0], 1), (-50, [0.7] * dims, 3)]
    return [(*r, "x", "x", "x", "x") for r in rows]


@pytest.mark.parametrize("block", [8 << 20, 64])
def test_mined_rows_equal_a_plain_search(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    monkeypatch.setattr(hard_negatives, "STEP", 3)
    rows = table()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["op13_hard_negatives"](spark, str(tmp_path)).collect())
    want = plain(rows, 50, 5, 3)
    assert want and got == want


def test_many_equal_vectors_are_ordered_by_id(spark):
    rows = [(i, [0.5, 0.5], 1, *"xxxx") for i in range(2000)] + [(i, [0.4, 0.4], 2, *"xxxx") for i in range(2000, 4000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = hard_negatives.mine(df, F.col("vec_id") == 50).orderBy("positive_id", "rank").collect()
    assert [(r.positive_id, r.negative_id) for r in got] == [(p, n) for p in range(5) for n in (2000, 2001, 2002)]


def test_empty_tables_and_no_anchors(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []
    some = spark.createDataFrame(table(n=20), SCHEMA)
    assert hard_negatives.mine(some, F.lit(None).cast("boolean")).collect() == []
