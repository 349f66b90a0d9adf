"""The plan over counts by length is best-fit decreasing, for any corpus, in bounded size."""

import collections

import numpy as np
from pyspark.sql import functions as F

from boundlake.llm import packing

from .common import empty, rows
from .test_tokens_packing import PATH


def placed(rows, counts):
    """(bin, offset, length) of every piece, read off the plan by rank."""
    for length, count in counts.items():
        own = rows[rows[:, 0] == length]
        own = own[np.argsort(own[:, 1])]
        for rank in range(count):
            _, first, to, offset = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
            yield int(to + rank - first), int(offset), length


def test_plan_makes_the_bins_of_a_piece_by_piece_packing():
    rng = np.random.default_rng(11)
    for _ in range(120):
        capacity = int(rng.integers(1, 70))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 250)))
        counts = collections.Counter(lengths.tolist())
        rows, made = packing.plan(counts, capacity)
        assert made == packing.best_fit_decreasing(lengths, capacity)[2]
        bins = collections.defaultdict(list)
        for which, offset, length in placed(rows, counts):
            bins[which].append((offset, length))
        assert set(bins) == set(range(made))
        for inside in bins.values():
            at = 0
            for offset, length in sorted(inside):
                assert offset == at
                at += length
            assert at <= capacity


def test_plan_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(12)
    counts = collections.Counter(np.clip(rng.lognormal(5.5, 1, 50_000).astype(int), 1, 1024).tolist())
    small, _ = packing.plan(counts, 1024)
    large, made = packing.plan({n: c * 1_000_000 for n, c in counts.items()}, 1024)
    assert len(large) < 2 * len(small) < 50_000 and made * 1024 >= sum(n * c for n, c in counts.items()) * 1_000_000


def test_equal_rows_and_null_ids_fill_different_places(spark):
    text = next(r[1] for r in rows() if r[0] == 3)
    same = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    got = packing.pack(same, PATH, 256, 2, with_ids=False, group=20).collect()
    assert len(got) == 500 and all(r.doc_id is None for r in got)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    size = got[0].length
    assert sorted(bins) == list(range(-(-500 // (256 // size))))
    assert all(sorted(x) == [(k * size, size) for k in range(len(x))] for x in bins.values())
    assert packing.pack(empty(spark), PATH, with_ids=False).count() == 0
