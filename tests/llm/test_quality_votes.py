"""op6: rules are weighed by what the others say of them, and verdicts follow the posterior."""

import collections

import numpy as np

from boundlake.llm import quality_rules

from .common import docs

SF = "/root/testdata/sf0.01"


def counted(votes):
    return sorted(collections.Counter(map(tuple, votes.tolist())).items())


def test_a_noisy_rule_is_outvoted():
    rng = np.random.default_rng(5)
    good = rng.random(30_000) < 0.85
    rates = [(0.7, 0.01), (0.6, 0.01), (0.65, 0.02), (0.5, 0.25)]  # the last calls a quarter of good documents bad
    votes = np.column_stack([np.where(rng.random(len(good)) < np.where(good, f, s), 0, 1) for s, f in rates])
    prior, found = quality_rules.fit(counted(votes))
    assert abs(prior - 0.85) < 0.05 and abs(found[3][1] - 0.25) < 0.05
    assert quality_rules.posterior((1, 1, 1, 0), prior, found) > 0.9  # its bad vote alone does not drop
    assert quality_rules.posterior((0, 0, 1, 1), prior, found) < 0.5  # two sound ones do, against its good vote
    verdict = np.array([quality_rules.posterior(tuple(v), prior, found) >= 0.5 for v in votes.tolist()])
    assert (verdict == good).mean() > 0.95 > (votes == 1).all(axis=1).mean() + 0.2


def test_start_is_no_bound():
    rng = np.random.default_rng(6)
    good = rng.random(20_000) < 0.7
    votes = np.column_stack([np.where(rng.random(len(good)) < np.where(good, 0.15, 0.9), 0, 1) for _ in range(4)])
    prior, found = quality_rules.fit(counted(votes))
    assert all(f > 2 * quality_rules.START[1] and s > 2 * quality_rules.START[0] for s, f in found)


def test_verdicts_are_those_of_the_posterior(spark):
    for frame in (spark.read.parquet(f"{SF}/documents.parquet"), docs(spark)):
        judged = quality_rules.judge(frame).collect()
        names = list(quality_rules.votes())
        pattern = lambda r: tuple(r[f"vote_{k}"] for k in names)
        prior, rates = quality_rules.fit(sorted(collections.Counter(map(pattern, judged)).items()))
        for r in judged:
            p = quality_rules.posterior(pattern(r), prior, rates)
            assert abs(r.quality - p) < 1e-9 and r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_not_the_all_must_pass_filter(spark):
    judged = quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).where("not base_failed").collect()
    bad = [(sum(value == 0 for name, value in r.asDict().items() if name.startswith("vote_")), r.kept) for r in judged]
    assert sum(n > 0 and kept for n, kept in bad) >= 10
