import collections

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from boundlake.llm import quality_pu, quality_rules

from .common import blank_words, docs, empty, rows

SF = "/root/testdata/sf0.01"


def brute(text):
    words = blank_words(text)
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + d for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if blank_words(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_statistics_equal_a_plain_count(spark):
    more = [(100 + i, t) for i, t in enumerate(["a a a a a", "a b c a b c", "a b c d a b c", "x y z w x y z w x", "#|<>&& $\n\n#|", "a b c x a b c y b c x a"])]
    both = docs(spark, False).select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: tuple(r)[1:6] for r in quality_rules.statistics(both).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    for i, text in [(r[0], r[1]) for r in rows()] + more:
        assert got[i] == brute(text), text


def test_rules_keep_good_documents_and_drop_bad_ones(spark):
    judged = quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).drop("quality").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    count = {(r.quality, r.kept): r["count"] for r in judged.where("not base_failed").groupBy("quality", "kept").count().collect()}
    assert count.get((1, False), 0) <= 0.02 * count[1, True]
    assert count.get((0, True), 0) <= 0.1 * count[0, False]


def test_rules_take_awkward_and_empty_tables(spark):
    found = {r.doc_id: r for r in quality_rules.judge(docs(spark)).collect()}
    assert len(found) == len(rows()) and not found[5].kept and found[5].base_failed
    assert quality_rules.judge(docs(spark)).count() == len(rows()) + 1
    assert quality_rules.judge(empty(spark)).count() == 0


def test_em_recovers_rates():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.8
    rates = [(0.6, 0.004), (0.3, 0.002), (0.5, 0.003)]
    votes = np.column_stack([np.where(rng.random(len(good)) < np.where(good, f, s), 0, 1) for s, f in rates])
    votes[rng.random(votes.shape) < 0.1] = -1
    prior, found = quality_rules.fit(sorted(collections.Counter(map(tuple, votes.tolist())).items()))
    assert abs(prior - 0.8) < 0.06
    assert all(abs(s - t) < 0.12 for (s, _), (t, _) in zip(found, rates))


def test_pu_statistics_survive_awkward_texts():
    x = quality_pu.features(pa.array([r[1] for r in rows()]))
    assert x.shape == (len(rows()), len(quality_pu.NAMES)) and np.isfinite(x).all()
    assert (x[0] == x[1]).all()


def test_pu_held_out_accuracy(spark):
    table = lambda n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    model = quality_pu.train(table("documents"), table("labels"), fold != 1)
    rows_ = quality_pu.score(table("documents"), model).where(fold == 1).join(table("labels"), "doc_id").select("score", "quality").collect()
    right = np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows_])
    assert right > 0.97


def test_pu_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_pu.train(docs(spark), labels, F.lit(True))
    found = quality_pu.score(docs(spark), model).collect()
    assert len(found) == len(rows()) + 1 and all(0 <= r.score <= 1 for r in found)
    assert quality_pu.score(empty(spark), model).count() == 0


def test_pu_learns_planted_classes():
    rng = np.random.default_rng(0)
    good = rng.normal(0.2, 0.05, (15_000, len(quality_pu.NAMES)))
    bad = good[:3000] + np.eye(len(quality_pu.NAMES))[3] * 0.7
    model = quality_pu.fit(good[3000:9000], np.concatenate([good[9000:], bad[:1500]]))
    p = lambda x: quality_pu._sigmoid(quality_pu._logits(quality_pu._binned(x, model.edges), model.weights, model.bias))
    assert (p(bad[1500:]) < 0.5).mean() > 0.9 and (p(good[:3000]) >= 0.5).mean() > 0.9
