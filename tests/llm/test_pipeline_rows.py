"""Stages of the pipeline on awkward rows: dotted and clashing columns, nulls, repeated rows."""

import random
import string

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boundlake.llm import secret_scan

from .common import docs, empty, rows, sentence


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, sentence(4, 4000)[:400]), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs(spark).withColumn("a.b", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_filtering_stages_return_the_columns_they_got(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, table, sf_dir)
        assert out.columns == table.columns, name
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert ids and set(ids) <= {r[0] for r in rows()}
        if name == "near_dedup":
            assert 1 not in ids and 2 not in ids and 0 in ids  # an exact and a near copy of 0
        if name == "decontamination":
            assert 16 not in ids and 0 in ids
        if name == "secret_scans":
            assert len(ids) == len(rows()) + 1
        assert stage(spark, empty(spark), sf_dir).count() == 0, name


def test_secret_recall_outside_the_base_patterns(spark):
    rng = random.Random(3)
    token = lambda: "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(40))
    planted = {i: token() for i in range(200)}
    frame = spark.createDataFrame([(i, f"{sentence(i, 12)} {t} {sentence(i + 1, 12)}") for i, t in planted.items()] + [(1000 + i, sentence(i, 60) + " getUserAccountSettingsController internationalization_of_names") for i in range(200)], "doc_id long, text string")
    model = secret_scan.train(secret_scan.default_samples(spark))
    found = {r.doc_id: (r.text, r.spans) for r in secret_scan.scan(frame, model).collect()}
    caught = sum(any(found[i][0][s.start : s.end] in t or t in found[i][0][s.start : s.end] for s in found[i][1]) for i, t in planted.items())
    assert caught >= 190 and sum(bool(found[1000 + i][1]) for i in range(200)) <= 4
