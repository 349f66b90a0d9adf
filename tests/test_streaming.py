"""Chains, folder watch and reactions over several micro-batches, restarts and replays."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from boundlake.operators import structure
from boundlake.sources.tables import Tables, artifacts, content_of, models, registry_tables
from boundlake.streaming import audit, reactions, watch
from boundlake.streaming.state import PROVIDER, keyed

EVENT = "key long, at long, what string"


def arrive(spark, folder, rows, schema=EVENT):
    folder.mkdir(exist_ok=True)
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_chains_go_on_over_batches_restarts_and_a_lost_state(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    batches = [[(1, 5, "a"), (1, 2, "b"), (2, 1, "x"), (None, 1, "nobody")], [(1, 7, None), (3, 1, "y")], [(1, 9, "c"), (1, 9, "c"), (2, 2, "")]]
    source.mkdir()
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(source))
    for i, rows in enumerate(batches[:2]):
        arrive(spark, source, rows)
        if i == 1:
            audit.audit(stream, "key", "at", "what", target, str(tmp_path / "c"))
    arrive(spark, source, batches[2])
    audit.audit(stream, "key", "at", "what", target, str(tmp_path / "c"))
    assert spark.conf.get(PROVIDER, None) != "x"
    got = spark.read.parquet(target)
    want = []
    for key, entries in ((1, ["b", "a", None, "c", "c"]), (2, ["x", ""]), (3, ["y"])):
        last = audit.ZERO
        for i, payload in enumerate(entries):
            now = hashlib.sha256("|".join([str(i), last, *([] if payload is None else [payload])]).encode()).hexdigest()
            want.append((key, i, payload, last, now))
            last = now
    rows = sorted(tuple(r) for r in got.select("key", "seq", "payload", "prev_hash", "entry_hash").collect())
    assert rows == sorted(want, key=lambda r: r[:2])
    assert structure.broken(got, "key").count() == 0

    # A new query without the old checkpoint goes on from the heads that were written.
    later = tmp_path / "later"
    arrive(spark, later, [(1, 10, "d"), (4, 1, "z")])
    more = spark.readStream.schema(EVENT).parquet(str(later))
    audit.audit(more, "key", "at", "what", str(tmp_path / "out2"), str(tmp_path / "c2"), audit.heads(got, "key"))
    both = got.unionByName(spark.read.parquet(str(tmp_path / "out2")))
    assert structure.broken(both, "key").count() == 0
    assert {(r.key, r.seq) for r in audit.heads(both, "key").collect()} == {(1, 5), (2, 1), (3, 0), (4, 0)}


def test_every_change_of_a_folder_is_told_once(spark, tmp_path):
    root, state, out = tmp_path / "root", str(tmp_path / "state"), str(tmp_path / "told")
    (root / "sec").mkdir(parents=True)

    def poll():
        with keyed(spark):
            q = watch.changes(spark, str(root), state, r"\.csv$").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.parquet(out).collect() if os.path.exists(f"{out}/_spark_metadata") else []
        told = {(r.rel, r.change, r.mtime_us, r.sha256, r.previous) for r in rows} - seen
        assert len(rows) == len(seen) + len(told)
        seen.update(told)
        return {(rel, change) for rel, change, *_ in told}

    seen: set = set()
    a, b = root / "sec" / "a.csv", root / "b.csv"
    a.write_text("1")
    b.write_text("2")
    (root / ".hidden.csv").write_text("x")
    (root / "other.txt").write_text("x")
    assert poll() == {("sec/a.csv", "added"), ("b.csv", "added")}
    assert poll() == set()
    a.write_text("9")
    os.utime(a, (1, 1))
    os.utime(b, (2, 2))  # touched only
    assert poll() == {("sec/a.csv", "changed")}
    b.unlink()
    (root / "c.csv").write_text("3")
    assert poll() == {("b.csv", "deleted"), ("c.csv", "added")}
    b.write_text("2")
    a.write_text("1")
    assert poll() == {("b.csv", "added"), ("sec/a.csv", "changed")}
    file_ids = {r.file_id for r in spark.read.parquet(out).where("rel = 'b.csv'").collect()}
    assert file_ids == {"file_" + hashlib.sha256(b"b.csv").hexdigest()[:16]}


def judged(batch):
    x = F.col("value")
    box = F.array(F.struct(F.lit("x").alias("sym"), (x - 1).alias("lo"), (x + 1).alias("hi")))
    return batch.select("subject", F.lit("p").alias("program_hash"), box.alias("box"), (10 - x - 1).alias("ms_lo"), (10 - x + 1).alias("ms_hi"), F.lit(0.0).alias("residual"))


def test_cases_grow_and_a_replayed_batch_adds_nothing(spark, tmp_path):
    source, target, schema = tmp_path / "in", str(tmp_path / "cases"), "subject string, value double"
    for rows in ([("a", 1.0), ("b", 1.0), ("c", 30.0)], [("d", 1.1), ("e", 30.0), ("f", 5.0)], [("g", 1.0)]):
        arrive(spark, source, rows, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    tables = reactions.react(stream, judged, target, str(tmp_path / "c"), delta=0.1)
    assert tables.versions() == [0, 1, 2]
    cases = {r.case_id for r in tables.read("cases").collect()}
    assert len(cases) == 4 and tables.read("results").count() == 7
    near = {(r.subject, round(r.distance, 6)) for r in tables.read("precedents").collect()}
    assert near == {("d", 0.05), ("e", 0.0), ("g", 0.0), ("g", 0.05)}
    assert {(r.subject, r.alert) for r in tables.read("alerts").collect()} == {("c", "criticality_high"), ("e", "criticality_high")}
    # The stream starts over without its checkpoint: every batch number was shown already.
    reactions.react(stream, judged, target, str(tmp_path / "c2"), delta=0.1)
    assert tables.read("results").count() == 7 and {r.case_id for r in tables.read("cases").collect()} == cases


def test_outcomes_are_recorded_once(spark):
    schema = "case_id string, fix_id string, outcome string, verified_cert string"
    first = reactions.outcomes(spark.createDataFrame([("c", "f", "resolved", "h")] * 2, schema), spark.createDataFrame([], f"{schema}, link_id string"))
    again = reactions.outcomes(spark.createDataFrame([("c", "f", "resolved", "h"), ("c", "g", "open", "h")], schema), first)
    assert [r.link_id for r in first.collect()] == ["c__f"] and [r.link_id for r in again.collect()] == ["c__g"]


def test_a_broken_write_shows_nothing(spark, tmp_path):
    tables, good = Tables(spark, str(tmp_path / "t")), spark.range(3)
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).cast("string").alias("x"))
    with pytest.raises(Exception, match="broken"):
        tables.publish(0, {"a": good, "b": bad})
    assert tables.versions() == [] and tables.read("a", schema="id long").count() == 0
    with pytest.raises(LookupError):
        tables.read("a")
    assert tables.publish(0, {"a": good, "b": spark.range(1)}) and tables.publish(1, {"a": good})
    assert not tables.publish(1, {"a": spark.range(100)})
    assert tables.read("a").count() == 6 and tables.read("a", before=1).count() == 3 and tables.read("b").count() == 1


def test_registry_tables_and_artifacts(spark, tmp_path):
    files = spark.createDataFrame([("f1", "s/a.xlsx", "xlsx", "rivet_joint", True), ("f2", "s/t/b.bin", "bin", "unknown_format", True), ("f3", "s/a0.xlsx", "xlsx", "rivet_joint", False)], "id string, rel string, ext string, format_type string, is_head boolean")
    errors = spark.createDataFrame([("s/x", "opendir_failed")], "path string, reason string")
    tables = Tables(spark, str(tmp_path / "t"))
    tables.publish(0, registry_tables(files, errors, "/root"))
    index = tables.read("registry_index").first()
    assert (index.files, index.heads, index.unknown_format, index.folders, index.errors, index.root) == (3, 2, 1, 2, 1, "/root")
    assert [r.rel_path for r in tables.read("unknown_format").collect()] == ["s/t/b.bin"]

    known = spark.createDataFrame([], "id string, name string, version long")
    batch = spark.createDataFrame([("m", bytes(range(256))), ("m", b""), ("n", b"\xff\x00"), ("n", b"\xff\x00")], "name string, content binary")
    made = artifacts(batch, known)
    got = made.withColumn("back", content_of(F.col("data"))).collect()
    assert sorted((r.name, bytes(r.back)) for r in got) == [("m", b""), ("m", bytes(range(256))), ("n", b"\xff\x00")]
    assert all(r.hash == "sha256:" + hashlib.sha256(bytes(r.back)).hexdigest() and r.id == "art_" + r.hash[7:23] and r.size == len(r.back) for r in got)
    assert artifacts(batch, made).count() == 0
    later = artifacts(spark.createDataFrame([("m", b"new")], "name string, content binary"), made).first()
    assert later.version == 3
    texts = spark.createDataFrame([("a1", "{}"), ("a1", "{1}"), ("a1", "{}")], "artifact string, model string")
    first = models(texts, spark.createDataFrame([], "id string, artifact string, version long"))
    assert sorted(r.version for r in first.collect()) == [1, 2] and models(texts, first).count() == 0
