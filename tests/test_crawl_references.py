"""Crawls with their counters, and references of formulas as rows."""

import os

from pyspark.sql import functions as F

from boundlake.functions import references
from boundlake.sources import crawl


def test_a_crawl_counts_in_the_pass_that_lists(spark, tmp_path):
    root, outside = tmp_path / "root", tmp_path / "outside"
    for d in (root / "a" / "deep", root / "b", outside):
        d.mkdir(parents=True)
    for p in (root / "top.csv", root / "a" / "x.XLSX", root / "a" / "deep" / "y.xlsb", root / "b" / "z.txt", root / "b" / ".hidden.csv", outside / "o.csv"):
        p.write_text("1")
    os.utime(root / "top.csv", (100, 100))
    (root / "b" / "loop").symlink_to(root)
    (root / "b" / "gone").symlink_to(tmp_path / "nothing")
    (root / "b" / "out").symlink_to(outside)
    (root / "b" / "again").symlink_to(outside)
    found, counters = crawl.crawl(spark, str(root), since=100)
    rows = {(r.status, r.rel, r.reason) for r in found.collect()}
    assert {r for r in rows if r[0] == "file"} in ({("file", p, None) for p in ("a/x.XLSX", "a/deep/y.xlsb", f"b/{via}/o.csv")} for via in ("out", "again"))
    assert {r[1:] for r in rows if r[0] == "error"} - {("b/again", "cycle_skipped"), ("b/out", "cycle_skipped")} == {("b/loop", "cycle_skipped"), ("b/gone", "dangling_symlink")}
    assert counters.get == {"scanned": 5, "skipped": 1, "errors": 3}
    none, counters = crawl.crawl(spark, str(tmp_path / "missing"))
    assert [(r.status, r.reason) for r in none.collect()] == [("error", "opendir_failed")] and counters.get["errors"] == 1


def test_references_by_sql_and_by_lateral_join(spark):
    texts = ["=A1+Sheet2!$B$3", "=SUM(C9:B2,rate)", "=1+", None, "", "plain", "='My Sheet'!A1:B2*A1", '="A1"']
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, formula string")
    want = {
        (0, 0, "cell", None, None, 0, 0, 0, 0, 1), (0, 1, "cell", None, "Sheet2", 2, 1, 2, 1, 1), (1, 0, "range", None, None, 1, 1, 8, 2, 16), (1, 1, "name", "rate", None, None, None, None, None, None),
        (6, 0, "range", None, "My Sheet", 0, 0, 1, 1, 4), (6, 1, "cell", None, None, 0, 0, 0, 0, 1),
    }
    references.register(spark)
    frame.createOrReplaceTempView("formulas")
    by_sql = spark.sql("SELECT k, r.* FROM formulas, LATERAL parse_refs(formula) AS r")
    assert {tuple(r) for r in by_sql.collect() if r.k not in (5,)} == want
    joined = references.with_references(frame, F.col("formula")).drop("formula")
    assert {tuple(r) for r in joined.collect() if r.k not in (5,)} == want
