import io
import zipfile

from pyspark.sql import functions as F

from boundlake.functions import program as pg
from boundlake.operators import workbooks as w
from boundlake.plans import books
from boundlake.ship import BATCH_KEY
from boundlake.sources import workbook

from .test_operators import make_xlsb

SF = "/root/testdata/sf0.001"

SCHEMA = "workbook string, sheet string, row int, col int, value double, text string, formula string"


def beam(spark):
    rows = [("b", "Beam", 0, 1, 300.0, None, None), ("b", "Beam", 1, 1, 1.0, None, None), ("b", "Beam", 2, 1, 100.0, None, None), ("b", "Beam", 3, 0, None, "MS", None), ("b", "Beam", 3, 1, 2.0, None, "=B1/(B2*B3)-1"), ("b", "Beam", 4, 1, 401.0, None, "=SUM(B1:B3)"), ("b", "Beam", 5, 1, None, None, "=B7+1"), ("b", "Beam", 6, 1, None, None, "=B6+1"), ("c", "S", 0, 0, 1.0, None, "=1+"), ("c", "S", 0, 1, 1.0, None, "=COUNT(A5:A7)")]
    return spark.createDataFrame(rows, SCHEMA)


def test_values_and_edges(spark):
    got = {(r.workbook, r.cell): r.value for r in w.values(beam(spark)).collect()}
    assert got["b", "Beam!B4"] == 2 and got["b", "Beam!B5"] == 401 and got["b", "Beam!B6"] is None and got["c", "S!A1"] is None and got["c", "S!B1"] == 3
    edges = {(r.src, r.dst): r.sens for r in w.sensitivities(beam(spark)).collect()}
    assert len(edges) == 6 and edges["Beam!B1", "Beam!B5"] - 1 < 1e-6
    assert w.references(beam(spark)).where("workbook = 'b'").count() == 8
    assert w.oversized(beam(spark)).count() == 0


def test_programs_of_targets(spark):
    rows = w.programs(beam(spark)).where("program = 'Beam!B4'").collect()
    assert {r.name for r in rows if r.kind == "var"} == {"Beam!B1", "Beam!B2", "Beam!B3"}
    assert rows[-1].name == "sub" and len(rows) == len(pg.linearize(pg.op("sub", pg.op("div", pg.var("a"), pg.op("mul", pg.var("b"), pg.var("c"))), pg.const(1))))


def test_lattice(spark):
    rows = [(1, 0, "a", 0.9), (1, 0, "o", 0.1), (1, 1, "/", 1.0), (1, 2, "b", 0.6), (1, 2, "6", 0.4)]
    found = w.lattice_strings(spark.createDataFrame(rows, "image_id int, slot int, tok string, conf double")).orderBy("conf", ascending=False).collect()
    assert found[0].text == "a/b" and abs(sum(r.conf for r in found) - 1) < 1e-9


def test_small_workbooks_are_made_and_scanned_together(spark):
    held = spark.conf.get(BATCH_KEY, "1000")
    spark.conf.set(BATCH_KEY, "7")
    try:
        files = books.books(spark, SF)
        assert "FlatMapGroups" not in files._jdf.queryExecution().toString()
        made = {f.path: bytes(f.content) for f in files.collect()}
    finally:
        spark.conf.set(BATCH_KEY, held)
    want = {}
    for x in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        want.setdefault(f"{x.l_suppkey}-{x.l_orderkey // 20_000}", []).append((x.l_orderkey, x.l_linenumber, x.l_extendedprice, x.l_quantity))
    assert made.keys() == want.keys() and max(map(len, want.values())) > 7
    for path, content in made.items():
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            got = [c[6] for c in workbook.xlsb_cells(archive, path)]
        assert got == [float(v) for key, line, price, quantity in sorted(want[path]) for v in (key, line, quantity, price)]
    some = spark.createDataFrame([*made.items(), *((f"{p}+", c) for p, c in made.items()), ("none", None), ("bad", b"x")], "path string, content binary").coalesce(1)
    assert workbook.scan(some).select(F.count_distinct("workbook")).first()[0] == 2 * len(made)
    few = workbook.scan(some, columns=["value", "row"])
    assert few.columns == ["value", "row"] and sorted(few.collect()) == sorted(workbook.scan(some).select("value", "row").collect())
    parts = [b for _ in range(50) for p, c in made.items() for b in workbook.batches(c, p)]
    joined = list(workbook._joined(iter(parts)))
    assert len(joined) < len(parts) and max(p.num_rows for p in joined) <= workbook.BATCH and sum(p.num_rows for p in joined) == sum(p.num_rows for p in parts)
    assert [tuple(x.values()) for p in workbook.batches(make_xlsb(), "b") for x in p.to_pylist()] == list(workbook.cells(make_xlsb(), "b"))
