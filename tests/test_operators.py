import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from boundlake.operators import registry, runs, structure
from boundlake.plans import catalogue
from boundlake.sources import files, workbook
from boundlake.streaming import events

from .compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_twin(spark, db, name):
    if name in catalogue.ORACLE_SQL:
        assert compare(spark, db, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF)[0] == ""
    else:
        assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_registry_tree(spark):
    names = [
        "bridges/north/cables/tension_v3.xlsx", "bridges/north/cables/tension_v7.xlsx", "bridges/north/cables/tension_v12.xlsx",
        "bridges/south/deck plan R2.csv", "bridges/south/piers/pier-depth_Rev_B.xlsx", "towers/mast.xlsx", "readme.txt",
    ]
    df = spark.createDataFrame([(n, n.rpartition("/")[2], i) for i, n in enumerate(names)], "rel string, name string, mtime long")
    out = {r.rel: r for r in files.catalogue(df).collect()}
    assert {n for n in names if out[n].is_head} == {names[2], names[3], names[4], names[5], names[6]}
    assert [out[n].revision for n in names] == [3, 7, 12, 2, 2, None, None] and out[names[0]].config_key == "tension"
    assert {r.rel: r.n_files for r in registry.folders(df, "rel").collect()} == {"": 7, "bridges": 5, "bridges/north": 3, "bridges/north/cables": 3, "bridges/south": 2, "bridges/south/piers": 1, "towers": 1}
    ranks = [("deck_v41.csv", 41), ("deck_R8.csv", 8), ("deck.csv", None), ("deck_RevD_2.csv", 4), ("deck_RevD2_9_9.csv", 4.002), ("deck_RevE.csv", 5), ("deck_reviewed_twice.csv", None), ("deck rev 6.csv", 6), ("deck_RevAA.csv", 27)]
    found = spark.createDataFrame([(n,) for n, _ in ranks], "n string").select("n", registry.revision_rank(F.col("n")).alias("r")).collect()
    assert {r.n: r.r for r in found} == dict(ranks)


def test_formats_and_ties(spark):
    texts = [(i, " | ".join(words)) for i, (_, _, words) in enumerate(registry.FORMATS)] + [(100, "a panel with buckling"), (101, "skin"), (102, ""), (103, None)]
    got = {r.id: r for r in registry.classify(spark.createDataFrame(texts, "id int, t string"), "id", "t", registry.markers(spark)).collect()}
    for i, (name, _, words) in enumerate(registry.FORMATS):
        assert (got[i].format_type, got[i].hits) == (name, len(words))
    assert (got[100].format_type, got[101].format_type) == ("panel_buckling", "skin_stringer_fem")
    assert got[102].format_type == got[103].format_type == "unknown"
    tie = registry.classify(spark.createDataFrame([(1, "shear and torque")], "id int, t string"), "id", "t", registry.markers(spark)).first()
    assert tie.format_type == "rivet_joint"  # one marker each; the earlier format wins
    assert spark.range(1).select(registry.domain(F.lit("bolt_joint")).alias("d"), registry.domain(F.lit("x")).alias("n")).first()[:] == ("fastener.bolt", None)


def test_unsupported_functions_are_all_found(spark):
    rows = [(x, f"={x.lower()}(A1,2)") for x in runs.UNSUPPORTED]
    found = {r.name: r for r in spark.createDataFrame(rows, "name string, f string").select("name", runs.reasons(F.col("f")).alias("why")).collect()}
    for name in runs.UNSUPPORTED:
        assert f"unsupported_function:{name}" in found[name].why
    cells = spark.createDataFrame([("w", "=A1+1", None), ("w", "=[2]X!A1", None), ("w", "=VLOOKUP(A1,B1:B2,1)", None), ("w", None, 3.0), ("w", None, None), ("v", "=A1", None)], "w string, f string, v double")
    got = {r.w: r for r in runs.ledger(cells, "w", "f", "v").collect()}
    assert (got["w"].total_cells, got["w"].formula_cells, got["w"].constant_cells, got["w"].hole_cells, got["w"].confidence) == (4, 3, 1, 2, "low")
    assert got["w"].flags == ["high_uncovered_ratio", "external_refs_present"] and (got["v"].confidence, got["v"].flags) == ("high", [])
    broken = spark.createDataFrame([("u", "c1", "=1+", None, None), ("u", "c2", "=[1]A!B1+", 2.0, None), ("u", "c3", None, None, "t"), ("u", "c4", None, None, None)], "w string, c string, f string, v double, t string")
    u = runs.ledger(broken, "w", "f", "v", "t").first()
    assert (u.total_cells, u.formula_cells, u.constant_cells, u.hole_cells, u.flags) == (3, 2, 0, 2, ["high_uncovered_ratio", "external_refs_present"])
    assert [(r.pos, r.cell, r.reason) for r in runs.hole_samples(broken, "w", "f", "c", [F.col("c")], 2).orderBy("pos").collect()] == [(1, "c1", "parse_error"), (2, "c2", "external_ref")]
    assert {(r.construct, r.file_count, r.cell_count) for r in runs.heatmap(broken, "w", "f").collect()} == {("parse_error", 1, 2), ("external_ref", 1, 1)}
    assert {(r.reason, r.n) for r in runs.hole_reasons(cells, "w", "f").collect()} == {("external_ref", 1), ("unsupported_function:VLOOKUP", 1), ("unsupported_function:LOOKUP", 1)}


def test_graph_and_glue(spark):
    e = spark.createDataFrame([("mast", "anchor"), ("tower", "mast"), ("park", "tower")], "src string, dst string")
    start = spark.createDataFrame([("park",)], "node string")
    assert {r.node: r.depth for r in structure.reach(e, start, 3).collect()} == {"park": 0, "tower": 1, "mast": 2, "anchor": 3}
    assert {r.node for r in structure.reach(e, start, 2).collect()} == {"park", "tower", "mast"}
    cycle = spark.createDataFrame([("u", "v"), ("v", "w"), ("w", "u"), ("t", "u"), ("s", "t")], "src string, dst string")
    assert {r.node: r.level for r in structure.topological_levels(cycle).collect()} == {"s": 0, "t": 1, "u": -1, "v": -1, "w": -1}
    assert {r.node for r in structure.affected(cycle, spark.createDataFrame([("w",)], "node string")).collect()} == {"s", "t", "u", "v", "w"}
    s = spark.createDataFrame([("k1", "f", -3.0, 6.5, "m", 1), ("k2", "f", 1.5, 9.0, "m", 2), ("k3", "f", 2.25, 4.0, "m", 3), ("k1", "g", 7.0, 8.0, "m", 1), ("k2", "g", 12.0, 13.0, "m", 2), ("k3", "g", 7.5, 12.5, "m", 3), ("k1", "h", 2.0, 3.0, "m", 1), ("k2", "h", 2.0, 3.0, "s", 2)], "region string, sym string, lo double, hi double, dim string, ord int")
    g = {r.sym: r for r in structure.glue(s).collect()}
    assert (g["f"].lo, g["f"].hi, g["g"].conflict, g["h"].conflict) == (2.25, 4, "range", "dimension")
    assert {r.sym: r.conflicts for r in structure.fold_glue(s).collect()}["g"] == ["k2"]
    o = [("D", "E", "p", 2.5), ("E", "F", "p", -4.0), ("F", "G", "p", 1.0), ("G", "D", "p", 0.25), ("D", "E", "q", 2.5), ("E", "F", "q", -4.0), ("D", "F", "q", -1.5), ("D", "E", "t", 7.0), ("E", "F", "t", 7.0), ("D", "E", "w", 3.0), ("E", "D", "w", -3.0)]
    h = {r.symbol: (r.h1, r.obstructed) for r in structure.cohomology(spark.createDataFrame(o, "a string, b string, symbol string, offset double")).collect()}
    assert h == {"p": (1, True), "q": (1, False), "t": (0, False), "w": (1, False)}


def test_long_chains_are_followed_to_the_end(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(149)], "src int, dst int").coalesce(1)
    assert {r.node: r.level for r in structure.topological_levels(e).collect()} == {i: i for i in range(150)}
    got = structure.affected(e, spark.createDataFrame([(149,)], "node int")).collect()
    assert {r.node: r.depth for r in got} == {i: 149 - i for i in range(149)} and len(got) == 149
    with pytest.raises(RuntimeError):
        structure.topological_levels(e, 2)


def test_coverage_has_no_unused_parameter(spark):
    cells = spark.createDataFrame([("w", "=A1+1"), ("w", "=VLOOKUP(A1,B1:C9,2)"), ("w", None)], "w string, f string")
    assert runs.coverage(cells, "w", "f").first().asDict() == {"w": "w", "cells": 3, "formulas": 2, "unsupported": 1, "confidence": "low"}
    with pytest.raises(TypeError):
        runs.coverage(cells, "w", "f", samples=50)


def test_merkle(spark):
    leaves = [b"a", b"b", b"c", b"d", b"e"]
    root = structure.merkle_root(leaves)
    df = spark.createDataFrame([("k", i, x.decode()) for i, x in enumerate(leaves)], "k string, i int, p string")
    assert structure.merkle_roots(df, "k", "i", "p").first().root == root
    for i, x in enumerate(leaves):
        proof = structure.merkle_proof(leaves, i)
        assert structure.merkle_verify(x, proof, root) and not structure.merkle_verify(b"z", proof, root)


def test_run_pair(spark):
    kind = "cell string, verdict string, lo double, hi double, cs double, holes int"
    old = spark.createDataFrame([("C7", "ABSTAIN", -2.0, 1.0, 0.71, 3), ("D7", "SAFE", 4.0, 4.5, 0.02, 0), ("E7", "SAFE", 1.0, 2.0, 0.12, 0)], kind)
    new = spark.createDataFrame([("C7", "SAFE", 0.4, 1.0, 0.16, 1), ("D7", "FAIL", -4.5, -4.0, 0.98, 0), ("F7", "SAFE", 1.0, 2.0, 0.12, 0)], kind)
    d = {r.cell: r for r in runs.diff(old, new).collect()}
    assert set(d) == {"C7", "D7", "F7"} and d["D7"].trend == "regressed" and d["C7"].trend == "improved" and d["F7"].trend == "new"
    assert d["C7"].delta_holes == -2 and d["C7"].transition == "ABSTAIN_TO_SAFE" and d["D7"].transition == "SAFE_TO_FAIL"
    assert {r.cell for r in runs.diff(old, new, full=True).collect()} == {"C7", "D7", "E7", "F7"}
    assert not runs.diff_summary(runs.diff(old, new)).first().safe


def make_xlsx():
    sheet = '<worksheet xmlns="m"><sheetData><row r="1"><c r="B1"><v>300</v></c></row><row r="4"><c r="A4" t="s"><v>0</v></c><c r="B4"><f>B1/2-1</f><v>149</v></c><c r="C4"><f t="shared" si="0">B1+1</f><v>301</v></c><c r="D4"><f t="shared" si="0"/><v>2</v></c><c r="E4" t="e"><v>#DIV/0!</v></c><c r="F4" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="o"><sheets><sheet name="Beam" sheetId="1" r:id="rId1"/></sheets><definedNames><definedName name="Allow">Beam!$B$1</definedName></definedNames></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>MS</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/media/image1.png", b"x")
    return out.getvalue()


def make_xlsb():
    rec = lambda kind, data: (bytes([kind]) if kind < 128 else bytes([kind & 127 | 128, kind >> 7])) + bytes([len(data)]) + data
    wide = lambda s: struct.pack("<I", len(s)) + s.encode("utf-16-le")
    at = lambda c: struct.pack("<II", c, 0)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.bin", rec(156, struct.pack("<II", 0, 1) + wide("rId1") + wide("Calc")))
        z.writestr("xl/_rels/workbook.bin.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.bin"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.bin", rec(0, struct.pack("<I", 0)) + rec(2, at(0) + struct.pack("<I", 10 << 2 | 2)) + rec(5, at(1) + struct.pack("<d", 32.5)) + rec(0, struct.pack("<I", 1)) + rec(9, at(0) + struct.pack("<d", 42.0) + b"\0\0") + rec(6, at(1) + wide("txt")))
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(make_xlsx())
    (tmp_path / "b.xlsb").write_bytes(make_xlsb())
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    got = {(r.sheet, r.row, r.col): r for r in workbook.read(spark, str(tmp_path)).collect()}
    assert got["Beam", 0, 1].value == 300 and got["Beam", 3, 0].text == "MS" and got["Beam", 3, 1].formula == "B1/2-1" and got["Beam", 3, 3].formula == "B1+1" and got["Beam", 3, 5].text == "in"
    assert got["Calc", 0, 0].value == 10 and got["Calc", 0, 1].value == 32.5 and got["Calc", 1, 0].value == 42 and got["Calc", 1, 1].text == "txt"
    spark.dataSource.register(workbook.WorkbookSource)
    assert list(workbook.cells((tmp_path / "a.xlsx").read_bytes(), "a"))[0][:5] == ("a", 0, "Beam", 0, 1)
    assert workbook.defined_names(make_xlsx()) == [("Allow", "Beam!$B$1")] and len(workbook.images(make_xlsx())) == 1


def test_png():
    rows = b"".join(bytes([f]) + bytes(r) for f, r in ((0, [1, 2, 3]), (1, [1, 1, 1]), (2, [1, 1, 1]), (4, [1, 0, 0])))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + b"\0\0\0\0"
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 4, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert files.png(data) == (3, 4, bytes([1, 2, 3, 1, 2, 3, 2, 3, 4, 3, 3, 4])) and files.png(b"x") is None


def test_streams(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    source = tmp_path / "in"
    for part in range(3):
        table.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(str(source))
    stream = events.read(spark, str(source), table.schema.simpleString()[7:-1].replace(":", " "), 1)
    events.run_once(events.triage(stream, F.lit(4), spark.createDataFrame([(1,)], "user_id long"), "user_id"), str(tmp_path / "out"), str(tmp_path / "c2"))
    assert {r.action for r in spark.read.parquet(str(tmp_path / "out")).select("action").distinct().collect()} == {"halt"}
    q = events.windows(stream, "1 hour", ["event_type"], "60 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == table.count()
    lines = spark.createDataFrame([('{"event_id": 1, "params": {"a": 2.5}, "timestamp": 60}',), ("broken",)], "value string")
    assert [(r.event_id, r.params) for r in events.parse(lines).collect()] == [(1, {"a": 2.5}), (None, None)]


def test_snapshots(spark, tmp_path):
    folder = tmp_path / "watched"
    (folder / "sec").mkdir(parents=True)
    snap = lambda: spark.createDataFrame(files.listing(spark, str(folder)).select("rel", "sha256").collect(), "rel string, sha256 string")
    (folder / "sec" / "a.csv").write_text("1")
    first = snap()
    assert [r.rel for r in events.changes(first, None).collect()] == ["sec/a.csv"]
    assert events.changes(snap(), first).count() == 0
    (folder / "sec" / "a.csv").write_text("2")
    (folder / "sec" / "b.csv").write_text("1")
    assert {r.rel for r in events.changes(snap(), first).collect()} == {"sec/a.csv", "sec/b.csv"}
