"""Limits that must not be there, and the awkward cases of documents, vectors and wide programs."""

import hashlib
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from boundlake import stores
from boundlake.functions import interval, units
from boundlake.functions import program as pg
from boundlake.operators import boxes, ledger, registry, runs, structure, vectors
from boundlake.operators import verdict as v
from boundlake.plans import catalogue, records

A = interval.Ival("lo", "hi")
SF = "/root/testdata/sf0.001"


def bounds(spark, rows, made):
    frame = spark.createDataFrame(rows, "lo double, hi double")
    return [(r.a, r.b) for r in frame.select(F.expr(made.lo).alias("a"), F.expr(made.hi).alias("b")).collect()]


def test_whole_powers_of_any_size_know_their_sign(spark):
    for n in (3, 4, 5, 999, 1000, 1001, 4001):
        (lo, hi), (one_lo, one_hi) = bounds(spark, [(-1.001, -1.0), (1.0, 1.001)], interval.rpow(A, float(n)))
        want = sorted(x**n for x in (-1.001, -1.0))
        assert lo <= want[0] and want[1] <= hi and (hi < 0) == bool(n % 2)
        assert one_lo <= 1 <= 1.001**n <= one_hi and one_hi < 1.001**n * 1.0001
    assert bounds(spark, [(-2.0, -1.0)], interval.rpow(A, 1001.0))[0][1] >= -1  # unbounded below, never empty
    for p in (math.inf, -math.inf, math.nan):
        assert bounds(spark, [(1.0, 2.0)], interval.rpow(A, p)) == [(-math.inf, math.inf)]


def test_waves_of_far_arguments_hold_every_value(spark):
    rows = [(x, x + 0.25) for x in (1e3, 1e6, 2e6, 1e15, -3e18, 1e300)] + [(math.pi / 2 - 1e-12, math.pi / 2 - 1e-13)]
    for fn, real in ((interval.sin, math.sin), (interval.cos, math.cos)):
        for (lo, hi), (a, b) in zip(bounds(spark, rows, fn(A)), rows):
            assert lo <= min(real(a), real(b)) and max(real(a), real(b)) <= hi
            if abs(a) > 2**20:
                assert (lo, hi) == (-1, 1)


def test_a_refuted_model_falls_back_to_the_physical_range(spark):
    root = pg.hole("h", (2.0, 5.0), "B")
    frame = spark.createDataFrame([(1, 3.0, 4.0), (2, 4.0, 3.0), (3, None, None)], "k int, a double, b double")
    got = {r.k: (r.ms_lo, r.ms_hi) for r in pg.evaluate(frame, root, {"h": ("a", "b")}).collect()}
    assert got == {1: (3, 4), 2: (2, 5), 3: (2, 5)}


def test_boxes_are_halved_to_the_end(spark):
    start = spark.createDataFrame([(1, 0.0, 2.0), (2, 0.0, math.inf)], "k int, x_lo double, x_hi double")
    done = boxes.sivia(start, pg.op("sub", pg.var("x"), pg.const(1)), ["x"], 2.0**-44).where("k = 1")
    unknown = done.where("status = 'unknown'").agg(F.max(F.col("x_hi") - F.col("x_lo")).alias("w")).first().w
    assert unknown < 2.0**-44  # 46 levels
    with pytest.raises(ValueError):
        boxes.sivia(start, pg.var("x"), ["x"], 0.0)


def test_units_both_ways(spark):
    known = spark.createDataFrame([("km", 1000.0, 0.0), ("degF", 5 / 9, 255.3722222222222), ("none", 0.0, 1.0)], "name string, scale double, offset double")
    frame = spark.createDataFrame([("km", 2.0), ("degF", 50.0), ("none", 3.0), ("parsec", 1.0), (None, 1.0)], "u string, x double")
    si = units.to_si(frame, known, "x", "u")
    back = {r.u: (r.x, r.own) for r in units.from_si(si, known, "si", "u").collect()}
    assert abs(back["km"][1] - 2) < 1e-12 and abs(back["degF"][1] - 50) < 1e-9
    assert back["none"][1] is None and back["parsec"][1] is None and back[None][1] is None


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        stores.shared_folder(Session())


def test_programs_compile_without_falling_back(spark):
    before = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for name in ("margin_verdict", "run_diff", "section_status", "interval_arithmetic", "interval_exact"):
            catalogue.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)


def test_nearest_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rows = [(i, [math.sin(i * k) for k in range(1, 6)]) for i in range(60)] + [(60, None), (61, []), (62, [0.0] * 5), (63, [math.sin(3 * k) for k in range(1, 6)])]
    frame = spark.createDataFrame(rows, "k long, e array<double>").repartition(5)
    got = {}
    for r in vectors.nearest(frame.where("k % 3 = 0"), frame, "k", "e", 4).collect():
        got.setdefault(r.query, []).append((r.nearest, r.k, r.similarity))

    def cosine(a, b):
        if not a or not b:
            return 0.0
        size = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / size if size else 0.0

    whole = dict(rows)
    for q in range(0, 64, 3):
        want = sorted((-round(cosine(whole[q], e), 9), k) for k, e in rows if k != q)[:4]
        assert [k for _, k, _ in sorted(got[q])] == [k for _, k in want]
    assert vectors.nearest(frame.limit(0), frame, "k", "e").count() == 0


def test_documents_and_statements(spark):
    files = spark.createDataFrame([(1, "a", 5), (2, "it's", None), (3, None, 5)], "id int, name string, folder_id int")
    assert ledger.by_id(files, "id", 9).count() == 0 and ledger.of_folder(files, -1).count() == 3 and ledger.of_folder(files, 5).count() == 2
    said = {r.id: r.statement for r in ledger.upserts(files, "t", "id").collect()}
    assert "VALUES (2, 'it''s', NULL)" in said[2] and "VALUES (3, NULL, 5)" in said[3] and said[1].endswith("DO UPDATE SET name = EXCLUDED.name, folder_id = EXCLUDED.folder_id;")
    assert ledger.canonical_config(0.25, "v9", {"b": 0.5, "a": 1 / 3}) == '{"alpha":0.25,"schema":"v9","thresholds":{"a":0.333333333,"b":0.5}}'
    assert ledger.config_hash(0.25, "v9", {"a": 1.0}) != ledger.config_hash(0.25, "v9", {"a": 1.5})
    cells = spark.createDataFrame([("S", r, c) for r, c in ((0, 0), (9, 25), (0, 26), (0, 51), (0, 52), (0, 701), (0, 702), (4, 16383))], "s string, r int, c int")
    names = [x.n for x in cells.select(ledger.cell_name(F.col("s"), F.col("r"), F.col("c")).alias("n")).collect()]
    assert names == ["S!A1", "S!Z10", "S!AA1", "S!AZ1", "S!BA1", "S!ZZ1", "S!AAA1", "S!XFD5"]


def test_a_vector_of_another_length_takes_nothing_from_the_others(spark):
    rows = [(i, [1.0, float(i)]) for i in range(40)]
    frame = spark.createDataFrame(rows + [(99, [1.0] * 9), (98, None)], "k long, e array<double>").coalesce(1)
    queries = frame.where("k < 3 or k = 99")
    got = vectors.nearest(queries, frame, "k", "e", 5).collect()
    assert len(got) == 20
    plain = {(r.query, r.k) for r in vectors.nearest(frame.where("k < 3"), frame.where("k < 40"), "k", "e", 5).collect()}
    assert {(r.query, r.k) for r in got if r.query != 99} == plain


def test_boxes_that_cannot_be_halved_end_as_unknown(spark):
    start = spark.createDataFrame([(1, 1e17 - 32, 1e17 + 32)], "k int, x_lo double, x_hi double")
    done = boxes.sivia(start, pg.op("sub", pg.var("x"), pg.const(1e17)), ["x"], 0.01).collect()
    assert {r.status for r in done} == {"safe", "fail", "unknown"} and all(r.x_hi - r.x_lo <= 16 for r in done if r.status == "unknown")
    plane = spark.createDataFrame([(1, 1e17 - 32, 1e17 + 32, 0.0, 1.0)], "k int, x_lo double, x_hi double, y_lo double, y_hi double")
    both = boxes.sivia(plane, pg.op("sub", pg.var("x"), pg.op("add", pg.const(1e17), pg.var("y"))), ["x", "y"], 0.01)
    assert both.where("status = 'unknown'").count() > 0


def test_statements_of_every_type(spark):
    row = spark.createDataFrame([(1, float("nan"), float("inf"), b"\x00\xff", [1, None], "it's")], 'id int, a double, b double, c binary, `D"x` array<int>, e string')
    said = ledger.upserts(row, "t", "id").first().statement
    assert said == """INSERT INTO t (id, a, b, c, "D""x", e) VALUES (1, 'NaN', 'Infinity', X'00FF', '[1,null]', 'it''s') ON CONFLICT (id) DO UPDATE SET a = EXCLUDED.a, b = EXCLUDED.b, c = EXCLUDED.c, "D""x" = EXCLUDED."D""x", e = EXCLUDED.e;"""
    listed = ledger.listed(spark.createDataFrame([(2, None), (1, 5)], "k int, b int"), "k", ["k", "b"]).collect()
    assert [r.json for r in listed] == ['{"b":5,"k":1}', '{"b":null,"k":2}']


def test_reports_of_abstentions(spark):
    trace = [(1, "hole_phys", "a", 3.0), (1, "hole_refuted", "kc", 1.0), (1, "disjunction", "d", 4.0), (1, "var", "v", 8.0), (2, "var", "v", 2.0), (3, "hole_phys", "a", 0.0)]
    got = {r.run: r for r in v.explain(spark.createDataFrame(trace, "run int, kind string, name string, width double"), ["run"]).collect()}
    assert {k: (r.holes, r.hole_share, [(x.name, x.kind, x.share) for x in r.reasons]) for k, r in got.items()} == {
        1: (2, 0.25, [("d", "disjunction", 1.0), ("a", "hole_phys", 0.75), ("kc", "hole_refuted", 0.25)]), 2: (0, 0.0, []), 3: (1, 0.0, [("a", "hole_phys", 0.0)]),
    }
    assert got[1].summary == "3 uncertain parts; worst: d" and got[2].summary == "nothing to narrow"
    advice = {x.name: x.advice for x in got[1].reasons}
    assert advice["kc"] == v.ADVICE["hole_refuted"] % "kc" and all("%" not in x for x in advice.values())


def test_merkle_roots_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(structure, "LEVELS", 2)
    rows = [(n, i, f"v{i % 5}") for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 15, 16, 17, 21, 33, 64, 65, 131) for i in range(n)]
    frame = spark.createDataFrame([*rows, (None, 1, "x")], "k long, o long, p string").repartition(7)
    got = {r.k: (r.leaves, r.root) for r in structure.merkle_roots(frame, "k", "o", "p").collect()}
    assert got == {n: (n, structure.merkle_root([f"v{i % 5}".encode() for i in range(n)])) for n in {r[0] for r in rows}}


def test_one_key_is_numbered_by_many_tasks(spark):
    frame = spark.range(20_000).select((F.col("id") * 0 + 3).alias("k"), (F.col("id") * 7919 % 20_000).alias("o")).repartition(5)
    got = structure.ranked(frame.unionByName(spark.createDataFrame([(1, 5), (9, 2), (9, 1)], "k long, o long")), "k", [F.col("o")])
    assert got.where("k = 3 and at <> o").count() == 0 and got.where("k = 3").count() == 20_000
    assert sorted((r.k, r.o, r.at) for r in got.where("k <> 3").collect()) == [(1, 5, 0), (9, 1, 0), (9, 2, 1)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert frame.repartitionByRange(F.col("k"), F.col("o")).select(F.spark_partition_id()).distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_reports_hold_bounds_certificate_and_derivation(spark):
    rows = spark.createDataFrame([(1, 2.0, 3.0, 0.0), (2, -math.inf, 1.5, 0.25)], "k int, ms_lo double, ms_hi double, residual double")
    targets = v.certify(rows, "interval", F.col("k").cast("string"))
    trace = spark.createDataFrame([(1, 1, "b", 'di"v', 3.0, 4.0, True), (1, 0, "a", "sub", 2.0, 3.0, None)], "k int, pos int, node string, op string, lo double, hi double, holed boolean")
    got = {r.k: json.loads(r.report) for r in ledger.target_reports(targets, ["k"], trace).collect()}
    cert = {r.k: r.cert_hash for r in targets.collect()}
    leaf = hashlib.sha256(b"\0" + bytes.fromhex(cert[1])).hexdigest()
    assert got[1] == {
        "verdict": "SAFE", "ms_enclosure": {"lower": 2.0, "upper": 3.0}, "residual": 0.0, "regime": "A", "certificate_ref": f"sha256:{cert[1]}", "audit_leaf": f"sha256:{leaf}",
        "derivation": [{"node": "a", "op": "sub", "encl": [2.0, 3.0], "holed": False, "width": 1.0}, {"node": "b", "op": 'di"v', "encl": [3.0, 4.0], "holed": True, "width": 1.0}],
    }
    assert got[2]["ms_enclosure"]["lower"] == "-Infinity" and got[2]["derivation"] == [] and got[2]["regime"] == "B"
    deltas = spark.createDataFrame([("c1", "SAFE", "FAIL", 0.1, 0.9, 0.8, "SAFE_TO_FAIL", "regressed"), ("c2", None, "SAFE", None, 0.1, None, "NEW", "new")], "cell string, old_verdict string, new_verdict string, old_cs double, new_cs double, delta_cs double, transition string, trend string")
    head, lines = ledger.diff_documents(deltas, spark.createDataFrame([("h", "new"), ("g", "closed")], "id string, change string"))
    assert json.loads(head.first().document) == {"improved": 0, "regressed": 1, "safe": False, "targets": 2}
    found = {(r.kind, r.id): json.loads(r.document) for r in lines.collect()}
    assert found["target", "c1"]["delta_cs"] == 0.8 and found["target", "c2"]["old_verdict"] is None and {("new_hole", "h"), ("closed_hole", "g")} < found.keys()
    fixes = spark.createDataFrame([("f1", "a", [1.0]), ("f1", "a", [1.0]), ("f2", "b", None)], "fix_id string, description string, patch array<double>")
    assert [(r.fix_id, r.status) for r in ledger.proposals(fixes, spark.createDataFrame([("f2", "approved")], "fix_id string, status string")).collect()] == [("f1", "proposed")]


def test_derivations_of_one_program_need_no_join(spark):
    rows = spark.createDataFrame([(1, 2.0, 3.0, 0.0), (2, -math.inf, 1.5, 0.25)], "k int, ms_lo double, ms_hi double, residual double")
    targets = v.certify(rows, "interval", F.col("k").cast("string"))
    node = lambda name, op, lo, hi, holed: F.struct(F.lit(name).alias("node"), F.lit(op).alias("op"), lo.alias("lo"), hi.alias("hi"), F.lit(holed).cast("boolean").alias("holed"))
    beside = ledger.target_reports(targets, ["k"], [node("a", "sub", F.col("ms_lo"), F.col("ms_hi"), None), node("b", 'di"v', F.col("ms_lo") + 1, F.col("ms_hi") + 1, True)])
    assert "Exchange" not in beside._jdf.queryExecution().executedPlan().toString()
    found = {r.k: json.loads(r.report) for r in beside.collect()}
    assert found[1]["derivation"] == [{"node": "a", "op": "sub", "encl": [2.0, 3.0], "holed": False, "width": 1.0}, {"node": "b", "op": 'di"v', "encl": [3.0, 4.0], "holed": True, "width": 1.0}]
    assert found[2]["derivation"][1] == {"node": "b", "op": 'di"v', "encl": ["-Infinity", 2.5], "holed": True, "width": "Infinity"}


def test_target_reports_write_nothing_between(spark, tmp_path):
    items = spark.read.parquet(f"{SF}/lineitem.parquet").limit(20)
    items.unionByName(items.limit(3)).unionByName(items.limit(1).withColumn("l_partkey", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = records.target_reports(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "ExistingRDD" not in plan
    assert [(r.steps, r.digits) for r in found.collect()] == [(2, 64)] * 24


def test_bundles_lower_to_a_hull_of_candidates_and_physical_range(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "b string")
    made = boxes.add(spark.createDataFrame([("a", "x", 0.6, 1.0, 2.0)], "b string, k string, conf double, lo double, hi double"), spark.createDataFrame([("a", "y", 0.9, 1.5, 4.0)], "b string, k string, conf double, lo double, hi double"))
    marks = spark.createDataFrame([("b", 1, 0.0, 10.0), ("b", 2, 5.0, 20.0), ("a", 1, 0.0, 1.0), ("a", 2, 3.0, 9.0)], "b string, o int, lo double, hi double")
    unknown = boxes.mark_unknown(marks, "b", "o")
    assert {(r.b, r.lo, r.hi) for r in unknown.collect()} == {("b", 5.0, 10.0), ("a", 3.0, 9.0)}
    assert {(r.b, r.conf) for r in boxes.top_conf(made, "b").collect()} == {("a", 0.9)}
    assert {tuple(r) for r in boxes.lower(made, unknown, "b", ids).collect()} == {("a", 1.0, 9.0, 3), ("b", 5.0, 10.0, 1), ("c", -math.inf, math.inf, 0)}


def test_sums_over_ranges_of_any_length(spark):
    values = {(r, c): float(r * 7 % 13 + c) for r in range(0, 1500, 3) for c in range(3)}
    cells = spark.createDataFrame([("w", r, c, x) for (r, c), x in values.items()], "k string, row int, col int, value double")
    asked = [(1, 0, 1499, 0, 2), (2, 255, 257, 0, 0), (3, 250, 1030, 1, 1), (4, 1, 2, 0, 2), (5, 999, 999, 2, 2)]
    ranges = spark.createDataFrame([("w", *a) for a in asked], "k string, id int, row0 int, row1 int, col0 int, col1 int")
    got = {r.id: (r.cells, r.total) for r in structure.over_ranges(ranges, cells, ["k"], ["id"]).collect()}
    want = {}
    for i, r0, r1, c0, c1 in asked:
        inside = [x for (r, c), x in values.items() if r0 <= r <= r1 and c0 <= c <= c1]
        if inside:
            want[i] = (len(inside), sum(inside))
    assert got == want and 4 not in got


def test_overrides_links_and_frequencies(spark):
    given = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.0, 1.0)], "k int, lo double, hi double")
    measured = spark.createDataFrame([(2, 0.5, None), (3, 0.0, 0.0)], "k int, lo double, hi double")
    assert sorted(tuple(r) for r in registry.overridden(given, measured, ["k"]).collect()) == [(1, 0.0, 1.0, False), (2, 0.5, None, True)]
    links = spark.createDataFrame([(1, 2), (2, 3), (3, None), (None, 4)], "a int, b int")
    assert structure.touching(links, 2, "a", "b").count() == 2 and structure.touching(links, 4, "a", "b").count() == 1
    rows = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "x string")
    assert [(r.x, r.n) for r in runs.most_frequent(rows, "x", 2).collect()] == [("c", 2), ("a", 1)]


def test_nearest_cases_meet_by_all_shared_symbols(spark):
    rng = random.Random(4)
    syms = ["a", "b", "c", "d"]

    def box(i):
        rows = []
        for s in syms if i % 5 else rng.sample(syms, rng.randint(1, 3)):
            m, w = rng.choice([-3.0, 0.0, 0.1875, 0.25, 1.0, 40.0, 40.25]) + rng.choice([0.0, 0.0, 1 / 64, -1 / 16]), rng.choice([1.0, 1.0, 0.5])
            rows += [(s, m - w / 2, m + w / 2)] * (2 if rng.random() < 0.02 else 1)
        if rng.random() < 0.05:
            rows[0] = (rows[0][0], -math.inf, 1.0)
        return rows

    kept = {i: box(i) for i in range(400)} | {400 + i: [("a", 0.0, 1.0), ("b", 0.0, 1.0)] for i in range(30)}
    asked = {i: kept[i] if i % 2 else box(i) for i in range(60)} | {60: [("a", 0.125, 1.125), ("b", 0.0, 1.0)]}
    long = lambda boxes, key: spark.createDataFrame([(i, f"p{i % 2}", *r) for i, rows in boxes.items() for r in rows], f"{key} int, program_hash string, sym string, lo double, hi double")
    found = runs.case_distance(long(asked, "query"), long(kept, "case_id"), 0.3, 4)
    got, want = {(r.query, r.nearest): (r.case_id, round(r.distance, 12)) for r in found.collect()}, {}
    for q, a in asked.items():
        near = []
        for c, b in kept.items():
            shared = {x[0] for x in a} & {x[0] for x in b}
            pairs = [(x, y) for x in a for y in b if x[0] == y[0]]
            if c % 2 != q % 2 or not shared or len(pairs) != len(shared) or any(math.isinf(v) for p in pairs for x in p for v in x[1:]):
                continue
            middle = lambda x: (x[1] + x[2]) / 2
            distance = math.sqrt(sum(((middle(x) - middle(y)) / max(x[2] - x[1], y[2] - y[1], 0.01 * abs(middle(x)), 1e-9)) ** 2 for x, y in pairs) / len(pairs))
            near += [(round(distance, 12), c)] if distance < 0.3 else []
        want |= {(q, n): (c, d) for n, (d, c) in enumerate(sorted(near)[:4], 1)}
    assert got == want and len({d for _, d in want.values()}) > 10 and [want[60, n][0] for n in range(1, 5)] == [400, 402, 404, 406]
    assert not re.search(r"hashpartitioning\(query#\w+, case_id#", found._jdf.queryExecution().toString())
