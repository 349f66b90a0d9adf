"""Models of several variables, adaptive probes and stored results against plain loops."""

import math
import random

from pyspark.sql import functions as F

from boundlake.operators import cache, probes
from boundlake.plans import catalogue


def cloud(seed, holes=3, n=60):
    rng = random.Random(seed)
    rows = [(h, rng.uniform(-3, 3), rng.uniform(0, 5), rng.uniform(-1, 1) * (h + 1)) for h in range(holes) for _ in range(n)]
    smooth = [(7, x / 4, y / 4, 2 * x / 4 + y / 4) for x in range(8) for y in range(8)]
    return rows + smooth + [rows[0], (0, *rows[0][1:3], 5.0), (8, 1.0, 1.0, 1.0), (9, 1.0, 1.0, 2.0), (9, 1.0, 2.0, 2.0), (0, math.nan, 1.0, 1.0), (0, 1.0, 1.0, math.inf)]


def finite(rows):
    return [r for r in rows if all(map(math.isfinite, r[1:]))]


def steepest(rows):
    out = {}
    for h, x, y, f in finite(rows):
        out.setdefault(h, 0.0)
        for g, a, b, e in finite(rows):
            d = math.dist((x, y), (a, b))
            if g == h and d > 1e-12:
                out[h] = max(out[h], abs(f - e) / d)
    return out


def test_slopes_are_those_of_all_pairs(spark):
    for seed in (1, 2):
        rows = cloud(seed)
        got = {r.hole: r for r in probes.slopes(spark.createDataFrame(rows, "hole int, x double, y double, f double").repartition(5), ["x", "y"]).collect()}
        want = steepest(rows)
        assert got.keys() == want.keys()
        for h, r in got.items():
            mine = [f for g, *_, f in finite(rows) if g == h]
            assert math.isclose(r.lip, want[h], rel_tol=1e-12) and (r.lo, r.hi) == (min(mine), max(mine))


def test_enclosures_are_the_meet_of_all_cones(spark):
    rows, rng = cloud(3), random.Random(4)
    frame = spark.createDataFrame(rows, "hole int, x double, y double, f double")
    models = probes.slopes(frame, ["x", "y"])
    steep = steepest(rows)
    boxes = [(h, q, (a := rng.uniform(-3, 3)), a + rng.choice([0.0, 0.1, 2.0]), (b := rng.uniform(0, 5)), b + 0.3) for h in (0, 1, 2, 7, 8, 5) for q in range(9)]
    limits = [(h, steep.get(h, 1.0) * k, -50.0, 50.0) for h, k in ((0, 1.25), (1, 1.0001), (2, 0.9), (7, 1.5), (8, 1.0), (5, 1.0))]
    asked = spark.createDataFrame(boxes, "hole int, query int, x_lo double, x_hi double, y_lo double, y_hi double")
    constants = spark.createDataFrame(limits, "hole int, lip double, phys_lo double, phys_hi double")
    got = {(r.hole, r.query): r for r in probes.enclose(asked, frame, constants, models, ["x", "y"]).collect()}
    assert len(got) == len(boxes)
    lips = {h: lip for h, lip, *_ in limits}
    for h, q, x0, x1, y0, y1 in boxes:
        cones = [(f - (d := lips[h] * (math.dist(((x0 + x1) / 2, (y0 + y1) / 2), (x, y)) + math.hypot((x1 - x0) / 2, (y1 - y0) / 2))), f + d) for g, x, y, f in finite(rows) if g == h]
        lo, hi = max([-50.0] + [a for a, _ in cones]), min([50.0] + [b for _, b in cones])
        refuted = steep.get(h, 0.0) > lips[h] or lo > hi
        r = got[h, q]
        assert r.refuted == refuted
        assert math.isclose(r.lo, -50.0 if refuted else lo, rel_tol=1e-9) and math.isclose(r.hi, 50.0 if refuted else hi, rel_tol=1e-9)
        assert r.residual == (50.0 if refuted or not cones else 0.0)


def plain_adaptive(start, fn, rounds):
    found = list(start)
    for _ in range(rounds):
        best, pair = -1.0, None
        for i in range(len(found)):
            for j in range(i + 1, len(found)):
                d = math.dist(found[i][:2], found[j][:2])
                if d > 1e-12 and abs(found[i][2] - found[j][2]) / d > best:
                    best, pair = abs(found[i][2] - found[j][2]) / d, (i, j)
        if pair is None:
            break
        x, y = ((found[pair[0]][k] + found[pair[1]][k]) * 0.5 for k in (0, 1))
        found.append((x, y, fn(x, y)))
    return found


def test_adaptive_probes_equal_a_plain_loop(spark, tmp_path):
    rows = [(k, b) for k, b in enumerate([0.0, 2500.0, -7300.0, 9999.0])]
    spark.createDataFrame(rows, "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got: dict = {}
    for r in catalogue.QUERIES["adaptive_models"](spark, str(tmp_path)).collect():
        got.setdefault(r.s_suppkey, {})[r.at] = (r.x0, r.x1, r.f)
    for k, b in rows:
        fn = lambda x, y, c=abs(b) / 10000: abs(x - c) * 2 + x * y
        want = plain_adaptive([(i / 2, j / 2, fn(i / 2, j / 2)) for i in range(3) for j in range(3)], fn, 8)
        assert [tuple(round(x, 6) for x in p) for p in want] == [got[k][i] for i in range(17)]


def test_grids(spark):
    holes = spark.createDataFrame([(1, 0.0, 4.0, 1.0, 1.0)], "hole int, x_lo double, x_hi double, y_lo double, y_hi double")
    assert sorted((r.x, r.y) for r in probes.grid(holes, ["x", "y"], 3).collect()) == [(x, 1.0) for x in (0, 0, 0, 2, 2, 2, 4, 4, 4)]
    assert [(r.x, r.y) for r in probes.grid(holes, ["x", "y"], 1).collect()] == [(2.0, 1.0)]


def test_results_end_by_program_and_by_symbol(spark):
    entries = spark.createDataFrame(
        [("p", "b1", ["x", "y"], 1, 10), ("p", "b1", ["x", "y"], 4, 11), ("p", "b2", ["y"], 2, 20), ("q", "b1", ["x"], 3, 30), ("r", "b9", ["z"], 1, 40)],
        "program_hash string, box_fp string, syms array<string>, version long, result long",
    )
    none = spark.createDataFrame([], "kind string, value string, version long")
    ended = spark.createDataFrame([("program", "p", 3), ("symbol", "z", 1), ("symbol", "x", 2), ("program", "p", 1)], "kind string, value string, version long")
    results = lambda df: sorted((r.program_hash, r.box_fp, r.result) for r in df.collect())
    assert results(cache.live(entries, none)) == [("p", "b1", 11), ("p", "b2", 20), ("q", "b1", 30), ("r", "b9", 40)]
    assert results(cache.live(entries, ended)) == [("p", "b1", 11), ("q", "b1", 30)]
    wanted = spark.createDataFrame([("p", "b1"), ("p", "b2"), ("x", "y")], "program_hash string, box_fp string")
    assert {(r.box_fp, r.hit, r.result) for r in cache.lookup(wanted, entries, ended).collect()} == {("b1", True, 11), ("b2", False, None), ("y", False, None)}
    uses = spark.createDataFrame([("r", "b9", 9), ("r", "b9", 2)], "program_hash string, box_fp string, version long")
    assert results(cache.evict(entries, none, uses, 2)) == [("p", "b1", 11), ("r", "b9", 40)]
    box = lambda *s: F.array(*(F.struct(F.lit(n).alias("sym"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for n, a, b in s))
    same = spark.range(1).select((cache.fingerprint(box(("a", 0.0, 1.0), ("b", 2.0, 3.0))) == cache.fingerprint(box(("b", 2.0, 3.0), ("a", 0.0, 1.0)))).alias("s")).first()
    assert same.s
