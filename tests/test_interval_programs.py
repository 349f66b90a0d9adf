import json
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from boundlake.functions import affine, interval
from boundlake.functions import program as pg
from boundlake.operators import boxes
from boundlake.operators import verdict as v

A, B = interval.Ival("a", "b"), interval.Ival("c", "d")


def bounds(spark, rows, kernels):
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    cols = [F.expr(e).alias(f"{k}_{s}") for k, i in kernels.items() for s, e in (("lo", i.lo), ("hi", i.hi))]
    return df.select(*cols).collect()


def test_basic_operations_enclose_the_exact_result(spark):
    rng = random.Random(1)
    num = lambda: rng.choice([rng.uniform(-5, 5), rng.uniform(-1, 1) * 10 ** rng.randint(-20, 20), float(rng.randint(-3, 3))])
    rows = []
    for _ in range(300):
        (a, b), (c, d) = sorted([num(), num()]), sorted([num(), num()])
        rows.append((a, b, c, d))
    kernels = {"add": interval.add(A, B), "sub": interval.sub(A, B), "mul": interval.mul(A, B), "div": interval.div(A, B), "eadd": interval.exact_add(A, B), "emul": interval.exact_mul(A, B)}
    for (a, b, c, d), r in zip(rows, bounds(spark, rows, kernels)):
        fa, fb, fc, fd = map(Fraction, (a, b, c, d))
        corners = {"add": [fa + fc, fb + fd], "sub": [fa - fd, fb - fc], "mul": [x * y for x in (fa, fb) for y in (fc, fd)]}
        corners |= {"eadd": corners["add"], "emul": corners["mul"]}
        if not c <= 0 <= d:
            corners["div"] = [x / y for x in (fa, fb) for y in (fc, fd)]
        else:
            assert (r.div_lo, r.div_hi) == (-math.inf, math.inf)
        for k, exact in corners.items():
            assert Fraction(r[f"{k}_lo"]) <= min(exact) and max(exact) <= Fraction(r[f"{k}_hi"])


def test_golden_identities(spark):
    inf = math.inf
    rows = [(1.0, 2.0, 3.0, 4.0), (-1.0, 2.0, -3.0, 4.0), (1.0, 2.0, -1.0, 1.0), (-2.0, 3.0, 0.0, 0.0), (-1.0, -0.5, inf, -inf)]
    r = bounds(spark, rows, {"add": interval.exact_add(A, B), "mul": interval.exact_mul(A, B), "div": interval.div(A, B), "sqr": interval.sqr(A), "root": interval.sqrt(A), "log": interval.log(A), "sum": interval.add(A, B), "cube": interval.ipow(A, 3)})
    assert (r[0].add_lo, r[0].add_hi) == (4, 6)
    assert (r[1].mul_lo, r[1].mul_hi) == (-6, 8)
    assert (r[2].div_lo, r[2].div_hi) == (-inf, inf)
    assert r[3].sqr_lo == 0 and 9 <= r[3].sqr_hi < 9.0001 and r[3].cube_lo <= -8 and r[3].cube_hi >= 27
    assert r[4].root_lo > r[4].root_hi and r[4].log_lo > r[4].log_hi and r[4].sum_lo > r[4].sum_hi


@pytest.mark.parametrize("name,fn", [("sin", math.sin), ("cos", math.cos), ("tan", math.tan), ("exp", math.exp), ("sqrt", lambda x: math.sqrt(max(x, 0))), ("log", lambda x: math.log(x) if x > 0 else -math.inf)])
def test_functions_enclose_samples(spark, name, fn):
    rng = random.Random(2)
    rows = [(*sorted([rng.uniform(-6, 6), rng.uniform(-6, 6)]), 0.0, 0.0) for _ in range(120)]
    for (a, b, *_), r in zip(rows, bounds(spark, rows, {"f": getattr(interval, name)(A)})):
        for k in range(21):
            x = min(max(a + (b - a) * k / 20, a), b)  # a rounded step may leave the box
            if name in ("log", "sqrt") and x < 0:
                continue
            y = fn(x)
            assert r.f_lo <= y <= r.f_hi


def random_program(rng, depth=4):
    if depth == 0 or rng.random() < 0.2:
        return pg.var(rng.choice("xy")) if rng.random() < 0.7 else pg.const(rng.randint(-4, 4))
    name = rng.choice(["add", "sub", "mul", "div", "neg", "sin", "exp"])
    return pg.op(name, *(random_program(rng, depth - 1) for _ in range(pg.OPS[name])))


def evaluate_at(node, at):
    args = [evaluate_at(x, at) for x in node.args]
    if node.kind == "const":
        return node.value
    if node.kind == "var":
        return at[node.name]
    try:
        return {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b, "neg": lambda a: -a, "sin": math.sin, "exp": math.exp}[node.name](*args)
    except (ZeroDivisionError, OverflowError, ValueError):
        return math.nan


def test_random_programs_enclose_the_truth_and_their_verdicts_hold(spark):
    rng = random.Random(3)
    boxes_ = [(-1.0, 0.5, 2.0, 3.0), (0.25, 0.5, -2.0, -1.0), (1.0, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(boxes_, "x_lo double, x_hi double, y_lo double, y_hi double").coalesce(1)
    for _ in range(12):
        root = random_program(rng)
        done = pg.evaluate(df, root, {"x": ("x_lo", "x_hi"), "y": ("y_lo", "y_hi")}).withColumn("verdict", v.decide(F.col("ms_lo"), F.col("ms_hi"), F.col("residual"))).collect()
        for r in done:
            lo, hi = affine.evaluate(root, {"x": (np.array([r.x_lo]), np.array([r.x_hi])), "y": (np.array([r.y_lo]), np.array([r.y_hi]))})
            for _ in range(15):
                y = evaluate_at(root, {"x": rng.uniform(r.x_lo, r.x_hi), "y": rng.uniform(r.y_lo, r.y_hi)})
                if math.isnan(y):
                    continue
                slack = 1e-12 * abs(y)
                assert r.ms_lo - slack <= y <= r.ms_hi + slack
                assert lo[0] - slack <= y <= hi[0] + slack
                assert not (r.verdict == "SAFE" and y < 0) and not (r.verdict == "FAIL" and y > 0)


def test_program_files_give_their_verdicts(spark):
    ast = {"kind": "op", "op": "sub", "args": [{"kind": "op", "op": "div", "args": [{"kind": "var", "sym": "sall"}, {"kind": "op", "op": "mul", "args": [{"kind": "var", "sym": "c"}, {"kind": "var", "sym": "L"}]}]}, {"kind": "const", "v": 1}]}
    for load, want in (([90, 110], "SAFE"), ([400, 500], "FAIL"), ([200, 400], "ABSTAIN")):
        root, box, ks = pg.load(json.dumps({"ks": 0, "box": {"L": load, "sall": [300, 300], "c": [1, 1]}, "ast": ast}))
        row = spark.range(1).select(*(F.lit(x).alias(f"{k}_{s}") for k, b in box.items() for s, x in zip(("lo", "hi"), b)))
        r = v.certify(pg.evaluate(row, root, {k: (f"{k}_lo", f"{k}_hi") for k in box}, ks), "interval", F.lit("p")).withColumn("good", v.valid(F.lit("p"))).first()
        assert r.verdict == want and r.good
    assert pg.from_json(pg.to_json(root)).hash == root.hash


def test_holes_count_once_for_each_use(spark):
    h = pg.hole("k", (1.0, 3.0))
    r = pg.evaluate(spark.range(1), pg.op("add", h, pg.op("mul", h, pg.const(2))), {}, 0.5).first()
    assert r.residual == 2 * 1.0 + 0.5
    assert pg.evaluate(spark.range(1), pg.disj(pg.const(1), pg.const(4)), {}).first().ms_hi == 4
    assert pg.evaluate(spark.range(1), pg.call("mystery", pg.const(1)), {}).first().ms_lo == -math.inf


def test_shared_parts_make_one_slot():
    x = pg.op("add", pg.var("a"), pg.const(1))
    assert len(pg.linearize(pg.op("mul", x, pg.op("add", pg.var("a"), pg.const(1))))) == 4
    d = pg.differences(x, pg.op("add", pg.var("a"), pg.hole("h", (0, 1))))
    assert d["new_holes"] == ["h"] and not d["closed_holes"]


def test_affine_keeps_correlation():
    x = (np.array([1.0]), np.array([2.0]))
    lo, hi = affine.evaluate(pg.op("sub", pg.var("x"), pg.var("x")), {"x": x})
    assert abs(lo[0]) < 1e-12 and abs(hi[0]) < 1e-12


def test_criticality_bands(spark):
    df = spark.createDataFrame([(0.5, 0.6, 0.01), (0.0, 0.2, 0.0), (-1.0, -0.5, 0.0), (math.nan, 1.0, 0.0), (-math.inf, 1.0, 0.0)], "ms_lo double, ms_hi double, residual double")
    cs = [r.cs for r in df.select(v.score(F.col("ms_lo"), F.col("ms_hi"), F.col("residual")).alias("cs")).collect()]
    assert cs[0] < 0.2 and 0.45 <= cs[1] <= 0.55 and cs[2] > 0.75 and cs[3] == cs[4] == 1.0
    assert [r.l for r in spark.createDataFrame([(0.1,), (0.3,), (0.6,), (0.8,), (0.95,)], "c double").select(v.label(F.col("c")).alias("l")).collect()] == ["SAFE", "WATCH", "REVIEW", "CRITICAL", "HALT"]


def test_set_inversion_shares(spark):
    one = spark.createDataFrame([(0, 0.0, 2.0), (1, 5.0, 6.0)], "run int, x_lo double, x_hi double")
    shares = {r.run: r for r in boxes.volume_share(boxes.sivia(one, pg.op("sub", pg.var("x"), pg.const(1)), ["x"], 0.01), ["x"], ["run"]).collect()}
    assert 0.45 <= shares[0].safe_share <= 0.55 and shares[1].safe_share > 0.99 and shares[1].unknown_share == 0


def test_probes_and_bundles(spark):
    p = spark.createDataFrame([("h", 0.0, 0.0), ("h", 1.0, 2.0), ("h", 3.0, 3.0)], "hole string, x double, f double")
    m = boxes.probe_model(p).first()
    assert (m.lo, m.hi, m.lip, m.monotone) == (0, 3, 2, 1)
    c = spark.createDataFrame([("h", 2.0, -10.0, 10.0)], "hole string, lip double, phys_lo double, phys_hi double")
    q = spark.createDataFrame([("h", "q", 1.0, 1.5)], "hole string, query string, lo double, hi double")
    r = boxes.lipschitz(q, p, c).first()
    assert r.lo <= 2 and r.hi >= 2.25 and not r.refuted
    assert boxes.lipschitz(q, p, c.withColumn("lip", F.lit(1.0))).first().refuted
