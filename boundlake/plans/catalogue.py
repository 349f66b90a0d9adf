"""Registered queries of the engine and their SQL twins.

Each query applies operators to whole tables; each twin is plain SQL for an
independent engine. Doubles that pass through library functions or sums are
rounded, the rest must be equal bit for bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formula, interval, points, units
from ..functions import program as pg
from ..operators import boxes, cache, registry, runs, structure
from ..operators import probes as probes_
from ..operators import verdict as v
from ..sources import workbook
from ..streaming import events as events_
from . import twins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        name = fn.__name__
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x, digits: int = 6):
    return F.round(x, digits)


def big(x):
    return F.col(x).cast("long") if isinstance(x, str) else x.cast("long")


# --- interval programs over line items ---------------------------------------------------------

MARGIN = pg.op("sub", pg.op("div", pg.var("sall"), pg.op("mul", pg.const(1500), pg.var("load"))), pg.const(1))
BOUNDS = {"sall": ("sall_lo", "sall_hi"), "load": ("load_lo", "load_hi")}
HOLED = pg.op("sub", pg.op("div", pg.hole("kc", (1400.0, 1600.0), "B", pg.var("load")), pg.op("div", pg.var("sall"), pg.var("load"))), pg.const(1))


def margin_boxes(spark: SparkSession, sf_dir: str, rel: float) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_extendedprice") * (1 - rel)).alias("sall_lo"), (F.col("l_extendedprice") * (1 + rel)).alias("sall_hi"),
        (F.col("l_quantity") * (1 - rel)).alias("load_lo"), (F.col("l_quantity") * (1 + rel)).alias("load_hi"),
    )


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
PRIORITY = "CASE WHEN cs < 0.2 THEN 0 WHEN cs < 0.5 THEN 1 WHEN cs < 0.75 THEN 2 WHEN cs < 0.9 THEN 3 ELSE 4 END"
LABEL = "CASE WHEN cs < 0.2 THEN 'SAFE' WHEN cs < 0.5 THEN 'WATCH' WHEN cs < 0.75 THEN 'REVIEW' WHEN cs < 0.9 THEN 'CRITICAL' ELSE 'HALT' END"
margin_sql = twins.margins


def margins(spark: SparkSession, sf_dir: str, rel: float = 0.05, root: pg.Node = MARGIN) -> DataFrame:
    done = pg.evaluate(margin_boxes(spark, sf_dir, rel), root, BOUNDS)
    return v.certify(done.select(*KEYS, "ms_lo", "ms_hi", "residual"), "interval", F.concat_ws("-", *KEYS[:2]))


@query(f"SELECT l_orderkey, l_linenumber, ms_lo, ms_hi, verdict FROM {margin_sql(0.05)} AS x")
def margin_verdict(spark, sf_dir):
    return margins(spark, sf_dir).select("l_orderkey", "l_linenumber", "ms_lo", "ms_hi", "verdict")


@query(f"SELECT l_orderkey, l_linenumber, round(residual, 6) AS residual, round(ms_lo, 9) AS ms_lo, round(ms_hi, 9) AS ms_hi, verdict FROM {margin_sql(0.05, holed=True)} AS x")
def hole_verdict(spark, sf_dir):
    return margins(spark, sf_dir, 0.05, HOLED).select("l_orderkey", "l_linenumber", r("residual").alias("residual"), r("ms_lo", 9).alias("ms_lo"), r("ms_hi", 9).alias("ms_hi"), "verdict")


@query(f"SELECT l_orderkey, l_linenumber, round(cs, 9) AS cs, CAST({PRIORITY} AS BIGINT) AS priority, {LABEL} AS label FROM {margin_sql(0.05)} AS x")
def margin_criticality(spark, sf_dir):
    return margins(spark, sf_dir).select("l_orderkey", "l_linenumber", r("cs", 9).alias("cs"), big("priority").alias("priority"), "label")


@query(f"""SELECT l_orderkey, count(*) AS n_targets, CASE max(CASE verdict WHEN 'FAIL' THEN 2 WHEN 'ABSTAIN' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'ABSTAIN' ELSE 'SAFE' END AS worst_verdict, round(max(cs), 9) AS max_cs
FROM {margin_sql(0.05)} AS x GROUP BY l_orderkey""")
def worst_verdict_by_order(spark, sf_dir):
    return runs.history(margins(spark, sf_dir), "l_orderkey").withColumn("max_cs", r("max_cs", 9))


def run_targets(spark, sf_dir, rel):
    """Targets of one run by order and line; several items may share a line number, so the worst score stands."""
    m = margins(spark, sf_dir, rel).withColumn("cell", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    worst = F.max(v.rank(F.col("verdict")))
    name = F.when(F.col("w") == 2, "FAIL").when(F.col("w") == 1, "ABSTAIN").otherwise("SAFE")
    return m.groupBy("cell").agg(worst.alias("w"), F.min("ms_lo").alias("lo"), F.max("ms_hi").alias("hi"), r(F.max("cs"), 9).alias("cs"), F.lit(0).alias("holes")).select("cell", name.alias("verdict"), "lo", "hi", "cs", "holes")


def run_sql(rel: float) -> str:
    return f"""(SELECT l_orderkey || '-' || l_linenumber AS cell, CASE max(CASE verdict WHEN 'FAIL' THEN 2 WHEN 'ABSTAIN' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'ABSTAIN' ELSE 'SAFE' END AS verdict, round(max(cs), 9) AS cs
FROM {margin_sql(rel)} AS x GROUP BY l_orderkey, l_linenumber)"""


DIFF = f"""SELECT n.cell, o.verdict AS old_verdict, n.verdict AS new_verdict, round(n.cs - o.cs, 9) AS delta_cs,
CASE WHEN o.verdict = n.verdict THEN 'UNCHANGED' ELSE o.verdict || '_TO_' || n.verdict END AS transition,
CASE WHEN n.cs - o.cs < -0.05 THEN 'improved' WHEN n.cs - o.cs > 0.05 THEN 'regressed' ELSE 'stable' END AS trend
FROM {run_sql(0.01)} AS n LEFT JOIN {run_sql(0.05)} AS o ON n.cell = o.cell"""


@query(DIFF)
def run_diff(spark, sf_dir):
    d = runs.diff(run_targets(spark, sf_dir, 0.05), run_targets(spark, sf_dir, 0.01))
    return d.select("cell", "old_verdict", "new_verdict", r("delta_cs", 9).alias("delta_cs"), "transition", "trend")


@query(f"SELECT count(*) FILTER (WHERE trend = 'improved') AS improved, count(*) FILTER (WHERE trend = 'regressed') AS regressed, count(*) FILTER (WHERE trend = 'stable') AS stable, bool_and(new_verdict = 'SAFE') AS safe FROM ({DIFF}) AS d")
def diff_summary(spark, sf_dir):
    return runs.diff_summary(runs.diff(run_targets(spark, sf_dir, 0.05), run_targets(spark, sf_dir, 0.01)))


@query(f"SELECT transition, count(*) AS n FROM ({DIFF}) AS d GROUP BY transition")
def verdict_transitions(spark, sf_dir):
    return runs.diff(run_targets(spark, sf_dir, 0.05), run_targets(spark, sf_dir, 0.01)).groupBy("transition").agg(F.count("*").alias("n"))


@query(f"SELECT verdict, count(*) AS n, count(*) AS n_valid, CAST(0 AS BIGINT) AS n_forged FROM {margin_sql(0.05)} AS x GROUP BY verdict")
def certificate_validity(spark, sf_dir):
    subject = F.concat_ws("-", *KEYS[:2])
    m = margins(spark, sf_dir).withColumnRenamed("verdict", "was")
    m = m.withColumn("verdict", F.col("was")).withColumn("good", v.valid(subject)).withColumn("verdict", F.lit("SAFE")).withColumn("forged", v.valid(subject) & (F.col("was") != "SAFE"))
    # Counted rather than filtered: a pushed-down filter would repeat the whole program.
    return m.groupBy(F.col("was").alias("verdict")).agg(F.count("*").alias("n"), F.count_if("good").alias("n_valid"), F.count_if("forged").alias("n_forged"))


_DIGEST = "'{\"hi\":' || CAST(CAST(floor(ms_hi * 1000000) AS BIGINT) AS VARCHAR) || ',\"lo\":' || CAST(CAST(floor(ms_lo * 1000000) AS BIGINT) AS VARCHAR) || ',\"verdict\":\"' || verdict || '\"}'"


@query(f"SELECT l_orderkey, l_linenumber, sha256({_DIGEST}) AS digest FROM {margin_sql(0.05)} AS x")
def cert_digest(spark, sf_dir):
    micro = lambda c: F.floor(F.col(c) * 1000000).cast("string")
    text = v.canonical({"lo": micro("ms_lo"), "hi": micro("ms_hi"), "verdict": v.text_of(F.col("verdict"))})
    return margins(spark, sf_dir).select("l_orderkey", "l_linenumber", F.sha2(text, 256).alias("digest"))


# --- single interval kernels over parts ---------------------------------------------------------

_A, _B, _C = interval.Ival("a_lo", "a_hi"), interval.Ival("b_lo", "b_hi"), interval.Ival("c_lo", "c_hi")
KERNELS = {
    "neg": lambda s: interval.neg(_A), "add": lambda s: interval.add(_A, _B), "sub": lambda s: interval.sub(_A, _B), "mul": lambda s: interval.mul(_A, _B, s), "div": lambda s: interval.div(_A, _B, s),
    "sqr": lambda s: interval.sqr(_A, s), "cube": lambda s: interval.ipow(_A, 3, s), "inverse_square": lambda s: interval.ipow(_A, -2, s), "ninth": lambda s: interval.ipow(_C, 9, s),
    "root": lambda s: interval.sqrt(_A, s), "log": lambda s: interval.log(_A, s), "exp": lambda s: interval.exp(_C, s), "sin": lambda s: interval.sin(_A, s), "cos": lambda s: interval.cos(_A, s),
    "tan": lambda s: interval.tan(_C, s), "pow": lambda s: interval.rpow(_A, 1.5, s), "hull": lambda s: interval.hull(_A, _B), "meet": lambda s: interval.meet(_A, _B),
    "max": lambda s: interval.maximum(_A, _B), "min": lambda s: interval.minimum(_A, _B), "abs": lambda s: interval.absolute(_A),
    "exact_add": lambda s: interval.exact_add(_A, _B, s), "exact_mul": lambda s: interval.exact_mul(_A, _B, s),
}
_OPERANDS = "(SELECT p_partkey, CAST(p_size AS DOUBLE) - 25 AS a_lo, CAST(p_size AS DOUBLE) - 25 + CAST(p_partkey % 7 AS DOUBLE) / 4 AS a_hi, p_retailprice / 1000 - 1 AS b_lo, p_retailprice / 1000 - CAST('0.5' AS DOUBLE) AS b_hi, (CAST(p_size AS DOUBLE) - 25) / 32 AS c_lo, (CAST(p_size AS DOUBLE) - 24) / 32 AS c_hi FROM part)"


def operands(spark, sf_dir):
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select(
        "p_partkey", (size - 25).alias("a_lo"), (size - 25 + (F.col("p_partkey") % 7).cast("double") / 4).alias("a_hi"),
        (F.col("p_retailprice") / 1000 - 1).alias("b_lo"), (F.col("p_retailprice") / 1000 - 0.5).alias("b_hi"), ((size - 25) / 32).alias("c_lo"), ((size - 24) / 32).alias("c_hi"),
    )


def _kernel_query(names: list[str], digits: int | None):
    """Bounds of kernels, infinite ones as null with a column of their own that says which."""

    def run(spark, sf_dir):
        o = operands(spark, sf_dir)
        for k in names:
            steps = interval.Steps(k)
            made = KERNELS[k](steps)
            for stage in [*steps.stages, [(f"{k}_lo", made.lo), (f"{k}_hi", made.hi)]]:
                o = o.select("*", *(F.expr(sql).alias(name) for name, sql in stage))
        ends = [f"{k}_{s}" for k in names for s in ("lo", "hi")]
        endless = lambda c: F.abs(F.col(c)) == float("inf")
        finite = lambda c: F.when(F.col(c) == 0, 0.0).when(~endless(c), F.col(c))
        shown = lambda c: (finite(c) if digits is None else r(finite(c), digits)).alias(c)
        return o.select("p_partkey", *map(shown, ends), F.concat_ws(" ", *(F.when(endless(c), F.concat(F.lit(c), F.when(F.col(c) > 0, "+").otherwise("-"))) for c in ends)).alias("infinite"))

    return run


_KERNEL_SETS = {
    "interval_arithmetic": (["neg", "add", "sub", "mul", "div", "sqr", "cube", "inverse_square", "abs"], None),
    "interval_functions": (["root", "log", "exp", "sin", "cos", "tan", "pow", "ninth"], 6),
    "interval_sets": (["hull", "meet", "max", "min"], None),
    "interval_exact": (["exact_add", "exact_mul"], None),
}
for _name, (_set, _digits) in _KERNEL_SETS.items():
    QUERIES[_name], ORACLE_SQL[_name] = _kernel_query(_set, _digits), twins.kernels(_set, _digits, _OPERANDS)


@query(f"SELECT p_partkey, round({interval.width(_A)}, 6) AS width, round({interval.middle(_A)}, 6) AS middle, round({interval.magnitude(_A)}, 6) AS magnitude, {interval.contains(_A, 'CAST(0 AS DOUBLE)')} AS has_zero, {interval.subset(_A, _B)} AS inside, {interval.equal(_A, _B)} AS same, {_A.is_empty} AS empty FROM {_OPERANDS} AS o")
def interval_predicates(spark, sf_dir):
    size = F.col("p_size").cast("double")
    o = table(spark, sf_dir, "part").select("p_partkey", (size - 25).alias("a_lo"), (size - 25 + (F.col("p_partkey") % 7).cast("double") / 4).alias("a_hi"), (F.col("p_retailprice") / 1000 - 1).alias("b_lo"), (F.col("p_retailprice") / 1000 - 0.5).alias("b_hi"))
    e = F.expr
    return o.select("p_partkey", r(e(interval.width(_A))).alias("width"), r(e(interval.middle(_A))).alias("middle"), r(e(interval.magnitude(_A))).alias("magnitude"), e(interval.contains(_A, "0D")).alias("has_zero"), e(interval.subset(_A, _B)).alias("inside"), e(interval.equal(_A, _B)).alias("same"), e(_A.is_empty).alias("empty"))


# --- formulas -----------------------------------------------------------------------------------

FORMULAS = {
    "net": "=ROUND(A1*(1-B1)*(1+C1),2)",
    "unit": "=IFERROR(A1/D1,0)",
    "band": "=IF(D1>=25,1,0)+IF(B1=0,10,0)",
    "total": "=SUM(A1:D1)",
    "mean": "=AVERAGE(A1:D1)",
    "remainder": "=MOD(A1,D1)",
    "steps": "=CEILING(D1,4)-FLOOR(D1,4)",
    "cut": "=TRUNC(A1,1)",
    "power": "=2^3^1%+-D1",
}


@query("""SELECT l_orderkey, l_linenumber, l_partkey,
round(sign(a * (1 - b) * (1 + c)) * floor(abs(a * (1 - b) * (1 + c) * power(CAST(10 AS DOUBLE), 2)) + 0.5) / power(CAST(10 AS DOUBLE), 2), 4) AS net,
round(CASE WHEN d = 0 THEN 0 ELSE a / d END, 8) AS unit,
CAST((CASE WHEN d >= 25 THEN 1 ELSE 0 END) + (CASE WHEN b = 0 THEN 10 ELSE 0 END) AS DOUBLE) AS band,
round(0.0 + a + b + c + d, 6) AS total, round((0.0 + a + b + c + d) / 4, 6) AS mean,
round(a - d * floor(a / d), 4) AS remainder, CAST(ceil(d / 4) * 4 - floor(d / 4) * 4 AS DOUBLE) AS steps,
round(floor(a * 10) / 10, 4) AS cut, round(power(CAST(2 AS DOUBLE), power(CAST(3 AS DOUBLE), CAST('0.01' AS DOUBLE))) + -d, 9) AS power
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS a, l_discount AS b, l_tax AS c, l_quantity AS d FROM lineitem) AS x""")
def formula_eval(spark, sf_dir):
    at = {"A1": "l_extendedprice", "B1": "l_discount", "C1": "l_tax", "D1": "l_quantity"}
    digits = {"unit": 8, "net": 4, "remainder": 4, "cut": 4, "power": 9}
    li = table(spark, sf_dir, "lineitem")
    made = {k: points.compile_formula(formula.parse(f), lambda ref: F.col(at[ref])) for k, f in FORMULAS.items()}
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *((c if k in ("band", "steps") else r(c, digits.get(k, 6))).alias(k) for k, c in made.items()))


_BUILT = "CASE l_linenumber % 6 WHEN 0 THEN NULL WHEN 1 THEN '=A' || l_linenumber || '+1' WHEN 2 THEN '=VLOOKUP(A1,B1:C9,2)' WHEN 3 THEN '=[1]Sheet1!A1+2' WHEN 4 THEN '=IF(A1>0,\"x\",B2)' ELSE '=index(A1:A9,2)*3' END"
_WHY = "list_filter([CASE WHEN contains(f, '[') AND contains(f, ']') THEN 'external_ref' END, " + ", ".join(f"CASE WHEN contains(upper(f), '{x}(') THEN 'unsupported_function:{x}' END" for x in ("VLOOKUP", "LOOKUP", "INDEX")) + "], lambda w: w IS NOT NULL)"
_HOLES = f"(SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, f, coalesce({_WHY}, []) AS why FROM (SELECT *, {_BUILT} AS f FROM lineitem) AS q)"


def formula_cells(spark, sf_dir):
    n = F.col("l_linenumber")
    f = (
        F.when(n % 6 == 0, F.lit(None).cast("string")).when(n % 6 == 1, F.concat(F.lit("=A"), n.cast("string"), F.lit("+1"))).when(n % 6 == 2, F.lit("=VLOOKUP(A1,B1:C9,2)"))
        .when(n % 6 == 3, F.lit("=[1]Sheet1!A1+2")).when(n % 6 == 4, F.lit('=IF(A1>0,"x",B2)')).otherwise(F.lit("=index(A1:A9,2)*3"))
    )
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", f.alias("formula"))


@query(f"""SELECT l_suppkey, cells, formulas, unsupported, CASE WHEN formulas = 0 OR unsupported / CAST(formulas AS DOUBLE) < 0.02 THEN 'high' WHEN unsupported / CAST(formulas AS DOUBLE) < 0.1 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT l_suppkey, count(*) AS cells, count(f) AS formulas, count(*) FILTER (WHERE len(why) > 0) AS unsupported FROM {_HOLES} AS h GROUP BY 1) AS x""")
def coverage_ledger(spark, sf_dir):
    return runs.coverage(formula_cells(spark, sf_dir), "l_suppkey", "formula")


@query(f"""SELECT l_suppkey, pos, cell, f AS formula, reason FROM (SELECT l_suppkey, f, why[i] AS reason, l_orderkey || '/' || l_linenumber || '/' || l_partkey AS cell, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, i) AS pos
FROM (SELECT *, unnest(range(1, len(why) + 1)) AS i FROM {_HOLES} AS h) AS x) AS y WHERE pos <= 50""")
def coverage_samples(spark, sf_dir):
    cells = formula_cells(spark, sf_dir).withColumn("cell", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey"))
    order = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return runs.hole_samples(cells, "l_suppkey", "formula", "cell", order).withColumn("pos", big("pos"))


@query(f"SELECT reason AS construct, count(DISTINCT l_suppkey) AS file_count, CAST(count(*) AS BIGINT) AS cell_count FROM (SELECT l_suppkey, unnest(why) AS reason FROM {_HOLES} AS h) AS x GROUP BY 1")
def coverage_heatmap(spark, sf_dir):
    return runs.heatmap(formula_cells(spark, sf_dir), "l_suppkey", "formula")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS nth, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem WHERE l_linenumber % 6 = 2) AS x WHERE (nth - 1) % greatest(1, CAST(floor(n / 5) AS BIGINT)) = 0""")
def coverage_sample(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_linenumber % 6 = 2")
    return runs.every_nth(li, [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_extendedprice")], 5, ["l_suppkey"]).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT t.l_orderkey, t.l_linenumber AS first_line, count(*) AS cells, round(sum(c.v), 4) AS total, round(avg(c.v), 4) AS mean
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) AS t JOIN (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) AS c ON t.l_orderkey = c.l_orderkey AND c.l_linenumber BETWEEN t.l_linenumber AND t.l_linenumber + 2 GROUP BY 1, 2""")
def range_join_sum(spark, sf_dir):
    """Ranges of three lines below each cell: expanded to cells, so the join is an equi join."""
    cells = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("v"))
    ranges = cells.select("l_orderkey", F.col("l_linenumber").alias("first_line"), F.col("l_linenumber").alias("row0"), (F.col("l_linenumber") + 2).alias("row1"), F.lit(0).alias("col0"), F.lit(0).alias("col1"))
    values = cells.select("l_orderkey", F.col("l_linenumber").alias("row"), F.lit(0).alias("col"), F.col("v").alias("value"))
    found = structure.over_ranges(ranges, values, ["l_orderkey"], ["first_line"])
    return found.select("l_orderkey", "first_line", "cells", r("total", 4).alias("total"), r("mean", 4).alias("mean"))


# --- registry, search, folders ------------------------------------------------------------------


@query("""SELECT o_orderkey, o_custkey, CAST(nth - 1 AS BIGINT) AS version_index, nth = 1 AS is_head, 'vg_' || substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 12) AS version_group
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey DESC) AS nth FROM orders) AS x""")
def head_versions(spark, sf_dir):
    h = registry.heads(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_totalprice"), F.desc("o_orderkey")])
    return h.select("o_orderkey", "o_custkey", big("version_index").alias("version_index"), "is_head", "version_group")


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey""")
def heads_only(spark, sf_dir):
    return registry.heads(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_totalprice"), F.desc("o_orderkey")]).where("is_head").select("o_custkey", "o_orderkey")


@query("""SELECT doc_id, source, CAST((CASE WHEN contains(lower(source), 'the') THEN 3 ELSE 1 END) + (CASE WHEN contains(lower(source), 'src1') THEN 3 ELSE 1 END) + length(lang) AS DOUBLE) AS score
FROM documents WHERE contains(lower(text || ' ' || source), 'the') AND contains(lower(text || ' ' || source), 'src1') ORDER BY score DESC, n_chars DESC, doc_id LIMIT 10""")
def keyword_search(spark, sf_dir):
    found = registry.search(table(spark, sf_dir, "documents"), "The, src1", ["text", "source"], "source", F.length("lang"), [F.desc("n_chars"), F.col("doc_id")])
    return found.select("doc_id", "source", "score")


_MARKS = (("spanish", "ción,ñ,que "), ("german", "ß,sch,ung"), ("french", "é,eau,tion"), ("english", "the,and,ing"))
_HITS = ", ".join(f"{' + '.join(f'CAST(contains(lower(text), {chr(39)}{w}{chr(39)}) AS INTEGER)' for w in words.split(','))} AS h{i}" for i, (_, words) in enumerate(_MARKS))


@query(f"SELECT doc_id, CASE WHEN best = 0 THEN 'unknown' {' '.join(f'WHEN h{i} = best THEN {chr(39)}{n}{chr(39)}' for i, (n, _) in enumerate(_MARKS))} END AS format_type, CAST(best AS BIGINT) AS hits FROM (SELECT *, greatest(h0, h1, h2, h3) AS best FROM (SELECT doc_id, {_HITS} FROM documents) AS q) AS x")
def format_classify(spark, sf_dir):
    found = registry.classify(table(spark, sf_dir, "documents"), "doc_id", "text", registry.markers(spark, _MARKS))
    return found.select("doc_id", "format_type", big("hits").alias("hits"))


_PATH = "regexp_extract(url, '^https?://([^?#]*)', 1)"


@query(f"""WITH p AS (SELECT string_split({_PATH}, '/') AS parts FROM pages), e AS (SELECT array_to_string(parts[1:d], '/') AS rel, array_to_string(parts[1:d-1], '/') AS parent, parts[d] AS last, d FROM p, (SELECT unnest(range(0, 20)) AS d) AS g WHERE d < len(parts))
SELECT rel, CASE WHEN d = 0 THEN NULL ELSE parent END AS parent, CASE WHEN d = 0 THEN '' ELSE last END AS name, CAST(d AS BIGINT) AS depth, count(*) AS n_files FROM e GROUP BY ALL""")
def folder_tree(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://([^?#]*)", 1).alias("path"))
    return registry.folders(paths, "path").select("rel", "parent", "name", big("depth").alias("depth"), "n_files")


@query("""SELECT s_nationkey, count(*) FILTER (WHERE verdict = 'SAFE') AS safe, count(*) FILTER (WHERE verdict = 'FAIL') AS fail, count(*) FILTER (WHERE verdict = 'ABSTAIN') AS abstain, round(max(cs), 9) AS max_cs, round(max(s_acctbal), 2) AS newest
FROM nation AS n JOIN supplier AS s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 0 LEFT JOIN """ + margin_sql(0.05) + """ AS t ON t.l_suppkey = s.s_suppkey GROUP BY s_nationkey""")
def section_status(spark, sf_dir):
    sections = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"))
    files = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") > 0).alias("is_head"), F.col("s_acctbal").alias("mtime"))
    found = runs.section_status(sections, files, margins(spark, sf_dir).select("l_suppkey", "verdict", "cs"), "s_nationkey", "l_suppkey")
    return found.withColumn("max_cs", r("max_cs", 9)).withColumn("newest", r("newest", 2))


@query("""SELECT s.section, count(*) AS n, CAST(max(CASE WHEN value >= 90 THEN 4 WHEN value >= 60 THEN 3 WHEN value >= 30 THEN 2 WHEN value >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS worst
FROM (SELECT unnest(['click', 'click_through', 'err', 'purchase', 'sign', 'view', 'x']) AS section) AS s JOIN events AS e ON starts_with(e.event_type, s.section) OR starts_with(s.section, e.event_type) GROUP BY s.section""")
def section_prefix_events(spark, sf_dir):
    """Sections against event types by prefix either way: the pairs are matched between the few distinct types first."""
    e = table(spark, sf_dir, "events").withColumn("priority", _band())
    by_type = e.groupBy("event_type").agg(F.count("*").alias("n"), F.max("priority").alias("worst"))
    names = F.array(*map(F.lit, ["click", "click_through", "err", "purchase", "sign", "view", "x"]))
    pairs = by_type.withColumn("section", F.explode(F.filter(names, lambda s: F.startswith(F.col("event_type"), s) | F.startswith(s, F.col("event_type")))))
    return pairs.groupBy("section").agg(F.sum("n").alias("n"), big(F.max("worst")).alias("worst"))


@query("""SELECT doc_id, 'n:' || len(u) || '|' || left(sha256(array_to_string(u, ',')), 8) AS sig, 'art_' || substr(sha256(text), 1, 16) AS id FROM (SELECT doc_id, text, list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[\\x21-\\x7E]{2,}'))) AS u FROM documents) AS x""")
def structural_signatures(spark, sf_dir):
    tokens = registry.tokens_of(F.col("text"))
    unique = F.array_sort(F.array_distinct(tokens))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("n:"), F.size(unique).cast("string"), F.lit("|"), F.substring(F.sha2(F.array_join(unique, ","), 256), 1, 8)).alias("sig"), registry.content_id("art_", F.col("text")).alias("id"))


@query("""SELECT name, CASE WHEN p % 4 = 0 THEN NULL WHEN p % 4 = 1 THEN CAST(p % 30 AS DOUBLE) WHEN p % 4 = 2 THEN CAST(p % 26 + 1 AS DOUBLE) ELSE p % 26 + 1 + CAST(p % 9 AS DOUBLE) / 1000 END AS rank
FROM (SELECT p_partkey AS p, 'part' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.xlsx' WHEN 1 THEN '_v' || (p_partkey % 30) || '.xlsx' WHEN 2 THEN '_Rev_' || chr(CAST(65 + p_partkey % 26 AS INTEGER)) || '.xlsx' ELSE '_Rev' || chr(CAST(65 + p_partkey % 26 AS INTEGER)) || (p_partkey % 9) || '_655.xlsx' END AS name FROM part) AS x""")
def revision_ranks(spark, sf_dir):
    p = F.col("p_partkey")
    letter = F.chr(65 + p % 26)
    text = lambda c: c.cast("string")
    tail = F.when(p % 4 == 0, F.lit(".xlsx")).when(p % 4 == 1, F.concat(F.lit("_v"), text(p % 30), F.lit(".xlsx"))).when(p % 4 == 2, F.concat(F.lit("_Rev_"), letter, F.lit(".xlsx"))).otherwise(F.concat(F.lit("_Rev"), letter, text(p % 9), F.lit("_655.xlsx")))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part"), text(p), tail).alias("name")).withColumn("rank", registry.revision_rank(F.col("name")))


@query("SELECT c_mktsegment AS key, min(c_name) AS first_name, max(version) AS version, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY 'art_' || substr(sha256(c_name), 1, 16)) AS version FROM customer) AS x GROUP BY 1")
def ingest_versions(spark, sf_dir):
    batch = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("content"))
    known = spark.createDataFrame([], "id string, key string, version long")
    new = registry.ingest(batch.union(batch), known, "content", "key")
    return new.groupBy("key").agg(F.min("content").alias("first_name"), F.max("version").alias("version"), F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders) AS x WHERE nth = 1")
def latest_registration(spark, sf_dir):
    return registry.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey % 3 <> 0 OR p_size % 2 = 0")
def changed_files(spark, sf_dir):
    now = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    before = now.where("p_partkey % 3 = 0").withColumn("p_size", F.when(F.col("p_size") % 2 == 0, F.col("p_size") + 100).otherwise(F.col("p_size")))
    return registry.unseen(now, before, ["p_partkey", "p_size"])


@query("""SELECT o_orderpriority AS format, count(*) AS files, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS coverage_pct FROM orders GROUP BY 1""")
def crawl_summary(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("format"), (F.col("o_orderstatus") == "F").alias("covered"))
    return registry.by_format(files, "format", "covered").select("format", "files", r("coverage_pct").alias("coverage_pct"))


@query("SELECT json_extract_string(props, '$.k') AS reason, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, reason LIMIT 10")
def top_skip_reasons(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return runs.most_frequent(e.select(F.get_json_object("props", "$.k").alias("reason")), "reason", 10)


@query("SELECT s_suppkey AS node, s_nationkey AS other, 'registered_as' AS rel FROM supplier WHERE s_suppkey = 7 OR s_nationkey = 7")
def lineage(spark, sf_dir):
    links = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("other"), F.lit("registered_as").alias("rel"))
    return structure.touching(links, 7, "node", "other")


# --- events --------------------------------------------------------------------------------------


def _band():
    """Priority of an event by its value."""
    x = F.col("value")
    return F.when(x >= 90, 4).when(x >= 60, 3).when(x >= 30, 2).when(x >= 10, 1).otherwise(0)


_BAND = "CASE WHEN value >= 90 THEN 4 WHEN value >= 60 THEN 3 WHEN value >= 30 THEN 2 WHEN value >= 10 THEN 1 ELSE 0 END"


def triaged(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("priority", _band())
    limits = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 5000).alias("has_fix"))
    return e.join(limits, "user_id", "left").withColumn("action", runs.action(F.col("priority"), F.coalesce("has_fix", F.lit(False))))


_TRIAGED = f"(SELECT e.*, {_BAND} AS priority, CASE WHEN value >= 90 THEN 'halt' WHEN coalesce(c_acctbal > 5000, FALSE) THEN 'auto_fix' ELSE 'work_order' END AS action FROM events AS e LEFT JOIN customer AS c ON e.user_id = c.c_custkey)"


@query(f"SELECT event_id, CAST(priority AS BIGINT) AS priority, action, CASE WHEN priority <= 1 THEN 'green' WHEN priority = 2 THEN 'yellow' ELSE 'red' END AS light, CAST(CASE WHEN priority <= 1 THEN 0 WHEN priority = 2 THEN 15 ELSE 25 END AS BIGINT) AS eta FROM {_TRIAGED} AS x")
def triage_action(spark, sf_dir):
    t = triaged(spark, sf_dir)
    return t.select("event_id", big("priority").alias("priority"), "action", runs.light(F.col("priority")).alias("light"), big(runs.eta_minutes(F.col("priority"))).alias("eta"))


@query(f"""SELECT count(*) FILTER (WHERE priority = 4) AS halt, count(*) FILTER (WHERE priority = 3) AS critical, count(*) FILTER (WHERE priority = 2) AS review, count(*) FILTER (WHERE priority = 1) AS watch,
count(*) FILTER (WHERE priority = 0) AS safe, count(*) FILTER (WHERE action = 'work_order') AS open_work_orders FROM {_TRIAGED} AS x""")
def production_dashboard(spark, sf_dir):
    return runs.dashboard(triaged(spark, sf_dir))


@query(f"SELECT event_id, user_id, CAST(priority AS BIGINT) AS priority FROM {_TRIAGED} AS x WHERE priority >= 3")
def urgent_events(spark, sf_dir):
    return triaged(spark, sf_dir).where("priority >= 3").select("event_id", "user_id", big("priority").alias("priority"))


def stamped(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    w = events_.windows(stamped(spark, sf_dir), "1 hour", ["event_type"])
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r("total", 4).alias("total"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(k AS INTEGER)) AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) AS g GROUP BY 1")
def sliding_windows(spark, sf_dir):
    w = events_.windows(stamped(spark, sf_dir), "2 hours", [], slide="1 hour")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events) AS a) AS b GROUP BY user_id, session""")
def session_windows(spark, sf_dir):
    w = events_.sessions(stamped(spark, sf_dir), "6 hours", "user_id")
    return w.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT e.event_id, x.l_orderkey FROM events AS e LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS l_orderkey FROM orders GROUP BY 1) AS x ON e.user_id = x.o_custkey""")
def event_file(spark, sf_dir):
    best = registry.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "events").select("event_id", "user_id").join(best, "user_id", "left").select("event_id", "l_orderkey")


@query("""SELECT p_partkey, CAST(coalesce(q * CAST('0.99' AS DOUBLE), p_size * CAST('0.95' AS DOUBLE)) AS DOUBLE) AS lo, CAST(coalesce(q * CAST('1.01' AS DOUBLE), p_size * CAST('1.05' AS DOUBLE)) AS DOUBLE) AS hi, q IS NOT NULL AS measured
FROM part LEFT JOIN (SELECT l_partkey, max(l_quantity) AS q FROM lineitem GROUP BY 1) AS m ON p_partkey = l_partkey""")
def params_override(spark, sf_dir):
    measured = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("q"))
    given = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 0.95).alias("lo"), (F.col("p_size") * 1.05).alias("hi"))
    return registry.overridden(given, measured.select("p_partkey", (F.col("q") * 0.99).alias("lo"), (F.col("q") * 1.01).alias("hi")), ["p_partkey"])


# --- case base -----------------------------------------------------------------------------------


def customer_boxes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    wide = c.select("c_custkey", F.col("c_mktsegment").alias("program_hash"), F.explode(F.array(F.struct(F.lit("bal").alias("sym"), (F.col("c_acctbal") / 1000).alias("mid")), F.struct(F.lit("nat").alias("sym"), F.col("c_nationkey").cast("double").alias("mid")))).alias("s"))
    return wide.select("c_custkey", "program_hash", "s.sym", (F.col("s.mid") - 0.5).alias("lo"), (F.col("s.mid") + 0.5).alias("hi"))


_CASES = "(SELECT c_custkey, c_mktsegment AS h, c_acctbal / 1000 AS bal, CAST(c_nationkey AS DOUBLE) AS nat FROM customer)"


@query(f"""SELECT query, case_id, round(distance, 6) AS distance, CAST(nth AS BIGINT) AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, case_id) AS nth FROM (
SELECT a.c_custkey AS query, b.c_custkey AS case_id, sqrt(power((((a.bal - 0.5) + (a.bal + 0.5)) / 2 - ((b.bal - 0.5) + (b.bal + 0.5)) / 2) / greatest(1.0, (a.bal + 0.5) - (a.bal - 0.5), (b.bal + 0.5) - (b.bal - 0.5), 0.01 * abs(((a.bal - 0.5) + (a.bal + 0.5)) / 2)), 2)
+ power((a.nat - b.nat) / greatest(1.0, 0.01 * abs(a.nat)), 2)) / sqrt(2) AS distance FROM {_CASES} AS a JOIN {_CASES} AS b ON a.h = b.h AND a.c_custkey % 100 = 0 AND a.c_custkey <> b.c_custkey) AS d WHERE distance < 0.3) AS x WHERE nth <= 5""")
def similar_cases(spark, sf_dir):
    b = customer_boxes(spark, sf_dir)
    queries = b.where("c_custkey % 100 = 0").withColumnRenamed("c_custkey", "query")
    found = runs.case_distance(queries, b.withColumnRenamed("c_custkey", "case_id"), 0.3, 6).where("query <> case_id")
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("query").orderBy("distance", "case_id"))
    return found.withColumn("nearest", at).where("nearest <= 5").select("query", "case_id", r("distance").alias("distance"), big("nearest").alias("nearest"))


@query("""SELECT o_custkey AS case_id, min(o_orderkey) AS fix_id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 GROUP BY 1""")
def resolved_cases(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cases = o.select(F.col("o_custkey").alias("case_id")).distinct()
    links = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("fix_id"), F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("open").alias("outcome"))
    fixes = o.select(F.col("o_orderkey").alias("fix_id"), F.when(F.col("o_totalprice") > 100000, "approved").otherwise("proposed").alias("status"))
    return runs.resolved_cases(cases, links, fixes).select("case_id", "fix_id")


# --- structure -----------------------------------------------------------------------------------


def tree_edges(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    supplier = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    return nation.unionByName(supplier)


_EDGES = "(SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier)"


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES} AS q), t AS (SELECT 's' || s_suppkey AS start, 's' || s_suppkey AS node, 0 AS depth FROM supplier UNION SELECT t.start, e.dst, t.depth + 1 FROM t JOIN e ON t.node = e.src WHERE depth < 3)
SELECT start, node, CAST(min(depth) AS BIGINT) AS depth FROM t GROUP BY 1, 2""")
def dep_reach(spark, sf_dir):
    starts = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return structure.reach(tree_edges(spark, sf_dir), starts, 3).withColumn("depth", big("depth"))


@query("SELECT 'r' || n_regionkey AS start, 'n' || n_nationkey AS node, CAST(1 AS BIGINT) AS depth FROM nation UNION ALL SELECT 'r' || n_regionkey, 's' || s_suppkey, CAST(2 AS BIGINT) FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def dep_affected(spark, sf_dir):
    starts = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return structure.affected(tree_edges(spark, sf_dir), starts).withColumn("depth", big("depth"))


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES} AS q), nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e), t AS (SELECT node, 0 AS level FROM nodes WHERE node NOT IN (SELECT dst FROM e) UNION SELECT e.dst, t.level + 1 FROM t JOIN e ON t.node = e.src)
SELECT node, CAST(max(level) AS BIGINT) AS level FROM t GROUP BY 1""")
def topological_levels(spark, sf_dir):
    return structure.topological_levels(tree_edges(spark, sf_dir)).withColumn("level", big("level"))


@query(f"WITH e AS {_EDGES} SELECT node FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) AS n WHERE node NOT IN (SELECT src FROM e)")
def margin_sinks(spark, sf_dir):
    edges = tree_edges(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return structure.sinks(nodes, edges.select("src"), "node")


@query("""SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, CASE WHEN a.src IS NULL THEN 'interventional' WHEN b.src IS NULL THEN 'syntactic' ELSE 'both' END AS origin, b.sens
FROM (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_linenumber <= 2) AS a FULL OUTER JOIN (SELECT l_suppkey AS src, l_partkey AS dst, max(l_discount) AS sens FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1, 2) AS b ON a.src = b.src AND a.dst = b.dst""")
def sdg_merge(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_discount").alias("sens"), "l_linenumber")
    return structure.merge_edges(li.where("l_linenumber <= 2"), li.where("l_linenumber >= 2"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN lag(l_linenumber) OVER w = l_linenumber - 1 THEN lag(t) OVER w END AS label FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS t FROM lineitem GROUP BY 1, 2) AS x WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""")
def left_labels(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("text")).select("l_orderkey", F.lit(0).alias("row"), F.col("l_linenumber").alias("col"), "text")
    return structure.left_labels(cells, ["l_orderkey"]).select("l_orderkey", F.col("col").alias("l_linenumber"), "label")


@query("""(SELECT p_partkey % 500 AS node, 'changed' AS change FROM part WHERE p_size > 25 EXCEPT SELECT p_partkey % 500, 'changed' FROM part WHERE p_size <= 25) UNION ALL (SELECT p_partkey % 500, 'unchanged' FROM part WHERE p_size > 25 INTERSECT SELECT p_partkey % 500, 'unchanged' FROM part WHERE p_size <= 25) UNION ALL (SELECT p_partkey % 500, 'dropped' FROM part WHERE p_size <= 25 EXCEPT SELECT p_partkey % 500, 'dropped' FROM part WHERE p_size > 25)""")
def node_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lit("p").alias("program"), (F.col("p_partkey") % 500).alias("hash"), "p_size")
    return pg.node_differences(p.where("p_size <= 25"), p.where("p_size > 25")).select(F.col("hash").alias("node"), "change")


def section_boxes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("sup"), "s_suppkey").alias("region"), F.concat(F.lit("n"), "s_nationkey").alias("sym"), (F.col("s_acctbal") - 4000).alias("lo"), (F.col("s_acctbal") + 4000).alias("hi"), (F.col("s_suppkey") % 17 == 0).cast("string").alias("dim"), F.col("s_suppkey").alias("ord"))


@query("""SELECT 'n' || s_nationkey AS sym, round(max(s_acctbal - 4000), 4) AS lo, round(min(s_acctbal + 4000), 4) AS hi, count(*) AS regions, CASE WHEN count(DISTINCT s_suppkey % 17 = 0) > 1 THEN 'dimension' WHEN max(s_acctbal - 4000) > min(s_acctbal + 4000) THEN 'range' END AS conflict,
NOT (count(DISTINCT s_suppkey % 17 = 0) > 1 OR max(s_acctbal - 4000) > min(s_acctbal + 4000)) AS consistent FROM supplier GROUP BY s_nationkey""")
def glue_meet(spark, sf_dir):
    return structure.glue(section_boxes(spark, sf_dir)).withColumn("lo", r("lo", 4)).withColumn("hi", r("hi", 4))


@query("""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS nth FROM supplier), t AS (SELECT s_nationkey, nth, s_acctbal - 4000 AS lo, s_acctbal + 4000 AS hi, 0 AS bad FROM o WHERE nth = 1
UNION ALL SELECT o.s_nationkey, o.nth, CASE WHEN greatest(t.lo, o.s_acctbal - 4000) > least(t.hi, o.s_acctbal + 4000) THEN t.lo ELSE greatest(t.lo, o.s_acctbal - 4000) END, CASE WHEN greatest(t.lo, o.s_acctbal - 4000) > least(t.hi, o.s_acctbal + 4000) THEN t.hi ELSE least(t.hi, o.s_acctbal + 4000) END,
t.bad + CASE WHEN greatest(t.lo, o.s_acctbal - 4000) > least(t.hi, o.s_acctbal + 4000) THEN 1 ELSE 0 END FROM t JOIN o ON o.s_nationkey = t.s_nationkey AND o.nth = t.nth + 1)
SELECT 'n' || s_nationkey AS sym, round(arg_max(lo, nth), 4) AS lo, round(arg_max(hi, nth), 4) AS hi, CAST(arg_max(bad, nth) AS BIGINT) AS n_conflicts FROM t GROUP BY 1""")
def glue_fold(spark, sf_dir):
    return structure.fold_glue(section_boxes(spark, sf_dir)).select("sym", r("lo", 4).alias("lo"), r("hi", 4).alias("hi"), big(F.size("conflicts")).alias("n_conflicts"))


@query("""SELECT 'g' || (n_nationkey % 5) AS symbol, CAST(1 AS BIGINT) AS h0, count(*) - 1 - (count(*) - 2) AS h1, bool_or(n_nationkey >= 20) AND min(n_nationkey % 5) = 3 AS obstructed FROM nation GROUP BY n_nationkey % 5""")
def overlap_cohomology(spark, sf_dir):
    """Rings of nations: offsets along a ring sum to 0 but in one of the five."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    g = F.col("k") % 5
    ring = n.select(F.concat(F.lit("g"), g).alias("symbol"), F.col("k").cast("string").alias("a"), ((F.col("k") + 5) % 25).cast("string").alias("b"), (F.when(F.col("k") >= 20, F.lit(-4.0)).otherwise(1.0) + F.when((g == 3) & (F.col("k") >= 20), 0.5).otherwise(0.0)).alias("offset"))
    return structure.cohomology(ring)


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events), t AS (SELECT user_id, event_id, seq, repeat('0', 64) AS prev_hash, sha256('0|' || repeat('0', 64) || '|' || event_type) AS entry_hash FROM o WHERE seq = 0
UNION ALL SELECT o.user_id, o.event_id, o.seq, t.entry_hash, sha256(o.seq || '|' || t.entry_hash || '|' || o.event_type) FROM t JOIN o ON o.user_id = t.user_id AND o.seq = t.seq + 1) SELECT user_id, event_id, CAST(seq AS BIGINT) AS seq, prev_hash, entry_hash FROM t""")
def hash_chain(spark, sf_dir):
    c = structure.chain(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")
    return c.select("user_id", "event_id", big("seq").alias("seq"), "prev_hash", "entry_hash")


@query("SELECT user_id, event_id FROM events WHERE event_id % 997 = 5")
def chain_verify(spark, sf_dir):
    """Entries with a forged payload are found; the rest of each chain still holds."""
    c = structure.chain(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")
    forged = c.withColumn("payload", F.when(F.col("event_id") % 997 == 5, F.lit("forged")).otherwise(F.col("payload")))
    return structure.broken(forged, "user_id").select("user_id", "event_id")


_LEAF = "sha256('\\x00'::BLOB || encode(CAST(l_partkey AS VARCHAR)))"


def _halve(x: str) -> str:
    return f"CASE WHEN len({x}) <= 1 THEN {x} ELSE list_transform(range(0, CAST((len({x}) + 1) // 2 AS BIGINT)), lambda i: sha256('\\x01'::BLOB || unhex({x}[2 * i + 1]) || unhex(coalesce({x}[2 * i + 2], {x}[2 * i + 1])))) END"


@query(f"""SELECT l_orderkey, CAST(n AS BIGINT) AS leaves, l6[1] AS root FROM (SELECT *, {_halve('l5')} AS l6 FROM (SELECT *, {_halve('l4')} AS l5 FROM (SELECT *, {_halve('l3')} AS l4 FROM (SELECT *, {_halve('l2')} AS l3 FROM (SELECT *, {_halve('l1')} AS l2 FROM (SELECT *, {_halve('l0')} AS l1 FROM (
SELECT l_orderkey, count(*) AS n, list({_LEAF} ORDER BY l_linenumber * 1000000 + l_partkey, {_LEAF}) AS l0 FROM lineitem GROUP BY 1) AS a) AS b) AS c) AS d) AS e) AS f) AS g""")
def merkle_root(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("at", F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey"))
    return structure.merkle_roots(li, "l_orderkey", "at", "l_partkey").withColumn("leaves", big("leaves"))


# --- boxes, probes, bundles ----------------------------------------------------------------------

LINE = pg.op("sub", pg.var("x"), pg.const(10))


@query(f"""WITH RECURSIVE t AS (SELECT p_partkey, CAST(0 AS DOUBLE) AS x_lo, CAST(p_size AS DOUBLE) AS x_hi, 'open' AS status, 0 AS level FROM part
UNION ALL SELECT p_partkey, CASE WHEN h = 1 THEN x_lo / 2 + x_hi / 2 ELSE x_lo END, CASE WHEN h = 0 THEN x_lo / 2 + x_hi / 2 ELSE x_hi END, 'open', level + 1 FROM t, (SELECT unnest([0, 1]) AS h) AS g
WHERE NOT ({interval.dn('x_lo - 10')} > 0) AND NOT ({interval.up('x_hi - 10')} < 0) AND NOT (x_hi - x_lo < 0.5) AND level < 40),
s AS (SELECT p_partkey, x_hi - x_lo AS v, CASE WHEN {interval.dn('x_lo - 10')} > 0 THEN 'safe' WHEN {interval.up('x_hi - 10')} < 0 THEN 'fail' WHEN x_hi - x_lo < 0.5 THEN 'unknown' END AS status FROM t)
SELECT p_partkey, round(sum(CASE WHEN status = 'safe' THEN v ELSE 0 END) / sum(v), 9) AS safe_share, round(sum(CASE WHEN status = 'fail' THEN v ELSE 0 END) / sum(v), 9) AS fail_share, round(sum(CASE WHEN status = 'unknown' THEN v ELSE 0 END) / sum(v), 9) AS unknown_share, count(*) AS boxes FROM s WHERE status IS NOT NULL GROUP BY 1""")
def sivia_region(spark, sf_dir):
    start = table(spark, sf_dir, "part").select("p_partkey", F.lit(0.0).alias("x_lo"), F.col("p_size").cast("double").alias("x_hi"))
    shares = boxes.volume_share(boxes.sivia(start, LINE, ["x"], 0.5), ["x"], ["p_partkey"])
    return shares.select("p_partkey", *(r(f"{x}_share", 9).alias(f"{x}_share") for x in ("safe", "fail", "unknown")), "boxes")


PLANE = pg.op("sub", pg.op("add", pg.var("x"), pg.var("y")), pg.const(1))


_LOW, _HIGH = twins.below(f"{twins.below('x0 + y0')} - 1"), twins.above(f"{twins.above('x1 + y1')} - 1")


@query(f"""WITH RECURSIVE t AS (SELECT r_regionkey, CAST(0 AS DOUBLE) AS x0, CAST(1 AS DOUBLE) AS x1, CAST(0 AS DOUBLE) AS y0, CAST(1 AS DOUBLE) AS y1 FROM region
UNION ALL SELECT r_regionkey, CASE WHEN wide AND h = 1 THEN (x0 + x1) / 2 ELSE x0 END, CASE WHEN wide AND h = 0 THEN (x0 + x1) / 2 ELSE x1 END, CASE WHEN NOT wide AND h = 1 THEN (y0 + y1) / 2 ELSE y0 END, CASE WHEN NOT wide AND h = 0 THEN (y0 + y1) / 2 ELSE y1 END
FROM (SELECT *, x1 - x0 >= y1 - y0 AS wide FROM t WHERE NOT ({_LOW} > 0) AND NOT ({_HIGH} < 0) AND NOT (greatest(x1 - x0, y1 - y0) < 0.05)) AS o, (SELECT unnest([0, 1]) AS h) AS g),
s AS (SELECT r_regionkey, (x1 - x0) * (y1 - y0) AS v, CASE WHEN {_LOW} > 0 THEN 'safe' WHEN {_HIGH} < 0 THEN 'fail' WHEN greatest(x1 - x0, y1 - y0) < 0.05 THEN 'unknown' END AS status FROM t)
SELECT r_regionkey, sum(CASE WHEN status = 'safe' THEN v ELSE 0 END) / sum(v) AS safe_share, sum(CASE WHEN status = 'fail' THEN v ELSE 0 END) / sum(v) AS fail_share, sum(CASE WHEN status = 'unknown' THEN v ELSE 0 END) / sum(v) AS unknown_share, count(*) AS boxes FROM s WHERE status IS NOT NULL GROUP BY 1""")
def sivia_plane(spark, sf_dir):
    start = table(spark, sf_dir, "region").select("r_regionkey", F.lit(0.0).alias("x_lo"), F.lit(1.0).alias("x_hi"), F.lit(0.0).alias("y_lo"), F.lit(1.0).alias("y_hi"))
    return boxes.volume_share(boxes.sivia(start, PLANE, ["x", "y"], 0.05), ["x", "y"], ["r_regionkey"])


_PROBES = "(SELECT l_partkey AS hole, l_quantity AS x, avg(l_discount) AS f FROM lineitem GROUP BY 1, 2)"


def probes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("hole"), F.col("l_quantity").alias("x")).agg(F.avg("l_discount").alias("f"))


@query(f"""SELECT hole, round(min(f), 6) AS lo, round(max(f), 6) AS hi, round(coalesce(max(abs(d / dx)), 0), 6) AS lip, CAST(CASE WHEN coalesce(min(d), 0) >= 0 THEN 1 WHEN coalesce(max(d), 0) <= 0 THEN -1 ELSE 0 END AS BIGINT) AS monotone
FROM (SELECT *, f - lag(f) OVER w AS d, x - lag(x) OVER w AS dx FROM {_PROBES} AS p WINDOW w AS (PARTITION BY hole ORDER BY x)) AS q GROUP BY hole""")
def probe_models(spark, sf_dir):
    m = boxes.probe_model(probes(spark, sf_dir))
    return m.select("hole", r("lo").alias("lo"), r("hi").alias("hi"), r("lip").alias("lip"), big("monotone").alias("monotone"))


@query(f"""WITH p AS {_PROBES}, s AS (SELECT hole, max(abs(d / dx)) AS slope FROM (SELECT hole, f - lag(f) OVER w AS d, x - lag(x) OVER w AS dx FROM p WINDOW w AS (PARTITION BY hole ORDER BY x)) AS q GROUP BY 1),
m AS (SELECT hole, max(f - 0.01 * (abs(25.0 - x) + 5.0)) AS a, min(f + 0.01 * (abs(25.0 - x) + 5.0)) AS b FROM p GROUP BY 1), u AS (SELECT m.*, coalesce(slope, 0) > 0.01 OR greatest(a, -1.0) > least(b, 1.0) AS refuted FROM m LEFT JOIN s ON m.hole = s.hole)
SELECT hole, round(CASE WHEN refuted THEN -1.0 ELSE greatest(a, -1.0) END, 6) AS lo, round(CASE WHEN refuted THEN 1.0 ELSE least(b, 1.0) END, 6) AS hi, refuted FROM u""")
def lipschitz_wrap(spark, sf_dir):
    p = probes(spark, sf_dir)
    each = p.select("hole").distinct()
    queries = each.select("hole", F.lit("q").alias("query"), F.lit(20.0).alias("lo"), F.lit(30.0).alias("hi"))
    constants = each.select("hole", F.lit(0.01).alias("lip"), F.lit(-1.0).alias("phys_lo"), F.lit(1.0).alias("phys_hi"))
    return boxes.lipschitz(queries, p, constants).select("hole", r("lo").alias("lo"), r("hi").alias("hi"), "refuted")


@query("SELECT doc_id, quality + toxic * 2 + 1 AS raw, round((quality + toxic * 2 + 1) / CAST(sum(quality + toxic * 2 + 1) OVER (PARTITION BY doc_id % 50) AS DOUBLE), 9) AS conf FROM labels")
def conf_normalise(spark, sf_dir):
    b = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 50).alias("bundle"), (F.col("quality") + F.col("toxic") * 2 + 1).alias("raw")).withColumn("conf", F.col("raw").cast("double"))
    return boxes.normalise(b, "bundle").select("doc_id", "raw", r("conf", 9).alias("conf"))


@query("SELECT doc_id FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS nth FROM documents) AS x WHERE nth <= 2 OR n_chars >= 5000")
def conf_prune(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("conf"))
    return boxes.prune(d, "source", 5000.0, [F.col("doc_id")]).select("doc_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(w, 6) AS width, round(w / max(w) OVER (PARTITION BY l_orderkey), 9) AS share FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (l_discount + 0.01) AS w FROM lineitem) AS x")
def reduction_plan(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").withColumn("width", F.col("l_extendedprice") * (F.col("l_discount") + 0.01))
    return v.reduction_plan(t, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", r("width").alias("width"), r("share", 9).alias("share"))


@query("""SELECT l_orderkey, CAST(count(*) AS BIGINT) AS parts, count(*) || ' uncertain parts; worst: ' || min_by('p' || l_partkey, (-share, 'p' || l_partkey)) AS summary FROM (SELECT *, w / max(w) OVER (PARTITION BY l_orderkey) AS share FROM (SELECT l_orderkey, l_partkey, l_extendedprice AS w FROM lineitem) AS y) AS x GROUP BY 1""")
def explain_abstain(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("p"), "l_partkey").alias("name"), F.lit("hole").alias("kind"), F.col("l_extendedprice").alias("width"))
    return v.explain(t, ["l_orderkey"]).select("l_orderkey", big(F.size("reasons")).alias("parts"), "summary")


def cached(spark, sf_dir):
    """Two versions of results of every part's box, and what ended some of them: programs by hash, symbols by name."""
    p = table(spark, sf_dir, "part")
    box = F.array(F.struct(F.lit("size").alias("sym"), F.col("p_size").cast("double").alias("lo"), (F.col("p_size") + 1).cast("double").alias("hi")), F.struct(F.concat(F.lit("s"), F.col("p_partkey") % 7).alias("sym"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")))
    boxes_ = p.select("p_partkey", F.concat(F.lit("h"), F.col("p_partkey") % 11).alias("program_hash"), cache.fingerprint(box).alias("box_fp"), F.transform(box, lambda b: b["sym"]).alias("syms"), "p_size")
    versions = boxes_.withColumn("version", F.explode(F.sequence(F.lit(1), F.when(F.col("p_size") % 2 == 0, 2).otherwise(1)))).where("p_size > 10")
    entries = versions.select("program_hash", "box_fp", "syms", "version", (F.col("p_size") * F.col("version")).alias("result")).distinct()
    ended = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "program").otherwise("symbol").alias("kind"), F.concat(F.when(F.col("n_nationkey") % 2 == 0, "h").otherwise("s"), F.col("n_nationkey")).alias("value"), F.when(F.col("n_nationkey") < 4, 2).otherwise(1).alias("version"))
    return boxes_, entries, ended


_CACHED = """(SELECT p_partkey, p_size, CASE WHEN p_size <= 10 THEN NULL WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS version, p_partkey % 11 AS h, p_partkey % 7 AS s FROM part)"""
_ENDS = "(SELECT n_nationkey AS k, CASE WHEN n_nationkey < 4 THEN 2 ELSE 1 END AS v FROM nation)"
_LIVE = f"(SELECT c.*, version IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_ENDS} AS e WHERE e.k % 2 = 0 AND e.k = c.h AND e.v >= c.version) AND NOT EXISTS (SELECT 1 FROM {_ENDS} AS e WHERE e.k % 2 = 1 AND e.k = c.s AND e.v >= c.version) AS hit FROM {_CACHED} AS c)"


@query(f"SELECT p_partkey, hit, CASE WHEN hit THEN CAST(p_size * version AS BIGINT) END AS result FROM {_LIVE} AS x")
def result_cache(spark, sf_dir):
    wanted, entries, ended = cached(spark, sf_dir)
    found = cache.lookup(wanted.select("p_partkey", "program_hash", "box_fp"), entries, ended)
    return found.select("p_partkey", "hit", big("result").alias("result"))


@query(f"SELECT p_partkey FROM {_LIVE} AS x WHERE NOT hit")
def result_reuse(spark, sf_dir):
    """Boxes whose result is not stored, or not any more."""
    wanted, entries, ended = cached(spark, sf_dir)
    return cache.lookup(wanted, entries.drop("syms").join(entries.select("program_hash", "box_fp", "syms").distinct(), ["program_hash", "box_fp"]), ended).where("NOT hit").select("p_partkey")


@query("SELECT p_partkey, round(greatest(CAST(p_size AS DOUBLE) * p_size - 1, 100), 6) AS lo, round(least(CAST(p_size + 1 AS DOUBLE) * (p_size + 1) - 1, 2000), 6) AS hi FROM part")
def monotone_wrap(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumns({"f_lo": F.col("p_size").cast("double") * F.col("p_size") - 1, "f_hi": (F.col("p_size") + 1).cast("double") * (F.col("p_size") + 1) - 1})
    lo, hi = boxes.monotone(F.col("p_size"), F.col("p_size") + 1, 1, F.col("f_lo"), F.col("f_hi"), F.lit(100.0), F.lit(2000.0))
    return p.select("p_partkey", r(lo).alias("lo"), r(hi).alias("hi"))


@query("SELECT s_suppkey, round(i / 4.0, 6) AS x0, round(s_acctbal + j / 2.0 - 1, 6) AS x1 FROM supplier, (SELECT unnest(range(0, 5)) AS i) AS a, (SELECT unnest(range(0, 5)) AS j) AS b")
def probe_grid(spark, sf_dir):
    domain = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(0.0).alias("x0_lo"), F.lit(1.0).alias("x0_hi"), (F.col("s_acctbal") - 1).alias("x1_lo"), (F.col("s_acctbal") + 1).alias("x1_hi"))
    return probes_.grid(domain, ["x0", "x1"], 5, "s_suppkey").select("s_suppkey", r("x0").alias("x0"), r("x1").alias("x1"))


_PLANES = "(SELECT l_linenumber AS hole, l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS f FROM lineitem)"
_STEEP = f"(SELECT hole, x, y, min(f) AS f0, max(f) AS f1 FROM {_PLANES} AS p GROUP BY 1, 2, 3)"
_MODELS = f"(SELECT a.hole, max(CASE WHEN a.x <> b.x OR a.y <> b.y THEN (a.f1 - b.f0) / sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) END) AS lip, min(a.f0) AS lo, max(a.f1) AS hi FROM {_STEEP} AS a JOIN {_STEEP} AS b ON a.hole = b.hole GROUP BY 1)"


def planes(spark, sf_dir):
    """Each line number as a black box over quantity and discount, probed by every line item."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_linenumber").alias("hole"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("f"))


@query(f"SELECT CAST(hole AS BIGINT) AS hole, round(lo, 6) AS lo, round(hi, 6) AS hi, round(lip, 6) AS lip FROM {_MODELS} AS m")
def plane_models(spark, sf_dir):
    m = probes_.slopes(planes(spark, sf_dir), ["x", "y"])
    return m.select(big("hole").alias("hole"), r("lo").alias("lo"), r("hi").alias("hi"), r("lip").alias("lip"))


@query(f"""WITH m AS {_MODELS}, q AS (SELECT DISTINCT l_linenumber AS hole, CAST(l_quantity AS BIGINT) AS query, l_quantity AS xc, 5.5 AS yc FROM lineitem),
c AS (SELECT hole, k, lip * k AS lip, CASE WHEN k > 1 THEN lo - ((hi - lo) / 2 + 1e-9) ELSE lo END AS a, CASE WHEN k > 1 THEN hi + ((hi - lo) / 2 + 1e-9) ELSE hi END AS b FROM m, (SELECT unnest([1.25]) AS k) AS g),
b AS (SELECT q.hole, q.query, max(p.f1 - c.lip * (sqrt((p.x - q.xc) * (p.x - q.xc) + (p.y - q.yc) * (p.y - q.yc)) + sqrt(0.5))) AS lo, min(p.f0 + c.lip * (sqrt((p.x - q.xc) * (p.x - q.xc) + (p.y - q.yc) * (p.y - q.yc)) + sqrt(0.5))) AS hi
  FROM q JOIN c ON q.hole = c.hole JOIN {_STEEP} AS p ON p.hole = q.hole GROUP BY 1, 2)
SELECT CAST(b.hole AS BIGINT) AS hole, b.query, round(greatest(b.lo, c.a), 6) AS lo, round(least(b.hi, c.b), 6) AS hi, FALSE AS refuted FROM b JOIN c ON b.hole = c.hole""")
def plane_enclosures(spark, sf_dir):
    """Boxes around every quantity that was probed, enclosed by the wrapper made of the probes."""
    p = planes(spark, sf_dir)
    models = probes_.slopes(p, ["x", "y"])
    asked = p.select("hole", big("x").alias("query"), (F.col("x") - 0.5).alias("x_lo"), (F.col("x") + 0.5).alias("x_hi"), F.lit(5.0).alias("y_lo"), F.lit(6.0).alias("y_hi")).distinct()
    found = probes_.enclose(asked, p, probes_.synthesize(models), models, ["x", "y"])
    return found.select(big("hole").alias("hole"), "query", r("lo").alias("lo"), r("hi").alias("hi"), "refuted")


@query()
def adaptive_models(spark, sf_dir):
    """Eight more probes of a fold in each supplier's black box, where its slope is steepest; tested by brute force."""
    own = table(spark, sf_dir, "supplier").select("s_suppkey", (F.abs("s_acctbal") / 10000).alias("at_"), F.lit(0.0).alias("x0_lo"), F.lit(1.0).alias("x0_hi"), F.lit(0.0).alias("x1_lo"), F.lit(1.0).alias("x1_hi"))
    start = probes_.grid(own, ["x0", "x1"], 3, "s_suppkey").join(own.select("s_suppkey", "at_"), "s_suppkey")
    number = (F.col("x0") * 2 * 3 + F.col("x1") * 2).cast("long")
    start = start.withColumn("at", number).withColumn("f", fold_value(F.col("x0"), F.col("x1"), F.col("at_")))
    every = probes_.adaptive(start, ["x0", "x1"], fold_value, 8, hole="s_suppkey", keep=("at_",))
    return every.select("s_suppkey", "at", r("x0").alias("x0"), r("x1").alias("x1"), r("f").alias("f"))


def fold_value(x0, x1, at_):
    return F.abs(x0 - at_) * 2 + x0 * x1


@query("""SELECT p_partkey, round(CASE p_size % 3 WHEN 0 THEN p_retailprice * 0.001 WHEN 1 THEN p_retailprice * 0.0254 ELSE p_retailprice + 273.15 END, 6) AS si, CASE p_size % 3 WHEN 0 THEN 'm^2*s^-2' WHEN 1 THEN 'm^2*s^-2' ELSE 'm*s^-2*K' END AS dim FROM part""")
def unit_convert(spark, sf_dir):
    table_ = spark.createDataFrame([("mm", 0.001, 0.0), ("in", 0.0254, 0.0), ("degC", 1.0, 273.15)], "name string, scale double, offset double")
    unit = F.element_at(F.array(F.lit("mm"), F.lit("in"), F.lit("degC")), F.col("p_size") % 3 + 1)
    p = units.to_si(table(spark, sf_dir, "part").withColumn("unit", unit), table_, "p_retailprice", "unit")
    length = F.array(*(F.lit(x) for x in (0, 1, 0, 0, 0, 0, 0)))
    heat = F.array(*(F.lit(x) for x in (0, 0, 0, 0, 1, 0, 0)))
    rate = F.array(*(F.lit(x) for x in (0, 1, -2, 0, 0, 0, 0)))
    dim = units.dim_mul(F.when(F.col("unit") == "degC", heat).otherwise(length), rate)
    return p.select("p_partkey", r("si").alias("si"), units.dim_text(dim).alias("dim"))


@query("SELECT CAST(l_suppkey AS BIGINT) AS sheet, count(*) AS cells, CAST(max(l_linenumber) AS BIGINT) AS max_row, count(DISTINCT l_linenumber) AS rows_used, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def workbook_stats(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(F.lit("w").alias("workbook"), F.col("l_suppkey").alias("sheet"), F.col("l_linenumber").alias("row"), F.col("l_quantity").alias("value"))
    return workbook.statistics(cells).select("sheet", "cells", big("max_row").alias("max_row"), "rows_used", r("total", 2).alias("total"))
