"""Runs and their differences, dashboards, coverage, events and case base."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import formula as formula_
from ..ship import ship
from . import verdict as v


def diff(old: DataFrame, new: DataFrame, key: str = "cell", threshold: float = 0.05, full: bool = False) -> DataFrame:
    """Targets of two runs side by side; rows need key, verdict, lo, hi, cs and holes.

    As a rule targets that vanished are left out; ``full`` keeps them.
    """
    side = lambda df, p: df.select(F.col(key), *(F.col(c).alias(f"{p}_{c}") for c in ("verdict", "lo", "hi", "cs", "holes")))
    both = side(new, "new").join(side(old, "old"), key, "full" if full else "left")
    delta = F.col("new_cs") - F.col("old_cs")
    return both.select(
        key, "old_verdict", "new_verdict", "old_cs", "new_cs",
        delta.alias("delta_cs"),
        transition(F.col("old_verdict"), F.col("new_verdict")).alias("transition"),
        F.when(delta < -threshold, "improved").when(delta > threshold, "regressed").when(delta.isNull(), "new").otherwise("stable").alias("trend"),
        (F.col("new_holes") - F.col("old_holes")).alias("delta_holes"),
    )


def transition(old: Column, new: Column) -> Column:
    return F.when(old.isNull(), F.lit("NEW")).when(new.isNull(), F.lit("GONE")).when(old == new, F.lit("UNCHANGED")).otherwise(F.concat(old, F.lit("_TO_"), new))


def transition_name(old: Column, new: Column) -> Column:
    """A change of verdict by what matters about it: to or from FAIL whatever the other side, else both sides."""
    pair = F.concat(old, F.lit("->"), new)
    return F.when((new == "FAIL") & (old != "FAIL"), "->FAIL").when((old == "FAIL") & (new != "FAIL"), "FAIL->").when(pair.isin("SAFE->SAFE", "SAFE->ABSTAIN", "ABSTAIN->SAFE"), pair).otherwise("other")


def diff_summary(deltas: DataFrame) -> DataFrame:
    """One row: counts of trends, and whether no target is worse than SAFE."""
    return deltas.agg(
        F.count_if(F.col("trend") == "improved").alias("improved"),
        F.count_if(F.col("trend") == "regressed").alias("regressed"),
        F.count_if(F.col("trend") == "stable").alias("stable"),
        F.coalesce(F.every(F.col("new_verdict") == "SAFE"), F.lit(True)).alias("safe"),
    )


def history(targets: DataFrame, run: str) -> DataFrame:
    """(run, n_targets, worst verdict, max cs) of every run."""
    worst = F.max(v.rank(F.col("verdict")))
    named = F.when(F.col("_worst") == 2, "FAIL").when(F.col("_worst") == 1, "ABSTAIN").otherwise("SAFE")
    return targets.groupBy(run).agg(F.count("*").alias("n_targets"), worst.alias("_worst"), F.max("cs").alias("max_cs")).select(run, "n_targets", named.alias("worst_verdict"), "max_cs")


def dashboard(events: DataFrame) -> DataFrame:
    """One row: events by priority and open work orders."""
    p = F.col("priority")
    return events.agg(
        F.count_if(p == 4).alias("halt"), F.count_if(p == 3).alias("critical"), F.count_if(p == 2).alias("review"), F.count_if(p == 1).alias("watch"),
        F.count_if(~p.isin(1, 2, 3, 4) | p.isNull()).alias("safe"), F.count_if(F.col("action") == "work_order").alias("open_work_orders"),
    )


def light(priority: Column) -> Column:
    return F.when(priority <= 1, "green").when(priority == 2, "yellow").otherwise("red")


def eta_minutes(priority: Column) -> Column:
    return F.when(priority <= 1, 0).when(priority == 2, 15).otherwise(25)


def action(priority: Column, has_fix: Column, proceed: bool = False) -> Column:
    """What an event leads to; ``proceed`` lets safe events pass without a work order."""
    out = F.when(priority >= 4, "halt").when(has_fix, "auto_fix")
    return (out.when(priority == 0, "proceed") if proceed else out).otherwise("work_order")


# Functions that a formula evaluator must report as unsupported, in their order.
UNSUPPORTED = (
    "XLOOKUP", "VLOOKUP", "HLOOKUP", "LOOKUP", "INDEX", "MATCH", "XMATCH", "OFFSET", "INDIRECT", "LAMBDA",
    "LET", "FILTER", "UNIQUE", "SEQUENCE", "SORT", "SORTBY", "TEXTJOIN", "CHOOSE", "GETPIVOTDATA",
)
# Names of the reasons why a formula is a hole, of confidence and its limits, and of the flags.
EXTERNAL, FUNCTION, UNPARSED = "external_ref", "unsupported_function", "parse_error"
CONFIDENCE = ((0.02, "high"), (0.10, "medium"))
MANY_HOLES, HAS_EXTERNAL = "high_uncovered_ratio", "external_refs_present"
#: Samples of holes that a ledger shows.
SAMPLES = 50


@F.pandas_udf(T.BooleanType())
def parses(text: pd.Series) -> pd.Series:
    """Whether a formula can be read; null stays null. Equal texts of a batch are read once."""
    codes, different = pd.factorize(text)
    return pd.Series(np.array([*map(_parses, different), None], dtype=object)[codes])


@functools.lru_cache(maxsize=100_000)
def _parses(text: str) -> bool:
    try:
        formula_.parse(text)
    except (ValueError, IndexError, RecursionError):
        return False
    return True


def reasons(formula: Column, parsed: Column | None = None) -> Column:
    """All reasons why a formula is a hole, in order; a name also counts inside a longer one, as LOOKUP in VLOOKUP.

    ``parsed`` tells whether the formula can be read; where it is not given, that is not looked at.
    """
    upper = F.upper(formula)
    external = F.contains(formula, F.lit("[")) & F.contains(formula, F.lit("]"))
    found = [F.when(external, F.lit(EXTERNAL)), *(F.when(F.contains(upper, F.lit(f"{x}(")), F.lit(f"{FUNCTION}:{x}")) for x in UNSUPPORTED)]
    return F.array_compact(F.array(*found, *([] if parsed is None else [F.when(~parsed, F.lit(UNPARSED))])))


def _marked(cells: DataFrame, formula: str) -> DataFrame:
    ship(cells.sparkSession)
    ok = cells.withColumn("_ok", parses(F.col(formula)))
    return ok.withColumn("_why", F.coalesce(reasons(F.col(formula), F.col("_ok")), F.array().cast("array<string>"))).drop("_ok")


def confidence(share: Column) -> Column:
    out = F.lit("low")
    for limit, name in reversed(CONFIDENCE):
        out = F.when(share < limit, name).otherwise(out)
    return out


def ledger(cells: DataFrame, workbook: str, formula: str, value: str, text: str | None = None) -> DataFrame:
    """Coverage of each workbook: cells by class, holes, share, confidence and flags.

    A cell counts as formula, else as constant if it has a value; cells with a
    text alone count in the total, empty cells don't.
    """
    filled = F.col(formula).isNotNull() | F.col(value).isNotNull()
    counted = _marked(cells, formula).groupBy(workbook).agg(
        F.count_if(filled if text is None else filled | F.col(text).isNotNull()).alias("total_cells"),
        F.count(formula).alias("formula_cells"),
        F.count_if(F.col(formula).isNull() & F.col(value).isNotNull()).alias("constant_cells"),
        F.count_if(F.size("_why") > 0).alias("hole_cells"),
        F.count_if(F.array_contains("_why", EXTERNAL)).alias("_external"),
    )
    share = F.when(F.col("formula_cells") > 0, F.col("hole_cells") / F.col("formula_cells")).otherwise(0.0)
    flags = F.array_compact(F.array(F.when(share >= CONFIDENCE[-1][0], F.lit(MANY_HOLES)), F.when(F.col("_external") > 0, F.lit(HAS_EXTERNAL))))
    return counted.withColumn("confidence", confidence(share)).withColumn("flags", flags).drop("_external")


def hole_samples(cells: DataFrame, workbook: str, formula: str, cell: str, order: list[Column], most: int = SAMPLES) -> DataFrame:
    """(workbook, pos, cell, formula, reason): the first ``most`` reasons of each workbook's holes, in order of cells."""
    each = _marked(cells, formula).select("*", F.posexplode_outer("_why").alias("_i", "reason")).where(F.col("reason").isNotNull())
    pos = F.row_number().over(Window.partitionBy(workbook).orderBy(*order, "_i"))
    return each.withColumn("pos", pos).where(F.col("pos") <= most).select(workbook, "pos", F.col(cell).alias("cell"), F.col(formula).alias("formula"), "reason")


def hole_reasons(cells: DataFrame, workbook: str, formula: str) -> DataFrame:
    """(workbook, reason, n): histogram of the reasons of each workbook's holes."""
    # ``explode`` would have its rows filtered first, and the formulas read a second time for that.
    each = _marked(cells, formula).select(workbook, F.explode_outer("_why").alias("reason")).where(F.col("reason").isNotNull())
    return each.groupBy(workbook, "reason").agg(F.count("*").alias("n"))


def coverage(cells: DataFrame, workbook: str, formula: str) -> DataFrame:
    """The ledger's counts for cells that are there whatever they hold."""
    counted = _marked(cells, formula).groupBy(workbook).agg(F.count("*").alias("cells"), F.count(formula).alias("formulas"), F.count_if(F.size("_why") > 0).alias("unsupported"))
    share = F.when(F.col("formulas") > 0, F.col("unsupported") / F.col("formulas")).otherwise(0.0)
    return counted.withColumn("confidence", confidence(share))


def heatmap(cells: DataFrame, workbook: str, formula: str) -> DataFrame:
    """(construct, file_count, cell_count) over all workbooks, by the reasons of the ledger."""
    by_file = hole_reasons(cells, workbook, formula)
    return by_file.groupBy(F.col("reason").alias("construct")).agg(F.count("*").alias("file_count"), F.sum("n").alias("cell_count"))


def every_nth(rows: DataFrame, order: list[Column], n: int, by: list[str]) -> DataFrame:
    """Every max(1, N/n)-th row of each group in a fixed order."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    size = F.count("*").over(Window.partitionBy(*by))
    return rows.withColumn("_at", at).withColumn("_n", size).where((F.col("_at") - 1) % F.greatest(F.lit(1), F.floor(F.col("_n") / n)) == 0).drop("_at", "_n")


def most_frequent(rows: DataFrame, value: str, most: int) -> DataFrame:
    """(value, n): the ``most`` values that occur most often; equal numbers by value."""
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(most)


#: Symbols by whose cells two boxes meet.
MEET = 2


def case_distance(queries: DataFrame, cases: DataFrame, delta: float = 0.15, top: int = 5) -> DataFrame:
    """Nearest cases of each query by box distance over shared symbols.

    Both sides are long tables (query or case_id, program_hash, sym, lo, hi), a
    box is a key's rows of one program; the distance scales by the query's own
    widths, so it is not symmetric. Boxes that share an unbounded or repeated
    symbol are near nothing. Within ``delta`` no shared symbol's middles can be
    further apart than the widest scale of that symbol allows, so boxes meet by
    neighbouring cells of that width in up to ``MEET`` shared symbols at once.
    Equal cases meet once, by their ``top`` least ids, and a first pass counts
    distances by size, so only pairs about as near as the ``top`` nearest are ordered.
    """
    a, b = _boxes(queries, "query"), _boxes(cases, "case_id")
    width = F.greatest("d.w", 0.01 * F.abs("d.m"), F.lit(1e-9))
    each = a.select("program_hash", "dims").union(b.select("program_hash", "dims")).select("program_hash", F.size("dims").alias("n"), F.explode("dims").alias("d")).where("d.m is not null")
    spans = each.groupBy("program_hash", F.col("d.sym").alias("sym")).agg((F.max(width) * F.sqrt(F.max("n")) * (delta * 1.0001)).alias("cell"), (F.max("d.m") - F.min("d.m")).alias("spread"))
    cells = spans.groupBy("program_hash").agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("spread") / F.col("cell")).alias("rank"), "sym"))), lambda x: x["sym"]).alias("order"), F.map_from_entries(F.collect_list(F.struct("sym", "cell"))).alias("cell")
    )
    # Kinds of boxes, of which there are few, tell what two boxes share; a shared symbol without a middle parts them.
    kinds = a.select("program_hash", "kind").distinct().join(b.select("program_hash", F.col("kind").alias("other")).distinct(), "program_hash").join(cells, "program_hash")
    names = lambda c: F.transform(c, lambda x: x["sym"])
    loose = lambda c: names(F.filter(c, lambda x: ~x["ok"]))
    both = F.array_intersect(names(F.col("kind")), names(F.col("other")))
    kinds = kinds.where((F.size(both) > 0) & ~F.arrays_overlap(both, F.array_union(loose(F.col("kind")), loose(F.col("other"))))).withColumn("shared", F.array_intersect("order", both))
    kinds = kinds.select("program_hash", "kind", "other", "shared", F.transform("shared", lambda s: F.col("cell")[s]).alias("widths"))
    near = _placed(a.join(kinds, ["program_hash", "kind"]), "a").withColumnRenamed("other", "_kind").drop("kind", "case")
    for i in range(MEET):
        near = near.withColumn(f"at{i}", F.explode(F.when(F.size("shared") > i, F.sequence(F.col(f"at{i}") - 1, F.col(f"at{i}") + 1)).otherwise(F.array(F.lit(0).cast("long")))))
    first = F.row_number().over(Window.partitionBy("program_hash", "kind", "dims").orderBy("case_id"))
    ids = F.sort_array(F.collect_list(F.struct("case_id"))).alias("ids")
    equal = b.withColumn("_at", first).where(F.col("_at") <= top).groupBy("program_hash", "kind", "dims").agg(ids)
    held = equal.join(kinds.select("program_hash", F.col("other").alias("kind"), "shared", "widths").distinct(), ["program_hash", "kind"])
    held = _placed(held, "b").withColumnRenamed("kind", "_kind")
    on = ["program_hash", "_kind", "shared", *(f"at{i}" for i in range(MEET))]

    def part(x, y):
        return F.pow((x["m"] - y["m"]) / F.greatest(x["w"], y["w"], 0.01 * F.abs(x["m"]), F.lit(1e-9)), 2)

    some = [F.when(F.size("shared") > i, part(F.col(f"d{i}_a"), F.col(f"d{i}_b"))).otherwise(0.0) for i in range(MEET)]
    rest = F.when(F.size("shared") > MEET, F.aggregate(F.zip_with("rest_a", "rest_b", part), F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)
    level = F.coalesce(F.floor(4 * F.log2(F.col("distance") / delta)), F.lit(-10_000))

    def pairs(queries):
        met = queries.join(held, on).withColumn("distance", F.sqrt(sum(some[1:], some[0]) + rest) / F.sqrt(F.size("shared")))
        return met.where(F.col("distance") < delta)

    counted = pairs(near).groupBy("query", level.alias("level")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("query").orderBy("level")) - F.col("n")
    limits = counted.withColumn("before", before).where(F.col("before") < top).groupBy("query").agg(F.max("level").alias("limit"))
    close = pairs(near.join(limits, "query")).where(level <= F.col("limit")).select("query", "distance", "ids")
    best = F.row_number().over(Window.partitionBy("query").orderBy("distance", F.col("ids")[0]["case_id"]))
    found = close.withColumn("_nth", best).where(F.col("_nth") <= top).select("query", F.explode("ids").alias("id"), "distance").select("query", "id.case_id", "distance")
    nearest = F.row_number().over(Window.partitionBy("query").orderBy("distance", "case_id"))
    return found.withColumn("nearest", nearest).where(F.col("nearest") <= top)


def _boxes(rows: DataFrame, key: str) -> DataFrame:
    """(key, program_hash, kind, dims): symbols of each box in order with middle and width, null where unbounded or repeated; the kind tells which."""
    middle = F.when(F.abs((F.col("lo") + F.col("hi")) / 2) < float("inf"), (F.col("lo") + F.col("hi")) / 2)
    each = rows.where("program_hash is not null and sym is not null").groupBy(key, "program_hash", "sym").agg(F.when(F.count("*") == 1, F.first(middle)).alias("m"), F.first(F.col("hi") - F.col("lo")).alias("w"))
    dims = F.sort_array(F.collect_list(F.struct("sym", "m", "w")))
    boxes = each.groupBy(key, "program_hash").agg(dims.alias("dims"))
    return boxes.withColumn("kind", F.transform("dims", lambda d: F.struct(d["sym"].alias("sym"), d["m"].isNotNull().alias("ok"))))


def _placed(boxes: DataFrame, k: str) -> DataFrame:
    """The shared symbols of boxes: the first ``MEET`` with their cells as columns, the others as one array."""
    by = F.transform("shared", lambda s: F.filter("dims", lambda d: d["sym"] == s)[0])
    out = boxes.withColumn("_by", by)
    for i in range(MEET):
        place = F.floor(F.try_divide(F.get("_by", F.lit(i))["m"], F.get("widths", F.lit(i))))
        out = out.withColumn(f"d{i}_{k}", F.get("_by", F.lit(i)).dropFields("sym")).withColumn(f"at{i}", F.coalesce(place, F.lit(0).cast("long")))
    return out.withColumn(f"rest_{k}", F.slice("_by", MEET + 1, F.greatest(F.size("_by") - MEET, F.lit(0)))).drop("_by", "dims", "widths")


def resolved_cases(cases: DataFrame, links: DataFrame, fixes: DataFrame) -> DataFrame:
    """Cases with their first approved fix that resolved them."""
    good = links.where("outcome = 'resolved'").join(fixes.where("status = 'approved'"), "fix_id")
    first = F.row_number().over(Window.partitionBy("case_id").orderBy("fix_id"))
    return cases.join(good.withColumn("_at", first).where("_at = 1").drop("_at"), "case_id")


def section_status(sections: DataFrame, files: DataFrame, targets: DataFrame, section: str, file: str) -> DataFrame:
    """Counts of verdicts, worst score and newest file of each section."""
    joined = sections.join(files.where("is_head"), section).join(targets, file, "left")
    is_ = lambda x: F.count_if(F.col("verdict") == x)
    return joined.groupBy(section).agg(is_("SAFE").alias("safe"), is_("FAIL").alias("fail"), is_("ABSTAIN").alias("abstain"), F.max("cs").alias("max_cs"), F.max("mtime").alias("newest"))
