"""Set inversion over boxes, hole models of one variable, candidate bundles."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import program as pg
from ..stores import checkpointed
from . import verdict as v
from .structure import FOLD


def sivia(boxes: DataFrame, root: pg.Node, symbols: list[str], epsilon: float = 0.01, ks: float = 0.0, most_levels: int | None = None) -> DataFrame:
    """Settle boxes as safe, failed or (narrower than ``epsilon``) unknown, bisecting the widest side.

    ``boxes`` has ``x_lo, x_hi`` for each symbol and may hold many runs; all its
    other columns are kept. Levels run one after the other, each on all open
    boxes at once, until none is open; equal widths split the first symbol.
    Boxes without finite bounds, and those so narrow that the middle of the widest
    side is one of its ends, cannot be halved and stay unknown unless they are
    settled at once, as do all that ``most_levels`` leaves open, if given.
    """
    if not epsilon > 0:
        raise ValueError("epsilon must be above 0")
    names = [(f"{s}_lo", f"{s}_hi") for s in symbols]
    columns = {s: n for s, n in zip(symbols, names)}
    open_, done = boxes, None
    width = F.greatest(*(F.col(hi) - F.col(lo) for lo, hi in names)) if len(names) > 1 else F.col(names[0][1]) - F.col(names[0][0])
    middle = [F.col(lo) / 2 + F.col(hi) / 2 for lo, hi in names]
    split = F.lit(len(symbols) - 1)
    for i in range(len(symbols) - 2, -1, -1):
        wider = F.lit(True)
        for j in range(i + 1, len(symbols)):
            wider &= (F.col(names[i][1]) - F.col(names[i][0])) >= (F.col(names[j][1]) - F.col(names[j][0]))
        split = F.when(wider, F.lit(i)).otherwise(split)
    stuck = F.lit(False)
    for i, (lo, hi) in enumerate(names):
        stuck |= (F.col("_split") == i) & ((middle[i] <= F.col(lo)) | (middle[i] >= F.col(hi)))
    for level in itertools.count() if most_levels is None else range(most_levels):
        judged = pg.evaluate(open_, root, columns, ks).withColumn("_split", split)
        status = v.decide(F.col("ms_lo"), F.col("ms_hi"), F.col("residual"))
        status = F.when(status == "SAFE", "safe").when(status == "FAIL", "fail").when((width < epsilon) | ~(width < float("inf")) | stuck, "unknown").otherwise("open")
        judged = checkpointed(judged.withColumn("status", status).drop("ms_lo", "ms_hi", "residual"))
        settled = judged.where("status <> 'open'").drop("_split")
        done = settled if done is None else done.unionByName(settled)
        if level % FOLD == FOLD - 1:
            done = checkpointed(done)
        left = judged.where("status = 'open'").drop("status")
        if left.isEmpty():
            return done
        halves = left.withColumn("_half", F.explode(F.array(F.lit(0), F.lit(1))))
        for i, (lo, hi) in enumerate(names):
            mine = F.col("_split") == i
            new_lo, new_hi = F.when(mine & (F.col("_half") == 1), middle[i]).otherwise(F.col(lo)), F.when(mine & (F.col("_half") == 0), middle[i]).otherwise(F.col(hi))
            halves = halves.withColumns({f"_{lo}": new_lo, f"_{hi}": new_hi}).drop(lo, hi).withColumnsRenamed({f"_{lo}": lo, f"_{hi}": hi})
        open_ = halves.drop("_split", "_half").select(*boxes.columns)
    return done.unionByName(open_.withColumn("status", F.lit("unknown")))


def volume_share(settled: DataFrame, symbols: list[str], by: list[str]) -> DataFrame:
    """Share of each status in the volume of all boxes of a run."""
    volume = F.lit(1.0)
    for s in symbols:
        volume = volume * (F.col(f"{s}_hi") - F.col(f"{s}_lo"))
    part = lambda x: F.sum(F.when(F.col("status") == x, volume).otherwise(0.0)) / F.sum(volume)
    return settled.groupBy(*by).agg(*(part(x).alias(f"{x}_share") for x in ("safe", "fail", "unknown")), F.count("*").alias("boxes"))


def lipschitz(queries: DataFrame, probes: DataFrame, constants: DataFrame, hole: str = "hole") -> DataFrame:
    """Bounds of a black box on query intervals from its probes and a Lipschitz constant.

    queries(hole, query, lo, hi), probes(hole, x, f), constants(hole, lip, phys_lo,
    phys_hi). Every probe bounds f on the interval; their meet with the physical
    range is the enclosure. Two probes steeper than the constant refute it.
    """
    near = Window.partitionBy(hole).orderBy("x")
    steep = F.abs((F.col("f") - F.lag("f").over(near)) / (F.col("x") - F.lag("x").over(near)))
    # The steepest secant of all pairs is the steepest of neighbours.
    slopes = probes.withColumn("_s", F.when(F.col("x") > F.lag("x").over(near), steep)).groupBy(hole).agg(F.max("_s").alias("slope"))
    joined = queries.join(constants, hole).join(probes, hole)
    centre, radius = (F.col("lo") + F.col("hi")) / 2, (F.col("hi") - F.col("lo")) / 2
    reach = F.col("lip") * (F.abs(centre - F.col("x")) + radius)
    met = joined.groupBy(hole, "query", "lip", "phys_lo", "phys_hi").agg(F.max(F.col("f") - reach).alias("a"), F.min(F.col("f") + reach).alias("b"))
    lo, hi = F.greatest("a", "phys_lo"), F.least("b", "phys_hi")
    refuted = (F.coalesce(F.col("slope"), F.lit(0.0)) > F.col("lip")) | (lo > hi)
    out = met.join(slopes, hole, "left")
    return out.select(hole, "query", F.when(refuted, F.col("phys_lo")).otherwise(lo).alias("lo"), F.when(refuted, F.col("phys_hi")).otherwise(hi).alias("hi"), refuted.alias("refuted"))


def monotone(lo: Column, hi: Column, sign: int, f_lo: Column, f_hi: Column, phys_lo: Column, phys_hi: Column) -> tuple[Column, Column]:
    """Bounds of a monotone function from its values at the ends, within the physical range."""
    a, b = (f_lo, f_hi) if sign >= 0 else (f_hi, f_lo)
    return F.greatest(a, phys_lo), F.least(b, phys_hi)


def probe_model(probes: DataFrame, hole: str = "hole") -> DataFrame:
    """(hole, lo, hi, lip, monotone) of sampled functions of one variable; -1, 0 or 1 for falling, neither, rising."""
    w = Window.partitionBy(hole).orderBy("x")
    stepped = probes.withColumn("_d", F.col("f") - F.lag("f").over(w)).withColumn("_x", F.col("x") - F.lag("x").over(w))
    slope = F.when(F.col("_x") > 0, F.abs(F.col("_d") / F.col("_x")))
    return stepped.groupBy(hole).agg(
        F.min("f").alias("lo"), F.max("f").alias("hi"), F.coalesce(F.max(slope), F.lit(0.0)).alias("lip"),
        F.when(F.coalesce(F.min("_d"), F.lit(0.0)) >= 0, 1).when(F.coalesce(F.max("_d"), F.lit(0.0)) <= 0, -1).otherwise(0).alias("monotone"),
    )


def normalise(bundles: DataFrame, by: str, conf: str = "conf") -> DataFrame:
    """Confidences that sum to 1 within each bundle."""
    total = F.sum(conf).over(Window.partitionBy(by))
    return bundles.withColumn(conf, F.when(total > 0, F.col(conf) / total).otherwise(F.lit(0.0)))


def prune(bundles: DataFrame, by: str, floor: float, order: list[Column], conf: str = "conf", least: int = 2) -> DataFrame:
    """Candidates above a confidence, and the best ``least`` in any case."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(conf), *order))
    return bundles.withColumn("_at", at).where((F.col("_at") <= least) | (F.col(conf) >= floor)).drop("_at")


def add(bundles: DataFrame, new: DataFrame) -> DataFrame:
    """Bundles with further candidates; nothing is merged."""
    return bundles.unionByName(new)


def mark_unknown(marks: DataFrame, by: str, order: str) -> DataFrame:
    """(by, lo, hi): physical range of each bundle that is marked unknown.

    Marks meet in their order; one that has nothing in common with those before
    it takes their place. A bundle has a few marks at most.
    """
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "lo", "hi")))
    none = F.struct(F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))

    def step(a: Column, x: Column) -> Column:
        lo, hi = F.greatest(a["lo"], x["lo"]), F.least(a["hi"], x["hi"])
        return F.struct(F.when(lo > hi, x["lo"]).otherwise(lo).alias("lo"), F.when(lo > hi, x["hi"]).otherwise(hi).alias("hi"))

    return marks.groupBy(by).agg(F.aggregate(items, none, step).alias("m")).select(by, "m.lo", "m.hi")


def top_conf(bundles: DataFrame, by: str, conf: str = "conf") -> DataFrame:
    """(by, conf): highest confidence of each bundle, 0 at least."""
    return bundles.groupBy(by).agg(F.greatest(F.lit(0.0), F.max(conf)).alias(conf))


def lower(bundles: DataFrame, unknown: DataFrame, by: str, ids: DataFrame) -> DataFrame:
    """(by, lo, hi, parts): hull of each bundle's candidates, and of its physical range where it is marked unknown.

    ``ids`` lists all bundles; one without candidates and without a mark is the
    entire line, as its hole has no bounds.
    """
    parts = bundles.select(by, "lo", "hi").unionByName(unknown.select(by, "lo", "hi"))
    hull = parts.groupBy(by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("parts"))
    end = lambda c, x: F.coalesce(c, F.lit(x)).alias(c)
    return ids.select(by).distinct().join(hull, by, "left").select(by, end("lo", float("-inf")), end("hi", float("inf")), end("parts", 0))
