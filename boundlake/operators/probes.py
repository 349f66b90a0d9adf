"""Black boxes of several variables, known by probes: models, enclosures, adaptive probes.

Probes are rows (hole, one column for each dimension, f). Slopes are secants by
Euclidean distance. Pairs of probes meet by cells of a grid, never all with all
where a bound shows that they need not.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stores import checkpointed

#: Factor on the observed slope, and what is added to half of the observed range.
SAFETY, PAD = 1.25, 1e-9
#: Probes at less than this distance have no slope.
APART = 1e-12


def _norm(parts: list[Column]) -> Column:
    return F.sqrt(functools.reduce(operator.add, (p * p for p in parts)))


def grid(holes: DataFrame, dims: list[str], n: int, hole: str = "hole") -> DataFrame:
    """(hole, dims): a regular grid of ``n`` values on each side of every hole's domain ``<dim>_lo .. <dim>_hi``; one value is the middle."""
    out = holes
    for d in dims:
        out = out.withColumn("_t", F.explode(F.array(*(F.lit(0.5 if n == 1 else i / (n - 1)) for i in range(n))))).withColumn(d, F.col(f"{d}_lo") + F.col("_t") * (F.col(f"{d}_hi") - F.col(f"{d}_lo")))
    return out.select(hole, *dims)


def _places(probes: DataFrame, dims: list[str], f: str, hole: str) -> DataFrame:
    """One row for each place of a hole, with the least and largest value measured there; finite places only."""
    finite = functools.reduce(operator.and_, (F.abs(d) < float("inf") for d in [*dims, f]))
    return probes.where(finite).groupBy(hole, *dims).agg(F.min(f).alias("f_lo"), F.max(f).alias("f_hi"))


def slopes(probes: DataFrame, dims: list[str], f: str = "f", hole: str = "hole") -> DataFrame:
    """(hole, lo, hi, lip, probes): range and steepest secant over all pairs of probes of each hole.

    Neighbours in small cells give a first slope L. A pair further apart than
    (highest - lowest value) / L cannot be steeper, so only places in adjacent
    cells of that size meet after that; the result is that of all pairs.
    """
    places = checkpointed(_places(probes, dims, f, hole))
    ends = [g for d in dims for g in (F.min(d).alias(f"{d}_a"), F.max(d).alias(f"{d}_b"))]
    whole = places.groupBy(hole).agg(F.min("f_lo").alias("lo"), F.max("f_hi").alias("hi"), F.count("*").alias("n"), *ends)
    side = F.ceil(F.pow("n", F.lit(1.0 / len(dims))))
    cells = [F.floor(F.coalesce(F.try_divide(F.col(d) - F.col(f"{d}_a"), F.col(f"{d}_b") - F.col(f"{d}_a")), F.lit(0.0)) * side).alias(f"_c{i}") for i, d in enumerate(dims)]
    small = places.join(whole, hole).select(hole, *dims, "f_lo", "f_hi", *cells)
    near = Window.partitionBy(hole, *(f"_c{i}" for i in range(1, len(dims)))).orderBy(*dims)
    apart = _norm([F.col(d) - F.lag(d).over(near) for d in dims])
    rise = F.greatest(F.col("f_hi") - F.lag("f_lo").over(near), F.lag("f_hi").over(near) - F.col("f_lo"))
    first = small.select(hole, F.when(apart > APART, rise / apart).alias("s")).groupBy(hole).agg(F.max("s").alias("first"))
    known = checkpointed(whole.join(first, hole, "left").withColumn("reach", F.when(F.col("first") > 0, (F.col("hi") - F.col("lo")) / F.col("first") * (1 + 1e-9))))

    # Without a first slope every pair meets, in one cell.
    at = lambda d: F.coalesce(F.floor((F.col(d) - F.col(f"{d}_a")) / F.col("reach")), F.lit(0))
    sized = places.join(known.where("hi > lo").select(hole, "reach", "first", *(f"{d}_a" for d in dims)), hole)
    held = sized.select(hole, *(at(d).alias(f"_c{i}") for i, d in enumerate(dims)), *(F.col(d).alias(f"o_{d}") for d in dims), F.col("f_lo").alias("o_lo"), F.col("f_hi").alias("o_hi"))
    moves = F.array(*(F.struct(*(F.lit(s).alias(f"s{i}") for i, s in enumerate(m))) for m in itertools.product((-1, 0, 1), repeat=len(dims))))
    asked = sized.withColumn("_m", F.explode(moves)).select(hole, "first", *dims, "f_lo", "f_hi", *((at(d) + F.col(f"_m.s{i}")).alias(f"_c{i}") for i, d in enumerate(dims)))
    distance = _norm([F.col(d) - F.col(f"o_{d}") for d in dims])
    # Both orders of a pair meet, so one direction of the rise is enough.
    met = asked.join(held, [hole, *(f"_c{i}" for i in range(len(dims)))]).select(hole, distance.alias("d"), (F.col("f_hi") - F.col("o_lo")).alias("r"))
    steepest = met.where(F.col("d") > APART).groupBy(hole).agg(F.max(F.col("r") / F.col("d")).alias("lip"))
    lip = F.greatest(F.coalesce(F.col("lip"), F.lit(0.0)), F.coalesce(F.col("first"), F.lit(0.0)), F.lit(0.0))
    return known.join(steepest, hole, "left").select(hole, "lo", "hi", lip.alias("lip"), F.col("n").alias("probes"))


def synthesize(models: DataFrame, safety: float = SAFETY, hole: str = "hole") -> DataFrame:
    """(hole, lip, phys_lo, phys_hi, regime): constants of a wrapper from a model; not rigorous, so regime B."""
    pad = (F.col("hi") - F.col("lo")) / 2 + PAD
    return models.select(hole, (F.col("lip") * safety).alias("lip"), (F.col("lo") - pad).alias("phys_lo"), (F.col("hi") + pad).alias("phys_hi"), F.lit("B").alias("regime"))


def enclose(queries: DataFrame, probes: DataFrame, constants: DataFrame, models: DataFrame, dims: list[str], f: str = "f", hole: str = "hole", query: str = "query") -> DataFrame:
    """(hole, query, lo, hi, residual, refuted): bounds of a black box on query boxes ``<dim>_lo .. <dim>_hi``.

    Each probe bounds f on a box by a cone with the slope ``lip``; the meet of all
    cones and the physical range is the enclosure. A slope of the model above
    ``lip``, or an empty meet, refutes the constant: the physical range is left,
    and half of it is the residual. A hole without probes has its physical range.

    Cells of probes bound their cones from both sides, so only cells that can
    hold the tightest cone of a query are opened; the result is that of all.
    """
    places = _places(probes, dims, f, hole)
    ends = [g for d in dims for g in (F.min(d).alias(f"{d}_a"), F.max(d).alias(f"{d}_b"))]
    whole = places.groupBy(hole).agg(F.count("*").alias("n"), *ends)
    side = F.ceil(F.pow("n", F.lit(0.5 / len(dims))))
    cell = F.concat_ws(",", *(F.floor(F.coalesce(F.try_divide(F.col(d) - F.col(f"{d}_a"), F.col(f"{d}_b") - F.col(f"{d}_a")), F.lit(0.0)) * side).cast("string") for d in dims))
    dealt = checkpointed(places.join(whole, hole).select(hole, cell.alias("cell"), *dims, "f_lo", "f_hi"))
    cells = dealt.groupBy(hole, "cell").agg(F.min("f_lo").alias("c_lo"), F.max("f_hi").alias("c_hi"), *ends)

    centre = {d: (F.col(f"{d}_lo") + F.col(f"{d}_hi")) / 2 for d in dims}
    radius = _norm([(F.col(f"{d}_hi") - F.col(f"{d}_lo")) / 2 for d in dims])
    asked = queries.join(constants.select(hole, "lip", "phys_lo", "phys_hi"), hole).select(hole, query, "lip", "phys_lo", "phys_hi", radius.alias("radius"), *(c.alias(f"{d}_c") for d, c in centre.items()))
    least = _norm([F.greatest(F.lit(0.0), F.col(f"{d}_a") - F.col(f"{d}_c"), F.col(f"{d}_c") - F.col(f"{d}_b")) for d in dims]) + F.col("radius")
    most = _norm([F.greatest(F.abs(F.col(f"{d}_a") - F.col(f"{d}_c")), F.abs(F.col(f"{d}_c") - F.col(f"{d}_b"))) for d in dims]) + F.col("radius")
    per = Window.partitionBy(hole, query)
    bounded = asked.join(cells, hole).select(
        hole, query, "cell", F.min(F.col("c_lo") + F.col("lip") * most).over(per).alias("up"), F.max(F.col("c_hi") - F.col("lip") * most).over(per).alias("down"),
        (F.col("c_lo") + F.col("lip") * least).alias("best_up"), (F.col("c_hi") - F.col("lip") * least).alias("best_down"),
    )
    slack = 1e-9 * (F.abs("up") + F.abs("down") + 1)
    opened = bounded.where((F.col("best_up") <= F.col("up") + slack) | (F.col("best_down") >= F.col("down") - slack)).select(hole, query, "cell")
    reach = F.col("lip") * (_norm([F.col(d) - F.col(f"{d}_c") for d in dims]) + F.col("radius"))
    cones = opened.join(asked, [hole, query]).join(dealt, [hole, "cell"]).groupBy(hole, query).agg(F.max(F.col("f_hi") - reach).alias("a"), F.min(F.col("f_lo") + reach).alias("b"))
    out = asked.join(cones, [hole, query], "left").join(models.select(hole, F.col("lip").alias("steepest")), hole, "left")
    lo, hi = F.greatest("phys_lo", F.coalesce("a", "phys_lo")), F.least("phys_hi", F.coalesce("b", "phys_hi"))
    refuted = F.coalesce(F.col("steepest") > F.col("lip"), F.lit(False)) | (lo > hi)
    bare = refuted | F.col("a").isNull()
    return out.select(
        hole, query, F.when(refuted, F.col("phys_lo")).otherwise(lo).alias("lo"), F.when(refuted, F.col("phys_hi")).otherwise(hi).alias("hi"),
        F.when(bare, (F.col("phys_hi") - F.col("phys_lo")) / 2).otherwise(0.0).alias("residual"), refuted.alias("refuted"),
    )


def adaptive(probes: DataFrame, dims: list[str], fn: Callable[..., Column], rounds: int, f: str = "f", hole: str = "hole", at: str = "at", keep: tuple[str, ...] = ()) -> DataFrame:
    """Probes of all holes with ``rounds`` more of each: every round adds the middle of a hole's steepest pair.

    ``at`` numbers a hole's probes from 0; equal slopes go to the pair with the
    smaller numbers. ``fn`` gives the value at the columns of ``dims`` (and
    ``keep``, parameters of the hole). A table with one row for each hole holds
    its steepest pair; a new probe is held against its hole's probes only, so a
    round is linear in them. Holes without two places get no probe.
    """
    every = checkpointed(probes.select(hole, *keep, at, *dims, f))
    other = every.select(hole, F.col(at).alias("_j"), *(F.col(d).alias(f"o_{d}") for d in dims), F.col(f).alias("o_f"))
    front = checkpointed(_steepest(every.join(other, hole).where(F.col(at) < F.col("_j")), dims, f, hole, at))
    for _ in range(rounds):
        size = every.groupBy(hole).agg((F.max(at) + 1).alias(at), *(F.first(k).alias(k) for k in keep))
        middle = front.join(size, hole).select(hole, *keep, at, *((F.col(f"pair.{d}") + F.col(f"pair.o_{d}")).alias(d) for d in dims))
        middle = middle.withColumns({d: F.col(d) * 0.5 for d in dims})
        new = checkpointed(middle.withColumn(f, fn(**{c: F.col(c) for c in (*dims, *keep)}).cast("double")).select(*every.columns))
        other = new.select(hole, F.col(at).alias("_j"), *(F.col(d).alias(f"o_{d}") for d in dims), F.col(f).alias("o_f"))
        met = _steepest(every.join(other, hole), dims, f, hole, at)
        front = checkpointed(front.unionByName(met).groupBy(hole).agg(F.min("pair").alias("pair")))
        every = checkpointed(every.unionByName(new))
    return every


def _steepest(pairs: DataFrame, dims: list[str], f: str, hole: str, at: str) -> DataFrame:
    """(hole, pair): the pair with the largest slope, then the smallest numbers."""
    distance = _norm([F.col(d) - F.col(f"o_{d}") for d in dims])
    order = F.struct((-F.abs(F.col(f) - F.col("o_f")) / distance).alias("slope"), F.col(at).alias("i"), F.col("_j").alias("j"), *(F.col(c) for d in dims for c in (d, f"o_{d}")))
    return pairs.where(distance > APART).groupBy(hole).agg(F.min(order).alias("pair"))
