"""Verdicts, criticality, certificates and explanations of evaluated programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the criticality score and their labels, lowest first.
BANDS = ((0.2, 0, "SAFE"), (0.5, 1, "WATCH"), (0.75, 2, "REVIEW"), (0.9, 3, "CRITICAL"))
ALPHA = 3.0


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def usable(lo: Column, hi: Column, residual: Column) -> Column:
    return _finite(lo) & _finite(hi) & _finite(residual) & (residual >= 0)


def decide(lo: Column, hi: Column, residual: Column) -> Column:
    """SAFE or FAIL only where the enclosure leaves no doubt, else ABSTAIN."""
    good = usable(lo, hi, residual)
    return F.when(good & (lo - residual > 0), "SAFE").when(good & (hi + residual < 0), "FAIL").otherwise("ABSTAIN")


def rank(verdict: Column) -> Column:
    """FAIL is worse than ABSTAIN, which is worse than SAFE."""
    return F.when(verdict == "FAIL", 2).when(verdict == "ABSTAIN", 1).otherwise(0)


def score(lo: Column, hi: Column, residual: Column, alpha: float = ALPHA) -> Column:
    """Criticality in 0..1: a logistic of the signal-to-noise ratio of the margin; 1 where unusable."""
    snr = (lo - residual) / ((hi - lo) + residual + F.lit(1e-12))
    return F.when(usable(lo, hi, residual), 1 / (1 + F.exp(F.lit(alpha) * snr))).otherwise(F.lit(1.0))


def priority(cs: Column) -> Column:
    out = F.lit(4)
    for limit, level, _ in reversed(BANDS):
        out = F.when(cs < limit, level).otherwise(out)
    return out


def label(cs: Column) -> Column:
    out = F.lit("HALT")
    for limit, _, name in reversed(BANDS):
        out = F.when(cs < limit, name).otherwise(out)
    return out


def canonical(fields: dict[str, Column]) -> Column:
    """Canonical JSON text: keys in order, numbers as 17-digit exponents."""
    parts = []
    for i, key in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "{") + f'"{key}":'), fields[key]]
    return F.concat(*parts, F.lit("}"))


def text_of(x: Column) -> Column:
    return F.concat(F.lit('"'), x, F.lit('"'))


def certify(df: DataFrame, method: str, subject: Column, regime: Column | None = None) -> DataFrame:
    """Add verdict, cs, priority, label and ``cert_hash`` to rows with ms_lo, ms_hi and residual."""
    lo, hi, res = F.col("ms_lo"), F.col("ms_hi"), F.col("residual")
    out = df.withColumn("verdict", decide(lo, hi, res)).withColumn("cs", score(lo, hi, res))
    out = out.withColumn("priority", priority(F.col("cs"))).withColumn("label", label(F.col("cs")))
    regime = F.when(F.col("residual") > 0, "B").otherwise("A") if regime is None else regime
    return out.withColumn("method", F.lit(method)).withColumn("regime", regime).withColumn("cert_hash", certificate_hash(subject, F.lit(method)))


def _hex(x: Column) -> Column:
    """A double by its decimal text, the shortest that reads back the same."""
    return x.cast("string")


def certificate_hash(subject: Column, method: Column) -> Column:
    fields = {"hi": _hex(F.col("ms_hi")), "lo": _hex(F.col("ms_lo")), "method": text_of(method), "residual": _hex(F.col("residual")), "subject": text_of(subject.cast("string")), "verdict": text_of(F.col("verdict"))}
    return F.sha2(canonical(fields), 256)


def valid(subject: Column) -> Column:
    """Whether a certificate's digest and verdict follow from its own numbers."""
    lo, hi, res = F.col("ms_lo"), F.col("ms_hi"), F.col("residual")
    sound = ~F.isnan(lo) & ~F.isnan(hi) & ~F.isnan(res) & (res >= 0) & (lo <= hi)
    return sound & (F.col("verdict") == decide(lo, hi, res)) & (F.col("cert_hash") == certificate_hash(subject, F.col("method")))


def reduction_plan(trace: DataFrame, run: list[str], width: str = "width") -> DataFrame:
    """Uncertain parts of each run by share of the widest one; infinite over infinite is 1."""
    from pyspark.sql import Window

    over = F.max(width).over(Window.partitionBy(*run))
    endless = F.lit(float("inf"))
    share = F.when(over == endless, F.when(F.col(width) == endless, 1.0).otherwise(0.0)).when(over > 0, F.col(width) / over).otherwise(0.0)
    return trace.withColumn("share", share)


#: What would narrow each kind of reason.
ADVICE = {
    "hole": "give %s bounds, or a formula of its own",
    "hole_phys": "measure %s at several inputs, so that a model can replace its range",
    "hole_refuted": "the measurements of %s contradict its model; widen the model's constant or split its domain",
    "disj": "decide which formula of %s holds",
    "disjunction": "decide which formula of %s holds",
}


def explain(trace: DataFrame, run: list[str]) -> DataFrame:
    """One row for each run: reasons to abstain, worst first, with advice for each, and what its holes account for.

    ``trace`` has one row for each node with kind (a key of ``ADVICE`` or any
    other), name and width; ``share`` is of the widest reason, ``hole_share`` of
    the sum of all widths. Runs without a reason have an empty list.
    """
    wide = F.max(F.when(F.col("kind").isin(*ADVICE), F.col("width")))
    total = F.sum("width")
    name = F.coalesce(F.col("name").cast("string"), F.lit("it"))
    advice = F.lit(None).cast("string")
    for kind, text in ADVICE.items():
        advice = F.when(F.col("kind") == kind, F.format_string(text, name)).otherwise(advice)
    item = F.when(F.col("kind").isin(*ADVICE), F.struct((-F.col("width")).alias("order"), F.col("name"), F.col("kind"), F.col("width"), advice.alias("advice")))
    holes = F.col("kind").startswith("hole")
    held = F.sum(F.when(holes, F.col("width")).otherwise(0.0))
    grouped = trace.groupBy(*run).agg(F.sort_array(F.collect_list(item)).alias("_r"), wide.alias("_wide"), F.count_if(holes).alias("holes"), held.alias("_held"), total.alias("_total"))
    endless = F.lit(float("inf"))
    share = lambda w: F.when(F.col("_wide") == endless, F.when(w == endless, 1.0).otherwise(0.0)).when(F.col("_wide") > 0, w / F.col("_wide")).otherwise(0.0)
    reasons = F.transform("_r", lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), share(x["width"]).alias("share"), x["advice"].alias("advice")))
    said = F.when(F.size("_r") == 0, F.lit("nothing to narrow")).otherwise(F.format_string("%d uncertain parts; worst: %s", F.size("_r"), F.get("_r", F.lit(0))["name"]))
    hole_share = F.when(F.col("_total") > 0, F.col("_held") / F.col("_total")).otherwise(F.col("_held"))
    return grouped.select(*run, reasons.alias("reasons"), "holes", hole_share.alias("hole_share"), said.alias("summary"))
