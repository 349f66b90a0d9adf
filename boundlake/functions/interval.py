"""Guaranteed interval arithmetic as SQL expressions.

Every kernel takes and returns bounds as SQL text, so the same kernel serves
Catalyst (through ``expr``) and any other engine with IEEE doubles. An interval
is a pair (lo, hi); lo > hi is empty, (-inf, inf) is entire.

Neither Spark nor SQL can set a rounding mode. ``dn`` and ``up`` step outward by
at least one unit in the last place, which encloses the result of a basic
operation; library functions, whose last digits are not guaranteed, step twice.
``exact_*`` kernels find the rounding error itself and step only if there is one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = "CAST('Infinity' AS DOUBLE)"
NEG_INF = "CAST('-Infinity' AS DOUBLE)"
LARGEST = "CAST('1.7976931348623157E308' AS DOUBLE)"
#: One step outward covers x * 2**-53 and the least subnormal.
REL = "CAST('1.1102230246251568E-16' AS DOUBLE)"
TINY = "CAST('4.9E-324' AS DOUBLE)"
TWO_PI = "CAST('6.283185307179586' AS DOUBLE)"
PI = "CAST('3.141592653589793' AS DOUBLE)"


def number(x: float) -> str:
    """A double as SQL text, bit for bit."""
    if math.isinf(x):
        return INF if x > 0 else NEG_INF
    return f"CAST('{x!r}' AS DOUBLE)"


def dn(x: str, steps: int = 1) -> str:
    """A bound at or below every real that rounds to x."""
    for _ in range(steps):
        x = f"(CASE WHEN ({x}) = {INF} THEN {LARGEST} ELSE ({x}) - (abs({x}) * {REL} + {TINY}) END)"
    return x


def up(x: str, steps: int = 1) -> str:
    for _ in range(steps):
        x = f"(CASE WHEN ({x}) = {NEG_INF} THEN -{LARGEST} ELSE ({x}) + (abs({x}) * {REL} + {TINY}) END)"
    return x


@dataclass(frozen=True)
class Ival:
    """Bounds as SQL text; short texts (column names or literals) keep expressions small."""

    lo: str
    hi: str

    @staticmethod
    def point(x: float) -> Ival:
        return Ival(number(x), number(x))

    def columns(self) -> tuple[Column, Column]:
        return F.expr(self.lo), F.expr(self.hi)

    @property
    def is_empty(self) -> str:
        return f"({self.lo} > {self.hi})"

    @property
    def is_entire(self) -> str:
        return f"({self.lo} = {NEG_INF} AND {self.hi} = {INF})"


EMPTY, ENTIRE = Ival(INF, NEG_INF), Ival(NEG_INF, INF)


class Steps:
    """Projections to apply in order. ``hold`` gives texts a column, so that a kernel that
    reads a result several times doesn't repeat its text; generated code stays small."""

    def __init__(self, prefix: str):
        self.prefix, self.stages = prefix, []

    def hold(self, *sqls: str) -> list[str]:
        names = [f"{self.prefix}_{len(self.stages)}_{i}" for i in range(len(sqls))]
        self.stages.append(list(zip(names, sqls)))
        return names


def _hold(steps: Steps | None, *sqls: str) -> list[str]:
    return steps.hold(*sqls) if steps else list(sqls)


def _or_empty(when: str, lo: str, hi: str) -> Ival:
    return Ival(f"(CASE WHEN {when} THEN {INF} ELSE {lo} END)", f"(CASE WHEN {when} THEN {NEG_INF} ELSE {hi} END)")


def _any_empty(*xs: Ival) -> str:
    return "(" + " OR ".join(x.is_empty for x in xs) + ")"


def neg(a: Ival) -> Ival:
    return Ival(f"(-{a.hi})", f"(-{a.lo})")


def add(a: Ival, b: Ival) -> Ival:
    return _or_empty(_any_empty(a, b), dn(f"{a.lo} + {b.lo}"), up(f"{a.hi} + {b.hi}"))


def sub(a: Ival, b: Ival) -> Ival:
    return _or_empty(_any_empty(a, b), dn(f"{a.lo} - {b.hi}"), up(f"{a.hi} - {b.lo}"))


def _nan(x: str) -> str:
    return f"isnan({x})"


def _extremes(steps: Steps | None, candidates: list[str], empty: str, bad: str) -> Ival:
    """From least to greatest candidate, one step outward; entire where ``bad`` holds."""
    lo, hi = _hold(steps, f"least({', '.join(candidates)})", f"greatest({', '.join(candidates)})")
    return _or_empty(empty, f"CASE WHEN {bad} THEN {NEG_INF} ELSE {dn(lo)} END", f"CASE WHEN {bad} THEN {INF} ELSE {up(hi)} END")


def mul(a: Ival, b: Ival, steps: Steps | None = None) -> Ival:
    """Least and greatest of the four products; 0 times infinity gives entire."""
    ps = _hold(steps, *(f"({x} * {y})" for x in (a.lo, a.hi) for y in (b.lo, b.hi)))
    bad = "(" + " OR ".join(_nan(p) for p in ps) + ")"
    return _extremes(steps, ps, _any_empty(a, b), bad)


def div(a: Ival, b: Ival, steps: Steps | None = None) -> Ival:
    """A divisor that holds 0 gives entire; it is replaced by 1 before dividing."""
    zero = f"({b.lo} <= 0 AND {b.hi} >= 0)"
    lo_b, hi_b = _hold(steps, *(f"(CASE WHEN {zero} THEN CAST(1 AS DOUBLE) ELSE {x} END)" for x in (b.lo, b.hi)))
    qs = _hold(steps, *(f"({x} / {y})" for x in (a.lo, a.hi) for y in (lo_b, hi_b)))
    bad = "(" + " OR ".join([zero, *(_nan(q) for q in qs)]) + ")"
    return _extremes(steps, qs, _any_empty(a, b), bad)


def sqr(a: Ival, steps: Steps | None = None) -> Ival:
    lo, hi = _hold(steps, f"({a.lo} * {a.lo})", f"({a.hi} * {a.hi})")
    low = f"CASE WHEN {a.lo} >= 0 THEN {dn(lo)} WHEN {a.hi} <= 0 THEN {dn(hi)} ELSE CAST(0 AS DOUBLE) END"
    return _or_empty(a.is_empty, f"greatest(CAST(0 AS DOUBLE), {low})", up(f"greatest({lo}, {hi})"))


def ipow(a: Ival, n: int, steps: Steps | None = None) -> Ival:
    """Integer power of any size with bounds at the ends; even powers know their sign."""
    if n == 0:
        return _or_empty(a.is_empty, number(1.0), number(1.0))
    if n < 0:
        inner = ipow(a, -n, steps)
        return div(Ival.point(1.0), Ival(*_hold(steps, inner.lo, inner.hi)), steps)
    if n == 1:
        return a
    if n == 2:
        return sqr(a, steps)
    # Few factors are multiplied; the library's power is within one unit of the exact one.
    power = (lambda x: "(" + " * ".join([x] * n) + ")") if n <= 4 else (lambda x: f"power({x}, {number(float(n))})")
    slack = n - 1 if n <= 4 else 2
    lo, hi = _hold(steps, power(a.lo), power(a.hi))
    wide = lambda f, x: f(x, slack)
    if n % 2:
        return _or_empty(a.is_empty, wide(dn, lo), wide(up, hi))
    low = f"CASE WHEN {a.lo} > 0 THEN {wide(dn, lo)} WHEN {a.hi} < 0 THEN {wide(dn, hi)} ELSE CAST(0 AS DOUBLE) END"
    return _or_empty(a.is_empty, f"greatest(CAST(0 AS DOUBLE), {low})", f"greatest({wide(up, lo)}, {wide(up, hi)})")


def rpow(a: Ival, p: float, steps: Steps | None = None) -> Ival:
    """Real power; the base is clipped to its non-negative part unless the exponent is whole.

    An exponent that is no finite number gives entire.
    """
    if not math.isfinite(p):
        return _or_empty(a.is_empty, NEG_INF, INF)
    if p == int(p):
        return ipow(a, int(p), steps)
    (base,) = _hold(steps, f"greatest({a.lo}, CAST(0 AS DOUBLE))")
    ends = [f"power({base}, {number(p)})", f"power(greatest({a.hi}, CAST(0 AS DOUBLE)), {number(p)})"]
    if p < 0:
        ends.reverse()
        at_zero = f"({base} = 0)"
        ends[1] = f"(CASE WHEN {at_zero} THEN {INF} ELSE power(CASE WHEN {at_zero} THEN CAST(1 AS DOUBLE) ELSE {base} END, {number(p)}) END)"
        ends[0] = f"(CASE WHEN {a.hi} <= 0 THEN {INF} ELSE power(CASE WHEN {a.hi} <= 0 THEN CAST(1 AS DOUBLE) ELSE {a.hi} END, {number(p)}) END)"
    lo, hi = _hold(steps, *ends)
    return _or_empty(f"({a.is_empty} OR {a.hi} < 0)", f"greatest(CAST(0 AS DOUBLE), {dn(lo, 2)})", up(hi, 2))


def pow_interval(a: Ival, b: Ival, steps: Steps | None = None) -> Ival:
    """A non-constant exponent: exp(b * log(a)), which encloses every power of a positive base."""
    held = lambda x: Ival(*_hold(steps, x.lo, x.hi))
    return exp(held(mul(b, held(log(a, steps)), steps)), steps)


def sqrt(a: Ival, steps: Steps | None = None) -> Ival:
    lo, hi = _hold(steps, *(f"sqrt(greatest({x}, CAST(0 AS DOUBLE)))" for x in (a.lo, a.hi)))
    return _or_empty(f"({a.is_empty} OR {a.hi} < 0)", f"greatest(CAST(0 AS DOUBLE), {dn(lo)})", up(hi))


def log(a: Ival, steps: Steps | None = None) -> Ival:
    lo, hi = _hold(steps, *(f"ln(CASE WHEN {x} > 0 THEN {x} ELSE CAST(1 AS DOUBLE) END)" for x in (a.lo, a.hi)))
    return _or_empty(f"({a.is_empty} OR {a.hi} <= 0)", f"CASE WHEN {a.lo} <= 0 THEN {NEG_INF} ELSE {dn(lo, 2)} END", up(hi, 2))


def exp(a: Ival, steps: Steps | None = None) -> Ival:
    lo, hi = _hold(steps, f"exp({a.lo})", f"exp({a.hi})")
    return _or_empty(a.is_empty, f"greatest(CAST(0 AS DOUBLE), {dn(lo, 2)})", up(hi, 2))


#: Beyond this size an argument's place in its period is not told from its bounds.
FAR = "CAST('1048576' AS DOUBLE)"
#: More than what first + k * period loses to rounding below that size.
CLOSE = "CAST('1E-9' AS DOUBLE)"


def _crosses(a: Ival, first: str, period: str) -> str:
    """Whether first + k * period lies in the interval, or next to it, for some whole k."""
    return f"(ceil(({a.lo} - {CLOSE} - {first}) / {period}) * {period} + {first} <= {a.hi} + {CLOSE})"


def _whole(a: Ival, period: str) -> str:
    return f"({a.hi} - {a.lo} >= {period} OR isnan({a.hi} - {a.lo}) OR abs({a.lo}) > {FAR} OR abs({a.hi}) > {FAR})"


def _wave(a: Ival, fn: str, top: str, bottom: str, steps: Steps | None) -> Ival:
    (whole,) = _hold(steps, _whole(a, TWO_PI))
    # Bounded stand-ins keep the functions off infinities in the branch not taken.
    at = Ival(*_hold(steps, *(f"(CASE WHEN {whole} THEN CAST(0 AS DOUBLE) ELSE {x} END)" for x in (a.lo, a.hi))))
    lo, hi = _hold(steps, f"{fn}({at.lo})", f"{fn}({at.hi})")
    least, greatest = _hold(steps, f"least({lo}, {hi})", f"greatest({lo}, {hi})")
    low = f"CASE WHEN {whole} OR {_crosses(at, bottom, TWO_PI)} THEN CAST(-1 AS DOUBLE) ELSE greatest(CAST(-1 AS DOUBLE), {dn(least, 2)}) END"
    high = f"CASE WHEN {whole} OR {_crosses(at, top, TWO_PI)} THEN CAST(1 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), {up(greatest, 2)}) END"
    return _or_empty(a.is_empty, low, high)


def sin(a: Ival, steps: Steps | None = None) -> Ival:
    return _wave(a, "sin", f"({PI} / 2)", f"(-{PI} / 2)", steps)


def cos(a: Ival, steps: Steps | None = None) -> Ival:
    return _wave(a, "cos", "CAST(0 AS DOUBLE)", PI, steps)


def tan(a: Ival, steps: Steps | None = None) -> Ival:
    (whole,) = _hold(steps, _whole(a, PI))
    at = Ival(*_hold(steps, *(f"(CASE WHEN {whole} THEN CAST(0 AS DOUBLE) ELSE {x} END)" for x in (a.lo, a.hi))))
    pole, lo, hi = _hold(steps, f"({whole} OR {_crosses(at, f'({PI} / 2)', PI)})", f"tan({at.lo})", f"tan({at.hi})")
    return _or_empty(a.is_empty, f"CASE WHEN {pole} THEN {NEG_INF} ELSE {dn(lo, 2)} END", f"CASE WHEN {pole} THEN {INF} ELSE {up(hi, 2)} END")


def hull(a: Ival, b: Ival) -> Ival:
    """Smallest interval around both; empty is the identity, as its bounds are (inf, -inf)."""
    return Ival(f"least({a.lo}, {b.lo})", f"greatest({a.hi}, {b.hi})")


def meet(a: Ival, b: Ival) -> Ival:
    lo, hi = f"greatest({a.lo}, {b.lo})", f"least({a.hi}, {b.hi})"
    return _or_empty(f"({lo} > {hi})", lo, hi)


def maximum(a: Ival, b: Ival) -> Ival:
    return _or_empty(_any_empty(a, b), f"greatest({a.lo}, {b.lo})", f"greatest({a.hi}, {b.hi})")


def minimum(a: Ival, b: Ival) -> Ival:
    return _or_empty(_any_empty(a, b), f"least({a.lo}, {b.lo})", f"least({a.hi}, {b.hi})")


def absolute(a: Ival) -> Ival:
    lo = f"CASE WHEN {a.lo} <= 0 AND {a.hi} >= 0 THEN CAST(0 AS DOUBLE) ELSE least(abs({a.lo}), abs({a.hi})) END"
    return _or_empty(a.is_empty, lo, f"greatest(abs({a.lo}), abs({a.hi}))")


def width(a: Ival) -> str:
    return f"(CASE WHEN {a.is_empty} THEN CAST(0 AS DOUBLE) ELSE {up(f'{a.hi} - {a.lo}', 2)} END)"


def middle(a: Ival) -> str:
    return f"(CASE WHEN {a.is_empty} THEN CAST('NaN' AS DOUBLE) WHEN {a.is_entire} THEN CAST(0 AS DOUBLE) ELSE {a.lo} / 2 + {a.hi} / 2 END)"


def magnitude(a: Ival) -> str:
    return f"(CASE WHEN {a.is_empty} THEN CAST(0 AS DOUBLE) ELSE greatest(abs({a.lo}), abs({a.hi})) END)"


def contains(a: Ival, x: str) -> str:
    return f"({a.lo} <= {x} AND {x} <= {a.hi})"


def subset(a: Ival, b: Ival) -> str:
    return f"({a.is_empty} OR ({b.lo} <= {a.lo} AND {a.hi} <= {b.hi}))"


def equal(a: Ival, b: Ival) -> str:
    return f"(({a.is_empty} AND {b.is_empty}) OR ({a.lo} = {b.lo} AND {a.hi} = {b.hi}))"


def text(a: Ival) -> Column:
    """``[lo, hi]`` with 15 significant digits."""
    lo, hi = a.columns()
    return F.format_string("[%.15g, %.15g]".replace("g", "e"), lo, hi)


def sum_error(a: str, b: str) -> str:
    """What a + b loses to rounding, exactly."""
    s = f"({a} + {b})"
    v = f"({s} - {a})"
    return f"(({a} - ({s} - {v})) + ({b} - {v}))"


def _split(x: str) -> tuple[str, str]:
    c = f"({x} * CAST('134217729' AS DOUBLE))"
    high = f"({c} - ({c} - {x}))"
    return high, f"({x} - {high})"


def product_error(a: str, b: str) -> str:
    """What a * b loses to rounding, exactly, unless it over- or underflows."""
    (ah, al), (bh, bl) = _split(a), _split(b)
    return f"(({al} * {bl}) - (((({a} * {b}) - ({ah} * {bh})) - ({al} * {bh})) - ({ah} * {bl})))"


def _inexact(x: str, error: str, down: bool) -> str:
    finite = f"({error} = 0)"
    return f"(CASE WHEN {finite} THEN {x} ELSE {dn(x) if down else up(x)} END)"


def exact_add(a: Ival, b: Ival, steps: Steps | None = None) -> Ival:
    lo, hi, lo_error, hi_error = _hold(steps, f"({a.lo} + {b.lo})", f"({a.hi} + {b.hi})", sum_error(a.lo, b.lo), sum_error(a.hi, b.hi))
    return _or_empty(_any_empty(a, b), _inexact(lo, lo_error, True), _inexact(hi, hi_error, False))


def exact_sub(a: Ival, b: Ival, steps: Steps | None = None) -> Ival:
    return exact_add(a, neg(b), steps)


def exact_mul(a: Ival, b: Ival, steps: Steps | None = None) -> Ival:
    """Each product is stepped only where it was rounded; tiny or huge ones always are."""
    pairs = [(x, y) for x in (a.lo, a.hi) for y in (b.lo, b.hi)]
    ps = _hold(steps, *(f"({x} * {y})" for x, y in pairs))
    errors = _hold(steps, *(product_error(x, y) for x, y in pairs))
    known = [f"({e} = 0 AND (({p} = 0 AND ({x} = 0 OR {y} = 0)) OR (abs({p}) > CAST('1E-290' AS DOUBLE) AND abs({p}) < CAST('1E300' AS DOUBLE))))" for (x, y), p, e in zip(pairs, ps, errors)]
    sure = _hold(steps, *known)
    los = _hold(steps, *(f"(CASE WHEN {k} THEN {p} ELSE {dn(p)} END)" for k, p in zip(sure, ps)))
    his = _hold(steps, *(f"(CASE WHEN {k} THEN {p} ELSE {up(p)} END)" for k, p in zip(sure, ps)))
    bad = "(" + " OR ".join(_nan(p) for p in ps) + ")"
    return _or_empty(_any_empty(a, b), f"CASE WHEN {bad} THEN {NEG_INF} ELSE least({', '.join(los)}) END", f"CASE WHEN {bad} THEN {INF} ELSE greatest({', '.join(his)}) END")
