"""SQL of interval results for another engine, written apart from the kernels.

A bound is stepped to the neighbouring double by its bit pattern, which that
engine can cast; the kernels step by arithmetic. Both must agree on every bit.
"""

from __future__ import annotations

INF = "CAST('Infinity' AS DOUBLE)"


def below(x: str, steps: int = 1) -> str:
    """The greatest double under x."""
    for _ in range(steps):
        x = f"list_extract(list_transform([{x}], lambda v: CASE WHEN v = -{INF} OR isnan(v) THEN v WHEN v = 0 THEN CAST('-4.9E-324' AS DOUBLE) ELSE CAST(CAST(CAST(CAST(v AS BIT) AS BIGINT) + CASE WHEN v > 0 THEN -1 ELSE 1 END AS BIT) AS DOUBLE) END), 1)"
    return x


def above(x: str, steps: int = 1) -> str:
    return f"(-({below(f'-({x})', steps)}))"


def margins(rel: float, holed: bool = False) -> str:
    """Line items with the bounds of their margin, verdict and criticality."""
    lo, hi = (f"CAST('{1 + s * rel!r}' AS DOUBLE)" for s in (-1, 1))
    box = f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * {lo} AS p0, l_extendedprice * {hi} AS p1, l_quantity * {lo} AS q0, l_quantity * {hi} AS q1 FROM lineitem"
    keys = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
    # Prices and quantities are positive, so the ends of products and quotients are known.
    if holed:  # a factor in [1400, 1600] over the ratio of price and quantity
        ratio = f"SELECT {keys}, {below('p0 / q1')} AS r0, {above('p1 / q0')} AS r1 FROM ({box}) AS b"
        quotient = f"SELECT {keys}, {below('1400 / r1')} AS v0, {above('1600 / r0')} AS v1, CAST(100 AS DOUBLE) AS residual FROM ({ratio}) AS r"
    else:
        load = f"SELECT {keys}, p0, p1, {below('1500 * q0')} AS d0, {above('1500 * q1')} AS d1 FROM ({box}) AS b"
        quotient = f"SELECT {keys}, {below('p0 / d1')} AS v0, {above('p1 / d0')} AS v1, CAST(0 AS DOUBLE) AS residual FROM ({load}) AS r"
    bounds = f"SELECT {keys}, {below('v0 - 1')} AS ms_lo, {above('v1 - 1')} AS ms_hi, residual FROM ({quotient}) AS q"
    verdict = "CASE WHEN ms_lo - residual > 0 THEN 'SAFE' WHEN ms_hi + residual < 0 THEN 'FAIL' ELSE 'ABSTAIN' END"
    return f"(SELECT *, {verdict} AS verdict, 1 / (1 + exp(3 * (ms_lo - residual) / (ms_hi - ms_lo + residual + 1e-12))) AS cs FROM ({bounds}) AS m)"


_PRODUCTS = "[a_lo * b_lo, a_lo * b_hi, a_hi * b_lo, a_hi * b_hi]"
_QUOTIENTS = "[a_lo / nullif(b_lo, 0), a_lo / nullif(b_hi, 0), a_hi / nullif(b_lo, 0), a_hi / nullif(b_hi, 0)]"
_ACROSS = "b_lo <= 0 AND b_hi >= 0"
_A_ACROSS = "a_lo <= 0 AND a_hi >= 0"
#: Squares are exact here, as sizes and quarters are small.
_NEAR, _FAR = "CASE WHEN a_lo >= 0 THEN a_lo * a_lo WHEN a_hi <= 0 THEN a_hi * a_hi ELSE 0 END", "greatest(a_lo * a_lo, a_hi * a_hi)"
_TWO_PI = "(2 * pi())"


def _has(first: str, lo: str = "a_lo", hi: str = "a_hi", period: str = _TWO_PI) -> str:
    """Whether a point of a periodic set lies between two numbers."""
    return f"floor(({hi} - {first}) / {period} + 1e-10) >= ceil(({lo} - {first}) / {period} - 1e-10)"


def _exact_sum(x: str, y: str) -> str:
    """Whether a sum of multiples of a quarter and of prices is a double: by decimals of the true values."""
    return f"(({x} + {y}) - {x} = {y} AND ({x} + {y}) - {y} = {x})"


_SIMPLE = {
    "neg": ("-a_hi", "-a_lo"),
    "add": (below("a_lo + b_lo"), above("a_hi + b_hi")),
    "sub": (below("a_lo - b_hi"), above("a_hi - b_lo")),
    "mul": (below(f"list_min({_PRODUCTS})"), above(f"list_max({_PRODUCTS})")),
    "div": (f"CASE WHEN {_ACROSS} THEN -{INF} ELSE {below(f'list_min({_QUOTIENTS})')} END", f"CASE WHEN {_ACROSS} THEN {INF} ELSE {above(f'list_max({_QUOTIENTS})')} END"),
    "sqr": (f"CASE WHEN {_A_ACROSS} THEN 0 ELSE greatest(0, {below(_NEAR)}) END", above(_FAR)),
    "cube": (below("a_lo * a_lo * a_lo", 2), above("a_hi * a_hi * a_hi", 2)),
    "inverse_square": (f"CASE WHEN {_A_ACROSS} THEN -{INF} ELSE {below(f'1 / ({above(_FAR)})')} END", f"CASE WHEN {_A_ACROSS} THEN {INF} ELSE {above(f'1 / ({below(_NEAR)})')} END"),
    "abs": (f"CASE WHEN {_A_ACROSS} THEN 0 ELSE least(abs(a_lo), abs(a_hi)) END", "greatest(abs(a_lo), abs(a_hi))"),
    "hull": ("least(a_lo, b_lo)", "greatest(a_hi, b_hi)"),
    "meet": (f"CASE WHEN greatest(a_lo, b_lo) > least(a_hi, b_hi) THEN {INF} ELSE greatest(a_lo, b_lo) END", f"CASE WHEN greatest(a_lo, b_lo) > least(a_hi, b_hi) THEN -{INF} ELSE least(a_hi, b_hi) END"),
    "max": ("greatest(a_lo, b_lo)", "greatest(a_hi, b_hi)"),
    "min": ("least(a_lo, b_lo)", "least(a_hi, b_hi)"),
    "root": (f"CASE WHEN a_hi < 0 THEN {INF} ELSE sqrt(greatest(a_lo, 0)) END", f"CASE WHEN a_hi < 0 THEN -{INF} ELSE sqrt(greatest(a_hi, 0)) END"),
    "log": (f"CASE WHEN a_hi <= 0 THEN {INF} WHEN a_lo <= 0 THEN -{INF} ELSE ln(CASE WHEN a_lo > 0 THEN a_lo ELSE 1 END) END", f"CASE WHEN a_hi <= 0 THEN -{INF} ELSE ln(CASE WHEN a_hi > 0 THEN a_hi ELSE 1 END) END"),
    "exp": ("exp(c_lo)", "exp(c_hi)"),
    "sin": (f"CASE WHEN {_has('-pi() / 2')} THEN -1 ELSE least(sin(a_lo), sin(a_hi)) END", f"CASE WHEN {_has('pi() / 2')} THEN 1 ELSE greatest(sin(a_lo), sin(a_hi)) END"),
    "cos": (f"CASE WHEN {_has('pi()')} THEN -1 ELSE least(cos(a_lo), cos(a_hi)) END", f"CASE WHEN {_has('0')} THEN 1 ELSE greatest(cos(a_lo), cos(a_hi)) END"),
    "tan": ("tan(c_lo)", "tan(c_hi)"),  # the arguments stay below a pole
    "pow": (f"CASE WHEN a_hi < 0 THEN {INF} ELSE power(greatest(a_lo, 0), 1.5) END", f"CASE WHEN a_hi < 0 THEN -{INF} ELSE power(greatest(a_hi, 0), 1.5) END"),
    "ninth": ("power(c_lo, 9)", "power(c_hi, 9)"),
}


def _exact_product(x: str, y: str) -> str:
    """Whether x * y is a double, for x a small multiple of a quarter: whole numbers tell."""
    mantissa = f"CAST((CAST(CAST({y} AS BIT) AS BIGINT) & 4503599627370495) | 4503599627370496 AS HUGEINT)"
    whole = f"({mantissa} * CAST(4 * {x} AS HUGEINT))"
    return f"({x} = 0 OR {y} = 0 OR CAST(CAST({whole} AS DOUBLE) AS HUGEINT) = {whole})"


def kernels(names: list[str], digits: int | None, operands: str) -> str:
    ends, shown = [], []
    for k in names:
        if k in _SIMPLE:
            lo, hi = _SIMPLE[k]
        elif k == "exact_add":  # a sum is exact if taking either part away gives back the other
            lo = f"CASE WHEN {_exact_sum('a_lo', 'b_lo')} THEN a_lo + b_lo ELSE {below('a_lo + b_lo')} END"
            hi = f"CASE WHEN {_exact_sum('a_hi', 'b_hi')} THEN a_hi + b_hi ELSE {above('a_hi + b_hi')} END"
        else:
            pairs = [(x, y) for x in ("a_lo", "a_hi") for y in ("b_lo", "b_hi")]
            lo = "least(" + ", ".join(f"CASE WHEN {_exact_product(x, y)} THEN {x} * {y} ELSE {below(f'{x} * {y}')} END" for x, y in pairs) + ")"
            hi = "greatest(" + ", ".join(f"CASE WHEN {_exact_product(x, y)} THEN {x} * {y} ELSE {above(f'{x} * {y}')} END" for x, y in pairs) + ")"
        ends.append(f"CAST({lo} AS DOUBLE) AS {k}_lo, CAST({hi} AS DOUBLE) AS {k}_hi")
        for side in ("lo", "hi"):
            finite = f"CASE WHEN {k}_{side} = 0 THEN CAST(0 AS DOUBLE) WHEN abs({k}_{side}) < {INF} THEN {k}_{side} END"
            shown.append(f"{finite if digits is None else f'round({finite}, {digits})'} AS {k}_{side}")
    which = ", ".join(f"CASE WHEN abs({k}_{s}) = {INF} THEN '{k}_{s}' || CASE WHEN {k}_{s} > 0 THEN '+' ELSE '-' END END" for k in names for s in ("lo", "hi"))
    return f"SELECT p_partkey, {', '.join(shown)}, concat_ws(' ', {which}) AS infinite FROM (SELECT p_partkey, {', '.join(ends)} FROM {operands} AS o) AS k"
