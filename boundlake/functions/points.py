"""Spreadsheet functions on numbers, as columns. A failed computation is NaN.

Arrays stand for ranges; blank and text cells are 0 before they get here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def _num(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def _clean(a: Column) -> Column:
    return F.filter(a, lambda x: ~F.isnan(x) & x.isNotNull())


def _or_nan(x: Column) -> Column:
    return F.coalesce(x, nan())


def divide(x, y) -> Column:
    x, y = _num(x), _num(y)
    return F.when(y == 0, nan()).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))


def _guarded(fn: Callable[[Column], Column], ok: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(ok(_num(x)), fn(_num(x))).otherwise(nan())


def compare(sign: str, x, y) -> Column:
    """1 or 0; every comparison with NaN is false but <>, as in IEEE."""
    x, y = _num(x), _num(y)
    either = F.isnan(x) | F.isnan(y)
    test = {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[sign]
    return F.when(either, F.lit(1.0 if sign == "<>" else 0.0)).otherwise(test.cast("double"))


def _scaled(x, digits, fn: Callable[[Column], Column]) -> Column:
    p = F.pow(F.lit(10.0), _num(digits))
    return fn(_num(x) * p) / p


def _half_away(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5).cast("double")


def _toward(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x).cast("double")).otherwise(F.floor(x).cast("double"))


def _away(x: Column) -> Column:
    return F.when(x < 0, F.floor(x).cast("double")).otherwise(F.ceil(x).cast("double"))


def _significant(x, s, fn: Callable[[Column], Column]) -> Column:
    s = _num(s)
    return F.when(s == 0, F.lit(0.0)).otherwise(fn(_num(x) / F.when(s == 0, F.lit(1.0)).otherwise(s)).cast("double") * s)


def modulo(x, y) -> Column:
    x, y = _num(x), _num(y)
    safe = F.when(y == 0, F.lit(1.0)).otherwise(y)
    return F.when(y == 0, nan()).otherwise(x - safe * F.floor(x / safe).cast("double"))


def _sum(a: Column) -> Column:
    return F.aggregate(_clean(a), F.lit(0.0), lambda s, x: s + x)


def sumproduct(*arrays: Column) -> Column:
    """Products by position; a row with a missing or failed part is skipped."""
    zipped = F.arrays_zip(*(a.alias(f"c{i}") for i, a in enumerate(arrays)))

    def product(row: Column) -> Column:
        out = F.lit(1.0)
        for i in range(len(arrays)):
            out = out * row[f"c{i}"]
        return F.coalesce(out, nan())

    return _sum(F.transform(zipped, product))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "SUM": _sum,
    "AVERAGE": lambda a: F.when(F.size(_clean(a)) == 0, nan()).otherwise(_sum(a) / F.greatest(F.size(_clean(a)), F.lit(1))),
    "COUNT": lambda a: F.size(_clean(a)).cast("double"),
    "PRODUCT": lambda a: F.aggregate(_clean(a), F.lit(1.0), lambda s, x: s * x),
    "SUMSQ": lambda a: F.aggregate(_clean(a), F.lit(0.0), lambda s, x: s + x * x),
    "MIN": lambda a: _or_nan(F.array_min(_clean(a))),
    "MAX": lambda a: _or_nan(F.array_max(_clean(a))),
    "SUMPRODUCT": sumproduct,
    "ABS": lambda x: F.abs(_num(x)),
    "SQRT": _guarded(F.sqrt, lambda x: x >= 0),
    "EXP": lambda x: F.exp(_num(x)),
    "LN": _guarded(F.ln, lambda x: x > 0),
    "LOG10": _guarded(F.log10, lambda x: x > 0),
    "LOG": lambda x, base=10.0: F.when((_num(x) > 0) & (_num(base) > 0) & (_num(base) != 1), F.ln(F.greatest(_num(x), F.lit(1e-323))) / F.ln(F.greatest(_num(base), F.lit(1e-323)))).otherwise(nan()),
    "SIN": lambda x: F.sin(_num(x)), "COS": lambda x: F.cos(_num(x)), "TAN": lambda x: F.tan(_num(x)),
    "ASIN": lambda x: F.asin(_num(x)), "ACOS": lambda x: F.acos(_num(x)), "ATAN": lambda x: F.atan(_num(x)),
    "SINH": lambda x: F.sinh(_num(x)), "COSH": lambda x: F.cosh(_num(x)), "TANH": lambda x: F.tanh(_num(x)),
    "ATAN2": lambda x, y: F.atan2(_num(y), _num(x)),
    "DEGREES": lambda x: F.degrees(_num(x)), "RADIANS": lambda x: F.radians(_num(x)), "PI": lambda: F.lit(3.141592653589793), "POWER": lambda x, y: F.pow(_num(x), _num(y)),
    "MOD": modulo,
    "INT": lambda x: F.floor(_num(x)).cast("double"), "TRUNC": lambda x, n=0: _scaled(x, n, _toward), "SIGN": lambda x: F.signum(_num(x)),
    "FLOOR": lambda x, s: _significant(x, s, F.floor), "CEILING": lambda x, s: _significant(x, s, F.ceil),
    "ROUND": lambda x, n=0: _scaled(x, n, _half_away), "ROUNDUP": lambda x, n=0: _scaled(x, n, _away), "ROUNDDOWN": lambda x, n=0: _scaled(x, n, _toward),
    "IF": lambda c, t, e=0.0: F.when(_num(c) != 0, _num(t)).otherwise(_num(e)),
    "IFERROR": lambda x, y: F.nanvl(_num(x), _num(y)),
    "AND": lambda *xs: F.array_min(F.array(*((_num(x) != 0) for x in xs))).cast("double"),
    "OR": lambda *xs: F.array_max(F.array(*((_num(x) != 0) for x in xs))).cast("double"),
    "NOT": lambda x: (_num(x) == 0).cast("double"),
}


def compile_formula(x, cell: Callable[[str], Column]) -> Column:
    """A parsed formula (``functions.formula``) as a column; ``cell`` gives the column of a reference or name."""
    from .formula import a1, cells_of

    def of(node) -> Column:
        if node.kind == "num":
            return F.lit(float(node.value))
        if node.kind == "cell":
            return _num(cell(a1(node.value[1], node.value[2])))
        if node.kind == "name":
            return _num(cell(str(node.value)))
        if node.kind == "un":
            v = of(node.args[0])
            return {"-": -v, "+": v, "%": v / 100}[node.value]
        if node.kind == "bin":
            if node.value == "&":
                return nan()
            a, b = map(of, node.args)
            if node.value in ("=", "<>", "<", ">", "<=", ">="):
                return compare(node.value, a, b)
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: divide(a, b), "^": lambda: F.pow(a, b)}[node.value]()
        if node.kind == "call" and node.value in FUNCTIONS:
            fn = FUNCTIONS[node.value]
            if node.value in ("SUM", "AVERAGE", "COUNT", "PRODUCT", "SUMSQ", "MIN", "MAX"):
                return fn(F.array(*(v for a in node.args for v in spread(a))))
            if node.value == "SUMPRODUCT":
                return fn(*(F.array(*spread(a)) for a in node.args))
            return fn(*map(of, node.args))
        return nan()

    def spread(node) -> list[Column]:
        if node.kind == "range":
            return [_num(cell(a1(r, c))) for _, r, c in cells_of(node, "")]
        return [of(node)]

    return of(x)
