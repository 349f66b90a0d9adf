"""Whole workbooks: evaluation, sensitivities, margin targets, programs of formula cells.

Cells come as one table (workbook, sheet, row, col, value, text, formula); each
workbook is evaluated by one task, as its cells depend on each other. Limits on
cells and evaluations bound that task; a workbook beyond them is reported.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formula as fm
from ..functions import program as pg
from ..ship import ship

MAX_CELLS, MAX_EVALUATIONS, MAX_DEPTH = 100_000, 2_000_000, 256
NAN = float("nan")


def _safe(fn):
    def run(*args):
        try:
            return float(fn(*args))
        except (ValueError, ZeroDivisionError, OverflowError, TypeError):
            return NAN

    return run


def _half_away(x: float) -> float:
    return math.copysign(math.floor(abs(x) + 0.5), x)


def _numbers(values: list[float]) -> list[float]:
    return [x for x in values if not math.isnan(x)]


_OVER_RANGES = {
    "SUM": sum, "AVERAGE": lambda v: sum(v) / len(v), "COUNT": len, "PRODUCT": math.prod, "SUMSQ": lambda v: sum(x * x for x in v), "MIN": min, "MAX": max,
}
_SCALAR = {
    "ABS": abs, "SQRT": math.sqrt, "EXP": math.exp, "LN": math.log, "LOG10": math.log10, "LOG": lambda x, b=10.0: math.log(x) / math.log(b), "SIN": math.sin, "COS": math.cos, "TAN": math.tan, "ASIN": math.asin, "ACOS": math.acos,
    "ATAN": math.atan, "SINH": math.sinh, "COSH": math.cosh, "TANH": math.tanh, "ATAN2": lambda x, y: math.atan2(y, x), "DEGREES": math.degrees, "RADIANS": math.radians, "PI": lambda: math.pi, "POWER": math.pow,
    "MOD": lambda x, y: x - y * math.floor(x / y), "INT": math.floor, "TRUNC": lambda x, n=0.0: math.trunc(x * 10**n) / 10**n, "SIGN": lambda x: (x > 0) - (x < 0), "FLOOR": lambda x, s: math.floor(x / s) * s if s else 0.0,
    "CEILING": lambda x, s: math.ceil(x / s) * s if s else 0.0, "ROUND": lambda x, n=0.0: _half_away(x * 10**n) / 10**n, "ROUNDUP": lambda x, n=0.0: math.copysign(math.ceil(abs(x * 10**n)), x) / 10**n,
    "ROUNDDOWN": lambda x, n=0.0: math.trunc(x * 10**n) / 10**n, "IF": lambda c, t, e=0.0: t if c != 0 else e, "AND": lambda *v: all(x != 0 for x in v), "OR": lambda *v: any(x != 0 for x in v), "NOT": lambda x: x == 0,
}
_COMPARE = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
_ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "^": math.pow}


class Workbook:
    """One workbook's formulas and numbers; blank and text cells count as 0, failures are NaN."""

    def __init__(self, cells: pd.DataFrame, names: dict[str, tuple[str, int, int]] | None = None):
        self.numbers: dict[tuple, float] = {}
        self.formulas: dict[tuple, fm.X | None] = {}
        self.texts: dict[tuple, str] = {}
        self.names = names or {}
        for sheet, row, col, value, text, formula in zip(cells["sheet"], cells["row"], cells["col"], cells["value"], cells["text"], cells["formula"]):
            key = (sheet, int(row), int(col))
            if isinstance(formula, str) and formula:
                self.texts[key] = formula
                try:
                    self.formulas[key] = fm.parse(formula)
                except ValueError:
                    self.formulas[key] = None
            elif value is not None and not pd.isna(value):
                self.numbers[key] = float(value)
        self.inputs = sorted({c for k, x in self.formulas.items() if x for r in fm.references(x) for c in self.cells(r, k[0])} & set(self.numbers))

    def cells(self, ref: fm.X, sheet: str) -> list[tuple]:
        if ref.kind == "name":
            at = self.names.get(str(ref.value).lower())
            return [at] if at else []
        return fm.cells_of(ref, sheet)

    def evaluate(self, changed: dict[tuple, float] | None = None, most: int = MAX_EVALUATIONS) -> dict[tuple, float]:
        """Values of all formula cells; a cycle or a chain beyond the depth limit is NaN."""
        known: dict[tuple, float] = {}
        changed = changed or {}
        left = [most]

        def cell(key: tuple, depth: int) -> float:
            if key in changed:
                return changed[key]
            if key not in self.formulas:
                return self.numbers.get(key, 0.0)
            if key not in known:
                left[0] -= 1
                if depth > MAX_DEPTH or left[0] < 0:
                    return NAN
                known[key] = NAN  # what a cycle reads
                x = self.formulas[key]
                known[key] = of(x, key[0], depth) if x else NAN
            return known[key]

        def spread(x: fm.X, sheet: str, depth: int) -> list[float]:
            return [cell(c, depth + 1) for c in self.cells(x, sheet)] if x.kind in ("range", "name") else [of(x, sheet, depth)]

        def of(x: fm.X, sheet: str, depth: int) -> float:
            if x.kind == "num":
                return x.value
            if x.kind in ("cell", "name", "range"):
                at = self.cells(x, sheet)
                return cell(at[0], depth + 1) if at else NAN
            if x.kind == "un":
                v = of(x.args[0], sheet, depth)
                return {"-": -v, "+": v, "%": v / 100}[x.value]
            if x.kind == "bin":
                if x.value == "&":
                    return NAN
                a, b = (of(y, sheet, depth) for y in x.args)
                return float(_COMPARE[x.value](a, b)) if x.value in _COMPARE else _safe(_ARITHMETIC[x.value])(a, b)
            if x.kind == "call":
                if x.value in _OVER_RANGES:
                    return _safe(_OVER_RANGES[x.value])(_numbers([v for a in x.args for v in spread(a, sheet, depth)]))
                if x.value == "SUMPRODUCT":
                    return _safe(sum)(_numbers([math.prod(r) for r in zip(*(spread(a, sheet, depth) for a in x.args))]))
                if x.value == "IFERROR" and len(x.args) == 2:
                    a, b = (of(y, sheet, depth) for y in x.args)
                    return b if math.isnan(a) else a
                if x.value in _SCALAR:
                    return _safe(_SCALAR[x.value])(*(of(y, sheet, depth) for y in x.args))
            return NAN

        for key in self.formulas:
            cell(key, 0)
        return known

    def sensitivities(self, step: float = 1e-3, least: float = 1e-7) -> Iterator[tuple[tuple, tuple, float]]:
        """(input, output, slope) wherever moving an input moves an output."""
        base = self.evaluate()
        for key in self.inputs:
            at = self.numbers[key]
            delta = step * abs(at) if abs(at) > 1 else step
            for out, value in self.evaluate({key: at + delta}).items():
                if abs(value - base[out]) > least:
                    yield key, out, (value - base[out]) / delta

    def program(self, key: tuple) -> pg.Node:
        """The program of a formula cell, inputs as variables."""
        inputs = set(self.inputs)
        return fm.Lowering(key[0], lambda k: self.texts.get(k, None if k in inputs else self.numbers.get(k, 0.0)), self.names).cell(key)


def label(key: tuple) -> str:
    return f"{key[0]}!{fm.a1(key[1], key[2])}"


def _per_workbook(cells: DataFrame, schema: str, rows) -> DataFrame:
    ship(cells.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["workbook"].iloc[0]
        found = [] if len(pdf) > MAX_CELLS else [(name, *r) for r in rows(Workbook(pdf))]
        return pd.DataFrame(found, columns=names)

    return cells.select("workbook", "sheet", "row", "col", "value", "text", "formula").groupBy("workbook").applyInPandas(run, schema)


def values(cells: DataFrame) -> DataFrame:
    """(workbook, cell, value) of every formula cell; null where it failed."""
    return _per_workbook(cells, "workbook string, cell string, value double", lambda w: [(label(k), v) for k, v in w.evaluate().items()])


def sensitivities(cells: DataFrame) -> DataFrame:
    """(workbook, src, dst, sens): measured dependency edges."""
    return _per_workbook(cells, "workbook string, src string, dst string, sens double", lambda w: [(label(a), label(b), s) for a, b, s in w.sensitivities()])


def references(cells: DataFrame) -> DataFrame:
    """(workbook, src, dst): syntactic dependency edges."""
    edges = lambda w: sorted({(label(c), label(k)) for k, x in w.formulas.items() if x for r in fm.references(x) for c in w.cells(r, k[0])})
    return _per_workbook(cells, "workbook string, src string, dst string", edges)


def programs(cells: DataFrame) -> DataFrame:
    """Program rows of every margin target: formula cells that no other formula reads."""

    def rows(w: Workbook):
        read = {c for k, x in w.formulas.items() if x for r in fm.references(x) for c in w.cells(r, k[0])}
        for key in w.formulas:
            if key not in read:
                yield from (r for r in pg.rows(label(key), w.program(key)))

    return _per_workbook(cells, "workbook string, " + pg.ROW_SCHEMA, rows)


def oversized(cells: DataFrame) -> DataFrame:
    """Workbooks with more cells than one task takes."""
    return cells.groupBy("workbook").agg(F.count("*").alias("cells")).where(F.col("cells") > MAX_CELLS)


def lattice_strings(lattice: DataFrame, width: int = 8, floor: float = 1e-4) -> DataFrame:
    """(image_id, text, conf): the best readings of a lattice of slots by beam search, confidences summing to 1."""

    def beam(pdf: pd.DataFrame) -> pd.DataFrame:
        paths = [("", 1.0)]
        for _, slot in sorted(pdf.groupby("slot")):
            paths = [(t + tok, c * p) for t, c in paths for tok, p in zip(slot["tok"], slot["conf"])]
            paths = sorted(paths, key=lambda x: (-x[1], x[0]))[:width]
        total = sum(c for _, c in paths) or 1.0
        kept = [(t, c / total) for t, c in paths if c / total >= floor] or paths[:1]
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]] * len(kept), "text": [t for t, _ in kept], "conf": [c for _, c in kept]})

    ship(lattice.sparkSession)
    return lattice.groupBy("image_id").applyInPandas(beam, f"image_id {dict(lattice.dtypes)['image_id']}, text string, conf double")
