"""Dimensions, units, and solving for unknown dimensions over the integers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("kg", "m", "s", "A", "K", "mol", "cd")


def dim_mul(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def dim_div(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dim_pow(a: Column, n: int) -> Column:
    return F.transform(a, lambda x: x * n)


def compatible(a: Column, b: Column) -> Column:
    return a == b


def dim_text(a: Column) -> Column:
    """Like kg*m*s^-2; 1 for no dimension."""
    parts = F.filter(
        F.array(*(F.when(a[i] == 0, F.lit("")).when(a[i] == 1, F.lit(name)).otherwise(F.concat(F.lit(f"{name}^"), a[i].cast("string"))) for i, name in enumerate(BASE))),
        lambda x: x != "",
    )
    return F.when(F.size(parts) == 0, F.lit("1")).otherwise(F.array_join(parts, "*"))


def to_si(df: DataFrame, units: DataFrame, value: str, unit: str) -> DataFrame:
    """Add ``si``: value * scale + offset of the row's unit; null for unknown units."""
    return df.join(_named(units, unit), unit, "left").withColumn("si", F.col(value) * F.col("scale") + F.col("offset")).drop("scale", "offset")


def from_si(df: DataFrame, units: DataFrame, value: str, unit: str) -> DataFrame:
    """Add ``own``: the SI value in the row's unit, (value - offset) / scale; null for unknown units and scale 0."""
    own = F.when(F.col("scale") != 0, (F.col(value) - F.col("offset")) / F.col("scale"))
    return df.join(_named(units, unit), unit, "left").withColumn("own", own).drop("scale", "offset")


def _named(units: DataFrame, unit: str) -> DataFrame:
    return units.select(F.col("name").alias(unit), "scale", "offset")


def smith(a: list[list[int]]) -> tuple[list[list[int]], list[list[int]], list[list[int]], int]:
    """U, D, V with U*A*V = D diagonal, each entry dividing the next; and the rank. Whole numbers of any size."""
    rows, cols = len(a), len(a[0]) if a else 0
    d = [list(r) for r in a]
    u = [[int(i == j) for j in range(rows)] for i in range(rows)]
    v = [[int(i == j) for j in range(cols)] for i in range(cols)]

    def add_row(i, j, k):
        for m in (d, u):
            m[i] = [x + k * y for x, y in zip(m[i], m[j])]

    def add_col(i, j, k):
        for m in (d, v):
            for r in m:
                r[i] += k * r[j]

    def swap_rows(i, j):
        for m in (d, u):
            m[i], m[j] = m[j], m[i]

    def swap_cols(i, j):
        for m in (d, v):
            for r in m:
                r[i], r[j] = r[j], r[i]

    t = 0
    while t < min(rows, cols):
        least = min(((abs(d[i][j]), i, j) for i in range(t, rows) for j in range(t, cols) if d[i][j]), default=None)
        if least is None:
            break
        swap_rows(t, least[1])
        swap_cols(t, least[2])
        clean = True
        for i in range(t + 1, rows):
            if d[i][t]:
                add_row(i, t, -(d[i][t] // d[t][t]))
                clean &= d[i][t] == 0
        for j in range(t + 1, cols):
            if d[t][j]:
                add_col(j, t, -(d[t][j] // d[t][t]))
                clean &= d[t][j] == 0
        if not clean:
            continue
        odd = next((i for i in range(t + 1, rows) for j in range(t + 1, cols) if d[i][j] % d[t][t]), None)
        if odd is not None:
            add_row(t, odd, 1)
            continue
        if d[t][t] < 0:
            d[t] = [-x for x in d[t]]
            u[t] = [-x for x in u[t]]
        t += 1
    return u, d, v, t


@dataclass
class Inferred:
    dims: dict[str, tuple[int, ...] | None]  # None: under-determined
    consistent: bool
    clashes: list[int]


def infer(known: dict[str, tuple[int, ...]], constraints: list[dict[str, int]]) -> Inferred:
    """Solve sum(coefficient * dim(symbol)) = 0 for the unknown symbols.

    Unknowns that the constraints leave open are None; constraints that no
    integer dimensions satisfy are named by their place.
    """
    unknown = sorted({s for c in constraints for s in c} - set(known))
    clashes = []
    rows, rhs = [], []
    for k, c in enumerate(constraints):
        right = [-sum(n * known[s][b] for s, n in c.items() if s in known) for b in range(len(BASE))]
        left = [c.get(s, 0) for s in unknown]
        if not any(left):
            if any(right):
                clashes.append(k)
            continue
        rows.append(left)
        rhs.append(right)
    dims: dict[str, tuple[int, ...] | None] = dict(known)
    ok = not clashes
    if unknown and rows:
        u, d, v, rank = smith(rows)
        solution = [[0] * len(BASE) for _ in unknown]
        y = [[0] * len(BASE) for _ in unknown]
        for b in range(len(BASE)):
            right = [sum(u[i][j] * rhs[j][b] for j in range(len(rows))) for i in range(len(rows))]
            for i in range(len(rows)):
                if i < rank:
                    if right[i] % d[i][i]:
                        ok = False
                    y[i][b] = right[i] // d[i][i]
                elif right[i]:
                    ok = False
        for i in range(len(unknown)):
            for b in range(len(BASE)):
                solution[i][b] = sum(v[i][j] * y[j][b] for j in range(len(unknown)))
        for i, s in enumerate(unknown):
            free = any(v[i][j] for j in range(rank, len(unknown)))
            dims[s] = None if free or not ok else tuple(solution[i])
    else:
        dims |= {s: None for s in unknown}
    return Inferred(dims, ok, clashes)
