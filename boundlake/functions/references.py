"""References of formulas as rows: a table function for SQL and DataFrames."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from . import formula

REFERENCE = "pos int, kind string, name string, sheet string, row0 int, col0 int, row1 int, col1 int, cells long"


@functools.lru_cache(maxsize=10_000)
def reference_rows(text: str | None) -> tuple[tuple, ...]:
    """A row for each cell, range and name of a formula in order of appearance; none for a text that is no formula."""
    try:
        found = formula.references(formula.parse(text)) if text else []
    except (ValueError, IndexError, RecursionError):
        return ()
    out = []
    for pos, x in enumerate(found):
        if x.kind == "name":
            out.append((pos, "name", str(x.value), None, None, None, None, None, None))
            continue
        first, last = (x.value, x.value) if x.kind == "cell" else x.value
        (r0, r1), (c0, c1) = sorted((first[1], last[1])), sorted((first[2], last[2]))
        out.append((pos, x.kind, None, first[0], r0, c0, r1, c1, (r1 - r0 + 1) * (c1 - c0 + 1)))
    return tuple(out)


@F.udtf(returnType=REFERENCE)
class ParseRefs:
    """``SELECT t.*, r.* FROM t, LATERAL parse_refs(t.formula) AS r``; rows and columns count from 0."""

    def eval(self, text: str):
        yield from reference_rows(text)


def register(spark: SparkSession, name: str = "parse_refs") -> None:
    """Make the table function known to SQL under a name."""
    ship(spark)
    spark.udtf.register(name, ParseRefs)


def with_references(cells: DataFrame, text: Column) -> DataFrame:
    """Each row with every reference of its formula, by a lateral join; rows without references are left out."""
    ship(cells.sparkSession)
    return cells.withColumn("_text", text).lateralJoin(ParseRefs(F.col("_text").outer())).drop("_text")
