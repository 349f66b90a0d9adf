"""Workbook scans over workbooks that Spark makes of the given tables, with their SQL twins."""

from __future__ import annotations

import functools
import io
import itertools
import struct
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..ship import ship
from ..sources import workbook
from .catalogue import big, query, r, table

_ROW = np.dtype([("kind", "u1"), ("size", "u1"), ("row", "<u4"), ("rest", "V13")])
_CELL = np.dtype([("kind", "u1"), ("size", "u1"), ("col", "<u4"), ("style", "<u4"), ("value", "<f8")])


@functools.cache
def _line(columns: int) -> np.dtype:
    return np.dtype([("head", _ROW), *((f"c{i}", _CELL) for i in range(columns))])


def binary_book(columns: list[np.ndarray]) -> bytes:
    """A binary workbook with one sheet of numbers, one record for each row and cell."""
    n = len(columns[0])
    out = np.zeros(n, _line(len(columns)))
    out["head"]["size"], out["head"]["row"] = 17, np.arange(n)
    for i, values in enumerate(columns):
        cell = out[f"c{i}"]
        cell["kind"], cell["size"], cell["col"], cell["value"] = 5, 16, i, values
    wide = lambda t: struct.pack("<I", len(t)) + t.encode("utf-16-le")
    sheet = b"\0" * 8 + wide("rId1") + wide("Data")
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("xl/workbook.bin", b"\x9c\x01" + bytes([len(sheet)]) + sheet, zipfile.ZIP_STORED)
        z.writestr("xl/_rels/workbook.bin.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.bin"/></Relationships>', zipfile.ZIP_STORED)
        z.writestr("xl/worksheets/sheet1.bin", out.tobytes())
    return file.getvalue()


def books(spark, sf_dir):
    """(path, content): line items as binary workbooks, one for each supplier and 20 000 orders."""
    ship(spark)
    name = F.concat_ws("-", F.col("l_suppkey"), F.floor(F.col("l_orderkey") / 20_000))
    li = table(spark, sf_dir, "lineitem").select(name.alias("path"), *(F.col(c).cast("double").alias(c) for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")))
    # A call for each group would cost more than its workbook, so sorted rows are cut where the path changes.
    ordered = li.repartition("path").sortWithinPartitions("path")

    def make(found):
        name, held = None, []

        def book() -> bytes:
            key, line, quantity, price = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((price, line, key))
            return binary_book([c[order] for c in (key, line, quantity, price)])

        for batch in found:
            paths, values, made = batch.column(0), [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], []
            cuts = np.flatnonzero(np.diff(paths.dictionary_encode().indices.to_numpy())) + 1
            for start, end in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
                if start == end:
                    continue
                path = paths[start].as_py()
                if held and path != name:
                    made.append((name, book()))
                    held = []
                name = path
                held.append([v[start:end] for v in values])
            if made:
                yield _files(made)
        if held:
            yield _files([(name, book())])

    return ordered.mapInArrow(make, "path string, content binary")


def _files(made: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.binary())], names=["path", "content"])


@query("""SELECT l_suppkey || '-' || CAST(l_orderkey // 20000 AS BIGINT) AS workbook, count(*) * 4 AS cells, count(*) AS rows_used, CAST(max(nth) - 1 AS BIGINT) AS last_row, round(sum(l_extendedprice), 2) AS price, CAST(sum(l_linenumber) AS BIGINT) AS lines
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_orderkey // 20000 ORDER BY l_orderkey) AS nth FROM lineitem) AS x GROUP BY 1""")
def workbook_scan(spark, sf_dir):
    """Every cell of every workbook, read through the binary reader."""
    cells = workbook.scan(books(spark, sf_dir), columns=["workbook", "row", "col", "value"])
    of = lambda i: F.when(F.col("col") == i, F.col("value"))
    return cells.groupBy("workbook").agg(
        F.count("*").alias("cells"), F.countDistinct("row").alias("rows_used"), big(F.max("row")).alias("last_row"), r(F.sum(of(3)), 2).alias("price"), F.sum(of(1)).cast("long").alias("lines")
    )
