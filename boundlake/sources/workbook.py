"""Spreadsheet files as tables: a Python data source over .xlsx, .xlsm and .xlsb.

``spark.read.format("workbook").load(path)`` gives one row for each cell:
(workbook, sheet_idx, sheet, row, col, has_value, value, text, formula), rows
and columns counted from 0. Sheets are streamed part by part, so memory follows
the shared strings and one row, not the file. Shared formulas keep the text of
their first cell; cells with an error value are NaN.
"""

from __future__ import annotations

import io
import itertools
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.formula import parse_a1
from ..ship import ship

SCHEMA = "workbook string, sheet_idx int, sheet string, row int, col int, has_value boolean, value double, text string, formula string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _stream(archive: zipfile.ZipFile, name: str) -> Iterator:
    with archive.open(name) as part:
        yield from ElementTree.iterparse(part, events=("end",))


def _relations(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, file = part.rpartition("/")
    name = f"{folder}/_rels/{file}.rels"
    if name not in archive.namelist():
        return {}
    out = {}
    for e in ElementTree.fromstring(archive.read(name)).iter():
        if _local(e.tag) == "Relationship":
            target = e.get("Target", "")
            out[e.get("Id")] = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}"
    return out


def _texts(element) -> str:
    return "".join(t.text or "" for t in element.iter() if _local(t.tag) == "t")


def xlsx_cells(archive: zipfile.ZipFile, name: str) -> Iterator[tuple]:
    strings = []
    if "xl/sharedStrings.xml" in archive.namelist():
        for _, e in _stream(archive, "xl/sharedStrings.xml"):
            if _local(e.tag) == "si":
                strings.append(_texts(e))
                e.clear()
    relations, sheets = _relations(archive, "xl/workbook.xml"), []
    for _, e in _stream(archive, "xl/workbook.xml"):
        if _local(e.tag) == "sheet":
            key = next((v for k, v in e.attrib.items() if _local(k) == "id"), "")
            sheets.append((e.get("name"), relations.get(key, "")))
    for index, (sheet, part) in enumerate(sheets):
        if part not in archive.namelist():
            continue
        shared: dict[str, str] = {}
        for _, e in _stream(archive, part):
            if _local(e.tag) == "row":
                e.clear()
            if _local(e.tag) != "c":
                continue
            _, row, col = parse_a1(e.get("r"))
            kind, value, text, formula, has = e.get("t", "n"), None, None, None, False
            for child in e:
                tag = _local(child.tag)
                if tag == "f":
                    formula = child.text or shared.get(child.get("si", ""))
                    if child.get("si") and child.text:
                        shared[child.get("si")] = child.text
                elif tag == "v" and child.text is not None:
                    has = True
                    if kind == "s":
                        text = strings[int(child.text)]
                    elif kind in ("str", "inlineStr"):
                        text = child.text
                    else:
                        value = float("nan") if kind == "e" else float(child.text)
                elif tag == "is":
                    has, text = True, _texts(child)
            yield (name, index, sheet, row, col, has, value, text, formula)
            e.clear()


def _records(stream) -> Iterator[tuple[int, bytes]]:
    """BIFF12 records: a type and a length of one to two and one to four bytes, then the payload."""
    while first := stream.read(1):
        kind = first[0]
        if kind & 0x80:
            kind = (kind & 0x7F) | (stream.read(1)[0] & 0x7F) << 7
        size = shift = 0
        for _ in range(4):
            byte = stream.read(1)[0]
            size |= (byte & 0x7F) << shift
            shift += 7
            if not byte & 0x80:
                break
        yield kind, stream.read(size)


def _wide(data: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", data, at)[0]
    return data[at + 4 : at + 4 + 2 * n].decode("utf-16-le"), at + 4 + 2 * n


def _rk(raw: int) -> float:
    value = float((raw if raw < 1 << 31 else raw - (1 << 32)) >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


def _xlsb_parts(archive: zipfile.ZipFile) -> tuple[list[str], list[tuple[str, str]]]:
    """Shared strings, and (name, part) of each sheet that is there."""
    strings, sheets, there = [], [], set(archive.namelist())
    if "xl/sharedStrings.bin" in there:
        with archive.open("xl/sharedStrings.bin") as part:
            strings = [_wide(data, 1)[0] for kind, data in _records(io.BufferedReader(part)) if kind == 19]
    relations = _relations(archive, "xl/workbook.bin")
    with archive.open("xl/workbook.bin") as part:
        for kind, data in _records(io.BufferedReader(part)):
            if kind == 156:
                key, at = _wide(data, 8)
                sheets.append((_wide(data, at)[0], relations.get(key, "")))
    return strings, [x for x in sheets if x[1] in there]


def xlsb_cells(archive: zipfile.ZipFile, name: str) -> Iterator[tuple]:
    """Values of a binary workbook; formulas are marked by an empty text, their cached values are kept."""
    strings, sheets = _xlsb_parts(archive)
    for index, (sheet, target) in enumerate(sheets):
        row = 0
        with archive.open(target) as part:
            for kind, data in _records(io.BufferedReader(part)):
                if kind == 0:
                    row = struct.unpack_from("<I", data)[0]
                elif 1 <= kind <= 11 and len(data) >= 8:
                    col = struct.unpack_from("<I", data)[0]
                    value = text = None
                    if kind == 2:
                        value = _rk(struct.unpack_from("<I", data, 8)[0])
                    elif kind in (3, 11):
                        value = float("nan")
                    elif kind in (4, 10):
                        value = float(data[8])
                    elif kind in (5, 9):
                        value = struct.unpack_from("<d", data, 8)[0]
                    elif kind in (6, 8):
                        text = _wide(data, 8)[0]
                    elif kind == 7:
                        text = strings[struct.unpack_from("<I", data, 8)[0]]
                    yield (name, index, sheet, row, col, kind != 1, value, text, "" if kind >= 8 else None)


#: Bytes of a decompressed sheet that are decoded at a time, and cells in an Arrow batch at most.
CHUNK, BATCH = 4 << 20, 65_536
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
KINDS = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.string(), pa.string()]


def _places(data: bytes, found: list[int]) -> int:
    """Append 16 * payload place + kind of every row and cell record; gives the place of the first record that is not whole."""
    p, n, add = 0, len(data), found.append
    while p + 1 < n:
        q, kind = p + 1, data[p]
        if kind & 0x80:
            kind = (kind & 0x7F) | (data[q] & 0x7F) << 7
            q += 1
            if q >= n:
                break
        size = data[q]
        q += 1
        if size & 0x80:
            size, shift = size & 0x7F, 7
            while shift < 28:
                if q >= n:
                    return p
                byte = data[q]
                q += 1
                size |= (byte & 0x7F) << shift
                shift += 7
                if not byte & 0x80:
                    break
        if q + size > n:
            break
        if kind < 12 and (size >= 8 or kind == 0 and size >= 4):
            add(q << 4 | kind)
        p = q + size
    return p


def _words(raw: np.ndarray, at: np.ndarray, dtype: str) -> np.ndarray:
    """Little-endian values at any places of a buffer."""
    size = np.dtype(dtype).itemsize
    return np.ndarray((max(0, len(raw) - size + 1),), dtype, raw, 0, (1,))[at]


def _among(*kinds: int) -> np.ndarray:
    found = np.zeros(16, bool)
    found[list(kinds)] = True
    return found


#: Kinds of cell records by what they hold; looked up by the kind.
KNOWN, FLAGS, REALS, ERRORS, OWN = _among(2, 3, 4, 5, 9, 10, 11), _among(4, 10), _among(5, 9), _among(3, 11), _among(6, 8)


def xlsb_batches(archive: zipfile.ZipFile, name: str, columns: list[str] = NAMES) -> Iterator[pa.RecordBatch]:
    """The named columns of the rows of :func:`xlsb_cells`, decoded a chunk of a sheet at a time."""
    strings, sheets = _xlsb_parts(archive)
    table = pa.array(strings, pa.string())
    for index, (sheet, target) in enumerate(sheets):
        row, rest = 0, b""
        with archive.open(target) as part:
            while more := part.read(CHUNK):
                data, found = rest + more, []
                rest = data[_places(data, found) :]
                if not found:
                    continue
                raw, place = np.frombuffer(data, np.uint8), np.array(found, np.int64)
                kind, place = place & 15, place >> 4
                head = np.maximum.accumulate(np.where(kind == 0, np.arange(len(kind)), -1))
                starts = np.flatnonzero(kind == 0)
                numbers = np.zeros(len(kind), np.int64)
                numbers[starts] = _words(raw, place[starts], "<u4")
                rows = np.where(head >= 0, numbers[head], row)
                row = int(rows[-1])
                cell = kind != 0
                kind, place, rows = kind[cell], place[cell], rows[cell]
                for i in range(0, len(kind), BATCH):
                    yield _xlsb_batch(raw, data, kind[i : i + BATCH], place[i : i + BATCH], rows[i : i + BATCH], table, name, index, sheet, columns)


def _xlsb_batch(raw, data, kind, place, rows, strings, name, index, sheet, columns) -> pa.RecordBatch:
    n = len(kind)

    def value():
        value, packed = np.zeros(n), kind == 2
        if packed.any():
            bits = _words(raw, place[packed] + 8, "<u4").astype(np.int64)
            whole = (bits.astype(np.uint32).view(np.int32) >> 2).astype(np.float64)
            double = ((bits & 0xFFFFFFFC) << 32).view(np.float64)
            out = np.where(bits & 2, whole, double)
            with np.errstate(invalid="ignore"):
                value[packed] = np.where(bits & 1, out / 100, out)
        value[ERRORS[kind]] = np.nan
        flag, real = FLAGS[kind], REALS[kind]
        value[flag] = raw[place[flag] + 8]
        value[real] = _words(raw, place[real] + 8, "<f8")
        return pa.array(value, mask=~KNOWN[kind])

    def text():
        at, shared, own, known = np.zeros(n, np.int64), kind == 7, OWN[kind], strings
        at[shared] = _words(raw, place[shared] + 8, "<u4")
        if own.any():
            at[own] = len(known) + np.arange(np.count_nonzero(own))
            known = pa.concat_arrays([known, pa.array([_wide(data, p + 8)[0] for p in place[own].tolist()], pa.string())])
        return known.take(pa.array(at, mask=~(shared | own))) if len(known) else pa.nulls(n, pa.string())

    make = {
        "workbook": lambda: pa.repeat(pa.scalar(name, pa.string()), n), "sheet_idx": lambda: pa.repeat(pa.scalar(index, pa.int32()), n), "sheet": lambda: pa.repeat(pa.scalar(sheet, pa.string()), n),
        "row": lambda: pa.array(rows.astype(np.int32)), "col": lambda: pa.array(_words(raw, place, "<u4").astype(np.int32)), "has_value": lambda: pa.array(kind != 1), "value": value, "text": text,
        "formula": lambda: pa.array([""]).take(pa.array(np.zeros(n, np.int64), mask=kind < 8)),
    }
    return pa.RecordBatch.from_arrays([make[c]() for c in columns], names=columns)


def batches(data: bytes, name: str, columns: list[str] = NAMES) -> Iterator[pa.RecordBatch]:
    """Cells of a workbook file as Arrow batches of the named columns; a broken file has none."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return
    with archive:
        if "xl/workbook.bin" in archive.namelist():
            yield from xlsb_batches(archive, name, columns)
            return
        rows = xlsx_cells(archive, name) if "xl/workbook.xml" in archive.namelist() else iter(())
        while some := list(itertools.islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), KINDS)], names=NAMES).select(columns)


def _joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with small batches put together, up to ``BATCH`` rows; many small workbooks would be as many batches."""
    held, n = [], 0
    for part in parts:
        if held and n + part.num_rows > BATCH:
            yield pa.concat_batches(held)
            held, n = [], 0
        held.append(part)
        n += part.num_rows
    if held:
        yield pa.concat_batches(held)


def cells(data: bytes, name: str) -> Iterator[tuple]:
    """Cells of a workbook file by its contents; a broken file has none."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return
    with archive:
        names = set(archive.namelist())
        if "xl/workbook.bin" in names:
            yield from xlsb_cells(archive, name)
        elif "xl/workbook.xml" in names:
            yield from xlsx_cells(archive, name)


def statistics(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, cells, max_row, rows_used, total) of every sheet."""
    from pyspark.sql import functions as F

    return cells.groupBy("workbook", "sheet").agg(F.count("*").alias("cells"), F.max("row").alias("max_row"), F.countDistinct("row").alias("rows_used"), F.sum("value").alias("total"))


def defined_names(data: bytes) -> list[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        return [(e.get("name"), e.text) for _, e in _stream(archive, "xl/workbook.xml") if _local(e.tag) == "definedName"]


def images(data: bytes) -> list[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        return [(n, archive.read(n)) for n in sorted(archive.namelist()) if n.startswith("xl/media/")]


def read(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Cells of every workbook under a path, through Spark's own listing and readers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.xls[xmb]").load(path)
    return scan(files)


def scan(files: DataFrame, path: str = "path", content: str = "content", columns: list[str] = NAMES) -> DataFrame:
    """Cells of every workbook in a table of file contents; null contents and broken files have none.

    Only the named columns are decoded.
    """
    ship(files.sparkSession)
    kinds = dict(x.split() for x in SCHEMA.split(", "))

    def cells(found):
        for batch in found:
            for i in range(batch.num_rows):
                if batch.column(1)[i].is_valid:
                    yield from batches(batch.column(1)[i].as_py(), batch.column(0)[i].as_py(), columns)

    return files.select(path, content).mapInArrow(lambda found: _joined(cells(found)), ", ".join(f"{c} {kinds[c]}" for c in columns))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "**", "*.xls[xmb]"), recursive=True)) if os.path.isdir(self.path) else [self.path]
        return [_File(p) for p in found]

    def read(self, partition):
        with open(partition.path, "rb") as file:
            yield from cells(file.read(), partition.path)


class WorkbookSource(DataSource):
    """``spark.dataSource.register(WorkbookSource)``: local or mounted paths; ``read`` takes any store."""

    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])
