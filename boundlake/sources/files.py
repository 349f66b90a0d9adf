"""File listings, program files and images as tables."""

from __future__ import annotations

import json
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry


def listing(spark: SparkSession, path: str, pattern: str = "*", since: str | None = None, content: bool = True) -> DataFrame:
    """(path, rel, name, size, mtime, sha256) of the files under a path; ``since`` leaves older ones out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if since:
        reader = reader.option("modifiedAfter", since)
    files = reader.load(path)
    rel = F.regexp_replace(F.col("path"), r"^.*?" + path.rstrip("/").rpartition("/")[2].replace(".", r"\.") + "/", "")
    sha = F.sha2(F.col("content"), 256) if content else F.lit(None).cast("string")
    return files.select("path", rel.alias("rel"), F.element_at(F.split(rel, "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), sha.alias("sha256"))


def catalogue(files: DataFrame) -> DataFrame:
    """Listing with revision, config key and heads: the newest file of each key."""
    named = files.withColumn("revision", registry.revision_rank(F.col("name"))).withColumn("config_key", registry.config_key(F.col("name")))
    order = [F.desc_nulls_last("revision"), F.desc("mtime"), F.desc(F.size(F.split("rel", "/"))), F.desc("rel")]
    return registry.heads(named, "config_key", order).withColumn("id", registry.content_id("file_", F.col("rel")))


def programs(spark: SparkSession, path: str) -> DataFrame:
    """Program rows of every JSON program file under a path."""
    from ..functions import program as pg
    from ..ship import ship

    ship(spark)
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path).select(F.input_file_name().alias("path"), "value")

    def run(frames):
        import pandas as pd

        columns = [x.split()[0] for x in pg.ROW_SCHEMA.split(", ")]
        for frame in frames:
            out = []
            for name, value in zip(frame["path"], frame["value"]):
                try:
                    out += pg.rows(name, pg.load(value)[0])
                except (KeyError, ValueError, json.JSONDecodeError):
                    continue
            yield pd.DataFrame(out, columns=columns)

    return texts.mapInPandas(run, pg.ROW_SCHEMA)


def png(data: bytes) -> tuple[int, int, bytes] | None:
    """(width, height, gray bytes) of an 8-bit gray, RGB or RGBA image without interlacing; None otherwise."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, head, packed = 8, None, b""
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
    if head is None or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        return None
    width, height, step = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    raw, line, before, gray = zlib.decompress(packed), width * step, bytearray(width * step), bytearray()
    for y in range(height):
        kind, row = raw[y * (line + 1)], bytearray(raw[y * (line + 1) + 1 : (y + 1) * (line + 1)])
        for i in range(line):
            a, b, c = (row[i - step] if i >= step else 0), before[i], (before[i - step] if i >= step else 0)
            if kind == 4:
                p = a + b - c
                guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                guess = (0, a, b, (a + b) // 2)[kind]
            row[i] = (row[i] + guess) & 255
        before = row
        gray += row if step == 1 else bytes((row[i] * 299 + row[i + 1] * 587 + row[i + 2] * 114) // 1000 for i in range(0, line, step))
    return width, height, bytes(gray)
