"""A folder tree as rows, with what was scanned, skipped and could not be read counted on the way."""

from __future__ import annotations

import os
import stat

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

FOUND = "status string, path string, rel string, name string, ext string, size long, mtime long, reason string"
#: The endings that a crawl keeps as a rule, and the reasons of errors.
ENDINGS = ("xlsx", "xlsm", "xlsb", "csv")
UNREADABLE, NO_STAT, DANGLING, CYCLE = "opendir_failed", "lstat_failed", "dangling_symlink", "cycle_skipped"


def _row(status: str, path: str, rel: str, info: os.stat_result | None = None, reason: str | None = None) -> tuple:
    name = rel.rpartition("/")[2]
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    return (status, path, rel, name, ext, info.st_size if info else None, int(info.st_mtime) if info else None, reason)


def walk(root: str, rel: str, descend: bool = True):
    """Rows of what lies under ``root/rel``; names that start with a dot are passed over.

    A link to a folder within the root is an error, as its files are found where
    they are; a link to one outside is followed once. Without ``descend`` folders
    are rows of status ``folder``.
    """
    top, seen, todo = os.path.realpath(root), set(), [rel]
    while todo:
        here = todo.pop()
        folder = os.path.join(root, here) if here else root
        try:
            names = sorted(os.listdir(folder))
        except OSError:
            yield _row("error", folder, here, reason=UNREADABLE)
            continue
        for name in names:
            if name.startswith("."):
                continue
            path, below = os.path.join(folder, name), f"{here}/{name}" if here else name
            try:
                info = os.lstat(path)
            except OSError:
                yield _row("error", path, below, reason=NO_STAT)
                continue
            linked = stat.S_ISLNK(info.st_mode)
            if linked:
                try:
                    info = os.stat(path)
                except OSError:
                    yield _row("error", path, below, reason=DANGLING)
                    continue
            if stat.S_ISDIR(info.st_mode):
                real = os.path.realpath(path)
                if linked and (real in seen or os.path.commonpath([real, top]) in (top, real)):
                    yield _row("error", path, below, reason=CYCLE)
                elif descend:
                    seen.add(real)
                    todo.append(below)
                else:
                    yield _row("folder", path, below, info)
            elif stat.S_ISREG(info.st_mode):
                yield _row("file", path, below, info)


def crawl(spark: SparkSession, root: str, endings: tuple[str, ...] = ENDINGS, since: int = 0) -> tuple[DataFrame, Observation]:
    """(files and errors, counters): one pass over a folder that all machines see.

    ``status`` is ``file`` or ``error``. Files of other endings, and those not
    changed after ``since`` (seconds), are left out; the counters ``scanned``,
    ``skipped`` and ``errors`` are there once an action has run. The driver
    lists the topmost folder only, tasks walk those below.
    """
    ship(spark)
    tops = [r for r in walk(root, "", descend=False)]
    folders = [(r[2],) for r in tops if r[0] == "folder"]
    own = spark.createDataFrame([r for r in tops if r[0] != "folder"], FOUND)

    def run(frames):
        names = [x.split()[0] for x in FOUND.split(", ")]
        for frame in frames:
            for rel in frame["rel"]:
                found = pd.DataFrame(list(walk(root, rel)), columns=names)
                yield found.astype({"size": "Int64", "mtime": "Int64"})

    if folders:
        own = own.unionByName(spark.createDataFrame(folders, "rel string").repartition(len(folders), "rel").mapInPandas(run, FOUND))
    file, wanted, old = F.col("status") == "file", F.col("ext").isin(*endings), (F.lit(since) > 0) & (F.col("mtime") <= since)
    counters = Observation("crawl")
    seen = own.observe(counters, F.count_if(file).alias("scanned"), F.count_if(file & wanted & old).alias("skipped"), F.count_if(F.col("status") == "error").alias("errors"))
    return seen.where((F.col("status") == "error") | (file & wanted & ~old)), counters
