"""Results that were computed before, as append-only tables.

Entries are (program_hash, box_fp, syms, version, ...result); tombstones are
(kind, value, version) and end what was stored up to their version, by program
or by any symbol of the box; uses are (program_hash, box_fp, version). Nothing is
rewritten: what counts follows from versions, which one writer numbers upwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["program_hash", "box_fp"]


def fingerprint(box: Column) -> Column:
    """Hash of a box, an array of structs (sym, lo, hi), whatever the order of its symbols."""
    side = F.transform(F.array_sort(box), lambda b: F.concat(b["sym"], F.lit(":"), b["lo"].cast("string"), F.lit(","), b["hi"].cast("string"), F.lit(";")))
    return F.sha2(F.array_join(side, ""), 256)


def symbols(entries: DataFrame) -> DataFrame:
    """(sym, program_hash, box_fp, version): which entries a symbol is part of."""
    return entries.select(F.explode("syms").alias("sym"), *KEY, "version").distinct()


def live(entries: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The newest entry of each key that no tombstone of its version or later ends."""
    ends = tombstones.groupBy("kind", "value").agg(F.max("version").alias("ended"))
    newest = entries.groupBy(*KEY).agg(F.max_by(F.struct(*(c for c in entries.columns if c not in KEY)), "version").alias("_e")).select(*KEY, "_e.*")
    by_program = ends.where("kind = 'program'").select(F.col("value").alias("program_hash"), F.col("ended").alias("_by_program"))
    by_symbol = symbols(newest).join(ends.where("kind = 'symbol'").select(F.col("value").alias("sym"), "ended"), "sym").where("ended >= version").select(*KEY).distinct()
    left = newest.join(by_program, "program_hash", "left").where(F.coalesce(F.col("_by_program") < F.col("version"), F.lit(True)))
    return left.drop("_by_program").join(by_symbol, KEY, "left_anti")


def lookup(wanted: DataFrame, entries: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The wanted boxes with what is stored of them; ``hit`` tells which need no evaluation."""
    stored = live(entries, tombstones)
    return wanted.join(stored.withColumn("hit", F.lit(True)), KEY, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def evict(entries: DataFrame, tombstones: DataFrame, uses: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` live entries that were stored or used last; equal versions by key."""
    used = uses.groupBy(*KEY).agg(F.max("version").alias("_used"))
    held = live(entries, tombstones).join(used, KEY, "left")
    return held.orderBy(F.desc(F.greatest("version", F.coalesce("_used", "version"))), *KEY).limit(limit).drop("_used")
