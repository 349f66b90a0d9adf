"""Event streams: triage, windows with watermarks, folder snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry, runs

EVENT = "event_id bigint, part_id string, section string, defect_type string, operator_id string, timestamp bigint, params map<string,double>"


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events from JSON lines; broken lines and missing fields become nulls."""
    e = lines.select(F.from_json(F.col(column), EVENT).alias("e")).select("e.*")
    return e.withColumn("ts", F.timestamp_seconds("timestamp"))


def read(spark: SparkSession, path: str, schema: str, files_at_a_time: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time).parquet(path)


def windows(events: DataFrame, length: str, by: list[str], late: str = "1 hour", slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Counts and sums by window. Windows close when the watermark passes them, which bounds the state."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = stamped.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, by: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = stamped.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def triage(events: DataFrame, priority: Column, fixes: DataFrame, key: str, proceed: bool = False) -> DataFrame:
    """Action and light of each event; ``fixes`` is a static table of keys with an approved fix."""
    known = fixes.select(key).distinct().withColumn("has_fix", F.lit(True))
    out = events.withColumn("priority", priority).join(known, key, "left")
    return out.withColumn("action", runs.action(F.col("priority"), F.coalesce("has_fix", F.lit(False)), proceed)).withColumn("light", runs.light(F.col("priority")))


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; the checkpoint folder makes the next run go on from here."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start().awaitTermination()


def changes(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """New and edited files of a snapshot by (rel, sha256); the built-in file stream misses edits."""
    return now if before is None else registry.unseen(now, before, ["rel", "sha256"])
