"""What a stream of boxes leads to: verdicts, precedents, new cases and alerts, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import runs
from ..operators import verdict as v
from ..sources.tables import Tables
from ..stores import checkpointed

BOX = "array<struct<sym:string,lo:double,hi:double>>"
RESULT = ("subject", "program_hash", "box", "ms_lo", "ms_hi", "residual", "verdict", "cs", "priority", "label", "cert_hash", "case_id")
CASE = f"case_id string, program_hash string, box {BOX}, verdict string, cs double, cert_hash string"
#: Fixed value: the score from which on a result alerts.
ALERT = 0.75


def case_id(program_hash: Column, box: Column) -> Column:
    """Id of a case by its program and its box, with symbols in order."""
    side = F.transform(F.array_sort(box), lambda b: F.concat(b["sym"], F.lit(":"), b["lo"].cast("string"), F.lit(","), b["hi"].cast("string"), F.lit(";")))
    return F.concat(F.lit("case_"), F.substring(F.sha2(F.concat(program_hash, F.lit("|"), F.array_join(side, "")), 256), 1, 24))


def _long(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.select(F.col(key).alias(name), "program_hash", F.explode("box").alias("b")).select(name, "program_hash", "b.sym", "b.lo", "b.hi")


def step(tables: Tables, number: int, boxes: DataFrame, delta: float = 0.15, top: int = 5, alert: float = ALERT) -> bool:
    """One batch of boxes (subject, program_hash, box, ms_lo, ms_hi, residual): judge, look up precedents, record.

    Precedents are cases of earlier batches only, so a batch that runs again has
    the same ones; cases that are known are not recorded again. All tables of a
    batch are shown together, once: a batch whose number was shown adds nothing.
    """
    if number in tables.versions():
        return False
    certified = v.certify(boxes, "reaction", F.col("subject")).withColumn("case_id", case_id(F.col("program_hash"), F.col("box")))
    results = checkpointed(certified.select(*RESULT))
    known = tables.read("cases", before=number, schema=CASE)
    near = runs.case_distance(_long(results, "subject", "query"), _long(known, "case_id", "case_id"), delta, top)
    new = results.select("case_id", "program_hash", "box", "verdict", "cs", "cert_hash").dropDuplicates(["case_id"]).join(known.select("case_id"), "case_id", "left_anti")
    return tables.publish(
        number,
        {
            "results": results,
            "precedents": near.select(F.col("query").alias("subject"), "case_id", "distance", "nearest"),
            "cases": new,
            "alerts": results.where(F.col("cs") >= alert).select("subject", "verdict", "cs", F.lit("criticality_high").alias("alert")),
        },
    )


def react(stream: DataFrame, evaluate: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, **options) -> Tables:
    """Run :func:`step` on every micro-batch that has arrived, then stop. ``evaluate`` makes boxes of a batch's rows."""
    tables = Tables(stream.sparkSession, target)

    def run(batch: DataFrame, number: int) -> None:
        step(Tables(batch.sparkSession, target), number, evaluate(batch), **options)

    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return tables


def outcomes(links: DataFrame, known: DataFrame) -> DataFrame:
    """Rows to append for outcomes of fixes (case_id, fix_id, outcome, verified_cert): the pair is the key, the same row again adds nothing."""
    keyed = links.withColumn("link_id", F.concat_ws("__", "case_id", "fix_id")).dropDuplicates(["link_id", "outcome", "verified_cert"])
    return keyed.join(known.select("link_id", "outcome", "verified_cert"), ["link_id", "outcome", "verified_cert"], "left_anti")
