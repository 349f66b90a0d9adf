"""Queries that run streams over the given tables in slices that arrive one after the other, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import references
from ..operators import registry
from ..sources.tables import Tables, artifacts, content_of, registry_tables
from ..stores import shared_folder
from ..streaming import audit, reactions, watch
from ..streaming.state import keyed
from .catalogue import ORACLE_SQL, big, formula_cells, query, r, table


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder's name in the folder that all machines share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def arriving(spark: SparkSession, rows: DataFrame, order: str, slices: int = 4) -> DataFrame:
    """The rows as a stream of micro-batches in order of a number: each slice is a write of its own, so files have its order."""
    folder = fresh(spark, "arriving")
    ends = rows.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    a, b = (ends.a or 0), (ends.b or 0)
    for i in range(slices):
        lo, hi = a + (b + 1 - a) * i // slices, a + (b + 1 - a) * (i + 1) // slices
        rows.where((F.col(order) >= lo) & (F.col(order) < hi)).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query(ORACLE_SQL["hash_chain"])
def audit_stream(spark, sf_dir):
    """Hash chains of users over four micro-batches: one unbroken chain for each, by keyed state."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    target = fresh(spark, "audit")
    audit.audit(arriving(spark, events, "event_id"), "user_id", "event_id", "event_type", target, fresh(spark, "audit-state"))
    chain = spark.read.parquet(target)
    return chain.select("user_id", "event_id", big("seq").alias("seq"), "prev_hash", "entry_hash")


def judged(batch: DataFrame) -> DataFrame:
    """A limit of 100 on each event's value, known to within 1."""
    x = F.col("value")
    box = F.array(F.struct(F.lit("x").alias("sym"), (x - 1).alias("lo"), (x + 1).alias("hi")))
    return batch.select(F.col("event_id").cast("string").alias("subject"), F.col("event_type").alias("program_hash"), box.alias("box"), (100 - (x + 1)).alias("ms_lo"), (100 - (x - 1)).alias("ms_hi"), F.lit(0.0).alias("residual"))


_SLICE = "(event_id - (SELECT min(event_id) FROM events)) * 4 // ((SELECT max(event_id) FROM events) + 1 - (SELECT min(event_id) FROM events))"


@query(f"""WITH e AS (SELECT event_id, event_type, value, {_SLICE} AS slice, 1 / (1 + exp(3.0 * ((100 - (value + 1)) / (((100 - (value - 1)) - (100 - (value + 1))) + 1e-12)))) AS cs, CASE WHEN 100 - (value + 1) > 0 THEN 'SAFE' WHEN 100 - (value - 1) < 0 THEN 'FAIL' ELSE 'ABSTAIN' END AS verdict FROM events),
c AS (SELECT event_type, value, min(slice) AS slice FROM e GROUP BY 1, 2),
p AS (SELECT e.event_id, count(*) AS near, min(d) AS nearest FROM (SELECT e.event_id, abs(((e.value - 1) + (e.value + 1)) / 2 - ((c.value - 1) + (c.value + 1)) / 2) / greatest((e.value + 1) - (e.value - 1), (c.value + 1) - (c.value - 1), 0.01 * abs(((e.value - 1) + (e.value + 1)) / 2)) AS d
  FROM e JOIN c ON e.event_type = c.event_type AND c.slice < e.slice AND c.value BETWEEN e.value - 1 AND e.value + 1) AS e WHERE d < 0.01 GROUP BY 1)
SELECT e.event_id, verdict, round(cs, 6) AS cs, cs >= 0.75 AS alerts, least(coalesce(near, 0), 5) AS precedents, round(nearest, 6) AS nearest FROM e LEFT JOIN p ON p.event_id = e.event_id""")
def reaction_stream(spark, sf_dir):
    """Verdict, alert and precedents of every event; the case base grows from batch to batch."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    tables = reactions.react(arriving(spark, events, "event_id"), judged, fresh(spark, "reactions"), fresh(spark, "reactions-state"), delta=0.01)
    near = tables.read("precedents").groupBy("subject").agg(F.count("*").alias("precedents"), F.min("distance").alias("nearest"))
    alerts = tables.read("alerts").select("subject", F.lit(True).alias("alerts"))
    out = tables.read("results").join(near, "subject", "left").join(alerts, "subject", "left")
    return out.select(
        F.col("subject").cast("long").alias("event_id"), "verdict", r("cs").alias("cs"), F.coalesce("alerts", F.lit(False)).alias("alerts"),
        F.coalesce("precedents", F.lit(0)).alias("precedents"), r("nearest").alias("nearest"),
    )


@query("""SELECT CAST(n_regionkey AS BIGINT) AS region, change, CAST(n AS BIGINT) AS files FROM (SELECT DISTINCT n_regionkey FROM nation) AS x, (SELECT unnest(['added', 'deleted']) AS change) AS c, LATERAL (SELECT CASE WHEN change = 'added' THEN 1 + CASE WHEN n_regionkey % 2 = 1 THEN 1 ELSE 0 END ELSE CASE WHEN n_regionkey % 2 = 1 THEN 1 ELSE 0 END END AS n) AS y WHERE n > 0""")
def folder_changes(spark, sf_dir):
    """A folder with a file for each region, half of them replaced between two polls of the watch."""
    nations = table(spark, sf_dir, "nation").select(F.concat_ws("|", "n_nationkey", "n_name").alias("line"), "n_regionkey")
    root, told, checkpoint, state = (fresh(spark, x) for x in ("watched", "told", "watch-state", "listings"))
    for some in (nations, nations.where("n_regionkey % 2 = 1").withColumn("line", F.upper("line"))):
        some.repartition("n_regionkey").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("n_regionkey").text(root)
        with keyed(spark):
            polled = watch.changes(spark, root, state, r"n_regionkey=\d+/part-").writeStream.format("parquet").option("path", told).option("checkpointLocation", checkpoint)
            poll = polled.trigger(availableNow=True).start()
        poll.awaitTermination()
    region = F.regexp_extract("rel", r"n_regionkey=(\d+)/", 1).cast("long")
    return spark.read.parquet(told).groupBy(region.alias("region"), "change").agg(F.count("*").alias("files"))


_PATH = "'b' || (p_partkey % 25) || '/s' || (p_partkey % 7) || '/p' || p_partkey || CASE WHEN p_size < 5 THEN '.bin' ELSE '.xlsx' END"


@query(f"""SELECT 'store' AS root, count(*) AS files, count(*) FILTER (WHERE p_partkey % 3 = 0) AS heads, count(*) FILTER (WHERE p_size < 5) AS unknown_format, (SELECT count(*) FROM nation) AS errors,
count(DISTINCT p_partkey % 25) + count(DISTINCT (p_partkey % 25) * 7 + p_partkey % 7) AS folders, (SELECT count(*) FROM part WHERE p_size < 5) AS listed_unknown, min({_PATH}) AS first_file FROM part""")
def registry_publish(spark, sf_dir):
    """Registry tables of a crawl, shown together and read back."""
    ext = F.when(F.col("p_size") < 5, "bin").otherwise("xlsx")
    part = lambda n: (F.col("p_partkey") % n).cast("string")
    rel = F.concat(F.lit("b"), part(25), F.lit("/s"), part(7), F.lit("/p"), "p_partkey", F.lit("."), ext)
    files = table(spark, sf_dir, "part").select(registry.content_id("file_", rel).alias("id"), rel.alias("rel"), ext.alias("ext"), F.when(F.col("p_size") < 5, "unknown_format").otherwise("rivet_joint").alias("format_type"), (F.col("p_partkey") % 3 == 0).alias("is_head"))
    errors = table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.lit("opendir_failed").alias("reason"))
    tables = Tables(spark, fresh(spark, "registry"))
    tables.publish(0, registry_tables(files, errors, "store"))
    return tables.read("registry_index").join(tables.read("unknown_format").agg(F.count("*").alias("listed_unknown"))).join(tables.read("file_registry").agg(F.min("rel").alias("first_file")))


@query("""SELECT name, 'art_' || substr(sha256(content), 1, 16) AS id, 'sha256:' || sha256(content) AS hash, row_number() OVER (PARTITION BY name ORDER BY 'art_' || substr(sha256(content), 1, 16)) AS version, CAST(strlen(content) AS BIGINT) AS size, base64(encode(content)) AS data, content AS back
FROM (SELECT DISTINCT c_mktsegment AS name, c_name || '/' || c_nationkey AS content FROM customer) AS x""")
def artifact_registry(spark, sf_dir):
    """Contents as artifacts, each once with its name's next version, and back from base64."""
    batch = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.concat_ws("/", "c_name", "c_nationkey").alias("content"))
    made = artifacts(batch.union(batch), spark.createDataFrame([], "id string, name string, version long"))
    return made.select("name", "id", "hash", big("version").alias("version"), "size", "data", content_of(F.col("data")).cast("string").alias("back"))


_REFS = """(SELECT unnest([1, 2, 2, 3, 4, 4, 5]) AS k, unnest([0, 0, 1, 0, 0, 1, 0]) AS pos, unnest(['cell', 'cell', 'range', 'name', 'cell', 'cell', 'range']) AS kind, unnest([NULL, NULL, NULL, '[1]Sheet1!A1', NULL, NULL, NULL]) AS name,
unnest([NULL, 0, 0, NULL, 0, 1, 0]) AS row0, unnest([0, 0, 1, NULL, 0, 1, 0]) AS col0, unnest([NULL, 0, 8, NULL, 0, 1, 8]) AS row1, unnest([0, 0, 2, NULL, 0, 1, 0]) AS col1, unnest([1, 1, 18, NULL, 1, 1, 9]) AS cells)"""


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CAST(pos AS BIGINT) AS pos, kind, name, CAST(CASE WHEN k = 1 THEN l_linenumber - 1 ELSE row0 END AS BIGINT) AS row0, CAST(col0 AS BIGINT) AS col0,
CAST(CASE WHEN k = 1 THEN l_linenumber - 1 ELSE row1 END AS BIGINT) AS row1, CAST(col1 AS BIGINT) AS col1, CAST(cells AS BIGINT) AS cells FROM lineitem JOIN {_REFS} AS f ON f.k = l_linenumber % 6""")
def formula_references(spark, sf_dir):
    """Every formula's cells, ranges and names, by the SQL table function."""
    references.register(spark)
    formula_cells(spark, sf_dir).createOrReplaceTempView("boundlake_cells")
    longs = ", ".join(f"CAST(r.{c} AS BIGINT) AS {c}" for c in ("pos", "row0", "col0", "row1", "col1", "cells"))
    return spark.sql(f"SELECT l_orderkey, l_linenumber, l_partkey, r.kind, r.name, {longs} FROM boundlake_cells AS c, LATERAL parse_refs(c.formula) AS r")
