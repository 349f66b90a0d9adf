"""Several tables that become visible together.

A version's tables are written as plain Parquet folders first; a manifest row for
each of them, written last as one file, makes them visible. Readers look only
at folders that a manifest names, so a write that breaks leaves nothing to be
seen, and a version that is there already is not written again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry

MANIFEST = "version long, name string, folder string"


class Tables:
    """Versions of named tables under one folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _entries(self, before: int | None = None) -> list:
        """Manifest rows, a few for each version."""
        if not self._there(f"{self.folder}/_manifest"):
            return []
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/_manifest").collect()
        return sorted(r for r in rows if before is None or r.version < before)

    def versions(self) -> list[int]:
        return sorted({r.version for r in self._entries()})

    def publish(self, version: int, tables: dict[str, DataFrame]) -> bool:
        """Write the tables of a version and show them; False if the version was there already."""
        if self._there(f"{self.folder}/_manifest/v{version}.done"):
            return False
        run, rows = uuid.uuid4().hex, []
        for name, table in sorted(tables.items()):
            folder = f"{self.folder}/{name}/v{version}-{run}"
            table.write.parquet(folder)
            rows.append((version, name, folder))
        self._show(version, rows)
        return True

    def _show(self, version: int, rows: list[tuple]) -> None:
        """One file with the manifest's rows comes into being by a rename, which either happens or doesn't."""
        made = f"{self.folder}/_making/{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(made)
        jvm = self.spark._jvm.org.apache.hadoop.fs
        source = jvm.Path(made)
        fs = source.getFileSystem(self.spark._jsc.hadoopConfiguration())
        part = next(s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-"))
        target = jvm.Path(f"{self.folder}/_manifest/v{version}.done")
        fs.mkdirs(target.getParent())
        if not fs.rename(part, target) and not fs.exists(target):
            raise OSError(f"version {version} could not be shown")
        fs.delete(source, True)

    def read(self, name: str, before: int | None = None, schema: str | None = None) -> DataFrame:
        """All rows of a table, or those of versions below ``before``; no rows where nothing is visible."""
        folders = [r.folder for r in self._entries(before) if r.name == name]
        if folders:
            return self.spark.read.parquet(*folders) if schema is None else self.spark.read.schema(schema).parquet(*folders)
        if schema is None:
            raise LookupError(f"no version of {name} is visible; a schema is needed for an empty table")
        return self.spark.createDataFrame([], schema)


def registry_tables(files: DataFrame, errors: DataFrame, root: str) -> dict[str, DataFrame]:
    """What a crawl leaves: folders, file_registry, unknown_format, l0_errors and the one-row registry_index.

    ``files`` needs id, rel, ext, format_type and is_head; ``errors`` path and reason.
    """
    folders = registry.folders(files, "rel").where("rel <> ''")
    unknown = files.where(F.col("format_type") == "unknown_format").select("id", F.col("rel").alias("rel_path"), "ext")
    counted = files.agg(F.count("*").alias("files"), F.count_if("is_head").alias("heads"), F.count_if(F.col("format_type") == "unknown_format").alias("unknown_format"))
    index = counted.join(folders.agg(F.count("*").alias("folders"))).join(errors.agg(F.count("*").alias("errors"))).withColumn("root", F.lit(root))
    return {"folders": folders, "file_registry": files, "unknown_format": unknown, "l0_errors": errors.select("path", "reason"), "registry_index": index}


def artifacts(batch: DataFrame, known: DataFrame, content: str = "content", key: str = "name") -> DataFrame:
    """Rows to append to the artifact registry: unseen contents with id, hash, size, base64 text and the name's next version."""
    new = registry.ingest(batch, known, content, key)
    body = F.col(content).cast("binary")
    return new.withColumns({"kind": F.lit("artifact"), "hash": F.concat(F.lit("sha256:"), F.sha2(body, 256)), "size": F.octet_length(body).cast("long"), "data": F.base64(body)}).drop(content)


def models(batch: DataFrame, known: DataFrame, model: str = "model", artifact: str = "artifact") -> DataFrame:
    """Rows to append to the model registry: one for each new model text, versioned by the artifact it came from."""
    named = batch.withColumn("id", registry.content_id("mdl_", F.col(model))).dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti")
    highest = known.groupBy(artifact).agg(F.max("version").alias("_highest"))
    from pyspark.sql import Window

    step = F.row_number().over(Window.partitionBy(artifact).orderBy("id"))
    versioned = named.join(highest, artifact, "left").withColumn("version", F.coalesce("_highest", F.lit(0)) + step).drop("_highest")
    return versioned.withColumns({"kind": F.lit("model"), "hash": F.concat(F.lit("sha256:"), F.sha2(F.col(model), 256))})


def content_of(data: Column) -> Column:
    """The bytes of an artifact's base64 text."""
    return F.unbase64(data)
