"""Tables between the operators' stages, in the folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..stores import checkpointed, shared_folder

__all__ = ["checkpointed", "map_rows", "shared_folder", "written"]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table under a new name in the shared folder and read it again."""
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def map_rows(docs: DataFrame, run) -> DataFrame:
    """``mapInArrow`` to the same columns, whatever they are called; by itself it takes no names with dots."""
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    return docs.toDF(*plain.names).mapInArrow(run, plain).toDF(*docs.columns)
