"""Nearest vectors of a query set by cosine similarity, exactly, in blocks of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from ..stores import checkpointed

#: Queries held by every task at a time; bounds what is broadcast.
BLOCK = 2048


def _unit(rows: list, width: int) -> np.ndarray:
    """Rows at unit length; null vectors, those of another length and those of length 0 give zeros, as does not-a-number."""
    out = np.zeros((len(rows), width))
    fit = [i for i, x in enumerate(rows) if x is not None and len(x) == width]
    if fit and width:
        out[fit] = np.nan_to_num(np.array([[np.nan if y is None else y for y in rows[i]] for i in fit], dtype=np.float64))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, top: int = 5) -> DataFrame:
    """(query, key, similarity, nearest): the ``top`` rows most similar to every query but itself; ties by key.

    A null vector, or one of another length than the query's, has similarity 0.
    Queries come to the driver in blocks of about ``BLOCK``. Each task scores its
    rows against a block and passes on its own best only, so what is shuffled
    is ``top`` rows for each query and task.
    """
    spark = ship(queries.sparkSession)
    kind = dict(rows.dtypes)[key]
    dealt = checkpointed(queries.select(F.col(key).alias("query"), F.col(vector).alias("v"), F.xxhash64(F.monotonically_increasing_id()).alias("n")))
    blocks = -(-dealt.count() // BLOCK)
    at = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    found = None
    for k in range(blocks):
        some = dealt.where(F.pmod("n", F.lit(blocks)) == k).toArrow()
        names, sets = np.array(some.column("query").to_pylist(), dtype=object), []
        wanted = some.column("v").to_pylist()
        widths = np.array([len(x or ()) for x in wanted], dtype=np.int64)
        for width in np.unique(widths).tolist():
            at_width = np.flatnonzero(widths == width)
            sets.append((width, names[at_width], _unit([wanted[i] for i in at_width], width)))
        shared = spark.sparkContext.broadcast(sets)

        def score(batches, shared=shared):
            best = [[np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)] for _ in shared.value]
            for batch in batches:
                keys, vectors = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_pylist()
                for held, (width, who, unit) in zip(best, shared.value):
                    held[:] = _merged(held, who, keys, np.round(unit @ _unit(vectors, width).T, 9), top)
            for held, (_, who, _) in zip(best, shared.value):
                columns = [pa.array(who[held[0]].tolist(), types[0]), pa.array(held[2].tolist(), types[0]), pa.array(held[1], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["query", key, "similarity"])

        types = [some.schema.field("query").type]
        scored = rows.where(F.col(key).isNotNull()).select(key, vector).mapInArrow(score, f"query {kind}, `{key}` {kind}, similarity double")
        block = checkpointed(scored.withColumn("nearest", F.row_number().over(at)).where(F.col("nearest") <= top))
        found = block if found is None else found.unionByName(block)
    return found if found is not None else spark.createDataFrame([], f"query {kind}, `{key}` {kind}, similarity double, nearest int")


def _merged(held: list, who: np.ndarray, keys: np.ndarray, scores: np.ndarray, top: int) -> list:
    """The best so far (query number, score, key) with those of a batch (queries x rows); a query is never its own neighbour."""
    scores = np.where(who[:, None] == keys[None, :], -np.inf, scores)
    edge = np.full(len(who), -np.inf) if scores.shape[1] <= top else np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top]
    if len(held[0]):
        full = np.bincount(held[0], minlength=len(who)) >= top
        last = np.full(len(who), np.inf)
        np.minimum.at(last, held[0], held[1])
        edge = np.where(full, np.maximum(edge, last), edge)
    q, row = np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))
    q, score, key = np.concatenate([held[0], q]), np.concatenate([held[1], scores[q, row]]), np.concatenate([held[2], keys[row]])
    _, order = np.unique(key, return_inverse=True) if len(key) else (None, np.zeros(0, np.int64))
    by = np.lexsort([order, -score, q])
    q, score, key = q[by], score[by], key[by]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < top
    return [q[keep], score[keep], key[keep]]
