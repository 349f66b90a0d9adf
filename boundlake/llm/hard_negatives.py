"""Hard negatives of anchors by exact integer inner products, computed packed.

Several candidates' components, biased to be at least 0, stand in separated
fields of one wide integer (Kronecker substitution), so one multiplication by an
anchor's biased component serves them all, and the sums over the components are
the fields' exact products once the bias is taken off again. The wide integers
have 53 bits and are held in doubles, so that one matrix product does all
multiplications without rounding; a batch whose fields are too wide for two in
53 bits takes Python's unbounded integers, sixteen fields each.

Rows without an id, with a null label or vector, or with a null or non-finite
component take no part. Rows that share an id count as one, the least by label
and vector. Vectors of unequal length meet as if the shorter one ended in
zeros; an empty vector scores 0. Scores beyond 64 bits raise an error. Ids are
integers. Other columns are not read, so clashing names cannot reach the output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .stores import checkpointed

#: Bytes of anchors that every task holds at a time, and anchors scored at a time.
BLOCK_BYTES, STEP = 8 << 20, 1024
WORD_BITS, WIDE_FIELDS = 53, 16
LEAST = np.iinfo(np.int64).min


def layout(dims: int, a_most: int, y_most: int) -> tuple[int, int]:
    """Bits of a field and fields of a word for components of at most the given sizes; few fields stand for unbounded words."""
    width = max(dims * 4 * a_most * y_most, 1).bit_length()
    fields = WORD_BITS // width
    return (width, fields) if fields >= 2 else (width, WIDE_FIELDS)


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products (anchors x rows) of whole-numbered vectors of one length, by packed words."""
    dims, n = anchors.shape[1], len(rows)
    if not (dims and n and len(anchors)):
        return np.zeros((len(anchors), n), np.int64)
    a_most, y_most = (int(max(abs(x.max()), abs(x.min()))) for x in (anchors, rows))
    width, fields = layout(dims, a_most, y_most)
    exact = np.float64 if width * fields <= WORD_BITS else object
    whole = (lambda x: x.astype(np.int64)) if exact is np.float64 else (lambda x: np.frompyfunc(int, 1, 1)(x))
    a, y = whole(anchors), whole(rows)
    padded = np.concatenate([y, np.zeros((-n % fields, dims), y.dtype)]) + y_most
    words = sum(padded[i::fields] << (width * i) for i in range(fields))
    sums = whole((a + a_most).astype(exact) @ words.astype(exact).T)
    out = np.empty((len(a), len(padded)), np.int64)
    taken = y_most * a.sum(axis=1)[:, None] + dims * a_most * y_most
    for i in range(fields):
        field = (sums >> (width * i)) & ((1 << width) - 1)
        out[:, i::fields] = field - taken - a_most * (padded[i::fields] - y_most).sum(axis=1)[None, :]
    return out[:, :n]


def matrix(column: pa.Array, scale: int, dims: int = 0) -> np.ndarray:
    """floor(scale * x) as whole doubles; shorter vectors end in zeros."""
    values, lengths = np.asarray(column.flatten().cast(pa.float64())), np.asarray(column.value_lengths().fill_null(0))
    out = np.zeros((len(lengths), max(dims, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = np.floor(values * scale)
    return out


class Best:
    """The ``top`` rows of each anchor so far: by score, then by the smaller id."""

    def __init__(self, anchors: int, top: int):
        self.score = np.full((anchors, top), LEAST)
        self.id = np.full((anchors, top), np.iinfo(np.int64).max)

    def add(self, at: slice, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Rows of a batch for the anchors ``at``; only those that fit count."""
        top = self.score.shape[1]
        last, last_id = self.score[at, -1:], self.id[at, -1:]
        better = fits & ((scores > last) | ((scores == last) & (ids[None, :] < last_id)))
        if np.count_nonzero(better) > 4 * top * len(scores) and scores.shape[1] > top:
            kth = np.partition(np.where(better, scores, LEAST), scores.shape[1] - top, axis=1)[:, scores.shape[1] - top]
            better &= scores >= kth[:, None]
        who, row = np.nonzero(better)
        if not len(who):
            return
        held, slot = np.nonzero(self.score[at] != LEAST)
        group = np.concatenate([who, held])
        score = np.concatenate([scores[who, row], self.score[at][held, slot]])
        key = np.concatenate([ids[row], self.id[at][held, slot]])
        # ~x turns the order of whole numbers round without overflow.
        order = np.lexsort([key, ~score, group])
        group, score, key = group[order], score[order], key[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        keep = place < top
        self.score[at][group[keep], place[keep]] = score[keep]
        self.id[at][group[keep], place[keep]] = key[keep]


def _scored(rows: DataFrame, anchors: Callable, scale: int, schema: str, searches: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """Hold every batch against the shared anchors; ``searches`` gives (Best, fit of a step, columns that lead a result)."""

    def run(batches):
        shared = anchors()
        found = list(searches(shared))
        for batch in batches:
            ids, labels = np.asarray(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            vectors = matrix(batch.column(2), scale, shared["vectors"].shape[1])
            mine = np.pad(shared["vectors"], ((0, 0), (0, vectors.shape[1] - shared["vectors"].shape[1])))
            for a in range(0, len(mine), STEP):
                at = slice(a, min(a + STEP, len(mine)))
                scores = packed_scores(mine[at], vectors)
                same = shared["labels"][at, None] == labels[None, :]
                for best, fits, _ in found:
                    best.add(at, scores, ids, fits(at, scores, same, ids))
        for best, _, lead in found:
            who, slot = np.nonzero(best.score != LEAST)
            columns = [x[who] for x in lead] + [best.id[who, slot], best.score[who, slot]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def mine(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: Column | str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score is the inner product of its ``floor(scale * x)`` with the
    anchor's. Positives are an anchor's best rows of its label, itself left out;
    negatives of a positive are the best rows of other labels whose score is
    ``low`` to ``high`` hundredths of the positive's. ``anchors`` is a condition
    on the columns of ``rows``.

    Every anchor is held against every row, block of anchors by block; a task
    passes on its own best rows only. An anchor without positives, or a positive
    without negatives, has no rows in the result; an empty table gives none.
    """
    spark = ship(rows.sparkSession)
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.struct(label.alias("label"), F.col(vector_col).alias("v")).alias("row"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    own = own.where(F.col("id").isNotNull() & F.col("row.label").isNotNull() & F.col("row.v").isNotNull() & F.forall("row.v", _finite))
    one = own.groupBy("id").agg(F.min("row").alias("row"), F.max("anchor").alias("anchor"))
    taken = checkpointed(one.select("id", "row.label", "row.v", "anchor"))
    counts = taken.agg(F.sum(F.col("anchor").cast("int")).alias("n"), F.max(F.size("v")).alias("dims")).first()
    blocks = -(-(counts.n or 0) // max(BLOCK_BYTES // (8 * max(counts.dims or 0, 1)), 1))
    block = F.pmod(F.xxhash64("id"), F.lit(max(blocks, 1)))
    every, found = taken.select("id", "label", "v"), None
    for k in range(blocks):
        some = taken.where(F.col("anchor") & (block == k)).select("id", "label", "v").toArrow().combine_chunks().to_batches()
        if not some:
            continue
        ids, labels, vectors = np.asarray(some[0].column(0)), some[0].column(1).to_numpy(zero_copy_only=False), matrix(some[0].column(2), scale)
        shared = {"ids": ids, "labels": labels, "vectors": vectors}
        best = checkpointed(_positives(every, spark.sparkContext.broadcast(shared), positives, scale))
        shared |= _by_slot(best, ids, positives)
        part = checkpointed(_negatives(every, spark.sparkContext.broadcast(shared), negatives, low, high, scale))
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], RESULT)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))


def _ranked(scored: DataFrame, by: list[str], top: int) -> DataFrame:
    at = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= top)


def _positives(rows: DataFrame, shared, top: int, scale: int) -> DataFrame:
    """(anchor, id, score, rank) of the best rows of each anchor's label."""

    def searches(held: dict):
        fits = lambda at, scores, same, ids: same & (held["ids"][at, None] != ids[None, :])
        yield Best(len(held["ids"]), top), fits, [held["ids"]]

    return _ranked(_scored(rows, lambda: shared.value, scale, "anchor long, id long, score long", searches), ["anchor"], top)


def _by_slot(best: DataFrame, ids: np.ndarray, top: int) -> dict:
    """Positives of a block of anchors, one row for each anchor and one column for each rank; 0 stands for none."""
    table = best.select("anchor", "rank", "id", "score").toArrow()
    anchor, rank, own, score = (np.asarray(table.column(i).combine_chunks()) for i in range(4))
    order = np.argsort(ids)
    at = order[np.searchsorted(ids, anchor, sorter=order)]
    out = {k: np.zeros((len(ids), top), np.int64) for k in ("given", "positive", "positive_score")}
    for k, x in (("given", 1), ("positive", own), ("positive_score", score)):
        out[k][at, rank - 1] = x
    return out


def _negatives(rows: DataFrame, shared, top: int, low: int, high: int, scale: int) -> DataFrame:
    """Best rows of other labels for each anchor and positive, within the range that the positive's score sets."""

    def searches(held: dict):
        for j in range(held["given"].shape[1]):
            scores = held["positive_score"][:, j].tolist()
            # Whole numbers beside the bounds, by Python's integers, which do not overflow.
            least = np.array([-(-low * p // 100) for p in scores], np.int64)[:, None]
            most = np.array([high * p // 100 for p in scores], np.int64)[:, None]
            given = held["given"][:, j, None] == 1

            def fits(at, scores, same, ids, least=least, most=most, given=given):
                return given[at] & ~same & (scores >= least[at]) & (scores <= most[at])

            yield Best(len(held["ids"]), top), fits, [held["ids"], held["positive"][:, j], held["positive_score"][:, j]]

    scored = _scored(rows, lambda: shared.value, scale, "anchor long, positive long, positive_score long, id long, score long", searches)
    ranked = _ranked(scored, ["anchor", "positive"], top)
    return ranked.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
