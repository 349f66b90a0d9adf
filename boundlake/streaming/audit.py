"""Hash chains that grow with a stream, one for each key."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..ship import ship
from .state import keyed

ZERO = "0" * 64


class Chain(StatefulProcessor):
    """State of a key: the next sequence number and the last hash. Earlier entries are never read again."""

    def __init__(self, key: str, order: str):
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "next long, hash string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        self.head.update((int(row["seq"]) + 1, str(row["entry_hash"])))

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values([self.order, "payload"], kind="stable", na_position="first")
        at, last = self.head.get() if self.head.exists() else (0, ZERO)
        before, now = [], []
        for i, payload in enumerate(frame["payload"], at):
            before.append(last)
            last = hashlib.sha256("|".join([str(i), last, *([] if payload is None else [payload])]).encode()).hexdigest()
            now.append(last)
        self.head.update((at + len(now), last))
        yield pd.DataFrame({self.key: frame[self.key], "seq": range(at, at + len(now)), self.order: frame[self.order], "payload": frame["payload"], "prev_hash": before, "entry_hash": now})

    def close(self) -> None:
        pass


def chained(stream: DataFrame, key: str, order: str, payload: str, heads: DataFrame | None = None) -> DataFrame:
    """Stream of (key, seq, order, payload, prev_hash, entry_hash): h = sha256(seq | previous h | payload), from 64 zeros.

    Entries of a micro-batch are chained in order of ``order``, then payload; an
    entry that arrives in a later batch follows those that were there. A chain's
    rows of one micro-batch are in memory together, so the trigger's limit bounds
    them. ``heads`` (key, seq, entry_hash) lets a new query go on from chains
    that were written before.
    """
    ship(stream.sparkSession)
    kinds = dict(stream.dtypes)
    rows = stream.select(key, order, F.col(payload).cast("string").alias("payload")).where(F.col(key).isNotNull())
    out = f"`{key}` {kinds[key]}, seq long, `{order}` {kinds[order]}, payload string, prev_hash string, entry_hash string"
    start = None if heads is None else heads.select(key, "seq", "entry_hash").groupBy(key)
    return rows.groupBy(key).transformWithStateInPandas(Chain(key, order), out, "append", "none", initialState=start)


def heads(chain: DataFrame, key: str) -> DataFrame:
    """(key, seq, entry_hash): the last entry of each written chain."""
    return chain.groupBy(key).agg(F.max("seq").alias("seq"), F.max_by("entry_hash", "seq").alias("entry_hash"))


def audit(stream: DataFrame, key: str, order: str, payload: str, target: str, checkpoint: str, start: DataFrame | None = None) -> None:
    """Append what has arrived to the chains under ``target`` and stop; the file sink shows each micro-batch once."""
    with keyed(stream.sparkSession):
        chains = chained(stream, key, order, payload, start).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        query = chains.trigger(availableNow=True).start()
    query.awaitTermination()
