"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Pieces of one length are alike to the packing, and there are only as many
lengths as a sequence has places. So the whole corpus is packed at once: the
counts by length go through the segment tree, many equal pieces and bins at a
time, and give a plan of bounded size that says which bins the pieces of each
length fill. Every piece then finds its place by its rank among those of its
length. Ranks come from small groups, so that no length, document or source is
ever in one task.

Null texts are empty documents of one end token. Repeated and null ids are
packed once for each row. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .stores import checkpointed
from .tokens import encoder

#: Pieces of one length, on average at most, that are ranked in one group.
GROUP = 20_000


class OpenBins:
    """Open bins by remaining capacity under a segment tree.

    Leaf c holds the bins with exactly c places left; an inner node holds
    whether any leaf below it has one. ``take`` finds the smallest capacity of
    at least ``need`` in O(log capacity).
    """

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.tree = bytearray(2 * self.size)
        self.bins: list[list] = [[] for _ in range(capacity + 1)]

    def put(self, left: int, which) -> None:
        """Open a bin, or anything that stands for some, with so many places left."""
        self.bins[left].append(which)
        node = left + self.size
        while node and not self.tree[node]:
            self.tree[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple | None:
        tree, node = self.tree, need + self.size
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node + (not tree[2 * node])
        left = node - self.size
        which = self.bins[left].pop()
        if not self.bins[left]:
            tree[node] = 0
            node >>= 1
            while node and not (tree[2 * node] or tree[2 * node + 1]):
                tree[node] = 0
                node >>= 1
        return left, which


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins.

    Longest first, ties in the order given; each goes to the open bin that it
    fills most tightly, or to a new one. Lengths must be 1 to ``capacity``.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened, made = OpenBins(capacity), 0
    for i in order.tolist():
        n = int(lengths[i])
        found = opened.take(n)
        if found is None:
            left, which = capacity, made
            made += 1
        else:
            left, which = found
        bins[i], offsets[i] = which, capacity - left
        if left > n:
            opened.put(left - n, which)
    return bins, offsets, made


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts by length: rows (length, rank, bin, offset) and the number of bins.

    From its rank on, up to the next row of the same length, the pieces go to
    bins that follow one another, each at the offset. Open bins with equal room
    are kept as runs of neighbouring bins: the tightest run takes as many pieces
    as fit before the next one is asked, which is what taking them one by one
    does.
    """
    opened, made, rows = OpenBins(capacity), 0, []
    for length in sorted((n for n, count in counts.items() if count), reverse=True):
        rank, left = 0, counts[length]
        while left:
            found = opened.take(length)
            room, (first, bins) = found if found else (capacity, (made, -(-left // (capacity // length))))
            if not found:
                made += bins
            layers = room // length
            used = min(bins, left // layers)
            if used:
                for k in range(layers):
                    rows.append((length, rank, first, capacity - room + k * length))
                    rank += used
                if room - layers * length:
                    opened.put(room - layers * length, (first, used))
            left -= used * layers
            if left and used < bins:  # the last bin is filled in part
                for k in range(left):
                    rows.append((length, rank, first + used, capacity - room + k * length))
                    rank += 1
                opened.put(room - left * length, (first + used, 1))
                used, left = used + 1, 0
            if used < bins:
                opened.put(room, (first + used, bins - used))
    return np.array(rows, np.int64).reshape(-1, 4), made


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """Token pieces of every document: whole, or cut so that only the first is shorter."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            column = batch.column(1)
            rows: list[int] = []
            piece: list[int] = []
            start: list[int] = []
            length: list[int] = []
            crc: list[int] = []
            kept: list[np.ndarray] = []
            for row, text in enumerate(column.to_pylist()):
                ids = np.append(enc.ids(text or ""), np.uint32(end_id)).astype("<u4")
                cut = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cut, cut[1:])):
                    rows.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        kept.append(ids[a:b].astype(np.int32))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns for each piece: id, piece, start, length, ids_crc32, [ids],
    sequence_id and offset. Sequences are numbered from 0 and gapless from
    offset 0. Which of equally long pieces goes where is not fixed. The pieces
    are checkpointed, so their ranks stay the same when tasks are repeated.
    """
    spark = ship(docs.sparkSession)
    found = pieces(docs, path, capacity, end_id, with_ids, id_col, text_col)
    kept = found.columns
    # Rows that are equal in all columns must part as well, so the deal is by row.
    cut = checkpointed(found.withColumn("_deal", F.xxhash64(F.monotonically_increasing_id())))
    counts = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}
    rows, _ = plan(counts, capacity)
    groups = max(1, -(-max(counts.values(), default=0) // group))
    dealt = cut.withColumn("_group", F.pmod("_deal", F.lit(groups)))
    sizes = dealt.groupBy("length", "_group").agg(F.count("*").alias("_size"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_group", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_group").orderBy("_deal")) - 1
    ranked = dealt.withColumn("_within", within).join(sizes, ["length", "_group"]).withColumn("_rank", F.col("_within") + F.col("_before"))
    shared = spark.sparkContext.broadcast(rows[np.lexsort([rows[:, 1], rows[:, 0]])])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"

    def place(batches):
        moves = shared.value
        # Lengths and ranks as one ascending key; ranks stay below 2**52.
        key = (moves[:, 0].astype(np.uint64) << np.uint64(52)) | moves[:, 1].astype(np.uint64)
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            own = (length.astype(np.uint64) << np.uint64(52)) | rank.astype(np.uint64)
            at = np.searchsorted(key, own, side="right") - 1
            out = [batch.column(k) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(moves[at, 2] + rank - moves[at, 1]), pa.array(moves[at, 3])], names=[*kept, "sequence_id", "offset"])

    return ranked.select(*(F.col(f"`{c}`") for c in kept), "_rank").mapInArrow(place, schema)
