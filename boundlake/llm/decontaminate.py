"""Benchmark decontamination with suffix arrays over the training texts.

Every shard of documents (a few MB of text) gets a suffix array over its words;
every benchmark suffix is searched in it by bisection, for its window of
``window`` words or, for shorter items, all of its words. Occurrences on one
diagonal are merged to the longest verbatim matches with their places.
Suffixes that cannot begin a match, as a word in their window does not occur
in the benchmark, are left out of the array.

The benchmark is broadcast in blocks of at most ``BLOCK_BYTES`` of text (or one
longer item); a larger benchmark takes one pass for each block. Null texts have
no words; items without words match nothing; an empty benchmark or table is
allowed. Repeated rows are each searched. Case folds for A-Z only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .stores import map_rows
from .textnp import ALNUM_HIGH, LOWER, steps, utf8, word_hashes, word_spans

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Bits of a packed key; a word number takes ``LEAST_BITS`` of them, or as many more as a block's different words need.
KEY_BITS, LEAST_BITS = 63, 21


class Block:
    """Windows of some benchmark items, numbered by the block's own words."""

    def __init__(self, texts: pa.Array, window: int):
        raw, offsets = utf8(texts)
        raw = LOWER[raw]
        starts, ends, counts = word_spans(raw, offsets, ALNUM_HIGH)
        self.words, ids = np.unique(word_hashes(raw, starts, ends), return_inverse=True)
        self.bits = max(LEAST_BITS, (len(self.words) + 2).bit_length())
        ids = ids.astype(np.int64) + 1  # 0 stands for any other word
        self.window = window
        first = np.concatenate([[0], np.cumsum(counts)])
        length = np.minimum(counts, window)
        n = np.where(counts > 0, counts - length + 1, 0)
        item = np.repeat(np.arange(len(counts)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        size = length[item]
        padded = np.concatenate([ids, np.zeros(window, np.int64)])
        grid = padded[(first[item] + at)[:, None] + np.arange(window)]
        grid[np.arange(window) >= size[:, None]] = 0
        keyed = np.column_stack([grid, size])
        keyed, which = np.unique(keyed, axis=0, return_inverse=True) if len(keyed) else (keyed, np.zeros(0, np.int64))
        self.grid, self.size = keyed[:, :window], keyed[:, window]
        # All places of each different window, as (window and the word beside it, item, place): first by the word before, then by the word after.
        before = np.where(at > 0, padded[first[item] + at - 1], 0)
        after = np.where(at + size < counts[item], padded[first[item] + at + size], 0)
        self.sides = []
        for beside in (before, after):
            key = (which.astype(np.int64) << self.bits) | beside
            order = np.argsort(key, kind="stable")
            self.sides.append((key[order], item[order], at[order]))
        self.first = np.searchsorted(np.sort(which), np.arange(len(keyed) + 1))
        self.least = int(self.size.min()) if len(self.size) else 0


def packed(grid: np.ndarray, bits: int) -> list[np.ndarray]:
    """Rows of word numbers as few keys, most significant first."""
    keys, each = [], KEY_BITS // bits
    for a in range(0, grid.shape[1], each):
        key = np.zeros(len(grid), np.int64)
        for k in range(a, a + each):
            key = (key << bits) | (grid[:, k] if k < grid.shape[1] else 0)
        keys.append(key)
    return keys


def bisect(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """Place of each wanted row among sorted rows of keys, as in a bisection of suffixes."""
    lo = np.zeros(len(wanted[0]), np.int64)
    hi = np.full(len(wanted[0]), len(keys[0]), np.int64)
    while (lo < hi).any():
        open_ = lo < hi
        mid = np.where(open_, (lo + hi) >> 1, 0)
        less = np.zeros(len(lo), bool)
        same = np.ones(len(lo), bool)
        for k, w in zip(keys, wanted):
            value = k[mid]
            less |= same & (value < w)
            same &= value == w
        go = open_ & (less | same if right else less)
        lo = np.where(go, mid + 1, lo)
        hi = np.where(open_ & ~go, mid, hi)
    return lo


def search(block: Block, column: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Words of each row, and longest matches as (row, item, item_start, start, words)."""
    raw, offsets = utf8(column)
    raw = LOWER[raw]
    starts, ends, counts = word_spans(raw, offsets, ALNUM_HIGH)
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if not len(block.size) or not len(starts):
        return counts, none
    hashes = word_hashes(raw, starts, ends)
    at = np.minimum(np.searchsorted(block.words, hashes), len(block.words) - 1)
    ids = np.where(block.words[at] == hashes, at + 1, 0).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(counts)), counts)
    # A 0 after each row keeps windows inside rows.
    text = np.zeros(len(ids) + len(counts) + block.window, np.int64)
    text[np.arange(len(ids)) + row] = ids
    known = np.concatenate([[0], np.cumsum(text > 0)])
    end = len(text) - block.window
    suffix = np.flatnonzero(known[block.least : end + block.least] - known[:end] == block.least)
    if not len(suffix):
        return counts, none
    keys = packed(text[suffix[:, None] + np.arange(block.window)], block.bits)
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    high = block.grid.copy()
    high[np.arange(block.window) >= block.size[:, None]] = (1 << block.bits) - 1
    lo = bisect(keys, packed(block.grid, block.bits), right=False)
    hi = bisect(keys, packed(high, block.bits), right=True)
    found = hi - lo
    window = np.repeat(np.arange(len(found)), found)
    inside = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
    place = suffix[order[lo[window] + inside]]
    size = block.size[window]
    # A longest match begins at a window whose word before differs on both sides, and ends at one whose word after
    # does; a 0 is an end of the text or a word that no item has. Only these are listed, not all pairs of places.
    ends = []
    for (key, items_, at_), beside in zip(block.sides, (text[place - 1], text[place + size])):
        own = (window << block.bits) | beside
        low, up = block.first[window], block.first[window + 1]
        same, over = (np.where(beside > 0, np.searchsorted(key, own, side=k), low) for k in ("left", "right"))
        many = up - over + same - low
        pair = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pair = np.where(pair < np.repeat(same - low, many), pair, pair + np.repeat(over - same, many)) + np.repeat(low, many)
        item, item_at = items_[pair], at_[pair]
        # From places in the padded text to rows and words of rows.
        spot = np.repeat(place, many)
        row = np.searchsorted(first[1:] + np.arange(1, len(counts) + 1), spot, side="right")
        word = spot - row - first[row]
        order = np.lexsort([word, word - item_at, item, row])
        ends.append([x[order] for x in (row, item, item_at, word, word + np.repeat(size, many))])
    # In this order the n-th beginning and the n-th end are of one match.
    (row, item, item_at, word, _), (*_, stop) = ends
    return counts, (row, item, item_at, word, stop - word)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> list[pa.Table]:
    """Bounded blocks of the benchmark; their number follows its size."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(id_col, text_col)
    total, longest = rows.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)), F.coalesce(F.max(F.octet_length(text_col)), F.lit(0))).first()
    if total <= limit:
        return [rows.toArrow()]
    # One block is fetched at a time; rows within the limit of a block by a running sum over chunks.
    n = -(-2 * total // limit)
    cut = rows.withColumn("_part", F.pmod(F.xxhash64(id_col, text_col), F.lit(n)))
    out: list[pa.Table] = []
    for part in range(n):
        piece = cut.where(F.col("_part") == part).drop("_part").toArrow()
        at = 0
        sizes = np.asarray(pa.compute.binary_length(piece.column(text_col)), dtype=np.int64)
        total_sizes = np.concatenate([[0], np.cumsum(sizes)])
        while at < len(sizes):
            stop = max(int(np.searchsorted(total_sizes, total_sizes[at] + limit, side="right")) - 1, at + 1)
            out.append(piece.slice(at, stop - at))
            at = stop
    return out


def _matches(schema_id: pa.DataType) -> pa.StructType:
    return pa.struct([("item_id", schema_id), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())])


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, matches) of every row: longest verbatim matches and their places.

    Places and lengths count words. An item that holds a window twice is
    reported at each place.
    """
    spark = ship(docs.sparkSession)
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    struct = f"array<struct<item_id:{item_kind},item_start:bigint,doc_start:bigint,n_words:bigint>>"
    parts = blocks(benchmark, item_col, item_text, block_bytes)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for k, part in enumerate(parts):
        shared = spark.sparkContext.broadcast((part.column(0).combine_chunks(), part.column(1).combine_chunks()))
        last = k == len(parts) - 1

        def run(batches, shared=shared, k=k, last=last):
            item_ids, texts = shared.value
            block = Block(texts, window)
            kind = _matches(item_ids.type)
            for batch in batches:
                _, offsets = utf8(batch.column(1))
                counts, found = [], []
                for a, b in steps(offsets):
                    n, m = search(block, batch.column(1).slice(a, b - a))
                    counts.append(n)
                    found.append((m[0] + a, *m[1:]))
                row, item, item_at, start, size = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 5
                values = pa.StructArray.from_arrays([item_ids.take(pa.array(item)), pa.array(item_at), pa.array(start), pa.array(size)], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)), values)
                names = ["id", "n_words", f"m{k}"]
                columns = [batch.column(0), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64)), lists]
                if not last:
                    columns.insert(1, batch.column(1))
                    names.insert(1, "text")
                for j in range(k):
                    columns.append(batch.column(batch.schema.get_field_index(f"m{j}")))
                    names.append(f"m{j}")
                yield pa.RecordBatch.from_arrays(columns, names=names)

        schema = f"id {kind}, " + "text string, " * (not last) + f"n_words long, m{k} {struct}" + "".join(f", m{j} {struct}" for j in range(k))
        out = out.select("id", "text", *([f"m{j}" for j in range(k)])).mapInArrow(run, schema)
    matches = F.concat(*(F.col(f"m{k}") for k in range(len(parts)))) if len(parts) > 1 else F.col("m0")
    return out.select(F.col("id").alias(id_col), "n_words", matches.alias("matches"))


def covered(matches: Column) -> Column:
    """Number of document words inside any match."""
    spans = F.sort_array(F.transform(matches, lambda m: F.struct(m["doc_start"].alias("s"), (m["doc_start"] + m["n_words"]).alias("e"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, x: Column) -> Column:
        more = F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(a["at"], x["s"]))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), (a["n"] + more).alias("n"))

    return F.when(F.size(matches) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(spans, start, step, lambda a: a["n"]))


def items(matches: Column) -> Column:
    """Different item ids as strings, in string order."""
    return F.sort_array(F.array_distinct(F.transform(matches, lambda m: m["item_id"].cast("string"))))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark window occurs."""
    spark = ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    for part in blocks(benchmark, item_col, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(part.column(1).combine_chunks())

        def run(batches, shared=shared):
            block = Block(shared.value, window)
            for batch in batches:
                hit = np.zeros(batch.num_rows, bool)
                _, offsets = utf8(batch.column(at))
                for a, b in steps(offsets):
                    hit[a + search(block, batch.column(at).slice(a, b - a))[1][0]] = True
                yield batch.filter(pa.array(~hit))

        docs = map_rows(docs, run)
    return docs
