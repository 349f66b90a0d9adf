"""Graphs, gluing, hash chains and Merkle trees, boxes and probes."""

from __future__ import annotations

import hashlib
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from ..stores import checkpointed

#: Rows of a sheet that meet the ranges over them in one key of a join.
ROWS = 256
#: Levels after which the union of all levels is written as one table, so that plans stay small.
FOLD = 32


def reach(edges: DataFrame, starts: DataFrame, most: int | None = 3, src: str = "src", dst: str = "dst") -> DataFrame:
    """(start, node, depth) of everything within ``most`` steps (None: at any depth), each at its least depth.

    One join for each level, until a level finds nothing new; nodes that are
    already known are not followed again, so the search ends on cycles too.
    """
    known = starts.select(F.col("node").alias("start"), F.col("node"), F.lit(0).alias("depth"))
    front = known
    step = edges.select(F.col(src).alias("node"), F.col(dst).alias("next"))
    for depth in itertools.count(1) if most is None else range(1, most + 1):
        found = front.join(step, "node").select("start", F.col("next").alias("node")).distinct()
        front = checkpointed(found.join(known.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        known = known.unionByName(front)
        if depth % FOLD == 0:
            known = checkpointed(known.repartition("start", "node"))
    return known


def affected(edges: DataFrame, starts: DataFrame, most: int | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """Everything that depends on the starts, by reversed edges; a start only if it is on a cycle.

    Dependants are followed to the end, or within ``most`` steps where given.
    """
    back = edges.select(F.col(dst).alias("src"), F.col(src).alias("dst"))
    found = reach(back, starts, most)
    closing = found.join(back.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node").where("next = start")
    loops = closing.groupBy("start").agg((F.min("depth") + 1).alias("depth")).select("start", F.col("start").alias("node"), "depth")
    return found.where("depth > 0").unionByName(loops)


def topological_levels(edges: DataFrame, most: int | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, level): longest path from a source; nodes on or behind a cycle get level -1.

    As many levels as there are; more than ``most``, where given, raise an error.
    """
    e = checkpointed(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    left = checkpointed(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    out = None
    for level in itertools.count():
        if level == most:
            raise RuntimeError(f"the graph has more than {most} levels")
        blocked = e.select(F.col("dst").alias("node")).distinct()
        free = checkpointed(left.join(blocked, "node", "left_anti").withColumn("level", F.lit(level)))
        out = free if out is None else out.unionByName(free)
        left = checkpointed(left.join(blocked, "node", "left_semi"))
        e = checkpointed(e.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
        if left.isEmpty():
            return out
        if free.isEmpty():
            break
        if level % FOLD == FOLD - 1:
            out = checkpointed(out.repartition("node"))
    return out.unionByName(left.withColumn("level", F.lit(-1)))


def sinks(nodes: DataFrame, edges: DataFrame, node: str, src: str = "src") -> DataFrame:
    """Nodes that are never a source: the margin targets of a model."""
    return nodes.join(edges.select(F.col(src).alias(node)), node, "left_anti")


def merge_edges(syntactic: DataFrame, measured: DataFrame) -> DataFrame:
    """Union of two edge sets with their origin and measured sensitivity."""
    a = syntactic.select("src", "dst").distinct().withColumn("_a", F.lit(True))
    b = measured.groupBy("src", "dst").agg(F.max("sens").alias("sens")).withColumn("_b", F.lit(True))
    origin = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "syntactic").otherwise("interventional")
    return a.join(b, ["src", "dst"], "full_outer").select("src", "dst", origin.alias("origin"), "sens")


def touching(links: DataFrame, node, *ends: str) -> DataFrame:
    """Links with a node at any of their ends: what an artifact came from and what came of it."""
    hit = F.lit(False)
    for end in ends:
        hit |= F.coalesce(F.col(end) == F.lit(node), F.lit(False))
    return links.where(hit)


def over_ranges(ranges: DataFrame, cells: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, names, cells, total, mean) of the values in each range ``row0 .. row1`` by ``col0 .. col1``; ranges without a value are left out.

    A range meets the cells by column and by its part of blocks of ``ROWS`` rows, so the join is an equi join and
    a range that is long is not written out cell by cell.
    """
    block = lambda c: F.floor(F.col(c) / ROWS)
    wanted = ranges.withColumn("_block", F.explode(F.sequence(block("row0"), block("row1")))).withColumn("_col", F.explode(F.sequence(F.col("col0"), F.col("col1"))))
    held = cells.select(*keys, block("row").alias("_block"), F.col("col").alias("_col"), F.col("row").alias("_row"), "value")
    met = wanted.join(held, [*keys, "_block", "_col"]).where(F.col("_row").between(F.col("row0"), F.col("row1")))
    return met.groupBy(*keys, *names).agg(F.count("value").alias("cells"), F.sum("value").alias("total"), F.avg("value").alias("mean"))


def left_labels(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Each value cell with the text of the cell directly to its left."""
    w = Window.partitionBy(*keys, "row").orderBy("col")
    near = F.when(F.lag("col").over(w) == F.col("col") - 1, F.lag("text").over(w))
    return cells.withColumn("label", near)


def glue(sections: DataFrame) -> DataFrame:
    """Meet of each symbol's intervals over all regions.

    A symbol whose intervals have no point in common, or whose regions disagree
    on its dimension, is in conflict; its meet is empty. Both ends are maxima
    and minima, so regions combine in any order and partly before the shuffle.
    """
    g = sections.groupBy("sym").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.countDistinct("dim").alias("dims"), F.count("*").alias("regions"))
    conflict = F.when(F.col("dims") > 1, "dimension").when(F.col("lo") > F.col("hi"), "range")
    return g.select("sym", "lo", "hi", "regions", conflict.alias("conflict"), (conflict.isNull()).alias("consistent"))


def fold_glue(sections: DataFrame) -> DataFrame:
    """Meet in a given order with every conflicting region named: a region in conflict is skipped."""
    item = F.struct("ord", "region", "lo", "hi")
    ordered = sections.groupBy("sym").agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        lo, hi = F.greatest(a["lo"], x["lo"]), F.least(a["hi"], x["hi"])
        clash = lo > hi
        return F.struct(F.when(clash, a["lo"]).otherwise(lo).alias("lo"), F.when(clash, a["hi"]).otherwise(hi).alias("hi"), F.when(clash, F.array_append(a["out"], x["region"])).otherwise(a["out"]).alias("out"))

    return ordered.select("sym", F.aggregate("items", start, step).alias("g")).select("sym", "g.lo", "g.hi", F.col("g.out").alias("conflicts"))


def cohomology(overlaps: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(symbol, h0, h1, obstructed) from offsets between regions, by weighted union-find for each symbol."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict = {}
        shift: dict = {}

        def find(x):
            total, path = 0.0, []
            while parent.setdefault(x, x) != x:
                path.append(x)
                x = parent[x]
            for p in reversed(path):
                total += shift[p]
                parent[p], shift[p] = x, total
            return x

        extra, bad = 0, False
        for a, b, offset in sorted(zip(pdf["a"], pdf["b"], pdf["offset"])):
            ra, rb = find(a), find(b)
            pa_, pb = (0.0 if r == x else shift[x] for r, x in ((ra, a), (rb, b)))
            if ra == rb:
                extra += 1
                bad |= abs(pa_ + offset - pb) > tolerance
            else:
                parent[rb], shift[rb] = ra, pa_ + offset - pb
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "h0": [sum(find(x) == x for x in list(parent))], "h1": [extra], "obstructed": [bad]})

    ship(overlaps.sparkSession)
    return overlaps.groupBy("symbol").applyInPandas(solve, "symbol string, h0 long, h1 long, obstructed boolean")


def chain(entries: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """Hash chain of each key: h_i = sha256(seq | h_{i-1} | payload), from 64 zeros.

    A chain is sequential by nature; keys run in parallel.
    """
    item = F.struct(F.col(order).alias("o"), F.col(payload).cast("string").alias("p"))
    rows = entries.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).alias("n"), F.lit("0" * 64).alias("h"), F.array().cast("array<struct<seq:int,o:bigint,p:string,prev:string,h:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        h = F.sha2(F.concat_ws("|", a["n"].cast("string"), a["h"], x["p"]), 256)
        row = F.struct(a["n"].alias("seq"), x["o"].cast("bigint").alias("o"), x["p"].alias("p"), a["h"].alias("prev"), h.alias("h"))
        return F.struct((a["n"] + 1).alias("n"), h.alias("h"), F.array_append(a["out"], row).alias("out"))

    out = rows.select(key, F.explode(F.aggregate("items", start, step, lambda a: a["out"])).alias("e"))
    return out.select(key, F.col("e.seq").alias("seq"), F.col("e.o").alias(order), F.col("e.p").alias("payload"), F.col("e.prev").alias("prev_hash"), F.col("e.h").alias("entry_hash"))


def broken(chains: DataFrame, key: str) -> DataFrame:
    """Entries whose link or hash does not hold; every entry is checked on its own."""
    before = F.coalesce(F.lag("entry_hash").over(Window.partitionBy(key).orderBy("seq")), F.lit("0" * 64))
    whole = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "prev_hash", "payload"), 256)
    return chains.withColumn("_before", before).where((F.col("prev_hash") != F.col("_before")) | (F.col("entry_hash") != whole)).drop("_before")


def ranked(rows: DataFrame, key: str, order: list[Column], name: str = "at") -> DataFrame:
    """Rows numbered from 0 within their key, in order; a key of any size spreads over many tasks.

    Rows are dealt by ranges of (key, order), so each task holds a run of a key;
    runs are numbered by themselves and moved on by the sizes of those before.
    """
    by = [F.col(key), *order]
    run = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_run", F.spark_partition_id())
    dealt = checkpointed(run)
    sizes = dealt.groupBy(key, "_run").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(key, "_run").orderBy(*order)) - 1
    return dealt.withColumn(name, own).join(starts, [key, "_run"]).withColumn(name, F.col(name) + F.col("_start")).drop("_run", "_start")


#: Levels of a Merkle tree that one row of a fold makes.
LEVELS = 10


def merkle_roots(leaves: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """(key, leaves, root): leaves prefixed by 00, inner nodes by 01, an odd node is paired with itself.

    Keys of up to 2 ** LEVELS leaves fold in one row each. Of larger ones blocks of
    that many neighbouring nodes fold to one, again and again until every key has
    one node, so a key of any number of leaves spreads over tasks; no row holds
    more than one block. Equal orders go by the leaf's hash.
    """
    hashed = leaves.select(key, F.col(order).alias("o"), F.sha2(F.concat(F.unhex(F.lit("00")), F.encode(F.col(payload).cast("string"), "utf-8")), 256).alias("h"))
    hashed = hashed.where(F.col(key).isNotNull())
    counts = hashed.groupBy(key).agg(F.count("*").alias("leaves"))
    deepest = counts.agg(F.max("leaves")).first()[0] or 1
    few = hashed if deepest <= 2**LEVELS else hashed.join(counts.where(F.col("leaves") <= 2**LEVELS).select(key), key, "left_semi")
    nodes = F.transform(F.sort_array(F.collect_list(F.struct("o", "h"))), lambda x: x["h"])
    whole = few.groupBy(key).agg(nodes.alias("nodes")).withColumn("leaves", F.size("nodes").cast("long")).withColumn("size", F.col("leaves"))
    done = _folded(whole, min(deepest, 2**LEVELS)).select(key, "leaves", F.col("nodes")[0].alias("root"))
    if deepest <= 2**LEVELS:
        return done
    large = hashed.join(counts.where(F.col("leaves") > 2**LEVELS), key)
    level = ranked(large, key, [F.col("o"), F.col("h")]).select(key, "leaves", F.col("leaves").alias("size"), "at", "h")
    while deepest > 1:
        block = F.floor(F.col("at") / 2**LEVELS).alias("at")
        nodes = F.transform(F.sort_array(F.collect_list(F.struct("at", "h"))), lambda x: x["h"])
        blocks = _folded(level.groupBy(key, "leaves", "size", block).agg(nodes.alias("nodes")), deepest)
        level = checkpointed(blocks.select(key, "leaves", "size", "at", F.col("nodes")[0].alias("h")))
        deepest = -(-deepest // 2**LEVELS)
    return done.unionByName(level.select(key, "leaves", F.col("h").alias("root")))


def _folded(blocks: DataFrame, most: int) -> DataFrame:
    """Blocks of nodes after as many levels as ``most`` nodes need, ``LEVELS`` at most.

    A key's level (of ``size`` nodes) is left alone once it has one node; a
    block's last node pairs with itself only where the whole level's does.
    """
    for _ in range(min(LEVELS, max(most - 1, 0).bit_length())):
        n = F.size("nodes")
        pair = lambda i: F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(F.get("nodes", 2 * i)), F.unhex(F.coalesce(F.get("nodes", 2 * i + 1), F.get("nodes", 2 * i)))), 256)
        half = F.transform(F.sequence(F.lit(0), F.floor((n + 1) / 2).cast("int") - 1), pair)
        blocks = blocks.withColumn("nodes", F.when(F.col("size") > 1, half).otherwise(F.col("nodes"))).withColumn("size", F.ceil(F.col("size") / 2))
    return blocks


def merkle_root(leaves: list[bytes]) -> str:
    """The same on the driver, for small lists."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
    return level[0].hex()


def merkle_proof(leaves: list[bytes], at: int) -> list[tuple[bool, bytes]]:
    """(sibling is on the right, sibling) from a leaf to the root."""
    level, proof = [hashlib.sha256(b"\0" + x).digest() for x in leaves], []
    while len(level) > 1:
        other = min(at ^ 1, len(level) - 1)
        proof.append((at % 2 == 0, level[other]))
        level = [hashlib.sha256(b"\1" + level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
        at //= 2
    return proof


def merkle_verify(leaf: bytes, proof: list[tuple[bool, bytes]], root: str) -> bool:
    h = hashlib.sha256(b"\0" + leaf).digest()
    for right, other in proof:
        h = hashlib.sha256(b"\1" + (h + other if right else other + h)).digest()
    return h.hex() == root
