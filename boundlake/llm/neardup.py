"""Near-duplicate documents: HyperMinHash sketches, banding, and exact confirmation.

A document is the set of its different 5-word shingles. Its sketch deals the
shingle hashes to buckets and keeps for each bucket's least hash the number of
leading zeros and a few bits of mantissa; empty buckets borrow from others.
Bands of registers propose pairs, a collision-corrected estimate of the Jaccard
similarity drops hopeless ones, and the full sets confirm the rest. Sets of few
shingles, whose registers hang together, are also proposed by the subsets that
similar ones share, so that none of their pairs is left to chance.

How groups are kept small: exact copies are one class and only its least id
goes on. Within a band's bucket only stars are proposed: every member with the
bucket's most central one. Members that stay outside the component of their
star's centre are then held against the other members by their rarest shingles,
which every similar pair shares, so no pair that a band proposes is lost unless
both are already connected. Sets meet their star's centre in salted groups of
bounded size.

A document of fewer than five words is one shingle of all its words. Null or
empty texts have no shingle and are linked with nothing. Rows that share an id
count as one document. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .stores import checkpointed
from .textnp import LOWER, NON_SPACE, gathered, mix, pack, steps, unpack, utf8, word_hashes, word_spans

SHINGLE = 5
#: Registers of a sketch and of a band. At similarity 0.75 a pair shares no
#: band with a chance of (1 - 0.75**4)**48, about one in 80 million, if
#: registers are independent; those of tiny sets are borrowed from a few.
BUCKETS, ROWS = 192, 4
BANDS = BUCKETS // ROWS
ZERO_BITS, MANTISSA_BITS = 6, 10
EMPTY = np.uint16(0xFFFF)
#: Chance that two different least hashes leave the same register.
COLLISION = 1 / 3 / (1 << MANTISSA_BITS)
#: Similarity as a fraction, compared in whole numbers.
NUMERATOR, DENOMINATOR = 75, 100
#: Largest set that is also proposed by its subsets.
SMALL = 8
#: Members that meet one copy of their star's centre.
SALT_ROWS = 200
#: Ids are broadcast up to this number (about 32 bytes each), else shuffled.
BROADCAST_IDS = 300_000
#: Ratio of the sizes between one class of set sizes and the next.
SIZE_STEP = 1.05
#: Bytes of text whose sets are made at a time; bounds the wide temporaries.
SET_BYTES = 1 << 19
_U = np.uint64


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of each row, ascending, and where rows begin."""
    raw = LOWER[raw]
    starts, ends, counts = word_spans(raw, offsets, NON_SPACE)
    h = word_hashes(raw, starts, ends)
    first = np.concatenate([[0], np.cumsum(counts)])
    a = _U(0x9E3779B97F4A7C15)
    rolled = h.copy()
    for k in range(1, SHINGLE):
        rolled = rolled[: max(len(h) - k, 0)] * a + h[k:]
    rolled = mix(rolled)
    out, sizes = [], []
    for i in range(len(counts)):
        n = int(counts[i])
        if n >= SHINGLE:
            found = np.unique(rolled[first[i] : first[i + 1] - SHINGLE + 1])
        elif n:
            whole = _U(n)
            with np.errstate(over="ignore"):
                for x in h[first[i] : first[i + 1]]:
                    whole = whole * a + x
            found = mix(np.array([whole], _U))
        else:
            found = np.zeros(0, _U)
        out.append(found)
        sizes.append(len(found))
    return (np.concatenate(out) if out else np.zeros(0, _U)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def registers(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of each row: leading zeros and mantissa of each bucket's least hash."""
    rows = len(begin) - 1
    out = np.full((rows, BUCKETS), EMPTY, np.uint16)
    if not len(hashes):
        return out
    row = np.repeat(np.arange(rows), np.diff(begin))
    slot = (((hashes >> _U(32)) * _U(BUCKETS)) >> _U(32)).astype(np.int64)
    cell = row * BUCKETS + slot
    least = np.ones(len(cell), bool)
    least[1:] = cell[1:] != cell[:-1]  # hashes ascend, so the first of a bucket is its least
    rest = hashes[least] * _U(BUCKETS)  # the hash's place inside its bucket, as a fraction of 2**64
    rest |= _U(1)
    zeros = np.zeros(len(rest), _U)
    shifted = rest.copy()
    for bits in (32, 16, 8, 4, 2, 1):
        small = shifted < (_U(1) << _U(64 - bits))
        zeros[small] += _U(bits)
        shifted[small] <<= _U(bits)
    mantissa = (shifted << _U(1)) >> _U(64 - MANTISSA_BITS)
    out.reshape(-1)[cell[least]] = np.minimum((zeros << _U(MANTISSA_BITS)) | mantissa, _U(0xFFFE)).astype(np.uint16)
    return out


def densified(found: np.ndarray, tries: int = 24) -> np.ndarray:
    """Fill empty registers from others of the row that a hash of the place picks."""
    out = found.copy()
    empty = found == EMPTY
    some = np.flatnonzero(empty.any(axis=1) & ~empty.all(axis=1))
    if not len(some):
        return out
    part, open_, full = out[some], empty[some], ~empty[some]
    for t in range(tries):
        source = (mix(np.arange(BUCKETS, dtype=_U) * _U(64) + _U(t + 1)) % _U(BUCKETS)).astype(np.int64)
        take = open_ & full[:, source]
        part[take] = part[:, source][take]
        open_ &= ~take
        if not open_.any():
            break
    if open_.any():  # the rest takes the nearest full register to the right
        place = np.where(np.tile(full, 2), np.arange(2 * BUCKETS), 4 * BUCKETS)
        nearest = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :BUCKETS] % BUCKETS
        part = np.where(open_, np.take_along_axis(found[some], nearest, axis=1), part)
    out[some] = part
    return out


def shared_sizes(n: int) -> list[int]:
    """Least numbers of shingles that a set of n shares with similar sets of up to ``SMALL``."""
    least = {m: -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR)) for m in range(1, SMALL + 1)}
    return sorted({k for m, k in least.items() if k <= min(n, m) and (n != m or k < n)})


#: For each small size, the subsets of each of these sizes by their members' places.
SUBSETS = {n: [np.array(list(itertools.combinations(range(n), k))) for k in shared_sizes(n)] for n in range(1, SMALL + 1)}


def subset_keys(hashes: np.ndarray, begin: np.ndarray) -> pa.ListArray:
    """Keys of each small set, of which any two similar ones share at least one; none for other sets."""
    sizes = np.diff(begin)
    mixed = mix(hashes ^ _U(0xC2B2AE3D27D4EB4F))
    out, lengths = [np.zeros(0, _U)], np.zeros(len(sizes), np.int32)
    for i in np.flatnonzero((sizes > 0) & (sizes <= SMALL)):
        own = mixed[begin[i] : begin[i + 1]]
        for places in SUBSETS[int(sizes[i])]:
            out.append(mix(own[places].sum(axis=1, dtype=_U) ^ _U(places.shape[1])))
            lengths[i] += len(places)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(np.concatenate(out).view(np.int64)))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, fp1, fp2, sketch, subsets): set size, 128-bit set fingerprint, dense registers and keys of small sets."""

    def run(batches):
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for a, b in steps(offsets, SET_BYTES):
                raw, at = utf8(batch.column(1).slice(a, b - a))
                hashes, begin = shingles(raw, at)
                sums = []
                for salt in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):
                    run_ = np.zeros(len(hashes) + 1, _U)
                    np.cumsum(mix(hashes ^ _U(salt)), out=run_[1:])
                    sums.append((run_[begin[1:]] - run_[begin[:-1]]).view(np.int64))
                dense = densified(registers(hashes, begin))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(begin)), pa.array(sums[0]), pa.array(sums[1]), pa.array([x.tobytes() for x in dense], pa.binary()), subset_keys(hashes, begin)],
                    names=["id", "n", "fp1", "fp2", "sketch", "subsets"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, n long, fp1 long, fp2 long, sketch binary, subsets array<long>")


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimate of each pair of sketches, corrected for chance collisions."""
    share = (a == b).mean(axis=1)
    return np.maximum((share - COLLISION) / (1 - COLLISION), 0)


def hopeful(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and estimate don't rule the similarity out.

    The estimate may fall short by six standard deviations, and sets with fewer
    shingles than registers, whose registers are not independent, all stay.
    """
    both = pairs.join(sketch.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(
        sketch.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b"
    )
    both = both.where(DENOMINATOR * F.least("na", "nb") >= NUMERATOR * F.greatest("na", "nb"))
    target = NUMERATOR / DENOMINATOR
    bound = target - 6 * (target * (1 - target) / BUCKETS) ** 0.5

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (2, 3))
            keep = (estimate(left, right) >= bound) | (batch.column(4).to_numpy() < 2 * BUCKETS)
            yield batch.select([0, 1]).filter(pa.array(keep))

    kind = dict(pairs.dtypes)["a"]
    return both.select("a", "b", "sa", "sb", F.least("na", "nb").alias("n")).mapInArrow(run, f"a {kind}, b {kind}")


def matching(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """Join on an id; ``ids`` is broadcast only if it is counted to be small."""
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, id_col, how)


def confirmed(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough; ``a`` is the centre of a star."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    salted = pairs.join(salts, "a")
    members = salted.select(F.col("b").alias("id"), F.col("a").alias("star"), F.pmod(F.xxhash64("b"), F.col("salts").cast("long")).cast("int").alias("salt"), F.lit(1).alias("role"))
    centres = salts.select(F.col("a").alias("id"), F.col("a").alias("star"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = checkpointed(members.unionByName(centres))
    kind = dict(docs.dtypes)[id_col]
    texts = matching(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), wanted, "id", "inner")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        centre = pdf[pdf["role"] == 0]
        found = []
        if len(centre):
            whole = np.cumsum(unpack(centre["payload"].iloc[0])[0], dtype=_U)
            for ident, payload in zip(pdf.loc[pdf["role"] == 1, "id"], pdf.loc[pdf["role"] == 1, "payload"]):
                own = np.cumsum(unpack(payload)[0], dtype=_U)
                at = np.minimum(np.searchsorted(whole, own), len(whole) - 1)
                shared = int((whole[at] == own).sum())
                if DENOMINATOR * shared >= NUMERATOR * (len(own) + len(whole) - shared):
                    found.append(ident)
        return pd.DataFrame({"a": [pdf["star"].iloc[0]] * len(found), "b": found}).astype({"a": pdf["star"].dtype, "b": pdf["star"].dtype})

    packed = texts.select("id", "star", F.struct("salt", "role").alias("at"), "text").mapInArrow(_packed_sets, f"id {kind}, star {kind}, at struct<salt:int,role:int>, payload binary")
    packed = packed.select("id", "star", "at.*", "payload")
    return packed.groupBy("star", "salt").applyInPandas(compare, f"a {kind}, b {kind}")


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, component) of every linked id, by least labels and pointer jumping.

    Every round each id takes the least label among itself and its neighbours,
    then the label of its label; rounds grow with the logarithm of the longest
    path at worst, and two or three do for stars.
    """
    both = checkpointed(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("id").alias("v"), F.col("component").alias("c")), "v").groupBy(F.col("u").alias("id")).agg(F.min("c").alias("near"))
        hooked = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        jump = labels.select(F.col("id").alias("now"), F.col("component").alias("further"))
        moved = checkpointed(hooked.join(jump, "now", "left").select("id", "was", F.least("now", F.coalesce("further", "now")).alias("component")))
        labels = moved.select("id", "component")
        if moved.where(F.col("was") != F.col("component")).isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def _labelled(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs with the components of both sides; an id without links is its own."""
    if labels is None:
        return pairs.withColumn("ca", F.col("a")).withColumn("cb", F.col("b"))
    left, right = (labels.select(F.col("id").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
    return pairs.join(left, "a", "left").join(right, "b", "left").withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, class_id, component_id, kept) of every row.

    ``class_id`` is the least id with exactly the same set, ``component_id`` the
    least id that links reach; one document of each component is kept.
    """
    ship(docs.sparkSession)
    sketch = checkpointed(sketches(docs, id_col, text_col))
    classes = checkpointed(sketch.where("n > 0").groupBy("n", "fp1", "fp2").agg(F.min("id").alias("rep")))
    reps = checkpointed(sketch.where("n > 0").join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n", "sketch", "subsets"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(F.col("sketch"), k * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    bands = reps.select("id", F.explode(F.concat(keys, "subsets")).alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = checkpointed(bands.join(shared, "key"))
    labels = None
    if not members.isEmpty():
        central = checkpointed(members.groupBy("id").agg(F.sum("size").alias("score")))
        scored = members.join(central, "id")
        leads = scored.groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("m"))).alias("best")).select("key", (-F.col("best.m")).alias("lead"), F.col("best.score").alias("lead_score"))
        starred = checkpointed(members.select("key", "id").join(leads, "key"))
        stars = checkpointed(starred.where("id <> lead").groupBy(F.col("lead").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("bands"), F.max("lead_score").alias("score")))
        hoped = checkpointed(hopeful(stars.select("a", "b"), reps).join(stars, ["a", "b"]))
        best = hoped.groupBy("b").agg(F.max(F.struct("bands", "score", (-F.col("a")).alias("m"))).alias("best")).select((-F.col("best.m")).alias("a"), "b")
        tried = checkpointed(best)
        links = checkpointed(confirmed(docs, tried, id_col, text_col))
        labels = None if links.isEmpty() else components(links)
        # What the first stars left apart: their other stars, and strangers by rare shingles.
        others = _labelled(hoped.select("a", "b"), labels).where("ca <> cb").select("a", "b")
        rare = hopeful(_strangers(docs, starred, labels, id_col, text_col), reps)
        open_ = checkpointed(others.unionByName(rare).join(tried, ["a", "b"], "left_anti").distinct())
        if not open_.isEmpty():
            more = checkpointed(confirmed(docs, open_, id_col, text_col))
            if not more.isEmpty():
                labels = components(links.unionByName(more))
    if labels is not None:
        classes = checkpointed(classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).select("n", "fp1", "fp2", "rep", "component"))
    else:
        classes = classes.withColumn("component", F.col("rep"))
    out = sketch.select("id", "n", "fp1", "fp2").join(classes, ["n", "fp1", "fp2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("class_id"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _strangers(docs: DataFrame, starred: DataFrame, labels: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    """Bucket members outside their star's component, with members that share a rare shingle.

    Sets this similar share a shingle among the rarest quarter of each, whatever
    rarity is, so long as both use one order. Here it is the number of member
    documents that hold the shingle, counted exactly: passages that many
    documents repeat come last and propose nothing.
    """

    known = _labelled(starred.select("key", F.col("lead").alias("a"), F.col("id").alias("b")), labels)
    known = checkpointed(known.select("key", F.col("b").alias("id"), F.col("cb").alias("component"), (F.col("ca") != F.col("cb")).alias("strange")))
    keys = known.where("strange").select("key").distinct()
    wanted = checkpointed(known.join(keys, "key", "left_semi").groupBy("id", "component").agg(F.max("strange").alias("strange")))
    rare = checkpointed(rarest(docs, wanted, id_col, text_col))
    side = lambda k, probe: rare.where(F.col("probe") == probe).select("shingle", "size", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "component", "strange", "n", "shared", "place")))
    once = "component_x <> component_y and (not strange_y or id_x < id_y)"
    enough = (DENOMINATOR + NUMERATOR) * F.least("shared_x", "shared_y") >= NUMERATOR * (F.col("n_x") + F.col("n_y"))
    # The shingle must be among the first n - overlap + 1 of both, for the overlap that both sizes ask.
    overlap = F.ceil(NUMERATOR * (F.col("n_x") + F.col("n_y")) / (DENOMINATOR + NUMERATOR))
    early = (F.col("place_x") <= F.col("n_x") - overlap) & (F.col("place_y") <= F.col("n_y") - overlap)
    pairs = side("x", True).join(side("y", False), ["shingle", "size"]).where(once).where(enough & early)
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def rarest(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(probe, shingle, size, id, component, strange, n, shared, place): rarest shared shingles of each wanted set.

    ``shared`` counts the set's shingles that any other wanted document holds;
    sets of n and m shingles that are similar enough share 3/7 of n + m, so both
    need that many. A set is listed under its own class of sizes; a stranger also
    probes each class that its shared shingles allow, with the shorter list that
    the class's sizes allow.

    Blocks of documents ask the owners of hash ranges how many wanted documents
    hold each of their different shingles, one message for each owner, so a
    common shingle is one entry of a message.
    """
    kind = dict(docs.dtypes)[id_col]
    owners = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = matching(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), wanted, "id", "inner")
    sets = checkpointed(texts.select("id", "component", "strange", "text").mapInArrow(_packed_sets, f"id {kind}, component {kind}, strange boolean, payload binary"))
    asked = sets.mapInArrow(lambda it: _set_blocks(it, owners), "block long, owner int, payload binary")
    own = "block long, owner int, payload binary, ids array<{0}>, components array<{0}>, strange array<boolean>".format(kind)
    none = {"ids": F.lit(None).cast(f"array<{kind}>"), "components": F.lit(None).cast(f"array<{kind}>"), "strange": F.lit(None).cast("array<boolean>")}
    answers = asked.groupBy("owner").applyInPandas(_holders, "block long, owner int, payload binary").withColumns(none)
    blocks = sets.mapInArrow(lambda it: _set_blocks(it, 0), own)
    return blocks.unionByName(answers).groupBy("block").applyInPandas(_rare_in_block, f"probe boolean, shingle long, size int, id {kind}, component {kind}, strange boolean, n long, shared long, place long")


def _packed_sets(batches):
    for batch in batches:
        _, offsets = utf8(batch.column(3))
        payload = []
        for a, b in steps(offsets, SET_BYTES):
            raw, at = utf8(batch.column(3).slice(a, b - a))
            hashes, begin = shingles(raw, at)
            payload += [pack(np.diff(hashes[i:j], prepend=_U(0))) for i, j in zip(begin, begin[1:])]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(payload, pa.binary())], names=[*batch.schema.names[:3], "payload"])


def _set_blocks(batches, owners: int, most: int = 4 << 20):
    """Messages to ``owners``, or (0 owners) the blocks themselves; blocks of about ``most`` packed bytes."""
    number = TaskContext.get().partitionId() << 24
    for batch in gathered(batches, 3, most):
        packed = batch.column(3).to_pylist()
        ends = np.cumsum([len(x) for x in packed])
        first = 0
        while first < len(packed):
            last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")), first + 1)
            own = [np.cumsum(unpack(x)[0], dtype=_U) for x in packed[first:last]]
            if owners:
                hashes, counts = np.unique(np.concatenate(own), return_counts=True)
                cut = np.searchsorted(hashes, np.array([(k << 64) // owners for k in range(owners)], dtype=_U)).tolist() + [len(hashes)]
                rows = [(number, k, pack(np.diff(hashes[a:b], prepend=_U(0)), counts[a:b])) for k, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], names=["block", "owner", "payload"])
            else:
                at, n = pa.array([0, last - first], pa.int32()), last - first
                lists = [pa.ListArray.from_arrays(at, batch.column(k).slice(first, n)) for k in range(3)]
                payload = pack(np.array([len(x) for x in own], np.int64), np.concatenate([np.diff(x, prepend=_U(0)) for x in own]))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([-1], pa.int32()), pa.array([payload], pa.binary()), *lists], names=["block", "owner", "payload", "ids", "components", "strange"])
            number += 1
            first = last


def _holders(pdf: pd.DataFrame) -> pd.DataFrame:
    """Number of documents with each shingle, for every block that asked."""
    asked = [unpack(x) for x in pdf["payload"]]
    hashes = np.concatenate([np.cumsum(x[0], dtype=_U) for x in asked])
    _, which = np.unique(hashes, return_inverse=True)
    total = np.bincount(which, np.concatenate([x[1] for x in asked])).astype(np.int64)
    starts = np.cumsum([0] + [len(x[0]) for x in asked])
    return pd.DataFrame({"block": pdf["block"], "owner": pdf["owner"], "payload": [pack(total[which[a:b]]) for a, b in zip(starts, starts[1:])]})


def _rare_in_block(pdf: pd.DataFrame) -> pd.DataFrame:
    own = pdf[pdf["owner"] < 0].iloc[0]
    answers = pdf[pdf["owner"] >= 0].sort_values("owner")
    sizes, steps_ = unpack(own["payload"])
    begin = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    own_sets = [np.cumsum(steps_[a:b], dtype=_U) for a, b in zip(begin, begin[1:])]
    hashes = np.unique(np.concatenate(own_sets)) if own_sets else np.zeros(0, _U)
    held = np.concatenate([unpack(x)[0] for x in answers["payload"]]).astype(np.int64) if len(answers) else np.zeros(0, np.int64)
    if len(held) != len(hashes):
        raise RuntimeError("a block's answers are not whole")
    names = ("probe", "shingle", "size", "id", "component", "strange", "n", "shared", "place")
    out: dict[str, list] = {k: [] for k in names}
    for ident, component, strange, found in zip(own["ids"], own["components"], own["strange"], own_sets):
        n = len(found)
        df = held[np.searchsorted(hashes, found)]
        order = np.lexsort([found, df])
        alone, shared = int((df < 2).sum()), int((df > 1).sum())
        lists = [(False, size_class(n), n - -(-NUMERATOR * n // DENOMINATOR) + 1)]
        if strange:
            least, most = -(-NUMERATOR * n // DENOMINATOR), min(DENOMINATOR * n // NUMERATOR, (DENOMINATOR + NUMERATOR) * shared // NUMERATOR - n)
            for k in range(size_class(least), size_class(most) + 1 if most >= least else 0):
                overlap = -(-NUMERATOR * (n + max(least, int(SIZE_STEP**k))) // (DENOMINATOR + NUMERATOR))
                lists.append((True, k, n - overlap + 1))
        for probe, k, length in lists:
            some = found[order[alone:length]].view(np.int64)
            out["shingle"].append(some)
            out["place"] += range(alone, alone + len(some))
            for name, value in zip(("probe", "size", "id", "component", "strange", "n", "shared"), (probe, k, ident, component, strange, n, shared)):
                out[name] += [value] * len(some)
    out["shingle"] = np.concatenate(out["shingle"]) if out["shingle"] else np.zeros(0, np.int64)
    return pd.DataFrame(out, columns=list(names))


def size_class(n: int) -> int:
    """Class of set sizes that differ by about a twentieth."""
    return int(math.log(n) / math.log(SIZE_STEP) + 1e-9) if n > 0 else 0


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates of a kept document."""
    found = find(docs, id_col, text_col)
    gone = checkpointed(found.where(~F.col("kept")).select(id_col).distinct())
    return matching(docs, gone, id_col, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
