"""Trie of conversations that share the head of their group's first one.

Conversation c is rebuilt as the first h turns of conversation c - c % group,
then its own turns after its first h, with h = crc32 of its decimal id modulo
``heads``. Rebuilt texts are never made. A turn counts by its address (128 bits of
SHA-256 over role and text), a sequence of turns by an element of a monoid: a
polynomial hash modulo 2**127 - 1 and the power that moves what stands before
it. Elements of base head and own suffix multiply to the fingerprint of the
rebuilt prefix, and a prefix of the own turns is divided off on the left.

Turns are dealt by ranges of (base, conversation, turn), so one huge conversation
spreads over tasks. Each task sums up its ends, a fold over these (a few for each
task) gives what every task starts with, and a second reading writes one small
row for each rebuilt turn. Prefix groups are then checked: members of a group agree
in depth, parent and address of the last turn, and all stored turns of one
address have the same role and text, so by induction the sequences are equal. A
disagreement starts the work anew with another base of the polynomial.

Rows without a conversation id take no part. Null role or text: as empty. Turns
of equal number follow in order of role and address; repeated rows are turns of
their own. A conversation left without turns belongs to the root alone. An
empty table has no root. Other columns are not read.
"""

from __future__ import annotations

import dataclasses
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .stores import checkpointed

PRIME = (1 << 127) - 1
#: Depths of one conversation that meet its totals in one key of a join.
DEPTHS = 4096
#: Ids of one node that are joined to a text at a time.
IDS = 1024
#: Nodes with more children than this share of all nodes (and than this number) are looked up by broadcast: no more than this many.
MANY = 10_000
ROWS = 4096

SEGMENT = "part int, at int, base long, conv long, n long, hash binary, words long, firsts array<struct<address:binary,words:long>>"
STEP = "conv long, depth int, fa long, fb long, pa long, pb long, ta long, tb long, words long, before long"


class Monoid:
    """Sequences of addresses under concatenation: (hash, length), with powers of one base."""

    def __init__(self, seed: int):
        self.base = 2 + int.from_bytes(hashlib.sha256(b"prefix%d" % seed).digest()[:16]) % (PRIME - 3)

    def join(self, left: int, right: int, length: int) -> int:
        """Hash of left + right, where right has the given length."""
        return (left * pow(self.base, length, PRIME) + right) % PRIME

    def cut(self, left: int, whole: int, length: int) -> int:
        """Hash of what follows ``left`` in ``whole``, of the given length."""
        return (whole - left * pow(self.base, length, PRIME)) % PRIME

    def of(self, addresses) -> int:
        total = 0
        for x in addresses:
            total = (total * self.base + 1 + int.from_bytes(x)) % PRIME
        return total


@dataclasses.dataclass
class Run:
    """Turns of one conversation from its start, or from the start of a task's part of it."""

    base: int | None = None
    conv: int | None = None
    n: int = 0
    hash: int = 0
    words: int = 0
    firsts: list[tuple[bytes, int]] = dataclasses.field(default_factory=list)

    def add(self, m: Monoid, address: bytes, words: int, heads: int) -> None:
        self.hash = (self.hash * m.base + 1 + int.from_bytes(address)) % PRIME
        self.n, self.words = self.n + 1, self.words + words
        if len(self.firsts) < heads - 1:
            self.firsts.append((address, words))

    def followed(self, m: Monoid, other: Run, heads: int) -> Run:
        return Run(self.base, self.conv, self.n + other.n, m.join(self.hash, other.hash, other.n), self.words + other.words, (self.firsts + other.firsts)[: heads - 1])


def _turns(conversations: DataFrame, group: int, heads: int, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One small row for each turn, in order of group (its first conversation first), conversation and turn."""
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    by = F.coalesce(F.col(role).cast("string"), F.lit(""))
    c = F.col(conv).cast("long")
    small = conversations.where(c.isNotNull()).select(
        (c - c % group).alias("base"), c.alias("conv"), F.col(turn).alias("turn"), by.alias("role"), address(by, said).alias("address"),
        F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        (F.crc32(c.cast("string").cast("binary")) % heads).cast("int").alias("h"),
    )
    order = [F.col("base"), F.col("conv") != F.col("base"), F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("address")]
    return small.repartitionByRange(*order).sortWithinPartitions(*order).select("base", "conv", "h", "address", "words")


def address(role: Column, text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def _segments(turns: DataFrame, m: Monoid, heads: int) -> list:
    """For each task its first and last conversation, and that of the base of its last group."""

    def run(batches):
        here, done, kept = Run(), 0, {}

        def close():
            if here.conv is not None:
                row = (TaskContext.get().partitionId(), done, here.base, here.conv, here.n, here.hash.to_bytes(16), here.words, list(here.firsts))
                kept.setdefault("first", row)
                kept["last"] = row
                if here.conv == here.base:
                    kept["base"] = row

        for batch in batches:
            for base, conv, address, words in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if conv != here.conv:
                    close()
                    here, done = Run(base, conv), done + 1
                here.add(m, address, words, heads)
        close()
        rows = sorted({r[1]: r for r in kept.values()}.values(), key=lambda r: r[1])
        names = [x.split()[0] for x in SEGMENT.split(", ")]
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*r[:7], [{"address": a, "words": w} for a, w in r[7]]))) for r in rows], schema=SEGMENT_ARROW)

    found = turns.select("base", "conv", "address", "words").mapInArrow(run, SEGMENT).toArrow().to_pylist()
    return sorted(found, key=lambda r: (r["part"], r["at"]))


SEGMENT_ARROW = pa.schema(
    [("part", pa.int32()), ("at", pa.int32()), ("base", pa.int64()), ("conv", pa.int64()), ("n", pa.int64()), ("hash", pa.binary()), ("words", pa.int64())]
    + [("firsts", pa.list_(pa.struct([("address", pa.binary()), ("words", pa.int64())])))]
)


def _starts(segments: list, m: Monoid, heads: int) -> dict[int, tuple[Run, Run]]:
    """What each task starts with: the conversation that goes on, and the base conversation of its group."""
    here, base, out = Run(), Run(), {}
    for s in segments:
        out.setdefault(s["part"], (here, base))
        part = Run(s["base"], s["conv"], s["n"], int.from_bytes(s["hash"]), s["words"], [(x["address"], x["words"]) for x in s["firsts"]])
        here = here.followed(m, part, heads) if here.conv == part.conv else part
        if here.conv == here.base:
            base = here
    return out


def _halves(x: int) -> tuple[int, int]:
    """128 bits as two signed longs."""
    return tuple(int.from_bytes(x.to_bytes(16)[i : i + 8], signed=True) for i in (0, 8))


def _steps(turns: DataFrame, starts: dict, m: Monoid, heads: int) -> DataFrame:
    """One row for each depth of each rebuilt conversation: fingerprints of node and parent, last turn, its words and those before it."""
    shared = turns.sparkSession.sparkContext.broadcast(starts)
    names = [x.split()[0] for x in STEP.split(", ")]
    schema = pa.schema([(n, pa.int32() if n == "depth" else pa.int64()) for n in names])

    def run(batches):
        here, base = shared.value.get(TaskContext.get().partitionId(), (Run(), Run()))
        here = dataclasses.replace(here, firsts=list(here.firsts))
        out, state = [], None

        def head_of(base_id: int, conv: int, h: int) -> tuple[list, int]:
            """Turns taken from the base, and how many own ones they stand for."""
            if conv == base_id:
                return [], 0
            return (base.firsts[:h] if base.conv == base_id else []), h

        def resume(base_id: int, conv: int, h: int):
            """(head's hash, its words, its turns, own turns left out, hash and words of those, last fingerprint)."""
            taken, skip = head_of(base_id, conv, h)
            own = here.firsts[:skip]
            left, left_words = m.of(a for a, _ in own), sum(w for _, w in own)
            head, head_words = m.of(a for a, _ in taken), sum(w for _, w in taken)
            after = max(here.n - skip, 0)
            return [head, head_words, len(taken), skip, left, left_words, m.join(head, m.cut(left, here.hash, after), after) if after else head]

        for batch in batches:
            for base_id, conv, h, turn, words in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if conv != here.conv:
                    if here.conv == here.base:
                        base = here
                    here = Run(base_id, conv)
                    out.append((conv, 0, 0, 0, None, None, 0, 0, 0, 0))
                    above, before = 0, 0
                    for depth, (a, w) in enumerate(head_of(base_id, conv, h)[0], 1):
                        now = (above * m.base + 1 + int.from_bytes(a)) % PRIME
                        out.append((conv, depth, *_halves(now), *_halves(above), *_halves(int.from_bytes(a)), w, before))
                        above, before = now, before + w
                    state = resume(base_id, conv, h)
                elif state is None:
                    state = resume(base_id, conv, h)
                here.add(m, turn, words, heads)
                head, head_words, taken, skip, left, left_words, above = state
                if here.n <= skip:
                    state[4], state[5] = here.hash, here.words
                else:
                    after = here.n - skip
                    # The rebuilt prefix is head * suffix; the suffix is the own prefix with its first turns divided off.
                    now = m.join(head, m.cut(left, here.hash, after), after)
                    out.append((conv, taken + after, *_halves(now), *_halves(above), *_halves(int.from_bytes(turn)), words, head_words + here.words - words - left_words))
                    state[6] = now
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return turns.select("base", "conv", "h", "address", "words").mapInArrow(run, STEP)


def _nodes(steps: DataFrame) -> DataFrame:
    """One row for each fingerprint; ``odd`` where its members disagree."""
    same = [F.min(c) != F.max(c) for c in ("depth", "pa", "pb", "ta", "tb")]
    odd = F.lit(False)
    for x in same:
        odd |= F.coalesce(x, F.lit(False))
    return steps.groupBy("fa", "fb").agg(
        F.min("conv").alias("rep"), F.count("*").alias("n"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
        F.min("words").alias("words"), F.min("before").alias("before"), odd.alias("odd"),
    )


def _ends(convs: DataFrame) -> DataFrame:
    """(fa, fb, ends): hash of the ids that end at a node. Ids become texts in blocks; one pass over the blocks of a node, in order, takes the hash."""
    block = F.expr(f"(conv - pmod(conv, {IDS}L)) div {IDS}")
    texts = convs.groupBy("fa", "fb", block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches):
        key = digest = None
        out: list[tuple] = []
        for batch in batches:
            for fa, fb, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (fa, fb) == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (fa, fb), hashlib.sha256()
                digest.update(ids.encode())
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["fa", "fb", "ends"])
                out = []
        if key is not None:
            out.append((*key, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["fa", "fb", "ends"])

    return texts.repartition("fa", "fb").sortWithinPartitions("fa", "fb", "block").select("fa", "fb", "ids").mapInArrow(run, "fa long, fb long, ends string")


def build(conversations: DataFrame, group: int = 20, heads: int = 4, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    Subtree sums need no walk over the tree. A member that is not a node's least
    one shares the node's words, and does so until the depth from which on it is
    the least one itself; so ``saved_tokens`` is a sum over members of the words
    before that depth. Leaves are counted by the members that are their least.
    """
    ship(conversations.sparkSession)
    said, by = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (text, role))
    stored = conversations.where(F.col(conv).isNotNull()).select(address(by, said).alias("a"), by.alias("r"), said.alias("t"))
    unlike = stored.groupBy("a").agg(((F.min("t") != F.max("t")) | (F.min("r") != F.max("r"))).alias("odd")).where("odd")
    if not unlike.isEmpty():
        raise RuntimeError("two different turns have one address")
    turns = checkpointed(_turns(conversations, group, heads, conv, turn, role, text))
    for seed in range(3):
        m = Monoid(seed)
        steps = checkpointed(_steps(turns, _starts(_segments(turns, m, heads), m, heads), m, heads))
        nodes = checkpointed(_nodes(steps))
        seen = nodes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("odd").cast("int")), F.lit(0)).alias("odd")).first()
        if not seen.odd:
            break
    else:
        raise RuntimeError("prefixes collide under three bases")

    children = nodes.where(F.col("pa").isNotNull()).groupBy(F.col("pa").alias("fa"), F.col("pb").alias("fb")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["fa", "fb"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    # The least members: from which depth on, the words before it, and whether they end at a leaf.
    least = nodes.groupBy(F.col("rep").alias("conv")).agg(F.min("depth").alias("own"), F.min_by("before", "depth").alias("shared"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    last = F.max_by(F.struct("fa", "fb", (F.col("before") + F.col("words")).alias("all")), "depth")
    convs = steps.groupBy("conv").agg(F.max("depth").alias("deepest"), last.alias("last")).select("conv", "deepest", "last.*").join(least, "conv", "left")
    totals = convs.select(
        "conv", F.coalesce("own", F.col("deepest") + 1).alias("own"), F.coalesce("shared", "all").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"),
        F.explode(F.sequence(F.lit(0), F.expr(f"int(deepest div {DEPTHS})"))).alias("block"),
    )
    sums = steps.withColumn("block", F.expr(f"int(depth div {DEPTHS})")).join(totals, ["conv", "block"]).groupBy("fa", "fb")
    sums = sums.agg(F.sum("leaf").alias("n_leaves"), F.sum(F.when(F.col("depth") < F.col("own"), F.col("shared")).otherwise(0)).alias("shared"))
    nodes = checkpointed(nodes.join(sums, ["fa", "fb"]).join(_ends(convs.select("conv", "fa", "fb")), ["fa", "fb"], "left"))

    # At most MANY nodes can have more than 1 / MANY of all nodes as children.
    many = F.col("n_children") > max(MANY, seen.n // MANY)
    parents = nodes.select(F.col("fa").alias("pa"), F.col("fb").alias("pb"), F.col("rep").alias("parent"), many.alias("many"))
    first = nodes.join(F.broadcast(parents.where("many").drop("many")), ["pa", "pb"], "left")
    known = first.where(F.col("parent").isNotNull() | F.col("pa").isNull())
    others = first.where(F.col("parent").isNull() & F.col("pa").isNotNull()).drop("parent").join(parents.where("NOT many").drop("many"), ["pa", "pb"])
    return known.unionByName(others).select(
        F.col("rep").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves",
        (F.col("shared") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
