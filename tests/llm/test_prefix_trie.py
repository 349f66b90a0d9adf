"""Trie of rebuilt conversations against a plain tree of tuples."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from boundlake.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, rep string, fa string, base string, words string"


def plain(rows, group=20, heads=4):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            r, t = role or "", text or ""
            address = hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[:16]
            own[c].append((turn is not None, turn or 0, r, address, t))
    own = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % heads, c - (abs(c) % group) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
        ends[tuple(rebuilt[c])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(who) - 1) * words
    digest = lambda k: hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()
    return sorted(
        ((who[0], len(k), members[k[:-1]][0] if k else None, len(who), children[k], leaves[k], saved[k], digest(k)) for k, who in members.items()), key=lambda r: r[:2],
    )


def table(seed, convs=90, texts=4):
    rng = random.Random(seed)
    rows = []
    for c in [*range(convs), *range(-25, 0, 3), 1000, 1001, 5_000_000_000, 10**18 + 7]:
        if c % 20 == 0 and rng.random() < 0.3:
            continue
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None, ""]), rng.choice([f"hello {rng.randrange(texts)} you", f"a b\tc {rng.randrange(texts)}", "", None])))
    rows += [(None, 1, "user", "x"), (40, 0, "user", "x"), (40, 0, "user", "x"), (41, 0, "user", "ab"), (41, 1, "use", "rab")]
    return [(*r, *"xxxxx") for r in rows]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_a_plain_tree(spark, tmp_path, seed):
    rows = table(seed)
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(queries.QUERIES["op12_prefix_trie"](spark, str(tmp_path))) == plain(rows)


def test_small_bounds_change_nothing(spark, monkeypatch):
    for name, value in (("DEPTHS", 2), ("IDS", 3), ("MANY", 2), ("ROWS", 3)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = table(3, 70)
    assert got(prefix_trie.build(spark.createDataFrame(rows, SCHEMA).repartition(6))) == plain(rows)


def test_one_huge_conversation_over_many_tasks(spark):
    rng = random.Random(5)
    said = [("user", f"turn {rng.randrange(50)}") for _ in range(700)]
    rows = [(c, i, r, t) for c in (20, 21, 35) for i, (r, t) in enumerate(said)] + [(22, 0, "user", "a"), (39, 0, "user", "b"), (40, 3, "user", "c")]
    rows = [(*r, *"xxxxx") for r in rows]
    assert got(prefix_trie.build(spark.createDataFrame(rows, SCHEMA).repartition(9))) == plain(rows)


def test_colliding_fingerprints_are_noticed_and_another_base_is_taken(spark, monkeypatch):
    rows, tried = table(4, 30), []

    class Weak(prefix_trie.Monoid):
        def __init__(self, seed):
            super().__init__(seed)
            tried.append(seed)
            if seed == 0:
                self.base = 0

    monkeypatch.setattr(prefix_trie, "Monoid", Weak)
    assert got(prefix_trie.build(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert tried == [0, 1]


def test_products_are_associative_and_cancel():
    m, x = prefix_trie.Monoid(0), [bytes([i] * 16) for i in range(9)]
    for i in range(9):
        for j in range(i, 9):
            assert m.join(m.of(x[:i]), m.of(x[i:j]), j - i) == m.of(x[:j])
            assert m.cut(m.of(x[:i]), m.of(x[:j]), j - i) == m.of(x[i:j])


def test_empty_table_and_turnless_conversations(spark):
    assert prefix_trie.build(spark.createDataFrame([], SCHEMA)).collect() == []
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lone, 0, "user", "x", *"xxxxx")]
    assert got(prefix_trie.build(spark.createDataFrame(rows, SCHEMA))) == plain(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
