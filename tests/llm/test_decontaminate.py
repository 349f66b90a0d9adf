import re

import pyarrow as pa
from pyspark.sql import functions as F

from boundlake.llm import decontaminate as d

from .common import docs, empty, lower, rows, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def items():
    base = sentence(1, 80).split()
    return [(1, " ".join(base[5:30])), (2, " ".join(base[:9])), (3, "two, WORDS!"), (4, None), (5, "...!"), (6, "漢字"), (7, "not there " * 8), (8, " ".join(base[20:60]) + " unseen tail"), (9, "word " * 12), (2, "one"), (10, "e A B")]


def brute(text, bench, window=10):
    w = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, t in bench:
        b = WORD.findall(lower(t))
        k = min(window, len(b))
        wins = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else set()
        for i in range(len(w) - k + 1 if b else 0):
            if tuple(w[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def check(spark, **limits):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    found = d.find(docs(spark, False), bench, **limits).select("doc_id", "n_words", d.covered(F.col("matches")).alias("hit"), d.items(F.col("matches")).alias("items")).collect()
    got = {r.doc_id: (r.n_words, r.hit, r["items"]) for r in found}
    assert got == {i: brute(t, items()) for i, t, *_ in rows()}


def test_hits_equal_a_plain_search(spark):
    check(spark)


def test_a_benchmark_in_several_blocks_gives_the_same(spark):
    check(spark, block_bytes=120)


def test_word_numbers_of_any_width_give_the_same(spark, monkeypatch):
    for bits in (25, 40):
        monkeypatch.setattr(d, "LEAST_BITS", bits)
        check(spark)


def test_matches_are_longest(spark):
    bench = spark.createDataFrame(items()[:1], "item_id long, text string")
    found = d.find(docs(spark, False), bench).where("doc_id = 0").first().matches
    assert [(m.item_id, m.item_start, m.doc_start, m.n_words) for m in found] == [(1, 0, 5, 25)]


def longest(text, bench, window=10):
    w, out = WORD.findall(lower(text)), []
    for item, t in bench:
        b = WORD.findall(lower(t))
        same = lambda i, j: 0 <= i < len(w) and 0 <= j < len(b) and w[i] == b[j]  # noqa: E731, B023
        for i in range(len(w)):
            for j in range(len(b)):
                if same(i, j) and not same(i - 1, j - 1):
                    n = 1
                    while same(i + n, j + n):
                        n += 1
                    if n >= min(window, len(b)):
                        out.append((item, j, i, n))
    return sorted(out)


def test_matches_are_longest_with_repeated_passages(spark):
    p, q = sentence(11, 12), " ".join(f"q{i}" for i in range(14))
    bench = [(1, f"{p} {p}"), (2, f"{p} x {p} y {q}"), (3, "word " * 25), (4, "a b " * 9), (5, "one two"), (6, f"{q} {q} {q}")]
    texts = [f"start {p} {p} end", f"{p} {p}", f"{p} {p} {p}", f"x {p} x {p} y {q} {q}", "word " * 60, "c " + "a b " * 30 + "a", "b " + "a b " * 5, f"{q} one two {q} {q} one", f"{p}", "nothing"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.matches for r in d.find(frame, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    for i, text in enumerate(texts):
        assert sorted(tuple(m) for m in found[i]) == longest(text, bench)
    assert (1, 0, 1, 24) in [tuple(m) for m in found[0]]


def test_much_repeated_windows_list_only_longest_matches():
    block = d.Block(pa.array(["word " * 20_000]), 10)
    counts, (row, item, item_at, start, words) = d.search(block, pa.array(["word " * 30_000, "word"]))
    assert counts.tolist() == [30_000, 1] and len(row) == 20_000 + 30_000 - 2 * 10 + 1 and words.max() == 20_000 and words.min() == 10


def test_removal_keeps_clean_rows_and_all_columns(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    kept = d.remove(docs(spark, False), bench)
    assert kept.columns == docs(spark).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t, *_ in rows() if not brute(t, items())[1]}


def test_empty_sides(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.matches for r in d.find(docs(spark), none).collect())
    assert d.remove(docs(spark), none).count() == len(rows()) + 1
    assert d.find(empty(spark), spark.createDataFrame(items(), "item_id long, text string")).count() == 0
