"""Every registered query and the whole pipeline on small tables of awkward rows, and on empty ones."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boundlake.llm import queries

from . import test_hard_negatives, test_prefix_trie
from .common import blank_words, docs, empty, lower, rows, sentence
from .test_tokens_packing import plain

ONE_ROW_EACH = [n for n in queries.QUERIES if n.startswith("op") and n.split("_")[0] not in ("op1", "op2", "op12", "op13")]
PASSAGE = " ".join(sentence(4, 4000).split()[100:130])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders with awkward and with empty tables."""
    full, bare = (str(tmp_path_factory.mktemp(x)) for x in ("full", "bare"))
    pages = "page_id long, url string, html string, text string, n_chars string"
    html = f"<html><body><nav>menu</nav><article><h1>Head of it</h1><p>{sentence(5)}</p></article></body></html>"
    made = {
        "documents": docs(spark),
        "benchmark": spark.createDataFrame([(1, PASSAGE, "x"), (1, "one", "x"), (2, None, "x"), (3, "", "x"), (4, "nothing of the kind here", "x")], "item_id long, text string, id string"),
        "labels": spark.createDataFrame([(i, i % 2, 0, "x") for i in range(0, 27, 2)] + [(0, 0, 0, "x"), (None, 1, 0, "x"), (500, 1, 0, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, f string"),
        "pages": spark.createDataFrame([(1, "u", html, "x", "y"), (1, "u", html, "x", "y"), (None, None, None, "x", "y"), (3, "v", "", "x", "y"), (4, "w", "plain words " * 2000, "x", "y")], pages),
        "embeddings": spark.createDataFrame(test_hard_negatives.table(n=120), test_hard_negatives.SCHEMA),
        "conversations": spark.createDataFrame(test_prefix_trie.table(1, 40), test_prefix_trie.SCHEMA),
    }
    for name, table in made.items():
        table.write.parquet(f"{full}/{name}.parquet")
        (empty(spark) if name == "documents" else table.limit(0)).write.parquet(f"{bare}/{name}.parquet")
    return full, bare


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.startswith("op")])
def test_queries_take_awkward_and_empty_tables(spark, tables, name):
    full, bare = tables
    found, none = queries.QUERIES[name](spark, full), queries.QUERIES[name](spark, bare)
    got = found.collect()
    assert got and found.columns == none.columns and none.count() == 0
    if name in ONE_ROW_EACH:
        assert sorted(r.doc_id for r in got) == sorted([r[0] for r in rows()] + [rows()[3][0]])
    if name == "op2_html_extraction":
        assert sorted((r.page_id or 0, r.n_chars > 0) for r in got) == [(0, False), (1, True), (1, True), (3, False), (4, True)]


def shingles(text):
    words = blank_words(lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_the_whole_pipeline(spark, tables):
    full, bare = tables
    pieces = corpus_pipeline.run(spark, full).collect()
    accepted = {r.doc_id for r in corpus_pipeline.language_id(spark, spark.read.parquet(f"{full}/documents.parquet"), full).select("doc_id").collect()}
    texts = {r[0]: r[1] for r in rows()}
    sets = {i: shingles(texts[i]) for i in accepted}
    group = {i: min(j for j in accepted if j == i or (sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))) for i in accepted}
    kept = {i for i in accepted if group[i] == i}
    assert {0, 3} <= accepted and not {1, 2} & kept and {5, 6, 7} & accepted == set()
    # The passage of the benchmark is in one text, and its one-word item in another.
    clean = {i for i in kept if PASSAGE not in (texts[i] or "") and "one" not in blank_words(lower(texts[i]))}
    lengths = collections.Counter()
    for r in pieces:
        lengths[r.doc_id] += r.length
    assert set(lengths) == clean
    masked = {r.doc_id: r.text for r in corpus_pipeline.secret_scans(spark, spark.read.parquet(f"{full}/documents.parquet"), full).collect()}
    # The repeated row of document 3 is the same document; both rows stay.
    assert dict(lengths) == {i: (len(plain(masked[i])) + 1) * (1 + (i == 3)) for i in clean}
    sequences = collections.defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 1024
    assert corpus_pipeline.run(spark, bare).count() == 0


def test_stages_keep_the_columns_of_documents(spark, tables):
    docs_ = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs_, tables[0]).columns == docs_.columns, name
    assert docs_.where(F.col("doc_id") < 0).count() == 0
