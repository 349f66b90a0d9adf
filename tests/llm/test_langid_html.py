import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from boundlake.llm import html_main, langid
from boundlake.llm.textnp import utf8

from .common import docs, empty, rows

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy_and_rejection(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    model = langid.train(table, fold != 0)
    found = langid.identify(table, model).where(fold == 0).join(table, "doc_id").select("lang", "lang_pred", "score", "rejected").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert np.mean([r.rejected for r in found]) < 0.02
    assert all(0 <= r.score <= 1 for r in found)
    awkward = {r.doc_id: r for r in langid.identify(docs(spark), model).collect()}
    for i, text, *_ in rows():
        if not any(map(str.isalpha, text or "")):
            assert (awkward[i].lang_pred, awkward[i].score, awkward[i].rejected) == ("und", 0.0, True)
        else:
            assert awkward[i].lang_pred in model.langs
    assert langid.identify(docs(spark), model).count() == len(rows()) + 1
    assert langid.identify(empty(spark), model).count() == 0
    assert langid.keep_identified(docs(spark), model).columns == docs(spark).columns


def test_language_without_labels(spark):
    model = langid.train(docs(spark).withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs(spark), model).collect()} == {"und"}


def test_averages_equal_a_plain_sum():
    raw, offsets = utf8(pa.array(["abc déf", "", "x", None, "漢字 abc"]))
    table = np.random.default_rng(0).normal(size=(langid.BUCKETS * len(langid.GRAMS), 2))
    got = langid.averages(raw, offsets, table)
    for i in range(5):
        part = raw[offsets[i] : offsets[i + 1]]
        at = np.concatenate(langid.gram_buckets(part))
        assert np.allclose(got[i], table[at].mean(axis=0) if len(at) else 0)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body class="no-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<!-- a <p>comment</p> --><div class="ad">Buy &amp; save</div><article><h1>Head &lt;1&gt;</h1><p>First  &eacute;
 line<br>goes on.<p>Short.<p>Third <b>bold</b>er <a href='x>y'>link</a> &copy 2020.<div class="comments"><p>A long reader comment of many words that
 says nothing of use at all.</p></div><ul><li>item one</li><li>item two</li></ul></article><aside>Side</aside><form><p>Mail <input></p></form><footer>&copy; Site</footer></body></html>"""


def test_main_text_of_a_page():
    tree = html_main.default_tree()
    assert html_main.main_blocks(PAGE, tree) == ["Head <1>", "First é line goes on.", "Short.", "Third bolder link © 2020.", "item one", "item two"]


def test_broken_pages_are_taken():
    tree = html_main.default_tree()
    for page in (None, "", "<", "<p", "plain text", "<p>a<p>b", "<!-- open", "<script>x", "<a href=\"x>y<p>z", "</div></p>text<article>b", "<p>" * 3000 + "deep", "a < b > c", "&#x110000; &#0; &bogus;"):
        assert isinstance(html_main.main_blocks(page, tree), list)
    assert html_main.main_blocks("<nav>menu</nav><article><p>A body that is cut", tree) == ["A body that is cut"]
    assert html_main.main_blocks("<p>a &lt; b</p>", tree) == ["a < b"]


def test_self_closed_foreign_elements_are_empty():
    tree = html_main.default_tree()
    article = "<article><h1>Head of it</h1><p>The body of the page with some words.</p></article>"
    want = ["Head of it", "The body of the page with some words."]
    for tag in ('<svg class="icon"/>', "<svg/>", "<SVG class='a' />", "<math display=block />", '<math a="b>c"/>', '<svg class=a b="c"/>'):
        assert html_main.main_blocks(f"<nav>menu {tag}</nav>{article}", tree) == want
        assert html_main.main_blocks(f"<nav>menu {tag}</nav>{article}<svg><text>no</text></svg>", tree) == want
    # A slash in an unquoted value does not close, nor does one on other elements.
    for tag in ("<svg class=a/>", "<svg a= />", '<svg a="/">', "<svg a='/'>", "<object/>", "<canvas />"):
        name = tag[1:].partition(" ")[0].strip("/>")
        assert html_main.main_blocks(f"<nav>menu</nav>{tag}lost</{name}>{article}", tree) == want


def test_elements_close_at_any_depth():
    tree = html_main.default_tree()
    for n in (95, 100, 5000):
        page = "<nav><ul>" + "<li><div>" * n + "menu</nav><article><h1>Head of it</h1><p>The body of the page with some words.</p></article>"
        assert html_main.main_blocks(page, tree) == ["Head of it", "The body of the page with some words."]
    assert [b.boiler for b in html_main.blocks("<nav>" + "<div>" * 300 + "</b></section>x</nav>y</div>z")] == [True, False, False]


def test_table_is_learned():
    rows_, labels = html_main.labelled_table()
    assert (html_main.grow(rows_, labels).keep(rows_) == labels).mean() > 0.97


def test_extraction_query(spark):
    frame = spark.createDataFrame([(1, "u", PAGE, "x", "y"), (2, "v", None, "x", "y"), (2, "v", None, "x", "y"), (3, None, "", "x", "y")], "page_id long, url string, html string, text string, n_chars string")
    found = html_main.extract(frame).orderBy("page_id").collect()
    assert [r.page_id for r in found] == [1, 2, 2, 3] and found[1].text == "" and found[3].n_chars == 0
    assert found[0].n_chars == len(found[0].text)
    assert html_main.extract(frame.limit(0)).count() == 0
