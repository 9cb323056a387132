"""Language identification and main-text extraction: held-out accuracy, rules and edges."""

import time

import numpy as np
import pytest

from stackscan.llm import html_extract, language_id, queries
from stackscan.llm.html_blocks import blocks_of
from stackscan.llm.labelled_pages import labelled_pages
from tests.llm.tables import documents, edge_docs, edge_rows, empty_docs

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def network(spark):
    docs = documents(spark, SF01)
    return language_id.fit(docs.where(~language_id.held_out()), documents=60)


@pytest.fixture(scope="module")
def field():
    return html_extract.fit()


def test_held_out_accuracy(spark, network):
    docs = documents(spark, SF01)
    found = language_id.identify(docs.where(language_id.held_out()), network).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_every_window_counts(network):
    """A prediction is that of all windows, whatever their number and grouping."""
    text = "".join(chr(97 + i % 26) if i % 7 else " " for i in range(50_000))
    logs = network.log_probabilities(language_id.windows_of(text)).mean(axis=0)
    (lang, score), = network.predict([text], rows=16)
    assert lang == network.languages[int(logs.argmax())] and score == pytest.approx(float(np.exp(logs.max()) / np.exp(logs).sum()), abs=1e-5)
    assert b"".join(w.tobytes() for w in language_id.windows_of("ÄB" * 300)).rstrip(b"\0") == ("Äb" * 300).encode()


def test_language_edges(spark, network):
    found = language_id.identify(edge_docs(spark), network).collect()
    assert len(found) == len(edge_rows())
    unknown = {i for i, t, *_ in edge_rows() if not t or not any(c.isalpha() for c in t)}
    for r in found:
        assert r["doc_id"] is None or (r["lang_pred"] == "und") == (r["doc_id"] in unknown)
    assert language_id.identify(empty_docs(spark), network).count() == 0
    nothing = language_id.fit(empty_docs(spark))
    assert {r["lang_pred"] for r in language_id.identify(edge_docs(spark), nothing).collect()} == {"und"}


def test_language_of_predictions_ignores_labels(spark, network):
    docs = documents(spark, SF01).limit(50)
    blind = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'y' AS source")
    assert language_id.identify(docs, network).collect() == language_id.identify(blind, network).collect()


def test_held_out_rule(spark):
    import zlib
    for r in documents(spark).select("doc_id", language_id.held_out().alias("h")).collect():
        assert r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_training_pages_held_out(field):
    right = total = 0
    for html, labels in labelled_pages(200, seed=99):
        found = field.decode(html_extract.features(blocks_of(html)))
        right, total = right + sum(a == b for a, b in zip(found, labels)), total + len(labels)
    assert right / total > 0.98


def test_viterbi_is_the_best_labelling(field):
    import itertools
    for html, _ in labelled_pages(6, seed=3):
        names = html_extract.features(blocks_of(html)[:9])
        scores = field._scores(names)
        value = lambda y: sum(scores[i, k] for i, k in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=len(names)), key=value)
        assert value(field.decode(names)) == pytest.approx(value(best))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no";</script></head><body>
<header><a href="/">Site name</a></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to improve this site.</p></div>
<article><h1>Fish &amp; chips</h1><p>First   paragraph with <b>bold</b>&nbsp;text &#233;.<br>Same block here.<p>Second paragraph, unclosed.
<div class="ad">Buy now! Only today.</div><p>Third one ends the story.</p></article>
<section class="comments"><h3>2 comments</h3><div class="comment"><p>I liked this a lot, thank you for it.</p></div></section>
<aside><p>Related: something else to read.</p></aside><form><p>Your e-mail</p><button>Send</button></form>
<footer>&copy; 2024 Somebody</footer></body></html>"""


def test_main_text(field):
    assert html_extract.main_text(PAGE, field) == (
        "Fish & chips\nFirst paragraph with bold text é. Same block here.\nSecond paragraph, unclosed.\nThird one ends the story.")


@pytest.mark.parametrize("html,texts", [
    (None, []), ("", []), ("just text", ["just text"]), ("<p>a<p>b", ["a", "b"]), ("<div>x<p>y</p>z</div>", ["x", "y", "z"]),
    ("<p title='a > b'>q</p>", ["q"]), ("<!-- <p>no</p> --><p>yes", ["yes"]), ("<p>cut <b", ["cut"]), ("</div></p>a", ["a"]),
    ("<script>if (a<b) '</p>'</script><p>1 &lt; 2 &amp &#x41;</p>", ["1 < 2 & A"]), ("<P>Up</P><BR/>x", ["Up", "x"]),
    ("<table><tr><td>1<td>2</table>", ["1", "2"]), ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]), ("a<style>p{}", ["a"]), ("<title>t</title>b", ["b"]),
])
def test_blocks(html, texts):
    assert [b.text for b in blocks_of(html)] == texts


def test_extract_query(spark):
    rows = {r["page_id"]: r for r in queries.op4_html_crf(spark, "/root/testdata/sf0.001").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        want = [b.text for b in blocks_of(p["html"]) if any(e.tag == "article" for e in b.path) and b.text]
        assert rows[p["page_id"]]["text"].split("\n") == want and rows[p["page_id"]]["n_chars"] == len("\n".join(want))


def test_extract_edges(spark, field):
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "u", PAGE, 3), (3, "u", PAGE, 4), (3, "u", PAGE, 4), (4, "u", "<p>" + "word " * 100_000, 5)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = html_extract.extract(frame, field).collect()
    assert len(found) == len(rows) and [r["row"]["text"] for r in found] == [1, 2, 3, 4, 4, 5]
    assert [r["text"] for r in found][:2] == ["", ""] and len({r["text"] for r in found[2:5]}) == 1
    assert html_extract.extract(frame.limit(0), field).count() == 0


@pytest.mark.parametrize("html,texts", [
    ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p>", ["a x=2 b"]), ("<p>a<svg><title>t</title><text>b</text></svg></p>", ["a b"]),
    ("<div><button>Send<p>one</p></div><p>two", ["Send", "one", "two"]), ("<article><select><option>a<option>b<p>c</article>d", ["a b", "c", "d"]),
    ("<object><object>x</object> y</object> z", ["x y z"]), ("<noscript><p>a</noscript>b", ["a", "b"]), ("<head><title>t</title></head>b", ["b"]),
    ("<video><p>No video.</p></video><textarea>v</textarea>w", ["No video.", "w"]), ("<iframe>a<p>b", ["a", "b"]), ("<p>a<svg/>b<math/>c", ["abc"]),
    ("<button>A</button><button>B</button>c", ["A B c"]),
])
def test_only_raw_text_is_left_out(html, texts):
    assert [b.text for b in blocks_of(html)] == texts


def test_embedded_elements_of_an_article_stay(field):
    first, formula, last = ("One sentence of some length stands here, and ends.", "Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> in this short paragraph of it.",
                            "Another one of about the same length ends the story.")
    page = f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{first}</p><p>{formula}</p><object><p>{last}</p></article><footer>&copy; 2024 Us</footer>"
    assert html_extract.main_text(page, field) == f"Title\n{first}\nEnergy is E=m in this short paragraph of it.\n{last}"


def test_quotes_hold_values_only_behind_an_equals_sign():
    from stackscan.llm.html_blocks import blocks_of

    texts = lambda html: [b.text for b in blocks_of(html)]
    assert texts("<p data-x=it's>Hello, <b>world</b> is here.</p><p>We don't know.</p><p>Last</p>") == ["Hello, world is here.", "We don't know.", "Last"]
    assert texts('<p title="5" wide">Hello world.</p><p a="x>y" b=\'>\'>t</p><p c=>u</p>') == ["Hello world.", "t", "u"]


def test_paths_cost_what_the_page_holds():
    for html, count in (("<div class=nav>a" * 50_000, 50_000), ("<div><object>a" * 20_000, 20_000), ("<b>a" * 50_000, 1), ("<div>a</span></p>" * 20_000, 20_000)):
        start = time.perf_counter()
        found = blocks_of(html)
        html_extract.features(found)
        assert len(found) == count and time.perf_counter() - start < 10


def test_a_block_lies_in_the_embedded_elements_that_hold_all_of_it():
    tags = lambda html: [[e.tag for e in b.path] for b in blocks_of(html)]
    assert tags("<p><object>a<svg>b</svg></object></p>") == [["p", "object"]]
    assert tags("<div><object><div>a</div>b</object>c</div>") == [["div", "object", "div"], ["div"]]
    assert tags("x<object>y<div>z") == [[], ["object", "div"]]


def test_the_sample_is_the_smallest_hashes_of_each_language(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "concat('word number ', id) AS text", "IF(id % 3 = 0, 'a', 'b') AS lang")
    ranked = docs.selectExpr("lang", "text", "row_number() OVER (PARTITION BY lang ORDER BY xxhash64(doc_id, lang), doc_id) AS r").where("r <= 20")
    want = sorted((r.lang, language_id.windows_of(r.text)[0].tobytes()) for r in ranked.collect())
    assert language_id.training_windows(docs, 20, 1) == want
