"""Main text of pages with one template and with others."""

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textloom.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T {k}</title><style>p{{x}}</style><script>var a="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="content">{open}<h1>Title {k} &amp; more</h1><p>First&nbsp;part <b>bold</b>ly   {k}.<p>Second<br>line &lt;x&gt; {body}<form><input><p>Mail</p></form>
<div class="comments"><p>Nice!</p></div>{close}</div><aside>Links</aside><footer>&copy; site</footer></body></html>"""


def page(k, marked=True):
    tags = ("<article>", "</article>") if marked else ("", "")
    return PAGE.format(k=k, open=tags[0], close=tags[1], body="word " * (20 + k))


def text(k):
    return f"Title {k} & more First part boldly {k}. Second line <x> " + " ".join(["word"] * (20 + k))


def test_marked_and_unmarked_articles(spark):
    rows = [(k, f"https://a.example/{k}", page(k)) for k in range(6)] + [(10 + k, f"http://B.example/{k}?q", page(k, False)) for k in range(6)] + [(30, "odd", page(3)), (31, None, page(4, False))]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: text(k) for k in range(6)} | {10 + k: text(k) for k in range(6)} | {30: text(3), 31: text(4)}


def test_odd_pages(spark):
    rows = [(1, "http://x/1", None), (2, "http://x/2", ""), (3, "http://x/3", "plain &eacute; text"), (4, None, "<p>open <i>tags"), (5, "http://x/5", "</div></p><p>a < b & c<p>d"), (5, "http://x/5", "</div></p><p>a < b & c<p>d"), (None, "", "<script>never closed <p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS text", "'c' AS host", "'c' AS mains", "'c' AS token")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_text(df).collect()), key=repr)
    assert got == sorted([(1, "", 0), (2, "", 0), (3, "plain é text", 12), (4, "open tags", 9), (5, "a < b & c d", 11), (5, "a < b & c d", 11), (None, "", 0)], key=repr)
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_pages_of_the_tables(spark, small):
    """Every article of these pages is its title and the text of the document that its address names."""
    docs = {r["doc_id"]: " ".join(r["text"].split()) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    raw = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    n = 0
    for r in html_text.op8_html_text(spark, small).collect():
        title = html.unescape(re.search(r"<h1>(.*?)</h1>", raw[r["page_id"]])[1])
        doc = int(re.search(r"/(\d+)", r["url"])[1])
        if doc in docs:
            n += 1
            assert r["text"] == " ".join(f"{title} {docs[doc]}".split())
    assert n


def shown(spark, rows):
    df = spark.createDataFrame([(k, f"http://same.example/{k}", page) for k, page in rows], "page_id long, url string, html string")
    return sorted((r["page_id"], r["text"]) for r in html_text.extract_text(df).collect())


def test_repeated_text_is_the_templates_if_a_tag_has_its_vector(spark):
    """A text in the article that stands on the same pages as a section is boilerplate; on other pages it isn't."""
    make = lambda k, section, line: f"<html><body><article><p>Own {k}</p>{'<p>Support us</p>' if line else ''}</article>{'<section><p>x</p></section>' if section else ''}</body></html>"
    own = lambda k, line=False: (k, f"Own {k}" + " Support us" * line)
    assert shown(spark, [(k, make(k, k % 2, True)) for k in range(6)]) == [own(k) for k in range(6)]
    assert shown(spark, [(k, make(k, k < 4, k < 4)) for k in range(6)]) == [own(k) for k in range(6)]
    assert shown(spark, [(k, make(k, k < 4, k > 1)) for k in range(6)]) == [own(k, k > 1) for k in range(6)]


def test_copies_of_a_page_are_no_template(spark):
    rows = [(k, f"<article><p>Own {k}</p><p>More {k}</p></article>") for k in (0, 0, 0, 0, 1, 2)]
    assert shown(spark, rows) == [(k, f"Own {k} More {k}") for k in (0, 0, 0, 0, 1, 2)]
    assert shown(spark, [(k, f"<article><p>Gone</p></article><p>{k}") for k in range(4)]) == [(k, "Gone") for k in range(4)]


UNNAMED = """<html><body><div class="k1"><div class="k2"><p>Home</p><p>News</p><p>About us</p></div></div>
<div class="k3"><div class="k4"><p>Lead {k} of this page</p></div><div class="k5"><p>Body {k}, and more of it</p>{extra}</div></div>
<div class="k6"><p>All rights reserved</p></div></body></html>"""


def test_unnamed_boilerplate_goes_by_its_vector(spark, monkeypatch):
    """No class name is listed: the repeated texts are the template's, and lead and body are one slot. A name that one
    page has says nothing. With vectors of chance there is no template, and other text comes out."""
    rows = [(k, UNNAMED.format(k=k, extra='<div class="share"><p>Part of the text</p></div>' if k == 5 else "")) for k in range(8)]
    want = [(k, f"Lead {k} of this page Body {k}, and more of it" + " Part of the text" * (k == 5)) for k in range(8)]
    assert shown(spark, rows) == want
    token_table = html_text.token_table
    monkeypatch.setattr(html_text, "token_table", lambda pages: token_table(pages).withColumn("vector", F.xxhash64("token", "vector")))
    assert shown(spark, rows) != want


def test_named_slots_of_a_template(spark):
    """Comments that differ from page to page are told by the name of their slot, inside the article too."""
    make = lambda k: f"<html><body><article><p>Text {k}</p><div class='comments'><p>I say {k}</p></div></article></body></html>"
    assert shown(spark, [(k, make(k)) for k in range(6)]) == [(k, f"Text {k}") for k in range(6)]
    assert shown(spark, [(1, make(1))]) == [(1, "Text 1")]


def brute_template(pages):
    """The texts (with their paths) that share the vector of counts of some tag, comparing all vectors of one host's pages."""
    counts = {}
    for k, page in enumerate(pages):
        tokens, blocks = html_text.parsed(page)
        for t in [*tokens, *((b.path, html_text.text_in(b)) for b in blocks if not b.bad and html_text.text_in(b))]:
            counts.setdefault(t, [0] * len(pages))[k] += 1
    enough = lambda v: sum(x > 0 for x in v) >= max(html_text.MIN_PAGES, html_text.MIN_SHARE * len(pages))
    tags = [v for t, v in counts.items() if isinstance(t, str)]
    return {t for t, v in counts.items() if isinstance(t, tuple) and enough(v) and v in tags}


def test_template_texts_against_all_vectors(spark):
    rng = random.Random(21)
    pages = []
    for k in range(9):
        parts = [f"<p>own {k} {j}</p>" for j in range(rng.randint(1, 3))] + [f"<section><p>{t}</p></section>" for t in "ab" if rng.random() < 0.6] + [f"<p>{t}</p>" for t in "cd" if rng.random() < 0.5]
        pages.append(f"<html><body><article>{''.join(parts)}</article><div><p>same</p></div></body></html>")
    df = spark.createDataFrame([("h", k, p) for k, p in enumerate(pages)], "host string, page long, html string")
    (row,) = html_text.templates(df).collect()
    wanted = {html_text.text_key(path, text) for path, text in brute_template(pages)}
    assert wanted and set(row["same"]) == wanted and row["mains"] == [">html>body>article"]


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'aria-hidden="false"', 'title="a hidden gem"', 'data-role="form"', "data-hidden", 'class="x" data-id=\'role="menu"\'', "title=hidden", 'data-class="comments"', 'alt="a>b" role="article"'])
def test_attributes_count_by_their_whole_names(attributes):
    assert html_text.extracted(f"<article><p>one two</p><div {attributes}><p>Hello text three</p></div></article>", []) == "one two Hello text three"


@pytest.mark.parametrize("attributes", ["hidden", 'HIDDEN=""', "hidden='until-found'", 'aria-hidden="true"', 'role="menu"', "class=comments", 'id="x" class="a comments b"'])
def test_attributes_that_tell_boilerplate(attributes):
    assert html_text.extracted(f"<article><p>one two</p><div {attributes}><p>Hello text three</p></div></article>", []) == "one two"


@pytest.mark.parametrize("page,text", [
    ("<div>" * 20_000 + "in" + "</div>" * 20_000, "in"), ("<div>" * 20_000 + "x", "x"), ("<div>" * 10_000 + "</section>" * 10_000 + "x", "x"), ("<a " * 20_000, " ".join(["<a"] * 20_000)), ("<a " * 20_000 + "<p>x", None), ("<!x " * 20_000, None), ("<div class=\"" * 20_000 + "<p>x", None),
    ("<p>" * 20_000 + "x", "x"), ("".join(f"<div class=k{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}>t{i}</div>" for i in range(5000)), " ".join(f"t{i}" for i in range(5000))), ("".join(f"<div class=k{chr(97 + i % 26)}{chr(97 + i // 26)}>" for i in range(600)) + "deep", "deep"), ("<script>" * 20_000, ""), ("a <!-- b > c", "a"),
])
def test_odd_markup_is_read_in_linear_time(page, text):
    began = time.perf_counter()
    got = html_text.extracted(page, [])
    assert time.perf_counter() - began < 5 and (text is None or got == text)  # a second on an idle machine
