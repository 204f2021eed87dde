"""Main text of pages: literal pages, made-up layouts, and the neighbour rule against plain loops."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

from opsloom.llm import catalog, extraction, sql

LONG = "The house stood at the end of the road and it was as old as the trees that were all around it. " * 3
MORE = "In the morning they went to the river with the boat, and he was on it for the first time in a year. " * 3
GERMAN = "Das Haus stand am Ende der Straße und war so alt wie die Bäume, die es von allen Seiten umgaben, als sie es sah. " * 3


def text(page: str) -> str:
    blocks = extraction.Blocks()
    blocks.cut(0, page)
    return "\n".join(t for t, k in zip(blocks.text, blocks.kept(), strict=True) if k)


def clean(s: str) -> str:
    return " ".join(s.split())


def test_article_page():
    page = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1><nav><a href="/">Home</a></nav></header><div id="cookie-notice">We use the cookies of the site and you can accept them all.</div>
<main><div class="toolbar">Print</div><article><header><h1>A &amp; B&nbsp;&#8211; <i>C</i></h1><p>By someone</p></header><p>{LONG}<p>Short.</p><p>x&lt;y<br>z</p>
<blockquote>He said so.</blockquote><ul><li>one<li>t<b>w</b>o</ul><pre> a
   b</pre><aside>{MORE}</aside><form>Name <input></form><p><a href="x">Only a link to another story</a></p><div class="ad">Buy</div><footer>Tags</footer></article>
<section id="comments"><article class="comment"><p>{MORE}</p></article></section></main><aside>{MORE}</aside><footer>&copy; Site</footer></body></html>"""
    assert text(page).split("\n") == ["A & B – C", clean(LONG), "Short.", "x<y z", "He said so.", "one", "two", "a b"]


def test_rules_alone():
    """No element or class says what is what."""
    menu = "<ul>" + "".join(f'<li><a href="/{k}">Section number {k}</a></li>' for k in range(6)) + "</ul>"
    page = f"<body>{menu}<div>Welcome</div><div><h2>Of houses</h2><p>{LONG}</p><p>Yes.</p><p>{MORE}</p><p>{GERMAN}</p></div><div>© 2020 Site, all rights reserved</div>{menu}<p>Contact us</p></body>"
    assert text(page).split("\n")[-4:] == [clean(LONG), "Yes.", clean(MORE), clean(GERMAN)]
    assert "Section" not in text(page) and "©" not in text(page) and "Contact" not in text(page)


def test_unknown_language_goes_by_length_and_links():
    page = f"<div><a href='/'>{'ljk ' * 20}</a></div><p>{'mnogo beseda tukaj ' * 20}</p>"
    assert text(page) == clean("mnogo beseda tukaj " * 20)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("just words", "just words"),
        ("<article>a <b>b <!-- <p>no</p> --> c", "a b c"),
        ("<article>a<!-- open <p>b</p>", "a"),
        ("<article>a<script>b<p>c", "a"),
        ("<article><p title='x > y' data-a=it's>a</p><p>don't</p>", "a\ndon't"),
        ("<article>1 < 2 & 3 &notaref; &#x41;&#66;</article><p>out</p", "1 < 2 & 3 ¬aref; AB"),
        ("<head><meta charset=x><article>in</article>", "in"),
        ("<article><p hidden>a</p><p style='display: none'>b</p><p aria-hidden=true>c</p><p>d</p></article>", "d"),
        ("<article><div class='elementor-widget theme-post-content'>a</div><div class='social-share'>b</div></article>", "a"),
        ("<article><a href=x>a<p>b</p><table><tr><td>c<td>d<tr><td>e</table></article>", "a\nb\nc\nd\ne"),
        ("<ARTICLE><P>a</P></ARTICLE><div>b</div>", "a"),
        ("<article>a\x00\xa0  b</article>", "a\x00 b"),
    ],
)
def test_odd_markup(page, want):
    assert text(page) == want


def test_neighbours_against_loops():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 12)
        page = np.array(sorted(rng.randint(0, 2) for _ in range(n)))
        label = np.array([rng.choice("gb??") for _ in range(n)])
        strict = np.array([rng.random() < 0.5 for _ in range(n)])
        got = extraction._inherits(page, label == "g", label == "b", strict)
        for k in range(n):
            if label[k] == "?":
                sides = [[label[j] for j in order if page[j] == page[k] and label[j] != "?"][:1] for order in (range(k - 1, -1, -1), range(k + 1, n))]
                near = [x for s in sides for x in s]
                want = all(x == "g" for x in near) if strict[k] else ("g" in near or not near)
                assert got[k] == want, (page, label, strict, k)


def test_long_pages_are_linear():
    deep = "<div><b>" * 50_000 + "word " + "</i>" * 50_000
    assert text(deep) == "word"
    assert text("<article>" + "<p>a <b>b" * 50_000 + "<a " * 100_000).count("\n") == 49_999


def test_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", "<article>a</article>", "x", 9), (1, None, None, None, None), (None, "v", "", "", 0), (1, "u", "<article>a</article>", "x", 9), (2, "w", "<article>" + f"<p>{MORE}</p>" * 20_000, "", 0)]
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extraction.main_text(spark.createDataFrame(rows, schema)).collect()), key=repr)
    long = "\n".join([clean(MORE)] * 20_000)
    assert got == sorted([(1, "u", "a", 1), (1, None, "", 0), (None, "v", "", 0), (1, "u", "a", 1), (2, "w", long, len(long))], key=repr)
    assert extraction.main_text(spark.createDataFrame([], schema)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    rel = con.sql(sql.EXTRACTION)
    got = catalog.op13_extraction(spark, sf)
    assert sorted(tuple(r[c] for c in rel.columns) for r in got.collect()) == sorted(rel.fetchall())
