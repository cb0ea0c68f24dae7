from __future__ import annotations

import html as markup
import random
import re

import duckdb
import pytest

from runhealth.llm import extract

PAGES = "page_id long, url string, html string, host string, main string, text string, place int"


def page(i, rng, blocks, layout):
    noise = f"noise{i} " + " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 60)))
    body = "".join(f"<p>{markup.escape(b)}</p>" for b in blocks)
    if layout == "article":
        return (f"<!DOCTYPE html><html><head><title>{noise}</title><script>var a='</p><article>';</script></head><body><nav><ul>"
                f"{'<li><a href=x>menu</a></li>' * rng.randint(1, 5)}</ul></nav><header>{noise}</header><article>{body}"
                f"<aside>{noise}</aside><div class='advert big'>{noise}</div><form><p>{noise}</p></form></article>"
                f"<section id=comments><p>{noise}</p></section><footer>&copy; {noise}</footer></body></html>")
    if layout == "divs":
        return (f"<body><div class='top'><div class=menu>{noise}</div></div><div class='wrap'><div class='col'>{body}</div>"
                f"<div class='sidebar'>{noise}</div></div><div id=\"cookie-notice\">{noise}</div><!-- {noise} --></body>")
    return f"<table><tr><td><div class='text'>{body.replace('</p>', '')}</div></table><style>p{{}}</style>"


@pytest.fixture(scope="module")
def made():
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(90):
        layout = ("article", "divs", "bare")[i % 3]
        blocks = [" ".join(rng.choice(["x<y", "a & b", "é", "word", " ", "1 > 0"]) for _ in range(rng.randint(8, 60))) for _ in range(rng.randint(1, 6))]
        rows.append((i, f"http://{layout}.example/p{i}", page(i, rng, blocks, layout), "h", "m", "t", 1))
        want[i] = "\n".join(filter(None, (re.sub(r"\s+", " ", b).strip() for b in blocks)))
    return rows, want


def test_made_templates(spark, made):
    rows, want = made
    got = {r["page_id"]: r for r in extract.extract_articles(spark.createDataFrame(rows, PAGES)).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_test_pages(spark, small):
    """The generator's pages: the article's own text, read with plain patterns."""
    path = f"{small.replace('0.001', '0.01')}/pages.parquet"
    got = {r["page_id"]: r["text"] for r in extract.extract_articles(spark.read.parquet(path)).collect()}
    for page_id, source in duckdb.sql(f"select page_id, html from '{path}'").fetchall():
        body = re.search(r"<article>(.*?)(</article>|$)", source, re.S)[1]
        blocks = re.split(r"</?(?:h1|p|br|article)\b[^>]*>", body)
        want = (re.sub(r"\s+", " ", markup.unescape(re.sub(r"</?b>", "", b))).strip() for b in blocks)
        assert got[page_id] == "\n".join(w for w in want if w)


WRAPPERS = ["<div class='page has-sidebar'>%s</div>", "<div id='content-with-comments'>%s</div>", "<main class='layout no-sidebar'>%s</main>",
            "<div class='sidebar-page'>%s</div>", "<div class='search'><div id=nav-wrap>%s</div></div>", "<section class='pageWithMenu'>%s</section>"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_names_of_wrappers_drop_no_article(spark, wrapper):
    """With a template of many pages, and on a page alone."""
    page_of = lambda i: wrapper % (
        f"<nav>menu {i}</nav><article><h1>Title {i}</h1><p>Body of {i}.</p><div class='comments'>said {i}</div></article><footer>foot {i}</footer>")
    rows = [(i, f"http://many/{i}", page_of(i), "h", "m", "t", 1) for i in range(6)] + [(9, "http://one/9", page_of(9), "h", "m", "t", 1)]
    got = {r["page_id"]: r["text"] for r in extract.extract_articles(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"Title {i}\nBody of {i}." for i in [*range(6), 9]}


def test_a_page_of_asides_alone_keeps_its_text():
    assert extract.article(extract.Page("<div class='sidebar'><p>all there is</p><nav>menu</nav></div>"), None) == "all there is"
    assert extract.article(extract.Page("<nav>menu</nav>"), None) == ""
    assert extract.marks("class='has-sidebar mainContent no-js' id=page-with-nav role=main") == ["main", "content", "page", "main"]


def test_edges(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None, "h", "m", "t", 1), (2, "x", "", "h", "m", "t", 1), (3, "http://a/1", "plain text &amp; more", "h", "m", "t", 1),
            (4, "http://b/1", "<p title='a>b'>one<br>two<p>three <i>and</i> four</p>tail", "h", "m", "t", 1), (4, "http://b/1", "<p>same", "h", "m", "t", 1),
            (5, "http://c/1", deep, "h", "m", "t", 1), (6, "http://d/1", "<p a=\"x>broken</p><p>fine", "h", "m", "t", 1), (None, "http://e/1", "<article>e</article>", "h", "m", "t", 1),
            (7, "http://f/1", "<article><p>" + "long " * 100_000 + "</article>", "h", "m", "t", 1)]
    got = [(r["page_id"], r["text"]) for r in extract.extract_articles(spark.createDataFrame(rows, PAGES)).collect()]
    found = dict(got)
    assert found[1] == found[2] == "" and found[3] == "plain text & more" and found[5] == "deep" and found[None] == "e"
    assert ("one\ntwo\nthree and four\ntail" in [t for i, t in got if i == 4]) and len(got) == 9
    assert len(found[7]) == 499_999
    assert extract.extract_articles(spark.createDataFrame([], PAGES)).count() == 0
