import html as entities
import re

import pytest

from tickloom.llm import html
from tickloom.llm.queries import op3_html_extraction

SCHEMA = "page_id bigint, url string, html string, text string"


def test_query(spark, sf):
    pages = {r["page_id"]: (r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op3_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        url, page = pages[r["page_id"]]
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("<h1>|</h1>|<p>|</p>", article))
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert (r["n_chars"], r["url"]) == (len(r["text"]), url)


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain  words &amp; &lt;more", "plain words & <more"),
    ("<article><p>a<p>b<ul><li>c<li>d</ul></article>", "a\nb\nc\nd"),
    ("<nav>n</nav><main><h1>T</h1><p>x <b>y</b>z<br>w</p></main><footer>f</footer>", "T\nx yz w"),
    ("<article><p>keep</p><aside>no</aside><div class='comments'><p>no</p></div><form>no<input value='>'></form><div class=share>no</div><p>keep&nbsp;2</p></article>", "keep\nkeep 2"),
    ("<p title='a > b'>x</p><script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>no</p> --><p>y", "x\ny"),
    ("<article><p>cut off <a href='x", "cut off"), ("<article>&#x41;&#66;&eacute;&unknown;</article>", "ABé&unknown;"),
    ("<div role=navigation>no</div><div>yes<table><tr><td>1<td>2</table>z</div>", "yes\n1\n2\nz"), ("<article><script>never closed", ""),
    ("<article><p>x</p></article><p>outside</p>", "x"), ("</p></div><p>x</b></i></p>", "x"), ("<!DOCTYPE html><p>x<!-- open", "x"),
])
def test_main_text(page, text):
    assert html.main_text(page, set()) == text


def test_style_tree_finds_what_repeats(spark):
    """Pages without an article: what reads alike on every page of a host goes, what differs stays."""
    page = "<body><div class='top'><p>Welcome to the site</p><p>All rights</p></div><div class='story'><p>Story {0} of {0}</p><p>More of {0}</p></div><div class='box'>Read on</div></body>"
    rows = [(i, f"https://A.example.com:80/{i}", page.format(i), "c") for i in range(20)] + [(100 + i, f"http://b.example.com/{i}", page.format(i), "c") for i in range(3)]
    pages = spark.createDataFrame(rows, SCHEMA)
    tree = {(r["host"], r["path"]): r for r in html.style_tree(pages).collect()}
    assert tree["a.example.com", ">body>div.top>p"]["importance"] == 0 and tree["a.example.com", ">body>div.top>p"]["n_pages"] == 20
    assert tree["a.example.com", ">body>div.story>p"]["importance"] > 0.5
    got = {r["page_id"]: r["text"] for r in html.extract_text(pages).collect()}
    assert got[3] == "Story 3 of 3\nMore of 3"
    assert got[102].split("\n")[0] == "Welcome to the site"  # too few pages to tell


def test_copies_of_an_article_stay(spark):
    rows = [(i, "https://c.example.com/", "<nav>menu</nav><article><p>same</p></article>", "c") for i in range(30)]
    assert {r["text"] for r in html.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()} == {"same"}


def test_defined_cases(spark):
    long = "<article>" + "<p>word</p>" * 60_000 + "<b>" * 2000 + "x" * 500_000
    rows = [(1, None, None, "t"), (2, "no host", "", "t"), (None, None, "<p>x", None), (None, None, "<p>x", None), (5, "u", long, ""), (6, "u", '<a "' * 3000, "")]
    got = sorted(((str(r["page_id"]), r["url"], r["n_chars"]) for r in html.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got[:2] == [("1", None, 0), ("2", "no host", 0)] and got[-2:] == [("None", None, 1)] * 2
    assert ("5", "u", 5 * 60_000 + 500_000) in got
    assert html.extract_text(spark.createDataFrame(rows, SCHEMA).where("false")).count() == 0
