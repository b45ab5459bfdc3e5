"""The site style tree: its entropies against brute force, and that it decides about what pages keep."""

import html as entities
import math
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from tickloom.llm import html
from tickloom.llm.queries import op3_html_extraction

SCHEMA = "page_id bigint, url string, html string, text string"


class Dom(HTMLParser):
    """Texts and children by path, of pages whose block elements nest as they are written but for paragraphs."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.path, self.texts, self.children, self.raw = [""], defaultdict(list), defaultdict(list), 0
        self.feed(page)
        self.close()

    def leave(self, tag):
        at = len(self.path) - 1 - [re.match("[a-z0-9]*", x)[0] for x in self.path[::-1]].index(tag)
        del self.path[at:]

    def open_paragraph(self):
        return "p" in self.path

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "title", "script", "style"):
            self.raw += tag != "head"
            if tag == "head":
                self.children[">".join(self.path)].append(tag)
            return
        if tag in ("b", "br", "a", "meta"):
            return
        if self.open_paragraph():
            self.leave("p")
        name = tag + "".join(f".{v}" for k, v in attrs if k == "class") + "!" * (tag in ("nav", "footer") or ("class", "ad") in attrs)
        self.children[">".join(self.path)].append(name)
        self.path.append(name)

    def handle_endtag(self, tag):
        if tag in ("title", "script", "style"):
            self.raw -= 1
        elif tag not in ("b", "a", "head") and any(re.match("[a-z0-9]*", x)[0] == tag for x in self.path):
            self.leave(tag)

    def add(self, data):
        if not self.raw:
            self.texts[">".join(self.path)].append(data)

    handle_data = add

    def handle_entityref(self, name):
        self.add(f"&{name};")

    def handle_charref(self, name):
        self.add(f"&#{name};")


def entropy(values):
    n = Counter(values)
    if len(values) == 1:
        return 1.0
    return sum(-k / len(values) * math.log(k / len(values), len(values)) for k in n.values())


def test_entropies(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("url", "html").distinct().collect()
    texts, children = defaultdict(list), defaultdict(list)
    for r in rows:
        host, dom = re.match("https?://([^/]+)", r["url"])[1], Dom(r["html"])
        for path, parts in dom.texts.items():
            if text := " ".join(entities.unescape("".join(parts)).split()):
                texts[host, path].append(text)
        for path, below in dom.children.items():
            children[host, path].append(" ".join(x for x in below if x != "head"))
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {(r["host"], r["path"], r["kind"]): r for r in html.style_nodes(pages.unionByName(pages)).collect()}  # copies count once
    for (host, path), found in texts.items():
        node = got[host, path, "content"]
        assert node["n_pages"] == len(found) and node["importance"] == pytest.approx(entropy(found), abs=1e-9)
    assert len(texts) > 100 and {k[:2] for k in got if k[2] == "content"} == set(texts)
    for (host, path), found in children.items():
        if path.endswith("article") or path.endswith("ul"):
            node = got[host, path, "children"]
            runs = [re.sub(r"\b(\w+)( \1\b)+", r"\1", x) for x in found]
            assert node["n_pages"] == len(found) and node["importance"] == pytest.approx(entropy(runs), abs=1e-9)


def test_the_tree_decides(spark, sf):
    """On hosts of several pages menus, adverts and footers go because the tree rates them low."""
    pages = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/pages.parquet")
    low = {r["host"]: set(r["paths"]) for r in html.low_branches(pages).collect()}
    assert len(low) >= 3
    noise = {">html>body>nav!", ">html>body>div.ad!", ">html>body>footer!"}
    assert all(x == noise for x in low.values())
    seen = 0
    for r in pages.collect():
        host = html.host_of(r["url"])
        if host in low:
            whole, kept = (html.main_text(r["html"], x) for x in ({"no such branch"}, low[host]))
            assert len(whole) > len(kept) and kept in whole
            seen += 1
    assert seen >= 100


def test_without_the_tree_what_repeats_stays(spark):
    page = "<body><div class=top>Welcome</div><div class=story><p>Story {0}</p><p>More of {0}</p></div><div class=x><a href=/{0}>To {0}</a> <a href=/b>on</a></div></body>"
    rows = [(i, "http://a.example.com/", page.format(i * 7), "") for i in range(12)]
    pages = spark.createDataFrame(rows, SCHEMA)
    with_tree = {r["page_id"]: r["text"] for r in html.extract_text(pages).collect()}
    without = {r["page_id"]: r["text"] for r in html.extract_text(pages, least_pages=13).collect()}
    assert with_tree[3] == "Story 21\nMore of 21"
    assert without[3] == "Welcome\nStory 21\nMore of 21\nTo 21 on"


@pytest.mark.parametrize("copies", [1, 9])
@pytest.mark.parametrize("page, text", [
    ('<html><body class="has-sidebar"><nav>{0}</nav><article><p>a {0}</p></article></body></html>', "a {0}"),
    ('<body class="page comments-open"><main><p>b {0}</p></main><div class="site-footer">f</div></body>', "b {0}"),
    ('<main class="search-enabled"><p>c {0}</p></main>', "c {0}"),
    ('<main class="widget"><p>c {0}</p></main>', "c {0}"),
    ('<article><p>x <span class="widget">y {0}</span> z</p></article>', "x y {0} z"),
    ('<article><p>long text {0}</p><section class="related-work"><p>r {0}</p></section><div class="related-posts">no {0}</div></article>', "long text {0}\nr {0}"),
    ('<article><header><h1>Title {0}</h1></header><p>t {0}</p><footer>no</footer></article>', "Title {0}\nt {0}"),
    ('<div class="widget"><article>in {0}</article></div><div class="cookie-notice">no {0}</div>', "in {0}"),
    ("<form><div><p>All of the page {0} is in a form</p></div></form>", "All of the page {0} is in a form"),
    ('<article><p>short {0}</p><section class="comments"><article class="comment"><p>far longer than the article {0}, by much</p></article></section></article>', "short {0}"),
    ("<article><p>x {0}</p></article><aside><article>teaser {0} and more of it, long</article></aside>", "x {0}"),
])
def test_names_alone_do_not_decide(spark, copies, page, text):
    rows = [(i, "http://h.example.com/", page.format(i), "") for i in range(copies)]
    got = {r["page_id"]: r["text"] for r in html.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: text.format(i) for i in range(copies)}


def test_copies_of_an_article_among_other_parts(spark):
    """The article is the same on all of a host's pages, which differ elsewhere; one page has no article."""
    rows = [(i, "http://c.example.com/", f"<nav>m {i}</nav><article><h1>Same</h1><p>same text</p></article><footer>f {i}</footer>", "") for i in range(8)]
    rows.append((8, "http://c.example.com/", "<nav>m</nav><p>text of its own</p>", ""))
    got = {r["page_id"]: r["text"] for r in html.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: "Same\nsame text" for i in range(8)} | {8: "text of its own"}


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x", "t", "h", "l", 3)], "page_id bigint, url string, html string, text string, _host string, _low string, path int")
    assert [tuple(r) for r in html.extract_text(pages).collect()] == [(1, "http://a/", "x", 1)]


def test_query_is_exact_at_a_larger_scale(spark, sf):
    at = sf.replace("sf0.001", "sf0.01")
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{at}/pages.parquet").collect()}
    for r in op3_html_extraction(spark, at).collect():
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("<h1>|</h1>|<p>|</p>", article))
        assert r["text"] == "\n".join(b for b in blocks if b)
