"""Main text of web pages by site style trees.

The DOMs of a host's distinct pages are merged: pages share a style node if the tags and classes from the body down to it
are the same. A node that holds text has a content importance, the entropy of the texts found there, and a node with
children a presentation importance, the entropy of the sequences of children found there, both over the host's pages that
have the node and by the logarithm of their number: a menu that reads alike on every page has 0, an article 1. A branch's
entropy is the mean of those of its nodes, which count less the deeper they lie.

Entropy alone doesn't show adverts and menus that differ from page to page, so a branch's importance is its entropy
times what its standing in the tree leaves of it, the least of the branches that hold it counting:

* a branch that holds the host's main text (over half of the text of its article and main elements, or where it has none
  over 9 tenths of all text), html and body keep it all, whatever they are called;
* one whose element or class, id or role names a part of a page that isn't its text (nav, aside, comments, ...) keeps a fifth;
* one beside the article and main elements of the host keeps a fifth;
* on hosts without such elements, one whose text is links by 4 fifths keeps a fifth.

A branch is removed from each page if neither it nor any branch within it is important. What an article holds without a
class of its own is part of the article, whose importance it shares. On hosts of fewer than LEAST_PAGES distinct pages
entropies say nothing; there, and where nothing of a page would be left, a page is a tree of its own, with every entropy 1.

Defined cases. Null html: empty text. Null url, or one without a host: such pages share a tree. Repeated rows: each is
returned, the tree counts them once. Very long pages: read whole. Documents that end within a tag, a comment or a
script: what precedes it counts. Nodes deeper than DEEPEST share that ancestor's style node; no text is lost by it. Ties
between texts play no part. An empty table gives an empty table. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Set
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, map_arrow

LOW_IMPORTANCE, LEAST_PAGES, FADE, DEEPEST = 0.3, 5, 0.9, 24
#: Shares of the main text, and of all text, beyond which a branch holds it; of linked text, beyond which it is a menu.
HOLDS_MAIN, HOLDS_ALL, LINKED = 0.5, 0.9, 0.8
#: Article and main elements have the main text if so many of a host's pages have such that no named part holds, or else if
#: they have so much of all text.
MAIN_PAGES, MAIN_SHARE = 0.5, 0.2
#: What is left of the importance of branches that aren't the text by name or place.
ASIDE = 0.2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|</?[a-zA-Z][^>]*+(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)

# fixed values: element names of HTML
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"},
}
BARRIERS = frozenset("table ul ol dl article section main div body td th".split())
NO_TEXT = frozenset("head button select datalist svg canvas audio video object".split())
ROLE_TAGS = frozenset("nav footer header aside form menu dialog search".split())
TEXT_TAGS = frozenset("article main".split())
# words that name parts that aren't the text, and such as may stand beside them in a class
ROLE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup "
    "promo promoted promotion related replies reply respond search share sharing sidebar signup skyscraper social sponsor sponsored subscribe "
    "toolbar widget".split()
) | frozenset("alert complementary contentinfo".split())
PART_WORDS = frozenset(
    "area articles bar block bottom box buttons container content entries group inner item items left links list main outer page "
    "panel post posts primary reader region right row secondary section site slot stories thread top unit user wrap wrapper".split()
)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", raw text), ("open", tag, attributes) and ("close", tag, "")."""
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            yield "close", tag, ""
            continue
        yield "open", tag, m[3]
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = closing.end() if closing else end
            yield "close", tag, ""


def names_role(token: str) -> bool:
    """Whether a class, id or role such as sidebar or site-footer names a part that isn't the text; has-sidebar doesn't."""
    words = [w for w in re.split(r"[^a-z]+", token) if w]
    return any(w in ROLE_WORDS for w in words) and all(w in ROLE_WORDS or w in PART_WORDS for w in words)


@lru_cache(1 << 14)
def label_of(tag: str, attributes: str, within_text: bool) -> str:
    """The node's name in the style tree: its tag and classes, without digits, and ! if they say that it isn't the text."""
    role, classes = tag in ROLE_TAGS and not (tag == "header" and within_text), ""
    if attributes and "=" in attributes and tag not in ("html", "body"):
        for kind, value in _ATTRIBUTE.findall(attributes):
            tokens = value.strip("\"'").lower().split()
            role = role or any(map(names_role, tokens))
            if kind.lower() == "class":
                classes = ".".join(sorted({re.sub(r"[0-9>!.]+", "", t) for t in tokens} - {""}))
    return (f"{tag}.{classes}" if classes else tag) + "!" * role


def tag_of(label: str) -> str:
    return label.partition(".")[0].rstrip("!")


Block = tuple[str, bool, str, int]


def blocks_of(page: str) -> tuple[list[Block], dict[str, list[str]]]:
    """Text blocks (path, whether part of an article rather than set off in it, text, linked code points), and the children
    of each path."""
    blocks: list[Block] = []
    children: dict[str, list[str]] = {"": []}
    # tag, path, text by its role, whether it bounds blocks, dropped, within a link
    stack: list[tuple[str, str, bool, bool, bool, bool]] = [("", "", False, True, False, False)]
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                _, path, kept, *_ = stack[-1]
                blocks.append((path, kept, text, min(linked, len(text))))
            linked = 0

    def pop_to(tags: Set[str], barrier: Set[str] = frozenset()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                if any(s[3] for s in stack[k:]):
                    flush()
                del stack[k:]
                return
            if stack[k][0] in barrier:
                return

    for kind, tag, value in events(page):
        if kind == "text":
            if not stack[-1][4]:
                parts.append(value)
                if stack[-1][5]:
                    linked += len(value.strip())
        elif kind == "close":
            if tag in BLOCKS:
                flush()
                pop_to({tag})
            else:
                pop_to({tag}, BLOCKS)
        elif tag == "br":
            parts.append("\n")
        else:
            if tag in BLOCKS:
                flush()
                pop_to({"p"}, BARRIERS)
            if tag in CLOSES:
                pop_to(CLOSES[tag], BARRIERS - CLOSES[tag])
            if tag in VOID:
                continue
            _, path, kept, _, dropped, link = stack[-1]
            block = tag in BLOCKS
            if block:
                label = label_of(tag, value, kept)
                seen = children.setdefault(path, [])
                if not seen or seen[-1] != label:
                    seen.append(label)
                if path.count(">") < DEEPEST:
                    path = f"{path}>{label}"
                kept = tag in TEXT_TAGS or (kept and label == tag)
            stack.append((tag, path, kept, block, dropped or tag in NO_TEXT or tag in RAW, link or tag == "a"))
    flush()
    return blocks, children


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page and path: hashes of the page, of the text and of the sequence of children there, its code points, linked ones."""
    kinds = (pa.string(), pa.string(), *[pa.int64()] * 5)
    for batch in batches:
        rows = []
        for url, page in zip(batch.column(0), batch.column(1)):
            page = page.as_py() or ""
            host, ident = host_of(url.as_py()), xxhash.xxh64_intdigest(page.encode("utf-8", "replace")) >> 1
            blocks, children = blocks_of(page)
            texts: dict[str, tuple[int, int, int]] = {}
            for path, _, text, linked in blocks:
                h, n, n_linked = texts.get(path, (0, 0, 0))
                texts[path] = crc32(text.encode("utf-8", "replace"), h), n + len(text), n_linked + linked
            for path in {**children, **texts}:
                h, n, n_linked = texts.get(path, (None, 0, 0))
                below = crc32(" ".join(children[path]).encode()) if path in children else None
                rows.append((host, path, ident, h, below, n, n_linked))
        columns = list(zip(*rows)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in FEATURES.split(", ")])


FEATURES = "host string, path string, page bigint, content bigint, children bigint, chars bigint, linked bigint"


def style_nodes(pages: DataFrame) -> DataFrame:
    """host, path, kind (content, children), n_pages, importance (an entropy, 0 to 1), chars, linked of the hosts' style nodes."""
    found = map_arrow(pages.select("url", "html"), _features, FEATURES)
    once = found.groupBy("host", "path", "page").agg(*[F.max(c).alias(c) for c in ("content", "children", "chars", "linked")])
    both = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("hash")) for kind in ("content", "children")])
    each = once.select("host", "path", "chars", "linked", F.explode(both).alias("x")).where("x.hash is not null")
    counted = each.groupBy("host", "path", "x.kind", "x.hash").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    there, entropy = F.sum("n"), F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
    content = F.col("kind") == "content"
    return counted.groupBy("host", "path", "kind").agg(
        there.alias("n_pages"), F.when(there > 1, entropy / F.log(there)).otherwise(1.0).alias("importance"),
        F.sum(F.when(content, F.col("chars")).otherwise(0)).alias("chars"), F.sum(F.when(content, F.col("linked")).otherwise(0)).alias("linked"),
    )


_SHARES = r"(^|>)(article|main)[^>]*(>[^>.!]+)*$"


def _text_at() -> Column:
    """The place in a path, from 1, of its first article or main element, or 0."""
    is_text = F.transform(F.split("path", ">"), lambda x: F.regexp_extract(x, r"^[^.!]*", 0).isin(*sorted(TEXT_TAGS)))
    return F.array_position(is_text, F.lit(True))


def _standing(least_pages: int) -> Column:
    """What a branch's name and place leave of its importance: 1 or ASIDE."""
    plain = F.col("main_pages") >= MAIN_PAGES * F.col("host_pages")
    has_main = plain | (F.col("host_main") >= MAIN_SHARE * F.col("host_chars"))
    holds = F.when(plain, F.col("plain") > HOLDS_MAIN * F.col("host_plain")).when(has_main, F.col("main") > HOLDS_MAIN * F.col("host_main")).otherwise(F.col("chars") > HOLDS_ALL * F.col("host_chars"))
    beside = has_main & (F.col("main") == 0) & (_text_at() == 0)
    menu = ~has_main & (F.col("n_pages") >= least_pages) & (F.col("linked") > LINKED * F.col("chars"))
    root = F.col("path").rlike(r"(^|>)(html|body|)$")
    return F.when(root | holds, 1.0).when(F.col("path").endswith("!") | beside | menu, ASIDE).otherwise(1.0)


def style_tree(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, path, n_pages, importance, most (the largest importance in its branch) of every branch of the hosts' style trees."""
    nodes = cut(style_nodes(pages))
    hosts = nodes.where((F.col("path") == "") & (F.col("kind") == "children") & (F.col("n_pages") >= least_pages)).select("host")
    nodes = nodes.join(hosts, "host", "left_semi").withColumn("text_at", _text_at())
    within = F.slice(F.split("path", ">"), F.lit(1), F.greatest(F.col("text_at") - 1, F.lit(0)).cast("int"))
    nodes = nodes.withColumn("plain_at", F.when(F.exists(within, lambda x: x.endswith("!")), 0).otherwise(F.col("text_at")))
    of = lambda at: F.sum(F.when(F.col(at) > 0, F.col("chars")).otherwise(0))
    whole = nodes.groupBy("host").agg(
        F.max("n_pages").alias("host_pages"), F.max(F.when(F.col("plain_at") == F.size(F.split("path", ">")), F.col("n_pages"))).alias("main_pages"),
        of("text_at").alias("host_main"), of("plain_at").alias("host_plain"), F.sum("chars").alias("host_chars"),
    ).fillna(0, "main_pages")
    # a node counts towards each branch that it is part of
    weight = F.pow(F.lit(FADE), F.col("depth") - F.col("top"))
    known = F.when(F.col("n_pages") >= least_pages, F.col("importance")).otherwise(1.0)
    up = above(nodes).withColumn("weight", weight).groupBy("host", F.col("branch").alias("path")).agg(
        F.max("n_pages").alias("n_pages"), F.round(F.sum(known * F.col("weight")) / F.sum("weight"), 9).alias("entropy"), F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"),
        *[F.sum(F.when(F.col("top") <= F.col(at), F.col("chars")).otherwise(0)).alias(name) for at, name in (("text_at", "main"), ("plain_at", "plain"))],
    )
    own = F.when(F.col("path").rlike(_SHARES), 1.0).otherwise(F.col("entropy"))
    branches = cut(up.join(whole, "host").select("host", "path", "n_pages", own.alias("own"), _standing(least_pages).alias("left")))
    least = above(branches.select("host", "path")).join(branches.select("host", F.col("path").alias("branch"), "left"), ["host", "branch"])
    least = least.groupBy("host", "path").agg(F.min("left").alias("left"))
    rated = cut(branches.drop("left").join(least, ["host", "path"]).select("host", "path", "n_pages", (F.col("own") * F.col("left")).alias("importance")))
    most = above(rated.select("host", "path", "importance")).groupBy("host", "branch").agg(F.max("importance").alias("most"))
    return rated.join(most.withColumnRenamed("branch", "path"), ["host", "path"])


def above(nodes: DataFrame) -> DataFrame:
    """Each node once for every branch that holds it, itself included."""
    names = F.split("path", ">")
    up = nodes.withColumn("depth", F.size(names)).withColumn("top", F.explode(F.sequence(F.lit(1), F.size(names))))
    return up.withColumn("branch", F.array_join(F.slice(names, F.lit(1), F.col("top")), ">"))


def prefixes(path: str) -> list[str]:
    """The branches that hold a path, itself included, the root first."""
    names = path.split(">")
    return [">".join(names[: k + 1]) for k in range(len(names))]


def set_aside(blocks: list[Block]) -> set[str]:
    """The branches of a page, taken as a tree of its own, that name or place sets aside."""
    sums: dict[str, list[int]] = {}  # of all text, of main text, and of such as no named part holds
    within = set()
    for path, _, text, _ in blocks:
        names = path.split(">")
        at = next((k for k, x in enumerate(names) if tag_of(x) in TEXT_TAGS), -1)
        plain = at if not any(x.endswith("!") for x in names[: max(at, 0)]) else -1
        for k, p in enumerate(prefixes(path)):
            found = sums.setdefault(p, [0, 0, 0])
            for i, held in enumerate((True, k <= at, k <= plain)):
                found[i] += len(text) if held else 0
            if 0 <= at <= k:
                within.add(p)
    n, n_main, n_plain = sums.get("", [0, 0, 0])
    has_main = n_plain > 0 or n_main >= MAIN_SHARE * max(n, 1)
    aside = set()
    for p, (all_of, main, plain) in sums.items():
        holds = plain > HOLDS_MAIN * n_plain if n_plain else main > HOLDS_MAIN * n_main if has_main else all_of > HOLDS_ALL * n
        if not holds and p.rpartition(">")[2] not in ("html", "body", "") and (p.endswith("!") or (has_main and not main and p not in within)):
            aside.add(p)
    return aside


def main_text(page: str, low: Set[str]) -> str:
    """low: paths of the branches of low importance of the host's tree; empty if the page is a tree of its own."""
    blocks, _ = blocks_of(page)
    out: list[str] = []
    for gone in (low, frozenset()):
        gone = gone or set_aside(blocks)
        passed: dict[str, bool] = {}
        for path, _, text, _ in blocks:
            if path not in passed:
                passed[path] = gone.isdisjoint(prefixes(path))
            if passed[path]:
                out.append(text)
        if out:
            break
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lows = batch.column(3).to_pylist()
        texts = [main_text(page.as_py() or "", frozenset(low or ())) for page, low in zip(batch.column(2), lows)]
        lengths = pa.array(list(map(len, texts)), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths], names=["page_id", "url", "text", "n_chars"])


def low_branches(pages: DataFrame, low_importance: float = LOW_IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, paths: the topmost branches to remove of each host that has a tree; none, maybe."""
    tree = style_tree(pages, least_pages)
    gone = F.when(F.col("most") < low_importance, F.col("path"))
    found = tree.groupBy("host").agg(F.sort_array(F.collect_set(gone)).alias("paths"))
    # within a branch that goes nothing more need be named
    return found.withColumn("paths", F.filter("paths", lambda p: ~F.exists("paths", lambda q: F.startswith(p, F.concat(q, F.lit(">"))))))


def extract_text(pages: DataFrame, low_importance: float = LOW_IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of pages(page_id, url, html)."""
    low = cut(low_branches(pages, low_importance, least_pages).select(F.col("host").alias("_host"), F.col("paths").alias("_low")))
    there = low.agg(F.sum(F.octet_length("_host") + F.octet_length(F.array_join("_low", ">")) + 64)).first()[0] or 0
    if there <= BROADCAST_BYTES:
        low = F.broadcast(low)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?i:[a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    mine = pages.select(F.col("page_id").cast("long"), "url", "html", host.alias("_of"))
    joined = mine.join(low, F.col("_of") == F.col("_host"), "left")
    return map_arrow(joined.select("page_id", "url", "html", "_low"), _extract, "page_id bigint, url string, text string, n_chars bigint")
