"""Main text of pages, with site templates removed.

Each page is cut into blocks of text, each with the hashes of the element
subtrees that hold it. Spark counts, per host, the distinct contents a subtree
occurs in; subtrees that recur across many of them are template and go, also
where sections, languages or layouts of the host each have their own. Parts
that markup itself names as menu, footer, advert and the like go on any page.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, landed
from .urls import split_url

#: Pages that make a subtree template: a few if they are much of a small host,
#: many if they are not just stray ones of a large host; the more, the less of it.
MIN_PAGES, MIN_SHARE = 3, 0.3
MANY, MANY_SHARE = 10, 0.02
MASS, MASS_SHARE = 100, 0.005

#: Code points from which a block is prose and no caption, link or button.
PROSE = 100

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?P<close>>|\Z)|<[!?][^>]*(?:>|\Z)""",
    re.S,
)
#: A quote opens a value only where it begins one; names inside values are none.
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "xmp", "iframe", "noembed", "noframes"}
JUNK_TAGS = {
    "head", "nav", "footer", "aside", "form", "template", "button", "select", "svg", "math", "dialog", "menu",
    "object", "canvas", "audio", "video", "datalist", *RAW,
}
#: Words of class and id names, cut at anything but letters and digits. The
#: first list holds wherever a name has one of its words.
JUNK_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "sidebar",
    "comments", "disqus", "cookie", "cookies", "consent", "gdpr", "newsletter", "breadcrumb", "breadcrumbs", "nav",
    "navbar", "navigation", "footer", "popup", "modal", "paywall", "pagination",
}
#: These words are also ordinary ones, so around prose of an article they count
#: only in names made of nothing but them, the first list and words of layout.
WEAK_NAMES = {
    "promo", "promotion", "banner", "comment", "respond", "reply", "replies", "notice", "subscribe", "subscription",
    "signup", "share", "sharing", "social", "related", "recommended", "menu", "topbar", "overlay", "widget", "pager",
    "toolbar", "skip",
}
LAYOUT_NAMES = {
    "a", "area", "article", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content",
    "form", "group", "head", "icon", "icons", "inner", "item", "items", "js", "left", "link", "links", "list", "main",
    "media", "outer", "page", "panel", "post", "posts", "right", "row", "section", "site", "slot", "thread", "to",
    "top", "unit", "us", "wrap", "wrapper",
}
JUNK_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
    "hr", "html", "legend", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
#: A start tag on the left ends an open element on the right.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
TOP = {"html", "body", "main", "article"}


class Node:
    __slots__ = ("tag", "junk", "hash", "scope")

    def __init__(self, tag: str, junk: bool, scope: int):
        self.tag, self.junk, self.scope, self.hash = tag, junk, scope, hash_text(tag)


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def is_junk_name(value: str, inside: bool) -> bool:
    for name in value.lower().split():
        words = {w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()}
        if not words.isdisjoint(JUNK_NAMES):
            return True
        weak = words & WEAK_NAMES
        if weak and (not inside or words <= WEAK_NAMES | LAYOUT_NAMES):
            return True
        if not inside and not {"header", "masthead"}.isdisjoint(words):
            return True
    return False


def is_junk(tag: str, attrs: str, inside: bool) -> bool:
    if tag in JUNK_TAGS or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            return True
        if name == "style" and NO_DISPLAY.search(value):
            return True
        if name == "role" and value.strip().lower() in JUNK_ROLES:
            return True
        if name in ("class", "id") and is_junk_name(value, inside):
            return True
    return False


def page_blocks(page: str) -> list[tuple[str, list[int]]]:
    """The blocks of text in page order, each with its subtrees' hashes.

    If the page has an ``article``, only blocks in one count, else those in a
    ``main``, else those of the body. A scope beside which there is more prose
    than in it is a teaser and limits nothing."""
    stack = [Node("html", False, 0)]
    found: list[tuple[str, list[Node], int]] = []
    text: list[str] = []
    junk, scope, at, n = 0, 0, 0, len(page)

    def flush():
        words = " ".join("".join(text).split())
        text.clear()
        if words:
            h = hash_text(words)
            for node in stack:
                node.hash = (node.hash * 1_000_003 ^ h) & 0xFFFFFFFFFFFFFFFF
            found.append((words, [x for x in stack if x.tag in BLOCKS and x.tag not in TOP], scope))

    def pop_to(depth: int):
        nonlocal junk, scope
        while len(stack) > depth:
            node = stack.pop()
            junk -= node.junk
            scope = stack[-1].scope

    while at < n:
        m = MARKUP.search(page, at)
        stop = m.start() if m else n
        if stop > at and not junk:
            text.append(entities.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in BLOCKS:
                flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    pop_to(depth)
                    break
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCKS or tag in ENDS or tag in JUNK_TAGS:
            flush() if tag in BLOCKS or tag in ENDS else None
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = stack[depth].tag
                if open_tag in ENDS.get(tag, ()) or (open_tag == "p" and tag in BLOCKS):
                    pop_to(depth)
                    break
                if open_tag in ("ul", "ol", "table", "dl", "div", "article", "main", "section", "select"):
                    break
        if tag in VOID or m["attrs"].endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        bad = is_junk(tag, m["attrs"], scope > 0)
        if bad and tag not in BLOCKS and not junk:
            pass
        inner = max(scope, {"article": 2, "main": 1}.get(tag, 0)) if not (bad or junk) else scope
        stack.append(Node(tag, bad, inner))
        junk += bad
        scope = inner
    flush()
    best = max((s for _, _, s in found), default=0)
    while best and sum(len(w) for w, _, s in found if s >= best) < sum(len(w) for w, _, s in found if s < best and len(w) >= PROSE):
        best -= 1
    return [(words, [x.hash for x in nodes]) for words, nodes, s in found if s >= best]


def blocks_of(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, url, host, content, blocks): ``content`` is a hash of all blocks."""
    host, _ = split_url(F.col(url))
    narrow = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    block = T.StructType([T.StructField("text", T.StringType()), T.StructField("trees", T.ArrayType(T.LongType()))])
    schema = T.StructType(
        [narrow.schema["key"], narrow.schema["url"], T.StructField("host", T.StringType())]
        + [T.StructField("content", T.LongType()), T.StructField("blocks", T.ArrayType(block))]
    )
    kind = pa.list_(pa.struct([("text", pa.string()), ("trees", pa.list_(pa.int64()))]))

    def run(batches):
        for batch in batches:
            content, out = [], []
            for value in batch.column("html"):
                found = page_blocks(value.as_py() or "")
                content.append(hash_text("\n".join(w for w, _ in found)))
                out.append([{"text": w, "trees": np.array(trees, np.uint64).view(np.int64).tolist()} for w, trees in found])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "url", "host")), pa.array(np.array(content, np.uint64).view(np.int64)), pa.array(out, kind)],
                names=schema.names,
            )

    return landed(in_arrow(narrow, run, schema), "blocks")


def is_template(n: Column, pages: Column, min_pages: int, min_share: float) -> Column:
    """Whether ``n`` distinct contents of a host's ``pages`` make a template."""
    few = (n >= min_pages) & (n >= min_share * pages)
    many = (n >= MANY) & (n >= MANY_SHARE * pages)
    return few | many | ((n >= MASS) & (n >= MASS_SHARE * pages))


def templates(blocks: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """(host, content, template): the template subtrees a page holds. Pages with
    equal content count once, so copies of an article do not make it a template."""
    contents = blocks.filter("size(blocks) > 0").select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    held = blocks.select("host", "content", F.explode(F.array_distinct(F.flatten("blocks.trees"))).alias("tree"))
    counts = held.distinct().groupBy("host", "tree").agg(F.count("*").alias("n")).filter(F.col("n") >= min(min_pages, MANY))
    often = counts.join(contents, "host").filter(is_template(F.col("n"), F.col("pages"), min_pages, min_share)).select("host", "tree")
    # By page: what a large host has of templates in all may be too much for a row.
    found = held.join(often, ["host", "tree"]).groupBy("host", "content").agg(F.collect_set("tree").alias("template"))
    return landed(found, "templates")


def main_text(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE
) -> DataFrame:
    """Per row: key, url, text, n_chars.

    A subtree is template if enough distinct contents of its host hold it:
    ``min_pages`` and ``min_share`` of the host's, or MANY and MANY_SHARE, or
    MASS and MASS_SHARE. NULL and empty html give an empty text; a NULL url or one without a host belongs to
    the host of empty name. Broken markup is read as far as it goes. Repeated
    rows give equal results; other columns are not read.
    """
    blocks = blocks_of(pages, key, url, html)
    marked = blocks.join(templates(blocks, min_pages, min_share), ["host", "content"], "left")
    own = F.when(
        F.col("template").isNull(), F.col("blocks.text")
    ).otherwise(F.transform(F.filter("blocks", lambda b: ~F.arrays_overlap(b["trees"], F.col("template"))), lambda b: b["text"]))
    text = F.array_join(own, "\n")
    return marked.select(F.col("key").alias(key), F.col("url").alias(url), text.alias("text"), F.length(text).cast("long").alias("n_chars"))
