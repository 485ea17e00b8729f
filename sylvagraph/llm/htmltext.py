"""Main text of web pages by site style trees (operator 3).

Each page is parsed into blocks of text under a path of structural elements (tag and first class or id). The pages of a
host are merged into one tree of such paths. A content node's importance is one minus the mean, over what it shows, of log n / log (m + 2),
where n of the m pages with the node show that: what all of many pages repeat has importance near zero, and few pages prove little. A presentation node's importance
is the entropy, to base m, of the child sequences that it has. A node's composite importance weighs its content by g^l and its presentation
by 1 - g^l, with l the kinds of child sequences of its own; a node of text alone has that of its content. Branches below the threshold are removed from each page, in the
article as elsewhere. Pages whose article is the same count as one, so copies of an article don't make it a repetition.

Markup takes part as evidence that outweighs any importance: navigation, headers, footers, asides, forms, scripts, adverts, notices and comments
that are declared as such, and whatever stands beside an article or main element that has text. A page of which nothing is left has empty text.

Tree statistics are sums that Spark combines before it shuffles; texts are never shuffled while the table of
low branches is small (checked). Beyond that they are joined by host, as two plain tables, so that adaptive execution splits a large host.
A host's low branches are one list of 8 bytes each.

Null, empty and text-free pages give empty text. Broken, unclosed and cut-off markup is read as far as it goes. Null urls are one host.
Rows are independent: repeated rows give repeated results, and each counts as a page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvagraph.llm.common import free_name, mapped, quoted, stored
from sylvagraph.llm.urlfilter import host_of

# Kinds of elements.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NOT_ARTICLE = {"nav", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "object", "canvas", "datalist", "fieldset", "audio", "video"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "caption", "tbody", "tfoot", "thead", "tr", "ul", "button", "select", "object", "canvas", "datalist", "audio", "video"}
ENDS_P = BLOCKS - {"html", "head", "body", "button", "select", "object", "canvas", "datalist", "audio", "video", "caption", "tbody", "tfoot", "thead", "tr"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "tbody": {"thead", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tfoot": {"tbody"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
# Parts of class names and ids.
NAMES = {"nav", "navbar", "navigation", "menu", "menubar", "sidebar", "ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense", "banner", "promo", "promotion", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "share", "sharing", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "header", "masthead", "topbar", "toolbar", "widget", "login", "search", "searchbox", "copyright", "disclaimer", "skip", "form"}
COMMENTS = {"comment", "comments", "disqus", "reply", "replies", "respond", "discussion", "commentlist"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
_PARTS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MASK = (1 << 64) - 1


class Element:
    __slots__ = ("tag", "path", "parent", "hard", "soft", "core", "head", "main", "children")

    def __init__(self, tag: str, path: int, parent: Element | None, hard: bool, soft: str, main: bool):
        self.tag, self.path, self.parent, self.hard, self.soft, self.main = tag, path, parent, hard, soft, main
        self.core = self.head = False
        self.children: list[int] = []


def _declared(attributes: str) -> tuple[str, bool, str]:
    """Of an element's attributes: its name for paths, whether it is surely no article, and the kind of its class names ('', 'name', 'comment')."""
    name, hard, soft = "", False, ""
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), unescape((m[2] or "").strip("\"'"))
        if key == "hidden":
            hard = True
        elif key == "aria-hidden":
            hard |= value.strip().lower() == "true"
        elif key == "style":
            hard |= bool(_HIDDEN.search(value))
        elif key == "role":
            hard |= value.strip().lower() in ROLES
        else:
            name = name or value.split(" ", 1)[0]
            parts = set(_PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
            if parts & COMMENTS:
                soft = "comment"
            elif parts & NAMES and not soft:
                soft = "name"
    return name, hard, soft


def parse(html: str) -> tuple[list[tuple[str, Element]], list[Element]]:
    """Blocks of text in page order, each with its structural element, and all structural elements."""
    from xxhash import xxh64_intdigest

    top = Element("", 0, None, False, "", False)
    stack, elements, blocks, texts = [top], [], [], []
    at, size = 0, len(html)

    def flush() -> None:
        if texts:
            text = " ".join("".join(texts).split())
            texts.clear()
            if text:
                blocks.append((text, stack[-1]))

    def close(to: int) -> None:
        flush()
        del stack[to:]

    find = _TOKEN.search
    while at < size:
        m = find(html, at)
        if m is None:
            texts.append(unescape(html[at:]))
            break
        if m.start() > at:
            text = html[at : m.start()]
            texts.append(unescape(text) if "&" in text else text)
        at = m.end()
        ending, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if ending:
            if tag in BLOCKS or tag == "span":
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                else:
                    if tag in BLOCKS:
                        flush()
            elif tag in ("td", "th"):
                texts.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            at = size if end is None else end.start()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr"):
                texts.append(" " if tag == "br" else "")
            continue
        if tag in ("td", "th"):
            texts.append(" ")
            continue
        if tag not in BLOCKS and not (tag == "span" and ("class" in attributes or "hidden" in attributes)):
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in ("button", "object"):
                    break
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    close(i)
                    break
                if stack[i].tag in SCOPES[tag]:
                    break
        if tag not in ("html", "head") and tag in BLOCKS and len(stack) > 1:
            for i in range(1, len(stack)):
                if stack[i].tag == "head":
                    close(i)
                    break
        if tag == "span":
            name, hard, soft = _declared(attributes)
            if not (hard or soft):
                continue
        else:
            flush()
            name, hard, soft = _declared(attributes) if attributes.strip() else ("", False, "")
        parent = stack[-1]
        path = xxh64_intdigest(f"{tag}.{name}", parent.path & _MASK)
        main = tag in ("article", "main")
        element = Element(tag, path, parent, hard or tag in NOT_ARTICLE, soft or ("name" if tag == "header" else ""), main)
        parent.children.append(path)
        if main or tag == "h1":
            for e in stack:
                e.core = True
                e.head |= tag != "article"
        stack.append(element)
        if tag != "span":
            elements.append(element)
        if hard and tag in ("html", "body"):
            element.hard = False
    flush()
    return blocks, elements


def _chain(element: Element) -> Iterator[Element]:
    while element.parent is not None:
        yield element
        element = element.parent


def _kept(blocks: list[tuple[str, Element]], low: set[int]) -> list[str]:
    """The blocks that are article, in page order."""
    marked = []
    for text, element in blocks:
        out = inside = False
        for e in _chain(element):
            if e.hard or (e.soft == "name" and not e.core) or (e.soft == "comment" and not e.head):
                out = True
                break
            inside |= e.main
        marked.append((text, element, out, inside))
    main = any(inside and not out for _, _, out, inside in marked)
    return [text for text, element, out, inside in marked if not out and (inside or not main) and not any(e.path in low for e in _chain(element))]


def main_text(html: str, low: set[int] | frozenset[int] = frozenset()) -> str:
    return "\n\n".join(_kept(parse(html)[0], low)) if html else ""


CONTENT, PRESENTATION, PAGES = 0, 1, 2
STYLE_ROWS = "host string, path bigint, kind int, feature bigint, page bigint"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _style_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, html -> what each page adds to its host's style tree, once a page."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        for part in (batch.slice(at, 200) for at in range(0, batch.num_rows, 200)):
            hosts, rows = [], []
            for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                blocks, elements = parse(html or "")
                page = xxh64_intdigest("\n".join(_kept(blocks, set())))
                mine = {(e.path, PAGES, 0, page) for e in elements}
                mine |= {(b.path, CONTENT, xxh64_intdigest(text), page) for text, b in blocks if b.parent}
                mine |= {(e.path, PRESENTATION, hash(tuple(e.children)) & _MASK, page) for e in elements if e.children}
                hosts += [host] * len(mine)
                rows += mine
            if rows:
                path, kind, feature, page = zip(*rows, strict=True)
                longs = lambda x: pa.array([_signed(v) for v in x], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), longs(path), pa.array(kind, pa.int32()), longs(feature), longs(page)], names=["host", "path", "kind", "feature", "page"])


def importance(pages: DataFrame, decay: float = 0.9) -> DataFrame:
    """host, path, pages and the composite importance of each path with text in the hosts' style trees. ``pages``: host, html."""
    shown = pages.mapInArrow(_style_rows, STYLE_ROWS).distinct()
    counts = shown.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("n"))
    only = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0.0))
    n, logs = F.col("n"), F.col("n") * F.log("n")
    nodes = counts.groupBy("host", "path").agg(
        only(PAGES, n).alias("pages"), only(CONTENT, n).alias("shown"), only(CONTENT, logs).alias("shown_logs"),
        only(PRESENTATION, n).alias("styled"), only(PRESENTATION, logs).alias("styled_logs"), only(PRESENTATION, F.lit(1.0)).alias("styles"),
    ).filter("shown > 0")
    content = 1 - F.col("shown_logs") / (F.col("shown") * F.log(F.col("pages") + 2))
    presentation = F.when((F.col("pages") > 1) & (F.col("styled") > 0), (F.log("styled") - F.col("styled_logs") / F.col("styled")) / F.log("pages")).otherwise(1.0)
    share = F.pow(F.lit(decay), F.col("styles"))
    return nodes.select("host", "path", "pages", (share * content + (1 - share) * presentation).alias("importance"))


BROADCAST_ROWS = 100_000


def extract(df: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.4) -> DataFrame:
    """The columns ``keep`` (default: all but the html) and the main text of each page."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in (html_col.lower(), text_col.lower())]
    host, low = free_name(df, "host"), free_name(df, "low_paths")
    pages = df.withColumn(host, host_of(F.col(url_col)))
    nodes = importance(pages.select(F.col(host).alias("host"), F.col(html_col).alias("html")))
    found = stored(nodes.filter(F.col("importance") < threshold).select(F.col("host").alias(host), "path"))
    of_host = stored(found.groupBy(host).agg(F.collect_set("path").alias(low)))
    small = found.count() <= BROADCAST_ROWS
    joined = pages.join(F.broadcast(of_host) if small else of_host, host, "left").select(*quoted(keep), F.col(html_col).alias(html_col), low)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(text_col, T.StringType())])
    return mapped(joined, partial(_texts, keep=keep, html_col=html_col, low=low, text_col=text_col), schema)


def _texts(batches: Iterator[pa.RecordBatch], keep: list[str], html_col: str, low: str, text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
            texts = [main_text(html or "", {p & _MASK for p in paths or ()}) for html, paths in zip(part.column(html_col).to_pylist(), part.column(low).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, text_col])
