"""Main text of web pages by the distribution of text over line blocks.

A page becomes lines, one for each block of text, with a gap of empty lines wherever a container (``div``, ``section``
and the like) begins or ends. A line weighs its characters outside links; markup that surrounds articles (menus,
adverts, forms, comments, by tag, role or class) weighs nothing, a page's own article mark and its title weigh
more. Weights are summed over a window that slides along the lines. The sum surges where it reaches a share of the
page's greatest sum and dives where it comes to nothing; what surges, with the rest of the innermost container it lies
in, sets the bounds, and the text between the first surge and the last dive is kept.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.llm.common import exact_id

#: Lines in a window; share of the page's greatest sum at which a sum surges; share of link text that makes a menu.
WINDOW, SURGE, LINKS = 3, 0.4, 0.5
#: How much more a line weighs inside the page's own article mark, and as its title.
MARKED, TITLE = 20, 10
#: Share of the page's text above which an element is a wrapper, whatever its class says.
WRAPPER = 0.5

_NEXT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*)(?:>|\Z|(?=<))", re.S)
_MARK = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Elements whose content is no markup; it is skipped to the closing tag.
_RAW = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp")}
_DROP = {"nav", "header", "footer", "aside", "form", "button", "head", "menu", "dialog", "label", "fieldset", "audio", "video",
         "canvas", "map", "optgroup", "datalist", "svg", "math", "select", "object"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_CONTAINER = {"article", "main", "section", "div", "td", "th", "details", "center"} | _DROP
_BLOCK = {"address", "body", "blockquote", "dd", "dl", "dt", "figure", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li",
          "ol", "p", "pre", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "caption"} | _CONTAINER
_SELF_CLOSING = {"p", "li", "td", "th", "tr", "dt", "dd", "option"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog",
          "menu", "menubar", "toolbar", "tablist"}
#: Words in a class or id that mark what surrounds an article.
_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "cookie",
          "cookies", "consent", "gdpr", "popup", "modal", "overlay", "nav", "navbar", "navigation", "menu", "menus", "submenu", "breadcrumb",
          "breadcrumbs", "sidebar", "footer", "masthead", "topbar", "toolbar", "comment", "comments", "commentlist", "disqus", "respond",
          "replies", "social", "related", "recommended", "recommendations", "newsletter", "subscribe", "subscription", "signup",
          "login", "pagination", "pager", "tagcloud", "paywall", "outbrain", "taboola"}
#: Words that mark it only in a class or id made up of such words.
_WEAK = {"banner", "notice", "notices", "alert", "aside", "side", "widget", "widgets", "foot", "header", "reply", "share", "sharing", "trending",
         "popular", "search", "tags", "copyright", "legal", "disclaimer", "skip", "teaser", "teasers", "links", "buttons"}
_FILLER = {"site", "page", "main", "top", "bottom", "left", "right", "box", "bar", "area", "section", "block", "list", "wrap", "wrapper",
           "container", "inner", "content", "post", "posts", "item", "global", "slot", "unit", "thread", "form", "banner"}
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


def _names_surroundings(value: str, marked: bool) -> bool:
    """Whether a class or id names what surrounds articles. Inside the page's own article mark all of its words have to."""
    for whole in value.split():
        words = [w.lower() for w in _SPLIT.split(whole) if len(w) > 1]
        if not marked and any(w in _WORDS for w in words):
            return True
        if any(w in _WEAK or w in _WORDS for w in words) and all(w in _WEAK or w in _WORDS or w in _FILLER for w in words):
            return True
    return False


def _surrounds(tag: str, attributes: str, marked: bool) -> tuple[bool, bool]:
    """Whether the element is no part of an article for certain, and whether its class says so."""
    if tag in _DROP:
        return True, False
    if tag in ("html", "body") or not attributes.strip():
        return False, False
    named = False
    for name, a, b, c in _MARK.findall(attributes):
        name, value = name.lower(), a or b or c
        if (name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value)
                or name == "role" and value.strip().lower() in _ROLES):
            return True, False
        named = named or name in ("class", "id") and _names_surroundings(value, marked)
    return False, named


@dataclass
class Line:
    """A block's text, characters of it inside links, its innermost container, mark and shade, or -1 for none; a title."""

    text: str
    linked: int
    container: int
    mark: int
    shade: int
    title: bool


@dataclass
class Page:
    """Lines (None: an empty one), for each container its first line, the line after its last and the container around it, and for each
    element that may surround the article (a shade) the shade around it and whether it surely does."""

    lines: list[Line | None] = field(default_factory=list)
    containers: list[list[int]] = field(default_factory=list)
    shades: list[tuple[int, bool]] = field(default_factory=list)


def read(page: str) -> Page:
    """The page's lines, in one pass over its markup; every element is opened and closed once."""
    out = Page()
    stack: list[tuple[str, int, int, int]] = []  # tag, and the container, mark and shade inside it
    at_depth: dict[str, list[int]] = {}
    text: list[str] = []
    linked = link_depth = at = 0
    container = mark = shade = -1
    title = False

    def close() -> None:
        nonlocal linked
        line = " ".join(entities.unescape("".join(text)).split())
        if line:
            out.lines.append(Line(line, min(linked, len(line)), container, mark, shade, title))
        text.clear()
        linked = 0

    def around() -> None:
        nonlocal container, mark, shade
        container, mark, shade = stack[-1][1:] if stack else (-1, -1, -1)

    def pop() -> None:
        nonlocal link_depth, title
        tag, inside, _, _ = stack.pop()
        at_depth[tag].pop()
        if tag in _CONTAINER:
            out.containers[inside][1] = len(out.lines)
            out.lines.extend([None] * WINDOW)
        if len(stack) < link_depth:
            link_depth = 0
        title = title and tag != "h1"
        around()

    while m := _NEXT.search(page, at):
        if m.start() > at:
            text.append(page[at : m.start()])
            linked += m.start() - at if link_depth else 0
        at = m.end()
        if not (tag := (m[2] or "").lower()):
            continue
        if tag == "br":
            text.append(" ")
        if tag in _BLOCK:
            close()
        if m[1]:
            if tag == "a":
                link_depth = 0
            elif at_depth.get(tag):
                depth = at_depth[tag][-1]
                while len(stack) > depth:
                    if stack[-1][0] in _BLOCK:
                        close()
                    pop()
        elif tag in _RAW:
            if not m[3].endswith("/"):
                end = _RAW[tag].search(page, at)
                at = end.start() if end else len(page)
        elif tag == "a":
            link_depth = len(stack) + 1
        elif tag not in _VOID and not m[3].endswith("/"):
            if tag in _SELF_CLOSING and stack and stack[-1][0] == tag:
                pop()
            sure, named = _surrounds(tag, m[3], mark >= 0)
            if tag in _CONTAINER:
                out.lines.extend([None] * WINDOW)
                out.containers.append([len(out.lines), -1, container])
                container = len(out.containers) - 1
            if tag in ("article", "main") and not (tag == "main" and mark >= 0):
                mark = container
            if sure or named:
                out.shades.append((shade, sure))
                shade = len(out.shades) - 1
            title = title or tag == "h1"
            at_depth.setdefault(tag, []).append(len(stack))
            stack.append((tag, container, mark, shade))
    text.append(page[at:])
    close()
    for c in out.containers:
        c[1] = len(out.lines) if c[1] < 0 else c[1]
    return out


def _shaded(page: Page) -> list[bool]:
    """Whether each shade is one: for certain, or by a class on what holds no more than ``WRAPPER`` of the text."""
    held = [0] * len(page.shades)
    total = 0
    for line in page.lines:
        if line:
            total += len(line.text)
            if line.shade >= 0:
                held[line.shade] += len(line.text)
    for k in range(len(held) - 1, -1, -1):
        if page.shades[k][0] >= 0:
            held[page.shades[k][0]] += held[k]
    out: list[bool] = []
    for k, (outer, sure) in enumerate(page.shades):
        out.append(outer >= 0 and out[outer] or sure or held[k] <= WRAPPER * total)
    return out


def _wrappers(page: Page, lines: list[Line | None], around: set[int]) -> list[int]:
    """Of an article without a mark: the containers around what surged, as long as most of their text is in it and
    they hold nothing that surrounds articles; short parts of the article may stand in them on their own."""
    if any(x and x.mark >= 0 for x in lines):
        return []
    dropped = [0, *accumulate(a is not None and b is None for a, b in zip(page.lines, lines))]
    size = [0, *accumulate(len(x.text) if x else 0 for x in lines)]
    out: set[int] = set()
    for inside in around:
        begin, end, outer = page.containers[inside]
        held = size[end] - size[begin]
        while outer >= 0 and outer not in around and outer not in out:
            begin, end, beyond = page.containers[outer]
            if dropped[end] > dropped[begin] or 2 * held < size[end] - size[begin]:
                break
            out.add(outer)
            outer = beyond
    return sorted(out)


def main_text(page: str | None) -> str:
    """The article's blocks joined by empty lines; "" if there are none."""
    read_ = read(page or "")
    shaded = _shaded(read_)
    lines = [x if x and not (x.shade >= 0 and shaded[x.shade]) else None for x in read_.lines]

    def weight(x: Line | None) -> int:
        if not x:
            return 0
        # Inside a mark, links are as good as other text.
        return len(x.text) * MARKED * (TITLE if x.title else 1) if x.mark >= 0 else max(0, len(x.text) - 2 * x.linked) * (TITLE if x.title else 1)

    n = len(lines)
    total = [0, *accumulate(map(weight, lines))]
    sums = [total[min(i + WINDOW, n)] - total[i] for i in range(n)]
    top = max(sums, default=0)
    if not top:
        return ""
    first, last, own, around = n, 0, [False] * n, set()
    i = 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        begin, surges = i, False
        while i < n and sums[i]:
            surges = surges or sums[i] >= SURGE * top
            i += 1
        if surges:
            weighty = [k for k in range(begin, i) if total[k + 1] > total[k]]
            own[weighty[0] : weighty[-1] + 1] = [True] * (weighty[-1] + 1 - weighty[0])
            first, last = min(first, weighty[0]), max(last, weighty[-1] + 1)
            for k in weighty:
                inside = lines[k].mark if lines[k].mark >= 0 else lines[k].container
                if inside >= 0 and inside not in around:
                    around.add(inside)
                    first, last = min(first, read_.containers[inside][0]), max(last, read_.containers[inside][1])
    for inside in _wrappers(read_, lines, around):
        first, last = min(first, read_.containers[inside][0]), max(last, read_.containers[inside][1])
        around.add(inside)
    kept = []
    for x, surged in zip(lines[first:last], own[first:last], strict=True):
        if x and (surged or x.mark >= 0 or x.container in around or x.linked <= LINKS * len(x.text)):
            kept.append(x.text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points of the text).

    Null html counts as empty and gives an empty text; broken or cut markup is read as far as it
    goes; repeated rows give repeated rows; null ids and urls stay null; extra columns are ignored.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(exact_id(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(kind))
