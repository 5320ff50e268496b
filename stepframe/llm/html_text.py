"""Main text of web pages: the maximum-scoring run of blocks, where words score positive and tags negative."""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_REST = re.compile(r"(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# HTML element names and the words by which pages name parts that aren't the article.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "select", "title", "math", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "ul",
}
APART = {"nav", "footer", "aside", "form", "head", "header", "menu", "dialog", "button", "fieldset"}
CONTENT = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form", "note", "status"}
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent", "cookie", "cookies", "copyright",
    "disclaimer", "disqus", "discussion", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager",
    "pagination", "popup", "privacy", "promo", "promotion", "recommended", "related", "replies", "reply", "responses", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored",
    "subscribe", "subscription", "tags", "teaser", "toolbar", "topbar", "widget", "widgets", "alert", "warning", "message",
}
# Opening one of these ends an open element of the second set.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# What may be named or built like a part and yet hold the page.
SOFT = {"form", "fieldset", "name"}
LIMIT = 3.0


@dataclass
class Block:
    """Text between two block tags: the innermost mark around it, by number and then by kind, and what it scores by."""

    node: int
    tag: str
    parts: list[str] = field(default_factory=list)
    features: Counter = field(default_factory=Counter)
    mark: str = ""
    inside: bool = False
    words: int = 0
    plain: int = 0

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def _names_part(name: str, attributes: str) -> bool:
    """Whether an element's attributes mark it as something other than the article."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "").lower()
        if key in ("class", "id") and name not in ("body", "html") and any(word in NAMES for word in re.split(r"[^a-z]+", value)):
            return True
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


class _Open(NamedTuple):
    """An open element: the innermost mark and whether content is open; name and place of the innermost block, place that no implied end passes."""

    name: str
    node: int
    content: bool
    tag: str
    block: int
    wall: int


class _Tag(NamedTuple):
    start: int
    end: int
    name: str
    closes: bool
    attributes: str


def _tags(page: str) -> Iterator[_Tag]:
    """The tags of a page from left to right, raw elements with what they hold; comments and declarations have no name.

    Each character is looked at a fixed number of times. From the first tag whose quotes don't end on, quotes mean
    nothing and the next > ends a tag; behind the last > there are no tags. A comment or raw element left open takes the rest.
    """
    last, quotes, at = page.rfind(">"), True, page.find("<")
    while at >= 0:
        name, closes, attributes, end = "", False, "", 0
        if page.startswith("<!--", at):
            close = page.find("-->", at + 2)
            end = close + 3 if close >= 0 else len(page)
        elif at > last:
            return
        elif page[at + 1] in "!?":
            end = page.index(">", at) + 1
        elif found := _NAME.match(page, at):
            rest = _REST.match(page, found.end()) if quotes else None
            quotes = rest is not None
            end = rest.end() if rest else page.index(">", found.end()) + 1
            name, closes, attributes = found[1].lower(), page[at + 1] == "/", page[found.end():end - 1]
            if name in RAW and not closes:
                close = re.compile(f"</{re.escape(name)}[\\s>/]", re.I).search(page, end)
                close = page.find(">", close.start()) if close else -1
                end = close + 1 if close >= 0 else len(page)
        if end:
            yield _Tag(at, end, name, closes, attributes)
        at = page.find("<", end or at + 1)


def blocks(page: str) -> list[Block]:
    """The page cut at its block tags. Tags left open are ended by what can't stand inside them; a stray end tag is skipped.

    Work is linear in the page: where each name is open is kept, and marks are a tree of numbers.
    """
    stack, places = [_Open("", 0, False, "", 0, 0)], defaultdict(list)
    parents, kinds, titles = [0], [""], set()
    out, current, at = [], Block(0, ""), 0

    def begin() -> None:
        nonlocal current
        carried = current.features if not current.parts else Counter()
        if current.parts:
            out.append(current)
        current = Block(stack[-1].node, stack[-1].tag, [], carried)

    def add(text: str) -> None:
        if not text:
            return
        current.parts.append(text)
        words = len(text.split())
        if words:
            link = any(s.name == "a" for s in stack[-4:])
            current.features[f"w {current.tag} {'a' if link else ''}"] += words
            current.words += words
            current.plain += 0 if link else words

    def end(name: str, beyond: int) -> None:
        """Ends the innermost open element of that name, if it stands beyond a place, and all in it."""
        if places[name] and places[name][-1] > beyond:
            depth = places[name][-1]
            while len(stack) > depth:
                places[stack.pop().name].pop()

    def mark(kind: str) -> int:
        parents.append(stack[-1].node)
        kinds.append(kind)
        return len(kinds) - 1

    for tag in _tags(page):
        add(page[at:tag.start])
        at, name = tag.end, tag.name
        if not name:
            continue
        current.features[f"t {name}"] += 1
        if tag.closes:
            end(name, 0 if name in BLOCK else stack[-1].block)
            if name in BLOCK:
                begin()
            continue
        if name in RAW:
            current.parts.append(" ")
            continue
        if name == "br" or name == "wbr":
            current.parts.append(" " if name == "br" else "")
        if name in VOID and name != "hr":
            continue
        for other in ENDS.get(name, ()):
            end(other, stack[-1].wall)
        if name != "hr" and not tag.attributes.endswith("/"):
            above, node = stack[-1], stack[-1].node
            named = _names_part(name, tag.attributes)
            fresh = name in CONTENT and not named and not places["article"] and not places["main"]
            if fresh:
                titles.add(node)
                node = mark("content")
            elif name in APART and not (name == "header" and above.content) or named:
                node = mark(name if name in APART else "name")
            elif name == "article" and places["article"]:
                node = mark("nested")
            if name == "h1":
                titles.add(parents[node] if kinds[node] == "content" else node)
            place = len(stack)
            hard = name in BLOCK and name not in ENDS
            stack.append(_Open(name, node, above.content or fresh, *((name, place) if name in BLOCK else above[3:5]), place if hard else above.wall))
            places[name].append(place)
        if name in BLOCK:
            begin()
    add(page[at:])
    if current.parts:
        out.append(current)
    _judge(out, parents, kinds, titles)
    return [b for b in out if b.text() or b.features]


def _judge(own: list[Block], parents: list[int], kinds: list[str], titles: set[int]) -> None:
    """Which marks count for each block, and whether it stands in the page's content element.

    A form, fieldset or named element that holds over half of the page's words outside links, with no title (h1, article
    or main) unmarked outside it, marks nothing. The content element is the article or main with the most words outside
    links; one in a named part or form counts where it has more than all that is unmarked outside such elements, and
    then that part doesn't mark it; one in an aside, menu, header or footer never does. An article within it is a comment on it, unless it
    holds over half of its words.
    """
    size = len(parents)
    held, live, hard, clear, content = [0] * size, [0] * size, [False] * size, [True] * size, [False] * size
    for b in own:
        held[b.node] += b.plain
    bare = list(held)
    for k in range(size - 1, 0, -1):
        held[parents[k]] += held[k]
    free = 0 in titles
    for k in range(1, size):
        up = parents[k]
        off = kinds[k] == "content" or kinds[k] in SOFT and not free and 2 * held[k] > held[0]
        clear[k] = off and clear[up]
        free = free or clear[k] and k in titles
        live[k] = live[up] if off else k
        hard[k] = hard[up] or not off and kinds[k] not in SOFT
        content[k] = content[up] or kinds[k] == "content"
    unmarked = sum(bare[k] for k in range(size) if not live[k] and not content[k])
    contents = [k for k in range(size) if kinds[k] == "content" and not hard[k] and (not live[k] or held[k] > unmarked)]
    chosen = max(contents, key=lambda k: (held[k], -k), default=0)
    within = [False] * size
    for k in range(1, size):
        within[k] = k == chosen or within[parents[k]]
        if k == chosen:
            live[k] = 0
        elif live[k] != k or within[k] and kinds[k] == "nested" and 2 * held[k] > held[chosen]:
            live[k] = live[parents[k]]
    for b in own:
        b.mark = kinds[live[b.node]]
        b.inside = within[b.node] and b.mark != "nested"
        if b.words and b.mark:
            b.features[f"x {b.mark}"] += b.words
        if b.words and chosen:
            b.features["c in" if b.inside else "c out"] += b.words


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each feature stands inside and outside the content of pages that mark it."""
    for batch in batches:
        within, without = Counter(), Counter()
        for page in batch.column(0).to_pylist():
            own = blocks(page)
            if any(b.inside for b in own):
                for b in own:
                    (within if b.inside else without).update(b.features)
        names = sorted({*within, *without})
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([within[x] for x in names]), pa.array([without[x] for x in names])], names=["feature", "within", "without"])


def fit(pages: DataFrame, sample: int = 2000) -> dict[str, float]:
    """Weights of words by the block they stand in, by marks and by content elements, and of tags, from `sample` pages that mark their content.

    These are the pages of the `sample` least hashes of (page_id, url), all if fewer, so that they're read where they lie.
    A page is labelled by its own `article` or `main` element. Weights are log odds of standing inside; those of words
    outside links are at least 0.1, so words score positive, what a mark adds at most -0.1, and tags at most -0.05.
    """
    marking, key = pages.where("html is not null and (html like '%<article%' or html like '%<main%')"), F.xxhash64("page_id", "url")
    last = marking.select(key.alias("key")).distinct().orderBy("key").limit(sample).agg(F.max("key")).first()[0]
    chosen = marking.where(key <= F.lit(last).cast("long"))
    counts = chosen.select("html").mapInArrow(_count, "feature string, within long, without long").groupBy("feature").agg(F.sum("within").alias("within"), F.sum("without").alias("without"))
    # Features are made of element names; names that a page makes up are rare and need no weight.
    rows = counts.where(F.col("within") + F.col("without") >= 5).orderBy(F.desc(F.col("within") + F.col("without")), "feature").limit(5000).collect()
    inside, outside = sum(r.within for r in rows), sum(r.without for r in rows)
    weights = {}
    for r in rows:
        value = max(-LIMIT, min(LIMIT, log((r.within + 0.5) / (inside + 1)) - log((r.without + 0.5) / (outside + 1))))
        weights[r.feature] = _signed(r.feature, value)
    marks = [v for f, v in weights.items() if f.startswith("x ")]
    if marks:
        # For marks that these pages don't have.
        weights["x"] = min(marks)
    return weights


def _signed(feature: str, value: float) -> float:
    if feature.startswith("t "):
        return min(-0.05, value / 10)
    if feature.startswith("x "):
        return min(-0.1, value)
    if feature.startswith("c "):
        return value
    return max(0.1, value) if feature.endswith(" ") else value / 2


def _weight(feature: str, weights: dict[str, float]) -> float:
    """The fitted weight; else a plain one: words 1, in links 0.1, 2 less in marked-off parts, 1 more or less by article and main, tags -0.2."""
    known = weights.get(feature)
    if known is not None:
        return known
    if feature.startswith("t "):
        return -0.2
    if feature.startswith("x "):
        return weights.get("x", -2.0)
    if feature.startswith("c "):
        return 1.0 if feature == "c in" else -1.0
    return 0.1 if feature.endswith("a") else 1.0


def best_run(scores: list[float]) -> tuple[int, int] | None:
    """First and last place of the run with the greatest sum over 0, the earliest and shortest of equal ones; none without such a run."""
    best, span, run, first = 0.0, None, 0.0, 0
    for i, score in enumerate(scores):
        if run <= 0:
            run, first = 0.0, i
        run += score
        if run > best:
            best, span = run, (first, i)
    return span


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The best run of blocks by a linear scan, without marked-off blocks whose own words score no more than 0."""
    own = blocks(page or "")
    span = best_run([sum(_weight(f, weights) * k for f, k in b.features.items()) for b in own])
    if span is None:
        return ""
    chosen = (b for b in own[span[0]:span[1] + 1] if not b.mark or sum(_weight(f, weights) * k for f, k in b.features.items() if f[0] in "wx") > 0)
    return "\n".join(t for t in (b.text() for b in chosen) if t)


def _extract(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x, weights) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(page_id, url, text): the article of every page, blocks joined by a line feed; empty where there is none.

    Null html counts as empty. Repeated and null ids and urls are returned as they are; other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(weights), "page_id long, url string, text string")
