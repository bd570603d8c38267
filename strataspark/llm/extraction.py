"""Main text of web pages by tag-path ratios.

A page becomes text blocks, each with its root-to-leaf path of block tags (with
the class or id that tells siblings apart). By path, text length and
punctuation are summed and divided by the number of blocks: the two path ratios.
The ratios are fused by product, smoothed over the path tree (a path also gets a
share of what stands under each of its ancestors, less for farther ones), and
compared with a threshold from the page's own ratios; blocks of paths above it
are the content. Tags that by their meaning aren't content (navigation, header,
footer, aside, script ...) and paths that are mostly links get ratio 0. Class names are
evidence, not proof: an element that by a word of its class or id is an advert, notice
or comment counts for nothing, one of a page's layout (header, sidebar, search ...), or a form,
loses most of its ratio, and either is disregarded where the element turns
out to be a wrapper: one that holds most of the page's text, with an article, main or h1
element in it (for layout: or several blocks). Within ``article`` and ``main`` ratios weigh more and are smoothed
farther, as such an element's short blocks (headings, list items) belong to it.

Defined results: a null or empty page, or one without content, gives the empty
string and n_chars 0; unclosed and misnested tags are closed as their block
tags imply; a page that ends within a tag or script loses that tag alone; an embedded
element (svg, object ...) without an end tag is an empty one.
Repeated rows give equal results. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import text_batches

# HTML element names by their role.
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
EMBEDDED = {"noscript", "template", "svg", "math", "object", "audio", "video", "canvas", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
BOILERPLATE_TAGS = {"nav", "header", "footer", "aside", "button", "dialog", "menu", "head", "menuitem"}
FORM_TAGS = {"form", "fieldset"}
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar"}
CONTENT_TAGS = {"article", "main"}
#: Words of a class or id of what is no part of the main text, wherever it stands.
FOREIGN_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion",
    "comment", "comments", "disqus", "replies", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert",
    "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related",
    "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager",
}
#: Words of a page's layout, which wrappers of the main text also bear.
LAYOUT_WORDS = {
    "nav", "navbar", "navigation", "menu", "header", "masthead", "footer", "foot", "sidebar", "aside", "banner", "widget", "widgets",
    "toolbar", "search", "form", "reply", "respond", "copyright", "legal", "disclaimer",
}
#: With one of these, a name says something about its element's surroundings ("has-sidebar").
MODIFIERS = {"has", "no", "not", "with", "without", "enabled", "disabled", "offset", "layout"}
#: Elements of running text; within an article or main element their names don't count.
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "dd", "dt", "td", "th", "tr", "figcaption"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", "li", "dd", "dt"}
#: An opening tag of the key ends open elements of the values, up to the barrier.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
PUNCTUATION = re.compile(r"[^\w\s]")
SPACE = re.compile(r"\s+")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"<]*\"|'[^'<]*')*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
NAMED = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
WORD = re.compile(r"[a-z]+")

#: Weight of what stands under an ancestor, by each step up the path tree:
#: elsewhere, under an ancestor within the page's article or main element, and
#: under the page's root elements.
SMOOTHING, SMOOTHING_IN_CONTENT, SMOOTHING_AT_TOP = 0.6, 0.7, 0.3
#: Outside article and main, paths with a larger share of link text aren't content.
MOST_LINKS = 0.5
#: Factor of the ratios of paths within an article or main element.
CONTENT_WEIGHT = 10.0
#: Content: paths whose smoothed ratio is at least this share of the mean of the
#: page's ratios, weighted by text length.
THRESHOLD = 0.2
#: Factor of the ratios under an element of the page's layout or a form.
LAYOUT_WEIGHT = 0.1
#: A wrapper holds more than this share of the page's text, and so many blocks
#: where no article, main or h1 stands in it.
WRAPPED, WRAPPED_BLOCKS = 0.5, 3

#: What a name or tag says of an element.
PLAIN, LAYOUT, FOREIGN = 0, 1, 2


class Mark:
    """An element that its names mark: the worst of them, and what stands in it."""

    __slots__ = ("kind", "chars", "blocks", "titled")

    def __init__(self, kind: int) -> None:
        self.kind, self.chars, self.blocks, self.titled = kind, 0, 0, False

    def counts(self, chars: int) -> int:
        """``kind``, or PLAIN for a wrapper in a page of so many characters."""
        enough = self.titled or (self.kind == LAYOUT and self.blocks >= WRAPPED_BLOCKS)
        return PLAIN if enough and self.chars > WRAPPED * chars else self.kind


class Element:
    __slots__ = ("tag", "path", "boilerplate", "marks", "content")

    def __init__(self, tag: str, path: tuple[str, ...], boilerplate: bool, marks: tuple[Mark, ...], content: bool) -> None:
        self.tag, self.path, self.boilerplate, self.marks, self.content = tag, path, boilerplate, marks, content


def named_kind(names: str) -> int:
    """The worst kind that a class or id attribute's names say."""
    kind = PLAIN
    for name in names.split():
        words = set(WORD.findall(name))
        if not words & MODIFIERS:
            kind = max(kind, FOREIGN if words & FOREIGN_WORDS else LAYOUT if words & LAYOUT_WORDS else PLAIN)
    return kind


def _opened(tag: str, attributes: str, parent: Element | None) -> Element:
    name, boilerplate = tag, tag in BOILERPLATE_TAGS
    kind = LAYOUT if tag in FORM_TAGS else PLAIN
    inside = bool(parent and parent.content)
    if "=" in attributes or "hidden" in attributes:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in NAMED.finditer(attributes)}
        named = f"{found.get('class', '')} {found.get('id', '')}".lower()
        words = set(WORD.findall(named))
        if tag not in ("body", "html", "article", "main") and not (inside and tag in TEXT_TAGS):
            kind = max(kind, named_kind(named))
        boilerplate |= found.get("role", "").lower() in BOILERPLATE_ROLES
        boilerplate |= found.get("aria-hidden", "").lower() == "true" or found.get("hidden") == ""
        boilerplate |= "display:none" in found.get("style", "").replace(" ", "").lower()
        if words:
            name = f"{tag}.{' '.join(sorted(words))}"
    above, marks = (parent.path, parent.marks) if parent else ((), ())
    if tag in CONTENT_TAGS or tag == "h1":
        for m in marks:
            m.titled = True
    if kind:
        marks = (*marks, Mark(kind))
    return Element(tag, (*above, name), boilerplate or bool(parent and parent.boilerplate), marks, inside or tag in CONTENT_TAGS)


#: (path, boilerplate, marked elements around it, share of the text that is link text, text)
Block = tuple[tuple[str, ...], bool, tuple[Mark, ...], float, str]


def _foreign(tag: str, attributes: str) -> bool:
    """Whether an inline element isn't content."""
    own = _opened(tag, attributes, None)
    return own.boilerplate or any(m.kind == FOREIGN for m in own.marks)


def _end_of(tag: str, page: str, at: int) -> int | None:
    """Where the element whose start tag ends at ``at`` ends, elements of its name in it counted."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*?(/?)>", re.I).finditer(page, at):
        depth += -1 if m[1] else not m[2]
        if not depth:
            return m.end()
    return None


def blocks(page: str) -> list[Block]:
    """The page's text blocks in page order."""
    stack: list[Element] = []
    out: list[Block] = []
    pending: list[str] = []
    in_link, linked = False, 0
    root = Element("", (), False, (), False)
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal in_link, linked
        if pending:
            text = SPACE.sub(" ", "".join(pending)).strip()
            pending.clear()
            if text:
                at = stack[-1] if stack else root
                out.append((at.path, at.boilerplate, at.marks, min(1.0, linked / len(text)), text))
                if not at.boilerplate:
                    for m in at.marks:
                        m.chars += len(text)
                        m.blocks += 1
        in_link, linked = False, 0

    def close(k: int) -> None:
        flush()
        del stack[k:]

    bad_inline: list[str] = []  # open inline elements that aren't content
    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at and not bad_inline:
            raw = page[at:start]
            pending.append(entities.unescape(raw) if "&" in raw else raw)
            linked += len(pending[-1]) if in_link else 0
        if start == n:
            break
        m = TOKEN.match(page, start)
        if not m:  # a lone < is text
            if not bad_inline:
                pending.append("<")
            at = start + 1
            continue
        at = m.end()
        closing, tag, attributes, ended = m.group(1, 2, 3, 4) if m[2] else m.group(5, 6, 7, 8)
        if not tag:
            continue
        tag = tag.lower()
        if not ended:  # the page ends within the tag
            break
        if closing:
            if tag in INLINE:
                in_link &= tag != "a"
                if bad_inline and bad_inline[-1] == tag:
                    bad_inline.pop()
                continue
            if tag == "br":
                pending.append(" ")
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    bad_inline.clear()
                    close(k)
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in EMBEDDED:
            if not attributes.endswith("/") and tag not in unclosed:
                end = _end_of(tag, page, at)
                if end is None:
                    unclosed.add(tag)
                at = end or at
            continue
        if tag in VOID:
            if tag == "br":
                pending.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in INLINE:
            in_link |= tag == "a"
            if bad_inline:
                if bad_inline[-1] == tag:
                    bad_inline.append(tag)
            elif "=" in attributes and not attributes.endswith("/") and tag != "label" and _foreign(tag, attributes):
                bad_inline.append(tag)
            continue
        bad_inline.clear()
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in ("table", "td", "th", "button", "li", "div", "section", "article"):
                    break
        if tag in ENDS:
            own, barrier = ENDS[tag]
            lowest = None
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in barrier:
                    break
                if stack[k].tag in own:
                    lowest = k
            if lowest is not None:
                close(lowest)
        flush()
        if not attributes.endswith("/"):
            stack.append(_opened(tag, attributes, stack[-1] if stack else None))
    flush()
    return out


#: A path, and the worst kind of the marked elements around it that count.
Place = tuple[tuple[str, ...], int]


def placed(found: list[Block]) -> list[Place]:
    """The place of each block; FOREIGN for boilerplate."""
    chars = sum(len(text) for _, boilerplate, _, _, text in found if not boilerplate)
    kinds = [FOREIGN if b else max((m.counts(chars) for m in marks), default=PLAIN) for _, b, marks, _, _ in found]
    return [(block[0], kind) for block, kind in zip(found, kinds, strict=True)]


def path_ratios(found: list[Block], places: list[Place]) -> tuple[dict[Place, float], float]:
    """Smoothed ratio of each place that isn't FOREIGN, and the page's threshold."""
    length: dict[Place, int] = defaultdict(int)
    marks: dict[Place, int] = defaultdict(int)
    nodes: dict[Place, int] = defaultdict(int)
    links: dict[Place, float] = defaultdict(float)
    for place, (_, _, _, linked, text) in zip(places, found, strict=True):
        if place[1] != FOREIGN:
            length[place] += len(text)
            links[place] += linked * len(text)
            marks[place] += len(PUNCTUATION.findall(text))
            nodes[place] += 1
    inside = {p: next((k for k, x in enumerate(p[0]) if x.split(".")[0] in CONTENT_TAGS), len(p[0])) for p in length}
    fused = {
        p: length[p] / nodes[p] * (1 + marks[p] / nodes[p]) * (CONTENT_WEIGHT if inside[p] < len(p[0]) else 1.0)
        for p in length
    }
    plain = [p for p in fused if p[1] == PLAIN]
    # what stands under each node of the path tree, weighted by text length
    under: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0.0, 0.0])
    for p in plain:
        for depth in range(len(p[0])):
            cell = under[p[0][:depth]]
            cell[0] += fused[p] * length[p]
            cell[1] += length[p]
    smoothed = {}
    for p, r in fused.items():
        path = p[0]
        if p[1] == LAYOUT:
            smoothed[p] = r * LAYOUT_WEIGHT if plain else 0.0
            continue
        best, weight = r, 1.0
        if inside[p] == len(path) and links[p] > MOST_LINKS * length[p]:
            smoothed[p] = 0.0
            continue
        for up in range(1, len(path) + 1):
            weight *= SMOOTHING_IN_CONTENT if inside[p] < len(path) - up else SMOOTHING if len(path) - up > 2 else SMOOTHING_AT_TOP
            total, chars = under[path[: len(path) - up]]
            best = max(best, weight * total / chars)
        smoothed[p] = best
    mean = sum(fused[p] * length[p] for p in plain) / max(1, sum(length[p] for p in plain))
    return smoothed, THRESHOLD * mean


def main_text(page: str | None) -> str:
    """The page's content blocks, joined by a newline."""
    found = blocks(page or "")
    places = placed(found)
    ratios, least = path_ratios(found, places)
    return "\n".join(block[4] for p, block in zip(places, found, strict=True) if ratios.get(p, 0.0) >= max(least, 1e-9))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars of every page: a scan without a shuffle."""
    text_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([main_text(page) for page in batch], dtype=object)

    found = pages.select(*keep, run("html").alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
