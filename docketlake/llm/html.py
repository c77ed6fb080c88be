"""One pass over a page: its tree of block elements, and the text blocks in page order."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

#: Elements that start and end a block of text, those that end an open one of their kind, and those skipped.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul video audio".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody", "thead"},
}
FENCES = frozenset("ul ol dl table select body div article section main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Attributes as browsers read them: a name, then perhaps a value; a quote that is never closed is part of a name.
_ATTRIBUTES = r"""(?>[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?>"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?)?|=)*+"""
#: Drawings end where they are closed or where a text element breaks out of them.
_SVG = r"<svg\b[^>]*(?<!/)>(?:(?!<(?:p|div|h[1-6]|ul|ol|li|dl|table|pre|blockquote|body|section|article|main|aside|nav|footer|header)\b).)*?</svg\s*>"
_OPEN = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"


@lru_cache
def _token(svg: bool, title: bool, attributes: str) -> re.Pattern:
    """Tokens: groups are a raw element's name, a title's text, then of a tag its slash, name and attributes, or text."""
    parts = [
        r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*(?:>|\Z))", *[_SVG] * svg,
        rf"<(script|style|template|textarea|iframe|noembed|noframes|annotation)\b{_OPEN}(?:>.*?</\1\b[^>]*>|(?<=/)>|>.*\Z)",
        r"<title\b[^>]*>((?:(?!</title).)*)</title\b[^>]*>" if title else r"<title\b[^>]*>()",
        rf"<(/?)([a-zA-Z][^\s/>]*+)({attributes})>", r"([^<]+|<)",
    ]
    return re.compile("|".join(parts), re.S | re.I)


def _tokens(html: str) -> Iterator[re.Match]:
    """Tokens of a page but for a tag that its end cuts off. Where many tags have no end outside quotes, quotes stop counting."""
    low = html.lower()
    flags = "</svg" in low, "</title" in low
    last = html.rfind(">") + 1
    cut = re.compile("<[a-zA-Z/!?]").search(html, last)
    end, failed, pos = cut.start() if cut else len(html), 0, 0
    for m in _token(*flags, _ATTRIBUTES).finditer(html, 0, end):
        if m.lastindex == 6 and m[6] == "<" and m.end() < last and html[m.end()].isalpha():
            failed += 1
            if failed > 50:
                pos = m.start()
                break
        yield m
    else:
        return
    yield from _token(*flags, "[^>]*").finditer(html, pos, end)


_ATTRIBUTE = re.compile(r"""=?([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")


def attributes(text: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name, values with their character references decoded; the first of a name counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


#: Stands in an element's names where its attributes hide it.
HIDDEN = "\0hidden"
_UNSEEN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)(?![\w-])", re.I)


def _is_hidden(own: dict[str, str]) -> bool:
    return "hidden" in own and own["hidden"].lower() != "until-found" or own.get("aria-hidden", "").strip().lower() == "true" or bool(_UNSEEN.search(own.get("style", "")))


@dataclass
class Page:
    """Elements 0, 1, ... (0 is the page) with tag, parent and words of class, id and role; blocks (element, text, link chars)."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    names: list[str] = field(default_factory=lambda: [""])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)
    links: list[tuple[str, str]] = field(default_factory=list)
    title: str = ""


def parse(html: str | None) -> Page:
    """The page's tree; null is an empty page.

    Tag soup is read as browsers do in the common cases: unclosed p, li, td and inline tags, stray end tags, comments of
    every form, quotes that stand wrong in tags. Scripts, styles, templates, text areas, frames, drawings (svg) and title
    are no text; formulas (math) are. A tag cut off by the end of the page is dropped.
    """
    page, stack, text = Page(), [0], []
    linked, href, anchor = 0, None, []

    def flush() -> None:
        nonlocal linked
        if text:
            if joined := " ".join("".join(text).split()):
                page.blocks.append((stack[-1], joined, linked))
            text.clear()
        linked = 0

    def pop_to(tags: set[str], fences: frozenset[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = page.tags[stack[depth]]
            if tag in tags:
                del stack[depth:]
                return
            if tag in fences:
                return

    for m in _tokens(html or ""):
        kind = m.lastindex
        if kind == 6:
            piece = unescape(m[6])
            text.append(piece)
            if href is not None:
                linked += len(piece.strip())
                anchor.append(piece)
        elif kind == 5:
            tag, closing = m[4].lower(), m[3]
            if tag == "a":
                if href is not None:
                    page.links.append((href, " ".join("".join(anchor).split())))
                    anchor.clear()
                href = None if closing else attributes(m[5]).get("href")
            elif tag in BLOCKS:
                flush()
                if closing:
                    pop_to(HEADINGS if tag in HEADINGS else {tag}, frozenset())
                    continue
                if tag != "p" and page.tags[stack[-1]] == "p" or tag == "p":
                    pop_to({"p"}, FENCES)
                if tag in CLOSES:
                    pop_to(CLOSES[tag], FENCES)
                page.tags.append(tag)
                page.parents.append(stack[-1])
                own = attributes(m[5]) if "=" in m[5] or "hidden" in m[5].lower() else {}
                names = " ".join(own[n] for n in ("class", "id", "role") if n in own).lower().replace(HIDDEN, " ")
                page.names.append(names + HIDDEN if _is_hidden(own) else names)
                if tag != "hr":
                    stack.append(len(page.tags) - 1)
            elif tag == "br":
                text.append(" ")
        elif kind == 2 and not page.title:
            page.title = " ".join(unescape(re.sub(r"<[^>]*>", "", m[2])).split())
    flush()
    if href is not None:
        page.links.append((href, " ".join("".join(anchor).split())))
    return page
