"""Main text of web pages by a tree-structured graphical model.

Every block element and every text block of a page is a node with a hidden label: furniture, content, or a mixture (an
element that holds both). A node's label depends on its parent's, and it shows features: its tag after its parent's tag,
the words of its class, its length and share of links after the parent's tag, and, for pages whose tags and classes say
nothing, its share of the page's text, its place in it, whether it opens with words like "3 comments", and whether
siblings have its shape. The tables of the model are counted on labelled pages. For a page, messages go up from the text blocks to the page and down again, which gives each node's
exact marginal; the text blocks that are more likely content than not are the main text.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .html import HIDDEN, Page, parse

#: Words of class, id and role that mark page furniture, and those that mark an article.
FURNITURE = frozenset(
    "ad ads adv advert advertisement advertising alert banner breadcrumb breadcrumbs byline-share comment comments consent contentinfo cookie cookies copyright "
    "dialog discussion disqus feedback follow footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice "
    "outbrain pager pagination popup privacy promo promoted promotion reader recommended related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe taboola tags toolbar topbar widget widgets".split()
)
ARTICLE = frozenset("article body content entry main post prose story text".split())
#: Words in English, French, German and Spanish that open or make up comments, notices, adverts and footers.
CUES = (
    "comment", "comments", "commentaires", "kommentare", "comentarios", "reply", "replies", "responses", "discussion", "related", "recommended", "more from", "read next", "à lire aussi",
    "lesen sie auch", "relacionados", "share this", "partager", "teilen", "compartir", "advertisement", "sponsored", "publicité", "anzeige", "publicidad", "cookie", "cookies", "privacy policy",
    "datenschutz", "newsletter", "subscribe", "sign up", "log in", "sign in", "s'abonner", "abonnieren", "suscríbete", "copyright", "all rights reserved", "tous droits réservés", "alle rechte vorbehalten",
)
GROUPS = {
    "article": "main", "main": "main", "nav": "furniture", "header": "furniture", "footer": "furniture", "aside": "furniture", "form": "furniture",
    "button": "furniture", "select": "furniture", "option": "furniture", "label": "furniture", "fieldset": "furniture", "legend": "furniture",
    "menu": "furniture", "dialog": "furniture", "head": "furniture", "noscript": "furniture", "iframe": "furniture", "html": "root", "body": "root", "#page": "root", "p": "p", "pre": "p",
    "blockquote": "p", "ul": "list", "ol": "list", "dl": "list", "li": "item", "dd": "item", "dt": "item",
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "#text": "text",
}
TAG_VALUES = ("main", "furniture", "root", "p", "list", "item", "heading", "text", "other")
NAME_VALUES = ("none", "furniture", "article", "hidden")
_WORDS = re.compile(r"[a-z]+")
_CUE = re.compile(rf"©|\b(?:{'|'.join(CUES)})\b")
CUE_CHARS = 160  # longer blocks are prose, whatever words they hold
SHARES = (0.0, 0.02, 0.05, 0.1, 0.2, 0.5)
PLACES = (0.02, 0.1, 0.3, 0.7, 0.9, 0.98)


def _name_group(names: str) -> int:
    if HIDDEN in names:
        return 3
    words = set(_WORDS.findall(names))
    return 1 if words & FURNITURE else 2 if words & ARTICLE else 0


def _shapes(page: Page) -> list[int]:
    """Of every element: 2 if an element before or after it has its tag and its children's tags, 1 if only its tag, else 0."""
    below: list[list[int]] = [[] for _ in page.tags]
    for i in range(1, len(page.tags)):
        below[page.parents[i]].append(i)
    shape = [(t, *(page.tags[c] for c in own[:4])) for t, own in zip(page.tags, below)]
    out = [0] * len(page.tags)
    for own in below:
        for a, b in zip(own, own[1:]):
            if page.tags[a] == page.tags[b]:
                alike = 2 if shape[a] == shape[b] and len(shape[a]) > 1 else 1
                out[a], out[b] = max(out[a], alike), max(out[b], alike)
    return out


def _features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """(parents, features): elements first, then text blocks; features are tag, name, length, link share, share of text, place, cue, shape.

    Tag, length and links are read after the parent's tag, so what the markup forces (a list holds items) counts for nothing.
    """
    n, m = len(page.tags), len(page.blocks)
    kinds = [TAG_VALUES.index(GROUPS.get(t, "other")) for t in page.tags]
    above = np.array([b[0] for b in page.blocks], np.int64)
    parents = np.concatenate((np.array(page.parents, np.int64), above))
    sizes = np.array([len(b[1]) for b in page.blocks], np.int64)
    linked = np.array([b[2] for b in page.blocks], np.int64)
    ends = np.cumsum(sizes)
    whole = max(int(ends[-1]), 1) if m else 1
    held, first, opens = np.zeros(n + m, np.int64), np.full(n + m, whole), np.full(n + m, m)
    held[n:], first[n:], opens[n:] = sizes, ends - sizes, np.arange(m)
    np.add.at(held, above, sizes)
    np.minimum.at(first, above, first[n:])
    np.minimum.at(opens, above, opens[n:])
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        held[p] += held[i]
        first[p], opens[p] = min(first[p], first[i]), min(opens[p], opens[i])
    cues = np.array([size <= CUE_CHARS and bool(_CUE.search(b[1].lower())) for size, b in zip(sizes.tolist(), page.blocks)] + [False])
    features = np.zeros((n + m, len(SIZES)), np.int64)
    features[:n, 0], features[n:, 0] = kinds, TAG_VALUES.index("text")
    features[:n, 1] = [_name_group(w) if w else 0 for w in page.names]
    features[n:, 2] = 1 + (sizes > 25) + (sizes > 80) + (sizes > 250)
    features[n:, 3] = np.where(linked == 0, 0, 1 + (3 * linked >= sizes) + (3 * linked >= 2 * sizes))
    side = np.where(np.arange(n + m) < n, 0, 1)
    place = np.where(held == 0, 0, np.searchsorted(PLACES, (first + held / 2) / whole))
    features[:, 4] = (np.searchsorted(SHARES, held / whole) * (len(PLACES) + 1) + place) * 2 + side
    leaf = np.isin(features[:, 0], [TAG_VALUES.index(t) for t in ("p", "item", "heading")])
    features[:, 5] = cues[opens] + 2 * np.where(side == 1, 2, leaf)
    features[:n, 6], features[n:, 6] = _shapes(page), 3
    over = features[np.maximum(parents, 0), 0]
    for i, values in ((0, len(TAG_VALUES)), (2, 5), (3, 4)):
        features[:, i] += values * over
    return parents, features


LABELS = 3
SIZES = (len(TAG_VALUES) ** 2, len(NAME_VALUES), 5 * len(TAG_VALUES), 4 * len(TAG_VALUES), 2 * (len(SHARES) + 1) * (len(PLACES) + 1), 6, 4)


@dataclass
class Model:
    """Log tables: ``start`` of the root, ``step`` [parent label, child label], and one [label, value] for each feature."""

    start: np.ndarray
    step: np.ndarray
    shows: list[np.ndarray]

    def marginals(self, parents: np.ndarray, features: np.ndarray) -> np.ndarray:
        """P(content) of every node of a forest; a parent stands before its children, and roots have parent -1."""
        return np.exp(self.beliefs(parents, _levels(parents), features)[0][:, 1])

    def beliefs(self, parents: np.ndarray, levels: list[np.ndarray], features: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(log P of each node's labels, expected number of each parent's and child's labels, if ``pairs``).

        Messages go up from the last level to the first, then down.
        """
        up = sum(table[:, features[:, i]] for i, table in enumerate(self.shows))
        sent = np.zeros_like(up)
        for level in reversed(levels[1:]):
            sent[:, level] = _log_sum(up[:, level][None] + self.step[:, :, None], 1)
            for y in range(LABELS):
                up[y] += np.bincount(parents[level], sent[y, level], len(parents))
        belief = up.copy()
        belief[:, levels[0]] += self.start[:, None]
        both = np.zeros_like(self.step)
        for level in levels[1:]:
            above = (belief[:, parents[level]] - sent[:, level])[:, None] + self.step[:, :, None]
            belief[:, level] = up[:, level] + _log_sum(above, 0)
            if pairs:
                joint = above + up[:, level][None]
                joint = np.exp(joint - joint.max(axis=(0, 1)))
                both += (joint / joint.sum(axis=(0, 1))).sum(2)
        return (belief - _log_sum(belief, 0)).T, both


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """log of the sum of exp along an axis."""
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


def _levels(parents: np.ndarray) -> list[np.ndarray]:
    """The nodes of a forest by their depth, roots first."""
    order = np.argsort(parents, kind="stable")
    first = np.searchsorted(parents[order], np.arange(len(parents) + 1))
    levels = [np.nonzero(parents < 0)[0]]
    while len(level := levels[-1]):
        n = first[level + 1] - first[level]
        levels.append(order[np.repeat(first[level] - np.cumsum(n) + n, n) + np.arange(n.sum())])
    return levels[:-1]


def _labels(page: Page, labels: list[bool], parents: np.ndarray) -> np.ndarray:
    """Labels of all nodes: an element is content (1) where at least half the text blocks below it are, furniture (0) where none is, else a mixture (2)."""
    n = len(page.tags)
    good, bad = np.zeros(len(parents), np.int64), np.zeros(len(parents), np.int64)
    good[n:], bad[n:] = np.array(labels, np.int64), ~np.array(labels, bool)
    for i in range(len(parents) - 1, 0, -1):
        good[parents[i]] += good[i]
        bad[parents[i]] += bad[i]
    label = np.where(good == 0, 0, np.where(good >= bad, 1, 2))
    label[:n][[t in ("#page", "html", "body") for t in page.tags]] = 2
    return label


def fit(pages: list[tuple[Page, list[bool]]], smooth: float = 0.5, rounds: int = 40, weight: float = 1.0) -> Model:
    """Fit the tables to labelled pages: (page, a label for each of its text blocks).

    They are counted first. As the features of a node tell much the same, counts alone make it too sure, so ``rounds`` steps along
    the gradient of the labels' likelihood follow: labels seen less labels expected by the messages, kept near the counts by ``weight``.
    """
    parts = [_features(page) for page, _ in pages]
    label = np.concatenate([_labels(page, own, parents) for (page, own), (parents, _) in zip(pages, parts)])
    parents, features = _joined(parts)
    roots, lower = parents < 0, parents >= 0
    start, step = np.full(LABELS, smooth), np.full((LABELS, LABELS), smooth)
    np.add.at(start, label[roots], 1)
    np.add.at(step, (label[parents[lower]], label[lower]), 1)
    shows = [np.full((LABELS, n), smooth) for n in SIZES]
    for i, table in enumerate(shows):
        np.add.at(table, (label, features[:, i]), 1)
    counted = [np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), *(np.log(t / t.sum(1, keepdims=True)) for t in shows)]
    seen = [t - smooth for t in (step, *shows)]
    tables, pace, before = [t.copy() for t in counted], [np.full(t.shape, 0.1) for t in counted[1:]], [np.zeros(t.shape) for t in counted[1:]]
    levels = _levels(parents)
    for _ in range(rounds):
        belief, pairs = Model(tables[0], tables[1], tables[2:]).beliefs(parents, levels, features, True)
        chance = np.exp(belief)
        told = [np.stack([np.bincount(features[:, i], chance[:, y], n) for y in range(LABELS)]) for i, n in enumerate(SIZES)]
        for k, expected in enumerate((pairs, *told)):
            slope = seen[k] - expected - weight * (tables[k + 1] - counted[k + 1])
            pace[k] = np.clip(pace[k] * np.where(slope * before[k] > 0, 1.2, np.where(slope * before[k] < 0, 0.5, 1.0)), 1e-4, 0.5)
            tables[k + 1] += np.sign(slope) * pace[k]
            before[k] = slope
    return Model(tables[0], tables[1], tables[2:])


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Trees (parents, features) side by side, as one forest."""
    sizes = np.array([len(p) for p, _ in parts])
    shift = np.cumsum(sizes) - sizes
    return np.concatenate([np.where(p < 0, p, p + s) for (p, _), s in zip(parts, shift)]), np.concatenate([f for _, f in parts])


def label_by_markup(page: Page) -> list[bool] | None:
    """Labels from a page that names its own article: text inside article or main, outside marked furniture; else None."""
    inside = [False] * len(page.tags)
    for i in range(1, len(page.tags)):
        group = GROUPS.get(page.tags[i], "other")
        inside[i] = (inside[page.parents[i]] or group == "main") and group != "furniture" and _name_group(page.names[i]) in (0, 2)
    labels = [inside[b[0]] for b in page.blocks]
    return labels if any(labels) else None


def example_pages(n: int = 240, seed: int = 7) -> list[tuple[Page, list[bool]]]:
    """Labelled layouts written by rule: every layout mixes furniture around and inside an article that it knows."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 9))) for _ in range(2000)]

    def prose(low: int, high: int) -> str:
        return " ".join(rng.choices(words, k=rng.randint(low, high))).capitalize() + rng.choice((".", ".", ".", "!", ""))

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{prose(1, 3)}</a></li>' for i in range(k)) + "</ul>"

    def some(*kinds: str) -> str:
        return "".join(k for k in kinds if rng.random() < 0.5)

    def heading(*words: str) -> str:
        return rng.choice(words) if rng.random() < 0.6 else prose(1, 3)

    def readers(k: int) -> str:
        made = rng.choice(("<div{}><p>{}</p></div>", "<div{}><div>{}</div><p>{}</p></div>", "<li{}><p>{}</p></li>", "<p{}>{}</p>"))
        return "".join(made.format(' class="comment"', *([prose(1, 2)] if made.count("{}") == 3 else []), prose(4, 40)) for _ in range(k))

    out = []
    for _ in range(n):
        body = f"<h1>{prose(3, 9)}</h1>" + "".join(
            rng.choice((f"<p>{prose(5, 80)}</p>", f"<p>{prose(1, 6)}</p>", f"<p>{prose(20, 120)} <a href='/x'>{prose(1, 2)}</a> {prose(3, 9)}</p>", f"<h2>{prose(1, 6)}</h2>", f"<blockquote>{prose(5, 30)}</blockquote>", "<ul>" + "".join(f"<li>{prose(2, 24)}</li>" for _ in range(rng.randint(1, 6))) + "</ul>", f"<div>{prose(8, 60)}</div>"))
            for _ in range(rng.randint(2, 14))
        )
        if rng.random() < 0.2:  # an article may say what furniture says
            body += f"<p>{rng.choice(CUES).capitalize()}{rng.choice(('.', ' ' + prose(1, 12)))}</p>"
        comments = f'<section class="comments"><h3>{heading("Comments", "3 comments", "Discussion", "Replies", "Commentaires", "Kommentare", "Comentarios")}</h3>' + readers(rng.randint(1, 5)) + "</section>"
        advert = f'<div class="ad">{heading("Advertisement", "Sponsored", "Anzeige")} {prose(3, 30)}</div>' if rng.random() < 0.3 else f'<div class="ad">{prose(3, 30)}</div>'
        inner = some(f'<div class="share">{links(3)}</div>', f'<aside class="related">{heading("Related", "Read next")} {links(3)}</aside>', advert, f'<form class="newsletter"><label>{heading("Subscribe to our newsletter", "Sign up")}</label><button>{prose(1, 2)}</button></form>')
        cookies = f'<div class="cookie-notice"><p>{prose(5, 20)} {heading("cookies", "privacy policy")} {prose(0, 9)}</p><button>{prose(1, 1)}</button></div>'
        unseen = f'<div {rng.choice(("hidden", "aria-hidden=true", "style=display:none"))}><p>{prose(5, 60)}</p></div>' if rng.random() < 0.3 else ""
        before = some(f"<header>{prose(1, 4)}</header>", f"<nav>{links(rng.randint(3, 8))}</nav>", f'<div class="menu">{links(4)}</div>', cookies, unseen, f'<div class="ad">{prose(3, 30)}</div>', f'<div class="breadcrumb">{links(2)}</div>')
        after = some(comments, f'<div id="sidebar"><h3>{prose(1, 3)}</h3><p>{prose(5, 40)}</p>{links(4)}</div>', f"<aside><p>{prose(5, 40)}</p></aside>", f'<div class="sponsored">{prose(4, 30)}</div>', f"<form><p>{prose(3, 9)}</p></form>", unseen)
        after += rng.choice((f"<footer>{prose(3, 20)}</footer>", f'<div class="footer">{prose(3, 20)} {links(3)}</div>', f'<div class="footer"><p>&copy; {prose(2, 9)}</p></div>'))
        left, right = rng.choice((("<article>", "</article>"), ("<main>", "</main>"), ('<main><article class="post">', "</article></main>"), ('<div class="content">', "</div>"), ('<div id="article-body">', "</div>"), ('<section class="entry-content">', "</section>")))
        # \x01 and \x02 fence the article, \x03 and \x04 the furniture inside it
        page = parse(f"<html><body>{before}{left}\x01{body}\x03{inner}\x04\x02{right}{after}</body></html>")
        labels, blocks, state = [], [], [False, False]
        for node, text, linked in page.blocks:
            for mark, place, value in (("\x01", 0, True), ("\x02", 0, False), ("\x03", 1, True), ("\x04", 1, False)):
                if mark in text:
                    state[place] = value
            if text := text.translate({1: None, 2: None, 3: None, 4: None}).strip():
                blocks.append((node, text, linked))
                labels.append(state[0] and not state[1])
        page.blocks = blocks
        out.append((page, labels))
    return out


#: Elements that name the parts of a page.
NAMING = frozenset("article main nav header footer aside section form menu hgroup".split())


def unnamed(page: Page) -> Page:
    """The page as if written with div elements alone, without classes, ids and roles; what is hidden stays so."""
    names = [HIDDEN if HIDDEN in x else "" for x in page.names]
    return replace(page, tags=["div" if t in NAMING else t for t in page.tags], names=names)


def training_pages(marked: list[tuple[Page, list[bool]]], layouts: int = 300) -> list[tuple[Page, list[bool]]]:
    """Labelled pages to fit on: layouts written by rule and ``marked`` pages, each as it stands and unnamed."""
    own = example_pages(layouts) + marked
    return own + [(unnamed(page), labels) for page, labels in own]


def train(pages: DataFrame, sample: int = 400, page_bytes: int = 1 << 18) -> Model:
    """Fit on layouts written by rule and on at most ``sample`` different pages that name their own article in markup, with and without names.

    Pages of more than ``page_bytes`` teach nothing, so what the driver takes is bounded. The sample is the pages of the smallest hashes of their html, so it does not depend on how the table is dealt out.
    The hashes alone find its limit; then one page of each hash up to it is fetched.
    """
    hashed = pages.where(F.octet_length("html") <= page_bytes).select("html", F.xxhash64("html").alias("h"))
    limit = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = hashed.where(F.col("h") <= limit).groupBy("h").agg(F.first("html").alias("html")).orderBy("h").select("html").collect() if limit is not None else []
    marked = [(page, labels) for page in (parse(r[0]) for r in rows) if (labels := label_by_markup(page))]
    return fit(training_pages(marked))


def extract(pages: DataFrame, model: Model | None = None, threshold: float = 0.5, sample: int = 400) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    The text is the blocks whose marginal exceeds ``threshold``, in page order, joined by a blank line. Null and empty
    html, and pages without content blocks, give an empty text; repeated rows each give a row; an empty table gives none;
    null page_id or url stay null; further columns are ignored. What an element's attributes hide is furniture. Without ``model`` one is trained (see ``train``).
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train(pages, sample))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parsed = [parse(h) for h in batch.column("html").to_pylist()]
        texts = main_texts(parsed, shared.value, threshold)
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(slim, run, "page_id long, url string, text string, n_chars long")


def main_texts(parsed: list[Page], model: Model, threshold: float = 0.5) -> list[str]:
    """The main text of each page; all pages go through the model together."""
    parts = [_features(p) for p in parsed]
    chance = model.marginals(*_joined(parts))
    sizes = np.array([len(p) for p, _ in parts])
    shift = np.cumsum(sizes) - sizes
    out = []
    for page, s, n in zip(parsed, shift.tolist(), sizes.tolist()):
        own = chance[s + len(page.tags) : s + n] > threshold
        out.append("\n\n".join(b[1] for b, keep in zip(page.blocks, own) if keep))
    return out
