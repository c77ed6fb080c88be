"""Quality rules, decontamination, sharding, pages and WARC records."""

import base64
import dataclasses
import gzip
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest
import zstandard
from docketlake.llm import content, decontaminate, quality, sharding, warc
from docketlake.llm.html import parse
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")
PAGES = "page_id long, url string, html string, extra string"


def test_quality_counts(docs, corpus):
    def brute(text):
        words = WORD.findall(text or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines, seen, dup = (text or "").split("\n"), set(), 0
        for line in lines:
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        return len(words), sum(map(len, words)), symbols, dup, len(again), len(words) < 50 or 100 * len(again) > 50 * len(words)

    def verdict(text, knots):
        """Ratio limits by interpolation over log2 of the size, for the whole text and for each piece that ends by its place."""
        raw = (text or "").encode()
        if not raw:
            return False
        press = zstandard.ZstdCompressor(level=3)
        knots = knots or ((1.0, 0.0, np.inf),)
        within = lambda x: np.interp(np.log2(len(x)), *zip(*[k[:2] for k in knots])) <= len(press.compress(x)) / len(x) <= np.interp(np.log2(len(x)), *zip(*[(k[0], k[2]) for k in knots]))
        ends = [*range(4096, len(raw), 4096), len(raw)]
        parts = [raw[max(0, e - 4096) : e] for e in ends]
        return within(raw) and sum(not within(x) for x in parts) <= len(parts) / 4

    verdicts = set()
    for bands in (quality.Bands(), quality.Bands(((8.0, 0.3, 0.9), (12.0, 0.2, 0.7), (17.0, 0.1, 0.6))), quality.Bands(((8.0, 0.3, 0.65), (12.0, 0.3, 0.55), (17.0, 0.3, 0.5))), quality.Bands(((8.0, 0.2, 0.45), (17.0, 0.2, 0.4)))):
        rows = quality.compression_bands(docs, bands).collect()
        want = Counter((*b, not b[-1] and verdict(t, bands.knots)) for t, b in ((t, (i, *brute(t))) for i, t, *_ in corpus))
        assert Counter(tuple(r)[:8] for r in rows) == want
        verdicts |= {(r.kept, r.base_failed) for r in rows}
    assert verdicts == {(True, False), (False, False), (False, True)}


def test_pieces_cover_every_byte():
    for n in (1, 4095, 4096, 4097, 8191, 8192, 12288, 20000):
        raw = bytes(i * i % 251 for i in range(n))
        parts = quality.pieces(raw, 4096)
        assert len(parts) == -(-n // 4096) and all(len(p) == min(n, 4096) for p in parts)
        assert parts[-1] == raw[-4096:] and b"".join(parts[:-1]) == raw[: 4096 * (len(parts) - 1)]


def labelled(spark, n=2400):
    """Invented prose, good, and its bad kin: every sixth repeats its words, every sixth is noise."""
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    rows, labels = [], []
    for i in range(n):
        size, kind = rng.randint(60, 900), i % 6
        if kind == 0:
            few = rng.sample(words, 90)
            text = " ".join(rng.choice(few) for _ in range(size))
        elif kind == 1:
            text = " ".join(base64.b64encode(rng.randbytes(9)).decode() for _ in range(size))
        else:
            text = " ".join(rng.choice(words) for _ in range(size))
        rows.append((i, text))
        labels.append((i, int(kind > 1)))
    labels += [(None, 1), (5, None), (10**9, 1), (3, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_fitted_bands_decide(spark):
    """Held-out documents: bands fitted on even ids reject most bad odd ones and keep the good ones."""
    docs, labels = labelled(spark)
    bands = quality.fit_bands(docs.where("doc_id % 4 < 2"), labels)
    again = quality.fit_bands(docs.where("doc_id % 4 < 2").repartition(7), labels.repartition(3))
    assert bands == again and len(bands.knots) > 3
    held = quality.compression_bands(docs.where("doc_id % 4 >= 2"), bands).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in held if r.quality == 1], [r.kept for r in held if r.quality == 0]
    assert len(bad) > 150 and sum(bad) < 0.1 * len(bad) and sum(good) > 0.95 * len(good)
    assert quality.fit_bands(docs.where("doc_id < 0"), labels.where("doc_id < 0")) == quality.Bands()


def test_bands_fit_any_number_of_labels():
    """From no label to thousands by one rule: good texts are kept at any number, and from some dozens on junk goes."""
    rng = np.random.default_rng(4)
    sizes = (2 ** rng.uniform(8, 15, 6000)).astype(int)
    ratios = 0.9 - 0.035 * np.log2(sizes) + rng.normal(0, 0.3, 6000) / np.log2(sizes) ** 1.5
    within = lambda bands, add: np.mean([low <= r + add <= high for (low, high), r in zip(map(bands.limits, sizes.tolist()), ratios)])
    junk = []
    for n in (0, 1, 5, 71, 500, 5000):
        bands = quality.Bands(quality._knots(sizes[:n], ratios[:n], 0.005))
        assert bool(bands.knots) == (n > 0) and within(bands, 0.0) > 0.98
        junk.append(1 - within(bands, -0.05))
    assert junk[0] == 0 and min(junk[3:]) > 0.8


def test_bands_judge_the_tail():
    """Noise or repetition after clean pieces counts, whatever its length."""
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    prose = " ".join(rng.choice(words) for _ in range(4000)).encode()
    noise = base64.b64encode(rng.randbytes(9000))
    judge = quality._Judge(quality.Bands(((5.0, 0.35, 1.0), (12.0, 0.4, 0.6), (26.0, 0.2, 0.6))))
    assert judge.verdict(prose[:4096])[1:] == (0.0, True) and judge.verdict(prose[:12288])[1:] == (0.0, True)
    for tail in (4095, 3000):
        assert judge.verdict(prose[:4096] + noise[:tail])[1:] == (0.5, False)
        assert judge.verdict(prose[: 4096 + tail])[1:] == (0.0, True)
    assert not judge.verdict(noise[:300])[2] or judge.bands.limits(300)[1] > 0.75
    assert not judge.verdict(b"same words here " * 40)[2]
    assert not judge.row(None)[-1]


def test_quality_keep(docs):
    clash = docs.withColumns({"kept": F.lit("x"), "ratio": F.lit(1), "base_failed": F.lit(None).cast("string")})
    out = quality.keep_good(clash)
    assert out.schema == clash.schema
    kept = {r.doc_id for r in quality.compression_bands(docs).where("kept").collect()}
    assert {r.doc_id for r in out.collect()} == kept and kept


def brute_hits(text, items, width=10):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = fold(text), set(), set()
    for item_id, item in items:
        w = fold(item)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            p = w[i : i + width]
            for j in range(len(words) - len(p) + 1):
                if words[j : j + len(p)] == p:
                    hit |= set(range(j, j + len(p)))
                    found |= {item_id} - {None}
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, docs, corpus):
    text = {r[0]: r[1] for r in corpus}
    items = [(None, text[40]), (1, text[20]), (2, "aß x9"), (3, " ".join(text[62].split()[45:70])), (4, None), (5, ""), (6, text[21]), (7, text[21]), (8, "zq"), (9, text[30].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(docs, bench).drop("items").collect()
    named = [(None if i is None else str(i), t) for i, t in items]
    want = Counter((i, *brute_hits(t, named)) for i, t, *_ in corpus)
    assert Counter(map(tuple, rows)) == want
    assert any(r.contaminated and not r.n_items for r in rows)
    rounds = decontaminate.contamination(docs, bench, max_patterns=200).drop("items")
    assert Counter(map(tuple, rounds.collect())) == want
    clash = docs.withColumns({"items": F.lit(1), "spans": F.lit("s"), "contaminated": F.lit(2.5)})
    for most in (400_000, 200):
        clean = decontaminate.keep_clean(clash, bench, max_patterns=most)
        assert clean.dtypes == clash.dtypes
        assert Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in rows if not r.contaminated)
    assert decontaminate.contamination(docs, bench.where("item_id < 0")).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.where("doc_id < 0"), bench).count() == 0


def test_shards(docs, corpus):
    rows = sharding.kd_shards(docs).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute_shards(points, leaves, first=0):
    """(lowest, highest bytes) bounds are checked along the way: every node splits at its weighted median, exact to a row."""
    if leaves == 1 or not points:
        return {p["doc_id"]: first for p in points}
    weight = np.array([p["size"] for p in points], float)

    def spread(k):
        x = np.array([p[k] >> 53 for p in points], float)
        mean = (x * weight).sum() / weight.sum()
        return (((x - mean) ** 2 * weight).sum() / weight.sum()) ** 0.5

    key = max(sharding.DIMENSIONS, key=lambda k: (round(spread(k), 9), -sharding.DIMENSIONS.index(k)))
    points = sorted(points, key=lambda p: p[key])
    sums = np.cumsum([p["size"] for p in points])
    half = leaves // 2
    goal = sums[-1] * half / leaves
    at = int(np.searchsorted(sums, goal))
    at += bool(sums[at] - goal < goal - (sums[at - 1] if at else 0))
    return brute_shards(points[:at], half, first) | brute_shards(points[at:], leaves - half, first + half)


def test_shards_are_the_exact_tree(spark):
    """On a table small enough that every cut is found to the row, the shards are those of the recursive weighted medians."""
    rng = random.Random(5)
    rows = [(i * rng.choice((1, 40)), "y" * int(rng.paretovariate(1.2) * 30), rng.choice(("en", "en", "de", None)), "src0" if rng.random() < 0.4 else f"src{rng.randint(1, 9)}") for i in range(500)]
    table = spark.createDataFrame(list({r[0]: r for r in rows}.values()), "doc_id long, text string, lang string, source string")
    points = [r.asDict() for r in sharding.points(table).collect()]
    got = {r.doc_id: r.shard for r in sharding.kd_shards(table).collect()}
    assert got == brute_shards(points, 16)


def test_shards_of_far_ids_and_one_row(spark):
    rows = [(-(2**63), "a" * 9, 1), (2**63 - 1, "b" * 9, 2), (0, None, 3), (None, "c", 4), (5, "", 5), (5, "", 5)]
    out = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, slot int")).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows) and all(0 <= r.shard < 16 for r in out)
    assert [(r.shard, r.slot) for r in sharding.kd_shards(spark.createDataFrame([(1, "x")], "doc_id long, text string")).collect()][0][1] == 0


def test_shards_are_even(spark):
    rows = [(i, "y" * (i * 7919 % 400), "en", "src0" if i % 3 else "src1") for i in range(4000)]
    out = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in out]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 16 + 500
    by_target = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), target_bytes=100_000)
    assert by_target.select("shard").distinct().count() == -(-sum(sizes) // 100_000)
    assert sharding.kd_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


ROUGH = """<html><head><title>A &amp; B</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a><li><a href="/y">Two</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head&#233;</h1><p><b>One  two<br>three<p>Four &lt;five&gt;.<ul><li>Item one of the list here<li>Item two</ul><!-- no --></article>
<section class="comments"><p>First! A reader says something long enough to look like prose, really.</p></section><footer>&copy; Us</footer>"""


def test_html_tree():
    page = parse(ROUGH)
    texts = [b[1] for b in page.blocks]
    assert texts == ["Home", "Two", "We use cookies", "Headé", "One two three", "Four <five>.", "Item one of the list here", "Item two", "First! A reader says something long enough to look like prose, really.", "© Us"]
    assert page.links == [("/x", "Home"), ("/y", "Two")] and page.title == "A & B"
    assert parse(None).blocks == [] and parse("").blocks == [] and parse("plain <") .blocks


def test_tree_model_extracts(spark):
    rows = [(1, "u", ROUGH, "e"), (2, None, None, None), (3, "v", "", None), (1, "u", ROUGH, "e"), (None, "w", "<p>just text", None)]
    out = {(r.page_id, r.url): r for r in content.extract(spark.createDataFrame(rows, PAGES)).collect()}
    got = out[(1, "u")]
    assert got.text == "Headé\n\nOne two three\n\nFour <five>.\n\nItem one of the list here\n\nItem two" and got.n_chars == len(got.text)
    assert out[(2, None)].text == "" and out[(3, "v")].n_chars == 0
    assert content.extract(spark.createDataFrame([], PAGES)).count() == 0


def precision_recall(model, pages):
    right = wrong = missed = 0
    for (page, labels), text in zip(pages, content.main_texts([p for p, _ in pages], model)):
        got, want = set(text.split("\n\n")) - {""}, {b[1] for b, y in zip(page.blocks, labels) if y}
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    return right / (right + wrong), right / (right + missed)


def bare(page):
    """A page's tree without article or furniture elements, classes, ids and roles."""
    named = {"article", "main", "nav", "header", "footer", "aside", "section", "form", "menu", "hgroup"}
    return dataclasses.replace(page, tags=["div" if t in named else t for t in page.tags], names=["\0hidden" if "\0hidden" in n else "" for n in page.names])


@pytest.fixture(scope="module")
def marked():
    """Labelled pages of the table, by their own marks."""
    pages = [parse(x) for x in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist()]
    return [(p, y) for p in pages if (y := content.label_by_markup(p))]


@pytest.fixture(scope="module")
def model(marked):
    return content.fit(content.training_pages(marked[:100]))


def test_tree_model_held_out(model):
    """Layouts that training has not seen, as they are and with nothing that names their parts."""
    pages = content.example_pages(150, 99)
    assert min(precision_recall(model, pages)) > 0.97
    assert all(not n or "hidden" in n for p, _ in pages for n in bare(p).names)
    precision, recall = precision_recall(model, [(bare(p), y) for p, y in pages])
    assert precision > 0.94 and recall > 0.96


def test_tree_model_without_marks(model, marked):
    """Held-out pages of the table, by their own marks as truth, with and without those marks: the second the rule cannot label."""
    for change, least in ((lambda p: p, 1.0), (bare, 0.98)):
        held = [(change(p), y) for p, y in marked[100:]]
        texts = content.main_texts([p for p, _ in held], model)
        right = sum(t == "\n\n".join(b[1] for b, y in zip(p.blocks, ys) if y) for (p, ys), t in zip(held, texts))
        assert right >= least * len(held) > 50
    assert all(content.label_by_markup(bare(p)) is None for p, _ in marked)


LONG = "The council met on Monday and agreed, after a long debate, on the rules that will hold for the market from the next year on. "
PLAIN = f"""<body><div><div><a href="/">Home</a></div><div><a href="/n">News</a></div></div><div style="color:red; display: none"><p>{LONG}Hidden.</p></div><div><h1>New rules for the market</h1>
<p>{LONG}{LONG}</p><p>{LONG}One.</p><h2>What changes</h2><p>{LONG}Two.</p><ul><li>Fees fall in spring, says the council</li><li>Reports are due in May</li></ul><p>{LONG}Three.</p></div>
<div><h3>2 comments</h3><div><p>I do not think that this will work, as nobody asked us.</p></div><div><p>Well done, it was about time that they did this.</p></div></div><div>&copy; 2024 The Paper</div></body>"""


def test_tree_model_reads_plain_pages(model):
    """A page of div elements alone, written by hand: comments in prose, a hidden notice and the footer stay out."""
    text = content.main_texts([parse(PLAIN)], model)[0]
    for kept in ("New rules", "One.", "What changes", "Two.", "Fees fall", "Reports are due", "Three."):
        assert kept in text
    for left in ("Home", "Hidden", "comments", "nobody asked", "Well done", "©"):
        assert left not in text


def test_hidden_elements():
    page = parse('<div hidden>a</div><div aria-hidden="TRUE">b</div><div class="x" style="margin:0;DISPLAY:none">c</div><div hidden=until-found>d</div><div class="hidden">e</div><div style="display:nonesuch">f</div><div aria-hidden=false>g</div>')
    assert ["\0hidden" in n for n in page.names[1:]] == [True, True, True, False, False, False, False]


def test_extract_equals_enumeration(spark, model):
    """The query's text against the sum over all labellings of every page's nodes."""
    import itertools

    import numpy as np

    pages = [
        f"<div><p>{LONG}</p><p>More.</p></div>", f"<nav><a href='/'>Home</a></nav><p>{LONG}</p>", "<article>One</article><footer>Two</footer>", f"<div class=ad>{LONG}</div><p>x</p>", "<p hidden>y</p>z", "plain", "<h1>Head</h1>" + LONG, "",
    ]
    rows = [(i, f"u{i}", h) for i, h in enumerate(pages)]
    got = {r.page_id: r.text for r in content.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    for i, html in enumerate(pages):
        page = parse(html)
        parents, features = content._features(page)
        total = np.zeros((len(parents), 3))
        assert len(parents) <= 9
        for labels in itertools.product(range(3), repeat=len(parents)):
            p = model.start[labels[0]] + sum(model.step[labels[a], labels[n]] for n, a in enumerate(parents) if a >= 0)
            p += sum(t[labels[n], features[n, k]] for n in range(len(parents)) for k, t in enumerate(model.shows))
            for n, y in enumerate(labels):
                total[n, y] += np.exp(p)
        chance = (total[:, 1] / total.sum(1))[len(page.tags) :]
        assert got[i] == "\n\n".join(b[1] for b, c in zip(page.blocks, chance) if c > 0.5)


def test_marginals_are_exact():
    """Sum-product against the sum over all labellings of a small tree."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    norm = lambda x: np.log(x / x.sum(-1, keepdims=True))
    model = content.Model(norm(rng.random(3)), norm(rng.random((3, 3))), [norm(rng.random((3, n))) for n in content.SIZES])
    parents = np.array([-1, 0, 0, 1, 1, 2])
    features = np.stack([rng.integers(0, n, 6) for n in content.SIZES], 1)
    total = np.zeros((6, 3))
    for labels in itertools.product(range(3), repeat=6):
        p = model.start[labels[0]] + sum(model.step[labels[a], labels[i]] for i, a in enumerate(parents) if a >= 0) + sum(t[labels[i], features[i, k]] for i in range(6) for k, t in enumerate(model.shows))
        for i, y in enumerate(labels):
            total[i, y] += np.exp(p)
    assert np.allclose(model.marginals(parents, features), total[:, 1] / total.sum(1))


ODD = [
    ('<p>aa</p><svg class="i"/><p>Main text</p>', ["aa", "Main text"]), ("<p>a<!-->b</p>c<!--->d<!-- x --!>e", ["ab", "cde"]), ('<p title="5" tall">text one', ["text one"]), ('<a href="u>bad', ["bad"]),
    ('<p>x <math><mi>y</mi></math> z <svg viewBox="0"><title>t</title><path d="M"/></svg>w<p>q', ["x y z w", "q"]), ("<svg><g>no<p>broke</p> out", ["no", "broke", "out"]), ("<title/>aa<p>b", ["aa", "b"]),
    ('<p>k<div class="x', ["k"]), ("a < b <3 </ x>c</>d", ["a < b <3 cd"]), ("<script/>var x</script>t<script src=a />u", ["tu"]), ('<p class="a>b" id=c>k', ["k"]), ("<h1>t</h2>u", ["t", "u"]),
    ("<iframe src=x><p>no</p></iframe>yes", ["yes"]), ("<style>p{}</style>x<textarea><p>no</textarea>y", ["xy"]), ('<p a="1"b="2">m', ["m"]), ("<P>One<BR/>two</P>", ["One two"]), ("&lt;p&gt; &amp &#x41;&nbsp;b", ["<p> & A b"]),
]


def test_odd_markup():
    for html, blocks in ODD:
        assert [b[1] for b in parse(html).blocks] == blocks, html
    page = parse('<div data-class="x" class=\'menu "b"\' ID=Top ROLE="nav"><a data-href="/no" href="/q?a=1&amp;b=2">go</a>')
    assert page.names[1] == 'menu "b" top nav' and page.links == [("/q?a=1&b=2", "go")]
    for odd in ("<" * 50_000 + "<a " * 50_000 + '<p x="' * 20_000, '<p x=">" ' * 20_000, "<title>" * 20_000, "<svg>" * 20_000, "<script/>" * 2000, "<!-- " * 20_000):
        parse(odd)  # in time that grows with the page


class Blocks(HTMLParser):
    """Text by block of plain, well-formed pages, read by another parser."""

    def __init__(self):
        super().__init__()
        self.out, self.own, self.off, self.links, self.href = [], "", 0, [], None

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style")
        if tag in ("p", "div", "h1", "li", "ul", "body", "html", "article"):
            self.flush()
        if tag == "a":
            self.href = dict(attrs).get("href", "")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style")
        if tag in ("p", "div", "h1", "li", "ul", "body", "html", "article"):
            self.flush()
        if tag == "a":
            self.links.append(self.href)

    def handle_data(self, data):
        self.own += "" if self.off else data

    def flush(self):
        if self.own.split():
            self.out.append(" ".join(self.own.split()))
        self.own = ""


def test_derivatives_equal_another_parsers(spark):
    """Derivatives of responses of all kinds against records made by hand."""
    html = "<html><body><article><h1>Héad &amp; more</h1><p>One <a href='/x?a=1&amp;b=2'>two</a></p><ul><li>A</li><li>B &#233;</li></ul><script>no()</script></article></body></html>"
    head = lambda *f: b"\r\n".join([b"HTTP/1.1 200 OK", *f, b"", b""])
    raw = html.encode()
    chunked = b"".join(f"{len(raw[i:i+50]):x};q=1\r\n".encode() + raw[i : i + 50] + b"\r\n" for i in range(0, len(raw), 50)) + b"0\r\n\r\n"
    deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
    page = [
        head(b"content-type: text/html; charset=utf-8") + raw, head(b"Content-Type: text/html", b"Content-Encoding: gzip") + gzip.compress(raw),
        head(b"Content-Type: text/html", b"Content-Encoding: deflate") + zlib.compress(raw), head(b"Content-Type: text/html", b"Content-Encoding: deflate") + deflate.compress(raw) + deflate.flush(),
        head(b"Content-Type: text/html", b"Transfer-Encoding: chunked", b"Content-Encoding: gzip, identity") + (lambda z: f"{len(z):x}\r\n".encode() + z + b"\r\n0\r\n\r\n")(gzip.compress(raw)),
        head(b"Content-Type: text/html", b"Transfer-Encoding: Chunked") + chunked, head(b"Content-Type: text/html; charset=iso-8859-1") + html.encode("latin-1"), head(b"Content-Type: text/html; charset=utf-16") + html.encode("utf-16"),
        *[head(b"Content-Type: text/html; charset=" + c) + raw for c in (b"undefined", b"idna", b"no\0such", b"hex", b"\"UTF-8\"")], head(b"Content-Type: text/html", b"Content-Encoding: zstd") + zstandard.ZstdCompressor().compress(raw), raw,
    ]
    other = [(head(b"Content-Type: text/plain; charset=x-none") + b"a <b>\nc", "a <b>\nc"), (head(b"Content-Type: image/png") + b"\x89PNG", None), (head(b"Content-Type: text/html", b"Content-Encoding: br") + b"??", None), (head(b"Content-Type: text/html", b"Content-Encoding: gzip") + b"no gzip", None), (None, ""), (b"", "")]
    blocks = [(b, True) for b in page] + other
    rows = [(f"<urn:uuid:{i}>", "response", f"https://h/{i}", None, None, None, f"sha1:{i}" if i % 2 else None, None, [{"name": "WARC-IP-Address", "value": "1"}], b) for i, (b, _) in enumerate(blocks)]
    rows.append(("<urn:uuid:r>", "request", "https://h/", None, None, None, None, None, None, b"GET /"))
    got = {}
    for r in warc.derivatives(spark.createDataFrame(rows, warc.RECORD).withColumn("extra", F.lit(1))).collect():
        got[r.refers_to, r.record_type] = r
    reader = Blocks()
    reader.feed(html)
    for i, (block, text) in enumerate(blocks):
        about = got.pop((f"<urn:uuid:{i}>", "metadata"))
        meta = json.loads(bytes(about.block))
        body = (block or b"").partition(b"\r\n\r\n")[2] if (block or b"").startswith(b"HTTP") else block or b""
        assert about.payload_digest == (f"sha1:{i}" if i % 2 else warc.digest(body)) and about.headers[0].value == "1" and about.target_uri == f"https://h/{i}"
        if text is True:
            text = "\n".join(reader.out)
            assert [x["url"] for x in meta["html"]["links"]] == reader.links == ["/x?a=1&b=2"], i
        if text is None:
            assert (f"<urn:uuid:{i}>", "conversion") not in got
        else:
            plain = got.pop((f"<urn:uuid:{i}>", "conversion"))
            assert bytes(plain.block).decode() == text, i
            assert plain.block_digest == warc.digest(bytes(plain.block)) and plain.payload_digest == about.payload_digest
    assert not got


def test_repeated_http_headers_stay():
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nset-cookie: b=2\r\nX-Long: one\r\n two\r\n\r\n<p>x"
    meta = json.loads(warc.derive({"record_id": "r", "target_uri": None, "date": None, "payload_digest": None, "block_digest": None, "headers": None, "block": block})[0]["block"])
    assert meta["http"]["headers"] == [{"name": "Set-Cookie", "value": "a=1"}, {"name": "set-cookie", "value": "b=2"}, {"name": "X-Long", "value": "one two"}]


def test_records_of_other_writers():
    raw = b"0\r\nwarc-type: response\r\nWARC-TARGET-URI: http://a/\r\ncontent-length: 5\r\nX-Note: a\r\n\tb\r\n\r\nhello"
    record = warc.from_bytes(raw)
    assert (record["record_type"], record["target_uri"], record["block"], record["headers"]) == ("response", "http://a/", b"hello", [{"name": "X-Note", "value": "a b"}])
    for cut in (raw[:-2], raw[: raw.index(b"\r\n\r\n")], raw.replace(b"length: 5", b"length: x")):
        assert {"name": "WARC-Truncated", "value": "unspecified"} in warc.from_bytes(cut)["headers"]
    assert warc.from_bytes(b"") is None and warc.from_bytes(b"junk") is None


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "https://a.example/x", ROUGH, "e"), (2, None, None, None), (3, "https://b.example/é", "<p>ü", None)]
    records = warc.responses(spark.createDataFrame(rows, PAGES))
    key = lambda r: r.record_id
    odd = records.withColumn("block", F.concat("block", F.lit(b"\xff\x00\r\n\r\n\x80")))
    for compression in ("none", "gzip"):
        warc.write_warc(odd.coalesce(1), f"{tmp_path}/{compression}", compression)
        assert sorted(map(tuple, odd.collect())) == sorted(map(tuple, warc.read_warc(spark, f"{tmp_path}/{compression}/*.txt*").collect()))
    warc.write_warc(records, f"{tmp_path}/in")
    back = warc.read_warc(spark, f"{tmp_path}/in/*.txt")
    assert sorted(map(tuple, records.collect())) == sorted(map(tuple, back.collect()))
    made = sorted(warc.derivatives(back).collect(), key=key)
    assert Counter(r.record_type for r in made) == {"metadata": 3, "conversion": 3}
    source = {r.record_id: r for r in records.collect()}
    for r in made:
        origin = source[r.refers_to]
        assert r.payload_digest == origin.payload_digest and r.target_uri == origin.target_uri and r.date == origin.date and r.headers == origin.headers
        assert r.block_digest == warc.digest(bytes(r.block))
    meta = next(json.loads(bytes(r.block)) for r in made if r.record_type == "metadata" and r.target_uri.endswith("/x"))
    assert meta["html"]["links"] == [{"url": "/x", "text": "Home"}, {"url": "/y", "text": "Two"}] and meta["http"]["headers"][0]["name"] == "Content-Type"
    text = next(bytes(r.block).decode() for r in made if r.record_type == "conversion" and r.target_uri.endswith("é"))
    assert text == "ü"
    assert warc.derivatives(warc.responses(spark.createDataFrame([], PAGES))).count() == 0
