"""Operators on small invented rows: what SQL over the driver tables does not reach."""

import json
import random
import re
from datetime import datetime

import pytest
from docketlake.functions import classify as C
from docketlake.functions import urls as U
from docketlake.operators import catalog as K
from docketlake.operators import graph as G
from docketlake.operators import harvest as H
from docketlake.operators import rank as R
from docketlake.operators import retrieval as Q
from docketlake.operators import routing as T
from docketlake.operators import scan as W
from docketlake.operators import search as SE
from docketlake.operators.storage import numbered
from docketlake.sources import io as S
from docketlake.streaming import jobs as J
from pyspark.sql import functions as F


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("href", "want"), [
    ("../c/./d", "https://h.example/c/d"), ("?q=2", "https://h.example/a/b?q=2"), ("//o.example/x", "https://o.example/x"), ("", "https://h.example/a/b?q=1"),
    ("z", "https://h.example/a/z"), ("../../../up/", "https://h.example/up/"), ("mailto:a@b", "mailto:a@b"), ("/r/../s", "https://h.example/s"),
])
def test_resolve(spark, href, want):
    assert one(spark, U.resolve_url(F.col("b"), F.col("h")), b="https://h.example/a/b?q=1", h=href) == want


@pytest.mark.parametrize(("url", "profile", "want"), [
    ("HTTP://WWW.Ex.example:80//a///b;s=1?utm_source=x&b=2&fbclid=9#f", "pipeline", "http://www.ex.example/a/b?b=2"),
    ("https://ex.example", "crawl", "https://ex.example/"), ("https://ex.example/a?mc_cid=1&xgclid=2", "crawl", "https://ex.example/a?xgclid=2"),
    (" https://Ex.example/A/?gclid=1#x ", "key", "https://ex.example/a"),
])
def test_normalize(spark, url, profile, want):
    assert one(spark, U.normalize_url(F.col("u"), profile), u=url) == want


def test_hosts_and_names(spark):
    assert one(spark, U.host_of(F.col("u")), u="https://user@www.A.example:8080/x y") == "a.example"
    assert one(spark, U.host_of(F.col("u")), u=None) == ""
    assert one(spark, U.host_suffixes(F.col("h")), h="a.b.c") == ["a.b.c", "b.c"]
    long = one(spark, U.safe_filename(F.col("u"), F.lit("T")), u="https://h.example/" + "x" * 200 + ".pdf")
    assert len(long) == 100 + 1 + 16 + 4 and long.endswith(".pdf")
    assert one(spark, U.safe_filename(F.col("u"), F.lit("My title!")), u="https://h.example/download.pdf") == "My_title.pdf"


@pytest.mark.parametrize(("raw", "unit", "want"), [
    ("US - New York", "", ("US", "State", "New York")), ("Canada – Federal", "", ("Canada", "Federal", "Federal")), ("ontario", "", ("Canada", "State", "ontario")),
    ("", "", ("", "Federal", "Federal")), ("Canada", "Ontario", ("Canada", "State", "Ontario")), ("usa", "federal", ("US", "Federal", "Federal")), ("Brazil - X", "", ("Brazil - X", "Federal", "Federal")),
])
def test_jurisdictions(spark, raw, unit, want):
    assert tuple(one(spark, C.parse_jurisdiction(F.col("r"), F.col("u")), r=raw, u=unit)) == want


def test_scores(spark):
    score = lambda **v: one(spark, C.regulatory_score(F.col("u"), F.col("t"), F.col("f"), F.lit(None)), **v)
    assert score(u="https://h.example/laws/BankingControlLaw.pdf", t="Banking Control Law", f="BankingControlLaw.pdf") == 80
    assert score(u="https://h.example/news/patriot.pdf", t="", f="") == -100
    assert score(u=None, t=None, f=None) == 0
    assert one(spark, C.route_question(F.col("q")), q="Who are you?") == "identity"


def test_prefer_subset_and_todo(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, j string")
    assert [r.k for r in K.prefer_subset(rows, F.col("j") == "b").collect()] == [2]
    assert K.prefer_subset(rows, F.col("j") == "z").count() == 2


H1, H2 = "https://h.example", "https://o.example"
LINKS = [(f"{H1}/s", f"{H1}/news/1"), (f"{H1}/s", f"{H1}/laws/1"), (f"{H1}/s", f"{H1}/x"), (f"{H1}/x", f"{H1}/y"), (f"{H1}/y", f"{H1}/s"), (f"{H1}/x", f"{H2}/a"), (f"{H2}/a", f"{H2}/b"), (f"{H2}/a", f"{H1}/x"), (f"{H2}/b", f"{H2}/laws/c")]


def test_crawl_sites_depth_and_focus(spark):
    edges = spark.createDataFrame(LINKS, "src string, dst string")
    seeds = spark.createDataFrame([("one", f"{H1}/s"), ("two", f"{H2}/a")], "seed string, url string")
    reach = lambda **k: {(r.seed, r.url.split("example")[1]): r.depth for r in G.crawl(edges, seeds, **k).collect()}
    assert reach() == {("one", "/s"): 0, ("one", "/news/1"): 1, ("one", "/laws/1"): 1, ("one", "/x"): 1, ("one", "/y"): 2, ("two", "/a"): 0, ("two", "/b"): 1, ("two", "/laws/c"): 2}
    assert ("one", "/a") in reach(same_site=False) and ("two", "/x") in reach(same_site=False)
    assert ("one", "/news/1") not in reach(focused=True)
    assert max(reach(max_depth=1).values()) == 1 and len(reach(max_depth=1)) == 6 and len(reach(max_depth=0)) == 2
    assert set(reach(max_pages=2)) == {("one", "/s"), ("one", "/laws/1"), ("two", "/a"), ("two", "/b")}
    assert reach(max_pages=1) == reach(max_depth=0) and reach(max_pages=0) == {}


def crawled(links, seeds, per_round):
    """The same crawl in plain loops."""
    def rank(u):
        return (not ("/laws/" in u), 0 if "news" in u else 1, u)

    out = {}
    for seed, (start, budget) in seeds.items():
        queue, seen, host = {start: 0}, {}, start.split("/")[2]
        while queue:
            ranked = sorted(queue, key=rank)[: per_round or len(queue)]
            now = ranked[: len(ranked) if budget is None else max(0, budget - len(seen))]
            if not now:
                break
            found = {}
            for u in now:
                seen[u] = queue.pop(u)
            for a, b in links:
                if a in now and b.split("/")[2] == host and b not in seen and b not in queue:
                    found[b] = min(found.get(b, 1 << 30), seen[a] + 1)
            queue |= found
        out |= {(seed, u): d for u, d in seen.items()}
    return out


@pytest.mark.parametrize("per_round", (None, 1, 3))
def test_budgets_hold_for_every_seed(spark, per_round):
    page = lambda i: f"https://s{i % 3}.example/{('laws', 'news', 'z')[i // 3 % 3]}/{i}"
    links = sorted({(page(i), page((i * k + k) % 90)) for i in range(90) for k in (2, 3, 4, 7)})
    seeds = {f"seed{i}": (page(i), None if i % 5 == 0 else i % 7) for i in range(0, 30, 2)}
    table = spark.createDataFrame([(s, u, b) for s, (u, b) in seeds.items()], "seed string, url string, max_pages int")
    got = {(r.seed, r.url): r.depth for r in G.crawl(spark.createDataFrame(links, "src string, dst string"), table, per_round=per_round).collect()}
    assert got == crawled(links, seeds, per_round)
    assert max(b for _, b in seeds.values() if b) >= max(sum(k[0] == s for k in got) for s, (_, b) in seeds.items() if b is not None)


def test_snapshots_of_one_id_keep_their_links(spark):
    pages = [(1, "https://a.example/p", '<a href="/one">One</a>'), (1, "https://b.example/p", '<a href="/two">Two</a>')]
    edges = G.link_edges(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {(r.src, r.dst) for r in edges} == {("https://a.example/p", "https://a.example/one"), ("https://b.example/p", "https://b.example/two")}


def test_scans_over_ranges_of_three_rows(spark):
    """One source with most rows, in many ranges, equals plain loops."""
    rng = random.Random(6)
    rows = [(("hot", "a", None)[0 if rng.random() < 0.8 else i % 3], i, rng.choice((0, 0, 0, 2)), rng.random() < 0.7, int(i > 60 and rng.random() < 0.1), rng.choice("xy"), rng.choice((200, 200, 500))) for i in range(120)]
    table = spark.createDataFrame(rows, "source string, k long, links int, bad boolean, found int, content_hash string, http_status int").withColumn("item_count", F.col("links"))
    streaks, stops, changes = [], [], []
    for source in ("hot", "a", None):
        own = [r for r in rows if r[0] == source]
        run, fails, seen, found, before, stopped = [], 0, 0, 0, None, False
        for _, k, links, bad, doc, page, status in own:
            if links:
                run = []
            else:
                run.append(k)
                if len(run) >= 3:
                    streaks = [s for s in streaks if s[:2] != (source, run[0])] + [(source, run[0], k, len(run))]
            fails, seen, found = (fails + 1) * bad, seen + 1, found + doc
            if fails >= 4 and not found and seen >= 6 and not stopped:
                stops, stopped = [*stops, (source, k)], True
            if status < 400:
                if links == 0 and before not in (None, page):
                    changes.append((source, k, page))
                before = page
    order = lambda rows: sorted(map(str, rows))
    for parts in (1, 40, 120):
        assert order(tuple(r) for r in W.empty_streaks(table, "source", "k", "links", 3, parts).collect()) == order(streaks)
        assert order(tuple(r) for r in W.failed_runs(table, "source", "k", "bad", "found", 4, 6, parts).collect()) == order(stops)
        assert order(tuple(r) for r in W.page_changes(table, parts).collect()) == order(changes)
    assert len(streaks) > 5 and stops and len(changes) > 5
    assert W.ranges(table, "source", "k", 40).where("source = 'hot'").select("_part").distinct().count() > 25


def test_updates_of_one_key_merge_in_turn(spark):
    old = spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "k int, x string, y string")
    new = spark.createDataFrame([(1, 1, "n1", None), (1, 2, None, "n2"), (1, 3, "n3", None), (3, 1, None, "z")], "k int, seq int, x string, y string")
    once = K.upsert(old, new, "k", "seq")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, K.upsert(once, new, "k", "seq").collect())) == [(1, "n3", "n2"), (2, "c", None), (3, None, "z")]


def test_artifacts_merge_row_by_row(spark):
    old = spark.createDataFrame([("u1", "Other", "site", 1), ("u2", "P - a", "", 2), ("u4", None, None, 4)], "url string, jurisdiction string, source_kind string, at long")
    new = [("u1", "P - b", "", 1, False), ("u1", "Q", "q", 2, False), ("u1", "P - b", "k3", 3, False), ("u1", "P - c", "k4", 4, False), ("u2", "P - a", "same", 5, None), ("u3", "first", "f", 6, False), ("u3", "P - z", "", 7, False), ("u3", "P - y", "dry", 8, True), ("u4", "P - d", "", 9, False), ("", "P - e", "x", 10, False)]
    out = R.merge_artifacts_into(old, spark.createDataFrame(new, "url string, jurisdiction string, source_kind string, at long, dry_run boolean"), "P - ")
    assert sorted(map(tuple, out.collect())) == [("u1", "P - c", "k4", "relabelled"), ("u2", "P - a", "", "kept"), ("u3", "P - z", "f", "added"), ("u4", "P - d", "ministry", "relabelled")]


def test_labels_name_authorities_in_four_forms(spark):
    docs = [(1, "", "Saudi Arabia - MC"), (2, "", "saudi arabia - mc and more"), (3, "", "MC"), (4, "", "Desk - A - mc"), (5, "", "Saudi Arabia - MCx"), (6, "x.mc.example", None), (7, "", "xMC"), (8, "", "Saudi Arabia - A b c"), (9, "mc.example", "MC")]
    owners = spark.createDataFrame([("MC", "mc.example"), ("A b", ""), ("nobody", "no.example")], "code string, host string")
    out = R.authority_documents(owners, spark.createDataFrame(docs, "k int, host string, jurisdiction string"), "Saudi Arabia", 4)
    assert sorted(map(tuple, out.collect())) == [("A b", 1, "8"), ("MC", 6, "1,2,3,4"), ("nobody", 0, "")]


def test_streaks_and_numbers(spark):
    visits = spark.createDataFrame([("a", i, 0 if 3 <= i < 13 else 1) for i in range(20)], "s string, i int, n int")
    assert [tuple(r) for r in W.empty_streaks(visits, "s", "i", "n").collect()] == [("a", 3, 12, 10)]
    out = numbered(spark.range(100).withColumn("k", -F.col("id")), "n", F.col("k")).collect()
    assert all(r.n == 100 - r.id for r in out)


def chunks_of(text: str, size: int = 900) -> list[str]:
    out, rest = [], text
    while rest:
        cut = len(rest) if len(rest) <= size else max((rest.rfind(c, 0, size + 1) for c in " "), default=-1)
        if len(rest) > size and cut < 0.4 * size:
            cut = rest.rfind("\n", 0, size + 1)
            cut = size if cut < 0.4 * size else cut
        out.append(rest[:cut])
        rest = rest[cut:].lstrip()
    return out


def test_chunks(spark):
    """Cuts equal a plain loop over texts of words, lines, long runs without either, long blanks, and one of 5 MB; all in the JVM."""
    rng = random.Random(5)
    make = lambda n, blanks: "".join("x" * rng.randint(1, 90 if blanks else 2000) + rng.choice(blanks or "\n") for _ in range(n))
    texts = [None, "", " ", "a", "x" * 900, "x" * 901, "x" * 900 + " y", "x" * 899 + " y z", " " * 2000 + "é" * 1000, "x" * 359 + " " + "y" * 900, "x" * 360 + " " + "y" * 900]
    texts += ["a b" + " " * n + "c" * 950 for n in (890, 900, 901, 1800, 5000)] + [make(n, b) for n in (5, 60, 300) for b in (" ", "\n", " \n\t\u00a0", "")] + ["\U0001f600 é" * 700]
    texts.append(make(110_000, " \n"))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    got = Q.chunk_text(docs)
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    found = {}
    for r in got.orderBy("id", "n").collect():
        found.setdefault(r.id, []).append(r.chunk)
    assert found == {i: chunks_of(t) for i, t in enumerate(texts) if t}
    assert len(found[len(texts) - 1]) > 5000


def test_json_leaves(spark):
    """Values and not keys, escapes read, any depth; bodies that are no JSON have none."""
    body = {
        "https://key.example/a": "plain", "a": [["https://v.example/x?a=1&b=2", {"b": [" /api/v1 "]}], "/docs/A.PDF", "x.pdf", "/one", "/one/two", "/s/t.PNG", "/s/t.json"],
        "q": 'say \\ "/quoted/path"', "Url": "/nav/1", "link": ["/nav/in/list"], "href": "mailto:x", "path": "httpx", "n": 3, "e": "",
    }
    text = json.dumps(body).replace("&", "\\u0026").replace("/docs", "\\/docs").replace('"Url"', '"\\u0055rl"')
    deep = "[" * 60 + '"/deep/er"' + "]" * 60
    rows = [(1, text), (2, "[" + text), (3, None), (4, ""), (5, '"https://bare.example/"'), (6, deep), (7, '{"url":"/nav/2","x":{"url":null,"path":"/nav/2"}}')]
    df = spark.createDataFrame(rows, "id long, body string")
    got = sorted((r.id, r.url) for r in H.json_urls(df).collect())
    want = [(1, x) for x in ("https://v.example/x?a=1&b=2", "/api/v1", "/docs/A.PDF", "/one/two", "/nav/in/list", "/nav/1")]
    assert got == sorted([*want, (5, "https://bare.example/"), (6, "/deep/er"), (7, "/nav/2")])
    assert sorted((r.id, r.url) for r in H.nav_urls(df).collect()) == [(1, "/nav/1"), (1, "httpx"), (7, "/nav/2")]


def test_extractive_summary_of_blank_text(spark):
    rows = Q.extractive_summaries(spark.createDataFrame([(1, "T", " "), (2, "T", "short")], "id long, title string, text string")).collect()
    assert {r.id: (r.method, r.key_points) for r in rows} == {1: ("empty", []), 2: ("extractive", ["short"])}


def test_anchor_edge_cases(spark):
    html = '<a href="JavaScript:x()">no</a><a class=q href=\'/a#f\'>A <b>b</b>\n c</a><a href="/a">twice</a><a href="mailto:x">m</a>'
    rows = H.anchors(spark.createDataFrame([(1, "https://h.example/p/", html), (2, None, None)], "page_id long, url string, html string")).collect()
    assert [(r.url, r.text) for r in rows] == [("https://h.example/a", "A b c")]


def test_json_and_text_sources(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"id": "1", "summary": " "}, {"id": "2", "summary": "s"}]))
    rows = S.read_json_table(spark, f"{tmp_path}/t.json", "id string, summary string").collect()
    assert {(r.id, r.summary) for r in rows} == {("1", None), ("2", "s")}
    assert S.read_json_table(spark, f"{tmp_path}/none.json", "id string").count() == 0
    lines = [{"id": "a", "summary": "old", "summarized_at": "1"}, {"id": "a", "summary": "new", "summarized_at": "2"}, {"id": "b", "summary": " ", "summarized_at": "1"}]
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n{broken\n")
    assert [r.summary for r in S.read_jsonl_latest(spark, f"{tmp_path}/l.jsonl", "id string, summary string, summarized_at string").collect()] == ["new"]
    (tmp_path / "s.txt").write_text("# c\nhttps://a.example\nUK | https://b.example\nFR | gazette | https://c.example\n\n")
    got = sorted(map(tuple, S.read_source_list(spark, f"{tmp_path}/s.txt").collect()))
    assert got == [("AdHoc", "custom", "https://a.example"), ("FR", "gazette", "https://c.example"), ("UK", "custom", "https://b.example")]
    (tmp_path / "s.json").write_text(json.dumps({"urls": ["https://a.example", {"url": "https://b.example", "kind": "x"}, {"jurisdiction": "none"}]}))
    assert sorted(map(tuple, S.read_source_list(spark, f"{tmp_path}/s.json").collect())) == [("AdHoc", "custom", "https://a.example"), ("AdHoc", "x", "https://b.example")]


def test_sheets(spark):
    grid = spark.createDataFrame([(0, "Region", "URL", "Topic\n1", "Topic 2", ""), (1, " EU ", "https://a.example", "x", None, "3.0"), (2, None, " ", None, None, None)], "row int, c0 string, c1 string, c2 string, c3 string, c4 string")
    rows = S.records_from_sheet(grid)
    assert rows.columns == ["row", "Region", "URL", "Topic 1", "Topic 2", "col_5"]
    assert [tuple(r) for r in rows.collect()] == [(1, "EU", "https://a.example", "x", None, "3")]
    twice = spark.createDataFrame([(0, "Title", "Title", "Title_x", "Title", "")], "row int, c0 string, c1 string, c2 string, c3 string, c4 string")
    assert S.records_from_sheet(twice).columns == ["row", "Title", "Title_2", "Title_x", "Title_3", "col_5"]
    primary = spark.createDataFrame([("EU", "https://a.example", "", "x", "y"), ("EU", "https://b.example - Not working", "page", "", None), ("EU", "", "link NOT working", None, ""), ("EU", None, None, None, "z")], "`Region` string, `Website links` string, `Nature of weblink` string, `Topic 1` string, `Sub Category` string")
    assert [(r.topics, r.status, r.source_kind) for r in S.seed_sources(primary).collect()] == [(["x", "y"], "active", "primary"), ([], "broken", "primary"), ([], "broken", "primary"), (["z"], "missing_url", "primary")]
    assert S.seed_by_position(rows, ["region", "url"]).columns == ["region", "url"]
    log = S.seed_tracking(spark.createDataFrame([("a", "2024", ""), ("b", "", "open")], "`Law Area` string, `Publication date` string, `Alert Status` string"))
    assert [(r.law_area, r.date_of_publication, r.alert_status, r.link) for r in log.collect()] == [("a", "2024", "new", None), ("b", None, "open", None)]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, title string")
    S.write_tables(df, f"{tmp_path}/a", f"{tmp_path}/b")
    S.append_jsonl(df, f"{tmp_path}/a")
    assert spark.read.json(f"{tmp_path}/a").count() == 4 and spark.read.json(f"{tmp_path}/b").count() == 2
    S.write_csv_index(df, f"{tmp_path}/c", ["title", "id"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["title", "id"]
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/x.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "d/e/y.bin").write_bytes(b"no")
    assert {(r.bytes, r.is_pdf) for r in S.scan_binary_documents(spark, f"{tmp_path}/d").collect()} == {(6, True), (2, False)}
    (tmp_path / "j/k").mkdir(parents=True)
    (tmp_path / "j/1.json").write_text(json.dumps([{"url": "u1"}]))
    (tmp_path / "j/k/2.json").write_text(json.dumps({"downloads": [{"url": "u2"}]}))
    assert {r.url for r in S.merge_artifacts(spark, f"{tmp_path}/j", "url string").collect()} == {"u1", "u2"}
    assert S.first_non_empty(df.where("id = '9'"), df).count() == 2


def test_stream_changes_equal_the_batch(spark, tmp_path):
    rows = [("s", 1, 200, "h1", ["a", "b"]), ("s", 2, 500, "h9", ["z"]), ("s", 3, 200, "h2", []), ("s", 4, 200, "h3", ["b", "c"]), ("t", 1, 200, "g", [])]
    schema = "source string, seq long, http_status int, content_hash string, items array<string>"
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = J.detect_changes(stream, remember=2).writeStream.format("memory").queryName("changes").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("changes").collect())) == [("s", "a", "new"), ("s", "b", "new"), ("s", "c", "new"), ("s", "h2", "changed")]


def test_change_state_goes_on_from_its_checkpoint(spark, tmp_path):
    """Three batches, the last one in a second run: nothing is told twice, the state is read from the checkpoint."""
    schema = "source string, seq long, http_status int, content_hash string, items array<string>, ts timestamp"
    day = lambda n: datetime(2024, 1, n)
    parts = [
        [("s", 2, 200, "h2", ["b"], day(2)), ("s", 1, 200, "h1", ["a"], day(1)), ("t", 1, 404, "g", ["x"], day(1))],
        [("s", 4, 200, "h4", [], day(4)), ("s", 3, 200, "h3", ["a", "c"], day(3)), ("s", 5, None, "h", ["q"], day(5))],
        [("s", 6, 503, "h9", ["z"], day(6)), ("s", 7, 200, "h4", None, None), ("s", 8, 200, "h5", [], day(8)), ("t", 2, 200, "g", [], day(2))],
    ]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    told = []
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{n}")
        if n:
            J.resume_batches(J.detect_changes(stream), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
            told.append(sorted((r.source, r.item, r.kind) for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert told[0] == [("s", "a", "new"), ("s", "b", "new"), ("s", "c", "new"), ("s", "h4", "changed")]
    assert told[1] == sorted([*told[0], ("s", "h5", "changed")])
    state = {r.source: (r.urls, r.page_hash, r.last_seq, r.last_ok) for r in J.change_state(spark, f"{tmp_path}/c").collect()}
    assert state == {"s": (["b", "a", "c"], "h5", 8, day(8)), "t": ([], "g", 2, day(2))}


def test_silence_is_told_once(spark, tmp_path):
    """A silence ended within a batch, one that a timer tells and a later row ends, and one at the end."""
    at = lambda n: datetime(2024, 1, n)
    parts = [[("a", at(5)), ("a", at(1)), ("b", at(1)), ("n", None)], [("b", at(8)), ("a", at(6))], [("a", at(9)), ("b", at(20))], [("b", at(21))]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("source string, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for n, part in enumerate(parts):
        spark.createDataFrame(part, "source string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/p{n}")
        J.resume_batches(J.silent_sources(stream, "3 days"), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    rows = sorted((r.source, r.since) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert rows == [("a", at(1)), ("a", at(9)), ("b", at(1)), ("b", at(8))]


def test_stream_health_and_publish(spark, tmp_path):
    rows = [("a", "ok", "2024-01-01 01:00:00", 1), ("a", "error", "2024-01-01 02:00:00", 2), ("a", "ok", "2024-01-05 00:00:00", 3)]
    spark.createDataFrame(rows, "source string, status string, at string, k long").withColumn("ts", F.col("at").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("source string, status string, at string, k long, ts timestamp").parquet(f"{tmp_path}/in")
    query = J.run_health(stream).writeStream.format("memory").queryName("health").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.n, r.ok) for r in spark.table("health").collect()] == [(2, 1)]
    for _ in range(2):
        J.publish(stream.select("source", "k"), f"{tmp_path}/out", f"{tmp_path}/c2", "source", "k", 5).awaitTermination()
    assert [(r.source, r.k) for r in J.current(spark, f"{tmp_path}/out").collect()] == [("a", 3)]
    status = stream.select("k", "status", F.col("source").alias("url"))
    for _ in range(2):
        J.live_status(status, f"{tmp_path}/live", f"{tmp_path}/c3", None, recent=2).awaitTermination()
    now = [tuple(r) for r in J.current(spark, f"{tmp_path}/live").select("part", "status", "n", "last", "url").collect()]
    assert sorted(now, key=str) == sorted([("total", "ok", 2, 3, None), ("total", "error", 1, 2, None), ("recent", "ok", 1, 3, "a"), ("recent", "error", 1, 2, "a")], key=str)
    more = spark.createDataFrame([("b", "ok", "x", 9)], "source string, status string, at string, k long").withColumn("ts", F.lit(None).cast("timestamp"))
    more.write.mode("append").parquet(f"{tmp_path}/in")
    J.live_status(status, f"{tmp_path}/live", f"{tmp_path}/c3", None, recent=2).awaitTermination()
    assert {(r.part, r.status, r.n, r["last"]) for r in J.current(spark, f"{tmp_path}/live").collect()} == {("total", "ok", 3, 9), ("total", "error", 1, 2), ("recent", "ok", 1, 9), ("recent", "ok", 1, 3)}


def test_versions_show_only_when_whole(spark, tmp_path):
    """A batch that dies between its data and its commit leaves the version before in sight, and its next run replaces it; old versions go."""
    path = f"{tmp_path}/table"
    rows = lambda n: spark.range(n).select(F.col("id").alias("k"))
    assert J.current(spark, path) is None
    J.commit(rows(1), path, 0)
    rows(2).write.parquet(f"{path}/version=1")
    assert J.current(spark, path).count() == 1 and J.committed(spark, path) == [0]
    J.commit(rows(3), path, 1)
    J.commit(rows(3), path, 1)
    assert J.current(spark, path).count() == 3 and J.current(spark, path, before=1).count() == 1
    for n in (2, 3, 4):
        J.commit(rows(n), path, n)
    assert J.committed(spark, path) == [2, 3, 4] and {p.name for p in (tmp_path / "table").iterdir() if p.is_dir()} == {"_commits", "version=2", "version=3", "version=4"}


def test_names_collide_within_a_folder(spark):
    rows = [(1, "uk", "a.pdf"), (2, "fr", "a.pdf"), (3, "uk", "a.pdf"), (4, "uk", "A.pdf"), (5, None, "b"), (6, None, "b")]
    out = R.disambiguate(spark.createDataFrame(rows, "k int, place string, name string"), "name", ["place"], "k", F.col("k").cast("string"))
    assert [r.name for r in out.orderBy("k").collect()] == ["a.pdf", "a.pdf", "a_3.pdf", "A.pdf", "b", "b_6.pdf"]


def test_searches_look_through_filled_fields(spark):
    rows = spark.createDataFrame([(1, "Title", "", ["Tag one", "two"], "UK"), (2, "", None, [], "tags")], "k int, title string, filename string, filename_tags array<string>, jurisdiction string")
    ids = lambda **how: [r.k for r in K.filter_pdfs(rows, **how).orderBy("k").collect()]
    assert ids(text="title uk tag") == [1] and ids(text=" TAG") == [1, 2] and ids(text="one two") == [1] and ids(text="") == [1, 2] and ids(jurisdiction="UK", text="two") == [1] and ids(text="none") == []


@pytest.mark.parametrize("rarest", [1, 8])
def test_index_finds_what_a_scan_finds(spark, tmp_path, rarest):
    """Every part of up to six characters of some rows, and parts that no row has, however few strings pick the candidates."""
    rows = [(1, "Bank Act", "2019", ["Tax", None]), (2, None, None, None), (3, "bank  notes é\U0001f600z", "", []), (4, "aaaa", "a", ["aa"]), (5, "BANK ACT", "2019", ["tax"]), (6, "100%_[x](y)", "\\n", ["q"]), (None, "Bank Act", "x", None)]
    table = spark.createDataFrame(rows, "id int, text string, part string, gram array<string>")
    fields = ["text", "part", "gram"]
    SE.write_index(table, "id", fields, f"{tmp_path}/index", buckets=3)
    held = {r.id: r.b for r in table.where("id is not null").select("id", K.blob(table, fields).alias("b")).collect()}
    asked = sorted({t[i : i + n] for t in held.values() for i in range(len(t)) for n in (1, 2, 3, 6)} | {"bank act 2020", "zz", "q ", "%", "AaA", " Bank "})
    found = SE.search(spark, f"{tmp_path}/index", spark.createDataFrame(list(enumerate([*asked, "", None])), "qid int, text string"), rarest)
    want = {(q, i) for q, t in enumerate(asked) for i, b in held.items() if t.strip(" ") and t.strip(" ").lower() in b}
    got = [(r.qid, r.id) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_todo_puts_local_files_first(spark):
    rows = [("a", "UK", "f/a", ""), ("b", "Saudi Arabia", None, "https://b"), ("c", None, "f/c", None), ("d", "Saudi Arabia", "f/gone", ""), ("e", "Saudi Arabia", "f/e", ""), ("f", "UK", None, ""), (None, "UK", "f/a", ""), ("g", "UK", "f/a", "")]
    catalog = spark.createDataFrame(rows, "id string, jurisdiction string, local_path string, url string")
    todo = K.todo_summaries(catalog, catalog.where("id = 'g'"), None, 10, spark.createDataFrame([("f/a",), ("f/c",), ("f/e",), ("f/e",)], "path string"))
    assert [(r.id, r.rank) for r in todo.collect()] == [("e", 0), ("a", 1), ("c", 1), ("b", 2), ("d", 2)]


def test_crawl_reports_of_odd_sources(spark):
    """A source without documents tells its first error, one whose pages stop giving links that, and nulls and an empty run hold."""
    visits = spark.createDataFrame([("a", 2, True, 0, "late"), ("a", 1, False, 0, "early"), *[("b", i, False, 0, None) for i in range(8)], ("c", 1, False, 0, "x")], "source string, seq int, js boolean, links int, error string")
    documents = spark.createDataFrame([("c", True, False), ("d", False, False), ("d", True, True)], "source string, regulatory boolean, downloaded boolean")
    rows = {r.source: tuple(r)[2:] for r in R.crawl_reports(visits, documents).collect()}
    assert rows == {"a": (2, 1, 2, 0, 0, 0, 0, "early"), "b": (8, 0, 0, 0, 0, 0, 0, "possible_rate_limit"), "c": (1, 0, 1, 1, 1, 0, 0, None), "d": (0, 0, 0, 2, 1, 1, 1, None), None: (11, 1, 3, 3, 2, 1, 1, None)}
    empty = R.crawl_reports(visits.limit(0), documents.limit(0)).collect()
    assert [tuple(r) for r in empty] == [("total", None, 0, 0, 0, 0, 0, 0, 0, None)]


def test_blocked_and_rejected(spark):
    cases = [(200, "Just a moment... checking your browser", True), (200, "An article on forbidden cloudflare sites", False), (200, "403 Forbidden", True), (429, None, True), (503, "", True), (404, "x", False), (None, "CAPTCHA", True), (200, "x" * 4000 + "captcha", False)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, status int, body string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", H.looks_blocked(F.col("status"), F.col("body")).alias("got")).collect())
    pages = [(200, "Request Rejected. The support ID is: 7", True), (200, "<html>rejected</html>", True), (404, "<html>rejected</html>", False), (200, "y" * 400 + "Request Rejected", False), (None, None, False)]
    rows = spark.createDataFrame(pages, "status int, body string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", H.is_rejected(F.col("status"), F.col("body")).alias("got")).collect())


def test_news_items_take_the_first_accepted_text(spark):
    html = '<a href="/n">More</a><a href=/n#x>Press release on the gazette</a><a href="/n">Another bulletin of it</a><a href="/2024/x">Plain page title</a><a href="/o">Contact us</a><a href="/z">A title without any word</a>'
    rows = H.news_items(spark.createDataFrame([(1, "https://h.example/", html), (2, "https://h.example/", None)], "page_id long, url string, html string")).orderBy("rank").collect()
    assert [(r.url, r.text, r.score) for r in rows] == [("https://h.example/n", "Press release on the gazette", 3), ("https://h.example/2024/x", "Plain page title", 0)]


def test_site_rules(spark):
    page = lambda html: spark.createDataFrame([(html,)], "h string")
    marks = [("x _API/web y", True), ("x _vti_bin/z", False), ("/_layouts/15/a", True), ("/_layouts/14/a", False), (None, False), ("x" * 12000 + "sharepoint", False)]
    for html, want in marks:
        assert page(html).select(H.looks_sharepoint(F.col("h")).alias("x")).first().x == want
    body = "User-agent: *\r\n   Disallow: /private\nDISALLOW: /no\ndisallow: /no\nDisallow:\nDisallow: /a b"
    assert {r.prefix for r in H.robots_rules(spark.createDataFrame([("h", body)], "host string, body string")).collect()} == {"/private", "/a"}
    found = H.sitemap(spark.createDataFrame([(1, "see https://a.example/x and <loc> https://a.example/f.pdf </loc>\n Sitemap: https://a.example/list"), (2, None)], "id int, body string"))
    assert {(r.url, r.kind) for r in found.collect()} == {("https://a.example/x", "page"), ("https://a.example/f.pdf", "document"), ("https://a.example/list", "sitemap")}
    shells = [(None, True, True), ("x" * 1600, False, True), ('<p id="__nuxt">' + "x" * 2000, True, False), ("<p ng-version=1>" + "<a >" * 4 + "x" * 2000, False, True), ("Request Rejected " + "<p ng-version=1>" + "x" * 2000, True, False), ("x" * 8100 + "<a >" * 2, True, False)]
    for html, site, pipeline in shells:
        got = page(html).select(H.looks_like_shell(F.col("h")).alias("a"), H.looks_like_shell(F.col("h"), F.lit(None).cast("string"), "pipeline").alias("b")).first()
        assert (got.a, got.b) == (site, pipeline), html


def test_decoding(spark):
    cases = [(b"caf\xc3\xa9", "TXT", "café"), (b"\x93q\x94", "TXT", "“q”"), (b"\x93\x81", "CSV", "\x93\x81"), (b"{\\rtf1\\b x\x93\x81}", "RTF", "{  x“}"), (b"<a>x\xff</a>", "ODT", " x "), (None, "TXT", None), (b"", "TXT", "")]
    rows = spark.createDataFrame(cases, "body binary, kind string, want string")
    for r in rows.select("want", H.decode_text(F.col("body"), F.col("kind")).alias("got")).collect():
        assert r.got == r.want


@pytest.mark.parametrize(("question", "want"), [
    ("Are there any new data to index?", "status"), ("what is EVA", "status"), ("who are you", "identity"), ("show\nthose files", "list"), ("give me the list", "list"), ("how many rules\nand how many PDFs", "status"),
    ("what penalties apply in Delhi", "content"), ("hi", "identity"), ("", "content"), (None, "content"), ("do you read", "status"),
])
def test_routing(spark, question, want):
    assert one(spark, C.route_question(F.col("q")), q=question) == want


def test_coverage_expects_what_each_row_has(spark):
    gazette = spark.createDataFrame([("A", "u", None), ("B", "u", "u"), ("C", " ", None), ("D", None, "u"), (None, None, None)], "jurisdiction string, parliamentary_bills string, official_gazette string")
    docs = [("A", "parliamentary_bills", 2020)] * 3 + [("B", "official_gazette", 2019)] * 4 + [("D", "official_gazette", None)] * 2 + [("", "site", 2021)] * 3
    rows = R.coverage(gazette, spark.createDataFrame(docs, "jurisdiction string, source_kind string, year int").withColumn("law_type", F.lit("act"))).collect()
    assert {r.jurisdiction: (r.n, r.expected, r.missing, r.years, r.state) for r in rows} == {
        "A": (3, ["parliamentary_bills"], [], [2020], "ok"), "B": (4, ["parliamentary_bills", "official_gazette"], ["parliamentary_bills"], [2019], "partial"), "C": (0, [], [], [], "zero"),
        "D": (2, ["official_gazette"], [], [], "partial"), "Unknown": (3, [], [], [2021], "ok"),
    }


def test_retrieval_finds_words_inside_words(spark):
    corpus = spark.createDataFrame([(1, "Cybersecurity", "UK", "none"), (2, "Other", "France", "about biosecurities"), (3, "No", "Francesia", "x"), (4, None, None, None), (5, "why not; ask!!", "", "")], "id long, title string, jurisdiction string, summary string")
    asked = spark.createDataFrame([(1, "security"), (2, "france"), (3, "why not; ask"), (4, "?"), (5, None)], "qid long, question string")
    got = {(r.qid, r.id): r.score for r in Q.retrieve(asked, corpus).collect()}
    assert got == {(1, 1): 2 + 6, (2, 2): 3, (2, 3): 2, (3, 5): 16}


@pytest.mark.parametrize(("block", "k"), ((512, 8), (3, 2)))
def test_retrieval_equals_scoring_every_pair(spark, block, k):
    """Blocks of questions, ties by id, common tokens, words inside words, string ids, nulls."""
    rng = random.Random(block)
    words = ["act", "actor", "factory", "banking", "bank", "bill7", "law", "ab", "the", "قانون", "قانوني", "data", "database", "tax", "taxes"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(f"d{i:03}", text(rng.randint(0, 4)), rng.choice(words), text(rng.randint(0, 12))) for i in range(150)] + [("x1", None, None, None), ("x2", "BANKING act", "", "")]
    asked = [(i, text(rng.randint(0, 5))) for i in range(14)] + [(90, "banking act"), (91, None), (92, docs[3][1] or "law")]
    tok = lambda x: {t for t in re.findall(r"[a-z0-9]{3,}|[\u0600-\u06ff]{2,}", (x or "").lower()) if t not in Q.STOP}
    want = []
    for qid, question in asked:
        raw, scored = (question or "").strip().lower(), []
        for i, *fields in docs:
            title, place, summary = ((f or "").lower() for f in fields)
            every = tok(f"{title} {place} {summary}")
            score = 6 * (len(raw) >= 6 and raw[:40] in title)
            for t in tok(question):
                score += (t in every) + 4 * (t in tok(title)) + 2 * (t in place) + (len(t) >= 4) * (2 * (t in title) + (t in summary))
            scored.append((-score, i))
        best = -min(scored)[0]
        floor = max(1, 0.35 * best) if best >= 6 else 1
        want += [(qid, i, -n, r + 1) for r, (n, i) in enumerate(sorted(scored)[:k]) if -n >= floor]
    got = Q.retrieve(spark.createDataFrame(asked, "qid int, question string"), spark.createDataFrame(docs, "id string, title string, jurisdiction string, summary string").repartition(5), k, block)
    assert sorted((r.qid, r.id, r.score, r.rank) for r in got.collect()) == sorted(want)


def test_answers_use_points_and_passages(spark):
    corpus = spark.createDataFrame([(1, "T1", "u1", "S1", ["a", "b", "c"]), (2, "T2", "u2", "S" * 300, [])], "id long, title string, url string, summary string, key_points array<string>")
    hits = spark.createDataFrame([(1, 1, 1, "P" * 300), (1, 2, 2, None)], "qid long, id long, rank int, passage string")
    rows = {r.qid: r for r in Q.answers(spark.createDataFrame([(1, "q"), (2, "r")], "qid long, question string"), hits, corpus).collect()}
    assert rows[1].answer == "Answer:\n• [1] a\n• [1] b\n  “" + "P" * 280 + "”\n• [2] " + "S" * 260 + "\n\nReferences:\n[1] T1 — u1\n[2] T2 — u2"
    assert rows[2].answer.startswith("I could not find") and rows[2].n == 0


def test_crawl_documents_and_give_up(spark):
    edges = spark.createDataFrame([("b", "d.pdf", "document", "href", "late"), ("a", "d.pdf", "document", "href", "early"), ("a", "b", "same_site", "href", "")], "src string, dst string, kind string, method string, text string")
    visited = spark.createDataFrame([("s", "a", 0), ("s", "b", 1), ("t", "b", 0)], "seed string, url string, depth int")
    assert sorted(map(tuple, G.crawl_documents(visited, edges).collect())) == [("s", "d.pdf", "a", "early", "href"), ("t", "d.pdf", "b", "late", "href")]
    links = spark.createDataFrame([(f"{H1}/s", f"{H1}/d.pdf", "document", "href", ""), (f"{H1}/s", f"{H2}/e.pdf", "document", "href", "")], "src string, dst string, kind string, method string, text string")
    seeds = spark.createDataFrame([("one", f"{H1}/s")], "seed string, url string")
    assert [r.url for r in G.crawl_documents(seeds.withColumn("depth", F.lit(0)), links, seeds).collect()] == [f"{H1}/d.pdf"]
    visits = spark.createDataFrame([("s", i, i >= 3, 0) for i in range(40)] + [("t", i, i >= 3, int(i == 0)) for i in range(40)], "s string, i int, bad boolean, found int")
    assert [tuple(r) for r in W.failed_runs(visits, "s", "i", "bad", "found").collect()] == [("s", 22)]


def test_listing_seeds_and_legal_seeds(spark):
    rows = [(1, "https://www.BOE.es/x"), (2, "https://docs.boe.es:8080/"), (3, "https://notboe.es.example/"), (4, "nowhere"), (5, None), (6, "https://www.govinfo.gov"), (1, "https://www.BOE.es/x")]
    sources = spark.createDataFrame(rows, "k long, url string")
    listed = {(r.k, r.group) for r in T.listing_seeds(sources).collect()}
    assert listed == {(1, "spain"), (2, "spain"), (3, "spain"), (6, "us")}  # a marker may stand anywhere in a host
    deep = spark.createDataFrame([("boe.es", "https://boe.es/deep")], "marker string, seed string")
    seeds = [(r.k, r.seed) for r in T.legal_seeds(sources, deep, ["/laws", "/en/rules"]).collect()]
    assert len(seeds) == len(set(seeds)) and {k for k, s in seeds if s == "https://boe.es/deep"} == {1, 2}
    assert (2, "https://docs.boe.es:8080/laws") in seeds and {k for k, s in seeds if s.endswith("/en/rules")} == {1, 2, 3, 6}
    assert T.listing_seeds(sources.limit(0)).count() == T.legal_seeds(sources.limit(0), deep).count() == 0


def test_group_links(spark):
    rows = [
        (1, "japan", "https://a/Law", "as PDF"), (2, "japan", "https://a/x.PDF?v", None), (3, "eu", "https://a/x", "as pdf"), (4, "eu", "https://a/law", "Law"), (5, "spain", "https://a/PDF/1", None),
        (6, "australia", "https://a/x", "Download"), (7, "australia", "https://a/x", "download"), (8, "us", "https://a/x", "Amended"), (9, "new zealand", "https://a/act/1/whole.html", "x"),
        (10, "elsewhere", "https://a/x.pdf", "x"), (11, "us", None, "law"), (12, None, "https://a/x.pdf", "law"), (9, "new zealand", "https://a/act/1/whole.html", "x"),
    ]
    out = sorted((r.k, r.url) for r in T.group_links(spark.createDataFrame(rows, "k long, group string, url string, text string")).collect())
    assert out == [(2, "https://a/x.PDF?v"), (3, "https://a/x"), (5, "https://a/PDF/1"), (6, "https://a/x"), (8, "https://a/x"), (9, "https://a/act/1/latest/whole.pdf"), (9, "https://a/act/1/whole.html")]


def test_live_status_phases(spark, tmp_path):
    at = str(tmp_path / "state")
    assert [(r.part, r.name, r.n) for r in J.status_page(spark, at).collect()] == [("phase", None, 0)]
    J.set_phase(spark, at, "starting")
    schema = "k long, status string, url string, place string"
    source = str(tmp_path / "in")
    for rows in ([(1, "ok", "u1", "b"), (2, "error", "u2", None)], [(3, "ok", "u3", "b"), (4, "ok", "u4", "a")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        J.finish(spark, J.live_status(spark.readStream.schema(schema).parquet(source), at, str(tmp_path / "checkpoint"), None, 3, ("place",)), at)
    page = {(r.part, r.name, r.n, r.last, r.url) for r in J.status_page(spark, at, 2).collect()}
    assert page == {
        ("phase", "done", 4, 4, None), ("total", "ok", 3, 4, None), ("total", "error", 1, 2, None), ("place", "b", 2, 3, None), ("place", "Unknown", 1, 2, None),
        ("recent", "ok", 1, 4, "u4"), ("recent", "ok", 1, 3, "u3"), ("recent", "error", 1, 2, "u2"),
    }
    assert [p for _, p in J._phases(spark, at)] == ["starting", "running", "done", "running", "done"]
    bad = spark.readStream.schema(schema).parquet(source).withColumn("k", F.expr("cast(raise_error('broken') as long)"))
    with pytest.raises(Exception):
        J.finish(spark, J.live_status(bad, at, str(tmp_path / "other"), None), at)
    assert J.status_page(spark, at).where("part = 'phase'").first().name == "failed"
