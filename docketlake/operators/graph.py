"""The link graph of page snapshots: edges, closure by rounds, frontier order and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from .harvest import ANCHOR, SKIPPED, anchor_href, anchor_text, api_hints, document_hrefs, embed_hrefs
from .scan import empty_streaks
from .storage import discard, numbered, saved


#: How links are found, the first counts where one is found in several ways.
METHODS = ("href", "embed", "embedded-url", "getattachment", "quoted-path", "script", "api")


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, kind, method, text): every link of every page, by anchors, embedded media, named documents and API paths.

    kind is document, same_site or off_site; a link that a page has twice keeps its first method and, of that, its text.
    Each page is read once: what all ways find in it is one array, whose entries are resolved after they are told apart, and
    links meet once, by page and URL, so snapshots that share an id keep their own links.
    """
    html, place = F.col("html"), {m: i for i, m in enumerate(METHODS)}
    tagged = lambda found, m: F.transform(found, lambda x: F.struct(F.lit(place[m]).alias("o"), F.lit(m).alias("method"), x.alias("raw")))
    order = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    named = F.transform(document_hrefs(html), lambda x: F.struct(order[x["method"]].alias("o"), x["method"].alias("method"), x["href"].alias("raw")))
    found = F.concat(tagged(F.regexp_extract_all(html, F.lit(ANCHOR), 0), "href"), tagged(embed_hrefs(html), "embed"), named, tagged(api_hints(html, 40), "api"))
    rows = pages.select(F.col("url").alias("src"), F.posexplode(found).alias("pos", "l")).select("src", "pos", "l.*")
    raw, by = F.col("raw"), F.col("method")
    href = F.when(by == "href", anchor_href(raw)).when(by.isin("embed", "api"), raw).otherwise(F.trim(F.replace(raw, F.lit("&amp;"), F.lit("&"))))
    text = F.when(by == "href", F.substring(anchor_text(raw), 1, 300)).otherwise("")
    rows = rows.select("src", "pos", "o", "method", href.alias("href"), text.alias("text"))
    rows = rows.where(~by.isin("href", "embed") | (~F.col("href").rlike(SKIPPED) & ((F.col("href") != "") | (by != "href"))))
    url = U.resolve_url(F.col("src"), F.col("href"))
    rows = rows.withColumn("dst", F.when(by == "api", url).otherwise(F.regexp_replace(url, "#.*$", ""))).where(F.col("dst").rlike("(?i)^https?://"))
    kept = rows.groupBy("src", "dst").agg(F.min(F.struct("o", "pos", "method", "text")).alias("m")).select("src", "dst", "m.method", "m.text")
    kind = F.when(U.looks_like_doc(F.col("dst")), "document").when(U.is_same_site(U.host_of(F.col("dst")), U.host_of(F.col("src"))), "same_site").otherwise("off_site")
    return kept.select("src", "dst", kind.alias("kind"), "method", "text")


def queue_of(url: Column) -> Column:
    """0 for legal pages, 2 for junk pages, 1 for others."""
    return F.when(U.is_legal_priority_page(url), 0).when(U.is_junk_page(url), 2).otherwise(1)


def crawl(
    edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, max_pages: int | None = None, focused: bool = False, same_site: bool = True, per_round: int | None = None
) -> DataFrame:
    """(seed, url, depth): what the crawl of each seed (seed, url, and max_pages, its own budget, if it has one) visits over the edges (src, dst).

    All seeds are crawled together, in rounds. Each has a queue of pages found and not visited: legal pages come first, then
    by priority and URL. A round visits the first pages of every queue, all of them or ``per_round``, as far as the seed's
    budget goes (``max_pages`` where it has none of its own; null has no bound), and puts the new pages they link to in the
    queue: those of the seed's site (``same_site``), no junk pages if ``focused``, none beyond ``max_depth`` links. A page
    already waiting keeps its place. With ``per_round`` 1 it is a crawl page by page. A seed given at several URLs starts
    with all of them; a seed with no budget left drops out. Queue, visits and edges are tables in the shared folder, each
    round's replaced by the next's.
    """
    edges = saved(edges.select("src", "dst").distinct())
    own = F.col("max_pages").cast("long") if "max_pages" in seeds.columns else F.lit(None).cast("long")
    starts = seeds.select("seed", "url", F.coalesce(own, F.lit(max_pages).cast("long")).alias("_budget"))
    sites = saved(starts.groupBy("seed").agg(F.min("_budget").alias("budget"), F.collect_set(U.host_of(F.col("url"))).alias("hosts")))
    bounded = not sites.where("budget is not null").isEmpty()
    at_once = not bounded and per_round is None  # every queue is emptied in every round
    waiting = saved(starts.select("seed", "url", F.lit(0).alias("depth")).distinct())
    visited, recent, round_ = saved(waiting.limit(0)), [], 0
    while True:
        taken = waiting if at_once else saved(_first_of_queues(waiting, visited, sites, per_round))
        if taken.isEmpty():
            return visited
        visited, recent, round_ = visited.unionByName(taken), [*recent, taken], round_ + 1
        if at_once and max_depth is not None and round_ > max_depth:
            return visited
        if len(recent) == 8:
            visited = saved(visited)
            discard(*recent[:-1])
            recent = recent[-1:]
        reached = taken if max_depth is None else taken.where(F.col("depth") < max_depth)
        reached = reached.join(edges, F.col("url") == F.col("src")).groupBy("seed", F.col("dst").alias("url")).agg((F.min("depth") + 1).alias("depth"))
        if focused:
            reached = reached.where(~U.is_junk_page(F.col("url")))
        if same_site:
            kept = reached.join(sites.select("seed", "hosts"), "seed")
            reached = kept.where(F.exists("hosts", lambda h: U.is_same_site(U.host_of(F.col("url")), h))).drop("hosts")
        new = reached.join(visited.select("seed", "url"), ["seed", "url"], "left_anti")
        if not at_once:
            rest = waiting.join(taken, ["seed", "url"], "left_anti")
            new = rest.unionByName(new.join(rest.select("seed", "url"), ["seed", "url"], "left_anti"))
        old, waiting = waiting, saved(new)
        if not at_once:
            discard(old)


def _first_of_queues(waiting: DataFrame, visited: DataFrame, sites: DataFrame, per_round: int | None) -> DataFrame:
    """The next pages of every seed's queue: ``per_round`` of them, or as many as its budget has left."""
    spent = visited.groupBy("seed").agg(F.count("*").alias("_n"))
    left = sites.join(spent, "seed", "left").select("seed", (F.col("budget") - F.coalesce("_n", F.lit(0))).alias("left")).where("left is null or left > 0")
    left = saved(left.join(waiting.select("seed").distinct(), "seed", "left_semi"))
    most = left.agg(F.max("left").alias("n"), F.count_if(F.col("left").isNull()).alias("free")).first()
    bound = per_round if most["free"] else min(x for x in (per_round, most["n"] or 0) if x is not None)
    order = F.when(U.is_legal_priority_page(F.col("url")), 0).otherwise(1), U.page_priority(F.col("url")), F.col("url")
    ranked = waiting.withColumn("_place", F.row_number().over(Window.partitionBy("seed").orderBy(*order)))
    # the bound of all seeds cuts each part of a queue before it is dealt to its seed
    ranked = ranked if bound is None else ranked.where(F.col("_place") <= bound)
    return ranked.join(left, "seed").where(F.col("left").isNull() | (F.col("_place") <= F.col("left"))).select("seed", "url", "depth")


def crawl_documents(visited: DataFrame, edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(seed, url, source_page, text, method): the documents that visited pages (seed, url, depth) link to, as first found by each seed.

    First is the page of the least depth, then of the smallest URL. With ``seeds`` (seed, url) documents off the seed's
    site are left out.
    """
    pages = visited.select("seed", F.col("url").alias("page"), "depth")
    links = edges.where("kind = 'document'").select("src", "dst", "method", "text").join(pages, F.col("src") == F.col("page"))
    if seeds is not None:
        hosts = seeds.groupBy("seed").agg(F.collect_set(U.host_of(F.col("url"))).alias("_hosts"))
        links = links.join(hosts, "seed").where(F.exists("_hosts", lambda h: U.is_same_site(U.host_of(F.col("dst")), h)))
    first = links.groupBy("seed", "dst").agg(F.min_by(F.struct("src", "text", "method"), F.struct("depth", "src")).alias("f"))
    return first.select("seed", F.col("dst").alias("url"), F.col("f.src").alias("source_page"), "f.text", "f.method")


def frontier_order(urls: DataFrame, focused: bool = False) -> DataFrame:
    """(k, url, queue, priority, place) in visiting order: legal pages first, then by priority; junk pages last, or not at all if ``focused``.

    ``place`` counts within a queue. The whole frontier is numbered by ranges and each queue's start is taken off, so no
    queue is one task's.
    """
    rows = urls.select("k", "url", queue_of(F.col("url")).alias("queue"), U.page_priority(F.col("url")).alias("priority"))
    rows = numbered(rows.where("queue < 2") if focused else rows, "_at", F.col("queue"), F.col("priority"), F.col("url"), F.col("k"))
    starts = rows.groupBy("queue").agg(F.min("_at").alias("_start"))
    return rows.join(F.broadcast(starts), "queue").withColumn("place", (F.col("_at") - F.col("_start") + 1).cast("int")).select("k", "url", "queue", "priority", "place")


def site_reports(edges: DataFrame, visits: DataFrame, streak: int = 8) -> DataFrame:
    """Report on each site: pages visited, documents, links by kind, errors and whether a streak of empty pages warns of blocking.

    edges (src, dst, kind), visits (url, seq, status, links): every fetch of a page in order, with how many links it gave.
    """
    site = lambda c: U.host_of(F.col(c)).alias("site")
    linked = edges.groupBy(site("src")).agg(
        F.count_distinct(F.when(F.col("kind") == "document", F.col("dst"))).alias("documents"), *[F.count_if(F.col("kind") == k).alias(f"{k}_links") for k in ("document", "same_site", "off_site")]
    )
    rows = visits.select(site("url"), "url", "seq", "status", "links")
    seen = rows.groupBy("site").agg(F.count_distinct("url").alias("pages"), F.count_if(F.col("status") != "ok").alias("errors"))
    empty = empty_streaks(rows.where("status = 'ok'"), "site", "seq", "links", streak).select("site").distinct().withColumn("empty_streak", F.lit(True))
    out = seen.join(linked, "site", "full").join(empty, "site", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("site", *[zero(c) for c in ("pages", "errors", "documents", "document_links", "same_site_links", "off_site_links")], F.coalesce("empty_streak", F.lit(False)).alias("empty_streak"))
