"""Aggregate, window, set and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import catalog as K
from ..operators import rank as R
from ..operators import scan as W
from . import sqlx as X
from .classify import ENRICHED, LAWS
from .inputs import load, with_bigints, with_inputs

QUERIES, SQL = {}, {}
STATUSES = ["to_download", "downloaded", "download_failed", "scanned_pdf"]


def register(name: str, oracle: str, *tables: str):
    def keep(fn):
        QUERIES[name] = fn
        SQL[name] = with_bigints(with_inputs(oracle, *tables) if tables else oracle)
        return fn

    return keep


@register("a1_run_stats", "select count(*) as attempted, count_if(status = 'ok') as ok, count_if(status <> 'ok') as failed, sum(new_items) as new_items from runs", "runs")
def _(spark, sf):
    return R.run_stats(load(spark, sf, "runs"))


@register("a2_counts_by_jurisdiction", "select case when trim(jurisdiction) = '' then 'Unknown' else jurisdiction end as value, count(*) as n from downloads group by 1 order by n desc, value limit 40", "downloads")
def _(spark, sf):
    return R.counts_by(load(spark, sf, "downloads"), "jurisdiction", 40)


@register("a3_laws_profile", f"""with {LAWS}, m as (select 'laws' as metric, '' as value, count(*) as n from laws union all select 'with_authority', '', count_if(coalesce(authority, '') <> '') from laws union all select 'with_summary', '', count_if(length(summary) > 20) from laws union all select 'level', coalesce(nullif(level, ''), '?'), count(*) from laws group by 2
  union all select * from (select 'country', coalesce(nullif(country, ''), '?') as value, count(*) as n from laws group by 2 order by n desc, value limit 15)) select metric, value, cast(n as bigint) as n from m""", "tracking", "registry", "updates")
def _(spark, sf):
    return R.laws_profile(K.laws_catalog(load(spark, sf, "updates"), load(spark, sf, "tracking"), load(spark, sf, "registry")))


@register("a4_status_counts", "select source_kind, " + ", ".join(f"count_if(status = '{s}') as {s}" for s in STATUSES) + ", count(*) as total from downloads group by 1", "downloads")
def _(spark, sf):
    return R.status_counts(load(spark, sf, "downloads"), "source_kind", STATUSES)


@register("a5_law_type_counts", f"select law_type as value, count(*) as n from ({ENRICHED}) group by 1", "downloads")
def _(spark, sf):
    return R.counts_by(K.enrich(load(spark, sf, "downloads")), "law_type")


@register("a5_year_counts", f"select cast(year as varchar) as value, count(*) as n from ({ENRICHED}) where year is not null group by 1", "downloads")
def _(spark, sf):
    return R.counts_by(K.enrich(load(spark, sf, "downloads")).where("year is not null"), "year")


@register("a5_kind_counts", "select source_kind as value, count(*) as n from downloads group by 1", "downloads")
def _(spark, sf):
    return R.counts_by(K.enrich(load(spark, sf, "downloads")), "source_kind")


@register("a6_top_error_hosts", f"select case when {X.host('url')} = '' then 'Unknown' else {X.host('url')} end as value, count(*) as n from runs where status <> 'ok' group by 1 order by n desc, value limit 25", "runs")
def _(spark, sf):
    return R.counts_by(load(spark, sf, "runs").where("status <> 'ok'").withColumn("host", U.host_of(F.col("url"))), "host", 25)


@register("a7_discovery_method_counts", "select discovery_method as value, count(*) as n from (select *, row_number() over (partition by url order by k) as r from downloads) where r = 1 group by 1", "downloads")
def _(spark, sf):
    """The first method that found each URL."""
    return R.counts_by(R.dedupe_first(load(spark, sf, "downloads"), ["url"], F.col("k")), "discovery_method")


@register("a8_language_histogram", "select lang, count(*) as n, count_if(length(text) >= 40) as with_text, sum(length(text)) as chars from documents group by 1")
def _(spark, sf):
    return R.language_histogram(load(spark, sf, "documents"))


@register("a9_sources_fewest_first", "select r.jurisdiction, coalesce(n, 0) as n, row_number() over (order by coalesce(n, 0), r.jurisdiction) as place from (select distinct jurisdiction from registry) r left join (select jurisdiction, count(*) as n from downloads group by 1) d on r.jurisdiction = d.jurisdiction", "registry", "downloads")
def _(spark, sf):
    return R.fewest_first(load(spark, sf, "registry"), load(spark, sf, "downloads"), "jurisdiction")


@register("a10_table_counts", "select 'documents' as name, count(*) as n from documents union all select 'pages', count(*) from pages union all select 'orders', count(*) from orders")
def _(spark, sf):
    return R.table_counts({t: load(spark, sf, t) for t in ("documents", "pages", "orders")})


@register("a11_drop_counts", "select jurisdiction, count(*) as n from downloads where status = 'download_failed' group by 1", "downloads")
def _(spark, sf):
    return load(spark, sf, "downloads").where("status = 'download_failed'").groupBy("jurisdiction").agg(F.count("*").alias("n"))


@register("a14_crawl_reports", """with v as (select source, event_id as seq, user_id % 7 = 0 as js, case when event_id % 400 < 90 then 0 else 3 end as links, case when status <> 'ok' then status || event_id end as error from runs),
  d as (select 'source-' || k % 55 as source, k % 3 > 0 as regulatory, status = 'downloaded' as downloaded from downloads where k % 55 > 3),
  p as (select source, count(*) as pages, count_if(js) as js_pages, count(error) as errors, arg_min(error, seq) filter (error is not null) as first from v group by 1),
  f as (select source, count(*) as candidates, count_if(regulatory) as kept, count_if(not regulatory) as rejected, count_if(downloaded) as downloaded from d group by 1),
  z as (select distinct source from (select source, sum(links) over (partition by source order by seq rows between 7 preceding and current row) as s, row_number() over (partition by source order by seq) as n from v where error is null) where s = 0 and n >= 8),
  r as (select coalesce(p.source, f.source) as source, coalesce(pages, 0) as pages, coalesce(js_pages, 0) as js_pages, coalesce(errors, 0) as errors, coalesce(candidates, 0) as candidates, coalesce(kept, 0) as kept, coalesce(rejected, 0) as rejected, coalesce(downloaded, 0) as downloaded, coalesce(case when candidates is null then first end, case when z.source is not null then 'possible_rate_limit' end) as error
    from p full join f on p.source = f.source left join z on z.source = coalesce(p.source, f.source))
  select 'source' as part, * from r union all select 'total', null, sum(pages)::bigint, sum(js_pages)::bigint, sum(errors)::bigint, sum(candidates)::bigint, sum(kept)::bigint, sum(rejected)::bigint, sum(downloaded)::bigint, null from r""", "runs", "downloads")
def _(spark, sf):
    """Sources 0 to 3 have visits only, and those from 40 on documents only."""
    visits = load(spark, sf, "runs").selectExpr("source", "event_id as seq", "user_id % 7 = 0 as js", "case when event_id % 400 < 90 then 0 else 3 end as links", "case when status <> 'ok' then concat(status, event_id) end as error")
    documents = load(spark, sf, "downloads").where("k % 55 > 3").selectExpr("concat('source-', k % 55) as source", "k % 3 > 0 as regulatory", "status = 'downloaded' as downloaded")
    return R.crawl_reports(visits, documents)


@register("a12_facet_values", "select distinct trim(x) as value from (select unnest(string_split(segment, ',')) as x from registry) where trim(x) <> '' union all select distinct trim(jurisdiction) from registry where trim(jurisdiction) <> ''", "registry")
def _(spark, sf):
    r = load(spark, sf, "registry")
    return R.facet_values(r, "segment", True).unionByName(R.facet_values(r, "jurisdiction"))


_stop = ", ".join(f"'{w}'" for w in R.TOPIC_STOP)


@register(
    "a13_topic_terms",
    f"""with w as (select id, unnest(l) as word, unnest(range(len(l))) as pos from (select id, regexp_extract_all(lower(text), '[a-z]{{5,}}') as l from corpus)), c as (select id, word, count(*) as c, min(pos) as p from w where word not in ({_stop}) group by 1, 2)
    select id, string_agg(word, ',' order by r) as topics from (select *, row_number() over (partition by id order by c desc, p) as r from c) where r <= 6 group by id""",
    "corpus",
)
def _(spark, sf):
    return R.topic_terms(load(spark, sf, "corpus"))


@register("a14_source_reports", "select source, count(*) as pages, sum(item_count) as candidates, sum(new_items) as kept, count_if(status = 'error') as errors, count_if(status = 'http_error') as http_errors from runs group by 1", "runs")
def _(spark, sf):
    return R.source_reports(load(spark, sf, "runs"))


@register("a15_blocked_hosts", f"select source, array_to_string(list_sort(list_distinct(list({X.host('url')})))[1:50], ',') as hosts from runs where http_status in (403, 429) or http_status >= 500 group by 1", "runs")
def _(spark, sf):
    return R.blocked_hosts(load(spark, sf, "runs")).withColumn("hosts", F.array_join("hosts", ","))


@register("a16_distinct_sets", "select jurisdiction, array_to_string(list_sort(list_distinct(list(source_kind))), ',') as kinds, array_to_string(list_sort(list_distinct(list(status))), ',') as statuses from downloads group by 1", "downloads")
def _(spark, sf):
    sets = R.distinct_sets(load(spark, sf, "downloads"), "jurisdiction", "source_kind", "status")
    return sets.select("jurisdiction", F.array_join("source_kind", ",").alias("kinds"), F.array_join("status", ",").alias("statuses"))


@register("w1_dedupe_first", "select k, sha256 from (select *, row_number() over (partition by sha256 order by k) as r from downloads) where r = 1", "downloads")
def _(spark, sf):
    return R.dedupe_first(load(spark, sf, "downloads"), ["sha256"], F.col("k")).select("k", "sha256")


@register("w2_top_items_per_source", "select source, k, rank from (select *, row_number() over (partition by source order by value desc, k) as rank from runs) where rank <= 25", "runs")
def _(spark, sf):
    return R.keep_top(load(spark, sf, "runs"), ["source"], 25, F.desc("value"), F.col("k")).select("source", "k", "rank")


@register("w3_relative_cutoff", "select source, k, score, rank from (select *, row_number() over (partition by source order by score desc, k) as rank from (select source, k, value as score, max(value) over (partition by source) as best from runs) where score >= case when best >= 6 then greatest(1, best * 0.35) else 1 end) where rank <= 8", "runs")
def _(spark, sf):
    scored = load(spark, sf, "runs").select("source", "k", F.col("value").alias("score"))
    return R.relative_cutoff(scored, "source", 8, 0.35, 6, 1.0, F.col("k"))


@register("w5_empty_streaks", "select source, min(k) as first, max(k) as last, count(*) as n from (select *, sum(case when item_count > 0 then 1 else 0 end) over (partition by source order by k) as i from (select source, k, item_count * (case when floor(k / 300) % 2 = 0 then 1 else 0 end) as item_count from runs)) where item_count = 0 group by source, i having count(*) >= 3", "runs")
def _(spark, sf):
    visits = load(spark, sf, "runs").select("source", "k", (F.col("item_count") * F.expr("case when floor(k / 300) % 2 = 0 then 1 else 0 end")).alias("item_count"))
    return W.empty_streaks(visits, "source", "k", "item_count", 3)


@register("w5_failed_runs", "select source, min(k) as at from (select *, sum(bad) over (partition by source, i order by k) as run from (select *, sum(1 - bad) over (partition by source order by k) as i, sum(found) over (partition by source order by k) as f, row_number() over (partition by source order by k) as n from (select source, k, case when status = 'ok' then 0 else 1 end as bad, case when k < 400 then 0 else new_items end as found from runs))) where run >= 3 and f = 0 and n >= 4 group by source", "runs")
def _(spark, sf):
    visits = load(spark, sf, "runs").select("source", "k", (F.col("status") != "ok").alias("bad"), F.when(F.col("k") < 400, 0).otherwise(F.col("new_items")).alias("found"))
    return W.failed_runs(visits, "source", "k", "bad", "found", 3, 4)


@register("w6_keep_last", "select k, discovered_at, row_number() over (order by discovered_at desc, k) as rank from updates order by discovered_at desc, k limit 200", "updates")
def _(spark, sf):
    return R.keep_top(load(spark, sf, "updates"), [], 200, F.desc("discovered_at"), F.col("k")).select("k", "discovered_at", "rank")


@register("w7_cap_per_source", "select source, sum(case when r <= 20 then 1 else 0 end) as kept, sum(case when r > 20 then 1 else 0 end) as capped from (select source, row_number() over (partition by source order by k) as r from runs where new_items > 0) group by source", "runs")
def _(spark, sf):
    return R.cap_per_source(load(spark, sf, "runs").where("new_items > 0"), "source", 20)


@register("w8_disambiguate_filename", r"select k, case when r > 1 then regexp_extract(filename, '^(.+?)(\.[^.]*)?$', 1) || '_' || sha256(url)[1:8] || '.pdf' else filename end as filename from (select *, row_number() over (partition by jurisdiction, source_kind, filename order by k) as r from downloads)", "downloads")
def _(spark, sf):
    mark = F.substring(F.sha2("url", 256), 1, 8)
    return R.disambiguate(load(spark, sf, "downloads"), "filename", ["jurisdiction", "source_kind"], "k", mark).select("k", "filename")


@register("w10_number_citations", "select source, string_agg('[' || n || '] ' || k, ' ' order by n) as citations from (select source, k, row_number() over (partition by source order by value desc, k) as n from runs) where n <= 6 group by 1", "runs")
def _(spark, sf):
    return R.number_citations(load(spark, sf, "runs"), "source", "k", 6, F.desc("value"), F.col("k"))


@register("w11_display_cap", "select k, total from (select k, count(*) over () as total from downloads where source_kind = 'site') order by k limit 400", "downloads")
def _(spark, sf):
    return R.display_cap(load(spark, sf, "downloads").where("source_kind = 'site'").select("k"), 400, F.col("k"))


@register("w12_first_per_host", f"select host, min(k) as k from (select k, {X.host('url')} as host from registry where starts_with(url, 'http') and trim(authority) <> '') where host <> '' group by host", "registry")
def _(spark, sf):
    return R.first_per_host(load(spark, sf, "registry"))


@register("x2_prepend_and_dedupe", "select k, link from (select *, row_number() over (partition by lower(link) order by new desc, k) as r from (select k, link, k % 2 as new from updates)) where r = 1", "updates")
def _(spark, sf):
    u = load(spark, sf, "updates")
    return K.union_by_precedence([u.where("k % 2 = 1"), u.where("k % 2 = 0")], F.lower("link")).select("k", "link")


@register("x3_union_first_wins", "select k, url from (select *, row_number() over (partition by url order by rank, k) as r from (select k, url, 0 as rank from downloads where k % 3 > 0 union all select k, url, 1 from downloads where k % 3 < 2)) where r = 1", "downloads")
def _(spark, sf):
    d = load(spark, sf, "downloads")
    return K.union_by_precedence([d.where("k % 3 > 0"), d.where("k % 3 < 2")], F.col("url")).select("k", "url")


@register("x4_kept_and_rejected", "select status, bytes >= 1000000 as big, count(*) as n from downloads group by 1, 2", "downloads")
def _(spark, sf):
    d = load(spark, sf, "downloads")
    kept, rest = R.kept_and_rejected(d, F.col("bytes") >= 1000000)
    return kept.select("status", F.lit(True).alias("big")).unionByName(rest.select("status", F.lit(False).alias("big"))).groupBy("status", "big").agg(F.count("*").alias("n"))


@register("x5_token_sets", "select doc_id, array_to_string(list_sort(list_intersect(a, b)), ' ') as both_sides, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b, x))), ' ') as only_first, len(list_distinct(a || b)) as n_union from (select doc_id, list_distinct(string_split(lower(text), ' ')) as a, list_distinct(string_split(lower(reverse(text)), ' ')) as b from documents)")
def _(spark, sf):
    word_set = lambda t: F.array_distinct(F.split(F.lower(t), " "))
    sets = R.token_sets(word_set(F.col("text")), word_set(F.reverse(F.col("text"))))
    return load(spark, sf, "documents").select("doc_id", F.array_join(F.sort_array(sets["both"]), " ").alias("both_sides"), F.array_join(F.sort_array(sets["only_first"]), " ").alias("only_first"), F.size(sets["either"]).alias("n_union"))


@register("j3_new_items", "select k, link from updates u where not exists (select 1 from (select link from updates where k % 4 = 0) s where s.link = u.link)", "updates")
def _(spark, sf):
    u = load(spark, sf, "updates").select("k", "link")
    return R.new_items(u, u.where("k % 4 = 0"), "link")


@register("j4_resume_filter", "select k from downloads c where k % 2 = 1 and not exists (select 1 from downloads d where d.k % 2 = 0 and d.url = c.url) and not exists (select 1 from downloads d where d.k % 2 = 0 and d.sha256 = c.sha256 and d.sha256 <> '')", "downloads")
def _(spark, sf):
    d = load(spark, sf, "downloads")
    return R.resume(d.where("k % 2 = 1"), d.where("k % 2 = 0")).select("k")


# every URL stands about three times on either side
@register(
    "j5_merge_manifest",
    """with d as (select 'u' || cast(floor(k / 7) as bigint) as url, jurisdiction, source_kind, status, k as nth from downloads), e as (select url, arg_min(jurisdiction, nth) as ej, arg_min(source_kind, nth) as ek from d where nth % 3 < 2 and floor(nth / 7) % 5 > 0 group by url),
  n as (select url, arg_max(jurisdiction, nth) as nj, arg_max(source_kind, nth) as nk from d where nth % 3 > 0 and floor(nth / 7) % 4 > 0 and status in ('downloaded', 'scanned_pdf') group by url)
  select coalesce(e.url, n.url) as url, case when n.url is null then ej else nj end as jurisdiction, case when n.url is null then ek else nk end as source_kind, case when n.url is null then 'kept' when e.url is null then 'added' else 'relabelled' end as change from e full join n on e.url = n.url""",
    "downloads",
)
def _(spark, sf):
    d = _addressed(spark, sf)
    return R.merge_manifest(d.where("nth % 3 < 2 and floor(nth / 7) % 5 > 0"), d.where("nth % 3 > 0 and floor(nth / 7) % 4 > 0"), "nth")


def _addressed(spark, sf):
    """Downloads at few URLs, in the order of ``nth``."""
    return load(spark, sf, "downloads").select(F.concat(F.lit("u"), F.floor(F.col("k") / 7).cast("string")).alias("url"), "jurisdiction", "source_kind", "status", F.col("k").cast("long").alias("nth"))


# row by row, as the artifact's rows come
@register("j5_merge_artifacts", """with recursive d as (select 'u' || cast(floor(k / 7) as bigint) as url, k as nth, k % 3 as side, jurisdiction, source_kind, floor(k / 7) as g from downloads),
  e as (select url, arg_min(jurisdiction, nth) as j, arg_min(case when nth % 7 = 0 then '' else source_kind end, nth) as s from d where side < 2 and g % 5 > 0 group by url),
  n as (select url, row_number() over (partition by url order by nth) as r, case when nth % 2 = 0 then 'Saudi Arabia - ' || (nth % 5) else 'Other' end as nj, case when nth % 4 = 0 then '' else 'crawl' end as nk from d where side > 0 and g % 4 > 0 and nth % 11 > 0),
  m as (select coalesce(e.url, f.url) as url, case when e.url is null then nj else j end as j, case when e.url is null then nk else s end as s, e.url is null as added, false as changed, cast(0 as bigint) as r from e full join (select * from n where r = 1) f on e.url = f.url
    union all select m.url, case when n.nj like 'Saudi Arabia - %' and n.nj <> m.j then n.nj else m.j end, case when n.nj like 'Saudi Arabia - %' and n.nj <> m.j then coalesce(nullif(n.nk, ''), nullif(m.s, ''), 'ministry') else m.s end, m.added, m.changed or (n.nj like 'Saudi Arabia - %' and n.nj <> m.j), n.r from m join n on n.url = m.url and n.r = m.r + 1)
  select url, j as jurisdiction, s as source_kind, case when added then 'added' when changed then 'relabelled' else 'kept' end as change from (select *, row_number() over (partition by url order by r desc) as back from m) where back = 1""", "downloads")
def _(spark, sf):
    d = _addressed(spark, sf)
    old = d.where("nth % 3 < 2 and floor(nth / 7) % 5 > 0").withColumn("source_kind", F.when(F.col("nth") % 7 == 0, "").otherwise(F.col("source_kind")))
    new = d.where("nth % 3 > 0 and floor(nth / 7) % 4 > 0").select("url", "nth", F.when(F.col("nth") % 2 == 0, F.concat(F.lit("Saudi Arabia - "), (F.col("nth") % 5).cast("string"))).otherwise("Other").alias("jurisdiction"), F.when(F.col("nth") % 4 == 0, "").otherwise("crawl").alias("source_kind"), (F.col("nth") % 11 == 0).alias("dry_run"))
    return R.merge_artifacts_into(old, new, "Saudi Arabia - ", "nth")


@register("a11_merge_counts", f"select jurisdiction, count(*) as n from ({SQL['j5_merge_artifacts']}) where change <> 'kept' group by 1")
def _(spark, sf):
    return R.merge_counts(QUERIES["j5_merge_artifacts"](spark, sf))


# a gazette row for each jurisdiction of the registry, two that have no documents and one without any source
GAZETTE = "select jurisdiction, case when n % 3 = 0 then null else 'https://p.example/' end as parliamentary_bills, case when n % 2 = 0 then ' ' else 'https://g.example/' end as official_gazette, 'https://l.example/' as legal_databases from (select jurisdiction, min(k) as n from registry group by jurisdiction union all select 'Nowhere', 1 union all select 'Atlantis', 5)"
_coverage = f"""with c as ({ENRICHED}), b as (select case when trim(jurisdiction) = '' then 'Unknown' else trim(jurisdiction) end as j, * replace (case when jurisdiction = 'France' and source_kind = 'official_gazette' then 'site' else source_kind end as source_kind) from c),
  h as (select j, count(*) as n, list_sort(list_distinct(list(source_kind))) as kinds, list_reverse_sort(list_distinct(list(year) filter (year is not null))) as years, list_sort(list_distinct(list(law_type))) as law_types from b group by 1),
  g as (select case when trim(jurisdiction) = '' then 'Unknown' else trim(jurisdiction) end as j, list_filter([case when trim(coalesce(parliamentary_bills, '')) <> '' then 'parliamentary_bills' end, case when trim(coalesce(official_gazette, '')) <> '' then 'official_gazette' end], lambda x: x is not null) as expected from ({GAZETTE})),
  m as (select g.j as jurisdiction, coalesce(n, 0) as n, coalesce(kinds, []) as kinds, expected, coalesce(years, []) as years, coalesce(law_types, []) as law_types, list_filter(expected, lambda x: not list_contains(coalesce(kinds, []), x)) as missing from g left join h on g.j = h.j)
  select jurisdiction, n, array_to_string(kinds, ',') as kinds, array_to_string(expected, ',') as expected, array_to_string(years, ',') as years, array_to_string(law_types, ',') as law_types, array_to_string(missing, ',') as missing, case when n = 0 then 'zero' when n < 3 or len(missing) > 0 then 'partial' else 'ok' end as state from m"""


@register("j6_coverage", _coverage, "downloads", "registry")
def _(spark, sf):
    load(spark, sf, "registry").createOrReplaceTempView("registry")
    # France's gazette is filed as site documents, so a kind that it should have is missing
    kind = F.when((F.col("jurisdiction") == "France") & (F.col("source_kind") == "official_gazette"), "site").otherwise(F.col("source_kind"))
    catalog = K.enrich(load(spark, sf, "downloads")).withColumn("source_kind", kind)
    return R.coverage(spark.sql(GAZETTE), catalog).withColumns({c: F.array_join(c, ",") for c in ("kinds", "expected", "years", "law_types", "missing")})


OWNERS = [("example.org", "Org"), ("docs.beta.example.org", "Docs desk"), ("gov.example", "Government"), ("www.nowhere.example", "None")]
_owners = "(values " + ", ".join(f"('{h}', '{n}')" for h, n in OWNERS) + ") o(host, label)"


@register(
    "j7_relabel_by_host",
    f"select d.k, d.host, coalesce(b.label, jurisdiction) as jurisdiction, coalesce(b.label <> jurisdiction, false) as changed from (select k, {X.host('url')} as host, jurisdiction from downloads) d left join (select d.host, arg_max(o.label, length(o.host)) as label from (select distinct {X.host('url')} as host from downloads) d join {_owners} on d.host = o.host or ends_with(d.host, '.' || o.host) group by d.host) b on d.host = b.host",
    "downloads",
)
def _(spark, sf):
    docs = load(spark, sf, "downloads").select("k", U.host_of(F.col("url")).alias("host"), "jurisdiction")
    return R.relabel_by_host(docs, spark.createDataFrame(OWNERS, "host string, label string"))


#: Owners by code and host; the second half of the labels names codes in all forms.
AUTHORITIES = [("MC", "example.org"), ("France", "alpha.gov.example"), ("ia", "delta.example.net"), ("Data Office", ""), ("none", "nowhere.example")]
LABELS = "case k % 8 when 0 then 'Saudi Arabia - MC' when 1 then 'saudi arabia - mc (archive)' when 2 then 'Desk - IA' when 3 then 'Columbia' when 4 then 'Saudi Arabia - Data Office of X' when 5 then ' Saudi Arabia - McX' else jurisdiction end"
_named = "(values " + ", ".join(f"('{c}', '{h}')" for c, h in AUTHORITIES) + ") o(code, host)"


@register("j8_authority_documents", f"""with d as (select k, {X.host('url')} as host, lower(trim({LABELS})) as j from downloads),
  p as (select distinct code, k from {_named} join d on j = 'saudi arabia - ' || lower(code) or starts_with(j, 'saudi arabia - ' || lower(code) || ' ') or j = lower(code) or ends_with(j, ' - ' || lower(code)) or (o.host <> '' and (d.host = o.host or ends_with(d.host, '.' || o.host))))
  select o.code, count(k) as n, coalesce(string_agg(k, ',' order by k) filter (r <= 12), '') as first_ids from {_named} left join (select *, row_number() over (partition by code order by k) as r from p) q on q.code = o.code group by o.code""", "downloads")
def _(spark, sf):
    owners = spark.createDataFrame(AUTHORITIES, "code string, host string")
    docs = load(spark, sf, "downloads").select("k", U.host_of(F.col("url")).alias("host"), F.expr(LABELS).alias("jurisdiction"))
    return R.authority_documents(owners, docs, "Saudi Arabia")


@register(
    "j9_catalog_with_summaries",
    """with c as (select sha256 || '-' || k % 7 as id, lower(url) as url_key from downloads where k % 5 < 4), s as (select sha256 || '-' || (k + 1) % 7 as id, lower(url) as url_key, 'Summary of ' || k as summary from downloads where k % 5 > 1),
    u as (select url_key, summary from (select *, row_number() over (partition by url_key order by id) as r from s) where r = 1), i as (select id, summary from (select *, row_number() over (partition by id order by url_key) as r from s) where r = 1)
    select c.id, c.url_key, coalesce(u.summary, i.summary) as summary, true as in_catalog from c left join u on c.url_key = u.url_key left join i on c.id = i.id
    union all select id, url_key, summary, false from s where url_key not in (select url_key from c) and id not in (select id from c)""",
    "downloads",
)
def _(spark, sf):
    d = load(spark, sf, "downloads").withColumn("url_key", F.lower("url"))
    catalog = d.where("k % 5 < 4").select(F.concat("sha256", F.lit("-"), (F.col("k") % 7).cast("string")).alias("id"), "url_key")
    made = d.where("k % 5 > 1").select(F.concat("sha256", F.lit("-"), ((F.col("k") + 1) % 7).cast("string")).alias("id"), "url_key", F.concat(F.lit("Summary of "), F.col("k").cast("string")).alias("summary"))
    return R.catalog_with_summaries(catalog, made)


@register("j10_site_alias_join", f"select k, d.host, coalesce(g, d.host) as site from (select k, {X.host('url')} as host from downloads) d left join (values ('beta.example.org', 'beta'), ('docs.beta.example.org', 'beta'), ('delta.example.net', 'delta')) a(host, g) on d.host = a.host", "downloads")
def _(spark, sf):
    alias = spark.createDataFrame([("beta.example.org", "beta"), ("docs.beta.example.org", "beta"), ("delta.example.net", "delta")], "host string, site string")
    docs = load(spark, sf, "downloads").select("k", U.host_of(F.col("url")).alias("host"))
    return R.site_of(docs, alias).select("k", "host", "site")


@register("j11_latest_of", "select sha256, max(downloaded_at) as downloaded_at, max_by(status, downloaded_at || lpad(cast(k as varchar), 12, '0')) as status from downloads group by 1", "downloads")
def _(spark, sf):
    return R.latest_of(load(spark, sf, "downloads"), "sha256", "downloaded_at", "status")


@register("t2_page_changes", "select source, k, content_hash from (select *, lag(content_hash) over (partition by source order by k) as before from runs where http_status > 0 and http_status < 400) where item_count = 0 and before is not null and before <> content_hash", "runs")
def _(spark, sf):
    return W.page_changes(load(spark, sf, "runs"))
