"""Harvest, retrieval, graph and source queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import graph as G
from ..operators import harvest as H
from ..operators import rank as R
from ..operators import retrieval as Q
from ..operators import routing as T
from ..operators.storage import saved, shared_dir
from ..sources import io as S
from . import sqlx as X
from .inputs import load, with_bigints, with_inputs

QUERIES, SQL = {}, {}


def register(name: str, oracle: str | None, *tables: str):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            SQL[name] = with_bigints(with_inputs(oracle, *tables) if tables else oracle)
        return fn

    return keep


_site = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"


def absolute(h: str) -> str:
    """SQL: ``h`` resolved against ``site``, without fragment. The pages' links have no dot segments."""
    return f"regexp_replace(case when regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') then {h} when starts_with({h}, '//') then regexp_extract(site, '^[A-Za-z]+:') || {h} when starts_with({h}, '/') then site || {h} else site || '/' || {h} end, '#.*$', '')"


def decoded(x: str) -> str:
    return f"replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')"


_anchor = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))[^>]*>(.*?)</a>"""


def anchor_ctes(pages: str = "pages") -> str:
    """SQL: anchor_rows (every link) and anchors (the first of a URL and page)."""
    groups = ", ".join(f"regexp_extract_all(html, '{_anchor}', {i}) as h{i}" for i in (1, 2, 3, 4))
    return f"""a0 as (select page_id, {_site} as site, {groups} from {pages}), a1 as (select *, unnest(range(len(h4))) as pos from a0),
  a2 as (select page_id, site, pos, trim({decoded("coalesce(h1[pos + 1], '') || coalesce(h2[pos + 1], '') || coalesce(h3[pos + 1], '')")}) as href, trim(regexp_replace({decoded("regexp_replace(h4[pos + 1], '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g')) as text from a1),
  anchor_rows as (select page_id, pos, href, text, {absolute('href')} as url from a2 where href <> '' and not regexp_matches(href, '(?i)^\\s*(?:javascript|mailto|tel|data|blob):|^\\s*#')),
  anchors as (select page_id, url, min(pos) as pos, arg_min(href, pos) as href, arg_min(text, pos) as text from anchor_rows where regexp_matches(url, '(?i)^https?://') group by 1, 2)"""


ANCHORS = anchor_ctes()


@register("e1_extract_anchors", f"with {anchor_ctes('plain')} select * from anchors".replace("with a0", "with plain as (select page_id, url, html || '<a title=\"x\" href=/un/quoted?a=1&amp;b=2>Un &amp; <b>quoted</b></a>' as html from pages), a0"))
def _(spark, sf):
    return H.anchors(load(spark, sf, "pages").selectExpr("page_id", "url", "html || '<a title=\"x\" href=/un/quoted?a=1&amp;b=2>Un &amp; <b>quoted</b></a>' as html"))


@register("entry_links_per_host", f"with {ANCHORS} select {X.host('url')} as host, count(distinct url) as n_links, count(distinct page_id) as n_pages from anchors group by 1")
def links_per_host(spark, sf):
    links = H.anchors(load(spark, sf, "pages")).select("page_id", U.normalize_url(F.col("url")).alias("link"), U.host_of(F.col("url")).alias("host"))
    return links.groupBy("host").agg(F.countDistinct("link").alias("n_links"), F.countDistinct("page_id").alias("n_pages"))


RICH = """html || '<iframe src="/emb/' || page_id || '.pdf"></iframe><div data-url="/d/' || page_id % 7 || '"></div><script>var x = {"FileRef": "/sites/f' || page_id || '.docx"}; go("/api/v1/p' || page_id || '"); q = "/files/q' || page_id % 9 || '.pdf?a=1&amp;b=2"; u = ' || chr(39) || 'https://cdn.example.org/z' || page_id || '.pdf' || chr(39) || '</script><script>Path=/lib/one/p' || page_id % 11 || '.pdf;url: docs/rel' || page_id || '.pdf; see /deep/er/r' || page_id || '.pdf, https://cdn.example.org/t/' || page_id % 5 || '.pdf.aspx?v=2 or https://cdn.example.org/getattachment/ab/g' || page_id || '.pdf/x and https://cdn.example.org/s' || page_id || '.pptx#top</script>'"""


def _rich(spark, sf):
    return load(spark, sf, "pages").selectExpr("page_id", "url", f"{RICH} as html")


_rich_sql = f"rich as (select page_id, url, {RICH} as html, {_site} as site from pages)"
EMBEDS = f"""embeds as (select distinct page_id, {absolute('h')} as url from (select page_id, site, unnest(regexp_extract_all(html, '(?is)<(?:iframe|embed|object|source)\\b[^>]*?\\b(?:src|data|data-src|href)\\s*=\\s*["'']([^"'']+)["'']', 1)
  || regexp_extract_all(html, '(?is)\\bdata-(?:url|href)\\s*=\\s*["'']([^"'']+)["'']', 1)) as h from rich) where not regexp_matches(h, '(?i)^\\s*(?:javascript|mailto|tel|data|blob):|^\\s*#'))"""


@register("e2_extract_embeds", f"with {_rich_sql}, {EMBEDS} select * from embeds")
def _(spark, sf):
    return H.embeds(_rich(spark, sf))


_named = (
    ("embedded-url", r"(?i)(https?://[^\s\"''<>]+?\.(?:pdf|docx?|xlsx?|csv)(?:\.aspx)?(?:\?[^\s\"''<>]*)?)", ""),
    ("getattachment", r"(?i)(https?://[^\s\"''<>]*?/getattachment/[^\s\"''<>]+?\.pdf[^\s\"''<>]*)", ""),
    ("quoted-path", r"(?i)[\"'']([^\"'']+\.pdf(?:\.aspx)?(?:\?[^\"'']*)?)[\"'']", ""),
    ("script", r"(?i)(https?://[^\s\"''<>]+?\.(?:pdf|docx?|xlsx?|pptx?)(?:\.aspx)?(?:\?[^\s\"''<>]*)?)", ""),
    ("script", r"(?i)(?:href|src|url|FileRef|ServerRelativeUrl|EncodedAbsUrl|Path)\s*[=:]\s*[\"'']?([^\s\"''<>]+\.pdf[^\s\"''<>]*)", "where regexp_matches(h, '(?i)^/|^https?://')"),
    ("script", r"(?i)(/[^\s\"''<>]*?/[^\s\"''<>]*?\.pdf)", ""),
)


def _documents_sql(methods, label: str = "") -> str:
    found = " union all ".join(f"select * from (select page_id, site, {i} as i, '{label or m}' as method, unnest(regexp_extract_all(html, '{p}', 1)) as h from rich) {w}" for i, (m, p, w) in enumerate(_named) if m in methods)
    return f"select page_id, url, arg_min(method, i) as method from (select page_id, {absolute(chr(104) + '2')} as url, i, method from (select *, trim(replace(h, '&amp;', '&')) as h2 from ({found}))) where regexp_matches(url, '(?i)^https?://') group by 1, 2"


@register("e3_harvest_document_urls", f"with {_rich_sql} {_documents_sql(('embedded-url', 'getattachment', 'quoted-path', 'script'))}")
def _(spark, sf):
    return H.document_urls(_rich(spark, sf))


@register("e3_datasource_urls", f"with {_rich_sql} {_documents_sql(('quoted-path', 'script'), 'datasource')}")
def _(spark, sf):
    return H.document_urls(_rich(spark, sf), data_source=True)


@register("e3_script_documents", f"""with {_rich_sql} select distinct page_id, regexp_replace(u, '#.*$', '') as url from (select page_id, unnest(regexp_extract_all(s, '(?i)(https?://[^\\s"''\\\\]+\\.(?:pdf|docx?|xlsx?|pptx?|csv|rtf|odt|ods)(?:[?#][^\\s"''\\\\]*)?)', 1)) as u from (select page_id, unnest(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1)[1:8]) as s from rich))""")
def _(spark, sf):
    return H.script_documents(_rich(spark, sf))


JSON = """'{"items":[{"url":"https://h' || event_id % 9 || '.example.org/a","title":"T"},{"path":"/docs/' || event_id % 11 || '/x.PDF"},{"link":"/api/v2/' || event_id % 5 || '"},{"img":"/s/' || event_id || '.png"},{"href":"/deep/page/' || event_id % 3 || '"},{"href":"mailto:x","/key/of/' || event_id || '":1}],"more":[["https://m.example.org/q?x=' || event_id % 4 || chr(92) || 'u0026y=2"],["file' || event_id || '.pdf",[{"Path":" ' || chr(92) || '/nested/' || event_id % 7 || chr(92) || '/x "}]]],"n":' || event_id || case when event_id % 10 > 0 then '}' else '' end"""
_values = f"select event_id as id, t.key, json_extract_string(t.value, '$') as v from (select event_id, {JSON} as body from events where event_id % 10 > 0) e, json_tree(e.body) t where t.type = 'VARCHAR'"


# a tenth of the bodies is cut off and has no values
@register("e4_walk_json_urls", f"""select distinct id, url from (select id, trim(v) as url from ({_values})) where starts_with(url, 'http://') or starts_with(url, 'https://')
  or (starts_with(url, '/') and length(url) > 2 and (regexp_matches(lower(url), '[.](pdf|docx?|xlsx?|pptx?|csv|rtf|od[ts]|txt)$') or contains(lower(url), '/api/')
  or (length(url) - length(replace(url, '/', '')) >= 2 and not regexp_matches(lower(url), '[.](css|js|png|jpe?g|gif|svg|ico|woff2?|ttf|map|json|xml)$'))))""")
def _(spark, sf):
    return H.json_urls(load(spark, sf, "events").selectExpr("event_id as id", f"{JSON} as body"))


@register("e4_nav_urls", f"select distinct id, v as url from ({_values}) where lower(key) in ('url', 'href', 'link', 'path') and (starts_with(v, '/') or starts_with(v, 'http'))")
def _(spark, sf):
    return H.nav_urls(load(spark, sf, "events").selectExpr("event_id as id", f"{JSON} as body"))


@register("e5_api_hints", f"with {_rich_sql} select page_id, array_to_string(regexp_extract_all(html, '[\"''](/_?api/[^\"''\\s]+)[\"'']', 1)[1:20], ' ') as hints from rich")
def _(spark, sf):
    return _rich(spark, sf).select("page_id", F.array_join(H.api_hints(F.col("html")), " ").alias("hints"))


MAP = """'<urlset><url><loc>https://a.example.org/p' || o_orderkey || '</loc></url><loc> https://a.example.org/f' || o_orderkey % 13 || '.pdf </loc><loc>https://a.example.org/sitemap-' || o_orderkey % 3 || '.xml</loc></urlset> see https://c.example.org/bare/' || o_orderkey || ' or https://b.example.org/d' || o_orderkey % 17 || '.docx' || chr(10) || 'Sitemap: https://b.example.org/index' || o_orderkey % 4 || '.gz' || chr(10) || '  Disallow: /private/' || o_orderkey % 7 || chr(10) || 'disallow: /open' || chr(10) || 'Disallow: /tmp'"""
_low_path = "lower(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', ''))"
_is_doc = rf"(regexp_matches({_low_path}, '\.(?:pdf|doc|docx|xls|xlsx|ppt|pptx|csv)$') or regexp_matches(url, '(?i)\.pdf(\.aspx)?($|\?|#|;)') or regexp_matches(url, '(?i)/getattachment/.*\.pdf') or regexp_matches(url, '(?i)/(websitefile|sharedfile|downloadfile|getfile|filedownload|download\.ashx)(/|$|\?)') or (contains(lower(url), '.pdf') and regexp_matches(lower(url), '/wps/wcm/|getattachment')))"
_sitemap = rf"""m as (select o_orderkey as id, {MAP} as body from orders),
  u as (select distinct id, url, case when {_is_doc} then 'document' when contains(lower(url), 'sitemap') then 'sitemap' else 'page' end as kind from (select id, unnest(regexp_extract_all(body, '(?i)<loc>\s*([^<\s]+)\s*</loc>', 1) || regexp_extract_all(body, 'https?://[^\s"''<>]+')) as url from m)
    union all select id, unnest(regexp_extract_all(body, '(?im)^[ \t]*sitemap:[ \t]*(\S+)', 1)), 'sitemap' from m),
  k as (select id, url, max(kind) as kind from u group by 1, 2)"""


@register("e6_parse_sitemap", f"with {_sitemap} select * from k")
def _(spark, sf):
    return H.sitemap(load(spark, sf, "orders").selectExpr("o_orderkey as id", f"{MAP} as body"))


@register("e6_sitemap_of_site", rf"with {_sitemap} select * from k where kind = 'document' or regexp_extract(url, '^https?://([^/]*)', 1) in ('a.example.org')")
def _(spark, sf):
    return H.sitemap(load(spark, sf, "orders").selectExpr("o_orderkey as id", f"{MAP} as body"), site="a.example.org")


_paths = "select p_partkey as k, 'h' || p_partkey % 6 as host, case p_partkey % 4 when 0 then '/private/' || p_partkey % 11 || '/x' when 1 then '/tmp/' || p_partkey when 2 then '/tm' else '/open' end as path from part"


@register("e7_robots_blocked", rf"with b as (select distinct 'h' || o_orderkey % 5 as host, unnest(regexp_extract_all({MAP}, '(?m)^[ \t]*Disallow:[ \t]*(\S+)', 1)) as prefix from orders), u as ({_paths}) select distinct k from u join b on u.host = b.host and starts_with(u.path, b.prefix)")
def _(spark, sf):
    rules = H.robots_rules(load(spark, sf, "orders").selectExpr("'h' || o_orderkey % 5 as host", f"{MAP} as body"))
    load(spark, sf, "part").createOrReplaceTempView("part")
    return H.robots_blocked(spark.sql(_paths), rules)


SP = """html || case page_id % 4 when 0 then '<script>s = "/x/_vti_bin/y.asmx"; t = "/q/_api/web/lists?a=1&amp;b=2"; d = "/p/DataSources/z.aspx"</script>' when 1 then '<a href="/_layouts/15/x.aspx">in</a>{"ServerRelativeUrl" : "/Shared Documents"},{"ServerRelativeUrl":"/style"}' when 2 then '<script>s = "/x/_vti_bin/y.asmx"</script>' else '' end"""
_folder_names = " or ".join(f"contains(lower(f), '{w}')" for w in ("document", "media", "library", "pdf", "file", "knowledge", "research", "publication", "newsletter", "sdaia", "sector"))
_data = " || ".join(f"regexp_extract_all(h, '(?i)[\"'']({p})[\"'']', 1)" for p in ("[^\"'']*DataSources/[^\"'']+\\.aspx[^\"'']*", "[^\"'']*_vti_bin/[^\"'']+", "[^\"'']*_api/web/[^\"'']+", "[^\"'']*_api/search/[^\"'']+", "[^\"'']*listdata\\.svc[^\"'']*"))


@register("e8_sharepoint", f"""select page_id, contains(head, 'sharepoint') or contains(head, '_api/web') or contains(head, '_layouts/15') or contains(head, 'microsoftsharepoint') or page_id % 5 = 0 as is_sharepoint, array_to_string(list_transform({_data}, lambda u: replace(u, '&amp;', '&')), ' ') as data,
  array_to_string(list_filter(regexp_extract_all(h, '"ServerRelativeUrl"\\s*:\\s*"([^"]+)"', 1), lambda f: {_folder_names}), ' ') as folders from (select page_id, h, lower(substr(h, 1, 12000)) as head from (select page_id, {SP} as h from pages))""")
def _(spark, sf):
    p = load(spark, sf, "pages").selectExpr("page_id", f"{SP} as h", "case when page_id % 5 = 0 then 'SPRequestGuid: 1' end as headers")
    return p.select("page_id", H.looks_sharepoint(F.col("h"), F.col("headers")).alias("is_sharepoint"), F.array_join(H.sharepoint_endpoints(F.col("h")), " ").alias("data"), F.array_join(H.sharepoint_folders(F.col("h")), " ").alias("folders"))


SHELLS = """case page_id % 8 when 0 then null when 1 then '<div ID="root"></div>' || repeat('x', 1600) when 2 then repeat('z', 2500) || '<p ng-version="1">' || '<A href="/x">x</a>' when 3 then html || '<div id="__nuxt"></div>' when 4 then regexp_replace(html, '<a ', '<b ') || repeat('y', 9000) when 5 then repeat('k', 3000) || '<a href="/q">q</a>' when 6 then 'Request Rejected ' || repeat('id="app" ', 300) else html end"""
_shell_url = "case when page_id % 16 = 5 then 'https://x.example/KnowledgeCenter/' else url end"
_n = "len(regexp_extract_all(low, '<a '))"
_four = "(contains(low, 'id=\"root\"') or contains(low, 'id=\"app\"') or contains(low, 'id=\"__next\"') or contains(low, 'ng-version'))"
_shells = f"""select page_id, html is null as gone, length(html) < 1500 or (({_four} or contains(low, 'id="__nuxt"')) and {_n} = 0 and not contains(low, '<a' || chr(10))) or (length(html) > 8000 and {_n} < 3) as site,
  length(html) < 2000 or (not contains(low, 'request rejected') and ((contains(u, 'knowledgecenter') and {_n} < 8 and not contains(low, '.pdf')) or ({_four} and {_n} < 5))) as pipeline, length(html) < 1500 or ({_four} and {_n} = 0) as script, {_n} < 3 as few
  from (select page_id, html, lower(html) as low, lower(u) as u from (select page_id, {SHELLS.replace("regexp_replace(html, '<a ', '<b ')", "regexp_replace(html, '<a ', '<b ', 'g')")} as html, {_shell_url} as u from pages))"""


@register("e9_shell_pages", f"select page_id, coalesce(site, true) as site, coalesce(pipeline, true) as pipeline, coalesce(script, true) as script, gone or site or few as fallback from ({_shells})")
def _(spark, sf):
    h = F.col("html")
    return load(spark, sf, "pages").selectExpr("page_id", f"{SHELLS} as html", f"{_shell_url} as u").select(
        "page_id", H.looks_like_shell(h).alias("site"), H.looks_like_shell(h, F.col("u"), "pipeline").alias("pipeline"), H.looks_like_shell(h, profile="script").alias("script"), H.needs_fallback(h).alias("fallback")
    )


BODIES = """case k % 8 when 0 then 'Access Denied' when 1 then 'Just a moment... Checking your browser' when 2 then 'An article on forbidden cloudflare robots' when 3 then repeat('x', 4000) || 'captcha' when 4 then '<html>Your support ID is: 5</html>' when 5 then '<html>it was rejected</html>' when 6 then '<html>403 Forbidden</html>' else null end"""
_blocked = " or ".join(f"contains(head, '{m}')" for m in ("cf-challenge", "just a moment", "attention required", "access denied", "enable javascript and cookies", "verify you are human", "checking your browser", "captcha", "ddos protection", "403 forbidden"))


@register("e10_looks_blocked", f"select k, http_status in (403, 429) or http_status >= 500 or {_blocked} as blocked, contains(b[1:400], 'Request Rejected') or contains(b[1:400], 'support ID is') or (http_status = 200 and length(b) < 400 and contains(lower(b), '<html>') and contains(lower(b), 'rejected')) as rejected from (select k, http_status, b, lower(b[1:4000]) as head from (select k, http_status, coalesce({BODIES}, '') as b from runs))", "runs")
def _(spark, sf):
    rows = load(spark, sf, "runs").selectExpr("k", "http_status", f"{BODIES} as b")
    return rows.select("k", H.looks_blocked(F.col("http_status"), F.col("b")).alias("blocked"), H.is_rejected(F.col("http_status"), F.col("b")).alias("rejected"))


NEWS = """html || '<a href="/news/' || page_id || '/2024/">Press release number ' || page_id || '</a><a href="/2023/x' || page_id % 5 || '">A plain page of that year</a><a href="/n' || page_id || '">Consultation on the new bill and notice</a><a href="/home">home</a><a href="mailto:x@y.z">Press update by mail list</a><a href="/late#a">More</a><a href="/late#b">Bulletin on the &quot;late&quot; regulation</a><a href="/late">Second bulletin on the late bill</a>'"""
_news_score = " + ".join(f"case when contains(p, '{w}') or contains(lower(text), '{w}') then 1 else 0 end" for w in ("news", "press", "update", "circular", "consultation", "bulletin", "release", "gazette", "bill", "regulation", "notice"))


@register("e11_score_news_items", f"""with pages0 as (select page_id, url, {NEWS} as html from pages), {anchor_ctes('pages0')},
  s as (select *, {_news_score} as score from (select *, lower({X.path('url')}) as p from anchor_rows where regexp_matches(url, '(?i)^https?://')) where length(text) between 12 and 220 and lower(text) not in ('login', 'cookie', 'privacy policy', 'contact us', 'home', 'skip to')),
  o as (select page_id, url, min(pos) as pos, arg_min(text, pos) as text, arg_min(score, pos) as score from s where score > 0 or regexp_matches(p, '/[0-9]{{4}}/') group by 1, 2),
  f as (select *, row_number() over (partition by page_id order by pos) as nth from o)
  select page_id, url, text, score, rank from (select *, row_number() over (partition by page_id order by score desc, pos) as rank from f where nth <= 75) where rank <= 25""")
def _(spark, sf):
    return H.news_items(load(spark, sf, "pages").selectExpr("page_id", "url", f"{NEWS} as html"))


FEED = """case o_orderkey % 4 when 0 then '{"publications":[{"title":"Bill ' || o_orderkey || '","links":[{"url":"https://b.example.org/' || o_orderkey || '.pdf","contentType":"application/pdf"},{"url":"https://b.example.org/x.html","contentType":"text/html"}],"files":[{"url":"https://b.example.org/f' || o_orderkey % 50 || '","contentType":"application/pdf"}]}]}'
  when 1 then '{"results":[{"title":"Rule ' || o_orderkey || '","pdf_url":"https://r.example.org/' || o_orderkey % 90 || '.pdf"},{"title":"No file","pdf_url":null}],"total_pages":1}' when 2 then 'https://l.example.org/ukpga/' || o_orderkey || '/data.feed' else 'https://n.example.org/act/' || o_orderkey % 70 || '/contents.html' end"""
_kind = "case o_orderkey % 4 when 0 then 'bills' when 1 then 'register' when 2 then 'law' else 'act' end"


@register("e12_flatten_feed", """with r as (
  select o_orderkey as id, 'https://b.example.org/' || o_orderkey || '.pdf' as url, 'Bill ' || o_orderkey as title from orders where o_orderkey % 4 = 0 union all select o_orderkey, 'https://b.example.org/f' || o_orderkey % 50, 'Bill ' || o_orderkey from orders where o_orderkey % 4 = 0
  union all select o_orderkey, 'https://r.example.org/' || o_orderkey % 90 || '.pdf', 'Rule ' || o_orderkey from orders where o_orderkey % 4 = 1 union all select o_orderkey, 'https://l.example.org/ukpga/' || o_orderkey || '/data.pdf', '' from orders where o_orderkey % 4 = 2
  union all select o_orderkey, 'https://n.example.org/act/' || o_orderkey % 70 || '/latest/whole.pdf', '' from orders where o_orderkey % 4 = 3) select url, min(id) as id, arg_min(title, id) as title from r group by url""")
def _(spark, sf):
    return H.flatten_feed(load(spark, sf, "orders").selectExpr("o_orderkey as id", f"{_kind} as kind", f"{FEED} as body"))


RULES = [("example.org", "/bills"), ("gov.example", "/en/laws"), ("beta.example.org", "/gazette"), ("gov.example", "/ar/laws")]


@register("e13_route_seeds", f"select distinct k, {X.scheme('url')} || '://' || {X.host('url')} || path as seed from registry join (values {', '.join(f'({chr(39)}{m}{chr(39)}, {chr(39)}{p}{chr(39)})' for m, p in RULES)}) r(marker, path) on {X.host('url')} = marker or ends_with({X.host('url')}, '.' || marker)", "registry")
def _(spark, sf):
    return H.route_seeds(load(spark, sf, "registry"), spark.createDataFrame(RULES, "marker string, path string"))


# hosts that hold the markers of the groups, alone, below another name or inside a longer one
_marked = "case k % 4 when 0 then 'https://' || host when 1 then 'https://www.' || host || '/en/x' when 2 then 'http://docs.' || host || ':8080/y' else 'https://not' || host || '.example/z' end"
MARKERS = [m for marks, _, _ in T.GROUPS.values() for m in marks]
_hosts = f"list_extract([{', '.join(f"'{m}'" for m in [*MARKERS, 'other.example'])}], cast(k % {len(MARKERS) + 1} + 1 as int))"


def marked_sources(spark, sf):
    """The registry (k, url) with the groups' hosts."""
    hosts = F.array(*[F.lit(m) for m in [*MARKERS, "other.example"]])
    return load(spark, sf, "registry").select("k", F.get(hosts, F.col("k") % (len(MARKERS) + 1)).alias("host")).selectExpr("k", f"{_marked} as url")


_listed = ", ".join(f"('{m}', '{g}', '{page}')" for g, (marks, pages, _) in T.GROUPS.items() for m in marks for page in pages)


@register("e13_listing_seeds", f"""select distinct k, "group", seed from (select k, {_marked} as url from (select k, {_hosts} as host from registry)) join (values {_listed}) r(marker, "group", seed) on contains({X.host('url')}, marker)""", "registry")
def _(spark, sf):
    return T.listing_seeds(marked_sources(spark, sf))


DEEP = [("example.org", "https://example.org/Documents/"), ("gov.example", "https://gov.example/laws/en.pdf"), ("beta.example.org", "https://rules.beta.example.org/en"), ("sansad.in", "https://sansad.in/ls/rules")]


@register("e13_legal_seeds", f"""select distinct k, seed from (select k, {_site} || p as seed from s cross join (values {', '.join(f"('{p}')" for p in T.LEGAL_PATHS)}) v(p) where {_site} <> ''
  union all select k, seed from s join (values {', '.join(map(str, DEEP))}) d(marker, seed) on {X.host('url')} = marker or ends_with({X.host('url')}, '.' || marker))""".replace("select distinct", f"with s as (select k, {_marked} as url from (select k, {_hosts} as host from registry) union all select -1 - k, url from registry) select distinct", 1), "registry")
def _(spark, sf):
    sources = marked_sources(spark, sf).unionByName(load(spark, sf, "registry").selectExpr("-1 - k as k", "url"))
    return T.legal_seeds(sources, spark.createDataFrame(DEEP, "marker string, seed string"))


_names = list(T.GROUPS)
_links = """select k, "group", case k % 5 when 0 then url || '/act/public/' || k || '/whole.html' when 1 then 'https://x.example/PDF/' || k when 2 then 'https://x.example/t/' || k else url end as url,
  case k % 7 when 0 then 'Download' when 1 then 'as PDF' when 2 then null else title end as text from (select k, url, title, list_extract([{}], cast(k % {} + 1 as int)) as "group" from downloads)""".format(", ".join(f"'{g}'" for g in [*_names, "none"]), len(_names) + 1)


@register("e13_group_links", f"""with l as ({_links}), t as (select k, "group", url, coalesce(text, '') as text, lower(url) as u, lower(coalesce(text, '')) as x, regexp_matches(lower(url || ' ' || coalesce(text, '')), 'bill|amend|act|law|gazette|regulation|statut|pdf') as bill from l where "group" <> 'none')
  select distinct k, "group", url, text from t where contains(u, '.pdf') or case "group" when 'germany' then false when 'japan' then false when 'eu' then contains(x, 'pdf') when 'spain' then contains(u, '/pdf') or contains(x, 'pdf') when 'australia' then bill or contains(text, 'Download') else bill end
  union select k, "group", replace(url, '/whole.html', '') || '/latest/whole.pdf', text from t where "group" = 'new zealand' and (contains(url, '/act/') or contains(url, '/bill/'))""", "downloads")
def _(spark, sf):
    group = F.get(F.array(*[F.lit(g) for g in [*_names, "none"]]), F.col("k") % (len(_names) + 1)).alias("group")
    links = load(spark, sf, "downloads").select(
        "k", group, F.expr("case k % 5 when 0 then url || '/act/public/' || k || '/whole.html' when 1 then 'https://x.example/PDF/' || k when 2 then 'https://x.example/t/' || k else url end as url"),
        F.expr("case k % 7 when 0 then 'Download' when 1 then 'as PDF' when 2 then null else title end as text"),
    )
    return T.group_links(links)


@register("e14_clean_text", r"select id, trim(regexp_replace(regexp_replace(string_agg(text, chr(10) || chr(10) order by page), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) as text from (select floor(doc_id / 4)::bigint as id, doc_id % 4 as page, replace(text, '. ', '.   ' || chr(10) || chr(10) || chr(10)) as text from documents) group by id")
def _(spark, sf):
    pages = load(spark, sf, "documents").selectExpr("cast(floor(doc_id / 4) as bigint) as id", "doc_id % 4 as page", "replace(text, '. ', concat('.   ', char(10), char(10), char(10))) as text")
    return H.clean_text(pages, None, None)


_ascii = r"regexp_replace(text, '[^\x01-\x7E]', '{}', 'g')"


@register("e15_decode_text", rf"""select doc_id, case doc_id % 5 when 0 then regexp_replace('{{\rtf1\ansi ' || a || '}}', '\\[a-z]+-?[0-9]* ?', ' ', 'g') || '“' when 1 then regexp_replace('<p>' || text || '</p>', '<[^>]+>', ' ', 'g') when 2 then a || '“q”€' when 3 then a || chr(129) || chr(147) else text end as text
  from (select doc_id, text, {_ascii.format('')} as a from documents)""")
def _(spark, sf):
    kind = F.when(F.col("doc_id") % 5 == 0, "RTF").when(F.col("doc_id") % 5 == 1, "ODT").otherwise("TXT")
    ascii_part = "encode(regexp_replace(text, '[^\\\\x01-\\\\x7E]', ''), 'UTF-8')"
    body = f"""case doc_id % 5 when 0 then encode('{{\\\\rtf1\\\\ansi ', 'UTF-8') || {ascii_part} || encode('}}', 'UTF-8') || X'8193' when 1 then encode('<p>' || text || '</p>', 'UTF-8') when 2 then {ascii_part} || X'93719480' when 3 then {ascii_part} || X'8193' else encode(text, 'UTF-8') end"""
    return load(spark, sf, "documents").select("doc_id", H.decode_text(F.expr(body), kind, None).alias("text"))


@register("e16_scanned", "select doc_id, doc_id % 2 = 0 and length(trim(text)) < 40 as scanned from documents")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", H.is_scanned(F.when(F.col("doc_id") % 2 == 0, "PDF").otherwise("TXT"), F.col("text")).alias("scanned"))


@register("e17_classify_responses", "with r as (select k, url, http_status + case when k % 13 = 0 then 404 else 0 end as status, case when k % 7 = 0 then 'text/html' else 'application/pdf' end as ct, case k % 5 when 0 then '' when 1 then 'oops' else '%PDF-' || k % 400 end as body from runs), o as (select *, case when status >= 400 then 'http_' || status when body = '' then 'empty' when contains(ct, 'html') then 'not_pdf' when body[1:4] <> '%PDF' then 'missing_magic' else 'ok' end as outcome from r) select k, url, case when outcome = 'ok' and row_number() over (partition by outcome, body order by k) > 1 then 'duplicate' else outcome end as outcome from o", "runs")
def _(spark, sf):
    rows = load(spark, sf, "runs").selectExpr("k", "url", "http_status + case when k % 13 = 0 then 404 else 0 end as status", "case when k % 7 = 0 then 'text/html' else 'application/pdf' end as content_type", "cast(case k % 5 when 0 then '' when 1 then 'oops' else concat('%PDF-', k % 400) end as binary) as body")
    return H.classify_responses(rows)


REPLY = """case k % 4 when 0 then '```json' || chr(10) || '{"summary":" S' || k || '","key_points":["a"," ","b","c","d","e","f","g","h","i","j","k","l"],"document_type":" Bill "}' || chr(10) || '```' when 1 then 'Sure: {"summary":"S' || k || '","topics":["1","2","3","4","5","6","7","8","9"]} ok' when 2 then '{"summary":"S' || k || '"}' else 'no object' end"""


@register("e18_fenced_json", "select k, case when k % 4 < 3 then 'S' || k end as summary, case k % 4 when 0 then 'a b c d e f g h i j' when 3 then null else '' end as points, case k % 4 when 1 then '12345678' when 3 then null else '' end as topics, case k % 4 when 0 then 'bill' when 3 then null else 'other' end as kind from runs", "runs")
def _(spark, sf):
    rows = load(spark, sf, "runs").selectExpr("k", f"{REPLY.replace('chr(10)', 'char(10)')} as reply").select("k", H.coerced_reply(F.col("reply")).alias("o"))
    return rows.select("k", F.col("o.summary").alias("summary"), F.array_join("o.key_points", " ").alias("points"), F.array_join("o.topics", "").alias("topics"), F.col("o.document_type").alias("kind"))


_stop = "[" + ", ".join(f"'{w}'" for w in Q.STOP) + "]"
_tok = lambda x: f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]{{3,}}') || regexp_extract_all(lower({x}), '[\\x{{0600}}-\\x{{06FF}}]{{2,}}')), lambda t: not list_contains({_stop}, t))"


@register("r1_tokenize", f"select doc_id, array_to_string(list_sort({_tok('text')}), ' ') as tokens from documents")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.array_join(F.sort_array(Q.tokens(F.col("text"))), " ").alias("tokens"))


def _questions(spark, sf):
    return load(spark, sf, "benchmark").selectExpr("item_id as qid", "text as question")


# every question against every document, each point by its own test
_retrieved = f"""q as (select item_id as qid, lower(trim(text)) as raw, {_tok('text')} as qt from benchmark), d as (select id, lower(title) as title, lower(jurisdiction) as place, lower(summary) as summary, {_tok("title || ' ' || jurisdiction || ' ' || summary")} as dt, {_tok('title')} as tt from corpus),
  s as (select qid, id, len(list_intersect(qt, dt)) + 4 * len(list_intersect(qt, tt)) + 2 * len(list_filter(qt, lambda t: contains(place, t))) + 2 * len(list_filter(qt, lambda t: length(t) >= 4 and contains(title, t))) + len(list_filter(qt, lambda t: length(t) >= 4 and contains(summary, t))) + case when length(raw) >= 6 and contains(title, raw[1:40]) then 6 else 0 end as score from q, d),
  c as (select *, max(score) over (partition by qid) as best from s where score >= 1), hits as (select qid, id, score, rank from (select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from c where score >= case when best >= 6 then greatest(1, best * 0.35) else 1 end) where rank <= 8)"""


@register("r2_retrieve", f"with {_retrieved} select * from hits", "corpus")
def _(spark, sf):
    return Q.retrieve(_questions(spark, sf), load(spark, sf, "corpus"))


def _passages_sql(step: int, width: int, least: int, once: int | None = None) -> str:
    """CTE passages."""
    from_ = "g" if once is None else f"(select * from (select *, row_number() over (partition by qid, id, passage[1:{once}] order by score desc, start) as same from g) where same = 1)"
    return f"""w as (select h.qid, h.id, s as start, trim(text[s + 1:s + {width}]) as passage from (select qid, h.id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, {step})) as s from hits h join documents on doc_id = h.id where rank <= 3) h),
  g as (select * from (select w.qid, w.id, passage, start, len(list_intersect(qt, {_tok('passage')})) as score from w join q on q.qid = w.qid where length(passage) >= {least}) where score >= 1),
  passages as (select qid, id, passage, score, start, nth from (select *, row_number() over (partition by qid, id order by score desc, start) as nth from {from_}) where nth <= 3)"""


@register("r3_passages", f"with {_retrieved}, {_passages_sql(500, 650, 50)} select * from passages", "corpus")
def _(spark, sf):
    corpus, questions = load(spark, sf, "corpus"), _questions(spark, sf)
    return Q.passages(Q.retrieve(questions, corpus), questions, corpus)


# the best passages of every document for one question
@register("w4_top_passages", f"with q as (select 1 as qid, {_tok(chr(39) + 'What do tion ther thon thre thnt thes thhe and thha say' + chr(39))} as qt), hits as (select 1 as qid, id, 1 as rank from corpus), {_passages_sql(500, 650, 50)} select id, passage, score, start, nth from passages", "corpus")
def _(spark, sf):
    corpus = load(spark, sf, "corpus")
    question = spark.createDataFrame([(1, "What do tion ther thon thre thnt thes thhe and thha say")], "qid int, question string")
    return Q.passages(corpus.select(F.lit(1).alias("qid"), "id", F.lit(1).alias("rank")), question, corpus).drop("qid")


@register("r3_passages_client", f"with {_retrieved}, {_passages_sql(400, 550, 40, 80)} select * from passages", "corpus")
def _(spark, sf):
    corpus, questions = load(spark, sf, "corpus"), _questions(spark, sf)
    return Q.passages(Q.retrieve(questions, corpus), questions, corpus, 400, 550, least=40, once=80)


_points = " + ".join(f"case when contains(lower(x), '{w}') then 1 else 0 end" for w in Q.LEGAL_WORDS)
_topics = f"tw as (select id, unnest(l) as word, unnest(range(len(l))) as pos from (select id, regexp_extract_all(lower(text), '[a-z]{{5,}}') as l from corpus)), tc as (select id, word, count(*) as c, min(pos) as p from tw where word not in ({', '.join(chr(39) + w + chr(39) for w in R.TOPIC_STOP)}) group by 1, 2), tt as (select id, string_agg(word, ',' order by r) as topics from (select *, row_number() over (partition by id order by c desc, p) as r from tc) where r <= 6 group by id)"


_summarised = f"""{_topics}, s4 as (select id, unnest(l) as x0, unnest(range(len(l))) as pos from (select id, regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') as l from corpus)), c4 as (select id, pos, trim(x0) as x from s4 where length(trim(x0)) between 40 and 400),
  r4 as (select id, x, row_number() over (partition by id order by {_points} desc, length(x) desc, pos) as r from c4), k4 as (select id, list(x order by r) as kp from r4 where r <= 5 group by id),
  j4 as (select corpus.id, title, text, coalesce(kp, [text[1:500]]) as kp, coalesce(topics, '') as topics from corpus left join k4 on corpus.id = k4.id left join tt on corpus.id = tt.id)"""


@register("r4_extractive_summary", f"""with {_summarised}
  select id, case when trim(text) = '' then 'No extractable text (may be scanned/image-only PDF).' else trim(case when title <> '' then title || '. ' else '' end || array_to_string(kp, ' ')[1:1200]) end as summary, case when trim(text) = '' then '' else array_to_string(kp, '|') end as key_points, case when trim(text) = '' then '' else topics end as topics, case when trim(text) = '' then 'empty' else 'extractive' end as method from j4""", "corpus")
def _(spark, sf):
    return Q.extractive_summaries(load(spark, sf, "corpus")).withColumn("key_points", F.array_join("key_points", "|"))


# documents of every third id have no key points
@register("r5_answers", f"""with {_retrieved}, {_passages_sql(500, 650, 50)}, {_summarised.replace('tt as', 'tt5 as').replace('join tt on corpus.id = tt.id', 'join tt5 on corpus.id = tt5.id')},
  l as (select h.qid, h.rank, case when h.id % 3 > 0 then array_to_string(list_transform(kp[1:2], lambda p: '• [' || h.rank || '] ' || p), chr(10)) else '• [' || h.rank || '] ' || c.summary[1:260] end || case when p.passage is not null then chr(10) || '  “' || p.passage[1:280] || '”' else '' end as line, '[' || h.rank || '] ' || c.title || ' — ' || c.url as ref
    from hits h join corpus c on c.id = h.id join j4 on j4.id = h.id left join passages p on p.qid = h.qid and p.id = h.id and p.nth = 1),
  a as (select qid, string_agg(line, chr(10) order by rank) filter (rank <= 6) as ls, string_agg(ref, chr(10) order by rank) as refs, count(*) as n from l group by qid)
  select q.qid, case when n is null then 'I could not find relevant summaries for that question yet.' else 'Answer:' || chr(10) || ls || chr(10) || chr(10) || 'References:' || chr(10) || refs end as answer, coalesce(n, 0) as n from q left join a on a.qid = q.qid""", "corpus")
def _(spark, sf):
    corpus, questions = load(spark, sf, "corpus"), _questions(spark, sf)
    hits = saved(Q.retrieve(questions, corpus))
    best = Q.passages(hits, questions, corpus, top=1).select("qid", "id", "passage")
    wanted = corpus.join(hits.select("id").distinct(), "id", "left_semi")
    points = Q.extractive_summaries(wanted).select("id", F.when(F.col("id") % 3 > 0, F.col("key_points")).alias("key_points"))
    return Q.answers(questions, hits.join(best, ["qid", "id"], "left"), wanted.join(points, "id", "left"))


_shown = ("case when id % 4 = 0 then '' else url || '?open' end as open_url", "'law' as document_type", "case when id % 5 = 0 then 'llm' else 'extractive' end as method")


@register("r6_publish_summaries", f"select id, title, jurisdiction, source_kind, url, coalesce(nullif(open_url, ''), url) as open_url, cast(null as varchar) as source_page, summary, case when id % 3 > 0 then title else '' end as key_points, '' as topics, document_type, method, summarized_at from (select *, {', '.join(_shown)} from corpus) order by summarized_at desc, id limit 5000", "corpus")
def _(spark, sf):
    rows = load(spark, sf, "corpus").selectExpr("*", *_shown, "case when id % 3 > 0 then array(title) end as key_points")
    return Q.publish_summaries(rows).withColumns({c: F.array_join(c, ",") for c in ("key_points", "topics")})


@register("r6_publish_meta", "select least(count(*), 5000) as count, count(*) as total_indexed, max(summarized_at) as updated_at from corpus", "corpus")
def _(spark, sf):
    return Q.publish_meta(load(spark, sf, "corpus"))


@register("r7_corpus_answer", "select jurisdiction, count(*) as n, count_if(length(summary) > 20) as with_summary, min(url) as first_url from corpus group by 1", "corpus")
def _(spark, sf):
    return Q.corpus_status(load(spark, sf, "corpus"))


@register("r7_corpus_listing", "select n, id, title, jurisdiction, url, '[' || n || '] ' || title || ' (' || jurisdiction || ')' as line from (select row_number() over (order by id) as n, id, case when title = '' then 'Untitled' else title end as title, jurisdiction, url from corpus)", "corpus")
def _(spark, sf):
    return Q.corpus_listing(load(spark, sf, "corpus"), F.col("id"))


# one cut after another, by recursion over the rest of each text
@register("r8_chunk_text", r"""with recursive c as (select doc_id as id, -1 as n, cast(null as varchar) as chunk, coalesce(text, '') as rest from documents union all
  select id, n + 1, case when length(rest) <= 900 then rest else rest[1:cut] end, case when length(rest) <= 900 then '' else ltrim(rest[cut + 1:], e' \t\n\r\x0b\x0c') end from (select *, case when sp between 360 and 900 then sp when nl between 360 and 900 then nl else 900 end as cut from (select *, 901 - strpos(reverse(rest[1:901]), ' ') as sp, 901 - strpos(reverse(rest[1:901]), chr(10)) as nl from c where rest <> '')))
  select id, n, chunk from c where n >= 0""")
def _(spark, sf):
    return Q.chunk_text(load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


_apis = f"apis as (select distinct page_id, site || p as url from (select page_id, site, unnest(list_distinct(regexp_extract_all(html, '[\"''](/_?api/[^\"''\\s]+)[\"'']', 1))[1:40]) as p from rich))"
_methods = "['href', 'embed', 'embedded-url', 'getattachment', 'quoted-path', 'script', 'api']"
EDGES = f"""{_rich_sql}, {anchor_ctes('rich')}, {EMBEDS}, named as ({_documents_sql(('embedded-url', 'getattachment', 'quoted-path', 'script'))}), {_apis},
  f as (select page_id, url, 'href' as method, text[1:300] as text from anchors union all select page_id, url, 'embed', '' from embeds union all select page_id, url, method, '' from named union all select page_id, url, 'api', '' from apis),
  g as (select p.url as src, f.url as dst, list_position({_methods}, method) as o, method, text from f join pages p on p.page_id = f.page_id where regexp_matches(f.url, '(?i)^https?://')),
  h as (select src, dst, arg_min(method, o) as method, min(text) filter (o = m) as text from (select *, min(o) over (partition by src, dst) as m from g) group by 1, 2),
  edges as (select src, dst, case when {_is_doc.replace('url', 'dst')} then 'document' when {X.host('dst')} = {X.host('src')} or ends_with({X.host('dst')}, '.' || {X.host('src')}) or ends_with({X.host('src')}, '.' || {X.host('dst')}) then 'same_site' else 'off_site' end as kind, method, text from h)"""


@register("g1_link_edges", f"with {EDGES} select * from edges")
def _(spark, sf):
    return G.link_edges(_rich(spark, sf))


# trees: the page of a customer leads to two others by the orders that were placed, and to the next site's first page
_home = lambda n: f"'https://s' || (({n}) % 5) || '.example.org/'"
_page = lambda i: f"{_home('o_custkey')} || case ({i}) % 3 when 0 then 'laws/' when 1 then 'news/' else 'x/' end || ({i})"
_at = "cast(floor(o_custkey / 5) as int)"
ORDER_EDGES = f"""select distinct {_page(_at)} as src, {_page(f'2 * {_at} + 1 + cast(o_orderkey % 2 as int)')} as dst from orders
  union select distinct {_page(_at)}, {_home('o_custkey + 1')} || 'laws/0' from orders"""
# a seed for every page of the first three levels
ORDER_SEEDS = f"select distinct {_page(_at)} as seed, {_page(_at)} as url, o_custkey % 7 + 2 as max_pages from orders where o_custkey < 35"
_seed_site = lambda c: f"split_part({c}, '/', 3)"


@register("g2_crawl_closure", f"with recursive e as ({ORDER_EDGES}), c as (select seed, url from ({ORDER_SEEDS}) union select seed, dst from e join c on e.src = c.url where {_seed_site('dst')} = {_seed_site('seed')}) select seed, url from c")
def _(spark, sf):
    load(spark, sf, "orders").createOrReplaceTempView("orders")
    return G.crawl(spark.sql(ORDER_EDGES), spark.sql(ORDER_SEEDS).drop("max_pages")).select("seed", "url")


_queue = lambda u: f"case when {X.matches(X.path(u), U.LEGAL_PATH)} or {X.matches(u, U.LEGAL_PATH)} then 0 else 1 end, case when regexp_matches(lower({u}), '{U.FIRST_PAGES}') then 0 when regexp_matches(lower({u}), '{U.SECOND_PAGES}') then 1 else 2 end, {u}"


def _budget_sql(rounds: int) -> str:
    """The rounds of a crawl with budgets and two pages a round, spelled out: w waits, v was visited."""
    ctes = [f"e as materialized ({ORDER_EDGES})", f"s as materialized ({ORDER_SEEDS})", "w0 as (select seed, url, 0 as depth from s)", "v0 as (select seed, url, depth from w0 where false)"]
    for i in range(rounds):
        ctes += [
            f"""t{i} as materialized (select seed, url, depth from (select w.*, row_number() over (partition by w.seed order by {_queue('w.url')}) as r, max_pages - (select count(*) from v{i} where v{i}.seed = w.seed) as budget from w{i} w join s on s.seed = w.seed) where r <= least(2, budget))""",
            f"v{i + 1} as materialized (select * from v{i} union all select * from t{i})",
            f"""w{i + 1} as materialized (select * from w{i} where (seed, url) not in (select (seed, url) from t{i}) union all
  select seed, dst, min(depth) + 1 from t{i} join e on src = url where {_seed_site('dst')} = {_seed_site('seed')} and (seed, dst) not in (select (seed, url) from v{i + 1}) and (seed, dst) not in (select (seed, url) from w{i}) group by seed, dst)""",
        ]
    return f"with {', '.join(ctes)} select * from v{rounds}"


# budgets of two to eight pages a seed are spent in eight rounds at most
@register("g2_crawl_budgets", _budget_sql(8))
def _(spark, sf):
    load(spark, sf, "orders").createOrReplaceTempView("orders")
    return G.crawl(spark.sql(ORDER_EDGES), spark.sql(ORDER_SEEDS), per_round=2)


@register("g2_crawl_documents", f"with {EDGES}, v as (select distinct url as seed, url, 0 as depth from pages), d as (select seed, dst, src, text, method, row_number() over (partition by seed, dst order by depth, src) as r from edges join v on v.url = src where kind = 'document' and ({X.host('dst')} = {X.host('seed')} or ends_with({X.host('dst')}, '.' || {X.host('seed')}) or ends_with({X.host('seed')}, '.' || {X.host('dst')}))) select seed, dst as url, src as source_page, text, method from d where r = 1")
def _(spark, sf):
    """Every page is the seed of a crawl of its own."""
    edges = saved(G.link_edges(_rich(spark, sf)))
    seeds = load(spark, sf, "pages").select(F.col("url").alias("seed"), "url")
    return G.crawl_documents(G.crawl(edges, seeds, max_depth=0), edges, seeds)


@register("g3_frontier_order", f"select *, row_number() over (partition by queue order by priority, url, k) as place from (select k, url, case when {X.matches(X.path('url'), U.LEGAL_PATH)} or {X.matches('url', U.LEGAL_PATH)} then 0 when {X.matches(X.path('url'), U.JUNK_PATH)} then 2 else 1 end as queue, case when regexp_matches(lower(url), '{U.FIRST_PAGES}') then 0 when regexp_matches(lower(url), '{U.SECOND_PAGES}') then 1 else 2 end as priority from downloads)", "downloads")
def _(spark, sf):
    return G.frontier_order(load(spark, sf, "downloads"))


VISITS = "select url, page_id as seq, case when page_id % 9 = 0 then 'error' else 'ok' end as status, case when page_id % 7 = 3 then 4 else 0 end as links from pages"


@register("g4_site_reports", f"""with {EDGES}, v as (select {X.host('url')} as site, * from ({VISITS})), l as (select {X.host('src')} as site, count(distinct dst) filter (kind = 'document') as documents, count_if(kind = 'document') as document_links, count_if(kind = 'same_site') as same_site_links, count_if(kind = 'off_site') as off_site_links from edges group by 1),
  p as (select site, count(distinct url) as pages, count_if(status <> 'ok') as errors from v group by 1), e as (select distinct site from (select site, sum(case when links > 0 then 1 else 0 end) over (partition by site order by seq) as i, links from v where status = 'ok') where links = 0 group by site, i having count(*) >= 2)
  select coalesce(p.site, l.site) as site, coalesce(pages, 0) as pages, coalesce(errors, 0) as errors, coalesce(documents, 0) as documents, coalesce(document_links, 0) as document_links, coalesce(same_site_links, 0) as same_site_links, coalesce(off_site_links, 0) as off_site_links, e.site is not null as empty_streak
  from p full join l on p.site = l.site left join e on e.site = coalesce(p.site, l.site)""")
def _(spark, sf):
    load(spark, sf, "pages").createOrReplaceTempView("pages")
    return G.site_reports(G.link_edges(_rich(spark, sf)), spark.sql(VISITS), 2)


def _written(spark, write) -> str:
    """A new path in the shared folder, after ``write`` (path) has filled it."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    write(path)
    return path


@register("s1_read_json_table", "select k, nullif(trim(title), '') as title, nullif(trim(jurisdiction), '') as jurisdiction, bytes from downloads union all select -1, null, null, count(*) from downloads where false", "downloads")
def _(spark, sf):
    """A JSON array for every thousand downloads, each in a file of its own, read back together; a missing file is an empty table."""
    d = load(spark, sf, "downloads").select("k", F.to_json(F.struct("k", "title", "jurisdiction", "bytes")).alias("j"))
    arrays = d.groupBy(F.floor(F.col("k") / 1000)).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("j"), ",\n"), F.lit("\n]")).alias("value")).select("value")
    path = _written(spark, lambda p: arrays.write.option("maxRecordsPerFile", 1).text(p))
    schema = "k long, title string, jurisdiction string, bytes long"
    missing = S.read_json_table(spark, f"{path}-not-there", schema)
    return S.read_json_table(spark, f"{path}-not-there", schema, path).where("k is not null").unionByName(missing).unionByName(missing.agg(F.count("*").alias("bytes")).selectExpr("cast(-1 as bigint) as k", "cast(null as string) as title", "cast(null as string) as jurisdiction", "bytes"))


@register("s2_read_jsonl_latest", "select id, summary, summarized_at from (select *, row_number() over (partition by id order by summarized_at desc) as r from (select k % 300 as id, case when k % 11 = 0 then '  ' else 'Summary ' || k end as summary, '2024-' || lpad(cast(k as varchar), 9, '0') as summarized_at from downloads where k % 13 <> 5)) where r = 1 and trim(summary) <> ''", "downloads")
def _(spark, sf):
    """Lines are appended in two batches; every thirteenth is malformed."""
    d = load(spark, sf, "downloads").select("k", (F.col("k") % 300).alias("id"), F.when(F.col("k") % 11 == 0, "  ").otherwise(F.concat(F.lit("Summary "), F.col("k").cast("string"))).alias("summary"), F.concat(F.lit("2024-"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("summarized_at"))
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    S.append_jsonl(d.where("k % 2 = 0 and k % 13 <> 5").drop("k"), path)
    S.append_jsonl(d.where("k % 2 = 1 and k % 13 <> 5").drop("k"), path)
    d.where("k % 13 = 5").select(F.concat(F.lit('{"id": '), F.col("k").cast("string"), F.lit(', "summary": "cut')).alias("value")).write.mode("append").text(path)
    return S.read_jsonl_latest(spark, path, "id long, summary string, summarized_at string")


def _manifest(spark, sf):
    """The downloads as nested manifests of a thousand rows, so that their number grows and not their size."""
    d = load(spark, sf, "downloads")
    row = lambda test, *c: F.collect_list(F.when(test, F.struct(*c)))
    return d.groupBy(F.floor(F.col("k") / 1000).alias("part")).agg(
        row(F.lit(True), "k", "url", "bytes", (F.col("k") % 10 == 0).alias("dry_run")).alias("downloads"), row(F.col("status") == "download_failed", "k", "url", "status").alias("errors"),
        row(F.col("discovery_method") == "sitemap", "k", "url", "discovery_method").alias("discovered"), row(F.col("k") % 100 == 0, "k", "jurisdiction", "source_kind").alias("source_reports"),
    )


@register("s3_explode_manifest", "select 'downloads' as part, k, url as value from downloads where k % 10 <> 0 union all select 'errors', k, url from downloads where status = 'download_failed' union all select 'discovered', k, url from downloads where discovery_method = 'sitemap' union all select 'source_reports', k, source_kind from downloads where k % 100 = 0", "downloads")
def _(spark, sf):
    parts = S.explode_manifest(saved(_manifest(spark, sf)))
    one = lambda n, c: parts[n].select(F.lit(n).alias("part"), "k", F.col(c).alias("value"))
    return one("downloads", "url").unionByName(one("errors", "url")).unionByName(one("discovered", "url")).unionByName(one("source_reports", "source_kind"))


@register("s5_records_from_sheet", "select cast(k as varchar) as Key, nullif(trim(title), '') as Title, cast(bytes as varchar) as Title_2, cast(2000 + k % 30 as varchar) || '-01-05' as \"Publication date\", nullif(trim(jurisdiction), '') as col_5 from downloads where k % 17 > 0", "downloads")
def _(spark, sf):
    """A grid with a header in its second row: a name with a line end, one twice, one blank; blank rows; numbers, dates with times."""
    some = lambda c: F.when(F.col("k") % 17 > 0, c)
    d = load(spark, sf, "downloads")
    body = d.select((F.col("k") + 10).alias("row"), some(F.concat(F.col("k").cast("string"), F.lit(".0"))).alias("c0"), some(F.concat(F.lit(" "), "title")).alias("c1"), some(F.col("bytes").cast("string")).alias("c2"), some(F.concat((2000 + F.col("k") % 30).cast("string"), F.lit("-01-05 00:00:00"))).alias("c3"), some(F.col("jurisdiction")).alias("c4"))
    head = spark.createDataFrame([(0, "a note", None, None, None, None), (1, "Key", "Title", "Title", "Publication\ndate", None)], "row long, c0 string, c1 string, c2 string, c3 string, c4 string")
    return S.records_from_sheet(head.unionByName(body), 1).drop("row")


# a second of the links that don't work say so in their own cell
@register("s6_seed_sources", """select region, nullif(jurisdiction, '') as jurisdiction, nullif(authority, '') as authority, nullif(authority_type, '') as authority_type, nullif(link_nature, '') as link_nature, nullif(u, '') as url, nullif(segment, '') as segment, coalesce(nullif(frequency, ''), 'Monthly') as frequency,
  array_to_string(list_filter([nullif(topics, ''), nullif(n_name, '')], lambda x: x is not null), '|') as topics, case when contains(lower(link_nature), 'not working') then 'broken' when u = '' then 'missing_url' when contains(u, 'NOT WORKING') then 'broken' else 'active' end as status, 'primary' as source_kind
  from (select *, trim(case when k % 8 = 3 then url || ' (NOT WORKING)' else url end) as u from registry)""", "registry")
def _(spark, sf):
    """The sheet is read as raw cells under a header row and mapped by its headers."""
    names = ["Region", "Jursidictions", S.PRIMARY["authority"][0], "Nature of Authority", "Nature of weblink", "Website links", "Segment (Private, Capital, Enterprise)", "Topic", "Sub Category", "Frequency", "Old Frequency"]
    url = F.when(F.col("k") % 8 == 3, F.concat("url", F.lit(" (NOT WORKING)"))).otherwise(F.col("url"))
    cells = ["region", "jurisdiction", "authority", "authority_type", "link_nature", url, "segment", "topics", "n_name", "frequency", F.lit("Monthly")]
    grid = load(spark, sf, "registry").select((F.col("k") + 1).alias("row"), *[(F.col(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(cells)])
    head = spark.createDataFrame([(0, *names)], "row long, " + ", ".join(f"c{i} string" for i in range(len(names))))
    return S.seed_sources(S.records_from_sheet(head.unionByName(grid))).withColumn("topics", F.array_join("topics", "|"))


@register("s6_seed_tracking", "select k as kmp_id, nullif(country, '') as country, nullif(law_area, '') as law_area, trim(link) as link, nullif(trim(remarks), '') as remarks, coalesce(nullif(date_of_publication, ''), date_of_tracking) as date_of_publication, coalesce(nullif(alert_status, ''), 'new') as alert_status from (select * replace (cast(k as varchar) as k) from tracking)", "tracking")
def _(spark, sf):
    names = ["KMP ID", "Country", "Law Area", "Link for update", "Remarks/Reasons for tracking", S.TRACKED["date_of_publication"], "Publication (own)", "Alert Status"]
    cells = ["k", "country", "law_area", "link", "remarks", "date_of_publication", "date_of_tracking", "alert_status"]
    sheet = load(spark, sf, "tracking").select(*[F.trim(F.col(c).cast("string")).alias(n) for c, n in zip(cells, names)])
    return S.seed_tracking(sheet).select("kmp_id", "country", "law_area", "link", "remarks", "date_of_publication", "alert_status")


@register("s7_read_pages", f"with {ANCHORS} select page_id, count(*) as n_links from anchors group by 1")
def _(spark, sf):
    """The pages are written with a column more and read back, and only what harvesting needs is read."""
    path = _written(spark, lambda p: load(spark, sf, "pages").withColumn("fetched_at", F.lit("2024-01-01")).write.parquet(p))
    return H.anchors(S.read_pages(spark, path)).groupBy("page_id").agg(F.count("*").alias("n_links"))


@register("s8_scan_binary_documents", "select sha256(body)[1:16] as key, octet_length(encode(body)) as bytes, starts_with(body, '%PDF') as is_pdf, count(*) as n from (select string_agg(line, chr(10) order by k) || chr(10) as body from (select k, floor(k / 100) as f, case when k % 200 = 0 then '%PDF-1.7 ' else '' end || url as line from downloads) group by f) group by 1, 2, 3", "downloads")
def _(spark, sf):
    """A file for every hundred downloads, every second of them a PDF by its first bytes."""
    d = load(spark, sf, "downloads").select("k", F.floor(F.col("k") / 100).alias("f"), F.concat(F.when(F.col("k") % 200 == 0, "%PDF-1.7 ").otherwise(""), "url").alias("line"))
    body = d.groupBy("f").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("value"))
    path = _written(spark, lambda p: body.write.partitionBy("f").text(p))
    return S.scan_binary_documents(spark, path, "*.txt").groupBy("key", "bytes", "is_pdf").agg(F.count("*").alias("n"))


@register("s9_merge_artifact_dir", "select k, url, jurisdiction from downloads where k % 7 > 0", "downloads")
def _(spark, sf):
    """Artifact files in folders, every second one a bare list and the others objects with downloads."""
    d = load(spark, sf, "downloads").where("k % 7 > 0").select(F.floor(F.col("k") / 500).alias("f"), F.struct("k", "url", "jurisdiction").alias("r"))
    rows = d.groupBy("f").agg(F.to_json(F.collect_list("r")).alias("j"))
    body = rows.select("f", F.when(F.col("f") % 2 == 0, F.col("j")).otherwise(F.concat(F.lit('{"downloads": '), "j", F.lit("}"))).alias("value"))

    def write(path):
        body.where("f % 2 = 0").write.partitionBy("f").option("compression", "none").text(f"{path}/lists")
        body.where("f % 2 = 1").write.partitionBy("f").text(f"{path}/objects")

    return S.merge_artifacts(spark, _written(spark, write), "k long, url string, jurisdiction string", "*.txt")


@register("s10_write_json_table", "select 2 as targets, k, url, bytes from downloads", "downloads")
def _(spark, sf):
    """Two targets, overwritten once, hold the same rows."""
    d, root = load(spark, sf, "downloads").select("k", "url", "bytes"), f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    S.write_tables(d.limit(1), f"{root}/a", f"{root}/b")
    S.write_tables(d, f"{root}/a", f"{root}/b")
    both = [spark.read.schema("k long, url string, bytes long").json(f"{root}/{t}") for t in "ab"]
    return both[0].unionByName(both[1]).groupBy("k", "url", "bytes").agg(F.count("*").cast("int").alias("targets"))


@register("s11_write_csv_index", "select cast(k as varchar) as k, nullif(trim(title), '') as title, nullif(url, '') as url from downloads where status = 'downloaded'", "downloads")
def _(spark, sf):
    path = _written(spark, lambda p: S.write_csv_index(load(spark, sf, "downloads").where("status = 'downloaded'"), p, ["k", "title", "url"]))
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


@register("s12_append_jsonl", "select k, url from downloads where k % 3 = 0 union all select k, url from downloads where k % 2 = 0", "downloads")
def _(spark, sf):
    d, path = load(spark, sf, "downloads").select("k", "url"), f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    S.append_jsonl(d.where("k % 3 = 0"), path)
    S.append_jsonl(d.where("k % 2 = 0"), path)
    return spark.read.schema("k long, url string").json(path)


_line = "case k % 5 when 0 then '# note' when 1 then url when 2 then jurisdiction || ' | ' || url when 3 then jurisdiction || '|' || source_kind || '| ' || url else jurisdiction || '||' || url end"


@register("s4_read_source_list", "select case when k % 5 = 1 then 'AdHoc' else trim(jurisdiction) end as jurisdiction, case when k % 5 = 3 then source_kind else 'custom' end as source_kind, trim(url) as url from downloads where k % 5 > 0", "downloads")
def _(spark, sf):
    return S.parse_source_lines(load(spark, sf, "downloads").selectExpr(f"{_line} as value"))


@register("s6_seed_gazette", r"""with g as (select k, jurisdiction, case when k % 3 > 0 then url || '; ' || chr(10) || 'gaz.example/' || k end as cell from downloads) select jurisdiction, kind as source_kind, case when starts_with(trim(u), 'http') then trim(u) else 'https://' || regexp_replace(trim(u), '^/+', '') end as url
  from (select jurisdiction, 'official_gazette' as kind, unnest(regexp_split_to_array(cell, '[;\n|]+')) as u from g union all select jurisdiction, 'legal_databases', url from (select jurisdiction, 'db.example/' || k as url from g)) where trim(u) <> ''""", "downloads")
def _(spark, sf):
    g = load(spark, sf, "downloads").selectExpr("jurisdiction", "cast(null as string) as parliamentary_bills", "case when k % 3 > 0 then concat(url, '; ', char(10), 'gaz.example/', k) end as official_gazette", "concat('db.example/', k) as legal_databases")
    return S.seed_gazette(g)


@register("s14_load_for_browse", "select k, coalesce(nullif(trim(title), ''), url) as open_url, case when k % 3 = 0 then null else bytes end as bytes from (select k, case when k % 4 = 0 then '' else title end as title, case when k % 5 = 0 then null else url end as url, bytes from downloads) where coalesce(nullif(trim(title), ''), url) is not null", "downloads")
def _(spark, sf):
    d = load(spark, sf, "downloads").selectExpr("k", "case when k % 4 = 0 then '' else title end as open_url", "case when k % 5 = 0 then null else url end as url", "case when k % 3 = 0 then 'n/a' else cast(bytes as string) end as bytes")
    return S.load_for_browse(d).select("k", "open_url", "bytes")


# the first source of the catalog has no rows, the second has some
@register("s14_fallback_chain", "select k, url from downloads where status = 'downloaded' and url is not null", "downloads")
def _(spark, sf):
    d = load(spark, sf, "downloads").select("k", "url", "status")
    return S.load_for_browse(S.first_non_empty(d.where("status = 'remote'"), d.where("status = 'downloaded'"), d)).select("k", "url")


@register("s15_catalog_from_manifest", "select coalesce(nullif(s, ''), 'pdf_' || row_number() over (order by k)) as id, coalesce(nullif(trim(title), ''), nullif(trim(filename), ''), 'Untitled') as title, jurisdiction, source_kind, url, url as open_url from (select *, case when k % 3 = 0 then '' else sha256 end as s from downloads)", "downloads")
def _(spark, sf):
    d = load(spark, sf, "downloads").withColumn("sha256", F.when(F.col("k") % 3 == 0, F.lit("")).otherwise(F.col("sha256")))
    return S.catalog_from_manifest(d, F.col("k"))
