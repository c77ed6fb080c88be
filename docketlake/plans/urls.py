"""URL and identifier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from . import sqlx as X
from .inputs import load, projection, with_inputs

QUERIES, SQL = {}, {}


query = projection(QUERIES, SQL)
query(
    "u1_normalize_url", "downloads",
    lambda url, title: {"crawl": U.normalize_url(url), "pipeline": U.normalize_url(url, "pipeline"), "light": U.normalize_url(url, "light"), "key_form": U.normalize_url(url, "key")},
    {
        "crawl": X.normalized("url", "crawl"), "pipeline": X.normalized("url", "pipeline"), "light": X.replace("trim(url)", "#.*$"),
        "key_form": "lower(" + X.replace(
            X.replace(X.replace("url", "#.*$"), r"[?].*$") + " || case when " + X.kept_query("url", "utm_source|utm_medium|utm_campaign|gclid|fbclid") + " = '' then '' else '?' || " + X.kept_query("url", "utm_source|utm_medium|utm_campaign|gclid|fbclid") + " end", "/$") + ")",
    },
)
query("u2_host_of", "downloads", lambda url, title: {"host": U.host_of(url), "title_host": U.host_of(title)}, {"host": X.host("url"), "title_host": X.host("title")})

_HREFS = ["../up/a.html", "./same", "?q=1", "//cdn.example.org/x", "/root/y", "https://o.example/z", "", "#frag", "deep/er/z.pdf"]
_AT = "{'" + "','".join(_HREFS) + "'}"


def _resolve(spark, sf):
    href = F.element_at(F.array(*[F.lit(h) for h in _HREFS]), (F.col("k") % len(_HREFS) + 1).cast("int"))
    return load(spark, sf, "downloads").select("k", href.alias("href"), U.resolve_url(U.normalize_url(F.col("url")), href).alias("resolved"))


QUERIES["u3_resolve_url"] = _resolve
_base = X.normalized("url", "crawl")
SQL["u3_resolve_url"] = with_inputs(
    f"""with s as (select k, {_base} as b, ['{"','".join(_HREFS)}'][k % {len(_HREFS)} + 1] as href from downloads),
    t as (select *, regexp_extract(b, '^([a-z]+://[^/?#]*)', 1) as site, {X.path('b')} as p from s),
    v as (select *, regexp_replace(p, '[^/]*$', '') as folder from t)
    select k, href, case when href = '../up/a.html' then site || coalesce(nullif(regexp_replace(folder, '[^/]+/$', ''), ''), '/') || 'up/a.html'
      when href = './same' then site || folder || 'same' when href like 'https:%' then href when href like '//%' then 'https:' || href
      when href = '' then b when href like '/%' then site || href when href like '?%' then site || p || href when href like '#%' then b || href
      else site || folder || href end as resolved from v""",
    "downloads",
)


SITES = "select k, case k % 7 when 0 then 'www.rulebook.sama.gov.sa' when 1 then 'CMA.org.sa' when 2 then 'ndmo.sdaia.gov.sa' else host end as host, split_part('example.org~www.beta.example.org~alpha.gov.example~docs.beta.example.org~sama.gov.sa~cma.gov.sa~dgp.sdaia.gov.sa', '~', cast(k % 7 as int) + 1) as seed from hosts"


def _same_site(spark, sf):
    load(spark, sf, "downloads").select("k", U.host_of(F.col("url")).alias("host")).createOrReplaceTempView("hosts")
    host, seed = F.col("host"), F.col("seed")
    return spark.sql(SITES).select("k", "host", U.is_same_site(host, seed).alias("either_way"), U.is_same_site(host, seed, one_way=True).alias("below"), U.is_same_site(host, seed, exact=True).alias("equal"))


QUERIES["u4_is_same_site"] = _same_site
SQL["u4_is_same_site"] = with_inputs(
    f"""with hosts as (select k, {X.host('url')} as host from downloads), s as (select k, host, regexp_replace(lower(host), '^www\\.', '') as h, regexp_replace(seed, '^www\\.', '') as s from ({SITES}))
    select k, host, h <> '' and (h = s or ends_with(h, '.' || s) or ends_with(s, '.' || h) or (h = 'rulebook.sama.gov.sa' and s = 'sama.gov.sa') or (h = 'cma.org.sa' and s = 'cma.gov.sa') or (h = 'ndmo.sdaia.gov.sa' and s in ('sdaia.gov.sa', 'dgp.sdaia.gov.sa'))) as either_way,
      h <> '' and (h = s or ends_with(h, '.' || s)) as below, h <> '' and h = s as equal from s""",
    "downloads",
)
_low_path = f"lower({X.replace(X.path('url'), ';[^/]*$')})"
query(
    "u5_document_links", "downloads", lambda url, title: {"is_doc": U.looks_like_doc(url), "is_pdf": U.is_pdf_url(url)},
    {
        "is_doc": f"({X.matches(_low_path, U.DOC_EXTENSIONS)} or {X.matches('url', U.PDF_LINK)} or {X.matches('url', U.ATTACHMENT)} or {X.matches('url', U.FILE_ENDPOINT)} or (contains(lower(url), '.pdf') and regexp_matches(lower(url), '/wps/wcm/|getattachment')))",
        "is_pdf": f"(contains(lower(url), '.pdf') or {X.matches('url', U.FILE_ENDPOINT)})",
    },
)
_mime = "['application/pdf', 'text/csv; charset=utf-8', 'text/html', 'application/msword']"
QUERIES["u6_doc_type"] = lambda spark, sf: load(spark, sf, "downloads").select(
    "k", U.doc_type(F.col("url"), F.element_at(F.array(*[F.lit(m) for m in ("application/pdf", "text/csv; charset=utf-8", "text/html", "application/msword")]), (F.col("k") % 4 + 1).cast("int"))).alias("doc_type")
)
_ext = f"regexp_extract(lower({X.path('url')}), '[.]([a-z]+)$', 1)"
SQL["u6_doc_type"] = with_inputs(
    f"select k, coalesce(case when {_ext} in ('{chr(39).join(x for x in [(chr(39) + ',' + chr(39)).join(U.EXTENSION_TYPES)])}') then upper({_ext}) end, case {_mime}[k % 4 + 1] when 'application/pdf' then 'PDF' when 'text/csv; charset=utf-8' then 'CSV' when 'application/msword' then 'DOC' end) as doc_type from downloads",
    "downloads",
)


def _names(spark, sf):
    d = load(spark, sf, "downloads")
    return d.select("k", U.slugify(F.col("title")).alias("slug"), U.safe_filename(F.regexp_replace("url", "[0-9]+\\.pdf$", "/download.pdf"), F.col("title")).alias("file"), U.title_hint(F.col("filename")).alias("hint"))


QUERIES["u7_file_names"] = _names
SQL["u7_file_names"] = with_inputs(
    r"""with s as (select *, regexp_replace(url, '[0-9]+\.pdf$', '/download.pdf') as u from downloads),
    t as (select *, regexp_extract(regexp_extract(u, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '([^/]*)/?$', 1) as n0,
      regexp_replace(regexp_replace(trim(regexp_replace(title, '[^\p{L}\p{N}_\s\-]', '', 'g')), '[\-\s]+', '_', 'g'), '^_+|_+$', '', 'g') as sl from s),
    v as (select *, regexp_replace(regexp_replace(case when n0 = '' then 'document.pdf' else n0 end, ';.*$', ''), '(?i)\.aspx$', '') as n1, case when sl = '' then 'unknown' else sl[1:80] end as slug from t),
    w as (select *, regexp_replace(regexp_replace(case when contains(lower(n1), '.pdf') then n1 else n1 || '.pdf' end, '[^\p{L}\p{N}_.\-()+ ]+', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g') as n2 from v)
    select k, slug, case when lower(n2) in ('document.pdf', 'file.pdf', 'download.pdf', 'pdf.pdf') then case when trim(title) = '' then sha256(u)[1:16] else slug[1:40] end || '.pdf' else n2 end as file, """
    + X.initcap(r"trim(regexp_replace(regexp_replace(filename, '\.[A-Za-z0-9]{1,5}$', ''), '[_\-+.]+', ' ', 'g'))") + " as hint from w",
    "downloads",
)
QUERIES["u8_split_urls"] = lambda spark, sf: load(spark, sf, "downloads").select("k", F.array_join(U.split_urls(F.concat("url", F.lit(" ;\n/"), "filename", F.lit("| "), "title")), " ").alias("parts"))
SQL["u8_split_urls"] = with_inputs(
    r"""select k, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(url || ' ;' || chr(10) || '/' || filename || '| ' || title, '[;\n|]+'), lambda x: trim(x)), lambda x: x <> ''),
    lambda x: case when starts_with(x, 'http') then x else 'https://' || regexp_replace(x, '^/+', '') end), ' ') as parts from downloads""",
    "downloads",
)
QUERIES["u9_start_url_candidates"] = lambda spark, sf: load(spark, sf, "downloads").select("k", F.array_join(U.start_url_candidates(F.col("url")), " ").alias("candidates"), U.flip_www(F.col("url")).alias("flipped"))
SQL["u9_start_url_candidates"] = with_inputs(
    f"""with s as (select k, url, {X.normalized('url', 'pipeline')} as u from downloads), t as (select *, regexp_replace({X.netloc('u')}, ':[0-9]*$', '') as h, regexp_replace({X.netloc('url')}, ':(80|443)$', '') as raw from s),
    v as (select *, regexp_replace(h, '^www[.]', '') as b from t),
    w as (select k, url, raw, u, unnest([u] || flatten(list_transform([h, b, 'www.' || b], lambda x: list_transform(['/', '/en/', '/ar/', '/en', '/ar'], lambda p: 'https://' || x || p)))) as c, unnest(range(16)) as i from v),
    f as (select k, url, raw, c, min(i) as i from w group by all)
    select k, string_agg(c, ' ' order by i) as candidates, any_value('https://' || case when starts_with(raw, 'www.') then raw[5:] else 'www.' || raw end || regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1)) as flipped from f group by k""",
    "downloads",
)
query(
    "u10_stable_ids", "downloads",
    lambda url, title: {"content": U.content_key(url), "law_id": U.stable_id(F.lit("src"), url, title), "row_id": U.stable_id(title, F.lit(None).cast("string"), prefix="pdf", digits=20)},
    {"content": "sha256(url)[1:16]", "law_id": "sha1('src|' || url || '|' || title)[1:16]", "row_id": "'pdf_' || sha1(title || '|')[1:20]"},
)
query(
    "u11_display", "downloads",
    lambda url, title: {"shown": U.display_url(url), "size": U.format_bytes(F.col("bytes")), "kind": U.format_kind(F.col("source_kind")), "http": U.is_http_url(title)},
    {
        "shown": "case when length(regexp_replace(url, '^https?://', '')) > 48 then regexp_replace(url, '^https?://', '')[1:47] || '…' else regexp_replace(url, '^https?://', '') end",
        "size": "case when bytes <= 0 then '' when bytes < 1024 then bytes || ' B' when bytes < 1048576 then cast(round(bytes / 1024) as bigint) || ' KB' else printf('%.1f', bytes / 1048576) || ' MB' end",
        "kind": X.initcap("replace(source_kind, '_', ' ')"), "http": "regexp_matches(title, '(?i)^https?://')",
    },
)
query(
    "u12_page_classes", "downloads", lambda url, title: {"priority": U.page_priority(url), "junk": U.is_junk_page(url), "legal": U.is_legal_priority_page(url)},
    {
        "priority": f"case when regexp_matches(lower(url), '{U.FIRST_PAGES}') then 0 when regexp_matches(lower(url), '{U.SECOND_PAGES}') then 1 else 2 end",
        "junk": X.matches(X.path("url"), U.JUNK_PATH), "legal": f"({X.matches(X.path('url'), U.LEGAL_PATH)} or {X.matches('url', U.LEGAL_PATH)})",
    },
)
QUERIES["u13_coerce_scheme"] = lambda spark, sf: load(spark, sf, "registry").select("k", U.coerce_scheme(F.col("url")).alias("url"))
SQL["u13_coerce_scheme"] = with_inputs("select k, case when starts_with(url, 'http') then url else 'https://' || regexp_replace(url, '^/+', '') end as url from registry", "registry")
