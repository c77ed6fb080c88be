"""Links, documents and signals in page snapshots and feed payloads. Everything is native: regular expressions and JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.classify import bound
from .rank import keep_top
from .storage import saved

ATTRIBUTE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
ANCHOR = rf"(?is)<a\b[^>]*?\bhref{ATTRIBUTE}[^>]*>(.*?)</a>"
EMBED = r"(?is)<(?:iframe|embed|object|source)\b[^>]*?\b(?:src|data|data-src|href)\s*=\s*[\"']([^\"']+)[\"']"
DATA_LINK = r"(?is)\bdata-(?:url|href)\s*=\s*[\"']([^\"']+)[\"']"
SKIPPED = r"(?i)^\s*(?:javascript|mailto|tel|data|blob):|^\s*#"
#: A string of JSON with, if it is a key, its colon and the string that follows; possessive, so it takes no stack.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
MEMBER = rf"(?s)({STRING})(?:\s*+(:)\s*+({STRING})?)?"
#: Endings of documents, and of files that are part of a page.
DOCUMENTS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "csv", "rtf", "odt", "ods", "txt")
ASSETS = ("css", "js", "png", "jpg", "jpeg", "gif", "svg", "ico", "woff", "woff2", "ttf", "map", "json", "xml")
#: Character references that link texts and addresses are read without.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: Words of news links, and anchors that are only navigation.
NEWS_WORDS = ("news", "press", "update", "circular", "consultation", "bulletin", "release", "gazette", "bill", "regulation", "notice")
NAVIGATION = ("login", "cookie", "privacy policy", "contact us", "home", "skip to")
#: What bodies of blocked responses say, in any case.
BLOCK_MARKERS = (
    "cf-challenge", "just a moment", "attention required", "access denied", "enable javascript and cookies",
    "verify you are human", "checking your browser", "captcha", "ddos protection", "403 forbidden",
)
#: Where documents are named in a page's source, with the method that finds them, first method wins.
DOCUMENT_PATTERNS = (
    ("embedded-url", r"""(?i)(https?://[^\s"'<>]+?\.(?:pdf|docx?|xlsx?|csv)(?:\.aspx)?(?:\?[^\s"'<>]*)?)"""),
    ("getattachment", r"""(?i)(https?://[^\s"'<>]*?/getattachment/[^\s"'<>]+?\.pdf[^\s"'<>]*)"""),
    ("quoted-path", r"""(?i)["']([^"']+\.pdf(?:\.aspx)?(?:\?[^"']*)?)["']"""),
    ("script", r"""(?i)(https?://[^\s"'<>]+?\.(?:pdf|docx?|xlsx?|pptx?)(?:\.aspx)?(?:\?[^\s"'<>]*)?)"""),
    ("script", r"""(?i)(?:href|src|url|FileRef|ServerRelativeUrl|EncodedAbsUrl|Path)\s*[=:]\s*["']?([^\s"'<>]+\.pdf[^\s"'<>]*)"""),
    ("script", r"""(?i)(/[^\s"'<>]*?/[^\s"'<>]*?\.pdf)"""),
)
#: Documents named in inline scripts, of which a page's first eight are read.
SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"
SCRIPT_DOCUMENT = r"""(?i)(https?://[^\s"'\\]+\.(?:pdf|docx?|xlsx?|pptx?|csv|rtf|odt|ods)(?:[?#][^\s"'\\]*)?)"""
#: Marks of SharePoint sites, addresses of their data, and names of folders worth listing.
SHAREPOINT_MARKS = ("sharepoint", "_api/web", "_layouts/15", "microsoftsharepoint")
SHAREPOINT_DATA = (
    r"""(?i)["']([^"']*DataSources/[^"']+\.aspx[^"']*)["']""",
    r"""(?i)["']([^"']*_vti_bin/[^"']+)["']""",
    r"""(?i)["']([^"']*_api/web/[^"']+)["']""",
    r"""(?i)["']([^"']*_api/search/[^"']+)["']""",
    r"""(?i)["']([^"']*listdata\.svc[^"']*)["']""",
)
FOLDER_NAMES = ("document", "media", "library", "pdf", "file", "knowledge", "research", "publication", "newsletter", "sdaia", "sector")
#: Marks of pages that scripts fill, and of library pages.
SHELL_MARKS = ('id="root"', 'id="app"', 'id="__next"', "ng-version", 'id="__nuxt"')
LIBRARY_PAGES = ("knowledgecenter", "ainewsletter", "mediacenter", "researchlibrary", "sdaiapublications", "ai-newsletter")


def _has(text: Column, marks) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in marks])


def _decoded(text: Column) -> Column:
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), REFERENCES, text)


def anchor_href(match: Column) -> Column:
    """Where a link points to, from the whole of it (a match of ANCHOR)."""
    return F.trim(_decoded(F.concat(*[F.regexp_extract(match, ANCHOR, i) for i in (1, 2, 3)])))


def anchor_text(match: Column) -> Column:
    return F.trim(F.regexp_replace(_decoded(F.regexp_replace(F.regexp_extract(match, ANCHOR, 4), "<[^>]*>", " ")), r"\s+", " "))


def anchor_rows(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, text, url): every link of each page in order, absolute, without fragment; a URL may come again.

    The page is searched once; a link's parts are read from the link.
    """
    found = pages.select("page_id", F.col("url").alias("base"), F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), 0)).alias("pos", "a"))
    rows = found.select("page_id", "pos", "base", anchor_href(F.col("a")).alias("href"), anchor_text(F.col("a")).alias("text")).where((F.col("href") != "") & ~F.col("href").rlike(SKIPPED))
    rows = rows.withColumn("url", F.regexp_replace(U.resolve_url(F.col("base"), F.col("href")), "#.*$", ""))
    return rows.where(F.col("url").rlike("(?i)^https?://")).drop("base")


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href, text): the links of each page, one row a URL and page, as they first stand."""
    first = anchor_rows(pages).groupBy("page_id", "url").agg(F.min(F.struct("pos", "href", "text")).alias("a"))
    return first.select("page_id", "url", "a.pos", "a.href", "a.text")


def embed_hrefs(html: Column) -> Column:
    return F.array_distinct(F.concat(F.regexp_extract_all(html, F.lit(EMBED), 1), F.regexp_extract_all(html, F.lit(DATA_LINK), 1)))


def embeds(pages: DataFrame) -> DataFrame:
    """(page_id, url): what iframes, objects, sources and data attributes point to."""
    rows = pages.select("page_id", F.col("url").alias("base"), F.explode(embed_hrefs(F.col("html"))).alias("href")).where(~F.col("href").rlike(SKIPPED))
    return rows.select("page_id", F.regexp_replace(U.resolve_url(F.col("base"), F.col("href")), "#.*$", "").alias("url")).distinct()


def document_hrefs(html: Column, data_source: bool = False) -> Column:
    """Array of (i, method, href): what each document pattern finds in a page's source."""
    named = [("datasource" if data_source else m, p) for m, p in DOCUMENT_PATTERNS if not data_source or m == "script" or m == "quoted-path"]
    found = lambda p: F.filter(F.regexp_extract_all(html, F.lit(p), 1), lambda x: x.rlike("(?i)^/|^https?://")) if "FileRef" in p else F.regexp_extract_all(html, F.lit(p), 1)
    return F.flatten(F.array(*[F.transform(found(p), _tagged(i, m)) for i, (m, p) in enumerate(named)]))


def document_urls(pages: DataFrame, data_source: bool = False) -> DataFrame:
    """(page_id, url, method): documents named anywhere in a page's source, with the first method that finds each.

    ``data_source`` marks bodies of a site's data services instead of pages: what the text patterns find is 'datasource'.
    """
    pairs = document_hrefs(F.col("html"), data_source)
    rows = pages.select("page_id", F.col("url").alias("base"), F.explode(pairs).alias("p"))
    href = F.trim(F.replace(F.col("p.href"), F.lit("&amp;"), F.lit("&")))
    rows = rows.select("page_id", F.regexp_replace(U.resolve_url(F.col("base"), href), "#.*$", "").alias("url"), "p.i", "p.method").where(F.col("url").rlike("(?i)^https?://"))
    return rows.groupBy("page_id", "url").agg(F.min_by("method", "i").alias("method"))


def script_documents(pages: DataFrame, scripts: int | None = 8) -> DataFrame:
    """(page_id, url): documents with absolute addresses in a page's first ``scripts`` inline scripts (None: in all)."""
    bodies = F.regexp_extract_all("html", F.lit(SCRIPT), 1)
    bodies = F.slice(bodies, 1, scripts) if scripts else bodies
    urls = F.flatten(F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit(SCRIPT_DOCUMENT), 1)))
    return pages.select("page_id", F.explode(urls).alias("url")).select("page_id", F.regexp_replace("url", "#.*$", "").alias("url")).distinct()


def _tagged(i: int, method: str):
    return lambda x: F.struct(F.lit(i).alias("i"), F.lit(method).alias("method"), x.alias("href"))


def json_strings(payloads: DataFrame) -> DataFrame:
    """(id, key, value): every string value in JSON bodies (id, body), at any depth, with its key if it has one, escapes read.

    In JSON a quote only begins or ends a string, so one pass over the body finds all of them, each with the value after
    its colon: no level is a round. Keys are no values. What is not JSON has none.
    """
    found = payloads.where(F.get_json_object("body", "$").isNotNull()).select("id", F.explode(F.regexp_extract_all("body", F.lit(MEMBER), 0)).alias("m"))
    part = lambda i: F.regexp_extract("m", MEMBER.replace("(?s)", "(?s)^"), i)
    rows = found.select("id", part(1).alias("first"), part(2).alias("colon"), part(3).alias("second")).where("colon = '' or second <> ''")
    read = lambda c: F.when(c.contains("\\"), F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>")[0]).otherwise(F.substr(c, F.lit(2), F.length(c) - 2))
    alone = F.col("colon") == ""
    return rows.select("id", F.when(~alone, read(F.col("first"))).alias("key"), read(F.when(alone, F.col("first")).otherwise(F.col("second"))).alias("value"))


def json_urls(payloads: DataFrame) -> DataFrame:
    """(id, url) of the string values in JSON bodies: absolute URLs, and paths to documents, APIs and, two levels down, pages."""
    rows = json_strings(payloads).select("id", F.trim("value").alias("url")).distinct()
    low = F.lower("url")
    ends = lambda names: low.rlike(rf"\.({'|'.join(names)})$")
    page = F.col("url").rlike("^/[^/]*/") & ~ends(ASSETS)
    return rows.where(F.col("url").rlike("^https?://") | ((F.length("url") > 2) & F.col("url").startswith("/") & (ends(DOCUMENTS) | low.contains("/api/") | page)))


def nav_urls(payloads: DataFrame) -> DataFrame:
    """(id, url): addresses and paths under the url, href, link and path keys of JSON bodies."""
    rows = json_strings(payloads).where(F.lower("key").isin("url", "href", "link", "path")).select("id", F.col("value").alias("url"))
    return rows.where(F.col("url").startswith("/") | F.col("url").startswith("http")).distinct()


def api_hints(html: Column, most: int = 20) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(html, F.lit(r"[\"'](/_?api/[^\"'\s]+)[\"']"), 1)), 1, most)


def sitemap(body: DataFrame, site: str | None = None) -> DataFrame:
    """(id, url, kind) of sitemaps and robots files (id, body): document, sitemap or page.

    Addresses are those in loc elements, bare ones anywhere, and what Sitemap lines name, which is a sitemap. With
    ``site`` pages and sitemaps of other sites than this host's go. Only the addresses of ids with several bodies are grouped.
    """
    links = F.concat(F.regexp_extract_all("body", F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), 1), F.regexp_extract_all("body", F.lit(r"""https?://[^\s"'<>]+"""), 0))
    lines = F.regexp_extract_all("body", F.lit(r"(?im)^[ \t]*sitemap:[ \t]*(\S+)"), 1)
    kind = F.when(F.array_contains("lines", F.col("url")), "sitemap").when(U.looks_like_doc(F.col("url")), "document").when(F.lower("url").contains("sitemap"), "sitemap").otherwise("page")
    several = saved(body.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))

    def found(bodies: DataFrame) -> DataFrame:
        rows = bodies.select("id", links.alias("links"), lines.alias("lines"))
        return rows.select("id", "lines", F.explode(F.array_distinct(F.concat("links", "lines"))).alias("url")).select("id", "url", kind.alias("kind"))

    same = body["id"].eqNullSafe(several["id"])
    rows = found(body.join(several, same, "left_anti"))
    if not several.isEmpty():
        rows = rows.unionByName(found(body.join(several, same, "left_semi")).groupBy("id", "url").agg(F.max("kind").alias("kind")))
    return rows if site is None else rows.where((F.col("kind") == "document") | U.is_same_site(U.host_of(F.col("url")), F.lit(site)))


def robots_blocked(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (k, host, path) that a rule (host, prefix) forbids.

    Paths are exploded into prefixes only as long as rules are, so this is an equi-join on (host, prefix).
    """
    sizes = rules.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("sizes"))
    cut = urls.join(sizes, "host").select("k", "host", "path", F.explode("sizes").alias("n")).where(F.length("path") >= F.col("n"))
    return cut.select("k", "host", F.expr("substring(path, 1, n)").alias("prefix")).join(rules, ["host", "prefix"], "left_semi").select("k").distinct()


def robots_rules(body: DataFrame) -> DataFrame:
    """(host, prefix) of the Disallow lines of robots files (host, body), indented ones too."""
    return body.select("host", F.explode(F.regexp_extract_all("body", F.lit(r"(?m)^[ \t]*Disallow:[ \t]*(\S+)"), 1)).alias("prefix")).distinct()


def looks_sharepoint(html: Column, headers: Column | None = None) -> Column:
    """Whether the first 12,000 characters of a page, or its response headers as text, show SharePoint."""
    found = _has(F.lower(F.substring(F.coalesce(html, F.lit("")), 1, 12000)), SHAREPOINT_MARKS)
    return found if headers is None else found | F.coalesce(_has(F.lower(headers), ("microsoftsharepoint", "sprequestguid")), F.lit(False))


def sharepoint_endpoints(html: Column) -> Column:
    """Addresses of a SharePoint page's data sources and services, as they stand, in the order of their kinds."""
    found = F.flatten(F.array(*[F.regexp_extract_all(html, F.lit(p), 1) for p in SHAREPOINT_DATA]))
    return F.array_distinct(F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))))


def sharepoint_folders(body: Column) -> Column:
    """Folders in a SharePoint listing whose names say that they hold documents."""
    folders = F.regexp_extract_all(body, F.lit(r'"ServerRelativeUrl"\s*:\s*"([^"]+)"'), 1)
    return F.array_distinct(F.filter(folders, lambda f: _has(F.lower(f), FOLDER_NAMES)))


def looks_like_shell(html: Column, url: Column | None = None, profile: str = "site") -> Column:
    """Whether a page is an empty application shell; a null or empty page is one.

    ``site``: under 1500 characters, a shell mark without any link, or over 8000 characters with under three links.
    ``pipeline`` (needs ``url``): under 2000 characters; a library page with under eight links and no .pdf; a shell mark
    with under five links; never a rejection page. ``script``: under 1500 characters, or a shell mark without any link.
    """
    html = F.coalesce(html, F.lit(""))
    low, size = F.lower(html), F.length(html)
    links = F.regexp_count(low, F.lit("<a "))
    marked = _has(low, SHELL_MARKS if profile == "site" else SHELL_MARKS[:4])
    if profile == "site":
        none = (links == 0) & ~low.contains("<a\n")
        return (size < 1500) | (marked & none) | ((size > 8000) & (links < 3))
    if profile == "script":
        return (size < 1500) | (marked & (links == 0))
    library = _has(F.lower(F.coalesce(url, F.lit(""))), LIBRARY_PAGES) & (links < 8) & ~low.contains(".pdf")
    return (size < 2000) | (~low.contains("request rejected") & (library | (marked & (links < 5))))


def needs_fallback(html: Column, least_links: int = 3) -> Column:
    """Whether a page must be fetched another way: no page, a shell, or under ``least_links`` links."""
    return html.isNull() | looks_like_shell(html) | (F.regexp_count(F.lower(F.coalesce(html, F.lit(""))), F.lit("<a ")) < least_links)


def looks_blocked(status: Column, body: Column) -> Column:
    """Whether a response says that the crawler is blocked: by its status, or a marker in the first 4000 characters."""
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 4000))
    return F.coalesce(status.isin(403, 429) | (status >= 500), F.lit(False)) | _has(head, BLOCK_MARKERS)


def is_rejected(status: Column, body: Column) -> Column:
    """Whether a response is a firewall's rejection page, by its first 400 characters."""
    body = F.coalesce(body, F.lit(""))
    head = F.substring(body, 1, 400)
    short = F.coalesce(status == 200, F.lit(False)) & (F.octet_length(body) < 400) & F.lower(head).contains("<html>") & F.lower(head).contains("rejected")
    return head.contains("Request Rejected") | head.contains("support ID is") | short


def news_items(pages: DataFrame, limit: int = 25, early: int = 3) -> DataFrame:
    """(page_id, url, text, score, rank): the best news links of each page.

    Links of 12 to 220 characters that are no navigation and whose path or text has a news word, or whose path has a
    year; a URL counts where it is first accepted. Of the first ``limit * early`` of these the ``limit`` best.
    """
    rows = anchor_rows(pages).where(F.length("text").between(12, 220) & ~F.lower("text").isin(*NAVIGATION))
    path = F.lower(U.path_of(F.col("url")))
    score = sum((F.when(path.contains(w) | F.lower("text").contains(w), 1).otherwise(0) for w in NEWS_WORDS), F.lit(0))
    rows = rows.withColumn("score", score).where((F.col("score") > 0) | path.rlike(r"/[0-9]{4}/"))
    accepted = rows.groupBy("page_id", "url").agg(F.min(F.struct("pos", "text", "score")).alias("a")).select("page_id", "url", "a.*")
    first = keep_top(accepted, ["page_id"], limit * early, F.col("pos"), name="nth")
    return keep_top(first, ["page_id"], limit, F.desc("score"), F.col("pos")).select("page_id", "url", "text", "score", "rank")


BILLS = "struct<publications:array<struct<title:string,links:array<struct<url:string,contentType:string>>,files:array<struct<url:string,contentType:string>>>>>"
REGISTER = "struct<results:array<struct<title:string,pdf_url:string>>>"


def flatten_feed(payloads: DataFrame) -> DataFrame:
    """(id, url, title) of the documents in feed payloads (id, kind, body): bills, register results, law and act links."""
    bills = payloads.where("kind = 'bills'").select("id", F.from_json("body", BILLS).alias("j")).select("id", F.explode("j.publications").alias("p"))
    bills = bills.select("id", "p.title", F.explode(F.concat(F.coalesce("p.links", F.from_json(F.lit("[]"), "array<struct<url:string,contentType:string>>")), F.coalesce("p.files", F.from_json(F.lit("[]"), "array<struct<url:string,contentType:string>>")))).alias("l"))
    bills = bills.where(F.lower("l.url").contains(".pdf") | (F.col("l.contentType") == "application/pdf")).select("id", F.col("l.url").alias("url"), "title")
    register = payloads.where("kind = 'register'").select("id", F.from_json("body", REGISTER).alias("j")).select("id", F.explode("j.results").alias("r")).where("r.pdf_url <> ''").select("id", F.col("r.pdf_url").alias("url"), "r.title")
    laws = payloads.where("kind = 'law'").select("id", F.concat(F.regexp_replace("body", "/(data\\.feed|contents)?$", ""), F.lit("/data.pdf")).alias("url"), F.lit("").alias("title"))
    acts = payloads.where("kind = 'act'").select("id", F.concat(F.regexp_replace("body", "/[^/]*\\.html$", ""), F.lit("/latest/whole.pdf")).alias("url"), F.lit("").alias("title"))
    rows = bills.unionByName(register).unionByName(laws).unionByName(acts)
    return rows.groupBy("url").agg(F.min_by("id", F.struct("id", "title")).alias("id"), F.substring(F.min_by("title", F.struct("id", "title")), 1, 300).alias("title"))


def route_seeds(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """(k, seed): listing URLs that rules (marker, path) add to the sources (k, url) whose host ends in the marker."""
    hosts = sources.select("k", U.scheme(F.col("url")).alias("scheme"), U.host_of(F.col("url")).alias("host"))
    tails = hosts.select("k", "scheme", "host", F.explode(U.host_suffixes(F.col("host"), 1)).alias("marker"))
    return tails.join(rules, "marker").select("k", F.concat("scheme", F.lit("://"), "host", "path").alias("seed")).distinct()


def clean_text(pages: DataFrame, most_pages: int | None = 20, most_chars: int | None = 40_000) -> DataFrame:
    """(id, text): page texts (id, page, text) of each document in order, blanks and empty lines thinned.

    Pages beyond ``most_pages`` (counted from one) and characters beyond ``most_chars`` are left out; None takes all.
    """
    kept = pages.where(F.col("page") <= most_pages) if most_pages else pages
    kept = kept.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]).alias("t"))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.array_join("t", "\n\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n"))
    return kept.select("id", (F.substring(text, 1, most_chars) if most_chars else text).alias("text"))


#: Windows-1252: the characters of bytes 0x80 to 0x9F; five of them have none.
CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_UNDEFINED = "[\\x81\\x8d\\x8f\\x90\\x9d]"


def decode_text(body: Column, kind: Column, most: int | None = 20_000) -> Column:
    """Text of text-like files: UTF-8, else Windows-1252, else (a byte has no such character) Latin-1.

    RTF is Windows-1252 with its control words as blanks, ODT and ODS are UTF-8 with their tags as blanks; both leave out
    bytes that are no text. Characters beyond ``most`` are left out; None takes all.
    """
    latin = F.decode(body, "ISO-8859-1")
    windows = F.translate(latin, _C1, CP1252)
    utf8 = body.cast("string")
    plain = F.when(F.is_valid_utf8(utf8), utf8).when(~latin.rlike(_UNDEFINED), windows).otherwise(latin)
    rtf = F.regexp_replace(F.translate(F.regexp_replace(latin, _UNDEFINED, ""), _C1, CP1252), r"\\[a-z]+-?\d* ?", " ")
    odf = F.regexp_replace(F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.replace(F.make_valid_utf8(utf8), F.lit("\ufffd"), F.lit(""))), "<[^>]+>", " ")
    text = F.when(kind == "RTF", rtf).when(kind.isin("ODT", "ODS"), odf).otherwise(plain)
    return F.substring(text, 1, most) if most else text


def is_scanned(kind: Column, text: Column) -> Column:
    return (kind == "PDF") & (F.length(F.trim(F.coalesce(text, F.lit("")))) < 40)


def classify_responses(responses: DataFrame, most_bytes: int = 150 << 20) -> DataFrame:
    """responses (k, url, status, content_type, body) with outcome: what came of each download; bytes seen before are duplicates.

    Of equal bodies that are otherwise fine the one of the smallest k is ok. Bodies are hashed where they are read, once; only
    hashes of fine ones are shuffled, so blank and failed responses, however many, meet nowhere.
    """
    size = F.length("body")
    out = F.when(F.col("status") >= 400, F.concat(F.lit("http_"), F.col("status").cast("string"))).when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > most_bytes, "too_large")
    out = out.when(F.col("content_type").contains("html"), "not_pdf").when(F.substring("body", 1, 4).cast("string") != "%PDF", "missing_magic").otherwise("ok")
    judged = saved(responses.select("k", "url", out.alias("outcome"), F.sha2("body", 256).alias("digest")))
    fine = judged.where("outcome = 'ok'")
    twice = fine.groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = fine.join(twice.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"), "left")
    rest = judged.where("outcome <> 'ok'").select("k", "url", "outcome")
    return joined.select("k", "url", F.when(F.col("k") > F.col("first"), "duplicate").otherwise("ok").alias("outcome")).unionByName(rest)


def fenced_json(reply: Column) -> Column:
    """The JSON object of a model's reply, as text: without its code fence, else the first braces; null if none parses."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(reply), "^```(?:json)?\\s*", ""), "\\s*```$", "")
    braces = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    is_object = lambda x: F.trim(x).startswith("{") & F.try_parse_json(x).isNotNull()
    return bound(bare, lambda x: F.when(is_object(x), x).otherwise(bound(braces, lambda y: F.when(is_object(y), y))))


def coerced_reply(reply: Column, most_points: int = 10, most_topics: int = 8) -> Column:
    """struct(summary, key_points, topics, document_type) of a model's reply: trimmed, blanks out, lists cut; null without object."""
    some = lambda c, n: F.slice(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), 1, n)

    def made(data: Column) -> Column:
        kind = F.coalesce(F.nullif(data["document_type"], F.lit("")), F.lit("other"))
        return F.when(data.isNotNull(), F.struct(
            F.trim(F.coalesce(data["summary"], F.lit(""))).alias("summary"), some(data["key_points"], most_points).alias("key_points"),
            some(data["topics"], most_topics).alias("topics"), F.lower(F.trim(kind)).alias("document_type"),
        ))

    return bound(F.from_json(fenced_json(reply), "struct<summary:string,key_points:array<string>,topics:array<string>,document_type:string>"), made)
