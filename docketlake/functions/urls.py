"""URL and identifier columns. All are native expressions; null and blank URLs give '' or null as stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*)://"
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
#: Query parameters that only track visits, by profile.
TRACKING = {"crawl": "utm_[^=&]*|gclid|fbclid|mc_cid|mc_eid", "pipeline": "utm_[^=&]*|gclid|fbclid"}
#: Document extensions and their types, MIME types and their types.
EXTENSION_TYPES = {"pdf": "PDF", "doc": "DOC", "docx": "DOCX", "xls": "XLS", "xlsx": "XLSX", "ppt": "PPT", "pptx": "PPTX", "csv": "CSV", "rtf": "RTF", "odt": "ODT", "ods": "ODS", "txt": "TXT"}
MIME_TYPES = {
    "application/pdf": "PDF", "application/msword": "DOC", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "DOCX",
    "application/vnd.ms-excel": "XLS", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "XLSX", "application/vnd.ms-powerpoint": "PPT",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "PPTX", "text/csv": "CSV", "application/rtf": "RTF",
    "application/vnd.oasis.opendocument.text": "ODT", "application/vnd.oasis.opendocument.spreadsheet": "ODS", "text/plain": "TXT",
}
DOC_EXTENSIONS = r"\.(?:pdf|doc|docx|xls|xlsx|ppt|pptx|csv)$"
PDF_LINK = r"(?i)\.pdf(\.aspx)?($|\?|#|;)"
ATTACHMENT = r"(?i)/getattachment/.*\.pdf"
FILE_ENDPOINT = r"(?i)/(websitefile|sharedfile|downloadfile|getfile|filedownload|download\.ashx)(/|$|\?)"
#: Path markers of pages that are visited first and second.
FIRST_PAGES = "knowledgecenter|researchlibrary|/documents|regulations|policies|mediacenter|datasource|_api/|newsletter|ruleslibrary|docscenter|websitefile|sharedfile|legislation|/doc/|infocenter"
SECOND_PAGES = "/about|/sectors|/research|eparticipation|informationcenter"
JUNK_PATH = r"(?i)(?:/news(?:/|$)|/media(?:/|$)|/press|/events?(?:/|$)|/careers?|/jobs|/tenders?(?:/|$)|/procurement|/gallery|/videos?|/blog|/social|/about(?:-us)?(?:/|$)|/contact|/faq|/training|/workshop|/conference|portalindicators|/researchs/portal)"
LEGAL_PATH = r"(?i)(?:/laws?(?:/|$)|/legislation|/regulations?|/legal|/circulars?|/decrees?|/policies|/policy|/rules|/bylaws?|/compliance|/licensing|/systems?(?:/|$)|/statutes?|/documents?/legal|/docslibrary|/library/laws|/e-services/regulations|نظام|لائحة|تشريع|قانون|تعميم|قرار|ضوابط|اشتراطات|%D9%86%D8%B8%D8%A7%D9%85|%D9%84%D8%A7%D8%A6%D8%AD%D8%A9)"
#: Companion hosts that count as one site.
COMPANIONS = (
    ("sama.gov.sa", "rulebook.sama.gov.sa"),
    ("moj.gov.sa", "laws.moj.gov.sa"),
    ("cma.org.sa", "cma.gov.sa"),
    ("gosi.gov.sa", "cmsgosi.gosi.gov.sa"),
    ("sdaia.gov.sa", "dgp.sdaia.gov.sa", "ndmo.sdaia.gov.sa"),
)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, AUTHORITY, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, QUERY, 1)


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and leading www.; '' where there is none."""
    bare = F.regexp_replace(F.regexp_replace(netloc(F.trim(url)), r"^.*@", ""), r":\d*$", "")
    return F.coalesce(F.regexp_replace(bare, r"^www\.", ""), F.lit(""))


def normalize_url(url: Column, profile: str = "crawl") -> Column:
    """One spelling for each URL.

    ``crawl`` and ``pipeline`` lower the host, default to https, join slashes, drop ';' parameters, fragment and tracking
    parameters; ``pipeline`` also drops default ports. ``light`` trims and drops the fragment. ``key`` drops fragment,
    five tracking parameters and the last slash, and lowers everything.
    """
    url = F.trim(url)
    if profile == "light":
        return F.regexp_replace(url, "#.*$", "")
    if profile == "key":
        kept = _without(F.regexp_replace(url, "#.*$", ""), "utm_source|utm_medium|utm_campaign|gclid|fbclid")
        return F.lower(F.regexp_replace(kept, "/$", ""))
    how = F.when(scheme(url) == "", F.lit("https")).otherwise(scheme(url))
    site = netloc(url)
    if profile == "pipeline":
        site = F.when(how == "https", F.regexp_replace(site, ":443$", "")).otherwise(F.regexp_replace(site, ":80$", ""))
    path = F.regexp_replace(F.regexp_replace(path_of(url), ";[^/]*$", ""), "/+", "/")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    kept = F.array_join(F.filter(F.split(query_of(url), "&"), lambda x: (x != "") & ~x.rlike(f"^({TRACKING[profile]})=")), "&")
    return F.concat(how, F.lit("://"), site, path, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)))


def _without(url: Column, names: str) -> Column:
    kept = F.array_join(F.filter(F.split(query_of(url), "&"), lambda x: (x != "") & ~x.rlike(f"^({names})=")), "&")
    return F.concat(F.regexp_replace(url, r"\?.*$", ""), F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)))


def resolve_url(base: Column, href: Column) -> Column:
    """``href`` as seen from the page ``base`` (RFC 3986 without its rarest cases); dot segments are folded."""
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    joined = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.\\-]*:)", 1), href))
        .when(href == "", F.regexp_replace(base, "#.*$", ""))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(site, path_of(base), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(site, folder, href))
    )
    return F.when(joined.rlike(r"/\.\.?(/|$|\?|#)"), _folded(joined)).otherwise(joined)


def _folded(url: Column) -> Column:
    parts = F.split(F.regexp_replace(path_of(url), "^/", ""), "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    closed = F.when(path_of(url).rlike(r"/\.\.?$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1), F.lit("/"), F.array_join(kept, "/"), closed, F.regexp_extract(url, r"^[^?#]*(.*)$", 1))


def is_same_site(host: Column, seed: Column, one_way: bool = False, exact: bool = False, companions=COMPANIONS) -> Column:
    """Equal hosts, ``host`` below ``seed``, ``seed`` below ``host`` or both of one group of ``companions``. Blank hosts never match.

    ``one_way`` leaves out hosts above the seed and companions; ``exact`` asks for equal hosts but for www.
    """
    bare = lambda h: F.regexp_replace(F.lower(F.coalesce(h, F.lit(""))), r"^www\.", "")
    host, seed = bare(host), bare(seed)
    known = (host != "") & (seed != "")
    if exact:
        return known & (host == seed)
    below = F.concat(F.lit("."), host).endswith(F.concat(F.lit("."), seed))
    if one_way:
        return known & below
    above = F.concat(F.lit("."), seed).endswith(F.concat(F.lit("."), host))
    group = F.lit(False)
    for hosts in companions:
        group = group | (host.isin(*hosts) & seed.isin(*hosts))
    return known & (below | above | group)


def looks_like_doc(url: Column) -> Column:
    path = F.lower(F.regexp_replace(path_of(url), ";[^/]*$", ""))
    wcm = F.lower(url).contains(".pdf") & F.lower(url).rlike("/wps/wcm/|getattachment")
    return path.rlike(DOC_EXTENSIONS) | url.rlike(PDF_LINK) | url.rlike(ATTACHMENT) | url.rlike(FILE_ENDPOINT) | wcm


def is_pdf_url(url: Column) -> Column:
    return F.lower(url).contains(".pdf") | url.rlike(FILE_ENDPOINT)


def doc_type(url: Column, content_type: Column) -> Column:
    """Type by extension, else by MIME type, else null."""
    ext = F.regexp_extract(F.lower(path_of(url)), r"\.([a-z]+)$", 1)
    mime = F.trim(F.lower(F.regexp_extract(content_type, "^([^;]*)", 1)))
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.try_element_at(table(EXTENSION_TYPES), ext), F.try_element_at(table(MIME_TYPES), mime))


def slugify(text: Column) -> Column:
    """Word characters only, blanks and hyphens as one underscore, at most 80 characters, 'unknown' where nothing is left."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("unknown")), r"[^\p{L}\p{N}_\s\-]", "")
    joined = F.regexp_replace(F.regexp_replace(F.trim(clean), r"[\-\s]+", "_"), "^_+|_+$", "")
    return F.when(joined == "", F.lit("unknown")).otherwise(F.substring(joined, 1, 80))


def safe_filename(url: Column, title: Column) -> Column:
    """A file name ending in .pdf for a URL; long names are cut and hashed, generic ones take the title's slug."""
    last = F.regexp_extract(path_of(url), "([^/]*)/?$", 1)
    name = F.coalesce(F.try_url_decode(last), last)
    name = F.when(name == "", F.lit("document.pdf")).otherwise(F.regexp_replace(name, ";.*$", ""))
    name = F.regexp_replace(name, r"(?i)\.aspx$", "")
    name = F.when(F.lower(name).contains(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))
    name = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_.\-()+ ]+", "_"), r"^[ ._]+|[ ._]+$", "")
    name = F.when(name == "", F.lit("document.pdf")).otherwise(name)
    mark = content_key(url)
    name = F.when(F.length(name) > 140, F.concat(F.substring(F.regexp_replace(name, r"\.[^.]*$", ""), 1, 100), F.lit("_"), mark, F.lit(".pdf"))).otherwise(name)
    slug = F.when(F.trim(F.coalesce(title, F.lit(""))) == "", mark).otherwise(F.substring(slugify(title), 1, 40))
    return F.when(F.lower(name).isin("document.pdf", "file.pdf", "download.pdf", "pdf.pdf"), F.concat(slug, F.lit(".pdf"))).otherwise(name)


def title_hint(name: Column) -> Column:
    """A file name as words: without extension, signs as blanks, words capitalised."""
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", "")
    return F.initcap(F.trim(F.regexp_replace(stem, r"[_\-+.]+", " ")))


def split_urls(cell: Column) -> Column:
    """The URLs of a cell, split at ';', '|' and line ends, with a scheme."""
    parts = F.filter(F.transform(F.split(cell, r"[;\n|]+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, coerce_scheme)


def coerce_scheme(url: Column) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), F.regexp_replace(url, "^/+", "")))


def start_url_candidates(url: Column) -> Column:
    """The normalised URL, then each spelling of its host with each usual front page, distinct and in order."""
    first = normalize_url(coerce_scheme(url), "pipeline")
    host = F.regexp_replace(netloc(first), r":\d*$", "")
    bare = F.regexp_replace(host, r"^www\.", "")
    made = [F.concat(F.lit("https://"), h, F.lit(p)) for h in (host, bare, F.concat(F.lit("www."), bare)) for p in ("/", "/en/", "/ar/", "/en", "/ar")]
    return F.array_distinct(F.array(first, *made))


def flip_www(url: Column) -> Column:
    """The same URL with www. added to or taken from its host; default ports go."""
    site = F.regexp_replace(netloc(url), r":(80|443)$", "")
    other = F.when(site.startswith("www."), F.substring(site, 5, 10_000)).otherwise(F.concat(F.lit("www."), site))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$", 1)
    return F.when(site == "", url).otherwise(F.concat(scheme(url), F.lit("://"), other, rest))


def content_key(x: Column) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(x, 256), 1, 16)


def stable_id(*parts: Column, prefix: str = "", digits: int = 16) -> Column:
    """SHA-1 of the parts joined by '|' (null: ''), cut to ``digits``, after ``prefix`` and '_' if given."""
    digest = F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])), 1, digits)
    return F.concat(F.lit(f"{prefix}_"), digest) if prefix else digest


def display_url(url: Column, most: int = 48) -> Column:
    shown = F.regexp_replace(url, "^https?://", "")
    return F.when(F.length(shown) > most, F.concat(F.substring(shown, 1, most - 1), F.lit("…"))).otherwise(shown)


def format_bytes(n: Column) -> Column:
    kb, mb = F.round(n / 1024).cast("long").cast("string"), F.format_string("%.1f", F.bround(n / 1048576, 1))
    return F.when(n.isNull() | (n <= 0), F.lit("")).when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(kb, F.lit(" KB"))).otherwise(F.concat(mb, F.lit(" MB")))


def format_kind(kind: Column) -> Column:
    return F.initcap(F.regexp_replace(F.coalesce(kind, F.lit("")), "_", " "))


def is_http_url(url: Column) -> Column:
    return F.coalesce(url.rlike("(?i)^https?://"), F.lit(False))


def page_priority(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.rlike(FIRST_PAGES), 0).when(low.rlike(SECOND_PAGES), 1).otherwise(2)


def is_junk_page(url: Column) -> Column:
    path = path_of(url)
    return F.coalesce(F.try_url_decode(path), path).rlike(JUNK_PATH)


def is_legal_priority_page(url: Column) -> Column:
    path = path_of(url)
    return F.coalesce(F.try_url_decode(path), path).rlike(LEGAL_PATH) | url.rlike(LEGAL_PATH)


def host_suffixes(host: Column, least_labels: int = 2) -> Column:
    """The host and its parents of ``least_labels`` labels or more, longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    tails = F.transform(F.sequence(F.lit(0), F.greatest(n - least_labels, F.lit(0))), lambda i: F.array_join(F.slice(labels, i + 1, n), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(tails)
