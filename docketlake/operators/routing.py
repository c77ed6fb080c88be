"""Where crawls of known sites begin: listing pages of site groups, generic legal paths, deep pages of a host, and which links count there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

#: Paths where sites of authorities keep their law.
LEGAL_PATHS = (
    "/en/laws", "/ar/laws", "/en/regulations", "/ar/regulations", "/en/legislation", "/ar/legislation", "/en/policies", "/ar/policies",
    "/en/circulars", "/ar/circulars", "/laws", "/regulations", "/legislation", "/policies", "/documents", "/library", "/docslibrary",
    "/en/documents", "/ar/documents", "/en/systems", "/ar/systems", "/en/rules", "/ar/rules",
)
#: Words that tell a bill, act or gazette in a link's URL or text.
BILL_WORDS = ("bill", "amend", "act", "law", "gazette", "regulation", "statut", "pdf")
#: A group's markers, which its hosts contain, its listing pages, and which of their links count.
GROUPS = {
    "us": (("congress.gov", "govinfo.gov"), ("https://www.congress.gov/search?q=%7B%22source%22%3A%22legislation%22%7D&pageSort=latestAction%3Adesc", "https://www.govinfo.gov/app/collection/bills", "https://www.govinfo.gov/app/collection/fr"), "bill"),
    "canada": (("parl.ca", "canada.ca", "gazette.gc.ca"), ("https://openparliament.ca/bills/", "https://www.parl.ca/legisinfo/en/bills/rss", "https://www.gazette.gc.ca/rp-pr/p2/index-eng.html", "https://www.gazette.gc.ca/rp-pr/p1/index-eng.html"), "bill"),
    "spain": (("boe.es", "congreso.es"), ("https://www.boe.es/diario_boe/", "https://www.boe.es/buscar/legislacion.php", "https://www.congreso.es/es/proyectos-de-ley"), "pdf path or text"),
    "germany": (("bundestag.de", "gesetze-im-internet.de", "recht.bund.de"), ("https://www.bundestag.de/services/opendata", "https://dip.bundestag.de", "https://www.gesetze-im-internet.de/"), "pdf"),
    "france": (("legifrance.gouv.fr", "assemblee-nationale.fr"), ("https://www.legifrance.gouv.fr/jorf/jo", "https://www.assemblee-nationale.fr/dyn/16/textes"), "bill"),
    "new zealand": (("legislation.govt.nz", "parliament.nz", "gazette.govt.nz"), ("https://www.legislation.govt.nz/subscribe/atom.aspx?subscriptiontype=0&subscriptionid=0", "https://www.legislation.govt.nz/bill/government/recent.aspx", "https://gazette.govt.nz/home/NoticeSearch?noticeType=go"), "bill"),
    "australia": (("legislation.gov.au", "aph.gov.au"), ("https://www.legislation.gov.au/WhatsNew", "https://www.legislation.gov.au/Browse/Results/ByPublicationDate/Acts/Asmade/0/0/All/Principal", "https://www.aph.gov.au/Parliamentary_Business/Bills_Legislation/Bills_Search_Results/Result?bId=r"), "bill or download"),
    "india": (("prsindia.org", "egazette", "sansad.in"), ("https://prsindia.org/billtrack", "https://prsindia.org/billtrack/filter/recent", "https://sansad.in/ls/legislation/bills"), "bill"),
    "japan": (("e-gov.go.jp", "shugiin.go.jp", "sangiin.go.jp", "kanpou"), ("https://www.e-gov.go.jp/", "https://www.shugiin.go.jp/internet/itdb_gian.nsf/html/gian/menu.htm"), "pdf"),
    "brazil": (("planalto.gov.br", "camara.leg.br", "in.gov.br"), ("https://www.in.gov.br/leiturajornal", "https://www.camara.leg.br/proposicoesWeb/prop_lista?sigla=PL&tipoAutor=todos", "https://www.planalto.gov.br/ccivil_03/_ato2023-2026/2024/lei/"), "bill"),
    "ireland": (("oireachtas.ie", "irisoifigiuil.ie", "irishstatutebook.ie"), ("https://www.oireachtas.ie/en/bills/", "https://www.irishstatutebook.ie/eli/isbc/recent.html", "https://www.irisoifigiuil.ie/"), "bill"),
    "singapore": (("parliament.gov.sg", "sso.agc.gov.sg"), ("https://www.parliament.gov.sg/parliamentary-business/bills-introduced", "https://sso.agc.gov.sg/Browse/Act/Current", "https://sso.agc.gov.sg/Browse/SL/Current"), "bill"),
    "eu": (("eur-lex.europa.eu", "europarl.europa.eu"), ("https://eur-lex.europa.eu/oj/direct-access.html", "https://eur-lex.europa.eu/search.html?scope=EURLEX&type=quick&lang=en&DTS_DOM=EU_LAW&qid="), "pdf text"),
}


def _contains(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def listing_seeds(sources: DataFrame, groups: dict = GROUPS) -> DataFrame:
    """(k, group, seed): the listing pages of each group one of whose markers the host of a source (k, url) contains.

    A marker may stand anywhere in the host, so there is no key to join on; the groups are a constant of the plan, tested
    where a source is read, and no source leaves its task. Sources without host have none.
    """
    host = U.host_of(F.col("url"))
    own = [F.when(_contains(host, marks), F.struct(F.lit(g).alias("group"), F.array(*[F.lit(p) for p in pages]).alias("pages"))) for g, (marks, pages, _) in groups.items()]
    met = sources.select("k", F.explode(F.array_compact(F.array(*own))).alias("g"))
    return met.select("k", "g.group", F.explode("g.pages").alias("seed"))


def legal_seeds(sources: DataFrame, deep: DataFrame, paths=LEGAL_PATHS) -> DataFrame:
    """(k, seed): every legal path on the site of a source (k, url), and the deep pages (marker, seed) of its host.

    A marker counts for its host and all below it. Sources without host have none; a seed counts once a source.
    """
    host = U.host_of(F.col("url"))
    sites = sources.select("k", F.regexp_extract(F.trim("url"), "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1).alias("site"), host.alias("host")).where("host <> ''")
    generic = sites.where("site <> ''").select("k", F.explode(F.transform(F.array(*[F.lit(p) for p in paths]), lambda p: F.concat("site", p))).alias("seed"))
    below = sites.select("k", F.explode(U.host_suffixes(F.col("host"), 1)).alias("marker"))
    return generic.unionByName(below.join(deep, "marker").select("k", "seed")).distinct()


def group_links(links: DataFrame, groups: dict = GROUPS) -> DataFrame:
    """(k, group, url, text): links (k, group, url, text) of listing pages that count in their group; null texts are empty.

    PDF files count everywhere. Other links count by the group's rule: what reads like a bill, what says PDF in its text, or
    path, or offers a download. An act or bill of New Zealand also has its whole text as a PDF, which is added.
    """
    text = F.coalesce("text", F.lit(""))
    low, both = F.lower("url"), F.lower(F.concat_ws(" ", "url", text))
    bill = _contains(both, BILL_WORDS)
    rules = {
        "pdf": F.lit(False), "bill": bill, "bill or download": bill | text.contains("Download"), "pdf text": F.lower(text).contains("pdf"),
        "pdf path or text": low.contains("/pdf") | F.lower(text).contains("pdf"),
    }
    named = {rule: [g for g, (_, _, r) in groups.items() if r == rule] for rule in rules}
    counts = reduce(lambda a, b: a | b, [F.col("group").isin(gs) & rules[rule] for rule, gs in named.items() if gs])
    kept = F.when(F.col("group").isin(list(groups)) & (low.contains(".pdf") | counts), F.col("url"))
    whole = F.when((F.col("group") == "new zealand") & _contains(F.col("url"), ("/act/", "/bill/")), F.concat(F.replace("url", F.lit("/whole.html"), F.lit("")), F.lit("/latest/whole.pdf")))
    return links.select("k", "group", F.explode(F.array_compact(F.array(kept, whole))).alias("url"), text.alias("text")).distinct()
