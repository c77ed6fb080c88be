"""Classification and catalog queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import urls as U
from ..operators import catalog as K
from ..operators.search import search, write_index
from ..operators.storage import numbered, saved, shared_dir
from . import sqlx as X
from .inputs import load, projection, with_inputs

QUERIES, SQL = {}, {}
query = projection(QUERIES, SQL)


def register(name: str, oracle: str, *tables: str):
    """Decorator: the query's function, with its SQL over the derived tables ``tables``."""
    def keep(fn):
        QUERIES[name] = fn
        SQL[name] = with_inputs(oracle, *tables) if tables else oracle
        return fn

    return keep


def cases(x: str, rules, otherwise: str) -> str:
    return "case " + " ".join(f"when {X.matches(x, p)} then '{v}'" for p, v in rules) + f" else {otherwise} end"


def values(table: dict[str, str], x: str, otherwise: str) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + f" else {otherwise} end"


def words(text: str) -> str:
    raw = f"url || ' ' || {X.path('url')} || ' ' || case when {{name}} <> '' then {{name}} else {X.extract(X.path('url'), '([^/]*)$')} end || ' ' || title || ' ' || {text}"
    return f"replace(regexp_replace(lower(regexp_replace(regexp_replace({raw}, '(?i)iot', '§IOT§', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')), '[_\\-./]+', ' ', 'g'), '§iot§', ' iot ')"


def score(name: str, text: str) -> str:
    blob, path = words(text).format(name=name), X.path("url")
    file = f"case when {name} <> '' then {name} else {X.extract(path, '([^/]*)$')} end"
    label = f"lower(trim(case when title <> '' then title else {text} end))"
    generic = ", ".join(f"'{t}'" for t in C.GENERIC_TITLES)
    return (
        f"case when trim({blob}) = '' then 0 when {X.matches(blob, C.REJECT)} then -100 else case when {X.matches(blob, C.KEEP)} then 40 else 0 end + case when {X.matches(path, U.LEGAL_PATH)} or {X.matches('url', U.LEGAL_PATH)} then 25 else 0 end"
        f" + case when {X.matches(path, U.JUNK_PATH)} then -30 else 0 end + case when {X.matches(file, C.KEEP)} then 20 else 0 end + case when {label} not in ({generic}) and {X.matches(label, C.KEEP)} then 15 else 0 end end"
    )


query("c1_relevance_text", "downloads", lambda url, title: {"words": C.relevance_text(url, title, F.col("filename"), F.lit(""))}, {"words": words("''").format(name="filename")})
query("c2_regulatory_score", "downloads", lambda url, title: {"score": C.regulatory_score(url, title, F.col("filename"), F.lit(""))}, {"score": score("filename", "''")})


@register("c3_split_regulatory", f"select k, {score(chr(39) * 2, 'title')} as score, {score(chr(39) * 2, 'title')} >= 15 as kept from downloads", "downloads")
def _(spark, sf):
    kept, rejected = K.split_regulatory(load(spark, sf, "downloads").select("k", "url", "title"))
    return kept.select("k", "score", F.lit(True).alias("kept")).unionByName(rejected.select("k", "score", F.lit(False).alias("kept")))


@register("c4_prune_junk", f"select jurisdiction, count(*) as n from downloads where not (source_kind = 'site') or {score('filename', chr(39) * 2)} >= 15 group by jurisdiction", "downloads")
def _(spark, sf):
    return K.prune_junk(load(spark, sf, "downloads"), F.col("source_kind") == "site").groupBy("jurisdiction").agg(F.count("*").alias("n"))


_blob = "title || ' ' || filename || ' ' || url"
_type = cases(_blob, C.LAW_TYPES, values(C.KIND_TYPES, "source_kind", "'other'"))
_years = f"list_reverse_sort(list_distinct(list_filter(list_transform(regexp_extract_all({_blob}, '(?:19|20)[0-9]{{2}}'), lambda y: cast(y as int)), lambda y: y between 1990 and 2035)))"
_years = f"case when len({_years}) > 0 then {_years} else [cast(downloaded_at[1:4] as int)] end"
_lang = cases("lower(title || ' ' || filename)", C.NAME_LANGUAGES, values(C.JURISDICTION_LANGUAGES, "jurisdiction", "'und'"))
_tags = "list_filter([" + ", ".join(f"case when {X.matches('filename', p)} then '{t}' end" for p, t in C.NAME_TAGS) + "], lambda x: x is not null)"
query("c5_law_type", "downloads", lambda url, title: {"law_type": C.law_type(title, F.col("filename"), url, F.col("source_kind"))}, {"law_type": _type})
query(
    "c6_years", "downloads", lambda url, title: {"years": F.array_join(C.years(title, F.col("filename"), url, F.col("downloaded_at")), ","), "year": F.try_element_at(C.years(title, F.col("filename"), url, F.col("downloaded_at")), F.lit(1))},
    {"years": f"array_to_string({_years}, ',')", "year": f"({_years})[1]"},
)
query("c7_language", "downloads", lambda url, title: {"language": C.language(F.col("jurisdiction"), title, F.col("filename"))}, {"language": _lang})
query("c8_filename_signals", "downloads", lambda url, title: {"tags": F.array_join(C.filename_signals(F.col("filename")), ",")}, {"tags": f"array_to_string({_tags}, ',')"})
ENRICHED = f"""select k, sha256 as id, title, filename, jurisdiction, source_kind, {_type} as law_type, ({_years})[1] as year, array_to_string({_years}, ',') as years, {_lang} as language, 'downloaded' as status,
  {X.host('url')} as host, array_to_string({_tags}, ',') as filename_tags, url, url as open_url, bytes, sha256, downloaded_at
  from (select * replace (case when title <> '' then title else f end as title, f as filename) from (select *, case when filename <> '' then filename when title <> '' then title else 'doc_' || k || '.pdf' end as f from downloads))"""


@register("c9_enrich", ENRICHED, "downloads")
def _(spark, sf):
    return K.enrich(load(spark, sf, "downloads")).withColumn("years", F.array_join("years", ",")).withColumn("filename_tags", F.array_join("filename_tags", ","))


def country(x: str) -> str:
    return values(C.ALIASES, f"lower(trim({x}))", f"trim({x})")


_units = {u: c for c, names in C.UNITS.items() for u in names}
_unit_list = ", ".join(f"'{u}'" for u in _units)


def parent(x: str) -> str:
    return values(_units, f"lower(trim({x}))", country(x))


def place_cte(source: str, raw: str, unit: str, name: str = "placed") -> str:
    """CTEs that add country, level and level_detail to ``source``."""
    return rf"""{name}0 as (select *, trim({raw}) as s_, trim({unit}) as u_ from {source}),
    {name}1 as (select *, coalesce(nullif(trim(regexp_replace(s_, '(?i)\s*[-–—]?\s*federal\b', '', 'g')), ''), s_) as bare_, trim(regexp_extract(s_, '^(.+?)\s*[-–—]\s*(.+)$', 1)) as l_, trim(regexp_extract(s_, '^(.+?)\s*[-–—]\s*(.+)$', 2)) as r_ from {name}0),
    {name}2 as (select *, coalesce(nullif({parent('u_')}, ''), nullif({parent('s_')}, ''), {country('s_')}) as p_ from {name}1),
    {name}3 as (select *, case when lower(u_) = 'federal' then 1 when u_ <> '' then 2 when s_ = '' then 3 when regexp_matches(s_, '(?i)\bfederal\b') then 4 when lower(s_) in ({_unit_list}) then 5
      when l_ <> '' and (lower(r_) in ({_unit_list}) or lower(l_) in ('us', 'usa', 'canada', 'australia', 'uk')) then 6 else 7 end as c_ from {name}2),
    {name} as (select * exclude (s_, u_, bare_, l_, r_, p_, c_), case c_ when 1 then {country('bare_')} when 2 then case when p_ <> '' and lower(p_) <> lower(u_) then p_ when {country('s_')} <> '' then {country('s_')} else p_ end
      when 3 then '' when 4 then {country('bare_')} when 5 then {parent('s_')} when 6 then {country('l_')} else {country('s_')} end as country_,
      case when c_ in (2, 5, 6) then 'State' else 'Federal' end as level, case c_ when 2 then u_ when 5 then s_ when 6 then r_ else 'Federal' end as level_detail from {name}3)"""


@register("c10_parse_jurisdiction", f"with {place_cte('tracking', 'country', 'federal_or_state')} select k, country_ as country, level, level_detail from placed", "tracking")
def _(spark, sf):
    return load(spark, sf, "tracking").select("k", C.parse_jurisdiction(F.col("country"), F.col("federal_or_state")).alias("p")).select("k", "p.*")


@register("c10_parse_registry_jurisdiction", f"with {place_cte('registry', 'jurisdiction', chr(39) * 2)} select k, country_ as country, level, level_detail from placed", "registry")
def _(spark, sf):
    return load(spark, sf, "registry").select("k", C.parse_jurisdiction(F.col("jurisdiction")).alias("p")).select("k", "p.*")


def area(x: str) -> str:
    flat = f"trim(regexp_replace(replace({x}, ';', ','), '\\s+', ' ', 'g'))"
    parts = f"flatten(list_transform(list_filter(list_transform(string_split({flat}, ','), lambda p: trim(p)), lambda p: p <> ''), lambda p: case lower(p) when 'capital markets' then ['Capital'] when 'capital market' then ['Capital'] when 'private markets' then ['Private'] when 'private market' then ['Private'] when 'private & capital' then ['Private', 'Capital'] when 'capital & private' then ['Capital', 'Private'] else [p] end))"
    return f"array_to_string(list_filter({parts}, lambda p, i: list_position(list_transform({parts}, lambda q: lower(q)), lower(p)) = i), ', ')"




@register("c11_normalize_country", f"select k, {country('jurisdiction')} as country, {country('n_name')} as nation from registry", "registry")
def _(spark, sf):
    return load(spark, sf, "registry").select("k", C.normalize_country(F.col("jurisdiction")).alias("country"), C.normalize_country(F.col("n_name")).alias("nation"))


@register("c12_normalize_law_area", f"select k, {area('law_area')} as law_area from tracking", "tracking")
def _(spark, sf):
    return load(spark, sf, "tracking").select("k", C.normalize_law_area(F.col("law_area")).alias("law_area"))


def clean(x: str) -> str:
    t = f"regexp_replace(trim({x}), '\\s+', ' ', 'g')"
    return f"case when lower({t}) in ('click here', 'read more', 'here', 'pdf', 'download', 'link') then '' else {t} end"


@register("c13_clean_title", f"select k, {clean('title')} as title from updates", "updates")
def _(spark, sf):
    return load(spark, sf, "updates").select("k", C.clean_title(F.col("title")).alias("title"))


def summary(remarks: str, comments: str, source: str) -> str:
    topics = "list_filter(list_transform(regexp_split_to_array(topic, '[,;]'), lambda x: trim(x)), lambda x: x <> '')"
    said = f"({remarks} <> '' and lower({remarks}) <> lower(name))"
    where = "case when level = 'State' and level_detail <> '' and level_detail <> level then case when country <> '' then level_detail || ' (' || country || ')' else level_detail end when level = 'Federal' and country <> '' then country || ' (federal)' else country end"
    bits = f"""concat_ws(' · ', case when {said} then {remarks} end,
      case when topic <> '' and lower(topic) <> lower(name) and not ({said} and lower(topic) = lower({remarks})) and len({topics}) > 0 then 'Topics: ' || array_to_string(({topics})[1:4], ', ') || case when len({topics}) > 4 then ' (+' || (len({topics}) - 4) || ' more)' else '' end end,
      case when law_area <> '' then 'Law area: ' || law_area end, case when {where} <> '' then 'Jurisdiction: ' || {where} end, case when authority <> '' then 'Issued / tracked under: ' || authority end, case when {comments} <> '' then {comments} end,
      case when rel <> '' and rel not in ('Pending', 'seed') then 'Relevancy: ' || rel when rel = 'Pending' and '{source}' = 'collector' then 'Awaiting analyst review' end)"""
    return f"case when {bits} = '' then 'Regulatory / legal update.' when length({bits}) > 480 then {bits}[1:477] || '…' else {bits} end"


#: Registry hosts and the authority of each link host, as SQL; ``links`` is a CTE (k, link).
MATCH = f"""hosts_ as (select k, {X.host('link')} as host from links), usable_ as (select *, {X.host('url')} as host from registry where trim(authority) <> '' and starts_with(url, 'http')),
  first_ as (select host, min(k) as k from usable_ where host <> '' group by host), best_ as (select l.host, min(case when l.host = f.host then (0, 0, f.k) when ends_with(l.host, '.' || f.host) then (1, -length(f.host), f.k) else (2, 0, f.k) end) as b
    from (select distinct host from hosts_ where host <> '') l join first_ f on l.host = f.host or ends_with(l.host, '.' || f.host) or ends_with(f.host, '.' || l.host) group by l.host),
  matched as (select h.k, trim(u.authority) as name, trim(u.url) as url, u.jurisdiction, u.region from hosts_ h join best_ on h.host = best_.host join usable_ u on u.k = b[3])"""
UPDATES_LAWS = f"""links as (select k, link from updates), {MATCH},
  ujoin as (select u.*, coalesce(nullif({clean('title')}, ''), nullif(trim(title), ''), 'Untitled update') as name, m.name as m_name, m.url as m_url, m.jurisdiction as m_j, trim(source_url) = '' or trim(u.authority) = '' as ask from updates u left join matched m on u.k = m.k),
  {place_cte('ujoin', 'country', chr(39) * 2, 'up1')}, {place_cte('up1x', "coalesce(m_j, '')", chr(39) * 2, 'up2').replace('up1x', "(select * rename (country_ as c1, level as l1, level_detail as d1) from up1)")},
  urows as (select k, id, name, case when c1 = '' and ask and coalesce(m_j, '') <> '' then country_ else c1 end as country, case when c1 = '' and ask and coalesce(m_j, '') <> '' then level else l1 end as level, case when c1 = '' and ask and coalesce(m_j, '') <> '' then level_detail else d1 end as level_detail,
    {area('law_area')} as law_area, trim(topical_relevance) as topic, trim(link) as link, case when trim(authority) <> '' then trim(authority) when ask then coalesce(m_name, '') else '' end as authority, case when trim(source_url) <> '' then trim(source_url) else coalesce(m_url, '') end as authority_url,
    region, discovered_at as date, 'collector' as source, trim(relevancy) as rel, alert_status from up2),
  ulaws as (select k, id, name, {summary("''", "''", 'collector')} as summary, country, level, level_detail, law_area, topic, link, authority, authority_url, region, date, source, case when rel = '' then 'Pending' else rel end as relevancy, alert_status from urows)"""
TRACKING_LAWS = f"""links as (select k, link from tracking), {MATCH},
  tjoin as (select t.*, coalesce(nullif({clean('remarks')}, ''), nullif(trim(remarks), ''), nullif(trim(topical_relevance), ''), 'Tracked update') as name, m.name as m_name, m.url as m_url, m.region as m_region from tracking t left join matched m on t.k = m.k),
  {place_cte('tjoin', 'country', 'federal_or_state', 'tp')},
  trows as (select k, sha1('trk|' || trim(link) || '|' || name)[1:16] as id, name, country_ as country, level, level_detail, {area('law_area')} as law_area, trim(topical_relevance) as topic, trim(link) as link, coalesce(m_name, '') as authority, coalesce(m_url, '') as authority_url, coalesce(m_region, '') as region,
    case when date_of_publication <> '' then date_of_publication else date_of_tracking end as date, 'tracking' as source, trim(relevancy) as rel, alert_status, case when trim(remarks) <> name then trim(remarks) else '' end as rem, trim(comments) as com from tp),
  tlaws as (select k, id, name, {summary('rem', 'com', 'tracking')} as summary, country, level, level_detail, law_area, topic, link, authority, authority_url, region, date, source, rel as relevancy, alert_status from trows)"""
SOURCE_LAWS = f"""{place_cte("(select * from registry where trim(authority) <> '' and starts_with(url, 'http'))", 'jurisdiction', chr(39) * 2, 'sp')},
  srows as (select k, sha1('src|' || trim(url) || '|' || trim(authority))[1:16] as id, trim(authority) as name, country_ as country, level, level_detail, {area('segment')} as law_area, array_to_string(list_filter(string_split(topics, ','), lambda x: x <> ''), ', ') as topic, trim(url) as link, trim(authority) as authority, trim(url) as authority_url, region,
    '' as date, 'source' as source, '' as rel, status as alert_status, concat_ws(' · ', case when authority_type <> '' then authority_type || ' authority' end, case when link_nature <> '' then link_nature end) as rem, case when status = 'active' then '' else 'Source status: ' || status end as com from sp),
  slaws as (select k, id, name, {summary('rem', 'com', 'source')} as summary, country, level, level_detail, law_area, topic, link, authority, authority_url, region, date, source, rel as relevancy, alert_status from srows)"""


@register("c15_laws_from_updates", f"with {UPDATES_LAWS} select * from ulaws", "updates", "registry")
def _(spark, sf):
    return K.law_rows_from_updates(load(spark, sf, "updates"), load(spark, sf, "registry"))


@register("c15_laws_from_tracking", f"with {TRACKING_LAWS} select * from tlaws", "tracking", "registry")
def _(spark, sf):
    return K.law_rows_from_tracking(load(spark, sf, "tracking"), load(spark, sf, "registry"))


@register("c14_summaries_of_sources", f"with {SOURCE_LAWS} select * from slaws", "registry")
def _(spark, sf):
    return K.law_rows_from_sources(load(spark, sf, "registry"))


@register("j1_match_authority", f"with links as (select k, link from updates), {MATCH} select * from matched", "updates", "registry")
def _(spark, sf):
    return K.match_authority(load(spark, sf, "updates").select("k", "link"), load(spark, sf, "registry"))


_UT = UPDATES_LAWS + ", " + TRACKING_LAWS.replace("links as (select k, link from tracking), " + MATCH, "").lstrip(", \n").replace("left join matched m on t.k = m.k", "left join tmatched m on t.k = m.k")
_TM = MATCH.replace("hosts_", "thosts_").replace("usable_", "tusable_").replace("first_", "tfirst_").replace("best_", "tbest_").replace("matched as", "tmatched as").replace("from links", "from tlinks")


_LAW_CTES = f"tlinks as (select k, link from tracking), {_TM}, {_UT}, {SOURCE_LAWS}, everything as (select 0 as rank, * from ulaws union all select 1, * from tlaws union all select 2, * from slaws)"
_LAW_ROWS = "select * exclude (rank, n) from (select *, row_number() over (partition by lower(case when link <> '' then link else name end) order by rank, k) as n from everything) where n = 1"
LAWS = f"{_LAW_CTES}, laws as ({_LAW_ROWS})"


@register(
    "x1_laws_catalog",
    f"with {_LAW_CTES} {_LAW_ROWS}",
    "updates", "tracking", "registry",
)
def _(spark, sf):
    return K.laws_catalog(load(spark, sf, "updates"), load(spark, sf, "tracking"), load(spark, sf, "registry"))


# rows of which some name a published ministry, by host in any case or by label as written
MINISTRIES = "select k, case k % 9 when 0 then 'https://SDAIA.gov.sa/' when 1 then 'https://www.mc.gov.sa/x' when 2 then 'https://tga.gov.example' when 3 then 'https://mewa.gov.sa' else url end as url, case k % 7 when 0 then 'Saudi Arabia - MC' when 1 then 'ministry of commerce' when 2 then 'Transport General Authority' when 3 then '' else jurisdiction end as jurisdiction, case when k % 4 = 0 then null else 'h' end as host from registry"


@register("c17_allowed_rows", f"""select k, contains(b, 'sdaia.gov.sa') or contains(b, 'dgp.sdaia') or contains(b, 'tga.gov.sa') or contains(b, 'mc.gov.sa') or contains(b, 'mewa.gov.sa') or regexp_matches(t, 'SDAIA|TGA|MEWA|Ministry of Commerce|Transport General|Environment, Water|Saudi Arabia - MC') as allowed,
  case when contains(b, 'sdaia') then 'Saudi Arabia - SDAIA' when contains(b, 'tga.gov') or contains(b, 'saudi arabia - tga') then 'Saudi Arabia - TGA' when contains(b, 'mewa.gov') or contains(b, 'saudi arabia - mewa') then 'Saudi Arabia - MEWA' when contains(b, 'mc.gov') or contains(b, 'saudi arabia - mc') or contains(b, 'ministry of commerce') then 'Saudi Arabia - MC' when trim(jurisdiction) = '' then 'Saudi Arabia' else trim(jurisdiction) end as label
  from (select k, jurisdiction, t, lower(t) as b from (select k, jurisdiction, jurisdiction || ' ' || coalesce(host, '') || ' ' || url as t from ({MINISTRIES})))""", "registry")
def _(spark, sf):
    load(spark, sf, "registry").createOrReplaceTempView("registry")
    none = F.lit(None).cast("string")
    text = C.ministry_text(F.col("jurisdiction"), F.col("host"), F.col("url"), none, none)
    return spark.sql(MINISTRIES).select("k", C.allowed(text).alias("allowed"), C.ministry_label(text, F.col("jurisdiction")).alias("label"))


@register("c18_source_status", "select k, case when trim(url) = '' then 'missing_url' when contains(lower(link_nature), 'not working') then 'broken' else 'active' end as status from registry", "registry")
def _(spark, sf):
    return load(spark, sf, "registry").select("k", C.source_status(F.col("url"), F.col("link_nature")).alias("status"))


_rank = "case " + " ".join(f"when contains(lower(jurisdiction), '{p}') then {i}" for i, p in enumerate(C.PRIORITY)) + " else 50 end"


@register("c19_due_sources", f"select k, {_rank} as rank from registry where url <> '' and status = 'active' and not contains(lower(frequency), 'less') order by rank, k limit 40", "registry")
def _(spark, sf):
    return K.due_sources(load(spark, sf, "registry"), even_day=False, limit=40).select("k", "rank")


_count = lambda p: f"len(regexp_extract_all(text, '{p}'))"
_scripts = (("ar", "[\\x{0600}-\\x{06FF}]"), ("zh-CN", "[\\x{4E00}-\\x{9FFF}]"), ("hi", "[\\x{0900}-\\x{097F}]"), ("ru", "[\\x{0400}-\\x{04FF}]"))
_total = " + ".join(_count(p) for _, p in (*_scripts, ("", "[A-Za-z]")))


@register("c20_script_language", "select doc_id, case " + " ".join(f"when ({_total}) > 0 and 4 * {_count(p)} > ({_total}) then '{v}'" for v, p in _scripts) + " else 'en' end as language from (select doc_id, text || case doc_id % 5 when 0 then repeat('نظام ', length(text)) when 1 then repeat('закон', length(text)) when 2 then repeat('हि法', length(text)) else '' end as text from documents)")
def _(spark, sf):
    tail = F.when(F.col("doc_id") % 5 == 0, F.repeat(F.lit("نظام "), F.length("text"))).when(F.col("doc_id") % 5 == 1, F.repeat(F.lit("закон"), F.length("text"))).when(F.col("doc_id") % 5 == 2, F.repeat(F.lit("हि法"), F.length("text"))).otherwise(F.lit(""))
    return load(spark, sf, "documents").select("doc_id", C.script_language(F.concat("text", tail)).alias("language"))


ASKED = ("How many PDFs do you have?", "list the documents please", "who are you", "Hello!", "will you read more files", "what is the rule on ", "give me a list", "still working?", "progress on ", "", "are there any new data to index", "what is eva", "display\nthose files", "keep  reading", "do you crawl", "I’ve an update", "what penalties apply")
_asked = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in ASKED) + "]"
_process = r"regexp_matches(q, '(read|reading|extract|extracting|index|indexing|process|processing|summariz(?:e|ing)?|crawl(?:ing)?|download(?:ing)?|fetch(?:ing)?)')"
_says = lambda p: rf"regexp_matches(q, '{p}')"
_inventory = _says(r"\b(list|show|display|name)\b") + " and " + _says(r"\b(pdfs?|summaries|documents?|files?|them|those|index)\b")
_service = " or ".join((
    _says(r"^(status|progress|update|hello|hi|hey|thanks|thank you)[\s?!.,]*$"), _says(r"\b(will|are|do|can|could|would)\s+you\b") + " and " + _process,
    _process + " and " + _says(r"\b(more|additional|new|further)\b") + " and " + _says(r"\b(pdfs?|documents?|files?|summaries|data)\b"), _says(r"\b(more|additional)\s+(pdfs?|documents?|files?)\b"),
    _says(r"\bhow many\b") + " and " + _says(r"\b(pdfs?|summaries|documents?)\b"), _says(r"\b(are you|do you)\b") + " and " + _process, _says(r"\bhave you (read|finished|done|indexed|extracted)\b"),
    _inventory, _says(r"\bgive me (a |the )?list\b"), _says(r"\b(still )?(working|running|crawling|indexing|extracting)\b"), _says(r"\b(progress|update me|status|coverage)\b"),
    _says(r"\b(who are you|what (can|do) you do|what is eva)\b"), _says(r"\bknowledge base\b"), _says(r"\b(keep|continue)\s+(reading|extracting|indexing)\b"),
))


@register("c21_route_question", f"""select conv_id, turn, case when q = '' or not ({_service}) then 'content' when regexp_matches(low, 'who are you|what (can|do) you do|hello|hi\\b|hey\\b') then 'identity' when {_inventory.replace('(q,', '(low,')} or regexp_matches(low, '\\bgive me (a |the )?list\\b') then 'list' else 'status' end as route
  from (select conv_id, turn, low, replace(trim(low), '’', chr(39)) as q from (select conv_id, turn, lower({_asked}[(conv_id + turn) % {len(ASKED)} + 1] || case when (conv_id + turn) % 3 = 0 then ' ' || text else '' end) as low from conversations))""")
def _(spark, sf):
    n = F.col("conv_id") + F.col("turn")
    q = F.concat(F.element_at(F.array(*[F.lit(x) for x in ASKED]), (n % len(ASKED) + 1).cast("int")), F.when(n % 3 == 0, F.concat(F.lit(" "), "text")).otherwise(F.lit("")))
    return load(spark, sf, "conversations").select("conv_id", "turn", C.route_question(q).alias("route"))


_more = _process.replace("|fetch(?:ing)?)", "|fetch(?:ing)?|scrape|scraping|ingest(?:ing)?)")
_client = " or ".join((
    _says(r"^(status|progress|update|hello|hi|hey|thanks|thank you)[\s?!.,]*$"), _says(r"\b(will|are|do|can|could|would|shall)\s+you\b") + " and " + _more,
    _more + " and " + _says(r"\b(more|additional|new|other|further)\b") + " and " + _says(r"\b(pdfs?|documents?|files?|bills?|summaries|data)\b"), _says(r"\b(more|additional)\s+(pdfs?|documents?|files?)\b"),
    _says(r"\bhow many\b") + " and " + _says(r"\b(pdfs?|summaries|documents?)\b"), _says(r"\b(are you|do you)\b") + " and " + _more, _says(r"\bhave you (read|finished|done|indexed|extracted)\b"), _inventory,
    _says(r"\bgive me (a |the )?list\b"), _says(r"\bwhich pdfs?\b"), _says(r"\bwhat (pdfs?|documents?) (do you|have you)\b"), _says(r"\b(still )?(working|running|crawling|indexing|extracting)\b"),
    _says(r"\b(how much|progress|update me|status|coverage)\b"), _says(r"\b(who are you|what (can|do) you do|what is eva)\b"), _says(r"\b(thank(s| you)|help me)\b"), _says(r"\bknowledge base\b"),
    _says(r"\b(keep|continue)\s+(reading|extracting|indexing|processing)\b"),
))
CLIENT_ASKED = (*ASKED, "thank you so much", "which pdfs have you", "what documents do you have", "shall you ingest it", "scraping other bills", "Hey there status", "help me please")
_client_asked = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in CLIENT_ASKED) + "]"


@register("c21_route_question_client", f"""select conv_id, turn, case when q = '' or not ({_client}) then 'content' when regexp_matches(low, '^(hi|hello|hey)\\b|who are you|what (can|do) you do|what is eva') then 'identity' when contains(low, 'thank') then 'thanks' when regexp_matches(low, '\\b(list|show|display|name|which|what)\\b') and regexp_matches(low, '\\b(pdfs?|summaries|documents?|files?|index|indexed|read|you have|you''ve)\\b') then 'list' else 'status' end as route
  from (select conv_id, turn, low, replace(trim(low), '’', chr(39)) as q from (select conv_id, turn, lower({_client_asked}[(conv_id + turn) % {len(CLIENT_ASKED)} + 1] || case when (conv_id + turn) % 3 = 0 then ' ' || text else '' end) as low from conversations))""")
def _(spark, sf):
    n = F.col("conv_id") + F.col("turn")
    q = F.concat(F.element_at(F.array(*[F.lit(x) for x in CLIENT_ASKED]), (n % len(CLIENT_ASKED) + 1).cast("int")), F.when(n % 3 == 0, F.concat(F.lit(" "), "text")).otherwise(F.lit("")))
    return load(spark, sf, "conversations").select("conv_id", "turn", C.route_question(q, "client").alias("route"))


def _has(fields: str, text: str) -> str:
    """SQL: whether the filled ones of these fields, joined by blanks, contain a text."""
    return f"contains(lower(concat_ws(' ', {', '.join(f'nullif(cast({c} as varchar), {chr(39) * 2})' for c in fields.split())})), '{text}')"


_pdf_fields = "title filename jurisdiction source_kind law_type year language host open_url url replace(filename_tags,',',chr(32))"


@register("c22_filter_pdfs", f"with e as ({ENRICHED}) select k, 'facets' as part from e where jurisdiction = 'UK' and source_kind = 'official_gazette' and {_has(_pdf_fields, 'law')} union all select k, 'type' from e where law_type = 'Bill' and year >= 0 and {_has(_pdf_fields, '20')} union all select k, 'year' from e where year = 2019 union all select k, 'across' from e where {_has(_pdf_fields, 'pdf uk off')}", "downloads")
def _(spark, sf):
    rows = saved(K.enrich(load(spark, sf, "downloads")))
    found = {"facets": K.filter_pdfs(rows, "UK", kind="official_gazette", text=" Law "), "type": K.filter_pdfs(rows, law_type="Bill", text="20").where("year >= 0"), "year": K.filter_pdfs(rows, year=2019), "across": K.filter_pdfs(rows, text="PDF UK off")}
    return reduce(DataFrame.unionByName, [r.select("k", F.lit(p).alias("part")) for p, r in found.items()])


_law_fields = "name summary country level level_detail law_area topic authority link authority_url region source"


SEARCHED = ["law", "UK off", "PDF", "x", "2019", "Gazette_2", "no such text anywhere", " https://WWW.", ""]


# the same fields by the index of short strings; a blank question finds nothing
@register("c22_indexed_search", f"with e as ({ENRICHED}) " + " union all ".join(f"select k, {i} as qid from e where {_has(_pdf_fields, t.strip().lower())}" for i, t in enumerate(SEARCHED) if t), "downloads")
def _(spark, sf):
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    write_index(K.enrich(load(spark, sf, "downloads")), "k", K.PDF_FIELDS, path, buckets=16)
    return search(spark, path, spark.createDataFrame(list(enumerate(SEARCHED)), "qid int, text string")).select(F.col("id").alias("k"), "qid")


@register("c23_filter_laws", f"with {TRACKING_LAWS} select k, 'state' as part from tlaws where level = 'State' and list_contains(list_transform(string_split(lower(law_area), ','), lambda x: trim(x)), 'tax') and {_has(_law_fields, 'a')} union all select k, 'country' from tlaws where country = 'Canada' and source = 'tracking' and {_has(_law_fields, 'example.org/u/1')}", "tracking", "registry")
def _(spark, sf):
    laws = K.law_rows_from_tracking(load(spark, sf, "tracking"), load(spark, sf, "registry"))
    found = {"state": K.filter_laws(laws, level="State", area="TAX", text="a"), "country": K.filter_laws(laws, "Canada", kind="tracking", text="Example.org/u/1")}
    return reduce(DataFrame.unionByName, [r.select("k", F.lit(p).alias("part")) for p, r in found.items()])


_summary_rows = "select id, title, url, case when id % 3 > 0 then summary else '' end as summary, case when id % 2 = 0 then [split_part(text, ' ', 2), split_part(text, ' ', 3)] else [] end as key_points from corpus"


@register("c24_filter_summaries", f"with s as ({_summary_rows}) select id, 'with' as part from s where summary <> '' and {_has('title summary url array_to_string(key_points,chr(32))', 'the')} union all select id, 'pending' from s where summary = '' and {_has('title url array_to_string(key_points,chr(32))', 'the')} union all select id, 'all' from s where {_has('title summary url array_to_string(key_points,chr(32))', 'd/1')}", "corpus")
def _(spark, sf):
    points = F.when(F.col("id") % 2 == 0, F.array(F.split_part("text", F.lit(" "), F.lit(2)), F.split_part("text", F.lit(" "), F.lit(3)))).otherwise(F.array().cast("array<string>"))
    rows = load(spark, sf, "corpus").select("id", "title", "url", F.when(F.col("id") % 3 > 0, F.col("summary")).otherwise("").alias("summary"), points.alias("key_points"))
    found = [K.filter_summaries(rows, m, t).select("id", F.lit(m).alias("part")) for m, t in (("with", "The"), ("pending", "The"), ("all", "d/1"))]
    return reduce(DataFrame.unionByName, found)


@register("c24_filter_doclist", f"select k from downloads where status = 'downloaded' and {_has('k url title filename jurisdiction source_kind', 'circular')}", "downloads")
def _(spark, sf):
    return K.filter_documents(load(spark, sf, "downloads").select("k", "url", "title", "filename", "jurisdiction", "source_kind", "status"), "downloaded", "circular").select("k")


@register("c24_filter_authorities", f"select k from registry where {_has('authority k url authority_type jurisdiction', 'self-reg')}", "registry")
def _(spark, sf):
    rows = load(spark, sf, "registry").select("k", F.col("authority").alias("name"), F.col("k").alias("code"), "url", "authority_type", F.col("jurisdiction").alias("country"), "topics")
    return K.filter_authorities(rows, "Self-reg").select("k")


@register("c24_filter_any_column", "select k from registry where contains(lower(concat_ws(' ', authority, url, jurisdiction, status)), 'beta')", "registry")
def _(spark, sf):
    return K.filter_rows(load(spark, sf, "registry"), {}, "BETA", ["authority", "url", "jurisdiction", "status"]).select("k")


@register("c25_prefer_subset", "select k from registry where contains(jurisdiction, 'Quebec') or not exists (select 1 from registry where contains(jurisdiction, 'Quebec'))", "registry")
def _(spark, sf):
    return K.prefer_subset(load(spark, sf, "registry"), F.col("jurisdiction").contains("Quebec")).select("k")


@register("c26_todo_summaries", "select id, k, case when contains(lower(jurisdiction), 'saudi') then 0 else 1 end + case when k % 4 = 0 and k % 8 <> 0 then 0 else 2 end as rank from (select *, sha256 || k as id from downloads) where k % 3 <> 0 and (contains(lower(jurisdiction), 'saudi') or contains(lower(jurisdiction), 'uk')) order by rank, id limit 25", "downloads")
def _(spark, sf):
    """Every fourth download says that it lies in a local file; half of these files are there."""
    catalog = load(spark, sf, "downloads").withColumn("id", F.concat("sha256", F.col("k").cast("string"))).withColumn("local_path", F.when(F.col("k") % 4 == 0, F.concat(F.lit("files/"), F.col("k").cast("string"))))
    files = catalog.where("k % 8 <> 0").select(F.concat(F.lit("files/"), F.col("k").cast("string")).alias("path"))
    return K.todo_summaries(catalog, catalog.where("k % 3 = 0"), ["saudi", "uk"], 25, files).select("id", "k", "rank")


@register("c27_normalize_law_row", "select k, coalesce(nullif(trim(title), ''), 'Untitled') as name, coalesce(nullif(trim(country), ''), '') as country, 'Federal' as level, '' as level_detail, coalesce(nullif(trim(law_area), ''), '') as law_area, coalesce(nullif(trim(link), ''), '') as link, 'source' as source from updates", "updates")
def _(spark, sf):
    return K.normalize_law_row(load(spark, sf, "updates"))


@register("c28_run_mode", "select k, (k % 2 = 0 or kind = 'ministry') and kind not in ('site', 'full', 'custom', 'all_pdfs') as regulatory_only from (select k, case when k % 10 = 3 then 'ministry' else source_kind end as kind from downloads)", "downloads")
def _(spark, sf):
    d = load(spark, sf, "downloads").select("k", F.when(F.col("k") % 10 == 3, "ministry").otherwise(F.col("source_kind")).alias("kind"))
    return d.select("k", C.filters_regulatory(F.col("kind"), F.col("k") % 2 == 0).alias("regulatory_only"))


# every tenth key is updated twice; the second update has no title
@register("s13_upsert", """with u as (select k, 1 as seq, case when k % 3 = 0 then 'done' end as status, 'New ' || k as title from downloads where k % 5 = 0 union all select k, 2, case when k % 20 = 0 then 'again' end, null from downloads where k % 10 = 0),
  l as (select k, arg_max(status, seq) filter (status is not null) as status, arg_max(title, seq) filter (title is not null) as title from u group by k)
  select coalesce(t.k, l.k) as k, coalesce(l.status, t.status) as status, coalesce(l.title, t.title) as title from (select k, status, title from downloads where k % 2 = 0) t full join l on t.k = l.k""", "downloads")
def _(spark, sf):
    d = load(spark, sf, "downloads")
    new = d.where("k % 5 = 0").select("k", F.lit(1).alias("seq"), F.expr("case when k % 3 = 0 then 'done' end").alias("status"), F.concat(F.lit("New "), F.col("k").cast("string")).alias("title"))
    more = d.where("k % 10 = 0").select("k", F.lit(2).alias("seq"), F.expr("case when k % 20 = 0 then 'again' end").alias("status"), F.lit(None).cast("string").alias("title"))
    return K.upsert(d.where("k % 2 = 0").select("k", "status", "title"), new.unionByName(more), "k", "seq")

_hint = "split_part('Bank of ~the Tax Agency FRANCE desk~Ministry GERMANY~xyz office~ab~data office', '~', cast(k % 6 as int) + 1)"


@register(
    "j2_match_authority_by_name",
    f"with {place_cte('registry', 'jurisdiction', chr(39) * 2, 'rp')}, h as (select k, lower(trim({_hint})) as hl, lower(country) as cl from updates), n as (select k as rk, trim(authority) as name, trim(url) as url, jurisdiction, region, lower(country_) as jc from rp where trim(authority) <> '' and starts_with(trim(url), 'http')),"
    " m as (select h.k, n.*, row_number() over (partition by h.k order by rk) as r from h join n on (contains(hl, lower(name)) or contains(lower(name), hl)) and (cl = '' or jc = '' or jc = cl or contains(jc, cl)) where length(hl) >= 4) select k, name, url, jurisdiction, region from m where r = 1",
    "updates", "registry",
)
def _(spark, sf):
    return K.match_authority_by_name(load(spark, sf, "updates").selectExpr("k", f"{_hint} as hint", "country"), load(spark, sf, "registry"))


def _said(*columns: str) -> str:
    return "concat_ws(' · ', " + ", ".join(f"nullif({c}, '')" for c in columns) + ")"


_topics4 = "array_to_string(list_filter(string_split(topics, ','), lambda x: x <> '')[1:4], ', ')"
_bare = "trim(regexp_replace({}, '(?i)\\s*[-–—]\\s*federal$', ''))"


@register(
    "c16_legacy_laws",
    f"""with r as (select 0 as rank, k, coalesce(nullif(title, ''), 'Update') as name, {_said('topical_relevance', 'law_area')} as summary, {_bare.format('country')} as country, 'Federal' as level, 'Federal' as level_detail, law_area, link, authority, 'collector' as source from updates
    union all select 1, k, coalesce(nullif(remarks, ''), nullif(topical_relevance, ''), 'Tracked'), {_said('remarks', 'topical_relevance', 'law_area')}, country, case when lower(coalesce(nullif(federal_or_state, ''), 'Federal')) = 'federal' then 'Federal' else 'State' end, coalesce(nullif(federal_or_state, ''), 'Federal'), law_area, link, '', 'tracking' from tracking
    union all select 2, k, authority, {_said('segment', _topics4)}, {_bare.format('jurisdiction')}, case when regexp_matches(jurisdiction, '(?i)federal') then 'Federal' else 'State' end, jurisdiction, segment, url, authority, 'source' from registry where authority <> '' and url <> '')
    select * exclude (rank, n) from (select *, row_number() over (partition by lower(case when link <> '' then link else name end) order by rank, k) as n from r) where n = 1""",
    "updates", "tracking", "registry",
)
def _(spark, sf):
    return K.legacy_laws(load(spark, sf, "updates"), load(spark, sf, "tracking"), load(spark, sf, "registry"))


@register(
    "w9_laws_sort",
    f"with {TRACKING_LAWS} select k, row_number() over (order by case when date = '' then 1 else 0 end, date desc, country, name, k) as place from tlaws order by place limit 300",
    "tracking", "registry",
)
def _(spark, sf):
    from ..operators.rank import keep_top

    laws = K.law_rows_from_tracking(load(spark, sf, "tracking"), load(spark, sf, "registry"))
    return keep_top(laws, [], 300, *K.laws_order(), name="place").select("k", "place")


@register("w9_catalog_sort", "select k, row_number() over (order by coalesce(downloaded_at, '') desc, coalesce(jurisdiction, '') desc, coalesce(title, '') desc, k) as place from downloads", "downloads")
def _(spark, sf):
    rows = load(spark, sf, "downloads").select("k", "downloaded_at", "jurisdiction", "title")
    return numbered(rows, "place", *K.catalog_order()).select("k", "place")


_told = "case when doc_id % 4 = 0 then '' when doc_id % 4 = 1 then repeat('نظام ', length(text)) else text end"


@register("w9_summary_sort", f"select id, row_number() over (order by case when summary = '' then 1 else 0 end, case when summary = '' or contains(summary, 'نظام') then 1 else 0 end, title, id) as place from (select doc_id as id, left(text, 12) as title, {_told} as summary from documents) order by place limit 300")
def _(spark, sf):
    from ..operators.rank import keep_top

    rows = load(spark, sf, "documents").selectExpr("doc_id as id", "left(text, 12) as title", f"{_told} as summary")
    return keep_top(K.ranked_summaries(rows), [], 300, *K.summaries_order(), name="place").select("id", "place")
