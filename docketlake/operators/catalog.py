"""Catalog operators: splits, prunes, enrichment, law rows, filters and normalised browse rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import urls as U
from .storage import saved


def split_regulatory(docs: DataFrame, min_score: int = 15) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected), both with score; docs (url, title, ...). Both read one scored table, written once."""
    scored = saved(docs.withColumn("score", C.regulatory_score(F.col("url"), F.col("title"), F.lit(None), F.col("title"))))
    return scored.where(F.col("score") >= min_score), scored.where(F.col("score") < min_score)


def prune_junk(docs: DataFrame, tested: Column, min_score: int = 15) -> DataFrame:
    """Rows that are not ``tested``, and tested ones that score ``min_score``."""
    return docs.where(~tested | (C.regulatory_score(F.col("url"), F.col("title"), F.col("filename"), F.lit(None)) >= min_score))


def enrich(downloads: DataFrame) -> DataFrame:
    """Catalog rows for downloads, with every inferred column."""
    name = F.when(C.text_or_blank(F.col("filename")) != "", F.col("filename")).when(F.col("title") != "", F.col("title")).otherwise(F.concat(F.lit("doc_"), F.col("k").cast("string"), F.lit(".pdf")))
    base = downloads.withColumn("filename", name)
    base = base.withColumn("title", F.when(F.col("title") != "", F.col("title")).otherwise(F.col("filename")))
    base = base.withColumn("years", C.years(F.col("title"), F.col("filename"), F.col("url"), F.col("downloaded_at")))
    return base.select(
        "k", F.coalesce("sha256", F.concat(F.lit("pdf_"), F.col("k").cast("string"))).alias("id"), "title", "filename", "jurisdiction", "source_kind",
        C.law_type(F.col("title"), F.col("filename"), F.col("url"), F.col("source_kind")).alias("law_type"), F.try_element_at("years", F.lit(1)).alias("year"), "years",
        C.language(F.col("jurisdiction"), F.col("title"), F.col("filename")).alias("language"), F.lit("downloaded").alias("status"), U.host_of(F.col("url")).alias("host"),
        C.filename_signals(F.col("filename")).alias("filename_tags"), "url", F.col("url").alias("open_url"), "bytes", "sha256", "downloaded_at",
    )


def due_sources(sources: DataFrame, even_day: bool, force: bool = False, regions: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Sources to poll: with a URL, active, less frequent ones on even days only; important jurisdictions first."""
    due = sources.where(C.text_or_blank(F.col("url")) != "")
    if not force:
        rare = F.lower(C.text_or_blank(F.col("frequency"))).contains("less")
        due = due.where((F.col("status").isNull() | (F.col("status") == "active")) & (~rare | F.lit(even_day)))
    if regions:
        due = due.where(F.lower("region").isin(*[r.lower() for r in regions]))
    due = due.withColumn("rank", C.priority_rank(F.col("jurisdiction")))
    return due.orderBy("rank", "k").limit(limit) if limit else due


#: What a search looks through.
PDF_FIELDS = ["title", "filename", "jurisdiction", "source_kind", "law_type", "year", "language", "host", "source_page", "open_url", "url", "filename_tags"]
LAW_FIELDS = ["name", "summary", "country", "level", "level_detail", "law_area", "topic", "authority", "link", "authority_url", "region", "source"]
SUMMARY_FIELDS = ["title", "summary", "url", "key_points"]
AUTHORITY_FIELDS = ["name", "code", "url", "authority_type", "country"]


def blob(rows: DataFrame, columns: list[str]) -> Column:
    """The filled ones of ``columns`` that ``rows`` has, arrays by their elements, joined by blanks, in lower case."""
    kinds = dict(rows.dtypes)
    text = lambda c: F.array_join(c, " ") if kinds[c].startswith("array") else F.col(c).cast("string")
    return F.lower(F.concat_ws(" ", *[F.nullif(text(c), F.lit("")) for c in columns if c in kinds]))


def filter_rows(rows: DataFrame, facets: dict[str, object], text: str = "", searched: list[str] | None = None) -> DataFrame:
    """Rows with these facet values and, in the searched columns, this text; blank facets and texts do not filter."""
    tests = [F.col(c) == v for c, v in facets.items() if v not in (None, "")]
    if text:
        tests.append(blob(rows, searched or rows.columns).contains(text.strip().lower()))
    return rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows


def in_area(area: str) -> Column:
    """Whether the comma list law_area has ``area``, without regard to case."""
    return F.array_contains(F.transform(F.split(F.lower("law_area"), ","), lambda x: F.trim(x)), area.lower())


def filter_pdfs(rows: DataFrame, jurisdiction: str = "", law_type: str = "", year: int | None = None, kind: str = "", text: str = "") -> DataFrame:
    """Catalog rows of these facets with ``text`` in any of ``PDF_FIELDS``."""
    return filter_rows(rows, {"jurisdiction": jurisdiction, "law_type": law_type, "year": year, "source_kind": kind}, text, PDF_FIELDS)


def filter_laws(rows: DataFrame, country: str = "", level: str = "", area: str = "", kind: str = "", text: str = "") -> DataFrame:
    """Laws of these facets with ``text`` in any of ``LAW_FIELDS``; the area is one of the row's list."""
    found = filter_rows(rows, {"country": country, "level": level, "source": kind}, text, LAW_FIELDS)
    return found.where(in_area(area)) if area else found


def filter_summaries(rows: DataFrame, mode: str = "with", text: str = "") -> DataFrame:
    """Rows ``with`` a summary, ``pending`` ones or ``all``, with ``text`` in any of ``SUMMARY_FIELDS``."""
    filled = C.text_or_blank(F.col("summary")) != ""
    rows = rows.where(filled) if mode == "with" else rows.where(~filled) if mode == "pending" else rows
    return filter_rows(rows, {}, text, SUMMARY_FIELDS)


def filter_documents(rows: DataFrame, status: str = "", text: str = "") -> DataFrame:
    """Listed documents of a status with ``text`` in any column."""
    return filter_rows(rows, {"status": status}, text)


def filter_authorities(rows: DataFrame, text: str = "") -> DataFrame:
    """Authorities with ``text`` in any of ``AUTHORITY_FIELDS``."""
    return filter_rows(rows, {}, text, AUTHORITY_FIELDS)


def prefer_subset(rows: DataFrame, wanted: Column) -> DataFrame:
    """The rows that satisfy ``wanted``, or all rows if none does."""
    some = rows.where(wanted)
    return rows if some.isEmpty() else some


def todo_summaries(catalog: DataFrame, done: DataFrame, jurisdictions: list[str] | None, limit: int | None = None, files: DataFrame | None = None) -> DataFrame:
    """Catalog rows with an id and a place to read them from that have no summary, of these jurisdictions.

    Those whose local_path is one of ``files`` (path) come first (rank 0 and 1), and among these and the others Saudi ones.
    """
    places = [c for c in ("local_path", "open_url", "url") if c in catalog.columns]
    somewhere = reduce(lambda a, b: a | b, [C.text_or_blank(F.col(c)) != "" for c in places])
    todo = catalog.where((C.text_or_blank(F.col("id")) != "") & somewhere).join(done.select("id"), "id", "left_anti")
    if jurisdictions:
        todo = todo.where(reduce(lambda a, b: a | b, [F.lower("jurisdiction").contains(j.lower()) for j in jurisdictions]))
    rank = F.when(F.lower(C.text_or_blank(F.col("jurisdiction"))).contains("saudi"), 0).otherwise(1)
    if files is not None:
        here = files.select(F.col("path").alias("local_path")).distinct().withColumn("_here", F.lit(True))
        todo = todo.join(here, "local_path", "left").withColumn("rank", F.when(F.col("_here"), rank).otherwise(rank + 2)).drop("_here")
    else:
        todo = todo.withColumn("rank", rank)
    return todo.orderBy("rank", "id").limit(limit) if limit else todo


def match_authority(links: DataFrame, registry: DataFrame) -> DataFrame:
    """(k, name, url, region, jurisdiction) of the registry row that a link's host belongs to; links (k, link).

    The first registry row of each host counts. An exact host wins, then the longest parent host, then the first registry
    host below the link's host. Both sides are exploded into host suffixes, so all of it is equi-joins.
    """
    usable = registry.where((F.trim("authority") != "") & F.col("url").startswith("http")).withColumn("host", U.host_of(F.col("url"))).where("host <> ''")
    first = usable.groupBy("host").agg(F.min_by(F.struct("k", F.trim("authority").alias("name"), F.trim("url").alias("url"), "jurisdiction", "region"), "k").alias("a"))
    hosts = links.select("k", U.host_of(F.col("link")).alias("host")).where("host <> ''")
    distinct = hosts.select("host").distinct()
    up = distinct.select("host", F.posexplode(U.host_suffixes(F.col("host"), 1)).alias("rank", "suffix")).join(first.withColumnRenamed("host", "suffix"), "suffix").select("host", "rank", "a")
    below = first.select(F.explode(U.host_suffixes(F.col("host"), 1)).alias("suffix"), "host", "a").where("suffix <> host")
    down = distinct.join(below.select(F.col("suffix").alias("host"), "a"), "host").select("host", F.lit(1000).alias("rank"), "a")
    best = up.unionByName(down).groupBy("host").agg(F.min_by("a", F.struct("rank", F.col("a.k"))).alias("a"))
    return hosts.join(best, "host").select("k", "a.name", "a.url", "a.jurisdiction", "a.region")


def _with_place(rows: DataFrame, name: str, labels: DataFrame, country: str, unit: str | None = None) -> DataFrame:
    """``rows`` with the parsed place of their ``country`` (and ``unit``) as ``name``; each different label of ``labels`` is parsed once, into a written table."""
    part = lambda df: df[unit] if unit else F.lit("")
    parsed = labels.select(labels[country].alias("_label"), part(labels).alias("_unit")).distinct()
    place = C.parse_jurisdiction(F.col("_label"), F.col("_unit")) if unit else C.parse_jurisdiction(F.col("_label"))
    known = saved(parsed.select("_label", "_unit", place.alias(name)))
    same = F.col(country).eqNullSafe(F.col("_label")) & (F.col(unit) if unit else F.lit("")).eqNullSafe(F.col("_unit"))
    return rows.join(known, same, "left").drop("_label", "_unit")


def law_rows_from_updates(updates: DataFrame, registry: DataFrame) -> DataFrame:
    """Laws-catalog rows for change candidates."""
    title = F.trim(C.text_or_blank(F.col("title")))
    named = updates.withColumn("name", F.when(C.clean_title(F.col("title")) != "", C.clean_title(F.col("title"))).when(title != "", title).otherwise(F.lit("Untitled update")))
    found = match_authority(updates.select("k", "link"), registry).select(F.col("k"), F.col("name").alias("_name"), F.col("url").alias("_url"), F.col("jurisdiction").alias("_jurisdiction"))
    rows = _with_place(named.join(found, "k", "left"), "_own", updates, "country")
    rows = _with_place(rows, "_matched", registry.withColumnRenamed("jurisdiction", "_jurisdiction"), "_jurisdiction")
    ask = (F.trim("source_url") == "") | (F.trim("authority") == "")
    authority = F.when(F.trim("authority") != "", F.trim("authority")).when(ask, C.text_or_blank(F.col("_name"))).otherwise(F.lit(""))
    use = (F.col("_own.country") == "") & ask & (C.text_or_blank(F.col("_jurisdiction")) != "")
    place = F.when(use, F.col("_matched")).otherwise(F.col("_own"))
    area = C.normalize_law_area(F.col("law_area"))
    rows = rows.select(
        "k", "id", "name", place.alias("place"), area.alias("law_area"), F.trim("topical_relevance").alias("topic"), F.trim("link").alias("link"), authority.alias("authority"),
        F.when(F.trim("source_url") != "", F.trim("source_url")).otherwise(C.text_or_blank(F.col("_url"))).alias("authority_url"), "region", F.col("discovered_at").alias("date"), F.lit("collector").alias("source"), F.trim("relevancy").alias("_relevancy"), "alert_status",
    )
    summary = C.build_summary(F.col("name"), F.col("topic"), F.col("law_area"), F.lit(""), F.lit(""), F.col("_relevancy"), F.col("authority"), F.col("place"), "collector")
    return _law_columns(rows.withColumn("summary", summary).withColumn("relevancy", F.when(F.col("_relevancy") == "", F.lit("Pending")).otherwise(F.col("_relevancy"))))


def law_rows_from_tracking(tracking: DataFrame, registry: DataFrame) -> DataFrame:
    """Laws-catalog rows for the analysts' log."""
    remarks, topic, link = (F.trim(C.text_or_blank(F.col(c))) for c in ("remarks", "topical_relevance", "link"))
    cleaned = C.clean_title(F.col("remarks"))
    named = tracking.withColumn("name", F.when(cleaned != "", cleaned).when(remarks != "", remarks).when(topic != "", topic).otherwise(F.lit("Tracked update")))
    found = match_authority(tracking.select("k", "link"), registry).select("k", F.col("name").alias("authority"), F.col("url").alias("authority_url"), "region")
    rows = _with_place(named.join(found, "k", "left"), "_place", tracking, "country", "federal_or_state").select(
        "k", U.stable_id(F.lit("trk"), link, F.col("name")).alias("id"), "name", F.col("_place").alias("place"), C.normalize_law_area(F.col("law_area")).alias("law_area"), topic.alias("topic"), link.alias("link"),
        C.text_or_blank(F.col("authority")).alias("authority"), C.text_or_blank(F.col("authority_url")).alias("authority_url"), C.text_or_blank(F.col("region")).alias("region"),
        F.when(C.text_or_blank(F.col("date_of_publication")) != "", F.col("date_of_publication")).otherwise(F.col("date_of_tracking")).alias("date"), F.lit("tracking").alias("source"), F.trim("relevancy").alias("relevancy"), "alert_status", remarks.alias("_remarks"), F.trim("comments").alias("_comments"),
    )
    summary = C.build_summary(F.col("name"), F.col("topic"), F.col("law_area"), F.when(F.col("_remarks") != F.col("name"), F.col("_remarks")).otherwise(F.lit("")), F.col("_comments"), F.col("relevancy"), F.col("authority"), F.col("place"), "tracking")
    return _law_columns(rows.withColumn("summary", summary))


def law_rows_from_sources(registry: DataFrame) -> DataFrame:
    """Laws-catalog rows for the authority registry."""
    name, url, status = F.trim("authority"), F.trim("url"), F.when(C.text_or_blank(F.col("status")) == "", F.lit("active")).otherwise(F.trim("status"))
    kind, nature = F.trim(C.text_or_blank(F.col("authority_type"))), F.trim(C.text_or_blank(F.col("link_nature")))
    topic = F.array_join(F.filter(F.split("topics", ","), lambda x: x != ""), ", ")
    rows = _with_place(registry.where((name != "") & url.startswith("http")), "_place", registry, "jurisdiction").select(
        "k", U.stable_id(F.lit("src"), url, name).alias("id"), name.alias("name"), F.col("_place").alias("place"), C.normalize_law_area(F.col("segment")).alias("law_area"), F.substring(topic, 1, 300).alias("topic"), url.alias("link"),
        name.alias("authority"), url.alias("authority_url"), "region", F.lit("").alias("date"), F.lit("source").alias("source"), F.lit("").alias("relevancy"), status.alias("alert_status"),
        F.concat_ws(" · ", F.when(kind != "", F.concat(kind, F.lit(" authority"))), F.when(nature != "", nature)).alias("_remarks"),
    )
    comments = F.when(F.col("alert_status") == "active", F.lit("")).otherwise(F.concat(F.lit("Source status: "), F.col("alert_status")))
    summary = C.build_summary(F.col("name"), F.col("topic"), F.col("law_area"), F.col("_remarks"), comments, F.col("relevancy"), F.col("authority"), F.col("place"), "source")
    return _law_columns(rows.withColumn("summary", summary))


LAW_COLUMNS = ("k", "id", "name", "summary", "country", "level", "level_detail", "law_area", "topic", "link", "authority", "authority_url", "region", "date", "source", "relevancy", "alert_status")


def _law_columns(rows: DataFrame) -> DataFrame:
    return rows.select("*", "place.*").select(*LAW_COLUMNS)


def union_by_precedence(tables: list[DataFrame], key: Column, order: str = "k") -> DataFrame:
    """All rows of the tables, but of one ``key`` only the first row of the first table that has it."""
    ranked = reduce(lambda a, b: a.unionByName(b), [t.withColumn("_rank", F.lit(i)) for i, t in enumerate(tables)])
    row = F.struct(*[F.col(f"`{c}`") for c in tables[0].columns])
    first = ranked.groupBy(key.alias("_key")).agg(F.min_by(row, F.struct("_rank", order)).alias("_first"))
    return first.select(*[F.col(f"_first.`{c}`").alias(c) for c in tables[0].columns])


def laws_catalog(updates: DataFrame, tracking: DataFrame, registry: DataFrame) -> DataFrame:
    tables = [law_rows_from_updates(updates, registry), law_rows_from_tracking(tracking, registry), law_rows_from_sources(registry)]
    return union_by_precedence(tables, F.lower(F.when(F.col("link") != "", F.col("link")).otherwise(F.col("name"))))


def upsert(target: DataFrame, updates: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``target`` with ``updates`` merged in by ``key``: new non-null fields overwrite, others stay; new keys are added.

    Several updates of a key are merged in turn by ``order``, a column that is no field: each field takes its last value
    that is not null, as if they had come one by one, so merging them again changes nothing. Without ``order`` the greatest
    value of a field counts.
    """
    fields = [c for c in updates.columns if c not in (key, order)]
    turn = F.col(order) if order else F.lit(0)
    last = updates.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(turn, F.col(c).cast("string")))).alias(c) for c in fields])
    t, u = target.alias("t"), last.alias("u")
    names = [c for c in target.columns if c != key]
    merged = [F.coalesce(F.col(f"u.{c}"), F.col(f"t.{c}")).alias(c) if c in fields else F.col(f"t.{c}") for c in names]
    added = [F.col(f"u.{c}") for c in fields if c not in target.columns]
    return t.join(u, F.col(f"t.{key}") == F.col(f"u.{key}"), "full").select(F.coalesce(F.col(f"t.{key}"), F.col(f"u.{key}")).alias(key), *merged, *added)


def normalize_law_row(rows: DataFrame) -> DataFrame:
    """Browse rows: alias columns made one, with defaults."""
    have = set(rows.columns)
    pick = lambda default, *names: F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in have], F.lit(default))
    return rows.select(
        "k", pick("Untitled", "name", "title").alias("name"), pick("", "country").alias("country"), pick("Federal", "level").alias("level"), pick("", "level_detail", "levelDetail").alias("level_detail"),
        pick("", "law_area", "lawArea").alias("law_area"), pick("", "link", "url").alias("link"), pick("source", "source").alias("source"),
    )


def match_authority_by_name(hints: DataFrame, registry: DataFrame) -> DataFrame:
    """(k, name, url, jurisdiction, region) of the first registry row whose name contains a hint, or lies in it.

    hints (k, hint, country); hints of under four characters match nothing, and a row's country must be blank, equal or
    contain the hint's, if that has one. A text that lies in another has its first four characters there, so equal
    four-character pieces (shorter ones for shorter names) find the candidates, and no pair is tried without one. Each
    different (hint, country) is answered once, from the first row of each different (name, country), so neither hints nor
    names that repeat multiply the pairs.
    """
    pieces = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(F.col(c), i, F.lit(n)))
    names = registry.where((F.trim("authority") != "") & F.trim("url").startswith("http")).select(
        F.col("k").alias("rk"), F.trim("authority").alias("name"), F.lower(F.trim("authority")).alias("nl"), F.trim("url").alias("url"), "jurisdiction", "region", F.lower(C.parse_jurisdiction(F.col("jurisdiction"))["country"]).alias("jc"),
    )
    asked = hints.select("k", F.lower(F.trim(C.text_or_blank(F.col("hint")))).alias("hl"), F.lower(C.text_or_blank(F.col("country"))).alias("cl")).where(F.length("hl") >= 4)
    distinct = asked.select("hl").distinct()
    in_hint = distinct.select("hl", F.explode(F.array_distinct(F.flatten(F.array(*[pieces("hl", n) for n in (1, 2, 3, 4)])))).alias("piece")).join(names.select("nl", F.substring("nl", 1, 4).alias("piece")).distinct(), "piece")
    in_name = names.select("nl").distinct().select("nl", F.explode(F.array_distinct(pieces("nl", 4))).alias("piece")).join(distinct.withColumn("piece", F.substring("hl", 1, 4)), "piece")
    pairs = in_hint.select("hl", "nl").unionByName(in_name.select("hl", "nl")).where(F.contains("hl", "nl") | F.contains("nl", "hl")).distinct()
    row = F.struct("name", "url", "jurisdiction", "region")
    first = names.groupBy("nl", "jc").agg(F.min("rk").alias("rk"), F.min_by(row, "rk").alias("a"))
    found = asked.select("hl", "cl").distinct().join(pairs, "hl").join(first, "nl").where("cl = '' or jc = '' or jc = cl or contains(jc, cl)")
    best = found.groupBy("hl", "cl").agg(F.min_by("a", "rk").alias("a"))
    return asked.join(best, ["hl", "cl"]).select("k", "a.*")


def legacy_laws(updates: DataFrame, tracking: DataFrame, registry: DataFrame) -> DataFrame:
    """The client's own merge of the three tables: plain summaries, no matching; the earlier table wins a link."""
    blank = C.text_or_blank
    joined = lambda *cs: F.concat_ws(" · ", *[F.when(blank(c) != "", c) for c in cs])
    country = lambda c: F.trim(F.regexp_replace(blank(c), r"(?i)\s*[-–—]\s*federal$", ""))
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    u, t, s = F.col, F.col, F.col
    none = F.lit("")
    unit = first(t("federal_or_state"), F.lit("Federal"))
    topics = F.filter(F.split("topics", ","), lambda x: x != "")
    shown = F.array_join(F.slice(topics, 1, 4), ", ")

    def rows(table: DataFrame, source: str, **made: Column) -> DataFrame:
        return table.select("k", *[c.alias(n) for n, c in made.items()], F.lit(source).alias("source"))

    tables = [
        rows(updates, "collector", name=first(u("title"), F.lit("Update")), summary=joined(u("topical_relevance"), u("law_area")), country=country(u("country")), level=F.lit("Federal"), level_detail=F.lit("Federal"), law_area=blank(u("law_area")), link=blank(u("link")), authority=blank(u("authority"))),
        rows(tracking, "tracking", name=first(t("remarks"), t("topical_relevance"), F.lit("Tracked")), summary=joined(t("remarks"), t("topical_relevance"), t("law_area")), country=blank(t("country")), level=F.when(F.lower(unit) == "federal", "Federal").otherwise("State"), level_detail=unit, law_area=blank(t("law_area")), link=blank(t("link")), authority=none),
        rows(registry.where("authority <> '' and url <> ''"), "source", name=s("authority"), summary=joined(s("segment"), shown), country=country(s("jurisdiction")), level=F.when(s("jurisdiction").rlike("(?i)federal"), "Federal").otherwise("State"), level_detail=blank(s("jurisdiction")), law_area=blank(s("segment")), link=s("url"), authority=s("authority")),
    ]
    return union_by_precedence(tables, F.lower(F.when(F.col("link") != "", F.col("link")).otherwise(F.col("name"))))


def laws_order(newest_first: bool = True) -> list[Column]:
    """Sort keys of the laws catalog: collector, tracking, sources; dated rows first, by date, then country and name."""
    rank = F.when(F.col("source") == "collector", 0).when(F.col("source") == "tracking", 1).otherwise(2)
    date = C.text_or_blank(F.col("date"))
    return [rank, F.when(date == "", 1).otherwise(0), F.desc(date) if newest_first else F.asc(date), F.asc(C.text_or_blank(F.col("country"))), F.asc(C.text_or_blank(F.col("name"))), F.asc("k")]


def catalog_order() -> list[Column]:
    """Sort keys of the published catalog: newest download first, then place and title, both from the end of the alphabet."""
    return [F.desc(C.text_or_blank(F.col(c))) for c in ("downloaded_at", "jurisdiction", "title")] + [F.asc("k")]


def ranked_summaries(rows: DataFrame) -> DataFrame:
    """``rows`` with rank: 0 for an English summary (see ``script_language``), 1 for one in another script, 2 for none."""
    summary = C.text_or_blank(F.col("summary"))
    return rows.withColumn("rank", F.when(summary == "", 2).when(C.script_language(summary) == "en", 0).otherwise(1))


def summaries_order() -> list[Column]:
    """Sort keys of ``ranked_summaries``: by rank, then title. The rank is a column, as a sort works its keys out at each comparison."""
    return [F.asc("rank"), F.asc(C.text_or_blank(F.col("title"))), F.asc("id")]
