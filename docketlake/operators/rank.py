"""Windows, ordering, aggregates and sets over catalog tables."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .scan import empty_streaks, previous
from .storage import numbered, saved


def dedupe_first(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``, ascending: an aggregate, so a key that a third of the rows share is reduced where they are read."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*order)).alias("_first"))
    return first.select(*[F.col(f"_first.`{c}`").alias(c) for c in rows.columns])


def keep_top(rows: DataFrame, groups: list[str], n: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group by ``order``, with their rank; without groups, of the whole table.

    Spark limits each partition to ``n`` rows a group before it shuffles, so a group's size does not matter.
    """
    if not groups:
        rows = rows.orderBy(*order).limit(n)
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(name) <= n)


def relative_cutoff(scored: DataFrame, group: str, k: int, share: float = 0.35, from_best: int = 6, least: float = 1.0, *order: Column) -> DataFrame:
    """Of each group the first ``k`` rows whose score reaches ``share`` of the best, once the best is ``from_best``; never less than ``least``.

    The cut is taken among the first ``k``: it is a bound on the score, so both orders give the same rows.
    """
    top = keep_top(scored, [group], k, F.desc("score"), *order)
    best = F.max("score").over(Window.partitionBy(group))
    floor = F.when(best >= from_best, F.greatest(F.lit(least), best * share)).otherwise(F.lit(least))
    return top.withColumn("_floor", floor).where(F.col("score") >= F.col("_floor")).drop("_floor")


def disambiguate(rows: DataFrame, name: str, folder: list[str], order: str, mark: Column, ending: str = ".pdf") -> DataFrame:
    """Names made unique in their folder: all but the first row of a name by ``order`` get ``_``, ``mark`` and ``ending`` for their extension."""
    first = rows.groupBy(*folder, name).agg(F.min(order).alias("_first"))
    own = first.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*folder, name])], "_first")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate([*folder, name])])
    joined = rows.join(own, same, "left").drop(*[f"_{i}" for i in range(len(folder) + 1)])
    renamed = F.concat(F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.lit("_"), mark, F.lit(ending))
    return joined.withColumn(name, F.when(F.col(order) > F.col("_first"), renamed).otherwise(F.col(name))).drop("_first")


def counts_by(rows: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, n), most frequent first; blank values count as Unknown."""
    value = F.when(F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == "", F.lit("Unknown")).otherwise(F.col(column).cast("string"))
    out = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def status_counts(rows: DataFrame, group: str, statuses: list[str]) -> DataFrame:
    """A row for each group with the count of each status, zeros included, and the total."""
    out = rows.groupBy(group).agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses], F.count("*").alias("total"))
    return out


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of every table."""
    return reduce(lambda a, b: a.unionByName(b), [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()])


def facet_values(rows: DataFrame, column: str, lists: bool = False) -> DataFrame:
    """Distinct non-blank values of a column, or of the parts of its comma lists."""
    values = rows.select(F.explode(F.split(column, ",")).alias("value") if lists else F.col(column).cast("string").alias("value"))
    return values.select(F.trim("value").alias("value")).where("value <> ''").distinct()


#: The kinds of source that a registry row can ask for, by column.
EXPECTED_KINDS = ("parliamentary_bills", "official_gazette")


def coverage(gazette: DataFrame, catalog: DataFrame, few: int = 3) -> DataFrame:
    """For each row of ``gazette`` (jurisdiction, parliamentary_bills, official_gazette): what the catalog has of it.

    documents, kinds present, expected (those whose cell is filled) and missing, years (latest first), law types, and the
    state: zero, partial (under ``few`` documents or a kind missing) or ok. Blank jurisdictions are Unknown on both sides.
    """
    known = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("Unknown"))
    some = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(c))
    have = catalog.groupBy(known("jurisdiction").alias("_j")).agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set(some("source_kind"))).alias("kinds"), F.sort_array(F.collect_set("year"), asc=False).alias("years"), F.sort_array(F.collect_set(some("law_type"))).alias("law_types"),
    )
    expected = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(k), F.lit(""))) != "", F.lit(k)) for k in EXPECTED_KINDS]))
    out = gazette.select(known("jurisdiction").alias("jurisdiction"), expected.alias("expected")).join(have, F.col("jurisdiction") == F.col("_j"), "left").drop("_j")
    none = F.array().cast("array<string>")
    out = out.withColumns({"n": F.coalesce("n", F.lit(0)), "kinds": F.coalesce("kinds", none), "law_types": F.coalesce("law_types", none), "years": F.coalesce("years", F.array().cast("array<int>"))})
    out = out.withColumn("missing", F.array_except("expected", "kinds"))
    return out.withColumn("state", F.when(F.col("n") == 0, "zero").when((F.col("n") < few) | (F.size("missing") > 0), "partial").otherwise("ok"))


def laws_profile(laws: DataFrame, countries: int = 15) -> DataFrame:
    """(metric, value, n) of a laws catalog: rows, those with an authority and with a summary of over 20 characters, rows of
    each level, and of the ``countries`` most frequent countries (blank: ?)."""
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("?"))
    total = laws.agg(F.count("*").alias("laws"), F.count_if(F.coalesce("authority", F.lit("")) != "").alias("with_authority"), F.count_if(F.length("summary") > 20).alias("with_summary"))
    rows = total.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.lit("").alias("value"), F.col(c).alias("n")) for c in ("laws", "with_authority", "with_summary")])).alias("r")).select("r.*")
    levels = laws.groupBy(named("level").alias("value")).agg(F.count("*").alias("n")).select(F.lit("level").alias("metric"), "value", "n")
    most = laws.groupBy(named("country").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(countries).select(F.lit("country").alias("metric"), "value", "n")
    return rows.unionByName(levels).unionByName(most)


def run_stats(runs: DataFrame) -> DataFrame:
    """One row: attempted, ok, failed, new_items of fetch runs."""
    ok = F.col("status") == "ok"
    return runs.agg(F.count("*").alias("attempted"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.sum("new_items").alias("new_items"))


def crawl_reports(visits: DataFrame, documents: DataFrame, streak: int = 8) -> DataFrame:
    """A report on each source of a run, and one on all of them (source null, part 'total').

    visits (source, seq, js, links, error): every fetch in order; documents (source, regulatory, downloaded): what was found. The error
    of a source is its first where no document was found, else possible_rate_limit after ``streak`` pages without links in a row.
    """
    pages = visits.groupBy("source").agg(F.count("*").alias("pages"), F.count_if("js").alias("js_pages"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("first"))
    found = documents.groupBy("source").agg(F.count("*").alias("candidates"), F.count_if("regulatory").alias("kept"), F.count_if(~F.col("regulatory")).alias("rejected"), F.count_if("downloaded").alias("downloaded"))
    empty = empty_streaks(visits.where("error is null"), "source", "seq", "links", streak).select("source").distinct().withColumn("empty", F.lit(True))
    counts = ["pages", "js_pages", "errors", "candidates", "kept", "rejected", "downloaded"]
    rows = pages.join(found, "source", "full").join(empty, "source", "left").fillna(0, counts)
    error = F.when(F.col("candidates") == 0, F.col("first"))
    rows = saved(rows.select("source", *counts, F.coalesce(error, F.when(F.col("empty"), F.lit("possible_rate_limit"))).alias("error")))
    total = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    named = lambda part, r: r.select(F.lit(part).alias("part"), "source", *counts, "error")
    return named("source", rows).unionByName(named("total", total.withColumns({c: F.lit(None).cast("string") for c in ("source", "error")})))


def merge_counts(merged: DataFrame) -> DataFrame:
    """(jurisdiction, n): rows that a merge (see ``merge_artifacts_into``) added or gave another label, by the label they have now."""
    return merged.where("change <> 'kept'").groupBy("jurisdiction").agg(F.count("*").alias("n"))


def source_reports(runs: DataFrame) -> DataFrame:
    """Pages, candidates, kept items, errors and HTTP errors of each source."""
    return runs.groupBy("source").agg(
        F.count("*").alias("pages"), F.sum("item_count").alias("candidates"), F.sum("new_items").alias("kept"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "http_error").alias("http_errors")
    )


def language_histogram(docs: DataFrame, least: int = 40) -> DataFrame:
    """Documents of each language, those with ``least`` characters of text, and all characters."""
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.length("text") >= least).alias("with_text"), F.sum(F.length("text")).alias("chars"))


def fewest_first(sources: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """(key, n, place): the sources in the order of how many documents each has, fewest first."""
    n = documents.groupBy(key).agg(F.count("*").alias("n"))
    counted = sources.select(key).distinct().join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return numbered(counted, "place", F.col("n"), F.col(key))


def blocked_hosts(runs: DataFrame, most: int = 50) -> DataFrame:
    """(source, hosts): the first ``most`` hosts by name at which each source was blocked."""
    from ..functions.urls import host_of

    blocked = runs.where("http_status in (403, 429) or http_status >= 500").select("source", host_of(F.col("url")).alias("host")).distinct()
    top = keep_top(blocked, ["source"], most, F.col("host"))
    return top.groupBy("source").agg(F.sort_array(F.collect_list("host")).alias("hosts"))


def distinct_sets(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """The distinct non-null values of each column in each group, sorted."""
    return rows.groupBy(group).agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns])


def cap_per_source(rows: DataFrame, source: str, n: int) -> DataFrame:
    """(source, kept, capped): how many rows of each source stay when it may have ``n`` (0: all), and how many do not."""
    count = F.count("*")
    kept = F.least(count, F.lit(n)) if n else count
    return rows.groupBy(source).agg(kept.cast("long").alias("kept"), (count - kept).cast("long").alias("capped"))


def number_citations(hits: DataFrame, group: str, label: str, n: int, *order: Column) -> DataFrame:
    """(group, citations): the first ``n`` hits of each group as '[1] label [2] label ...'."""
    top = keep_top(hits, [group], n, *order, name="_n")
    line = F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] "), F.col(label).cast("string"))
    return top.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", line.alias("t")))), lambda x: x["t"]), " ").alias("citations"))


def display_cap(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows by ``order``, each with the ``total`` of rows there are."""
    return rows.orderBy(*order).limit(n).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def first_per_host(rows: DataFrame, order: str = "k") -> DataFrame:
    """(host, first): the first row by ``order`` of each host, of rows with an http address and an authority."""
    from ..functions.urls import host_of

    hosts = rows.where(F.col("url").startswith("http") & (F.trim("authority") != "")).select(order, host_of(F.col("url")).alias("host")).where("host <> ''")
    return hosts.groupBy("host").agg(F.min(order).alias(order))


def kept_and_rejected(rows: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that pass ``test``, and all others (those for which it is null too)."""
    sure = F.coalesce(test, F.lit(False))
    return rows.where(sure), rows.where(~sure)


def token_sets(one: Column, two: Column) -> dict[str, Column]:
    """Columns that compare two sets of tokens: both, only_first, either."""
    return {"both": F.array_intersect(one, two), "only_first": F.array_except(one, two), "either": F.array_union(one, two)}


def site_of(hosts: DataFrame, companions: DataFrame) -> DataFrame:
    """``hosts`` (.., host) with site: the group that ``companions`` (host, site) puts the host in, else the host itself."""
    named = companions.select(F.col("host").alias("_h"), F.col("site").alias("_s"))
    return hosts.join(named, F.col("host") == F.col("_h"), "left").withColumn("site", F.coalesce("_s", "host")).drop("_h", "_s")


def latest_of(rows: DataFrame, key: str, stamp: str, *columns: str, tie: str = "k") -> DataFrame:
    """Of each key the newest ``stamp`` and the ``columns`` of that row; ties by the greatest ``tie``."""
    last = F.max_by(F.struct(*columns), F.struct(stamp, tie)).alias("_l")
    return rows.groupBy(key).agg(F.max(stamp).alias(stamp), last).select(key, stamp, *[F.col(f"_l.{c}").alias(c) for c in columns])


def new_items(items: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """Items whose keys are not among the seen ones."""
    return items.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def resume(candidates: DataFrame, done: DataFrame) -> DataFrame:
    """Candidates whose URL is not done and whose bytes are not either; a candidate without hash counts by URL."""
    left = candidates.join(done.select("url").distinct(), "url", "left_anti")
    return left.join(done.select("sha256").where("sha256 <> ''").distinct(), "sha256", "left_anti")


def merge_manifest(existing: DataFrame, new: DataFrame, order: str = "at") -> DataFrame:
    """Downloaded rows of both, one a URL: a known URL takes the new jurisdiction and kind, a new URL is added.

    Of several new rows of a URL the last by ``order`` counts, of several existing ones the first. Rows without URL go.
    """
    new = new.where(F.col("status").isin("downloaded", "scanned_pdf") & (F.coalesce("url", F.lit("")) != ""))
    last = new.groupBy("url").agg(F.max_by(F.struct("jurisdiction", "source_kind"), order).alias("n"))
    first = existing.where("url <> ''").groupBy("url").agg(F.min_by(F.struct("jurisdiction", "source_kind"), order).alias("e"))
    change = F.when(F.col("n").isNull(), "kept").when(F.col("e").isNull(), "added").otherwise("relabelled")
    pick = lambda c: F.when(F.col("n").isNull(), F.col(f"e.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return first.join(last, "url", "full").select("url", pick("jurisdiction"), pick("source_kind"), change.alias("change"))


def merge_artifacts_into(existing: DataFrame, new: DataFrame, prefix: str, order: str = "at") -> DataFrame:
    """Rows (url, jurisdiction, source_kind, change) of a manifest after an artifact's rows (.., dry_run) are merged in by ``order``.

    Dry runs and rows without URL are left out. A new URL is added with its first row. After that, a row whose jurisdiction
    starts with ``prefix`` and differs from what the URL then has gives it that jurisdiction, and its kind if it has one,
    else the URL keeps its own, else 'ministry': so the last such jurisdiction stands, with the last kind that came with a change.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    pair = F.struct("jurisdiction", "source_kind")
    new = new.where(~F.coalesce("dry_run", F.lit(False)) & (text("url") != ""))
    old = existing.where(text("url") != "").groupBy("url").agg(F.min_by(pair, order).alias("o"))
    start = old.join(new.groupBy("url").agg(F.min_by(pair, order).alias("f")), "url", "full")
    start = start.select("url", F.coalesce("o", "f").alias("s"), F.col("o").isNull().alias("added"))
    # what each URL starts with stands before its labelled rows, as null sorts first
    labelled = new.where(text("jurisdiction").startswith(prefix)).select("url", order, "jurisdiction", "source_kind")
    turns = labelled.unionByName(start.select("url", F.lit(None).cast(dict(new.dtypes)[order]).alias(order), "s.jurisdiction", F.lit(None).cast("string").alias("source_kind")))
    steps = previous(turns, "url", order, "jurisdiction").where(F.col(order).isNotNull() & (F.col("jurisdiction") != F.coalesce("_before.value", F.lit(""))))
    last = steps.groupBy("url").agg(F.max_by("jurisdiction", order).alias("j"), F.max_by("source_kind", F.when(text("source_kind") != "", F.col(order))).alias("k"))
    kind = F.coalesce("k", F.nullif("s.source_kind", F.lit("")), F.lit("ministry"))
    change = F.when(F.col("added"), "added").when(F.col("j").isNotNull(), "relabelled").otherwise("kept")
    return start.join(last, "url", "left").select(
        "url", F.coalesce("j", "s.jurisdiction").alias("jurisdiction"), F.when(F.col("j").isNull(), F.col("s.source_kind")).otherwise(kind).alias("source_kind"), change.alias("change"),
    )


def relabel_by_host(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """docs (k, host, jurisdiction) with the label of the owner (host, label) of their host or its longest parent."""
    from ..functions.urls import host_suffixes

    parents = docs.select("host").distinct().select("host", F.posexplode(host_suffixes(F.col("host"), 1)).alias("_p", "suffix"))
    best = parents.join(owners.select(F.col("host").alias("suffix"), "label"), "suffix").groupBy("host").agg(F.min_by("label", "_p").alias("label"))
    return docs.join(best, "host", "left").select("k", "host", F.coalesce("label", "jurisdiction").alias("jurisdiction"), F.coalesce(F.col("label") != F.col("jurisdiction"), F.lit(False)).alias("changed"))


def authority_documents(owners: DataFrame, docs: DataFrame, country: str, most: int = 12) -> DataFrame:
    """(code, n, first_ids): the documents (k, host, jurisdiction) of each owner (code, host): all are counted, the first listed.

    A document is an owner's if its label, in lower case, is the code, ends with `` - code`` or is ``country`` - code, alone or with
    a blank and more after it; or if its host is the owner's or below it. Labels meet codes as keys: each label gives the few
    codes that it may name. Owners without documents have n 0.
    """
    from ..functions.urls import host_suffixes

    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    label, lead = low("jurisdiction"), f"{country.lower()} - "
    rest = F.substring(label, len(lead) + 1, 1 << 30)
    # after the country every beginning that a blank ends, as a code may hold blanks; after any dash what follows it
    words, tails = F.split(rest, " "), F.split(label, " - ")
    leading = F.when(label.startswith(lead), F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, 1, i), " ")))
    ending = F.transform(F.sequence(F.lit(1), F.size(tails)), lambda i: F.array_join(F.slice(tails, i, F.size(tails)), " - "))
    named = F.array_distinct(F.concat(F.coalesce(leading, F.array().cast("array<string>")), ending))
    by_label = docs.groupBy("jurisdiction").agg(F.count("*")).select(F.col("jurisdiction").alias("_label"), F.explode(named).alias("_code"))
    keyed = owners.select("code", low("code").alias("_own"), "host").where("code is not null")
    labels = by_label.join(keyed, F.col("_code") == F.col("_own")).select("_label", "code").distinct()
    by_name = docs.join(labels, F.col("jurisdiction").eqNullSafe(F.col("_label"))).select("code", "k")
    suffixes = docs.select("k", F.explode(host_suffixes(F.col("host"), 1)).alias("suffix"))
    by_host = keyed.where("host <> ''").join(suffixes, F.col("host") == F.col("suffix")).select("code", "k")
    pairs = by_name.unionByName(by_host).distinct()
    counts = pairs.groupBy("code").agg(F.count("*").alias("n"))
    first = keep_top(pairs, ["code"], most, F.col("k")).groupBy("code").agg(F.array_join(F.sort_array(F.collect_list("k")), ",").alias("first_ids"))
    found = owners.select("code").distinct().join(counts, "code", "left").join(first, "code", "left")
    return found.select("code", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("first_ids", F.lit("")).alias("first_ids"))


def catalog_with_summaries(catalog: DataFrame, summaries: DataFrame) -> DataFrame:
    """Every catalog row with its summary, found by URL and else by id; summaries of neither are added."""
    s = dedupe_first(summaries, ["url_key"], F.col("id"))
    by_url = s.select("url_key", F.col("id").alias("_by_url"), F.col("summary").alias("_s1"))
    by_id = dedupe_first(summaries, ["id"], F.col("url_key")).select("id", F.col("id").alias("_by_id"), F.col("summary").alias("_s2"))
    joined = catalog.join(by_url, "url_key", "left").join(by_id, "id", "left")
    rows = joined.select("id", "url_key", F.coalesce("_s1", "_s2").alias("summary"), F.lit(True).alias("in_catalog"))
    rest = summaries.join(catalog.select("url_key").distinct(), "url_key", "left_anti").join(catalog.select("id").distinct(), "id", "left_anti")
    return rows.unionByName(rest.select("id", "url_key", "summary", F.lit(False).alias("in_catalog")))


def topic_terms(docs: DataFrame, n: int = 6) -> DataFrame:
    """(id, topics): the ``n`` most frequent words of five Latin letters or more, without stop words; ties by first place.

    A document's words are counted in the task that reads it; those of ids with several rows meet by id.
    """
    several = saved(docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("_id")))
    low, same = docs.select("id", F.lower("text").alias("text")), F.col("id").eqNullSafe(F.col("_id"))
    kinds = StructType([docs.schema["id"], StructField("topics", StringType())])
    alone = low.join(several, same, "left_anti").select("id", F.col("text").cast("binary").alias("text"))
    found = alone.mapInArrow(_topic_counter(n), kinds).where("topics is not null")
    return found.unionByName(_shared_topics(low.join(several, same, "left_semi"), n))


def _topic_counter(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    words, stop = re.compile(rb"[a-z]{5,}"), [w.encode() for w in TOPIC_STOP]

    def topics(text: bytes | None) -> str | None:
        counts = Counter(words.findall(text or b""))
        for word in stop:
            counts.pop(word, None)
        return b",".join([word for word, _ in counts.most_common(n)]).decode() or None  # ties stay in order of first place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = pa.array([topics(text.as_py()) for text in part.column("text")], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), found], ["id", "topics"])

    return run


def _shared_topics(low: DataFrame, n: int) -> DataFrame:
    """``topic_terms`` of lower-case texts, several of which may share an id."""
    words = low.select("id", F.posexplode(F.regexp_extract_all("text", F.lit("[a-z]{5,}"), 0)).alias("pos", "word")).where(~F.col("word").isin(*TOPIC_STOP))
    counted = words.groupBy("id", "word").agg(F.count("*").alias("c"), F.min("pos").alias("p"))
    top = keep_top(counted, ["id"], n, F.desc("c"), F.col("p"))
    return top.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), ",").alias("topics"))


#: Words that are no topics.
TOPIC_STOP = ("which", "their", "there", "these", "those", "about", "shall", "under", "would", "could", "between")
