"""Readers and writers of catalogs, manifests, source lists and page snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import urls as U
from ..operators.storage import discard, numbered, saved


def read_json_table(spark: SparkSession, path: str, schema: StructType | str, *others: str) -> DataFrame:
    """A JSON array of records at the first of the paths that exists; without one an empty table. Blank strings are null."""
    for place in (path, *others):
        try:
            return _blank_to_null(spark.read.schema(schema).option("multiLine", True).json(place))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.createDataFrame([], schema)


def _blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.nullif(F.trim(F.col(n)), F.lit("")).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes])


def read_jsonl_latest(spark: SparkSession, path: str, schema: StructType | str, key: str = "id", newest: str = "summarized_at", needed: str = "summary") -> DataFrame:
    """JSON lines: malformed ones dropped, the newest of each key, rows without ``needed`` dropped."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull())
    last = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.coalesce(F.col(newest), F.lit(""))).alias("r")).select("r.*")
    return last.where(F.trim(F.coalesce(F.col(needed), F.lit(""))) != "")


def explode_manifest(manifest: DataFrame) -> dict[str, DataFrame]:
    """The tables of a nested manifest, one for each array column; downloads without dry runs."""
    out = {n: manifest.select(F.inline(n)) for n, t in manifest.dtypes if t.startswith("array<struct")}
    if "downloads" in out and "dry_run" in out["downloads"].columns:
        out["downloads"] = out["downloads"].where(~F.coalesce("dry_run", F.lit(False)))
    return out


def parse_source_lines(lines: DataFrame) -> DataFrame:
    """(jurisdiction, source_kind, url) of text lines (value): one to three fields parted by '|', '#' comments."""
    parts = F.transform(F.split(F.trim("value"), r"\|"), lambda x: F.trim(x))
    rows = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#")).select(parts.alias("p"))
    n = F.size("p")
    at = lambda i: F.try_element_at("p", F.lit(i))
    return rows.select(
        F.when(n == 1, F.lit("AdHoc")).otherwise(at(1)).alias("jurisdiction"), F.when(n < 3, F.lit("custom")).when(at(2) == "", F.lit("custom")).otherwise(at(2)).alias("source_kind"),
        F.when(n == 1, at(1)).when(n == 2, at(2)).otherwise(at(3)).alias("url"),
    )


def read_source_list(spark: SparkSession, path: str) -> DataFrame:
    """A source list: text lines, or JSON (strings or records, bare or under urls or sources)."""
    if not path.endswith(".json"):
        return parse_source_lines(spark.read.text(path))
    body = spark.read.text(path, wholetext=True)
    record = "struct<url:string,jurisdiction:string,source_kind:string,kind:string>"
    array = F.coalesce(F.get_json_object("value", "$.urls"), F.get_json_object("value", "$.sources"), F.col("value"))
    items = body.select(F.explode(F.from_json(array, "array<string>")).alias("item"))
    parsed = items.select("item", F.from_json("item", record).alias("r"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = parsed.select(F.coalesce(blank(F.col("r.jurisdiction")), F.lit("AdHoc")).alias("jurisdiction"), F.coalesce(blank(F.col("r.source_kind")), blank(F.col("r.kind")), F.lit("custom")).alias("source_kind"), F.when(F.col("item").startswith("{"), F.col("r.url")).otherwise(F.col("item")).alias("url"))
    return rows.where("url <> ''")


def records_from_sheet(grid: DataFrame, header_row: int = 0, order: str = "row") -> DataFrame:
    """Records of a raw grid (row, c0, c1, ...): names from ``header_row`` (a blank one is col_ and its place, from 1; a repeated one has _2, _3, ... after it); blank rows dropped, values trimmed, whole numbers without '.0', dates in ISO form (without a time of midnight)."""
    cells = [c for c in grid.columns if c != order]
    head = grid.where(F.col(order) == header_row).first()
    names: list[str] = []
    times: dict[str, int] = {}
    for i, c in enumerate(cells):
        base = " ".join(str((head[c] if head else None) or "").split()) or f"col_{i + 1}"
        times[base] = times.get(base, 0) + 1
        names.append(base if times[base] == 1 else f"{base}_{times[base]}")
    whole = lambda t: F.regexp_replace(t, r"^(-?\d+)\.0$", "$1")
    iso = lambda t: F.regexp_replace(F.regexp_replace(t, r"^(\d{4}-\d\d-\d\d)[ T]00:00:00(?:\.0+)?$", "$1"), r"^(\d{4}-\d\d-\d\d) (\d\d:\d\d:\d\d)$", "$1T$2")
    value = lambda c: F.nullif(iso(whole(F.trim(F.col(c).cast("string")))), F.lit(""))
    rows = grid.where(F.col(order) > header_row).select(order, *[value(c).alias(n) for c, n in zip(cells, names)])
    return rows.where(F.coalesce(*[F.col(f"`{n}`") for n in names]).isNotNull())


#: Headers of the primary sheet, the first there is counts.
PRIMARY = {
    "region": ("Region",), "jurisdiction": ("Jursidictions", "Jurisdictions"),
    "authority": ("Name of Regulatory Authority/ Concerned Ministry/ Government Website/ Concerned Department/ Secretary of State/Attorney General",),
    "authority_type": ("Nature of Authority",), "link_nature": ("Nature of weblink",), "url": ("Website links",), "segment": ("Segment (Private, Capital, Enterprise)",),
}
#: Headers of the analysts' log.
TRACKED = {
    "country": "Country", "federal_or_state": "Federal/State", "period_of_tracking": "Period of Tracking", "date_of_tracking": "Date of Tracking",
    "date_of_publication": "Date of Publication on Subscribed Database (DD-MMM-YYYY)", "law_area": "Law Area", "topical_relevance": "Topical Relevance",
    "link": "Link for update", "remarks": "Remarks/Reasons for tracking", "tracked_by": "Tracked by", "relevancy": "Relevancy", "comments": "Comments",
    "cor_impact": "COR Impact (Yes/No)", "assigned_to": "Assigned to", "slr_name": "SLR Name", "alert_status": "Alert Status", "last_tracked": "Last tracked", "kmp_id": "KMP ID",
}


def _filled(sheet: DataFrame, names) -> Column:
    """The first filled one of the sheet's columns ``names``, null where it has none."""
    there = [F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in sheet.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def seed_sources(sheet: DataFrame) -> DataFrame:
    """Registry rows of the primary sheet: topic and sub-category columns gathered, the first filled frequency column, and the status.

    A link whose nature says that it isn't working is broken; else one without URL is missing_url, one whose own cell says
    so broken, any other active.
    """
    topics = [F.nullif(F.col(f"`{c}`"), F.lit("")) for c in sheet.columns if "Sub Category" in c or "Topic" in c]
    own = {n: _filled(sheet, headers) for n, headers in PRIMARY.items()}
    dead = lambda c: F.coalesce(F.lower(c).contains("not working"), F.lit(False))
    status = F.when(dead(own["link_nature"]), "broken").when(own["url"].isNull(), "missing_url").when(dead(own["url"]), "broken").otherwise("active")
    return sheet.select(
        *[c.alias(n) for n, c in own.items()], _filled(sheet, [c for c in sheet.columns if "frequency" in c.lower()]).alias("frequency"),
        F.array_compact(F.array(*topics) if topics else F.array().cast("array<string>")).alias("topics"), status.alias("status"), F.lit("primary").alias("source_kind"),
    )


def seed_by_position(sheet: DataFrame, names: list[str], order: str = "row") -> DataFrame:
    """The sheet's columns under ``names``, by position."""
    return sheet.toDF(*[order if c == order else c for c in sheet.columns]).select(*[F.col(f"`{c}`").alias(n) for c, n in zip([c for c in sheet.columns if c != order], names)])


def seed_tracking(sheet: DataFrame) -> DataFrame:
    """The analysts' log: columns by header; the publication date is any publication column's where its own is blank, alerts are new by default."""
    published = [TRACKED["date_of_publication"], *[c for c in sheet.columns if "Publication" in c]]
    cells = {n: _filled(sheet, published if n == "date_of_publication" else [h]) for n, h in TRACKED.items()}
    cells["alert_status"] = F.coalesce(cells["alert_status"], F.lit("new"))
    return sheet.select(*[c.alias(n) for n, c in cells.items()])


def seed_gazette(gazette: DataFrame) -> DataFrame:
    """(jurisdiction, source_kind, url): one row for each URL of each cell of the gazette table."""
    kinds = ["parliamentary_bills", "official_gazette", "legal_databases"]
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("source_kind"), F.col(k).alias("cell")) for k in kinds]))
    rows = gazette.select("jurisdiction", pairs.alias("p")).where("p.cell is not null")
    return rows.select("jurisdiction", "p.source_kind", F.explode(U.split_urls(F.col("p.cell"))).alias("url"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def scan_binary_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, key, is_pdf) of the files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("bytes"), U.content_key(F.col("content")).alias("key"), (F.substring("content", 1, 4).cast("string") == "%PDF").alias("is_pdf"))


def merge_artifacts(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """The downloads of all JSON files below ``path``; a file is a list, or an object with downloads."""
    body = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    array = F.when(F.trim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.downloads"))
    return body.select(F.inline(F.from_json(array, f"array<struct<{schema}>>")))


def write_tables(df: DataFrame, *targets: str, format: str = "json") -> None:
    """Overwrite every target with the whole table. The plan runs once: further targets are written from the shared folder."""
    held = saved(df) if len(targets) > 1 else df
    for target in targets:
        held.write.mode("overwrite").format(format).save(target)
    discard(held)


def write_csv_index(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def load_for_browse(catalog: DataFrame) -> DataFrame:
    """Catalog rows with the first non-blank of open_url, download_url and url; rows without are dropped; bytes as a number."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    have = [c for c in ("open_url", "download_url", "url") if c in catalog.columns]
    out = catalog.withColumn("open_url", F.coalesce(*[blank(c) for c in have])).where("open_url is not null")
    return out.withColumn("bytes", F.expr("try_cast(bytes as bigint)")) if "bytes" in catalog.columns else out


def first_non_empty(*tables: DataFrame) -> DataFrame:
    """The first table that has rows; the last one if none has."""
    return next((t for t in tables[:-1] if not t.isEmpty()), tables[-1])


def catalog_from_manifest(downloads: DataFrame, order: Column) -> DataFrame:
    """The summariser's input for manifest downloads: id is the hash, or pdf_<ordinal>."""
    downloads = numbered(downloads, "_nth", order)
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return downloads.select(F.coalesce(blank("sha256"), F.concat(F.lit("pdf_"), F.col("_nth").cast("string"))).alias("id"), F.coalesce(blank("title"), blank("filename"), F.lit("Untitled")).alias("title"), "jurisdiction", "source_kind", "url", F.col("url").alias("open_url"))
