"""Running values over a source's rows in order, without bringing a source into one task.

A table is dealt into ranges of (source, order); each range works its own rows out, what a range must know of those before
it comes from a scan over one row a source and range, and then the range's rows are completed. So a source that holds half of
all rows is spread over as many tasks as its rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .storage import saved


def ranges(rows: DataFrame, source: str, order: str, parts: int | None = None) -> DataFrame:
    """``rows`` as a written table with ``_part``, the range they are in; rows equal in both columns share one."""
    by = (F.col(source), F.col(order))
    dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    return saved(dealt.withColumn("_part", F.spark_partition_id()))


def within(source: str, order: str) -> WindowSpec:
    """A source's rows of one range, in order."""
    return Window.partitionBy("_part", source).orderBy(order)


def carried(ranged: DataFrame, source: str, summary: dict[str, Column], carry: dict[str, tuple]) -> DataFrame:
    """(_part, _source, names of ``carry``): what the ranges before hold of each source.

    ``summary`` has an aggregate a range and source; ``carry`` a function of these and its value where no range is before.
    """
    before = Window.partitionBy(source).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(source, "_part").agg(*[c.alias(n) for n, c in summary.items()])
    return sums.select("_part", F.col(source).alias("_source"), *[F.coalesce(make.over(before), F.lit(none)).alias(n) for n, (make, none) in carry.items()])


def completed(local: DataFrame, carry: DataFrame, source: str) -> DataFrame:
    """``local`` (range by range) with the columns of ``carry`` beside each row."""
    before = carry.withColumnRenamed("_part", "_range")
    return local.join(before, (F.col("_part") == F.col("_range")) & F.col(source).eqNullSafe(F.col("_source"))).drop("_range", "_source")


def empty_streaks(visits: DataFrame, source: str, order: str, links: str, least: int = 8, parts: int | None = None) -> DataFrame:
    """Runs of ``least`` or more visits in a row without links: (source, first, last, n)."""
    linked = (F.col(links) > 0).cast("int")
    ranged = ranges(visits.select(source, order, links), source, order, parts)
    local = ranged.withColumn("_island", F.sum(linked).over(within(source, order))).where(F.col(links) == 0)
    pieces = local.groupBy("_part", source, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    before = carried(ranged, source, {"_linked": F.sum(linked)}, {"_before": (F.sum("_linked"), 0)})
    whole = completed(pieces, before, source).groupBy(source, (F.col("_before") + F.coalesce("_island", F.lit(0))).alias("_run"))
    return whole.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).where(F.col("n") >= least).drop("_run")


def failed_runs(visits: DataFrame, source: str, order: str, error: str, documents: str, errors: int = 20, pages: int = 12, parts: int | None = None) -> DataFrame:
    """(source, at): where a crawl gives up: the first visit by ``order`` that ends ``errors`` errors in a row while no
    document was found (``documents``: found by the visit) and ``pages`` pages were visited.
    """
    ranged = ranges(visits.select(source, order, F.col(error).cast("int").alias("_bad"), F.col(documents).alias("_found")), source, order, parts)
    so_far = within(source, order)
    local = ranged.withColumn("_errors", F.sum("_bad").over(so_far))
    # errors up to the last visit that went well: the run of errors that ends a visit is what came after
    well = F.when(F.col("_bad") == 0, F.col("_errors"))
    local = local.withColumns({"_well": F.max(well).over(so_far), "_documents": F.sum("_found").over(so_far), "_seen": F.row_number().over(so_far)})
    sums = {"_e": F.sum("_bad"), "_d": F.sum("_found"), "_n": F.count("*")}
    totals = carried(ranged, source, sums, {"_errors0": (F.sum("_e"), 0), "_documents0": (F.sum("_d"), 0), "_seen0": (F.sum("_n"), 0)})
    own = local.groupBy(source, "_part").agg(F.max("_well").alias("_w"))
    marks = completed(own, totals, source).withColumn("_mark", F.col("_w") + F.col("_errors0"))
    earlier = Window.partitionBy(source).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = marks.select("_part", F.col(source).alias("_source"), "_errors0", "_documents0", "_seen0", F.coalesce(F.max("_mark").over(earlier), F.lit(0)).alias("_well0"))
    rows = completed(local, carry, source)
    run = F.col("_errors0") + F.col("_errors") - F.coalesce(F.col("_errors0") + F.col("_well"), F.col("_well0"))
    given_up = (run >= errors) & (F.col("_documents0") + F.col("_documents") == 0) & (F.col("_seen0") + F.col("_seen") >= pages)
    return rows.where(given_up).groupBy(source).agg(F.min(order).alias("at"))


def previous(rows: DataFrame, source: str, order: str, value: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``_before``: a struct of the ``value`` of the source's row before, null for its first row."""
    ranged = ranges(rows, source, order, parts)
    own, held = within(source, order), F.struct(F.col(value).alias("value"))
    local = ranged.withColumns({"_lag": F.lag(held).over(own), "_n": F.row_number().over(own)})
    carry = carried(ranged, source, {"_last": F.max_by(held, F.struct(order))}, {"_last0": (F.last("_last"), None)})
    before = F.when(F.col("_n") > 1, F.col("_lag")).otherwise(F.col("_last0")).alias("_before")
    return completed(local, carry, source).select(*rows.columns, before)


def page_changes(runs: DataFrame, parts: int | None = None) -> DataFrame:
    """(source, k, content_hash): successful runs without items whose page differs from the source's successful run before."""
    ok = runs.where("http_status > 0 and http_status < 400").select("source", "k", "content_hash", "item_count")
    return previous(ok, "source", "k", "content_hash", parts).where("item_count = 0 and _before.value <> content_hash").select("source", "k", "content_hash")
