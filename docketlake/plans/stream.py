"""Streaming queries: the events table read as a stream to its end, results by way of the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import shared_dir
from ..streaming import jobs as J

QUERIES, SQL = {}, {}
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").load(sf_dir)


def drained(stream: DataFrame) -> DataFrame:
    """All rows that the stream emits up to its present end."""
    at = f"{shared_dir(stream.sparkSession)}/{uuid.uuid4().hex}"
    J.resume_batches(stream, f"{at}/rows", f"{at}/checkpoint").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")


def register(name: str, oracle: str | None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            SQL[name] = oracle
        return fn

    return keep


# every fifth snapshot has no items; its hash changes with the order of the events
SNAPSHOTS = (
    "concat('source-', user_id % 40) as source", "event_id as seq", "case when event_type in ('error', 'signup') then 503 else 200 end as http_status",
    "concat('hash-', floor(event_id / 3) % 4) as content_hash", "case when event_id % 5 = 0 then array() else array(concat('item-', event_id % 60)) end as items",
    "ts",
)


@register("t1_detect_new_items", """with s as (select 'source-' || user_id % 40 as source, event_id as seq, 'hash-' || cast(floor(event_id / 3) % 4 as bigint) as content_hash, event_id % 5 = 0 as bare, 'item-' || event_id % 60 as item from events where event_type not in ('error', 'signup'))
  select distinct source, item, 'new' as kind from s where not bare union all select source, content_hash, 'changed' from (select *, lag(content_hash) over (partition by source order by seq) as before from s) where bare and before <> content_hash""")
def _(spark, sf):
    return drained(J.detect_changes(events(spark, sf).selectExpr(*SNAPSHOTS)))


# what the state holds after the stream's end, read from its checkpoint
@register("t1_change_state", """with s as (select 'source-' || user_id % 40 as source, event_id as seq, ts, 'hash-' || cast(floor(event_id / 3) % 4 as bigint) as content_hash, event_id % 5 = 0 as bare, 'item-' || event_id % 60 as item from events where event_type not in ('error', 'signup'))
  select source, count(distinct item) filter (not bare) as n, arg_max(content_hash, seq) as page_hash, max(seq) as last_seq, arg_max(ts, seq) as last_ok from s group by source""")
def _(spark, sf):
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    J.resume_batches(J.detect_changes(events(spark, sf).selectExpr(*SNAPSHOTS)), f"{at}/rows", f"{at}/checkpoint").awaitTermination()
    return J.change_state(spark, f"{at}/checkpoint").select("source", F.size("urls").cast("long").alias("n"), "page_hash", "last_seq", F.col("last_ok").cast("timestamp_ntz").alias("last_ok"))


@register("t1_new_items_by_key", "select distinct 'source-' || user_id % 40 as source, 'item-' || event_id % 60 as item from events")
def _(spark, sf):
    items = events(spark, sf).selectExpr("concat('source-', user_id % 40) as source", "concat('item-', event_id % 60) as item")
    return drained(J.new_items_stream(items, "source", "item"))


@register("t3_publish_updates", "select user_id as link, max(event_id) as k from events group by 1 order by k desc, link limit 50")
def _(spark, sf):
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    J.publish(events(spark, sf).selectExpr("user_id as link", "event_id as k"), f"{at}/rows", f"{at}/checkpoint", "link", "k", 50).awaitTermination()
    return J.current(spark, f"{at}/rows")


@register("t6_resume_batches", "select event_id, event_type from events where event_type <> 'view'")
def _(spark, sf):
    return drained(events(spark, sf).where("event_type <> 'view'").select("event_id", "event_type"))


RUN_STATUS = "case event_type when 'error' then 'error' when 'signup' then 'http_error' else 'ok' end"


@register("t4_run_health", f"select 'source-' || user_id % 40 as source, date_trunc('day', ts) as start, date_trunc('day', ts) + interval 1 day as \"end\", count(*) as n, cast(count_if({RUN_STATUS} = 'ok') as bigint) as ok from events group by 1, 2, 3")
def _(spark, sf):
    return _health(spark, sf)


def _with_end(spark: SparkSession, runs: DataFrame) -> DataFrame:
    """The stream and, of a source named 'end', a row so far ahead in time that the watermark passes all others."""
    late = spark.createDataFrame([("end", "ok")], "source string, status string").withColumn("ts", F.lit("2999-01-01").cast("timestamp"))
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    late.write.parquet(at)
    return runs.unionByName(spark.readStream.schema(late.schema).load(at))


def _health(spark: SparkSession, sf: str, *window: str) -> DataFrame:
    """Health by window, from the stream to its end."""
    runs = events(spark, sf).selectExpr("concat('source-', user_id % 40) as source", f"{RUN_STATUS} as status", "cast(ts as timestamp) as ts")
    rows = drained(J.run_health(_with_end(spark, runs), *window))
    day = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return rows.where("source <> 'end'").select("source", day("start"), day("end"), "n", "ok")


# every run lies in the seven windows that began on its day or the six before
@register("t4_success_rate_7_days", f"""select source, d - i * interval 1 day as start, d - i * interval 1 day + interval 7 day as "end", count(*) as n, cast(count_if(good) as bigint) as ok, round(100.0 * count_if(good) / count(*), 2)::double as rate
  from (select 'source-' || user_id % 40 as source, date_trunc('day', ts) as d, {RUN_STATUS} = 'ok' as good from events) cross join range(7) t(i) group by 1, 2, 3""")
def _(spark, sf):
    return _health(spark, sf, "7 days", "1 day").withColumn("rate", F.round(100.0 * F.col("ok") / F.col("n"), 2))


# the last row of a source before nothing came from it for over a day, at the end of the table too
@register("t4_silent_sources", """select source, ts as since from (select *, lead(ts) over (partition by source order by ts) as after from (select distinct 'user-' || user_id as source, ts from events))
  where after is null or after - ts > interval 1 day""")
def _(spark, sf):
    runs = events(spark, sf).selectExpr("concat('user-', user_id) as source", "'ok' as status", "cast(ts as timestamp) as ts")
    rows = drained(J.silent_sources(_with_end(spark, runs), "1 day"))
    return rows.where("source <> 'end'").select("source", F.col("since").cast("timestamp_ntz").alias("since"))


@register("t4_run_health_batch", f"select 'source-' || user_id % 40 as source, date_trunc('day', ts) as start, date_trunc('day', ts) + interval 1 day as \"end\", count(*) as n, cast(count_if({RUN_STATUS} = 'ok') as bigint) as ok from events group by 1, 2, 3")
def _(spark, sf):
    runs = spark.read.schema(SCHEMA).parquet(f"{sf}/events.parquet").selectExpr("concat('source-', user_id % 40) as source", f"{RUN_STATUS} as status", "ts")
    day = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return J.run_health(runs).select("source", day("start"), day("end"), "n", "ok")


@register("t5_live_status", f"select 'total' as part, {RUN_STATUS} as status, count(*) as n, max(event_id) as last, cast(null as varchar) as url from events group by 2 union all select * from (select 'recent', {RUN_STATUS}, cast(1 as bigint), event_id, 'https://h' || user_id % 17 || '.example.org/' as url from events order by event_id desc limit 15)")
def _(spark, sf):
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    runs = events(spark, sf).selectExpr("event_id as k", f"{RUN_STATUS} as status", "concat('https://h', user_id % 17, '.example.org/') as url")
    J.live_status(runs, f"{at}/rows", f"{at}/checkpoint", None).awaitTermination()
    return J.current(spark, f"{at}/rows")


_page = f"(select event_id as k, {RUN_STATUS} as status, 'https://h' || user_id % 17 || '.example.org/' as url, case when user_id % 60 > 0 then 'place-' || user_id % 60 end as jurisdiction, event_type as source_kind from events)"


@register("t5_status_page", f"""with r as {_page}, j as (select coalesce(jurisdiction, 'Unknown') as name, count(*) as n, max(k) as last from r group by 1 order by n desc, name limit 40)
  select 'phase' as part, 'done' as name, count(*) as n, max(k) as last, cast(null as varchar) as url from r union all select 'total', status, count(*), max(k), null from r group by status union all select 'jurisdiction', name, n, last, null from j
  union all select 'source_kind', source_kind, count(*), max(k), null from r group by source_kind union all select * from (select 'recent', status, cast(1 as bigint), k, url from r order by k desc limit 15)""")
def _(spark, sf):
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    runs = events(spark, sf).selectExpr(
        "event_id as k", f"{RUN_STATUS} as status", "concat('https://h', user_id % 17, '.example.org/') as url", "case when user_id % 60 > 0 then concat('place-', user_id % 60) end as jurisdiction", "event_type as source_kind"
    )
    J.finish(spark, J.live_status(runs, f"{at}/rows", f"{at}/checkpoint", None, by=("jurisdiction", "source_kind")), f"{at}/rows")
    return J.status_page(spark, f"{at}/rows")
