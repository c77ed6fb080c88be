"""Structured Streaming: new items against kept state, page changes, run health, publishing and resumable batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

UPDATES = "source string, item string, kind string"
STATE = "urls array<string>, page_hash string, last_seq long, last_ok timestamp"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _on_disk(spark: SparkSession) -> None:
    """Keep state in RocksDB, which the operators below need: it holds on disk what does not fit in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Changes(StatefulProcessor):
    """What each source has shown: its latest items, the last page's hash, and when it last answered."""

    def __init__(self, remember: int):
        self.remember = remember

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        urls, before, last, when = self.seen.get() if self.seen.exists() else ([], None, None, None)
        items = dict.fromkeys(urls or [])
        waiting = [(r.seq, r.content_hash, r.items or [], r.ts) for r in rows if r.http_status is not None and 0 < r.http_status < 400]
        for seq, digest, shown, ts in sorted(waiting, key=lambda r: (r[0], r[1] or "")):
            for item in shown:
                if item not in items:
                    yield Row(source=key[0], item=item, kind="new")
                items.pop(item, None)
                items[item] = None
            if not shown and before is not None and before != digest:
                yield Row(source=key[0], item=digest, kind="changed")
            before, last, when = digest, seq, ts if ts is not None else when
        if waiting:
            self.seen.update((list(items)[-self.remember :], before, last, when))

    def close(self) -> None:
        pass


def detect_changes(snapshots: DataFrame, remember: int = 200) -> DataFrame:
    """Updates of a stream of snapshots (source, seq, http_status, content_hash, items array<string>, and ts if there is one).

    One row for each item that its source has not shown before (kind new), and one where a page without items has another
    hash than last time (kind changed), in the order of ``seq``. Only responses from 1 to 399 touch the state, which is in
    RocksDB, a row a source: its last ``remember`` items, page hash, seq and ``ts`` (see ``change_state``). Items beyond
    ``remember`` are forgotten when a batch ends. Of a batch a task holds one source's good snapshots, so the stream's
    ``maxFilesPerTrigger`` bounds memory; between batches the stream's own order counts: later files should hold later snapshots.
    """
    _on_disk(snapshots.sparkSession)
    ts = F.col("ts").cast("timestamp") if "ts" in snapshots.columns else F.lit(None).cast("timestamp")
    rows = snapshots.select("source", F.col("seq").cast("long").alias("seq"), "http_status", "content_hash", "items", ts.alias("ts"))
    return rows.groupBy("source").transformWithState(_Changes(remember), UPDATES, "append", "none")


def change_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(source, urls, page_hash, last_seq, last_ok): what ``detect_changes`` with this checkpoint knows of each source."""
    return spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint).select("key.source", "value.*")


class _Silence(StatefulProcessor):
    """The latest time of each source; a timer goes off when nothing has come for ``after`` microseconds since."""

    def __init__(self, after: int):
        self.after = after

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, told = self.last.get() if self.last.exists() else (None, False)
        for at in sorted(r.at for r in rows if r.at is not None):
            if last is not None and at <= last:
                continue
            if last is not None and at - last > self.after and not told:
                yield Row(source=key[0], since=last)
            last, told = at, False
        if last is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update((last, told))
            if not told:
                self.handle.registerTimer((last + self.after) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, _ = self.last.get()
        self.last.update((last, True))
        yield Row(source=key[0], since=last)

    def close(self) -> None:
        pass


def silent_sources(runs: DataFrame, after: str = "7 days", delay: str = "1 day") -> DataFrame:
    """(source, since): each time that nothing came from a source for longer than ``after``, and its last row before that.

    runs (source, ts). A silence that has not ended is told as soon as the watermark, ``delay`` behind the latest row of any
    source, has passed its limit; one that a later row ends is told once. Rows without a time or later than the watermark do not count.
    """
    _on_disk(runs.sparkSession)
    span = runs.sparkSession.sql(f"select unix_micros(timestamp_seconds(0) + interval {after})").first()[0]
    rows = runs.select("source", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    told = rows.groupBy("source").transformWithState(_Silence(span), "source string, since long", "append", "eventTime")
    return told.select("source", F.timestamp_micros("since").alias("since"))


def new_items_stream(items: DataFrame, *keys: str, delay: str | None = None, time: str = "ts") -> DataFrame:
    """Items whose keys the stream has not had; with ``delay`` the state forgets keys older than that."""
    if delay is None:
        return items.dropDuplicates(list(keys))
    return items.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def run_health(runs: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Runs and successes by source and window of the event time ``ts``; rows later than ``delay`` are dropped."""
    when = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = runs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy("source", when.alias("w"))
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok")).select("source", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "ok")


def publish(updates: DataFrame, path: str, checkpoint: str, key: str, newest: str, most: int = 5000):
    """A query that keeps at ``path`` the newest ``most`` updates, one for each ``key``; a batch that runs again changes nothing.

    Each batch writes a new version next to the last and then commits it (see ``commit``).
    """

    def write(batch: DataFrame, epoch: int) -> None:
        own = batch.sparkSession
        last = current(own, path, before=epoch)
        rows = batch.unionByName(last) if last is not None else batch
        last_of = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), F.col(newest)).alias("_row"))
        rows = last_of.select("_row.*").orderBy(F.desc(newest), key).limit(most)
        commit(rows, path, epoch)

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(spark: SparkSession, path: str) -> tuple:
    """The file system of ``path``, and a function that makes its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def committed(spark: SparkSession, path: str) -> list[int]:
    """The versions at ``path`` that are whole, oldest first."""
    files, make = _files(spark, path)
    marks = make(f"{path}/_commits")
    return sorted(int(x.getPath().getName()) for x in files.listStatus(marks)) if files.exists(marks) else []


def commit(rows: DataFrame, path: str, version: int, keep: int = 3) -> None:
    """Write ``rows`` as a version of the table at ``path``; readers see all of it or, until it is whole, the one before.

    The data comes first, then an empty file under _commits, whose creation makes the version the current one. A batch that
    died in between left data that no reader looks at and that its next run overwrites. All but the last ``keep`` versions go.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")
    files, make = _files(spark, path)
    files.create(make(f"{path}/_commits/{version}"), True).close()
    for old in committed(spark, path)[:-keep]:
        files.delete(make(f"{path}/_commits/{old}"), False)
        files.delete(make(f"{path}/version={old}"), True)


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last committed version at ``path`` (``before`` a version, if given), or None."""
    versions = [v for v in committed(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/version={versions[-1]}") if versions else None


def resume_batches(stream: DataFrame, path: str, checkpoint: str):
    """A query that writes what has arrived since the last run to Parquet, and ends; done files are never read again."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def set_phase(spark: SparkSession, path: str, phase: str) -> None:
    """Note that the crawl whose state is at ``path`` is in ``phase`` (a word); a phase that it is in already is not noted again."""
    files, make = _files(spark, path)
    told = _phases(spark, path)
    if not told or told[-1][1] != phase:
        files.create(make(f"{path}/_phases/{len(told):06d}_{phase}"), True).close()


def _phases(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(number, phase) of all phases at ``path``, oldest first."""
    files, make = _files(spark, path)
    marks = make(f"{path}/_phases")
    return [tuple(n.split("_", 1)) for n in sorted(x.getPath().getName() for x in files.listStatus(marks))] if files.exists(marks) else []


def live_status(runs: DataFrame, path: str, checkpoint: str, every: str | None = "120 seconds", recent: int = 15, by: tuple[str, ...] = ()):
    """A query that keeps the state of a crawl at ``path`` up to date ``every`` so often (None: until the stream's present end).

    runs (k, status, url and the columns ``by``): the last version at ``path`` (see ``current``) has a row for each status (part
    'total') with its runs and latest k, one for each value of a column of ``by`` (part: the column's name; status: the value, or
    Unknown), and the ``recent`` latest runs (part 'recent'). The totals of a version are those of the last plus the batch's own, so
    a batch that runs again changes nothing. The phase is 'running' from the first batch on; ``finish`` notes its end.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        own = batch.sparkSession
        set_phase(own, path, "running")
        last = current(own, path, before=epoch)
        names = [F.struct(F.lit("total").alias("part"), "status"), *[F.struct(F.lit(c).alias("part"), F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias("status")) for c in by]]
        counts = batch.select("k", F.explode(F.array(*names)).alias("v")).groupBy("v.part", "v.status").agg(F.count("*").alias("n"), F.max("k").alias("last"))
        late = batch.orderBy(F.desc("k")).limit(recent).select(F.lit("recent").alias("part"), "status", F.lit(1).cast("long").alias("n"), F.col("k").alias("last"), "url")
        rows = counts.withColumn("url", F.lit(None).cast("string")).unionByName(late)
        rows = rows.unionByName(last.select(*rows.columns)) if last is not None else rows
        totals = rows.where("part <> 'recent'").groupBy("part", "status").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("url").alias("url"))
        newest = rows.where("part = 'recent'").orderBy(F.desc("last")).limit(recent)
        commit(totals.unionByName(newest.select(*totals.columns)), path, epoch)

    writer = runs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def finish(spark: SparkSession, query, path: str) -> None:
    """Wait for a query of ``live_status`` and note its end: phase 'done', or 'failed' if it failed, which is raised."""
    try:
        query.awaitTermination()
    except Exception:
        set_phase(spark, path, "failed")
        raise
    set_phase(spark, path, "done")


def status_page(spark: SparkSession, path: str, most: int = 40) -> DataFrame:
    """(part, name, n, last, url): the state at ``path`` for a page.

    It is what ``live_status`` keeps, of every column counted by the ``most`` frequent values (ties: by name), and a row with
    part 'phase': the phase with the runs so far and the latest k. Before the first version it is that row alone, with 0 runs.
    """
    told = _phases(spark, path)
    state = F.lit(told[-1][1] if told else None).cast("string").alias("name")
    rows = current(spark, path)
    if rows is None:
        return spark.range(1).select(F.lit("phase").alias("part"), state, F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("string").alias("url"))
    rows = rows.withColumnRenamed("status", "name")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "name"))
    counted = rows.where("part not in ('total', 'recent')").withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
    phase = rows.where("part = 'total'").agg(F.sum("n").alias("n"), F.max("last").alias("last")).select(F.lit("phase").alias("part"), state, "n", "last", F.lit(None).cast("string").alias("url"))
    return rows.where("part in ('total', 'recent')").unionByName(counted).unionByName(phase)
