"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.storage import discard, saved, shared_dir  # noqa: F401


def map_arrow(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: StructType | str, rows: int = 1024
) -> DataFrame:
    """Apply ``fn`` to Arrow batches of up to ``rows`` rows of ``df``; batches for which it returns None give no rows.

    Spark's own batches hold up to 10,000 texts; a worker that makes Python objects of all of them at once stays that large.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, rows):
            if (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


#: What operators keep in a Python worker from task to task; a worker that takes up other work gives it back.
KEPT: list[dict] = []


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows; empty ones are left out. At the end Arrow gives back what it holds unused.

    Unless ``keep``, what earlier tasks of this worker kept is given up first.
    """
    for kept in KEPT if not keep else ():
        kept.clear()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def sized(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces whose texts in ``column`` have ``most`` bytes together; a longer text is a piece of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def text_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators read, under their standard names."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def gapless(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str, buckets: int) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each group, without bringing a whole group into one task.

    Rows are dealt to ``buckets`` by a hash of the order columns; each bucket of a group is numbered by itself and
    shifted by the rows of the buckets before it, so a group that holds all rows is still numbered in parallel.
    """
    keys = list(groups)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_k_bucket"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"),
    )
    own = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    on = F.col("_bucket") == F.col("_k_bucket")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    numbered = dealt.withColumn("_own", F.row_number().over(own) - 1)
    return (
        numbered.join(shifts, on)
        .withColumn(name, (F.col("_own") + F.col("_shift")).cast("long"))
        .drop("_own", "_shift", "_bucket", "_k_bucket", *[f"_k_{k}" for k in keys])
    )


def join_classes(rows: DataFrame, classes: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with what ``classes`` (key, n, ...; one row a key, ``n`` rows each) has of their key; both columns stay.

    Keys that hold over a ten-thousandth of the ``total`` rows are at most ten thousand; they go to every task, so their
    rows are not shuffled. All other keys are joined by shuffle, and none of these is large.
    """
    own = classes.withColumnRenamed(key, "_key")
    hot, cold = own.where(F.col("n") * 10_000 > total), own.where(F.col("n") * 10_000 <= total)
    same = F.col(key) == F.col("_key")
    rest = rows.join(F.broadcast(hot.select("_key")), same, "left_anti")
    return rows.join(F.broadcast(hot), same).drop("_key", "n").unionByName(rest.join(cold, same).drop("_key", "n"))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of an edge list (a, b): rows (node, root), root the smallest node of its component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) until the edge set stops changing. Every round
    is written to the shared folder, so no round is ever recomputed and a lost executor costs one round at most. The hub
    of a very large component is a hot key of a round's joins, which adaptive execution (on by default) splits.
    """
    stars = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state = _state(stars)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        before, stars = stars, saved(_small_star(_large_star(stars)))
        last, state = state, _state(stars)
        discard(before)
        if state == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(stars: DataFrame) -> tuple:
    row = stars.agg(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"),
        F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["x"], row["s"]


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.union(stars.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    down = stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m"))).where("u != v").distinct()
