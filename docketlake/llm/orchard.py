"""Centroid clustering (Lloyd's rounds in exact integers) with Orchard's search for the nearest centroid.

Every centroid has the list of the others in order of distance. A vector starts at some centroid and goes down that
one's list; a centroid that is closer takes over with its own list, those looked at are marked and not measured again,
and the search stops at the first in the list that lies strictly beyond twice the present distance, as by the triangle
inequality neither it nor those after it can be as close. Tasks search for all vectors of a batch at once and send on a
sum a centroid; the centroids, ``k`` times ``size`` numbers, go out with each round.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, saved

#: Integers beyond this would give distances beyond a long.
_MOST = 1 << 27


@dataclass(frozen=True)
class Lists:
    """Centroids, and for each the others in ``order`` of distance (ties by number) with their squared distance, ``reach``."""

    centroids: np.ndarray
    order: np.ndarray
    reach: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> "Lists":
        far = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(-1)
        order = np.array([[j for j in np.lexsort((np.arange(len(far)), row)) if j != i] for i, row in enumerate(far)], np.int64).reshape(len(far), -1)
        return cls(centroids, order, np.take_along_axis(far, order, 1) if order.size else far[:, :0])

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``x`` the nearest centroid (ties: smaller number) and the squared distance, beginning at ``start``."""
        k = len(self.centroids)
        now = start.copy()
        best = ((x - self.centroids[now]) ** 2).sum(1)
        at = np.zeros(len(x), np.int64)
        seen = np.zeros((len(x), k), bool)
        seen[np.arange(len(x)), now] = True
        open_ = np.arange(len(x)) if k > 1 else np.arange(0)
        while len(open_):
            here, place = now[open_], at[open_]
            # strictly beyond twice the distance ends it: squared, over four times (a quarter of the reach, as that fits a long)
            open_ = open_[-(-self.reach[here, place] // 4) <= best[open_]]
            other = self.order[now[open_], at[open_]]
            at[open_] += 1
            new = ~seen[open_, other]
            rows, other = open_[new], other[new]
            seen[rows, other] = True
            d = ((x[rows] - self.centroids[other]) ** 2).sum(1)
            closer = (d < best[rows]) | (d == best[rows]) & (other < now[rows])
            rows = rows[closer]
            now[rows], best[rows], at[rows] = other[closer], d[closer], 0
            open_ = open_[at[open_] < k - 1]
        return now, best


def integer_vectors(vectors: DataFrame, size: int = 64, scale: int = 1024, column: str = "embedding") -> DataFrame:
    """vec_id and x, the components as integers floor(scale * component), of vectors that have ``size`` finite ones."""
    wide = F.transform(F.col(column), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    finite = F.forall(F.col(column), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    kept = vectors.where((F.size(column) == size) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("x"))
    over = F.exists("x", lambda v: F.abs(v) > _MOST)
    return kept.select("vec_id", F.when(over, F.raise_error(F.lit(f"a component is beyond {_MOST // scale}: distances would not fit a long"))).otherwise(F.col("x")).alias("x"))


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3:", column: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, cluster, distance) of every kept vector, as a written table, and the centroids.

    Centroids start as the ``k`` kept vectors of the smallest sha256 of ``seed`` + vec_id (ties: by components); each
    round takes every vector to the nearest and each non-empty centroid to the floor of its vectors' mean, in exact
    integers. Vectors of another size, null or with a null or non-finite component are left out; those without vec_id are
    no first centroids but are clustered; repeated rows each count and give a row. With fewer than ``k`` distinct rows to
    start from there are fewer centroids; an empty table has none and gives no rows. A component beyond 131,072 raises an
    error, as a squared distance might then not fit a long.
    """
    table = integer_vectors(vectors, size, scale, column)
    first = table.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256), "x").limit(k)
    centroids = np.array([r["x"] for r in first.select("x").collect()], np.int64).reshape(-1, size)
    if not len(centroids):
        return saved(table.where("false").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))), centroids
    lists = Lists.of(centroids)

    def hinted(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch, size)
        near, _ = lists.nearest(x, np.zeros(len(x), np.int64))
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(near.astype(np.int32))], ["vec_id", "x", "start"])

    # where the first round leads is where every later search begins
    points = saved(map_arrow(table, hinted, "vec_id long, x array<long>, start int", 4096))
    for _ in range(rounds):
        centroids = _moved(points, Lists.of(centroids), size)
    last = Lists.of(centroids)

    def assigned(batch: pa.RecordBatch) -> pa.RecordBatch:
        near, far = last.nearest(_matrix(batch, size), batch.column("start").to_numpy().astype(np.int64))
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    return saved(map_arrow(points, assigned, "vec_id long, cluster int, distance long", 4096)), centroids


def _moved(points: DataFrame, lists: Lists, size: int) -> np.ndarray:
    """The centroids after one round; tasks add up each batch, Spark the batches, and ``k`` times ``size`` sums come to the driver."""

    def sums(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch, size)
        near, _ = lists.nearest(x, batch.column("start").to_numpy().astype(np.int64))
        order = np.argsort(near, kind="stable")
        own, at, n = np.unique(near[order], return_index=True, return_counts=True)
        added = np.add.reduceat(x[order], at, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n), pa.FixedSizeListArray.from_arrays(added.ravel(), size).cast(pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = map_arrow(points, sums, "cluster int, n long, sums array<long>", 4096).select("cluster", "n", F.posexplode("sums"))
    total = parts.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(19,0)")).alias("s"))
    moved = lists.centroids.copy()
    for row in total.collect():
        moved[row["cluster"], row["pos"]] = int(row["s"]) // row["n"]
    return moved


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """``cluster`` with the sums of distances and each centroid's digest beside every row.

    vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 (of the components, in decimal, joined by commas).
    """
    rows, centroids = cluster(vectors, **options)
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(30,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = F.array(*[F.lit(sums.get(i, 0)).cast("long") for i in range(len(digests))]) if digests else F.array().cast("array<long>")
    shas = F.array(*map(F.lit, digests)) if digests else F.array().cast("array<string>")
    return rows.select(
        "vec_id", "cluster", "distance", F.get(own, "cluster").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), F.get(shas, "cluster").alias("centroid_sha256"),
    )


def _sql(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """The same rounds spelled out, a pair of tables each."""
    steps = [
        f"""v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as x from embeddings
    where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size})""",
        f"c0 as materialized (select row_number() over (order by h, x) - 1 as cluster, x from (select sha256('3:' || vec_id) as h, x from v where vec_id is not null order by h, x limit {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} as materialized (select r, vec_id, cluster, x, d from (select v.r, v.vec_id, c.cluster, v.x,
    list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from v cross join c{i} c) qualify row_number() over (partition by r order by d, cluster) = 1)"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} as materialized (select c{i}.cluster, coalesce(m.x, c{i}.x) as x from c{i} left join (select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as x
    from (select cluster, i, sum(x[i]) as s, count(*) as n from a{i} cross join range(1, {size + 1}) as t(i) group by cluster, i) group by cluster) m on m.cluster = c{i}.cluster)"""
            )
    return "with " + ",\n".join(steps) + f"""
select a.vec_id, a.cluster::int as cluster, a.d as distance, (sum(a.d) over (partition by a.cluster))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia,
    sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on c.cluster = a.cluster
"""


SQL = _sql()
