"""K-d tree sharding.

Each row is a point of metadata: place in the id order, size, source and language. A node splits along the dimension in
which its bytes are spread widest (greatest standard deviation), at the row where the bytes to its left reach the left
leaves' part. One round counts the bytes of every open node on coarse histograms of all dimensions, which gives the
spreads and the stretch that holds the cut; further rounds count 4096 stretches within it. So the driver sees a bounded
number of sums whatever the table's size, and the cut is exact to a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless, saved

DIMENSIONS = ("by_source", "by_lang", "by_size", "by_id")
BINS = 4096
_COARSE = 10  # bits of a key in the first histogram
_SPAN = (1 << 31) - 1


@dataclass
class Node:
    """Leaves first to first + leaves - 1, and where to cut: rows with ``key`` <= ``cut`` go left."""

    first: int
    leaves: int
    key: str = ""
    cut: int = 0
    left: "Node | None" = None
    right: "Node | None" = None


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and one sortable long for each dimension: 31 bits of its value, 32 of a hash of the id.

    The hash breaks ties, so a dimension in which a third of the rows are alike still splits anywhere.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        *[(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(f"_{c}") for c in ("source", "lang")],
    )
    span = base.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    low, width = float(span["a"] or 0), float(max(1, (span["b"] or 0) - (span["a"] or 0)))
    hashed = lambda c: F.coalesce(F.shiftrightunsigned(F.xxhash64(c), 33), F.lit(0))
    values = {
        "by_source": hashed("_source"), "by_lang": hashed("_lang"),
        "by_size": (F.log2(F.col("size").cast("double")) / 40 * _SPAN).cast("long"),
        "by_id": F.coalesce(((F.col("doc_id").cast("double") - low) / width * _SPAN).cast("long"), F.lit(0)),
    }
    tie = F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32"), 32)
    keys = [(F.least(F.greatest(v, F.lit(0)), F.lit(_SPAN)) * F.lit(1 << 32) + tie).alias(k) for k, v in values.items()]
    return base.select("doc_id", "size", "text_crc32", *keys)


def grow(table: DataFrame, leaves: int) -> Node:
    """The k-d tree of ``table`` (see ``points``) with so many leaves of nearly equal bytes."""
    root = Node(0, leaves)
    level = [root]
    while level := [n for n in level if n.leaves > 1]:
        placed = table.withColumn("_node", _node_of(root, {id(n): i for i, n in enumerate(level)}, -1)).where("_node >= 0")
        keys = F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.col(k).alias("k")) for i, k in enumerate(DIMENSIONS)])).alias("p")
        coarse = placed.select("_node", "size", keys).groupBy("_node", "p.d", F.shiftrightunsigned("p.k", 63 - _COARSE).alias("bin"))
        found: dict[int, list[list]] = {}
        for r in coarse.agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("p.k").alias("a"), F.max("p.k").alias("b")).collect():
            found.setdefault(r["_node"], [[] for _ in DIMENSIONS])[r["d"]].append((r["bin"], r["bytes"], r["n"], r["a"], r["b"]))
        goals: dict[int, tuple[float, float]] = {}
        spans: dict[int, tuple[int, int]] = {}
        for i, histograms in found.items():
            node, widest = level[i], max(range(len(DIMENSIONS)), key=lambda d: (_deviation(histograms[d]), -d))
            node.key, total = DIMENSIONS[widest], sum(h[1] for h in histograms[widest])
            goal, leaf, before = total * (node.leaves // 2) / node.leaves, total / node.leaves, 0
            for _, size, n, a, b in sorted(histograms[widest]):
                if before + size >= goal:
                    break
                before += size
            goals[i] = (goal - before, leaf)
            spans[i] = (a, b)
        for i, node in enumerate(level):
            if i not in goals:  # no rows: everything that may come goes left
                node.key, node.cut = DIMENSIONS[0], (1 << 63) - 1
        _cut(placed, level, dict(goals), spans)
        below = []
        for node in level:
            half = node.leaves // 2
            node.left, node.right = Node(node.first, half), Node(node.first + half, node.leaves - half)
            below += [node.left, node.right]
        level = below
    return root


def _deviation(histogram: list[tuple]) -> float:
    """Standard deviation of the bytes of a histogram, in bins."""
    total = sum(h[1] for h in histogram)
    mean = sum(h[0] * h[1] for h in histogram) / total
    return (sum(h[1] * (h[0] - mean) ** 2 for h in histogram) / total) ** 0.5


def _cut(placed: DataFrame, level: list[Node], goals: dict, spans: dict) -> None:
    """Set every node's cut within its span, where ``goals`` is still to come from the span's bytes; all nodes in the same rounds."""
    while spans:
        key = lo = hi = width = F.lit(None).cast("long")
        for i, (a, b) in spans.items():
            at = F.col("_node") == i
            key, lo, hi = F.when(at, F.col(level[i].key)).otherwise(key), F.when(at, F.lit(a)).otherwise(lo), F.when(at, F.lit(b)).otherwise(hi)
            width = F.when(at, F.lit((b - a) // BINS + 1)).otherwise(width)
        inside = placed.select("_node", "size", key.alias("k"), lo.alias("lo"), hi.alias("hi"), width.alias("w")).where("k between lo and hi")
        bins = inside.groupBy("_node", F.expr("(k - lo) div w").alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        sums: dict[int, list] = {}
        for r in bins.collect():
            sums.setdefault(r["_node"], []).append((r["bin"], r["bytes"], r["n"]))
        following = {}
        for i, (a, b) in spans.items():
            goal, leaf = goals[i]
            width, before = (b - a) // BINS + 1, 0
            for at, size, n in sorted(sums[i]):
                if before + size >= goal:
                    break
                before += size
            start, end = a + at * width, min(b, a + (at + 1) * width - 1)
            if n == 1 or width == 1 or size <= leaf / 10_000:
                level[i].cut = end if before + size - goal < goal - before else start - 1
            else:
                following[i], goals[i] = (start, end), (goal - before, leaf)
        spans = following


def _node_of(node: Node, numbers: dict[int, int], other: int) -> Column:
    """The number of the node of ``numbers`` in which a row lies; ``other`` where it lies in none."""
    if id(node) in numbers:
        return F.lit(numbers[id(node)])
    if node.left is None:
        return F.lit(other)
    return F.when(F.col(node.key) <= F.lit(node.cut), _node_of(node.left, numbers, other)).otherwise(_node_of(node.right, numbers, other))


def shard_of(node: Node) -> Column:
    if node.left is None:
        return F.lit(node.first)
    return F.when(F.col(node.key) <= F.lit(node.cut), shard_of(node.left)).otherwise(shard_of(node.right))


def kd_shards(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None, per_bucket: int = 50_000) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text, and source and lang if it has them) into a shard of nearly equal bytes.

    The tree has ``shards`` leaves, or with ``target_bytes`` as many as bring leaves to that size. One row per input row:
    doc_id, size (UTF-8 bytes of the text plus 1; null text: none), text_crc32, law ('bytes'), shard, slot (gapless from 0
    in each shard), grown_shard (null under this law). Rows alike in doc_id and text cannot be told apart and stay
    together; null metadata counts as one value; an empty table gives no rows; further columns are ignored.
    """
    table = saved(points(docs))
    rows, total = table.agg(F.count("*"), F.sum("size")).first()
    if target_bytes:
        shards = max(1, -(-(total or 0) // target_bytes))
    root = grow(table, shards)
    placed = table.withColumn("shard", shard_of(root).cast("int"))
    numbered = gapless(placed, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot", max(4, rows // per_bucket))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
