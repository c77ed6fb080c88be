"""Packing of token pieces into sequences of fixed capacity.

Which piece lies where depends only on how many pieces there are of each length, a table of at most ``capacity`` rows
however large the corpus is. The plan is made on that table: each line puts, in each of a run of like sequences, a number
of pieces of one length at one place. Pieces are then numbered within their length and look their line up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import gapless, map_arrow, saved, sized, small, text_table
from .tokens import Encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


@dataclass
class Run:
    """Sequences first to first + count - 1, all filled alike, with ``gap`` places free in each."""

    first: int
    count: int
    gap: int


class Plan:
    """Lines (length, rank of the first piece, pieces a sequence, first sequence, offset), and the open runs."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.lines: list[tuple[int, int, int, int, int]] = []
        self.used: dict[int, int] = {}

    def fill(self, run: Run, length: int, copies: int) -> Run:
        """Put ``copies`` pieces of ``length`` into each sequence of the run."""
        rank = self.used.get(length, 0)
        self.lines.append((length, rank, copies, run.first, self.capacity - run.gap))
        self.used[length] = rank + copies * run.count
        return Run(run.first, run.count, run.gap - copies * length)

    def open(self, count: int) -> Run:
        run = Run(self.sequences, count, self.capacity)
        self.sequences += count
        return run

    def spread(self, run: Run, length: int, count: int, most: int) -> tuple[int, list[Run]]:
        """Put up to ``count`` pieces into the run, ``most`` a sequence: (pieces left, the runs that it falls into)."""
        whole = min(run.count, count // most)
        out = []
        if whole:
            out.append(self.fill(Run(run.first, whole, run.gap), length, most))
            count -= whole * most
        rest = Run(run.first + whole, run.count - whole, run.gap)
        if rest.count and count:
            out.append(self.fill(Run(rest.first, 1, rest.gap), length, count))
            rest, count = Run(rest.first + 1, rest.count - 1, rest.gap), 0
        return count, out + [rest] * bool(rest.count)


def match_large(sizes: dict[int, int], capacity: int) -> Plan:
    """Large-item matching.

    Pieces above a third of the capacity fit at most two to a sequence, so placing them is a matching: from the longest
    down, each takes the longest large piece not yet placed that still fits beside it. Shorter pieces then go, longest
    first, each where it leaves the smallest gap; what fits nowhere opens a new sequence.
    """
    plan = Plan(capacity)
    left = {n: c for n, c in sizes.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    runs: list[Run] = []
    while large:
        longest = large[-1]
        at = bisect_left(large, capacity - longest + 1) - 1
        partner = large[at] if at >= 0 else 0
        if partner == longest:
            pairs = left[longest] // 2
            if pairs:
                runs.append(plan.fill(plan.open(pairs), longest, 2))
                left[longest] -= 2 * pairs
            else:  # one is left of this length: with the next shorter, if any
                at -= 1
                partner = large[at] if at >= 0 else 0
                run = plan.fill(plan.open(1), longest, 1)
                left[longest] = 0
                if partner:
                    run = plan.fill(run, partner, 1)
                    left[partner] -= 1
                runs.append(run)
        else:
            n = min(left[longest], left[partner]) if partner else left[longest]
            run = plan.fill(plan.open(n), longest, 1)
            left[longest] -= n
            if partner:
                run = plan.fill(run, partner, 1)
                left[partner] -= n
            runs.append(run)
        large = [n for n in large if left[n]]
    _best_fit(plan, runs, {n: c for n, c in left.items() if c and 3 * n <= capacity})
    return plan


def _best_fit(plan: Plan, runs: list[Run], sizes: dict[int, int]) -> None:
    """Place all pieces, longest first, each in an open sequence with the smallest gap that holds it."""
    by_gap: dict[int, list[Run]] = {}
    gaps: list[int] = []

    def keep(run: Run) -> None:
        if run.gap:
            if run.gap not in by_gap:
                by_gap[run.gap] = []
                insort(gaps, run.gap)
            by_gap[run.gap].append(run)

    for run in runs:
        keep(run)
    for length in sorted(sizes, reverse=True):
        count = sizes[length]
        while count:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                fit = plan.capacity // length
                keep(plan.open(-(-count // fit)))
                continue
            gap = gaps[at]
            run = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(at)
            count, parts = plan.spread(run, length, count, gap // length)
            for part in parts:
                keep(part)


class CapacityTree:
    """Segment tree over gaps 0 to capacity: a node tells whether an open run has a gap below it."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.held = [0] * (2 * self.size)

    def add(self, gap: int, by: int) -> None:
        node = gap + self.size
        while node:
            self.held[node] += by
            node >>= 1

    def least(self, length: int) -> int | None:
        """The smallest gap of at least ``length`` that an open run has."""
        node = length + self.size
        if self.held[node]:
            return length
        while node > 1:
            if not node & 1 and self.held[node + 1]:  # a right sibling holds larger gaps only
                node += 1
                while node < self.size:
                    node = 2 * node if self.held[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def best_fit_decreasing(sizes: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over all lengths; a segment tree over the gaps finds the tightest open sequence."""
    plan, tree = Plan(capacity), CapacityTree(capacity)
    by_gap: dict[int, list[Run]] = {}
    for length in sorted(sizes, reverse=True):
        count = sizes[length]
        while count:
            gap = tree.least(length)
            if gap is None:
                run = plan.open(-(-count // (capacity // length)))
            else:
                run = by_gap[gap].pop()
                tree.add(gap, -1)
            count, parts = plan.spread(run, length, count, run.gap // length)
            for part in parts:
                if part.gap:
                    by_gap.setdefault(part.gap, []).append(part)
                    tree.add(part.gap, 1)
    return plan


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """The documents' ids, each document ended by ``end_id``, in pieces of ``capacity``; only longer ones are cut.

    Rows: doc_id, piece, start, length, ids_crc32, row (a number of its own once the table is written), and with ``with_ids`` the ids themselves, as little-endian unsigned
    16-bit (vocabularies of up to 65,536) or 32-bit bytes in ``ids``.
    """

    def batch_rows(batch: pa.RecordBatch, first: int) -> pa.RecordBatch:
        encoder, out = Encoder.of(tokenizer), []
        short = with_ids and encoder.full.get_vocab_size() <= 1 << 16
        for doc_id, found in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(batch.column("text"))):
            raw = np.append(found, np.uint32(end_id))
            kept = raw.astype("<u2") if short else raw
            for i in range(0, len(raw), capacity):
                part = raw[i : i + capacity]
                out.append((doc_id, i // capacity, i, len(part), zlib.crc32(part), kept[i : i + capacity].tobytes() if with_ids else None))
        doc_ids, piece, start, length, crc, ids = (list(x) for x in zip(*out))
        arrays = [pa.array(doc_ids, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        arrays.append(pa.array(range(first, first + len(out)), pa.int64()))
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
        if with_ids:
            arrays.append(pa.array(ids, pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in sized(small(batches, 4096, keep=True), "text", 8 << 20):
            out = batch_rows(batch, row)
            row += out.num_rows
            yield out

    return text_table(docs).mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def place(pieces: DataFrame, capacity: int, method=match_large, per_bucket: int = 50_000) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` must be a written table, as it is read three times.

    The driver sees one row for each length there is, ``capacity`` at most; the plan it sends out has a line for each
    length in each run of like sequences, which the lengths bound too.
    """
    sizes = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = method(sizes, capacity)
    lines = np.array(sorted(plan.lines), np.int64).reshape(-1, 5)
    keys = lines[:, 0] << 44 | lines[:, 1]  # a rank is below 2^44
    shared = pieces.sparkSession.sparkContext.broadcast((keys, lines))
    columns = [*pieces.columns, "sequence_id", "offset"]
    types = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, lines = shared.value
        length, rank = (batch.column(n).to_numpy() for n in ("length", "_rank"))
        _, first, copies, sequence, offset = lines[np.searchsorted(keys, length << 44 | rank, "right") - 1].T
        nth = rank - first
        found = [pa.array(sequence + nth // copies), pa.array(offset + nth % copies * length)]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in columns[:-2]), *found], columns)

    buckets = max(8, sum(sizes.values()) // per_bucket)
    return map_arrow(gapless(pieces, ["length"], [F.col("row")], "_rank", buckets), run, types)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack all rows of ``docs`` (doc_id, text) into as few sequences of ``capacity`` tokens as large-item matching can.

    One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is its end id
    alone; repeated rows and rows without doc_id are packed like any other; an empty table gives no rows; further columns
    are ignored.
    """
    return place(saved(token_pieces(docs, tokenizer, capacity, end_id)), capacity).drop("row")


def packed_matrices(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, pad_id: int = 0) -> DataFrame:
    """Rows of the packed id matrix, by best-fit decreasing; overlong documents are split without loss.

    One row a sequence: sequence_id, n_tokens, ids (``capacity`` little-endian unsigned 16- or 32-bit ids, padded with
    ``pad_id``), cu_seqlens (cumulative segment lengths, from 0 to n_tokens), position_ids (unsigned 16-bit or 32-bit,
    from 0 in each segment, 0 in the padding), and for each segment its document in doc_ids, its place in the document
    in starts. Null and empty texts are a segment of one id; an empty table gives no rows; extra columns are ignored.
    """
    pieces = saved(token_pieces(docs, tokenizer, capacity, end_id, with_ids=True))
    spots = place(pieces.drop("ids"), capacity, best_fit_decreasing)
    numbered = spots.select(F.col("row").alias("_row"), "sequence_id", "offset")
    loaded = pieces.select("row", "doc_id", "start", "length", "ids").join(numbered, F.col("row") == F.col("_row"))
    parts = loaded.select("sequence_id", F.struct("offset", "length", "doc_id", "start", "ids").alias("part"))
    rows = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))

    kind = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        where = "<u2" if capacity <= 1 << 16 else "<u4"
        out = []
        for sequence, parts in zip(batch.column("sequence_id").to_pylist(), batch.column("parts").to_pylist()):
            raw = b"".join(p["ids"] for p in parts)
            n = len(raw) // np.dtype(kind).itemsize
            ids = np.full(capacity, pad_id, kind)
            ids[:n] = np.frombuffer(raw, kind)
            position = np.zeros(capacity, where)
            for p in parts:
                position[p["offset"] : p["offset"] + p["length"]] = np.arange(p["length"])
            out.append((sequence, n, ids.tobytes(), [p["offset"] for p in parts] + [n], position.tobytes(), [p["doc_id"] for p in parts], [p["start"] for p in parts]))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out), kinds)], MATRIX_NAMES)

    return map_arrow(rows, run, MATRIX)


MATRIX = "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>"
MATRIX_NAMES = ["sequence_id", "n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "starts"]


def write_matrices(matrices: DataFrame, path: str, capacity: int, pad_id: int = 0, rows_per_file: int = 16_384) -> None:
    """Write the rows of ``packed_matrices`` below ``path`` as files that a training loader maps to arrays.

    ``path``/rows holds Parquet files in the order of sequence_id, of at most ``rows_per_file`` rows, ids and position_ids
    as binaries of one fixed size; ``path``/meta one JSON record: sequences, tokens, capacity, pad_id, bytes an id and a
    position. Files are written by Spark where the rows are; a rerun overwrites.
    """
    rows = matrices.repartitionByRange(F.col("sequence_id")).sortWithinPartitions("sequence_id")
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(f"{path}/rows")
    kept = matrices.sparkSession.read.schema(MATRIX).parquet(f"{path}/rows")
    meta = kept.agg(
        F.count("*").alias("sequences"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("tokens"), F.lit(capacity).alias("capacity"), F.lit(pad_id).alias("pad_id"),
        (F.max(F.octet_length("ids")) / capacity).cast("int").alias("id_bytes"), (F.max(F.octet_length("position_ids")) / capacity).cast("int").alias("position_bytes"),
    )
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``write_matrices`` wrote."""
    return spark.read.schema(MATRIX).parquet(f"{path}/rows")


def as_arrays(batch: pa.RecordBatch, capacity: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(ids, position_ids, cu_seqlens) of a batch of matrix rows: two matrices of ``capacity`` columns, and a vector for each row."""

    def matrix(name: str) -> np.ndarray:
        values = batch.column(name).to_pylist()
        width = len(values[0]) // capacity if values else 2
        return np.frombuffer(b"".join(values), f"<u{width}").reshape(len(values), capacity)

    return matrix("ids"), matrix("position_ids"), [np.array(x, np.int32) for x in batch.column("cu_seqlens").to_pylist()]
