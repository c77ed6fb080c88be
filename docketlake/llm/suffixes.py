"""Repeated 200-byte strings by a logarithmic family of sparse suffix arrays.

Every ``length``-byte string has an anchor: the place of the least hash of the ``gram``-byte strings inside it, leftmost
among equals. Equal strings have their anchors in the same place, so only suffixes that start at anchors (about one byte
in seventy) need sorting. An entry of the index is such a suffix with its stretch, the run of strings that share the
anchor: ``head`` is the suffix's first bytes, by which the arrays are sorted, ``key`` the hash of its gram, and ``c1``,
``c2`` the 128-bit digest of all bytes that the stretch covers.

A new batch is put in the order of its suffixes, in ranges of heads, and merge-scanned with the levels of the family in
that order: neighbours with the same digest are stretches that are repeated whole. Neighbours with one gram and different
digests are partial matches, at the edge of what two places share; their strings are compared one by one. Levels of the
batch's size merge with it in that very scan and are written as one; larger levels are read and stay as they are.

Entries are only made for anchors that a count-min sketch estimates repeated, and at most two a task for equal stretches
(what is repeated inside a task is known there), so a passage that a third of all texts share stays a few rows a task.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, saved, small, text_table
from .substring import _BASES, STRETCH, Rolling, _cells, _repeated, add_cells, least_of, mixed

_U = np.uint64
_PLACE_BITS = 22
PART_BYTES = 1_500_000
#: A 64-bit value for each byte.
_VALUES = mixed(np.arange(1, 257, dtype=_U) * _U(_BASES[0]))


@dataclass
class Stretches:
    """Runs of strings with one anchor: batch row, first start in the row's text, how many, anchor's offset from the first."""

    rows: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    offset: np.ndarray
    at: np.ndarray  # first start in the part
    key: np.ndarray
    raw: bytes
    length: int

    def take(self, which: np.ndarray) -> "Stretches":
        return Stretches(*(x[which] for x in (self.rows, self.lo, self.n, self.offset, self.at, self.key)), self.raw, self.length)

    def heads(self, size: int) -> list[bytes]:
        """The first bytes of each anchor's suffix."""
        starts = self.at + self.offset
        return [self.raw[i : i + size] for i in starts.tolist()]

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """128-bit digests of the bytes that each stretch covers; how many there are tells how many strings."""
        return _digests(self.raw, self.at, self.at + self.n + self.length - 1)

    def strings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digest, second half, batch row, start) of every single string."""
        nth = np.arange(self.n.sum()) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        at = np.repeat(self.at, self.n) + nth
        return *_digests(self.raw, at, at + self.length), np.repeat(self.rows, self.n), np.repeat(self.lo, self.n) + nth


def _digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]), _U).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def stretches(texts: list[str | None], length: int, gram: int) -> Iterator[Stretches]:
    """The stretches of a batch, in parts of about ``PART_BYTES``; texts of fewer than ``length`` bytes have none."""
    held, size = [], 0
    for row, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8) if text else b""
        if len(raw) < length:
            continue
        for first in range(0, len(raw) - length + 1, PART_BYTES):  # pieces overlap by a string less one byte
            piece = raw[first : first + PART_BYTES + length - 1]
            held.append((row, first, piece))
            size += len(piece)
            if size >= PART_BYTES:
                yield _part(held, length, gram)
                held, size = [], 0
    if held:
        yield _part(held, length, gram)


def _part(held: list[tuple[int, int, np.ndarray]], length: int, gram: int) -> Stretches:
    sizes = np.array([len(p) for _, _, p in held])
    starts = np.cumsum(sizes) - sizes
    line = np.concatenate([p for _, _, p in held])
    values = _VALUES[line]
    grams = mixed(Rolling(values, _BASES[0]).runs(gram))
    low = _U((1 << _PLACE_BITS) - 1)
    least = least_of((grams & ~low) | np.arange(len(grams), dtype=_U), length - gram + 1)
    anchor = (least & low).astype(np.int64)
    piece = np.repeat(np.arange(len(held)), sizes)[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= (starts + sizes)[piece]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]) | (inside[1:] != inside[:-1])))
    at = np.nonzero(new)[0]
    n = np.diff(np.append(at, len(anchor)))
    at, n = at[inside[at]], n[inside[at]]
    own = piece[at]
    rows, firsts = (np.array([h[i] for h in held], np.int64) for i in (0, 1))
    return Stretches(rows[own], at - starts[own] + firsts[own], n, anchor[at] - at, at, grams[anchor[at]], line.tobytes(), length)


def _uppers(texts: list[str | None], rows: np.ndarray) -> np.ndarray:
    """31 bits of the hash of each used row's text, above 32 free bits; they tell texts of one doc_id apart."""
    out = np.zeros(len(texts), np.int64)
    used = np.unique(rows)
    out[used] = [xxhash.xxh64_intdigest(texts[i].encode(), 42) >> 33 << 32 for i in used.tolist()]
    return out


def _known(part_rows: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(batch rows, runs): starts that are repeated for sure, as pairs of first start and count."""
    order = np.lexsort((lo, part_rows))
    rows = part_rows[order]
    pairs = np.stack((lo[order], n[order]), 1).astype("<i4")
    cuts = np.nonzero(np.diff(rows))[0] + 1
    return rows[np.concatenate(([0], cuts))], [x.tobytes() for x in np.split(pairs, cuts)]


def _twins(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (a, b): whether each is the first of its equals, and how many equals it has."""
    order = np.lexsort((b, a))
    head = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
    group = np.cumsum(head) - 1
    count = np.bincount(group)[group]
    first, n = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
    first[order], n[order] = head, count
    return first, n


ENTRY = "head binary, key long, c1 long, c2 long, doc_id long, spot long, n int, seen boolean, runs binary"
_ENTRY_NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def _rows(parts: list[tuple]) -> pa.RecordBatch | None:
    if not parts:
        return None
    whole = [pa.array(np.concatenate([p[i] for p in parts])) for i in range(1, 8)]
    heads, runs = (pa.array([x for p in parts for x in p[i]], pa.binary()) for i in (0, 8))
    return pa.RecordBatch.from_arrays([heads, *whole[:5], whole[5].cast(pa.int32()), whole[6], runs], _ENTRY_NAMES)


class _Met:
    """How often a task has met stretches, in a table of fixed size; a later stretch takes an earlier one's slot."""

    def __init__(self, slots: int = 1 << 18) -> None:
        self.c1, self.c2, self.n = np.zeros(slots, _U), np.zeros(slots, _U), np.zeros(slots, np.uint8)

    def times(self, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        """How often each of these different stretches came before, two at most; counts them as met."""
        slot = (c1 & _U(len(self.n) - 1)).astype(np.int64)
        n = np.where((self.c1[slot] == c1) & (self.c2[slot] == c2), self.n[slot], 0)
        self.c1[slot], self.c2[slot], self.n[slot] = c1, c2, np.minimum(n + 1, 2)
        return n


def _emit(out: list, met: _Met, heads, key: np.ndarray, c1: np.ndarray, c2: np.ndarray, rows: np.ndarray, lo: np.ndarray, n: np.ndarray, ids: np.ndarray, upper: np.ndarray) -> None:
    """Rows for the first of equals (the first two times that the task meets them), and known runs for all that have equals.

    The second row tells the first one, if nothing else does, that it is not alone.
    """
    first, equals = _twins(c1, c2)
    at = np.nonzero(first)[0]
    before = met.times(c1[at], c2[at])
    came = np.zeros(len(c1), np.uint8)
    came[at] = before
    order = np.lexsort((~first, c2, c1))  # equals stand together, the first of them first
    came[order] = came[order][np.maximum.accumulate(np.where(first[order], np.arange(len(order)), 0))]
    twice = (equals > 1) | (came > 0)
    own = at[before < 2]
    out.append((heads(own), key[own].view(np.int64), c1[own].view(np.int64), c2[own].view(np.int64), ids[rows[own]], upper[rows[own]] | lo[own], n[own], twice[own], [None] * len(own)))
    if twice.any():
        owners, runs = _known(rows[twice], lo[twice], n[twice])
        none, count = np.zeros(len(owners), np.int64), len(owners)
        out.append(([None] * count, none, none, none, ids[owners], upper[owners], none, np.zeros(count, bool), runs))


def sketch(docs: DataFrame, length: int, gram: int, depth: int, width: int) -> np.ndarray:
    """One bit a cell: whether two or more stretches may have an anchor of that cell."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        stretch, cells = [], []
        for part in stretches(batch.column("text").to_pylist(), length, gram):
            cell, n = np.unique(_cells(part.key, depth, width), return_counts=True)
            cell = np.repeat(cell, np.minimum(n, 2)).astype(np.int64)
            for piece in np.split(cell, np.nonzero(np.diff(cell // STRETCH))[0] + 1):
                if len(piece):
                    stretch.append(int(piece[0] // STRETCH))
                    cells.append((piece % STRETCH).astype("<u4").tobytes())
        if not stretch:
            return None
        return pa.RecordBatch.from_arrays([pa.array(stretch, pa.int32()), pa.array(cells, pa.binary())], ["stretch", "cells"])

    return add_cells(map_arrow(docs.select("text"), count, "stretch int, cells binary"), depth, width, 2)


def _texts_and_ids(batch: pa.RecordBatch) -> tuple[list[str | None], np.ndarray]:
    return batch.column("text").to_pylist(), batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)


def entries(docs: DataFrame, bits: np.ndarray, length: int, gram: int, depth: int, width: int, head: int) -> DataFrame:
    """Index entries of anchors estimated repeated, and runs of what is known to be repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met()
        for batch in small(batches):
            texts, ids = _texts_and_ids(batch)
            out: list[tuple] = []
            for part in stretches(texts, length, gram):
                part = part.take(np.nonzero(_repeated(shared.value, part.key, depth, width))[0])
                if len(part.rows):
                    _emit(out, met, lambda own, p=part: p.take(own).heads(head), part.key, *part.contexts(), part.rows, part.lo, part.n, ids, _uppers(texts, part.rows))
            if (made := _rows(out)) is not None:
                yield made

    return docs.mapInArrow(run, ENTRY)


CONTEXT = "key long, c1 long, c2 long, doc_id long, spot long, n int, seen boolean, text binary"


def partial_contexts(docs: DataFrame, bits: np.ndarray, length: int, gram: int, depth: int, width: int) -> DataFrame:
    """The stretches whose key is in ``bits``, with their bytes; at most two a task of each context."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met()
        for batch in small(batches):
            texts, ids = _texts_and_ids(batch)
            for part in stretches(texts, length, gram):
                part = part.take(np.nonzero(_repeated(shared.value, part.key, depth, width))[0])
                if not len(part.rows):
                    continue
                c1, c2 = part.contexts()
                first, equals = _twins(c1, c2)
                at = np.nonzero(first)[0]
                before = met.times(c1[at], c2[at])
                at, before = at[before < 2], before[before < 2]
                if not len(at):
                    continue
                own, upper = part.take(at), _uppers(texts, part.rows)
                cut = [own.raw[a : a + n + length - 1] for a, n in zip(own.at.tolist(), own.n.tolist())]
                columns = (own.key.view(np.int64), c1[at].view(np.int64), c2[at].view(np.int64), ids[own.rows], upper[own.rows] | own.lo, own.n.astype(np.int32), (equals[at] > 1) | (before > 0), pa.array(cut, pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in CONTEXT.split(", ")])

    return docs.mapInArrow(run, CONTEXT)


def compare_contexts(contexts: DataFrame, length: int) -> DataFrame:
    """(doc_id, own, runs): repeated starts of contexts that occur once, among the few contexts of their key."""
    one = contexts.repartition("key").groupBy("key", "c1", "c2").agg(F.count("*").alias("c"), F.max("seen").alias("seen"), F.min_by(F.struct("doc_id", "spot", "n", "text"), F.struct("doc_id", "spot")).alias("r"))
    lists = one.groupBy("key").agg(F.collect_list(F.struct((F.col("seen") | (F.col("c") > 1)).alias("known"), "r.*")).alias("l")).where(F.size("l") > 1).select("l")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, owns, runs = [], [], []
        for contexts in batch.column("l").to_pylist():
            strings = [[c["text"][t : t + length] for t in range(c["n"])] for c in contexts]
            seen = Counter(x for own in strings for x in own)
            for c, own in zip(contexts, strings):
                if not c["known"] and (hits := [t for t, x in enumerate(own) if seen[x] > 1]):
                    ids.append(c["doc_id"])
                    owns.append(c["spot"] >> 32)
                    starts = np.array(hits) + (c["spot"] & ((1 << 31) - 1))
                    runs.append(np.stack((starts, np.ones(len(starts), np.int64)), 1).astype("<i4").tobytes())
        if not ids:
            return None
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(owns, pa.int64()), pa.array(runs, pa.binary())], ["doc_id", "own", "runs"])

    return map_arrow(lists, run, "doc_id long, own long, runs binary")


def partial_strings(docs: DataFrame, bits: np.ndarray, length: int, gram: int, depth: int, width: int) -> DataFrame:
    """Single strings (c1, c2: their digest) of the stretches whose key is in ``bits``, one stretch of each context a part."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met()
        for batch in small(batches):
            texts, ids = _texts_and_ids(batch)
            out: list[tuple] = []
            for part in stretches(texts, length, gram):
                part = part.take(np.nonzero(_repeated(shared.value, part.key, depth, width))[0])
                if len(part.rows):
                    part = part.take(np.nonzero(_twins(*part.contexts())[0])[0])
                    c1, c2, rows, at = part.strings()
                    _emit(out, met, lambda own: [None] * len(own), c1, c1, c2, rows, at, np.ones(len(at), np.int64), ids, _uppers(texts, part.rows))
            if (made := _rows(out)) is not None:
                yield made

    return docs.mapInArrow(run, ENTRY)


SUFFIX = ("head", "key", "c1", "c2")


@dataclass
class IndexFamily:
    """Levels of entries in the order of their suffixes, each level twice the batches of the next; an entry's context is in one level only."""

    levels: list[tuple[int, DataFrame]] = field(default_factory=list)

    def add(self, batch: DataFrame) -> DataFrame:
        """Insert a batch; returns the entries that it shows repeated, old and new.

        The batch and all levels are brought together by ranges of heads and scanned in suffix order. Levels of the
        batch's size, one after another, are merged with it: the scan writes what is new in them as one level. Larger
        levels are only scanned.
        """
        size, merged = 1, [batch]
        while self.levels and self.levels[-1][0] == size:
            merged.append(self.levels.pop()[1])
            size *= 2
        union = _union([t.withColumn("old", F.lit(False)) for t in merged] + [t.withColumn("old", F.lit(True)) for _, t in self.levels])
        same = Window.partitionBy(*SUFFIX)
        scan = union.repartitionByRange("head").withColumn("more", F.count("*").over(same) > 1)
        scan = scan.withColumn("keeps", ~F.col("old") & (F.row_number().over(same.orderBy(F.desc("old"), "doc_id", "spot")) == 1))
        scan = saved(scan.withColumn("seen", F.col("seen") | F.col("more")).where("keeps or seen").drop("old", "more"))
        self.levels.append((size, scan.where("keeps").drop("keeps")))
        return scan.where("seen").select("doc_id", "spot", "n")

    def partial(self) -> DataFrame:
        """(key, n): grams with more than one context, and how many."""
        return _union([t for _, t in self.levels]).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def key_bits(keys: DataFrame, depth: int, width: int) -> np.ndarray:
    """The cells of all ``keys`` (column key)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell = np.unique(_cells(batch.column("key").to_numpy().view(_U), depth, width)).astype(np.int64)
        pieces = np.split(cell, np.nonzero(np.diff(cell // STRETCH))[0] + 1)
        return pa.RecordBatch.from_arrays([pa.array([int(p[0] // STRETCH) for p in pieces], pa.int32()), pa.array([(p % STRETCH).astype("<u4").tobytes() for p in pieces], pa.binary())], ["stretch", "cells"])

    return add_cells(map_arrow(keys, run, "stretch int, cells binary"), depth, width, 1)


def repeated_bytes(docs: DataFrame, length: int = 200, gram: int = 64, batches: int = 4, depth: int = 2, sketch_bytes: int = 128 << 20, few: int = 64, head: int = 32) -> DataFrame:
    """Remove the bytes covered by a ``length``-byte string that also starts anywhere else, in the same text or another.

    One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.
    Null and empty texts have no bytes; strings never cross texts; repeated rows, and rows without doc_id, are texts of
    their own, so copies remove each other whole (from ``length`` bytes on); an empty table gives no rows; further columns
    are ignored. The table enters the index family in ``batches`` parts by a hash of doc_id. ``sketch_bytes`` bounds the
    sketches sent to every executor: beyond, they let more through to the exact steps, which stay right. Keys of up to
    ``few`` contexts bring their bytes together; fuller ones are resolved string by string across tasks.
    ``head`` bytes of each suffix are sorted by; the rest of it counts by its digest.
    """
    table = text_table(docs)
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = STRETCH
    while width < size // 16 and 2 * depth * width // 8 <= sketch_bytes:
        width *= 2
    bits = sketch(table, length, gram, depth, width)
    made = saved(entries(table, bits, length, gram, depth, width, head))
    family, found = IndexFamily(), []
    suffixes = made.where("runs is null").drop("runs")
    for i in range(batches):
        found.append(family.add(suffixes.where(F.pmod(F.xxhash64("doc_id", F.shiftright("spot", 32)), F.lit(batches)) == i)))
    partial = saved(family.partial())
    known = [made.where("runs is not null").select("doc_id", "spot", "runs")]
    edges = []
    few_keys, many_keys = partial.where(F.col("n") <= few).select("key"), partial.where(F.col("n") > few).select("key")
    if not few_keys.isEmpty():
        edges.append(compare_contexts(partial_contexts(table, key_bits(few_keys, depth, width), length, gram, depth, width), length))
    if not many_keys.isEmpty():
        edge = saved(partial_strings(table, key_bits(many_keys, depth, width), length, gram, depth, width))
        known.append(edge.where("runs is not null").select("doc_id", "spot", "runs"))
        single = edge.where("runs is null")
        more = F.count("*").over(Window.partitionBy("c1", "c2")) > 1
        found.append(single.select("doc_id", "spot", "n", more.alias("more")).where("more").drop("more"))
    starts = _union(found).select(
        "doc_id", F.shiftright("spot", 32).alias("own"), (F.col("spot").bitwiseAND(F.lit((1 << 31) - 1)) * F.lit(1 << 31) + F.col("n")).alias("start"), F.lit(None).cast("binary").alias("runs")
    )
    runs = _union(known).select("doc_id", F.shiftright("spot", 32).alias("own"), "runs")
    runs = _union([runs, *edges]).select("doc_id", "own", F.lit(None).cast("long").alias("start"), "runs")
    marks = starts.unionByName(runs).groupBy("doc_id", "own").agg(F.collect_set("start").alias("_starts"), F.collect_set("runs").alias("_runs"))
    marks = marks.select(F.col("doc_id").alias("_doc"), F.col("own").alias("_own"), "_starts", "_runs")
    on = (F.coalesce("doc_id", F.lit(-1)) == F.col("_doc")) & (F.shiftrightunsigned(F.xxhash64("text"), 33) == F.col("_own"))
    joined = table.join(marks, on, "left").select("doc_id", "text", "_starts", "_runs")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, text, starts, runs in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "_starts", "_runs"))):
            raw = text.encode() if text else b""
            gone = _gone(len(raw), starts, runs, length)
            spans = int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1))
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw
            out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _gone(size: int, starts: list[int] | None, runs: list[bytes] | None, length: int) -> np.ndarray:
    edges = np.zeros(size + 1, np.int32)
    one = np.array(starts or [], np.int64)
    pairs = [np.stack((one >> 31, one & ((1 << 31) - 1)), 1), *(np.frombuffer(r, "<i4").reshape(-1, 2).astype(np.int64) for r in runs or [])]
    for p in pairs:
        np.add.at(edges, p[:, 0], 1)
        np.add.at(edges, p[:, 0] + p[:, 1] - 1 + length, -1)
    return np.cumsum(edges[:-1]) > 0


SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, j, substr(h, 2 * j + 1, 1198) as q from (select doc_id, h, unnest(range(0, length(h) // 2 - 199, 400)) as j from d where length(h) >= 400)),
w as (select doc_id, j + i as i, md5(substr(q, 2 * i + 1, 400)) as m from (select doc_id, j, q, unnest(range(length(q) // 2 - 199)) as i from p)),
dup as (select doc_id, i from (select doc_id, i, count(*) over (partition by m) as c from w) where c > 1),
cut as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end as s from dup),
spans as (select doc_id, min(i) as a, max(i) + 200 as b from (select doc_id, i, sum(s) over (partition by doc_id order by i) as g from cut) group by doc_id, g),
total as (select d.doc_id, length(h) // 2 as n, coalesce(sum(b - a), 0) as gone, count(a) as k, coalesce(max(b), 0) as e from d left join spans on d.doc_id = spans.doc_id group by d.doc_id, h),
pieces as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as f, a as t from spans union all select doc_id, e, n from total),
kept as (select pieces.doc_id, string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' order by f) as x from pieces join d on d.doc_id = pieces.doc_id group by pieces.doc_id)
select total.doc_id, cast(n as bigint) as n_bytes, cast(gone as bigint) as n_removed, cast(k as bigint) as n_spans, sha256(unhex(coalesce(x, ''))) as kept_sha256 from total join kept on total.doc_id = kept.doc_id
"""
