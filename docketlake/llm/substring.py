"""Substring dedup of word windows behind a count-min prefilter.

Every window of ``window`` words has an anchor: the least hash of the ``gram``-word strings inside it. The first pass
counts, for each anchor, the documents that have it, in a count-min sketch: tasks send the cells they touched, cells are
added up by stretches of the sketch, and what comes back is one bit a cell, set where the count is two or more. A window
cannot be in more documents than its anchor, so the estimate never falls short. The second pass takes only windows whose
anchor is estimated repeated, with 128-bit digests of all their words, and groups equal digests exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, small, text_table

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_U = np.uint64
STRETCH = 1 << 20  # sketch cells that are added up together
PART_WORDS = 300_000


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Digests modulo 2^64 of all runs of consecutive values, by prefix sums; ``base`` is odd and so has an inverse."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        self.sums = np.concatenate((np.zeros(1, _U), np.cumsum(values * powers(base, len(values)), dtype=_U)))
        self.back = powers(pow(base, -1, 1 << 64), len(values) + 1)

    def runs(self, length: int) -> np.ndarray:
        """Digest of the run of ``length`` values from every place where one fits."""
        n = max(0, len(self.sums) - length)
        return (self.sums[length:] - self.sums[:n]) * self.back[:n]

    def at(self, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return (self.sums[starts + length] - self.sums[starts]) * self.back[starts]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


@dataclass
class Part:
    """Some documents' words end to end: which windows lie inside one document, and their anchors."""

    rows: np.ndarray  # number of the batch row of each valid window
    place: np.ndarray  # word number, in its document, where it starts
    at: np.ndarray  # word number in the part
    anchor: np.ndarray
    raw: bytes  # all words, joined by one space
    starts: np.ndarray  # where each word of the part starts in ``raw``, and one past its end

    def digests(self, which: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """128-bit digests of the windows' words."""
        at, raw, digest = self.at[which], self.raw, xxhash.xxh3_128_digest
        spans = zip(self.starts[at].tolist(), (self.starts[at + window] - 1).tolist())
        both = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in spans]), _U).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()


def parts(texts: list[str | None], window: int, gram: int) -> Iterator[Part]:
    """The batch in parts of about 300,000 words; documents of fewer words than a window have none."""
    held, size = [], 0
    for row, text in enumerate(texts):
        words = text.encode().split() if text else []
        if len(words) >= window:
            held.append((row, words))
            size += len(words)
            if size >= PART_WORDS:
                yield _part(held, size, window, gram)
                held, size = [], 0
    if held:
        yield _part(held, size, window, gram)


def _part(held: list[tuple[int, list[bytes]]], size: int, window: int, gram: int) -> Part:
    sizes = np.array([len(w) for _, w in held])
    words = [x for _, w in held for x in w]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, size)
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, size) + 1)))
    anchor = least_of(mixed(Rolling(hashes, _BASES[0]).runs(gram)), window - gram + 1)
    rows = np.repeat([r for r, _ in held], sizes)[: len(anchor)]
    place = (np.arange(size) - np.repeat(np.cumsum(sizes) - sizes, sizes))[: len(anchor)]
    inside = np.nonzero(place + window <= np.repeat(sizes, sizes)[: len(anchor)])[0]
    return Part(rows[inside], place[inside], inside, anchor[inside], b" ".join(words), starts)


def _cells(anchors: np.ndarray, depth: int, width: int) -> np.ndarray:
    """Row by row of the sketch, the cell of each anchor; ``width`` is a power of two."""
    return np.stack([(mixed(anchors + _U((2 * r + 1) * _BASES[1] % (1 << 64))) & _U(width - 1)) + _U(r * width) for r in range(depth)])


def sketch(docs: DataFrame, window: int, gram: int, depth: int, width: int) -> np.ndarray:
    """One bit a cell, packed: whether two or more documents may have an anchor of that cell."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        stretch, cells = [], []
        for part in parts(batch.column("text").to_pylist(), window, gram):
            new = np.concatenate(([True], (part.anchor[1:] != part.anchor[:-1]) | (part.rows[1:] != part.rows[:-1])))
            anchor, rows = part.anchor[new], part.rows[new]
            order = np.lexsort((rows, anchor))
            anchor, rows = anchor[order], rows[order]
            own = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])))  # once a document
            cell, n = np.unique(_cells(anchor[own], depth, width), return_counts=True)
            cell = np.repeat(cell, np.minimum(n, 2)).astype(np.int64)
            cuts = np.nonzero(np.diff(cell // STRETCH))[0] + 1
            for piece in np.split(cell, cuts):
                stretch.append(int(piece[0] // STRETCH))
                cells.append((piece % STRETCH).astype("<u4").tobytes())
        if not stretch:
            return None
        return pa.RecordBatch.from_arrays([pa.array(stretch, pa.int32()), pa.array(cells, pa.binary())], ["stretch", "cells"])

    return add_cells(map_arrow(docs.select("text"), count, "stretch int, cells binary"), depth, width, 2)


def add_cells(touched: DataFrame, depth: int, width: int, least: int) -> np.ndarray:
    """Add up the tasks' cells stretch by stretch: one bit a cell, packed, set where it was touched ``least`` times."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for stretch, cells in zip(batch.column("stretch").to_pylist(), batch.column("cells").to_pylist()):
                own = sums.setdefault(stretch, np.zeros(STRETCH, np.uint8))
                at = np.frombuffer(cells, "<u4")
                np.add.at(own, at, 1)
                own[at] = np.minimum(own[at], 2)
        if sums:
            bits = [np.packbits(x >= least, bitorder="little").tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], ["stretch", "bits"])

    tasks = max(1, min(depth * width // STRETCH, 512))
    out = np.zeros(depth * width // 8, np.uint8)
    for r in touched.repartition(tasks, "stretch").mapInArrow(add, "stretch int, bits binary").toLocalIterator():
        out[r["stretch"] * (STRETCH // 8) : (r["stretch"] + 1) * (STRETCH // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _repeated(bits: np.ndarray, anchors: np.ndarray, depth: int, width: int) -> np.ndarray:
    cells = _cells(anchors, depth, width)
    return np.all(bits[(cells >> _U(3)).astype(np.int64)] >> (cells & _U(7)).astype(np.uint8) & 1, axis=0)


def sketch_width(text_bytes: int, depth: int, limit: int) -> int:
    """Cells a row for so much text: about four an anchor (a word in sixteen starts one), ``limit`` bytes in all at most."""
    width = STRETCH
    while width < text_bytes // 24 and 2 * depth * width // 8 <= limit:
        width *= 2
    return width


SPOTS = "w1 long, w2 long, doc_id long, spot long, runs binary"


class _Seen:
    """The smallest doc_id of windows that a task has met, in a table of fixed size; a later window takes an earlier one's slot."""

    def __init__(self, slots: int = 1 << 18) -> None:
        self.w1, self.w2, self.doc = np.zeros(slots, _U), np.zeros(slots, _U), np.zeros(slots, np.int64)

    def least(self, w1: np.ndarray, w2: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The smallest doc_id known of each of these different windows, ``doc`` included."""
        slot = (w1 & _U(len(self.doc) - 1)).astype(np.int64)
        known = (self.w1[slot] == w1) & (self.w2[slot] == w2)
        doc = np.where(known, np.minimum(doc, self.doc[slot]), doc)
        self.w1[slot], self.w2[slot], self.doc[slot] = w1, w2, doc
        return doc


def candidates(docs: DataFrame, bits: np.ndarray, window: int, gram: int, depth: int, width: int) -> DataFrame:
    """Windows estimated repeated.

    Of equal windows that a task meets only those of the smallest doc_id so far go on as rows (w1, w2, doc_id, spot); the
    others are known to be repeated and go as runs of starts, so a window that a third of all documents share makes about
    one row for each task. ``spot`` is the start, with 32 bits of the text's hash above to tell rows of one doc_id apart.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def found(batch: pa.RecordBatch, seen: _Seen) -> pa.RecordBatch | None:
        texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
        numbers = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        out = []
        for part in parts(texts, window, gram):
            which = np.nonzero(_repeated(shared.value, part.anchor, depth, width))[0]
            if not len(which):
                continue
            w1, w2 = part.digests(which, window)
            rows, place = part.rows[which], part.place[which]
            doc = numbers[rows]
            order = np.lexsort((doc, w2, w1))
            w1, w2, rows, place, doc = w1[order], w2[order], rows[order], place[order], doc[order]
            head = np.concatenate(([True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
            at = np.nonzero(head)[0]
            late = doc > seen.least(w1[at], w2[at], doc[at])[np.cumsum(head) - 1]
            used = np.unique(rows)
            upper = np.zeros(len(texts), np.int64)
            upper[used] = [xxhash.xxh64_intdigest(texts[i].encode(), 42) >> 33 << 32 for i in used.tolist()]
            spot = upper[rows] | place
            open_ = ~late
            out.append((w1[open_].view(np.int64), w2[open_].view(np.int64), doc[open_], spot[open_], [None] * int(open_.sum())))
            known = spot[late]
            if len(known):
                by_row = np.lexsort((place[late], rows[late]))
                known, own, starts = known[by_row], rows[late][by_row], place[late][by_row]
                cuts = np.concatenate(([0], np.nonzero(np.diff(own))[0] + 1))
                runs = [x.astype("<i4").tobytes() for x in np.split(starts, cuts[1:])]
                own = own[cuts]
                out.append((mixed(own.astype(_U) + _U(1)).view(np.int64), upper[own] | numbers[own], numbers[own], upper[own], runs))
        if not out:
            return None
        w1, w2, doc, spot = (np.concatenate([x[i] for x in out]) for i in range(4))
        arrays = [pa.array(x) for x in (w1, w2, doc, spot)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([r for x in out for r in x[4]], pa.binary())], ["w1", "w2", "doc_id", "spot", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in small(batches):
            if (out := found(batch, seen)) is not None:
                yield out

    return docs.mapInArrow(run, SPOTS)


def repeated_starts(docs: DataFrame, window: int, gram: int, depth: int, sketch_bytes: int) -> DataFrame:
    """(_doc, _own, starts, runs) for each text (``_own``: 31 bits of its hash) with windows to remove."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = sketch_width(size, depth, sketch_bytes)
    bits = sketch(docs, window, gram, depth, width)
    found = candidates(docs, bits, window, gram, depth, width)
    same = Window.partitionBy("w1", "w2")
    late = found.withColumn("first", F.min("doc_id").over(same)).where("runs is not null or doc_id > first")
    return late.groupBy("doc_id", F.shiftright("spot", 32).alias("own")).agg(
        F.collect_set(F.expr("if(runs is null, cast(spot & 2147483647 as int), null)")).alias("_starts"), F.collect_set("runs").alias("_runs")
    ).select(F.col("doc_id").alias("_doc"), F.col("own").alias("_own"), "_starts", "_runs")


def _with_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    last = F.lit((1 << 63) - 1)
    on = (F.coalesce(docs["doc_id"], last) == F.col("_doc")) & (F.shiftrightunsigned(F.xxhash64(docs["text"]), 33) == F.col("_own"))
    return docs.join(marks, on, "left").select(*[docs[c] for c in docs.columns], "_starts", "_runs")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class _Removal:
    """A text's words and which of them go."""

    def __init__(self, text: str | None, starts: list[int] | None, runs: list[bytes] | None, window: int) -> None:
        self.raw = text.encode() if text else b""
        self.words = self.raw.split()
        edges = np.zeros(len(self.words) + 1, np.int32)
        for at in (np.array(starts or [], np.int64), *(np.frombuffer(r, "<i4") for r in runs or [])):
            np.add.at(edges, at, 1)
            np.add.at(edges, at + window, -1)
        self.gone = np.cumsum(edges[:-1]) > 0

    def kept_words(self) -> bytes:
        return b" ".join([w for w, g in zip(self.words, self.gone.tolist()) if not g])

    def kept_text(self) -> bytes:
        """The text as it was but for the words that go and the white space around them."""
        if not self.gone.any():
            return self.raw
        spans = [m.span() for m in _WORD.finditer(self.raw)]
        edges = np.nonzero(np.diff(np.concatenate(([True], self.gone, [True]))))[0].tolist()
        return b" ".join(self.raw[spans[a][0] : spans[b - 1][1]] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeated(docs: DataFrame, window: int = 50, gram: int = 20, depth: int = 2, sketch_bytes: int = 128 << 20) -> DataFrame:
    """Count the words covered by a window of ``window`` words that also starts in a document of smaller doc_id.

    One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined
    by one space). Null and empty texts have no words. Rows of one doc_id never remove each other's words; rows without
    doc_id count as the last of all and lose what any other document has; repeated rows each give a row; an empty table
    gives none; further columns are ignored. ``sketch_bytes`` bounds the sketch that is sent to every executor: beyond
    about 5 GB of text for each 50 MB of it the prefilter lets more windows through to the exact pass, which stays right.
    """
    table = text_table(docs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        columns = (batch.column(n).to_pylist() for n in ("doc_id", "text", "_starts", "_runs"))
        for doc_id, text, starts, runs in zip(*columns):
            own = _Removal(text, starts, runs, window)
            out.append((doc_id, len(own.words), int(own.gone.sum()), hashlib.sha256(own.kept_words()).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out), kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    marks = repeated_starts(table, window, gram, depth, sketch_bytes)
    return map_arrow(_with_marks(table, marks), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip_repeated(docs: DataFrame, window: int = 50, gram: int = 20, depth: int = 2, sketch_bytes: int = 128 << 20, drop_emptied: bool = False) -> DataFrame:
    """``docs`` without the words that ``remove_repeated`` counts; text (and n_chars, if there) change, all rows stay.

    With ``drop_emptied`` rows go that lose all their words; rows that had none stay. Columns of any name pass through;
    n_chars keeps its type; null texts stay null, and an empty table gives no rows.
    """
    schema = docs.schema
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = (batch.column(n).to_pylist() for n in ("text", "_starts", "_runs"))
        cut = [None if t is None else _Removal(t, s, r, window) for t, s, r in zip(*columns)]
        if drop_emptied:
            stays = [x is None or not len(x.gone) or not x.gone.all() for x in cut]
            batch, cut = batch.filter(pa.array(stays)), [x for x, y in zip(cut, stays) if y]
        texts = [None if x is None else x.kept_text().decode() for x in cut]
        new = {"text": texts, "n_chars": [None if t is None else len(t) for t in texts]}
        rows = batch.column("row")
        fields = [rows.field(i) for i in range(len(schema))]
        return pa.RecordBatch.from_arrays([pa.array(new[f.name], a.type) if f.name in new else a for f, a in zip(schema, fields)], schema.names)

    marks = repeated_starts(text_table(docs), window, gram, depth, sketch_bytes)
    return map_arrow(_with_marks(row, marks), run, schema)


SQL = """
with d as (select doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
late as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by h) as f from win) where doc_id > f),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as j from late),
kept as (select doc_id, count(*) as n, string_agg(x, ' ' order by j) as t from (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as j from d) s where not exists (select 1 from gone g where g.doc_id = s.doc_id and g.j = s.j) group by doc_id)
select d.doc_id, coalesce(len(w), 0) as n_words, coalesce(len(w), 0) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from d left join kept on d.doc_id = kept.doc_id
"""
