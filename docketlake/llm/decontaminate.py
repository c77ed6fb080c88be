"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the word windows of the benchmark items. A pattern set of one length m has a table that gives, for the
block of two words that ends at a text position, how far the position can move on without missing an occurrence; only
where that shift is zero are the patterns with this last block (their suffix-hash bucket) compared word by word. The
search moves many cursors at once, one for each stretch of a batch's words, each by its own shifts. Words outside the
patterns' vocabulary all get number zero, so comparing numbers compares strings exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, saved, text_table

#: A-Z become a-z; of ASCII only 0-9 and a-z belong to words; every byte of a longer UTF-8 character does.
_FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
STRETCH = 256


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class Patterns:
    """The distinct windows of the items (those of part ``part`` of ``parts`` by hash), numbered words, and one search table for each pattern length.

    Windows of items without an id count as occurrences but name no item.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = 10, part: int = 0, parts: int = 1) -> None:
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - width + 1) if words else 0):
                window = words[i : i + width]
                if parts > 1 and xxhash.xxh3_64_intdigest(b" ".join(window)) % parts != part:
                    continue
                own = owners.setdefault(tuple([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in window]), set())
                if item_id is not None:
                    own.add(item_id)
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for pattern in owners:
            by_length.setdefault(len(pattern), []).append(pattern)
        self.tables = [_Table(sorted(found), [owners[p] for p in sorted(found)]) for _, found in sorted(by_length.items())]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))


class _Table:
    """Shift table and suffix-hash buckets for patterns of one length."""

    def __init__(self, patterns: list[tuple[int, ...]], owners: list[set[str]]) -> None:
        self.m = m = len(patterns[0])
        self.block = min(2, m)
        size = 1 << max(12, (8 * len(patterns) * m).bit_length())
        self.mask = size - 1
        grid = np.array(patterns, np.int64)
        self.shift = np.full(size, min(255, m - self.block + 1), np.uint8)
        for end in range(self.block - 1, m):  # the last block gives shift 0
            np.minimum.at(self.shift, self.hash_at(grid, end), np.uint8(min(255, m - 1 - end)))
        suffix = self.hash_at(grid, m - 1)
        order = np.argsort(suffix, kind="stable")
        self.patterns, self.owners = grid[order], [owners[i] for i in order]
        self.first = np.searchsorted(suffix[order], np.arange(size + 1)).astype(np.int32)

    def hash_at(self, grid: np.ndarray, end: int) -> np.ndarray:
        before = grid[:, end - 1] if self.block == 2 else 0
        return self._mix(before, grid[:, end])

    def _mix(self, before: np.ndarray | int, last: np.ndarray) -> np.ndarray:
        return ((before * 0x9E3779B1 + last * 0x85EBCA77) >> 7) & self.mask

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end positions, pattern numbers) of every occurrence in ``text``, an array of word numbers."""
        m, ends, found = self.m, [], []
        at = np.arange(m - 1, len(text), STRETCH)
        stop = np.minimum(at + STRETCH, len(text))
        while len(at):
            shift = self.shift[self._mix(text[at - 1] if self.block == 2 else 0, text[at])]
            here = at[shift == 0]
            if len(here):
                end, pattern = self._compare(text, here)
                ends.append(end)
                found.append(pattern)
            at = at + np.maximum(shift, 1).astype(np.int64)
            live = at < stop
            at, stop = at[live], stop[live]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *ends]), np.concatenate([none, *found])

    def _compare(self, text: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compare each position with every pattern of its bucket, word by word."""
        key = self._mix(text[here - 1] if self.block == 2 else 0, text[here])
        first = self.first[key].astype(np.int64)
        n = self.first[key + 1] - first
        end = np.repeat(here, n)
        pattern = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        for back in range(self.m):
            same = text[end - back] == self.patterns[pattern, self.m - 1 - back]
            end, pattern = end[same], pattern[same]
            if not len(end):
                break
        return end, pattern


@dataclass
class Found:
    """For each text of a batch: its number of words, the spans [start, end, start, end, ...] of words in occurrences, the items."""

    sizes: np.ndarray
    spans: list[list[int]]
    items: list[list[str]]


def _search(texts: list[str | None], patterns: Patterns) -> Found:
    words = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    # texts are laid end to end with one word of number -1 between them, so nothing matches across two
    starts = np.cumsum(sizes + 1) - sizes - 1
    line = np.full(int(sizes.sum()) + len(words) + 1, -1, np.int64)
    for own, start in zip(words, starts.tolist()):
        line[start : start + len(own)] = patterns.numbers(own)
    edges = np.zeros(len(line) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for table in patterns.tables:
        ends, found = table.search(line)
        np.add.at(edges, ends - table.m + 1, 1)
        np.add.at(edges, ends + 1, -1)
        for doc, pattern in set(zip((np.searchsorted(starts, ends, "right") - 1).tolist(), found.tolist())):
            items.setdefault(doc, set()).update(table.owners[pattern])
    turns = np.nonzero(np.diff(np.concatenate(([0], np.cumsum(edges[:-1]) > 0)).astype(np.int8)))[0].reshape(-1, 2)
    docs = np.searchsorted(starts, turns[:, 0], "right") - 1
    spans: list[list[int]] = [[] for _ in texts]
    for doc, (a, b) in zip(docs.tolist(), (turns - starts[docs][:, None]).tolist()):
        spans[doc] += [a, b]
    return Found(sizes, spans, [sorted(items.get(i, ())) for i in range(len(texts))])


def _joined(a: Found, b: Found) -> Found:
    spans = []
    for one, two in zip(a.spans, b.spans):
        merged: list[int] = []
        for start, end in sorted(zip((one + two)[::2], (one + two)[1::2])):
            if merged and start <= merged[-1]:
                merged[-1] = max(merged[-1], end)
            else:
                merged += [start, end]
        spans.append(merged)
    return Found(a.sizes, spans, [sorted({*x, *y}) for x, y in zip(a.items, b.items)])


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"


def _result(ids: pa.Array, found: Found) -> pa.RecordBatch:
    hits = np.array([sum(s[1::2]) - sum(s[::2]) for s in found.spans], np.int64)
    digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found.items]
    arrays = [ids, pa.array(found.sizes), pa.array(hits), pa.array([len(x) for x in found.items], pa.int64()), pa.array(digests), pa.array(hits > 0), pa.array(found.items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in RESULT.split(", ")])


def _pattern_parts(benchmark: DataFrame, width: int, max_bytes: int, max_patterns: int) -> Iterator[Broadcast]:
    """The windows of the benchmark in parts of about ``max_patterns``, each sent out when it is its turn."""
    size = benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"the benchmark has {size} bytes of text, more than max_bytes={max_bytes}")
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null").collect()
    items = [(r[0], r[1]) for r in rows]
    parts = max(1, -(-sum(len(words_of(t)) for _, t in items) // max_patterns))
    for i in range(parts):
        yield benchmark.sparkSession.sparkContext.broadcast(Patterns(items, width, i, parts))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_bytes: int = 256 << 20, max_patterns: int = 400_000) -> DataFrame:
    """How far each row of ``docs`` (doc_id, text) repeats ``width``-word windows of ``benchmark`` (item_id, text).

    One row per input row: doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256 (of the
    sorted item_ids, comma-joined), contaminated, items. Null, empty and wordless texts have no words and no hits; items
    without words are in no text; items of fewer than ``width`` words are one window each; windows of items without id
    are hits of no item; repeated rows each give a row; further columns are ignored; empty tables give no rows, or no hits.

    A search table of ``max_patterns`` windows takes about 300 MB in the driver and in each Python worker. More windows
    are searched in rounds of that many, each written before the next. The driver holds the benchmark's text; more than
    ``max_bytes`` of it is refused.
    """
    table, last = text_table(docs), None
    for shared in _pattern_parts(benchmark, width, max_bytes, max_patterns):
        if last is not None:
            table = saved(map_arrow(table, _round(last), ROUND))
        last = shared

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _result(batch.column("doc_id"), _with_earlier(batch, _search(batch.column("text").to_pylist(), last.value)))

    return map_arrow(table, run, RESULT)


ROUND = "doc_id long, text string, spans array<long>, items array<string>"


def _with_earlier(batch: pa.RecordBatch, found: Found) -> Found:
    if "spans" not in batch.schema.names:
        return found
    return _joined(Found(found.sizes, batch.column("spans").to_pylist(), batch.column("items").to_pylist()), found)


def _round(shared: Broadcast):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _with_earlier(batch, _search(batch.column("text").to_pylist(), shared.value))
        arrays = [batch.column("doc_id"), batch.column("text"), pa.array(found.spans, pa.list_(pa.int64())), pa.array(found.items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "spans", "items"])

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_bytes: int = 256 << 20, max_patterns: int = 400_000) -> DataFrame:
    """The rows of ``docs`` in which no window of ``benchmark`` occurs, with all their columns, whatever their names.

    As for ``contamination``; each round drops the rows that it finds contaminated.
    """
    last = None
    for shared in _pattern_parts(benchmark, width, max_bytes, max_patterns):
        if last is not None:
            docs = saved(map_arrow(docs, _clean(last), docs.schema))
        last = shared
    return map_arrow(docs, _clean(last), docs.schema)


def _clean(shared: Broadcast):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _search(batch.column("text").cast(pa.string()).to_pylist(), shared.value)
        return batch.filter(pa.array([not s for s in found.spans]))

    return run


SQL = """
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
pat as (select distinct item_id, least(len(w), 10) as m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as p from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct m from pat),
win as (select doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') as p from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d, sizes where len(w) >= m)),
hit as (select win.doc_id, win.i, win.m, pat.item_id from win join pat on win.m = pat.m and win.p = pat.p),
pos as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + m)) as j from (select distinct doc_id, i, m from hit)) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as s from (select distinct doc_id, cast(item_id as varchar) as x from hit where item_id is not null) group by doc_id)
select d.doc_id, coalesce(len(w), 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos on d.doc_id = pos.doc_id left join its on d.doc_id = its.doc_id
"""
