"""Quality rules: repetition counts and zstandard compression bands."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_table

_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>"))
_WORD = re.compile(r"[^\x20\x09-\x0D]")


@dataclass(frozen=True)
class Bands:
    """Compression limits that depend on length, as ``fit_bands`` finds them. A ratio is compressed bytes over raw bytes at ``level``.

    ``knots``: (log2 of bytes, least ratio, greatest ratio) in the order of length; between knots the limits are interpolated,
    beyond them they are those of the end. A text is judged whole, and in pieces of ``chunk_bytes``, the last of which ends
    with the text (it may overlap the one before), so every byte lies in a piece; a text shorter than a piece is its only
    piece. Each is held to the limits of its own length. A text fails when the whole is outside them, or more than
    ``chunk_share`` of its pieces are.

    Without knots every ratio is within the limits.
    """

    knots: tuple[tuple[float, float, float], ...] = ()
    chunk_bytes: int = 4096
    chunk_share: float = 0.25
    level: int = 3

    def limits(self, size: int) -> tuple[float, float]:
        x, knots = math.log2(size), self.knots
        if not knots:
            return 0.0, math.inf
        at = bisect_right(knots, (x, math.inf, math.inf))
        if at in (0, len(knots)):
            return knots[min(at, len(knots) - 1)][1:]
        (x0, low0, high0), (x1, low1, high1) = knots[at - 1], knots[at]
        share = (x - x0) / (x1 - x0)
        return low0 + share * (low1 - low0), high0 + share * (high1 - high0)


def pieces(raw: bytes, size: int) -> list[bytes]:
    """The text in pieces of ``size``, the last one ending with the text; a shorter text is one piece."""
    n = len(raw)
    return [raw[max(0, min(i, n - size)) :][:size] for i in range(0, n, size)]


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a ``width``-word window found twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total = until = 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + width - max(i, until)
            until = i + width
    return total


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return len(lines) - len(set(lines))


def base_rule(raw: bytes) -> tuple[int, int, bool]:
    """Words, repeated words, and whether a text is too short or too repetitive."""
    words = raw.split()
    n, again = len(words), repeated_words(words)
    return n, again, n < 50 or 100 * again > 50 * n


class _Judge:
    """One task's compressor and limits."""

    def __init__(self, bands: Bands) -> None:
        self.bands, self.press = bands, zstandard.ZstdCompressor(level=bands.level).compress

    def ratio(self, raw: bytes) -> float:
        return len(self.press(raw)) / len(raw)

    def verdict(self, raw: bytes) -> tuple[float, float, bool]:
        """Whole-text ratio, share of pieces outside their band, and whether the text is within its bands."""
        bands, n = self.bands, len(raw)
        if not n:
            return 0.0, 0.0, False
        whole = self.ratio(raw)
        low, high = bands.limits(n)
        parts = pieces(raw, bands.chunk_bytes)
        least, most = bands.limits(len(parts[0]))
        share = sum(not least <= (whole if len(parts) == 1 else self.ratio(x)) <= most for x in parts) / len(parts)
        return whole, share, low <= whole <= high and share <= bands.chunk_share

    def row(self, text: str | None) -> tuple:
        text = text or ""
        raw = text.encode()
        n, again, failed = base_rule(raw)
        ratio, share, within = self.verdict(raw)
        chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
        return n, chars, len(raw.translate(None, _SYMBOLS)), repeated_lines(text), again, failed, ratio, share, within and not failed


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, outside_share double"
)


def compression_bands(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Judge every row of ``docs`` (doc_id, text) by its repetition counts and its compression bands.

    One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, then
    the whole-text ratio and the share of pieces outside their band. Null and empty texts have no words: base_failed,
    not kept, ratio zero. Repeated rows each give a row; an empty table gives none; further columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        judge = _Judge(bands)
        rows = [judge.row(t) for t in batch.column("text").to_pylist()]
        n, chars, symbols, lines, again, failed, ratio, share, kept = (list(x) for x in zip(*rows))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, chars, symbols, lines, again)), pa.array(failed), pa.array(kept), pa.array(ratio), pa.array(share)],
            ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "outside_share"],
        )

    return map_arrow(text_table(docs), run, SCHEMA)


def fit_bands(docs: DataFrame, labels: DataFrame, share: float = 0.005, chunk_bytes: int = 4096, level: int = 3) -> Bands:
    """Bands fitted on labelled rows: limits that leave out ``share`` of good texts below and a quarter of that above.

    labels (doc_id, quality): a document is good if all its labels are 1. All good ones count. Texts are measured where they
    are read, only ids and two sizes are joined with the labels, and texts are counted by cells of length (sixteenths of its
    log2) and ratio (2048ths); a cell stands for its texts by their mean length and ratio. Cells come to the driver: their
    number is bounded by the range of lengths and ratios, some 300,000 at most, however many texts there are. ``_knots`` says
    how few of them differ from many. Without good rows, or with empty tables, there are no limits and the repetition rules
    judge alone. Null labels, ids and texts are left out.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_q")).where("_q = 1").select("_id")
    texts = text_table(docs).where("doc_id is not null and text <> ''")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        press, out = zstandard.ZstdCompressor(level=level).compress, []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            raw = text.encode()
            if not base_rule(raw)[2]:
                out.append((doc_id, len(raw), len(press(raw))))
        if not out:
            return None
        ids, n, packed = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, n, packed)], ["_id", "n", "packed"])

    sizes = map_arrow(texts, run, "_id long, n long, packed long").join(good, "_id")
    cell = F.floor(16 * F.log2("n")).alias("length"), F.floor(2048 * F.col("packed") / F.col("n")).alias("ratio")
    cells = sizes.groupBy(*cell).agg(F.sum("n").alias("bytes"), F.sum("packed").alias("packed"), F.count("*").alias("texts")).toPandas().sort_values(["length", "ratio"])
    counts = cells["texts"].to_numpy()
    return Bands(_knots(cells["bytes"].to_numpy() / counts, cells["packed"].to_numpy() / cells["bytes"].to_numpy(), share, counts), chunk_bytes, level=level)


def _quantiles(values: np.ndarray, counts: np.ndarray, shares: tuple[float, ...]) -> np.ndarray:
    """``np.quantile`` of values that stand for ``counts`` each."""
    order = np.argsort(values, kind="stable")
    last = np.cumsum(counts[order])
    at = np.asarray(shares) * (last[-1] - 1)
    low, high = (values[order][np.searchsorted(last, x, side="right")] for x in (np.floor(at), np.ceil(at)))
    return low + (at - np.floor(at)) * (high - low)


def _knots(sizes: np.ndarray, ratios: np.ndarray, share: float, counts: np.ndarray | None = None, prior: int = 50) -> tuple[tuple[float, float, float], ...]:
    """Limits at up to 32 lengths, from any number of good texts by one rule; with ``counts`` a size and ratio stand for so many.

    A curve through the ratios by log length (a parabola, with under 50 texts a line, with under 10 a constant) and one
    through their deviations make all texts comparable: the quantiles of all their scaled deviations are the pooled limits. Texts
    in order of length form groups of 200, but eight groups at least; a group's own quantiles count as its texts against ``prior``,
    the pooled ones as the rest. Limits then widen by 6 deviations over the root, and 0.5 over the number, of all texts, so
    a handful rejects hardly anything and thousands are held to what they are. Beyond the ends limits keep the slope of
    the last eight groups.
    """
    counts = np.ones(len(sizes), np.int64) if counts is None else counts
    n = int(counts.sum())
    if not n:
        return ()
    logs = np.log2(sizes)
    mean = np.average(logs, weights=counts)  # curves are fitted around it
    root = np.sqrt(counts)  # what weights squared deviations by counts
    degree = 0 if n < 10 or np.ptp(logs) < 1e-6 else 1 if n < 50 else 2
    centre = np.poly1d(np.polyfit(logs - mean, ratios, min(degree, len(sizes) - 1), w=root))
    off = ratios - centre(logs - mean)
    spread = np.poly1d(np.polyfit(logs - mean, np.log(np.abs(off) + 1e-3), min(degree, 1, len(sizes) - 1), w=root))
    scale = lambda x: np.exp(spread(x - mean))
    z = off / scale(logs)
    ends = share, 1 - share / 4
    pooled, deviation = _quantiles(z, counts, ends), np.sqrt(np.average((z - np.average(z, weights=counts)) ** 2, weights=counts))
    order = np.lexsort((np.random.default_rng(1).permutation(len(sizes)), sizes))
    parts = max(min(8, n), min(32, n // 200))
    before = np.cumsum(counts[order]) - counts[order]
    groups = [g for g in np.split(order, np.searchsorted(before, [n * i / parts for i in range(1, parts)])) if len(g)]
    x = np.array([np.average(logs[g], weights=counts[g]) for g in groups])
    weight = np.array([counts[g].sum() / (counts[g].sum() + prior) for g in groups])
    own = np.array([_quantiles(z[g], counts[g], ends) for g in groups])
    mixed = weight[:, None] * own + (1 - weight[:, None]) * pooled
    slack = 6 * deviation / np.sqrt(n) * scale(x) + 0.5 / n
    low, high = centre(x - mean) + scale(x) * mixed[:, 0] - slack, centre(x - mean) + scale(x) * mixed[:, 1] + slack
    outer = []
    for far, at, part in ((5.0, 0, slice(0, 8)), (26.0, -1, slice(-8, None))):
        slopes = [np.polyfit(x[part], y[part], 1)[0] if np.ptp(x[part]) > 1e-6 else 0.0 for y in (low, high)]
        outer.append((far, *(float(np.clip(y[at] + slope * (far - x[at]), least, 2.0)) for y, slope, least in zip((low, high), slopes, (0.02, 0.3)))))
    inner = [(float(a), float(b), float(c)) for a, b, c in zip(x, low, high)]
    kept = [k for i, k in enumerate(inner) if not i or k[0] - inner[i - 1][0] > 1e-6]
    return tuple(tuple(round(v, 4) for v in k) for k in [outer[0], *kept, outer[1]])


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that ``compression_bands`` keeps, with all their columns, whatever their names; null and empty texts go."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        judge = _Judge(bands)
        return batch.filter(pa.array([judge.row(t)[-1] for t in batch.column("text").cast(pa.string()).to_pylist()]))

    return map_arrow(docs, run, docs.schema)
