"""Alignment of two tokenizers' tokens over the same bytes, by divide and conquer at shared cuts.

A cut is a byte offset where a token of each tokenizer ends. An interval of tokens is divided at a common end near its
middle, found by bisecting each list of ends for the other's next value in turn, and both halves are divided again; an
interval without a common end inside is a leaf, a group. White space outside the tokenizers' pieces is always a cut, so a
document is divided there first, and what lies between, mostly a word, is encoded and divided once and then remembered.

A pair of ids is linked where tokens of the two overlap. Documents are aligned once, into a table with each one's pairs;
tasks add up how many of their documents hold a pair before the counts are shuffled; then the counts go out, at most
``max_pairs`` at a time, in as many rounds over that table as it takes.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import KEPT, discard, map_arrow, saved, sized, small, text_table
from .tokens import byte_letters

#: Characters that no rule of either tokenizer takes for white space: printable ASCII and Latin letters.
_SOLID = "!-~À-ÖØ-öø-ɏ"
_CUT = re.compile(rf"(?<=[{_SOLID}])(?=[ \n])")
_SOLIDS = frozenset(re.findall(f"[{_SOLID}]", "".join(map(chr, range(0x250)))))
_MARKS = frozenset(".,;:!?")
_MARKED = re.compile(r".*[A-Za-zÀ-ÖØ-öø-ɏ][.,;:!?]", re.DOTALL)


def leaves(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Leaf groups of two rising lists of ends with the same last value: (first, end of a's tokens, first, end of b's), in order."""
    return list(zip(*(x.tolist() for x in _divided(np.asarray(a, np.int64), np.asarray(b, np.int64)))))


def _divided(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The four columns of ``leaves``; all intervals of a level are divided together.

    ``low`` to ``high`` is where an interval of ``a`` may still hold a common end; what a search has passed over is left out
    of it, so every end is looked at once and bisected a logarithmic number of times.
    """
    done = []
    i, i_end, j, j_end, low, high = np.array([[0], [len(a)], [0], [len(b)], [0], [len(a) - 1]])
    while len(i):
        open_ = low < high
        if not open_.all():
            done.append([x[~open_] for x in (i, i_end, j, j_end)])
            i, i_end, j, j_end, low, high = (x[open_] for x in (i, i_end, j, j_end, low, high))
        middle = (low + high) // 2
        found, x, y = _common_ends(a, b, middle, high, j_end - 1)
        x, y = x[found] + 1, y[found] + 1
        parts = (
            (i, i[found], x), (i_end, x, i_end[found]), (j, j[found], y), (j_end, y, j_end[found]), (low, low[found], x), (middle, middle[found], high[found]),
        )
        i, i_end, j, j_end, low, high = (np.concatenate([kept[~found], left, right]) for kept, left, right in parts)
    columns = [np.concatenate(x) for x in zip(*done)]
    order = np.argsort(columns[0])
    return tuple(x[order] for x in columns)


def _common_ends(a: np.ndarray, b: np.ndarray, x: np.ndarray, x_end: np.ndarray, y_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each interval the first place from ``x`` on, before ``x_end``, whose end ``b`` has too, and its place there: (is there one, x, y)."""
    x, y, found = x.copy(), np.zeros_like(x), np.zeros(len(x), bool)
    todo = np.arange(len(x))
    while len(todo):
        at = np.searchsorted(b, a[x[todo]])
        todo, at = todo[at < y_end[todo]], at[at < y_end[todo]]
        same = b[at] == a[x[todo]]
        y[todo], found[todo[same]] = at, True
        todo, at = todo[~same], np.searchsorted(a, b[at[~same]])
        x[todo] = at
        todo = todo[at < x_end[todo]]
    return found, x, y


def links(a: np.ndarray, b: np.ndarray, leaf: tuple[int, int, int, int]) -> Iterator[tuple[int, int]]:
    """Places of the tokens of a leaf whose byte ranges overlap."""
    i, i_end, j, j_end = leaf
    _, x, y = _overlaps(np.asarray(a[i:i_end]), np.asarray(b[j:j_end]))
    return zip((x + i).tolist(), (y + j).tolist())


def _overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends of both, and the tokens of a and of b that hold the bytes before each; every overlap is met once."""
    ends = np.sort(np.concatenate([a, b]), kind="stable")
    ends = ends[np.append(True, ends[1:] != ends[:-1])]
    return ends, np.searchsorted(a, ends), np.searchsorted(b, ends)


#: The alignment of a stretch of text: tokens of A, groups as `a1,a2|b1;a3|b2`, and the linked pairs' codes. Kept by the
#: hundred thousand, so a plain tuple, which Python's garbage collector need not follow.
Piece = tuple[int, bytes, bytes]


class Aligner:
    """Aligns texts, remembering stretches from the second time that one is met (by a table of hash bytes).

    Up to ``keep`` are kept, in two generations; the older one goes when the younger is full. Stretches that are not known
    are encoded and divided ``block`` at a time.
    """

    _own: dict[tuple, "Aligner"] = {}

    def __init__(self, byte_bpe: str, piece_bpe: str, keep: int = 500_000, block: int = 8192) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(byte_bpe), sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        self.a.encode_special_tokens = True
        shown = {letter: byte for byte, letter in byte_letters().items()}
        specials = self.a.get_added_tokens_decoder()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.bytes_a[i] = entry.encode() if i in specials else bytes(shown[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.shift = (len(pieces) - 1).bit_length()
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.shown = [f"{i}{sign}" for i in range(max(len(self.bytes_a), len(pieces))) for sign in ",|;\n"]
        whole = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        rule = json.loads(self.a.to_str())["pre_tokenizer"]
        split = (rule or {}).get("type") == "ByteLevel" and rule["use_regex"] and not rule["add_prefix_space"]
        self.parts = split and not any("\n" in p or "▁" in p.lstrip("▁") for p in whole)
        self.marks = self.parts and not any(map(_MARKED.match, whole))
        self.lead = self.b.encode("a")
        self.block = block
        self.half, self.young, self.old, self.met = max(1, keep // 2), {}, {}, bytearray(1 << 22)

    @classmethod
    def of(cls, byte_bpe: str, piece_bpe: str) -> "Aligner":
        """The aligner of this Python worker, kept from task to task."""
        if not any(kept is cls._own for kept in KEPT):
            KEPT.append(cls._own)
        key = byte_bpe, piece_bpe
        if key not in cls._own:
            cls._own[key] = cls(*key)
        return cls._own[key]

    def align(self, texts: list[str | None]) -> list[Piece | None]:
        """The alignment of each text, None for one that has no tokens: null, empty, or not given back byte for byte."""
        asked = [t.replace("\n", " \n").split(" ") if t and self.parts else [] for t in texts]
        if len(self.young) > self.half:
            self.young, self.old, self.met = {}, self.young, bytearray(len(self.met))
        young = self.young
        missing = set().union(*asked).difference(young)
        odd = {p for p in missing if p[-1:] not in _SOLIDS}
        if odd or not self.parts:
            asked = [self._cut(t) if t and (not p or not odd.isdisjoint(p)) else p for t, p in zip(texts, asked)]
            missing = set().union(*asked).difference(young)
        new = []
        for part in missing:
            if (known := self.old.get(part)) is not None:
                young[part] = known
            else:
                new.append(part)
        self._learn(new)
        out = []
        for text, parts in zip(texts, asked):
            got = list(map(young.__getitem__, parts))
            if not all(got):
                got = self._encoded([" " + text])
            if not got or got[0] is None:
                out.append(None)
            else:
                n, groups, codes = zip(*got)
                out.append((sum(n), b";".join(groups), b"".join(codes)))
        met, mask = self.met, len(self.met) - 1
        for part in new:
            slot = hash(part) & mask
            if not met[slot]:
                met[slot] = 1
                del young[part]
        return out

    def _cut(self, text: str) -> list[str]:
        """The stretches of " " + text, cut before a blank or line end that follows a solid character, as ``align`` keeps them.

        A stretch that begins with a blank and then a solid character stands without that blank, one that begins with a
        line end as it is; any other, and a text that may not be cut, has a mark before it.
        """
        stretches = _CUT.split(" " + text) if self.parts else [" " + text]
        return [p[1:] if self.parts and p[0] == " " and p[1:2].strip() else p if p[0] == "\n" else "\0" + p for p in stretches]

    def _learn(self, parts: list[str]) -> None:
        """Put the alignment of ``parts`` into the young generation."""
        young, stems, ask = self.young, {}, []
        for part in parts:
            if self.marks and part[-1:] in _MARKS and len(part) > 2 and part[-2].isalpha() and part[-2] in _SOLIDS:
                stems[part] = part[:-1]
            else:
                ask.append(part)
        heads = {stem: young.get(stem) or self.old.get(stem) for stem in stems.values()}
        heads |= {part: None for part in ask}
        ask = [part for part, known in heads.items() if known is None]
        found = dict(zip(ask, self._encoded([p[1:] if p[0] == "\0" else p if p[0] == "\n" else " " + p for p in ask])))
        for part in parts:
            if (stem := stems.get(part)) is None:
                young[part] = found[part]
            else:
                head, mark = heads[stem] or found[stem], self._mark(part[-1])
                young[part] = head and mark and (head[0] + mark[0], head[1] + b";" + mark[1], head[2] + mark[2])

    def _mark(self, mark: str) -> Piece | None:
        key = "\1" + mark
        if key not in self.young:
            self.young[key] = self._encoded([mark])[0]
        return self.young[key]

    def _encoded(self, stretches: list[str]) -> list[Piece | None]:
        """Alignments of stretches that both tokenizers encode on their own; None where bytes are not given back."""
        out: list[Piece | None] = [None] * len(stretches)
        joint = [k for k, s in enumerate(stretches) if self.parts and s[0] in " \n" and s[-1] in _SOLIDS]
        for own, joined in ((joint, True), (sorted(set(range(len(stretches))).difference(joint)), False)):
            for at in range(0, len(own), self.block):
                places = own[at : at + self.block]
                for k, piece in zip(places, self._block([stretches[k] for k in places], joined)):
                    out[k] = piece
        return out

    def _block(self, stretches: list[str], joined: bool) -> list[Piece | None]:
        """``_encoded`` of stretches that A takes in one go (``joined``: each begins with a cut and ends with a solid character) or one by one."""
        raws = [s.encode() for s in stretches]
        a, n_a = self._ids_a(stretches, raws, joined)
        # B puts a blank before what it gets: a stretch without one follows a letter that is taken off again
        found = self.b.encode([s[1:] if s[0] == " " else "a" + s for s in stretches])
        for k, s in enumerate(stretches):
            if s[0] != " ":
                found[k] = found[k][len(self.lead) :] if found[k][: len(self.lead)] == self.lead else []
        n_b = np.fromiter(map(len, found), np.int64, len(found))
        b = np.fromiter(chain.from_iterable(found), np.int64, n_b.sum())
        good = np.ones(len(raws), bool)
        for ids, n, texts, sizes in ((a, n_a, self.bytes_a, self.sizes_a), (b, n_b, self.bytes_b, self.sizes_b)):
            given = b"".join(map(texts.__getitem__, ids.tolist()))
            ends = np.cumsum(np.append(0, sizes[ids]))[np.cumsum(np.append(0, n))].tolist()
            good &= [given[x:y] == raw for x, y, raw in zip(ends, ends[1:], raws)]
        out: list[Piece | None] = [None] * len(raws)
        if good.any():
            own = self._aligned(a[np.repeat(good, n_a)], n_a[good], b[np.repeat(good, n_b)], n_b[good])
            for k, piece in zip(np.flatnonzero(good).tolist(), own):
                out[k] = piece
        return out

    def _ids_a(self, stretches: list[str], raws: list[bytes], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all stretches in a row, and how many each has."""
        if joined:
            found = self.a.encode_batch_fast(["".join(stretches)], add_special_tokens=False)[0].ids
            ids = np.array(found, np.int64)
            ends, wanted = np.cumsum(self.sizes_a[ids]), np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
            at = np.searchsorted(ends, wanted)
            if len(ends) and at[-1] + 1 == len(ends) and (ends[at] == wanted).all():
                return ids, np.diff(at, prepend=-1)
        each = [e.ids for e in self.a.encode_batch_fast(stretches, add_special_tokens=False)]
        n = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), np.int64, n.sum()), n

    def _aligned(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> list[Piece]:
        """Alignments of stretches, given the ids of all in a row and how many each has. Their ends are cuts too."""
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        i, i_end, j, j_end = _divided(ends_a, ends_b)
        # a group's ids of A, then its ids of B, each with the sign that follows it
        sign_a, sign_b = np.zeros_like(a), np.zeros_like(b)
        sign_a[i_end - 1], sign_b[j_end - 1], sign_b[np.cumsum(n_b) - 1] = 1, 2, 3
        row = np.empty(len(a) + len(b), np.int64)
        row[np.arange(len(a)) + np.repeat(j, i_end - i)] = a * 4 + sign_a
        row[np.arange(len(b)) + np.repeat(i_end, j_end - j)] = b * 4 + sign_b
        groups = "".join(map(self.shown.__getitem__, row.tolist())).encode().split(b"\n")
        ends, x, y = _overlaps(ends_a, ends_b)
        codes = (a[x] << self.shift | b[y]).astype("<u8").tobytes()
        upto = (8 * np.searchsorted(ends, ends_a[np.cumsum(n_a) - 1], "right")).tolist()
        return list(zip(n_a.tolist(), groups, [codes[s:e] for s, e in zip([0, *upto], upto)]))


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def alignments(docs: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """The groups of every document's tokens: doc_id, groups (an array of a: ids of A, b: ids of B), null without tokens.

    A (``byte_bpe``, a tokenizers file) encodes a blank and the text, B (``piece_bpe``, a sentencepiece model) the text.
    Null and empty texts, and texts whose bytes either tokenizer doesn't give back, have no tokens; repeated rows each
    give a row; an empty table gives none; further columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Aligner.of(byte_bpe, piece_bpe).align(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f and f[1].decode() for f in found], pa.string())], ["doc_id", "groups"])

    ids = lambda side: F.transform(F.split(side, ","), lambda x: x.cast("int"))
    groups = F.transform(F.split("groups", ";"), lambda g: F.struct(ids(F.split(g, "[|]")[0]).alias("a"), ids(F.split(g, "[|]")[1]).alias("b")))
    return _kept_worker(text_table(docs), run, "doc_id long, groups string").select("doc_id", groups.alias("groups"))


def aligned(table: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """Counts and digests of every document's alignment, its different pairs' codes, and how often each is linked in it."""

    def row(doc_id: int | None, found: Piece | None) -> tuple:
        if found is None:
            return doc_id, 0, 0, 0, 0, "", b"", b""
        n_a, groups, codes = found
        codes, n_groups = np.frombuffer(codes, np.uint64), groups.count(b";") + 1
        pairs, times = np.unique(codes, return_counts=True)
        n_b = groups.count(b",") + 2 * n_groups - n_a
        return doc_id, n_a, n_b, n_groups, len(codes), hashlib.sha256(groups).hexdigest(), pairs.astype("<u8").tobytes(), times.astype("<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        rows = [row(i, f) for i, f in zip(batch.column("doc_id").to_pylist(), Aligner.of(byte_bpe, piece_bpe).align(texts))]
        kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [c.split()[0] for c in ALIGNED.split(", ")])

    return _kept_worker(table, run, ALIGNED)


def _kept_worker(table: DataFrame, fn, schema: str, most: int = 4 << 20) -> DataFrame:
    """``map_arrow`` over batches of up to ``most`` bytes of text, by workers that keep what earlier tasks learnt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(small(batches, 2048, keep=True), "text", most):
            yield fn(batch)

    return table.mapInArrow(run, schema)


def pair_counts(found: DataFrame, shift: int, most: int = 1_000_000) -> DataFrame:
    """pair, n (documents of ``found`` that hold it), best (n is its A id's greatest); tasks send a row a pair they hold.

    A task keeps counts of up to about ``most`` pairs and sends them on when there are more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        waiting = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            own, counts = np.unique(np.concatenate([keys[:0], *held]), return_counts=True)
            both, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([n, counts]), len(both)).astype(np.int64)

        for batch in small(batches):
            held += [np.frombuffer(x, "<u8") for x in batch.column("pairs").to_pylist()]
            waiting += sum(len(x) for x in held[-batch.num_rows :])
            if waiting > most:
                (keys, n), held, waiting = merged(), [], 0
                if len(keys) > most:
                    yield _pair_batch(keys, n)
                    keys, n = keys[:0], n[:0]
        keys, n = merged()
        if len(keys):
            yield _pair_batch(keys, n)

    summed = found.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(F.shiftright("pair", shift))
    return summed.withColumn("best", F.col("n") == F.max("n").over(own))


def _pair_batch(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], ["pair", "n"])


def _scored(found: DataFrame, counts: DataFrame) -> DataFrame:
    """``found`` with n_best and count_sum raised by the links whose pair ``counts`` has; ``counts`` goes to every worker."""
    rows = counts.toArrow()
    order = np.argsort(rows["pair"].to_numpy())
    keys, n, best = (rows[c].to_numpy()[order] for c in ("pair", "n", "best"))
    sent = found.sparkSession.sparkContext.broadcast((keys.astype(np.uint64), n, best))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, n, best = sent.value
        sums = []
        for pairs, times in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
            pairs, times = np.frombuffer(pairs, "<u8"), np.frombuffer(times, "<u4").astype(np.int64)
            at = np.searchsorted(keys, pairs)
            at[at == len(keys)] = 0
            here = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            at, times = at[here], times[here]
            sums.append((int(times[best[at]].sum()), int((times * n[at]).sum())))
        added = {name: pa.array(x, pa.int64()) for name, x in zip(("n_best", "count_sum"), zip(*sums))}
        return pa.RecordBatch.from_arrays([pa.compute.add(batch.column(c), added[c]) if c in added else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return map_arrow(found, run, found.schema)


def alignment_counts(docs: DataFrame, byte_bpe: str, piece_bpe: str, max_pairs: int = 2_000_000) -> DataFrame:
    """Each document's alignment in numbers, its links weighed by how many documents of the corpus hold their pair.

    One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many
    documents as any of its A id), count_sum, groups_sha256. What has no tokens (see ``alignments``) has zeros and ''.
    Rows count as documents, those without doc_id and repeated ones too; an empty table gives no rows; further columns
    are ignored. Counts are sent out ``max_pairs`` at a time, in rounds over the aligned documents.
    """
    shift = (sentencepiece.SentencePieceProcessor(model_file=piece_bpe).get_piece_size() - 1).bit_length()
    found = saved(aligned(text_table(docs), byte_bpe, piece_bpe))
    counts = saved(pair_counts(found, shift))
    total = counts.count()
    rounds = max(1, -(-total // max_pairs))
    scored = found.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for i in range(rounds):
        scored = _scored(scored, counts.where(F.pmod(F.xxhash64("pair"), F.lit(rounds)) == i))
        if i + 1 < rounds:
            before, scored = found, saved(scored)
            discard(before)
            found = scored
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
