"""Token ids with a vocabulary file of a public tokenizer.

Texts are cut at ASCII white space first. The tokenizer drops white space, folds case character by character and never
joins across it, so a text's ids are its chunks' ids in a row; chunks repeat heavily, so each task keeps those it has
seen. A chunk of plain letters, digits and signs is cut by the tokenizer's own split pattern, with all others of its kind at
once, and its different pieces are given to the merge model; any other chunk goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import KEPT

#: The split pattern of the vocabulary file over lower-case text of ASCII and the letters U+00DF to U+017F.
#: The blank between two chunks is a piece of its own.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\sa-z0-9ß-öø-ſ]+| ")
_BETWEEN = b"\xff" * 4
#: Chunks that are cut into pieces at a time.
BLOCK = 65_536
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-įı-ňŊ-ſ]+")
_PLAINS = re.compile(r"[ !-~À-ÖØ-öø-įı-ňŊ-ſ]+")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    It keeps the ids of up to ``keep`` chunks and as many pieces, from the second time that one is met (by a table of hash
    bytes, so words that come once take no room). They are kept in two generations: when the younger one is full it becomes
    the older one, and what the older one had and is asked for again moves into the new younger one.
    """

    _own: dict[str, "Encoder"] = {}

    def __init__(self, path: str, keep: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.full = Tokenizer.from_file(path)
        self.model, self.half = self.full.model, max(1, keep // 2)
        self.marks = re.compile("|".join(re.escape(t.content) for t in self.full.get_added_tokens_decoder().values()) or r"(?!)")
        self.letters = byte_letters()
        self.chunks: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: tuple[dict[bytes, bytes], dict[str, bytes]] = ({}, {})
        self.met = bytearray(1 << 22)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """The encoder of this Python worker, kept from task to task."""
        if not any(kept is cls._own for kept in KEPT):
            KEPT.append(cls._own)
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        found = text.encode().split()
        try:
            return b"".join(map(self.chunks.__getitem__, found))
        except KeyError:
            pass
        own = list(dict.fromkeys(found))
        return b"".join(map(dict(zip(own, self._learn(own))).__getitem__, found))

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each of these texts in turn, as ``encode`` has them; a chunk is looked up once, however often it comes in them."""
        cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = cut.flatten().dictionary_encode()
        listed = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        # chunks hold no blank, so they come apart as they were; an empty one stands for white space at an end
        names = pc.binary_join(listed, pa.scalar(" ", pa.large_string()))[0].as_py().encode().split(b" ")
        blank = names.index(b"") if b"" in names else len(names)
        ids = self._learn(names[:blank] + names[blank + 1 :])
        ids[blank:blank] = [b""] * (blank < len(names))
        table, sizes = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts, codes, ends = np.cumsum(sizes) - sizes, coded.indices.to_numpy(), cut.offsets.to_numpy()
        for first, last in zip(ends, ends[1:]):
            own = codes[first:last]
            n = sizes[own]
            upto = np.cumsum(n)
            # a chunk's ids stand together in the table: from its start there, counted on from its place in the text
            yield table[np.repeat(starts[own] - upto + n, n) + np.arange(n.sum())]

    def _learn(self, found: list[bytes]) -> list[bytes]:
        """The ids of each of the different chunks ``found``; those that were met before are put into ``chunks``."""
        if len(self.chunks) > self.half:
            self.chunks, self.older, self.met = {}, (self.chunks, self.older[1]), bytearray(len(self.met))
        if len(self.pieces) > self.half:
            self.pieces, self.older = {}, (self.older[0], self.pieces)
        chunks, older, met, mask = self.chunks, self.older[0], self.met, len(self.met) - 1
        out = list(map(chunks.get, found))
        new = [k for k, ids in enumerate(out) if ids is None]
        if older:
            for k in new:
                if (ids := older.get(found[k])) is not None:
                    chunks[found[k]] = out[k] = ids
            new = [k for k in new if out[k] is None]
        for at in range(0, len(new), BLOCK):
            places = new[at : at + BLOCK]
            own = [found[k] for k in places]
            for k, chunk, ids in zip(places, own, self._new_ids(own)):
                out[k] = ids
                slot = hash(chunk) & mask
                if met[slot]:
                    chunks[chunk] = ids
                else:
                    met[slot] = 1
        return out

    def _new_ids(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of chunks: the plain ones are cut into pieces together, and each different piece goes to the merge model once."""
        joined = b" ".join(chunks).decode()
        if _PLAINS.fullmatch(joined) and not self.marks.search(joined):
            return self._plain_ids(joined)
        words = joined.split(" ")
        plain = [bool(_PLAIN.fullmatch(w)) and not self.marks.search(w) for w in words]
        known = iter(self._plain_ids(" ".join([w for w, p in zip(words, plain) if p])))
        return [next(known) if p else array("I", self.full.encode(w, add_special_tokens=False).ids).tobytes() for w, p in zip(words, plain)]

    def _plain_ids(self, joined: str) -> list[bytes]:
        """The ids of plain chunks, which a blank divides."""
        cut = _PIECES.findall(joined.lower())
        known: dict[str, bytes | None] = dict.fromkeys(cut)
        known[" "] = _BETWEEN
        pieces, older, met, mask = self.pieces, self.older[1], self.met, len(self.met) - 1
        new = []
        for piece, ids in known.items():
            if ids is None:
                ids = pieces.get(piece)
                if ids is None:
                    ids = older.get(piece)
                    if ids is None:
                        new.append(piece)
                        continue
                    pieces[piece] = ids
                known[piece] = ids
        for piece, ids in zip(new, self._merged(new)):
            known[piece] = ids
            slot = hash(piece) & mask
            if met[slot]:
                pieces[piece] = ids
            else:
                met[slot] = 1
        return _parts(b"".join(map(known.__getitem__, cut)))

    def _merged(self, pieces: list[str]) -> list[bytes]:
        """The merge model's ids of each piece."""
        tokenize, letters = self.model.tokenize, self.letters
        shown = [p if p.isascii() else "".join(map(letters.__getitem__, p.encode())) for p in pieces]
        ids = array("I")
        for piece in shown:
            ids.extend([t.id for t in tokenize(piece)])
            ids.append(0xFFFFFFFF)
        return _parts(ids.tobytes())[:-1]


def _parts(flat: bytes) -> list[bytes]:
    """``flat`` without the marks ``_BETWEEN``, cut at them."""
    ends = (4 * np.flatnonzero(np.frombuffer(flat, "<u4") == 0xFFFFFFFF)).tolist()
    return [flat[s:e] for s, e in zip([0, *[e + 4 for e in ends]], [*ends, len(flat)])]


def byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary: itself, or the next from U+0100."""
    shown = {b for span in ((33, 126), (161, 172), (174, 255)) for b in range(span[0], span[1] + 1)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}
