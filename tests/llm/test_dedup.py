"""Near-duplicate, substring and byte dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from docketlake.llm import simhash, substring, suffixes
from docketlake.llm.common import components, gapless
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_fingerprint(text):
    words = WORD.findall(folded(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fingerprint -> smallest fingerprint that links of two bits or fewer reach."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def test_fingerprints_and_components(spark, docs, corpus):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(corpus)
    own = {(r.doc_id, r.fingerprint) for r in rows}
    assert own == {(i, f"{brute_fingerprint(t):016x}") for i, t, *_ in corpus}
    roots = brute_components(int(r.fingerprint, 16) for r in rows)
    least = defaultdict(lambda: 1 << 62)
    for r in rows:
        if r.doc_id is not None:
            root = roots[int(r.fingerprint, 16)]
            least[root] = min(least[root], r.doc_id)
    assert all(r.component_id == least[roots[int(r.fingerprint, 16)]] for r in rows)


def test_dense_cells_lose_no_link(spark):
    """A crowd of fingerprints a bit or two around a few centres, and chains of two-bit steps."""
    rng = np.random.default_rng(1)
    fps = set()
    for centre in rng.integers(0, 1 << 63, 3).tolist():
        fps.add(centre)
        fps |= {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (120, 2))}
        chain = centre
        for bit in range(0, 40, 2):
            chain ^= 3 << bit
            fps.add(chain)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    reps = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in components(simhash.links(reps)).collect()}
    want = brute_components(f % (1 << 64) for f in signed)
    groups = defaultdict(set)
    for f in signed:
        groups[got.get(f, f)].add(f % (1 << 64))
    expected = defaultdict(set)
    for f, r in want.items():
        expected[r].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_embedding_bounds_hamming(spark):
    rows = spark.createDataFrame([(0,), (-1,), (0x0F00000000000013,)], "fp long").select("fp", simhash.embedding(F.col("fp")).alias("e")).collect()
    for fp, e in rows:
        assert [e >> 4 * i & 15 for i in range(16)] == [(fp % (1 << 64) >> 4 * i & 15).bit_count() for i in range(16)]


def test_keep_first(docs, corpus, none):
    """Copies go, repeated rows of a kept doc_id and rows without doc_id stay; clashing columns pass through."""
    clash = docs.withColumns({"_keep": F.lit(1), "key": F.lit("k"), "gone": F.lit(2), "fp": F.lit(0), "root": F.lit(None).cast("string")})
    kept = simhash.keep_first(clash)
    assert kept.schema == clash.schema
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[3] == 1 and not ids[68] and not ids[69] and ids[5] == 2 and ids[None] == 1
    assert len([i for i in ids if i is not None and not (corpus[i][1] or "").split()]) == 1  # empty texts are copies of each other
    assert simhash.keep_first(none).count() == 0


def brute_windows(rows, width=50):
    first = {}
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    number = [1 << 62 if r[0] is None else r[0] for r in rows]
    for n, w in zip(number, words):
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, 1 << 63), n)
    out = Counter()
    for r, n, w in zip(rows, number, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < n:
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[(r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("sketch_bytes", [1 << 18, 128 << 20])
def test_substring_dedup(docs, corpus, sketch_bytes):
    rows = substring.remove_repeated(docs, sketch_bytes=sketch_bytes).collect()
    assert Counter(tuple(r) for r in rows) == brute_windows(corpus)


def test_substring_strip_keeps_columns_and_rows(docs, corpus):
    docs = docs.withColumns({"n_chars": F.col("n_chars").cast("int"), "_doc": F.lit("d"), "_own": F.lit(1), "_starts": F.lit(None).cast("array<int>"), "_runs": F.lit(2.5), "row": F.lit("r")})
    out = substring.strip_repeated(docs)
    assert out.schema == docs.schema
    rows = out.collect()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r._doc == "d" and r._runs == 2.5 for r in rows)
    assert len(rows) == len(corpus)
    before = {r[0]: r[1] for r in corpus}
    got = {r.doc_id: r.text for r in rows}
    assert got[10] == before[10] and got[73] is None
    assert WORD.findall(got[68]) == [] or len(got[68]) < len(before[68])
    want = {k[0]: k[3] for k in brute_windows(corpus)}
    for r in rows:
        if r.doc_id is not None and r.doc_id != 5:
            assert hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() == want[r.doc_id]


def brute_bytes(rows, length):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = Counter()
    for doc_id, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out[(doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("batches", "few"), [(1, 64), (5, 1)])
def test_repeated_bytes(docs, corpus, batches, few):
    rows = suffixes.repeated_bytes(docs, batches=batches, few=few).collect()
    assert Counter(tuple(r) for r in rows) == brute_bytes(corpus, 200)


def test_repeated_bytes_across_pieces(spark, monkeypatch):
    """A text longer than a part, with a repeat across the seam of its pieces."""
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 123, 5000, np.uint8)).decode()
    rows = [(1, text + text[1000:1900], None, None, 0), (2, "x" * 700, None, None, 0), (3, text[:150], None, None, 0)]
    monkeypatch.setattr(suffixes, "PART_BYTES", 1500)
    got = Counter()
    parts = list(suffixes.stretches([r[1] for r in rows], 200, 64))
    starts = {(int(r), int(s)) for p in parts for r, lo, n in zip(p.rows, p.lo, p.n) for s in range(lo, lo + n)}
    assert starts == {(i, s) for i, r in enumerate(rows) for s in range(max(0, len(r[1]) - 199))}
    got.update(tuple(r) for r in suffixes.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string, a string, b string, c int")).collect())
    assert got == brute_bytes(rows, 200)


def test_index_family_levels(spark):
    """Levels double, hold each context once, stay in suffix order by ranges, and larger ones are not written again."""
    family = suffixes.IndexFamily()
    schema = "head binary, key long, c1 long, c2 long, doc_id long, spot long, n int, seen boolean"
    found, last = Counter(), {}
    for i in range(6):
        rows = [(b"aa", 1, 1, 0, i, 7, 3, False), (b"ab", 2, i, 0, i, 8, 3, False), (b"b", 10 + i, 1, 0, i, 9, 3, False)]
        found.update((r.doc_id, r.spot) for r in family.add(spark.createDataFrame(rows, schema)).collect())
        assert {r.key: r.n for r in family.partial().collect()} == ({2: i + 1} if i else {})
        now = {size: sorted(level.inputFiles()) for size, level in family.levels}
        assert all(now[size] == files for size, files in last.items() if size in now and size > 1 and size in (4,))
        last = now
    assert [size for size, _ in family.levels] == [4, 2]
    assert {d for d, s in found if s == 7} == set(range(6)) and not [1 for _, s in found if s != 7]
    rows = [r for _, level in family.levels for r in level.collect()]
    assert len(rows) == len({(r.head, r.key, r.c1, r.c2) for r in rows}) == 1 + 6 + 6


def test_stretches_met_twice_in_a_task(spark):
    """A passage that many parts of one task share: two entries, and every copy is found."""
    rng = np.random.default_rng(8)
    word = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    passage = word(420)
    rows = [(i, word(300) + passage + word(250)) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = suffixes.PART_BYTES
    suffixes.PART_BYTES = 900
    try:
        texts = [t for _, t in rows]
        met, out = suffixes._Met(), []
        for part in suffixes.stretches(texts, 200, 64):
            suffixes._emit(out, met, lambda own, p=part: p.take(own).heads(32), part.key, *part.contexts(), part.rows, part.lo, part.n, np.arange(40), np.zeros(40, np.int64))
        entries = suffixes._rows(out).to_pylist()
    finally:
        suffixes.PART_BYTES = before
    inner = Counter((r["c1"], r["c2"]) for r in entries if r["runs"] is None)
    assert max(inner.values()) == 2
    assert {r["doc_id"] for r in entries if r["runs"] is not None} == set(range(1, 40))
    assert Counter(tuple(r) for r in suffixes.repeated_bytes(table).collect()) == brute_bytes(rows, 200)


def test_empty_tables(none):
    assert simhash.near_duplicates(none).count() == 0
    assert substring.remove_repeated(none).count() == 0
    assert suffixes.repeated_bytes(none).count() == 0


def test_gapless(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 300, 0).alias("g"), "id")
    out = gapless(rows, ["g"], [F.col("id")], "slot", 7).collect()
    for g in (0, None):
        assert sorted(r.slot for r in out if r.g == g) == list(range(sum(r.g == g for r in out)))


def jaccard(a, b, width=5):
    one, two = ({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (folded(a).split(), folded(b).split()))
    return len(one & two) / len(one | two)


def test_keep_first_near_copies(spark):
    """Planted copies at 0.8 to 0.95 go, those below stay; a crowd of near copies and a chain keep one each."""
    rng = np.random.default_rng(3)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    texts, gone, stay = [], set(), set()
    for k in range(120):
        n = (200, 1000)[k % 2]
        words = fresh(n)
        texts.append(" ".join(words))
        for changed in ((1, 2, 4, 6), (5, 10, 20, 40))[k % 2]:
            other = list(words)
            for at in np.linspace(10, n - 10, changed).astype(int):
                other[at] = fresh(1)[0].upper()
            j = jaccard(" ".join(words), " ".join(other))
            if k // 2 % 4 == (1, 2, 4, 6, 5, 10, 20, 40).index(changed) % 4:
                (gone if j >= 0.8 else stay).add(len(texts))
                texts.append(" ".join(other))
    assert len(gone) == 90 and len(stay) == 30
    base, crowd = fresh(400), len(texts)
    for _ in range(150):
        other = list(base)
        for at in rng.integers(0, 400, 4):
            other[at] = fresh(1)[0]
        texts.append(" ".join(other))
    rows = [(i, t, None, None, len(t)) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in simhash.keep_first(table).collect()}
    assert kept == set(range(crowd + 1)) - gone


def test_crowded_cells_lose_no_link(spark):
    """A crowd whose members are mostly less alike than 0.8: buckets of three against blocks of four find every component."""
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 300)]
    texts = []
    for _ in range(60):
        other = list(base)
        for at in rng.integers(0, 300, int(rng.integers(1, 12))):
            other[at] = f"w{rng.integers(0, 1 << 40)}"
        texts.append(" ".join(other))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8 and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    table = simhash.banded(docs)
    reps = table.withColumn("first_id", F.col("doc_id"))
    got = {r.node: r.root for r in simhash.similar_links(reps, docs, probes=3, block=4).collect()}
    keys = {r.doc_id: r.key for r in table.select("doc_id", "key").collect()}
    groups = defaultdict(set)
    for i, k in keys.items():
        groups[got.get(k, k)].add(i)
    assert 1 < len(set(root)) < 60
    assert {min(g) for g in groups.values()} == set(root)
