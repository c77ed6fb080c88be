"""Token ids, packing plans and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from docketlake.llm import packing
from docketlake.llm.common import sized
from docketlake.llm.queries import word_bpe
from docketlake.llm.tokens import Encoder
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def full():
    return Tokenizer.from_file(word_bpe())


def test_chunked_ids_equal_the_tokenizers(full, corpus):
    encoder, rng = Encoder(word_bpe(), keep=50), random.Random(2)
    texts = [t for _, t, *_ in corpus if t] + ["<|endoftext|> Hi<|startoftext|>x", "Café DÉJÀ vu's can't WE'LL 12345 don’t", "a\x1cb\x85c\xa0d İ ΣΑΣ ŉx ſt × ÷ ǅ", "日本語 １２３ ½"]
    texts += ["".join(rng.choice("abAB' .,!19\n\té́ÉßİΣσ <|>日ſǅ\x1c ŉ×") for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == full.encode(t, add_special_tokens=False).ids


def test_words_of_many_texts_are_encoded_once(full, corpus):
    texts = [None, "", " \t", "\x0b a  a ", "a\x1cb\x85c"] + [t for _, t, *_ in corpus]
    encoder, asked = Encoder(word_bpe(), keep=50), []
    learn = encoder._learn
    encoder._learn = lambda found: asked.extend(found) or learn(found)
    for t, ids in zip(texts, encoder.encode_all(pa.array(texts, pa.string())), strict=True):
        assert ids.tolist() == full.encode(t or "", add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) == len({w for t in texts for w in (t or "").encode().split()})


def test_pieces_of_many_words_are_merged_once(full):
    texts = ["zorble Zorble. (zorble) ZORBLE,", "zörble's zorble <|endoftext|> 日zorble", "Zörble! zorble-zorble"]
    encoder, asked = Encoder(word_bpe()), []
    model = encoder.model
    encoder.model = SimpleNamespace(tokenize=lambda piece: asked.append(piece) or model.tokenize(piece))
    for t, ids in zip(texts, encoder.encode_all(pa.array(texts)), strict=True):
        assert ids.tolist() == full.encode(t, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) and "zorble" in asked


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["aa", None, "é", "x" * 9, "", "b"]})
    assert [b.column("text").to_pylist() for b in sized(iter([batch]), "text", 4)] == [["aa", None, "é"], ["x" * 9], ["", "b"]]


def replay(plan, sizes):
    """Every piece's place by the plan's lines; checks that sequences are gapless and within capacity."""
    bins, used = defaultdict(list), Counter()
    for length, rank, copies, first, offset in plan.lines:
        used[length] = max(used[length], rank)
    for length, n in sizes.items():
        lines = sorted(x for x in plan.lines if x[0] == length)
        for r in range(n):
            _, rank, copies, first, offset = max(x for x in lines if x[1] <= r)
            bins[first + (r - rank) // copies].append((offset + (r - rank) % copies * length, length))
    for content in bins.values():
        content.sort()
        assert all(a == sum(n for _, n in content[:i]) for i, (a, _) in enumerate(content))
        assert sum(n for _, n in content) <= plan.capacity
    return bins


@pytest.mark.parametrize("method", [packing.match_large, packing.best_fit_decreasing])
@pytest.mark.parametrize("seed", range(12))
def test_plans(method, seed):
    rng = random.Random(seed)
    capacity = rng.choice((7, 30, 100))
    sizes = {n: rng.choice((1, 2, 3, 50)) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(25, capacity)))}
    bins = replay(method(sizes, capacity), sizes)
    total = sum(n * c for n, c in sizes.items())
    assert len(bins) >= -(-total // capacity)
    if method is packing.match_large:
        assert all(sum(3 * n > capacity for _, n in b) <= 2 for b in bins.values())


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_decreasing_is_the_textbook_one(seed):
    rng = random.Random(seed)
    sizes = Counter(rng.randint(1, 60) for _ in range(120))
    gaps = []
    for n in sorted(sizes.elements(), reverse=True):
        fit = [i for i, g in enumerate(gaps) if g >= n]
        if fit:
            gaps[min(fit, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(60 - n)
    plan = packing.best_fit_decreasing(sizes, 60)
    assert plan.sequences == len(gaps)


def test_capacity_tree():
    tree, held = packing.CapacityTree(50), set()
    rng = random.Random(4)
    for _ in range(300):
        gap = rng.randint(1, 50)
        tree.add(gap, -1 if gap in held else 1)
        held ^= {gap}
        need = rng.randint(1, 50)
        assert tree.least(need) == min((g for g in held if g >= need), default=None)


def test_pack_documents(docs, corpus, full):
    rows = packing.pack(docs, word_bpe()).collect()
    ids = lambda t: np.array(full.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
    want = Counter()
    for i, t, *_ in corpus:
        x = ids(t)
        want.update((i, p, p * 4096, len(x[p * 4096 : (p + 1) * 4096]), zlib.crc32(x[p * 4096 : (p + 1) * 4096].tobytes())) for p in range(-(-len(x) // 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert all(a == sum(n for _, n in s[:i]) for i, (a, _) in enumerate(s)) and sum(n for _, n in s) <= 4096
    assert len(seqs) == -(-sum(r.length for r in rows) // 4096)


def test_matrices_round_trip(docs, corpus, full):
    rows = packing.packed_matrices(docs, word_bpe(), 512).collect()
    got = defaultdict(list)
    for r in rows:
        ids, pos = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(pos) == 512 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
            got[d].append((s, ids[a:b].tolist()))
    want = defaultdict(list)
    for i, t, *_ in corpus:
        x = full.encode(t or "", add_special_tokens=False).ids + [1]
        want[i] += [(s, x[s : s + 512]) for s in range(0, len(x), 512)]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_matrices_written_and_read(spark, docs, full, tmp_path):
    made = packing.packed_matrices(docs, word_bpe(), 512)
    rows = {r.sequence_id: r for r in made.collect()}
    for _ in range(2):
        packing.write_matrices(made, f"{tmp_path}/m", 512, rows_per_file=10)
    back = packing.read_matrices(spark, f"{tmp_path}/m")
    assert {r.sequence_id: r for r in back.collect()} == rows and back.schema == made.schema
    meta = spark.read.json(f"{tmp_path}/m/meta").first()
    assert (meta.sequences, meta.tokens, meta.capacity, meta.id_bytes, meta.position_bytes) == (len(rows), sum(r.n_tokens for r in rows.values()), 512, 2, 2)
    files = sorted((tmp_path / "m/rows").glob("*.parquet"))
    assert len(files) >= len(rows) / 10
    seen = []
    for file in files:
        table = pq.read_table(file).combine_chunks()
        for batch in table.to_batches():
            ids, places, ends = packing.as_arrays(batch, 512)
            own = batch.column("sequence_id").to_pylist()
            assert own == sorted(own) and len(own) <= 10
            for i, s in enumerate(own):
                assert ids[i].tobytes() == rows[s].ids and ends[i].tolist() == rows[s].cu_seqlens
                assert places[i][: rows[s].n_tokens].tolist() == [k for a, b in zip(ends[i], ends[i][1:]) for k in range(b - a)]
            seen += own
    assert sorted(seen) == sorted(rows)


def test_empty(none):
    assert packing.pack(none, word_bpe()).count() == 0
    assert packing.packed_matrices(none, word_bpe()).count() == 0


def test_pipeline(spark, tmp_path, corpus, full):
    """Every row of run() against brute-force versions of its stages."""
    import corpus_pipeline
    import zstandard
    from docketlake.llm import quality
    from test_dedup import WORD, jaccard
    from test_rules import brute_hits

    rng = random.Random(9)
    base = [f"w{rng.randrange(1 << 30)}" for _ in range(300)]
    near = [" ".join(base), " ".join(base[:150] + ["x"] + base[151:]), " ".join(w if i % 9 else "y" for i, w in enumerate(base))]
    rows = [r for r in corpus if r[0] is not None and r[0] != 5] + [(1000 + i, t, "en", "src0", len(t)) for i, t in enumerate(near)]
    def good(text):
        raw, words = (text or "").encode(), WORD.findall(text or "")
        grams = Counter(zip(words, words[1:], words[2:]))
        again = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        if len(words) < 50 or 2 * len(again) > len(words):
            return False
        press, x, low, high = zstandard.ZstdCompressor(level=3), *zip(*knots)
        within = lambda p: np.interp(np.log2(len(p)), x, low) <= len(press.compress(p)) / len(p) <= np.interp(np.log2(len(p)), x, high)
        parts = [raw[max(0, e - 4096) : e] for e in (*range(4096, len(raw), 4096), len(raw))]
        return within(raw) and 4 * sum(not within(p) for p in parts) <= len(parts)

    # the pipeline fits its bands on rows that stay as they are below
    marked = [(r[0], 1) for r in rows[:50]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    knots = quality.fit_bands(table, spark.createDataFrame(marked, "doc_id long, quality int")).knots
    part = next(x for r in rows[:60] if len(w := WORD.findall(r[1] or "")) > 120 and good(r[1]) and good(x := " ".join(w[: len(w) * 2 // 3])))
    rows += [(2000, part, "en", None, 1), (2001, rows[62][1] + "\n" + rows[63][1], "en", None, 1)]
    bench = [(1, " ".join(WORD.findall(next(r[1] for r in rows[30:] if good(r[1])))[2:30])), (2, "nothing here of any kind at all in this corpus of ours"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(marked, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")

    kept = {r[0]: r[1] for r in rows if good(r[1])}
    root = {i: i for i in kept}
    for a in sorted(kept):
        for b in kept:
            if a < b and root[a] != root[b] and jaccard(kept[a], kept[b]) >= 0.8:
                root = {k: min(root[a], root[b]) if r in (root[a], root[b]) else r for k, r in root.items()}
    kept = {i: kept[i] for i in sorted(kept) if root[i] == i}
    first, gone = {}, {}
    for i, text in kept.items():
        words = WORD.findall(text)
        gone[i] = {j for k in range(len(words) - 49) if first.setdefault(tuple(words[k : k + 50]), i) < i for j in range(k, k + 50)}
    stripped = {}
    for i, text in kept.items():
        spans = [m.span() for m in WORD.finditer(text)]
        runs, last = [], None
        for j, (a, b) in enumerate(spans):
            if j not in gone[i]:
                runs = [*runs[:-1], (runs[-1][0], b)] if last == j - 1 else [*runs, (a, b)]
                last = j
        if runs:
            stripped[i] = " ".join(text[a:b] for a, b in runs) if gone[i] else text
    clean = {i: t for i, t in stripped.items() if not brute_hits(t, [(str(k), t) for k, t in bench if k])[-1]}
    want = Counter()
    for i, t in clean.items():
        ids = np.array(full.encode(t, add_special_tokens=False).ids + [1], "<u4")
        want.update((i, p, p * 4096, len(x), zlib.crc32(x.tobytes())) for p in range(-(-len(ids) // 4096)) for x in [ids[p * 4096 : (p + 1) * 4096]])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    assert len(rows) > len({i for i in root}) > len(kept) > len(stripped) and any(gone[i] for i in stripped) and len(stripped) > len(clean) > 10
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    assert all(a == sum(n for _, n in s[:k]) and a + n <= 4096 for s in map(sorted, places.values()) for k, (a, n) in enumerate(s))
