"""Cross-tokenizer alignment against whole-text encoding and plain intersection of ends."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from docketlake.llm import alignment
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "a", " ", "  two  blanks ", "\nline", "end.\n\nNext \n line\n", "tab\tand\x0bfeed\x0c", "it's 12,345.67 we'll?!", "<s> </s> <|endoftext|> <unk> <0x0A>",
    "naïve façade Straße œuvre", "日本語のテキスト。中文", "😀 family 👩‍👩‍👧", "a▁b", "▁", "nul\0byte", "é combining ́", "\xa0nbsp wide　", "word" * 400, "١٢٣ العربية", "x\r\ny", "don't,", "a.b.c, d;", "Ünï.",
]


@pytest.fixture(scope="module")
def models():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    table = alignment.byte_letters()
    shown = {v: k for k, v in table.items()}
    return a, b, shown


def brute(models, text):
    """(groups of ids, links) of whole-text encodings, cut at the ends that both have; None without tokens."""
    a, b, shown = models
    if not text:
        return None
    whole = a.encode(" " + text, add_special_tokens=False)
    ids_a, ids_b = whole.ids, b.encode(text)
    bytes_a = [bytes(shown[c] for c in t) for t in whole.tokens]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    raw = (" " + text).encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return None
    spans = []
    for parts in (bytes_a, bytes_b):
        ends = [0]
        for p in parts:
            ends.append(ends[-1] + len(p))
        spans.append(list(zip(ends, ends[1:])))
    common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, links, at = [], [], [0, 0]
    for end in common:
        own = []
        for side, (ids, span) in enumerate(zip((ids_a, ids_b), spans)):
            own.append([])
            while at[side] < len(span) and span[at[side]][1] <= end:
                own[side].append((ids[at[side]], *span[at[side]]))
                at[side] += 1
        groups.append(tuple([i for i, *_ in tokens] for tokens in own))
        links += [(x, y) for x, s, e in own[0] for y, t, u in own[1] if s < u and t < e]
    return groups, links, len(ids_a), len(ids_b)


def spelt(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))
def test_leaves_are_the_cuts(x, y):
    a, b = sorted(x | {61}), sorted(y | {61})
    found = alignment.leaves(a, b)
    cuts = sorted(set(a) & set(b))
    assert [a[i_end - 1] for _, i_end, _, _ in found] == [b[j_end - 1] for *_, j_end in found] == cuts
    assert [i for i, *_ in found] == [0, *[i_end for _, i_end, _, _ in found[:-1]]]
    pairs = {p for leaf in found for p in alignment.links(a, b, leaf)}
    assert pairs == {(i, j) for i in range(len(a)) for j in range(len(b)) if ([0, *a][i] < b[j]) and ([0, *b][j] < a[i])}


@pytest.mark.parametrize("keep", (2, 500_000))
def test_stretches_equal_whole_texts(models, corpus, keep):
    texts = [*ODD, *[t for _, t, *_ in corpus if t and len(t) < 20_000], *[f"{x}{y}{x}" for x in ODD[:8] for y in ODD]]
    own = alignment.Aligner(A, B, keep)
    for _ in range(3):
        found = own.align(texts)
        for text, got in zip(texts, found):
            want = brute(models, text)
            assert (got and (got[0], got[1].decode())) == (want and (want[2], spelt(want[0]))), text


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab cé.\n',!▁\t1日\xa0 "), max_size=24))
def test_any_text_equals_whole_text(models, text):
    own = alignment.Aligner.of(A, B)
    want = brute(models, text)
    got = own.align([text])[0]
    assert (got and got[1].decode()) == (want and spelt(want[0]))


@pytest.mark.parametrize("max_pairs", (2_000_000, 15_000))
def test_counts(spark, docs, corpus, models, max_pairs):
    rows = alignment.alignment_counts(docs, A, B, max_pairs).collect()
    found = [brute(models, t) for _, t, *_ in corpus]
    n = Counter(p for f in found if f for p in set(f[1]))
    most = defaultdict(int)
    for (x, _), c in n.items():
        most[x] = max(most[x], c)
    want = []
    for (doc_id, *_), f in zip(corpus, found):
        if f is None:
            want.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links, n_a, n_b = f
        want.append((doc_id, n_a, n_b, len(groups), len(links), sum(n[p] == most[p[0]] for p in links), sum(n[p] for p in links), hashlib.sha256(spelt(groups).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows)


def test_groups(spark, models):
    text = random.Random(3).choice(ODD[6:8])
    row = alignment.alignments(spark.createDataFrame([(1, text, "x"), (2, None, "x")], "doc_id long, text string, groups string"), A, B).orderBy("doc_id").collect()
    assert [(g.a, g.b) for g in row[0].groups] == brute(models, text)[0]
    assert row[1].groups is None


def test_empty_table(none):
    assert alignment.alignment_counts(none, A, B).collect() == []


def test_tasks_send_counts_on_when_full(spark, docs):
    shift = 15
    table = alignment.saved(alignment.aligned(alignment.text_table(docs), A, B))
    assert sorted(alignment.pair_counts(table, shift, 50).collect()) == sorted(alignment.pair_counts(table, shift).collect())


@pytest.mark.parametrize("block", (3, 8192))
def test_stretches_are_divided_together(models, corpus, monkeypatch, block):
    texts = [*ODD, *[t for _, t, *_ in corpus[:40] if t and len(t) < 20_000]]
    own, asked, divided = alignment.Aligner(A, B, block=block), [], alignment._divided
    monkeypatch.setattr(alignment, "_divided", lambda a, b: asked.append(len(a)) or divided(a, b))
    for text, got in zip(texts, own.align(texts), strict=True):
        want = brute(models, text)
        assert (got and (got[0], got[1].decode(), len(got[2]) // 8)) == (want and (want[2], spelt(want[0]), len(want[1]))), text
    if block > 3:
        assert len(asked) < 20 + len(ODD) and max(asked) > 1000
