"""Exact dedup and centroid clustering against brute force."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from docketlake.llm import exact, orchard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def brute_classes(corpus):
    groups = defaultdict(list)
    for doc_id, text, *_ in corpus:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    rows = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            rows.append((i, keep, len(ids), first, sha))
            first = False
    return sorted(map(str, rows))


@pytest.mark.parametrize("digest", (exact.sha256, lambda t: F.pmod(F.xxhash64(t), F.lit(3)), lambda t: F.lit(0)))
def test_classes(spark, docs, corpus, digest):
    rows = exact.exact_duplicates(docs, salts=2, digest=digest).collect()
    assert sorted(str(tuple(r)) for r in rows) == brute_classes(corpus)


def test_hot_group_and_spaces(spark):
    rows = [(i, " same\t\ntext ") for i in range(300, 0, -1)] + [(0, "same text"), (None, "\nsame text\n"), (None, None), (None, ""), (7, " "), (7, "  ")] + [(9, "again")] * 25_000
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(str(tuple(r)) for r in exact.exact_duplicates(table, salts=3).collect()) == brute_classes(rows)
    kept = exact.keep_first(table.withColumn("keep_id", F.lit("own"))).collect()
    # texts: empty, "same text" without and with blanks at its ends, one blank, "again"
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.keep_id) for r in kept) == [(i, "own") for i in (-1, 0, 1, 7, 9)]
    assert sum(r.doc_id == 9 for r in kept) == 1


def test_keep_first(spark, docs, corpus):
    kept = exact.keep_first(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in corpus})


def test_empty_tables(spark, none):
    assert exact.exact_duplicates(none).collect() == [] and exact.keep_first(none).collect() == []
    assert orchard.cluster_report(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def brute_clusters(rows, k, rounds, size):
    table = [(i, tuple(math.floor(1024 * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in table if i is not None)[:k]
    centroids = [x for _, x in first]
    far = lambda x, c: sum((p - q) ** 2 for p, q in zip(x, c))
    near = lambda x: min((far(x, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, x in table:
            members[near(x)[1]].append(x)
        centroids = [tuple(sum(col) // len(members[j]) for col in zip(*members[j])) if members[j] else c for j, c in enumerate(centroids)]
    found = [(i, *near(x)[::-1]) for i, x in table]
    inertia = defaultdict(int)
    for _, j, d in found:
        inertia[j] += d
    return sorted(str((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())) for i, j, d in found)


@pytest.mark.parametrize(("k", "size"), ((8, 64), (5, 3), (1, 2)))
def test_clusters(spark, k, size):
    rng = random.Random(k)
    rows = [(i, [rng.choice((-1.5, 0.25, 2.0)) + rng.gauss(0, 0.3) for _ in range(size)]) for i in range(150)]
    rows += [rows[3], rows[3], (None, rows[5][1]), (900, None), (901, [0.5] * (size + 1)), (902, [None] + [1.0] * (size - 1)), (903, [float("nan")] * size), (904, [float("inf")] * size), (905, []), (906, [0.0] * size), (907, [0.0] * size)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).repartition(3)
    assert sorted(str(tuple(r)) for r in orchard.cluster_report(table, k=k, rounds=10, size=size).collect()) == brute_clusters(rows, k, 10, size)


def test_fewer_vectors_than_centroids(spark):
    rows = [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [4.0, -1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(str(tuple(r)) for r in orchard.cluster_report(table, k=8, size=2).collect()) == brute_clusters(rows, 8, 10, 2)


def test_components_beyond_a_long_raise(spark):
    table = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        orchard.cluster_report(table, size=2).collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-6, 6)] * 2), min_size=1, max_size=12), st.lists(st.tuples(*[st.integers(-8, 8)] * 2), min_size=1, max_size=20), st.data())
def test_orchard_search(centroids, vectors, data):
    """Ties and equal centroids on a small grid, from any start, where many vectors lie at exactly half a distance."""
    c, x = np.array(centroids, np.int64), np.array(vectors, np.int64)
    start = np.array(data.draw(st.lists(st.integers(0, len(c) - 1), min_size=len(x), max_size=len(x))), np.int64)
    near, far = orchard.Lists.of(c).nearest(x, start)
    d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(-1)
    assert near.tolist() == d.argmin(1).tolist() and far.tolist() == d.min(1).tolist()
