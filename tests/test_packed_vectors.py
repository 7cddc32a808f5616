"""Text vectors packed for shuffles: small, and the same neighbours and searches as plain ones."""

import random

import numpy as np
from pyspark.sql import functions as F

from worksight.operators import neighbours, serving, vectors


def texts(spark, n, seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(r.choices(words, k=r.choice([0, 3, 40, 300])))) for i in range(n)]
    rows += [(n + i, rows[i % 5][1]) for i in range(n // 4)] + [(2 * n, "often " * 70_000), (2 * n + 1, None)]
    return spark.createDataFrame(rows, "work_id long, text string").repartition(5)


def test_packed_counts_come_back():
    draw = np.random.default_rng(1)
    rows = [draw.integers(0, 4, 100) * draw.integers(0, most, 100) for most in (2, 60, 300, 1 << 20)] + [np.zeros(100, int)]
    assert (vectors.unpacked([vectors.packed(x) for x in rows], 100) == np.array(rows)).all()
    assert vectors.unpacked([], 100).shape == (0, 100)


def test_packed_vectors_are_small_and_equal_plain_ones(spark):
    df = texts(spark, 120)
    packed, weighed = vectors.packed_vectors(df)
    got = {r.work_id: weighed([r.v])[0] for r in packed.collect()}
    plain = {r.work_id: np.array(r.v) for r in vectors.text_vectors(df).collect()}
    assert got.keys() == plain.keys() and all((got[i] == plain[i]).all() for i in plain)
    assert packed.select(F.max(F.length("v"))).first()[0] <= 1 + 64 + 512  # doubles take 4,096 bytes


def test_neighbours_and_searches_of_packed_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    df = texts(spark, 120)
    packed, weighed = vectors.packed_vectors(df)
    packed, plain = packed.toDF("id", "v"), vectors.text_vectors(df).toDF("id", "v")
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    how = {"list_rows": 20, "probes": 100}
    assert rows(neighbours.neighbours(packed, 4, unpack=weighed, **how)) == rows(neighbours.neighbours(plain, 4, **how))
    ask = lambda x: x.where("id % 3 = 0")
    want = rows(serving.cosine_topk(ask(plain), plain, 6))
    for block in (1 << 15, 16):
        monkeypatch.setattr(serving, "BLOCK", block)
        assert rows(serving.cosine_topk(ask(packed), packed, 6, weighed)) == want


def test_best_rows_over_tiles(monkeypatch):
    monkeypatch.setattr(serving, "TILE", 8)
    draw = np.random.default_rng(4)
    x = draw.normal(size=(90, 12))
    x = np.vstack([x, x[:20]]) / np.linalg.norm(np.vstack([x, x[:20]]), axis=1, keepdims=True)
    ids = np.arange(len(x))
    for k in (1, 5, 30, 200):
        got = serving.nearest(ids[::7], x[::7], ids, x, x.astype(np.float32), k)
        score = np.floor(x[::7] @ x.T * 1e5 + 0.5) / 1e5
        want = [(i, j) for i, s in zip(ids[::7], score) for j in sorted(set(ids) - {i}, key=lambda j: (-s[j], j))[:k]]
        assert list(zip(got.id, got.other)) == want
