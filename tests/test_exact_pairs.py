"""The second profile's pairs come from all pairs of vectors, however many lists an index would have."""

import numpy as np
import pytest

from tests.test_texts import brute, clustered
from worksight.operators import neighbours, serving
from worksight.plans import register, texts


@pytest.mark.parametrize("k", [1, 6])
def test_exact_pairs_equal_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(neighbours, "LEAST", 32)
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    monkeypatch.setattr(neighbours, "TILE", 16)
    monkeypatch.setattr(serving, "TILE", 8)
    rows = clustered(300, 7)
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (9999, None), rows[7]], "id long, v array<double>").repartition(6)
    got = {}
    for r in neighbours.directed(df, k, exact=True).collect():
        got.setdefault(r.id, []).append((-r.cosine, r.other))
    want = brute(rows, k)
    assert got.keys() == want.keys()
    for i in want:
        assert [(pytest.approx(c, abs=2e-6), j) for c, j in want[i]] == sorted(got[i])
    assert neighbours.directed(df.where("false"), k, exact=True).count() == 0


def test_second_pairs_miss_none(spark, monkeypatch):
    draw = np.random.default_rng(9)
    packed = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x / np.linalg.norm(x) for x in draw.normal(size=(400, 12)))], "work_id long, v binary")
    monkeypatch.setattr(register, "description_vectors", lambda spark, d: (packed, neighbours.of_bytes))
    monkeypatch.setattr(neighbours, "centres", lambda distinct, n, unpack, list_rows: unpack([r.v for r in distinct.limit(40).collect()]))  # an index of 40 lists
    monkeypatch.setattr(texts.pairs, "corroborated_pairs", lambda near, records: near)
    monkeypatch.setattr(texts.domain, "register", lambda spark, d: packed.withColumnRenamed("v", "description"))
    got = {(r.a, r.b) for r in texts.second_pairs(spark, "").collect()}
    rows = [(r.work_id, neighbours.of_bytes([r.v])[0]) for r in packed.collect()]
    assert got == {(min(i, j), max(i, j)) for i, near in brute(rows, 5).items() for _, j in near}
