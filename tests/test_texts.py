"""Text vectors, the neighbour index, distances on the ellipsoid, quantiles by range."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from worksight.functions import geodesic, stats
from worksight.operators import desk, neighbours, pairs, vectors

# Published distances on WGS-84 (or GRS 80, the same to a hundredth of a millimetre).
PUBLISHED = [
    ((-(37 + 57 / 60 + 3.7203 / 3600), 144 + 25 / 60 + 29.5244 / 3600, -(37 + 39 / 60 + 10.1561 / 3600), 143 + 55 / 60 + 35.3839 / 3600), 54972.271),
    ((0.0, 0.0, 0.0, 1.0), 111319.490793),
    ((0.0, 12.0, 90.0, 12.0), 10001965.729),
    ((0.0, 179.5, 0.0, -179.5), 111319.490793),
]


def test_published_distances(spark):
    df = spark.createDataFrame([(*p, m) for p, m in PUBLISHED], "a double, b double, c double, d double, told double")
    for r in df.withColumn("g", geodesic.geodesic("a", "b", "c", "d")).collect():
        assert r.g.converged and abs(r.g.metres - r.told) < 0.001
    odd = spark.createDataFrame([(0.0, 0.0, 0.5, 179.7), (5.0, 6.0, 5.0, 6.0), (91.0, 0.0, 0.0, 0.0), (None, 0.0, 0.0, 0.0)], "a double, b double, c double, d double")
    opposite, same, out_of_range, missing = [r.g for r in odd.withColumn("g", geodesic.geodesic("a", "b", "c", "d")).collect()]
    assert (opposite.converged, opposite.metres) == (False, None) and (same.converged, same.metres) == (True, 0.0)
    assert out_of_range is None and missing is None


def test_search_texts_leave_out_what_is_empty(spark):
    df = spark.createDataFrame([(1, "New  ROAD_bridge!", "Roads", None, "", "D 1", None, "V-2"), (2, None, None, None, None, None, None, None)], "work_id long, description string, sector string, sub_sector string, state string, district string, block string, village string")
    assert [r.text for r in vectors.search_texts(df).orderBy("work_id").collect()] == ["work new road bridge | sector roads | district d 1 | village v 2", ""]


def test_vectors_equal_a_plain_version(spark):
    r = random.Random(2)
    texts = [(i, " ".join(r.choice("abcdefghij") * r.randint(1, 2) for _ in range(r.randint(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (62, "a | a")]
    got = {x.work_id: np.array(x.v) for x in vectors.text_vectors(spark.createDataFrame(texts, "work_id long, text string").repartition(5), 64).collect()}
    slots = lambda t: Counter(int(hashlib.md5(x.encode()).hexdigest()[:3], 16) % 64 for x in (t or "").split() if x != "|")
    held = Counter(s for _, t in texts for s in slots(t))
    assert set(got) == {i for i, t in texts if slots(t)}
    for i, t in texts:
        if i in got:
            v = np.zeros(64)
            for s, n in slots(t).items():
                v[s] = n * (math.log((1 + len(texts)) / (1 + held[s])) + 1)
            assert got[i] == pytest.approx(v / np.linalg.norm(v))
    assert vectors.text_vectors(spark.createDataFrame([], "work_id long, text string")).count() == 0


def brute(rows, k):
    ids, v = [i for i, _ in rows], np.array([x for _, x in rows])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.round(v @ v.T, 6)
    return {i: sorted((-cos[a, b], j) for b, j in enumerate(ids) if j != i)[:k] for a, i in enumerate(ids)}


def found(df, k, **how):
    out = {}
    for x in neighbours.neighbours(df, k, **how).collect():
        out.setdefault(x.id, []).append((-x.cosine, x.other))
    return {i: sorted(x) for i, x in out.items()}


def clustered(n, seed):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(12, 16))
    rows = [(i, (middle[draw.integers(12)] + 0.6 * draw.normal(size=16)).tolist()) for i in range(n)]
    return rows + [(n + i, rows[i % 3][1]) for i in range(n // 3)]  # a quarter are copies of three


def test_index_is_exact_with_as_many_probes_as_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "HOT", 30)
    rows = clustered(300, 5)
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (9999, None), rows[7]], "id long, v array<double>").repartition(6)
    got, want = found(df, 6, list_rows=50, probes=100), brute(rows, 6)
    assert got.keys() == want.keys()
    for i in want:
        assert [(pytest.approx(c, abs=2e-6), j) for c, j in want[i]] == got[i]
    assert neighbours.neighbours(df.where("false"), 3).count() == 0


def test_recall_of_few_probes(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rows = clustered(2400, 6)
    got, want = found(spark.createDataFrame(rows, "id long, v array<double>"), 10, list_rows=50, probes=8), brute(rows, 10)
    hits = sum(len({j for _, j in want[i]} & {j for _, j in got[i]}) for i in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


RECORD = "work_id long, sector string, sub_sector string, state string, district string, block string, village string, latitude double, longitude double, recommended long, sanctioned long, recommended_on date, agency string"


def test_pairs_need_all_that_corroborates(spark):
    from datetime import date

    one = (1, "Roads", "S", "R", "D", "B", "V", 10.0, 75.0, 100, 100, date(2024, 1, 1), "a")
    other = lambda key, **x: tuple(x.get(n, v) for n, v in zip([c.split()[0] for c in RECORD.split(", ")], (key, *one[1:]), strict=True))
    records = spark.createDataFrame([one, other(2, sector=" roads "), other(3, latitude=10.02), other(4, sanctioned=89), other(5, recommended=None, latitude=None)], RECORD)
    near = spark.createDataFrame([(1, k, 0.98) for k in (2, 3, 4, 5)], "a long, b long, cosine double")
    got = {r.b: r for r in pairs.scored_pairs(near, records).withColumn("reasons", pairs.review_reasons()).collect()}
    assert got[2].reasons == [] and got[2].score == pytest.approx(99.0)
    assert got[3].reasons == ["distance"] and got[3].km == pytest.approx(2.2122, abs=1e-3)
    assert got[4].reasons == [] and got[4].amount == pytest.approx(0.6 + 0.4 * 0.89)
    assert got[5].reasons == ["distance"] and got[5].amount == 1.0 and got[5].km is None
    second = {r.b: r.review for r in pairs.corroborated_pairs(near, records).collect()}
    assert second == {2: False, 3: False, 4: False, 5: False}  # the second profile compares sectors as they are written
    best = {r.id: r for r in pairs.best_candidates(spark.range(1, 7), pairs.corroborated_pairs(near, records.replace(" roads ", "Roads"))).collect()}
    assert (best[1].has_candidate, best[1].best, best[6].best, best[6].has_candidate) == (True, 2, None, False)


def test_similar_works(spark):
    from datetime import date

    rows = [(k, "Roads", "S", "R", d, "B", "V", lat, 75.0, cost, 1, date(2024, 1, 1), "a") for k, d, lat, cost in [(1, "D", 10.0, 100), (2, "D", 30.0, 90), (3, "E", 10.01, 90), (4, "E", 30.0, 90), (5, "D", 10.0, 100)]]
    near = spark.createDataFrame([(1, 2, 0.9, 1), (1, 3, 0.8, 2), (1, 4, 0.7, 3), (1, 5, 0.2, 4)], "query_id long, chunk_id long, score double, place int")
    got = {r.work_id: (r.nth, r.match) for r in desk.similar_works(near, spark.createDataFrame(rows, RECORD), 4).collect()}
    assert got == {2: (1, "High"), 3: (2, "High"), 4: (3, "Possible"), 5: (4, "Possible")}


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_quantiles_by_range(spark, monkeypatch, few):
    monkeypatch.setattr(stats, "FEW", few)
    r = random.Random(8)
    rows = [(r.choice(["a"] * 9 + ["b", None]), r.choice([None, r.gauss(0, 5), float(r.randint(0, 3))])) for _ in range(700)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    got = {x.k: x for x in stats.spread(df, ["k"], "x", {"q10": 0.1, "q75": 0.75}).collect()}
    for k in {k for k, _ in rows} - {"none"}:
        own = np.array([x for q, x in rows if q == k and x is not None])
        assert [got[k].n, got[k].q10, got[k].median, got[k].q75, got[k].mad] == pytest.approx([len(own), *np.quantile(own, [0.1, 0.5, 0.75]), np.median(np.abs(own - np.median(own)))])
    assert "none" not in got
    ranked = stats.ranking(spark.createDataFrame([(1, 0.1), (0, 0.1), (1, 0.9), (0, 0.3), (1, 0.3)], "y int, s double"), "s", "y", []).first()
    assert ranked.roc_auc == pytest.approx((0.5 + 2 + 1.5) / 6) and ranked.average_precision == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)
    assert stats.quantiles(df.where("false"), ["k"], "x", {"m": 0.5}).count() == 0 and F is not None
