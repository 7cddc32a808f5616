"""Importance resampling against a plain version."""

import hashlib
import heapq
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from worksight.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, buckets=10_000):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, targets, percent=5):
    corpus, target = [0] * 10_000, [0] * 10_000
    own = [features(t) for _, t in docs]
    for _, found in own:
        for k in found:
            corpus[k] += 1
    for t in targets:
        for k in features(t)[1]:
            target[k] += 1
    s, t = sum(corpus), sum(target)
    gain = [math.floor(1000 * math.log((target[k] + 1) * (s + 10_000) / ((corpus[k] + 1) * (t + 10_000)))) for k in range(10_000)]
    rows = []
    for (d, _), (n, found) in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[k] for k in found)
        rows.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    eligible = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(eligible[: percent * len(eligible) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def texts(n, seed=3):
    r = random.Random(seed)
    vocabulary = ["Été", "the", "of", "q" * 63, "r" * 64, "s" * 65, "t" * 300, "漢字", "A1", "b"] + [f"w{i}" for i in range(300)]
    return [" ".join(r.choice(vocabulary[: r.choice([10, 60, 310])]) + r.choice(["", ",", "."]) for _ in range(r.randint(0, 70))) for _ in range(n)]


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_draw(spark, monkeypatch, percent):
    monkeypatch.setattr(importance, "PIECE", 7)
    docs = [(i, t) for i, t in enumerate(texts(400))] + [(1000, None), (1001, ""), (None, texts(1, 8)[0] + " x" * 30), (None, "y " * 40), (5, "z " * 25), (5, "z " * 25), (5, "two  rows of one id " * 9), (1002, "long " * 40_000 + "u" * 70_000)]
    targets = [*texts(30, 5), None, "", "w1 w2 w3"]
    df = spark.createDataFrame([(d, t, 9, "a") for d, t in docs], "doc_id long, text string, rank int, score string").repartition(7)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id long, text string")
    got = importance.resampled(df, bench, percent).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, targets, percent)
    again = importance.resampled(df.repartition(2), bench, percent).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_few_rows_and_no_rows(spark):
    df = spark.createDataFrame([(i, "word " * 30) for i in range(19)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = importance.resampled(df, none).collect()
    assert len(got) == 19 and all(x.rank is None for x in got)
    assert sorted(map(tuple, got), key=str) == brute([(i, "word " * 30) for i in range(19)], [])
    assert importance.resampled(df.where("false"), none).count() == 0


def test_ties_go_to_smaller_ids(spark):
    rows = [(score, key) for score in (5, 7) for key in [None, *range(300, 0, -1)]]
    df = spark.createDataFrame([(k, None, 20, 1, 1, s) for s, k in rows], "doc_id long, tag long, n_words long, n_features long, weight long, score long").repartition(5)
    got = {x["rank"]: (x.score, x.doc_id) for x in importance.drawn(df, 60).collect() if x["rank"]}
    want = [(7, k) for k in [*range(1, 301), None]] + [(5, k) for k in range(1, 61)]
    assert got == {i: w for i, w in enumerate(want[: 60 * 602 // 100], 1)}


def test_whole_documents_are_drawn(spark):
    df = spark.createDataFrame([(i % 30, f"text {i % 30} " * 20, "s", 1) for i in range(60)], "doc_id long, text string, source string, draw_rank int")
    got = importance.drawn_documents(df, df.select("text").limit(3), 50).collect()
    assert sorted(x["draw_rank_"] for x in got) == list(range(1, 31))
    assert all(x.text == f"text {x.doc_id} " * 20 and x.source == "s" for x in got)


def test_tournament_merges_runs_that_enter_late():
    r = random.Random(1)
    runs = [sorted((r.randrange(50),) for _ in range(r.randrange(6))) for _ in range(40)]
    tree, out = importance.Tournament(), []
    for run in sorted((x for x in runs if x), key=lambda x: x[0]):
        out += tree.winners(run[0])
        tree.enter(iter(run))
    out += tree.winners()
    assert out == list(heapq.merge(*runs))


def test_query_reads_whole_tables(spark, tmp_path):
    from worksight.llm.queries import op11_importance

    docs, items = list(enumerate(texts(150, 6))), texts(9, 7)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = op11_importance(spark, str(tmp_path))
    assert df.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, df.collect()), key=str) == brute(docs, items)
    assert df.agg(F.max("rank")).first()[0] == sum(features(t)[0] >= 20 for _, t in docs) * 5 // 100
