"""Removal of repeated passages against a plain version."""

import random
import re

import pytest
from pyspark.sql import functions as F

from worksight.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, length=20):
    key = lambda d: (d is None, d or 0)
    texts = [(d, WORD.findall(t or "")) for d, t in docs]
    first = {}
    for d, w in texts:
        for i in range(len(w) - length + 1):
            s = tuple(w[i : i + length])
            first[s] = min(first.get(s, (key(d), i)), (key(d), i))
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (key(d), i):
                gone |= set(range(i, i + length))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def corpus(seed, n):
    r = random.Random(seed)
    fresh = lambda k: [f"w{r.randrange(10**9)}" if r.random() < 0.7 else r.choice("abc") for _ in range(k)]
    shared = [fresh(r.randint(15, 70)) for _ in range(12)]
    line = fresh(14)
    docs = []
    for d in range(n):
        parts = fresh(r.randint(0, 30))
        for _ in range(r.randint(0, 4)):
            p = r.choice(shared)
            at = r.randrange(10)
            parts += p[at : len(p) - r.randrange(10)] + fresh(r.choice([0, 1, 3, 25])) + (line if r.random() < 0.3 else [])
        docs.append((d, r.choice([" ", "\n", "\t  "]).join(parts)))
    docs += [(d + 5000, docs[r.randrange(n)][1]) for d in range(n // 5)]
    docs += [(7000, "same " * 57), (7001, "same " * 19), (7002, "Same " * 20 + "same " * 20), (7003, "x y " * 40 + " ".join(shared[0])), (7004, None), (7005, ""), (7006, " ".join(shared[1]).upper() + " é漢字 " * 30)]
    docs += [(None, " ".join(shared[2])), (None, " ".join(shared[2])), (None, "new " + " ".join(shared[3])), (3, " ".join(shared[4])), (3, "moved " + " ".join(shared[4])), (3, " ".join(shared[4]))]
    return docs


@pytest.mark.parametrize("bucket_bytes,slice_rows,resolve", [(4 << 20, 1024, 50_000), (1500, 1024, 3), (4000, 2, 10), (700, 1, 1)])
def test_removed_words(spark, monkeypatch, bucket_bytes, slice_rows, resolve):
    monkeypatch.setattr(repeats, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(repeats, "SLICE", slice_rows)
    monkeypatch.setattr(repeats, "RESOLVE", resolve)
    docs = corpus(slice_rows, 120)
    df = spark.createDataFrame([(d, t, 5, "z") for d, t in docs], "doc_id long, text string, start int, bucket string").repartition(5)
    assert sorted(map(tuple, repeats.without_repeats(df).collect()), key=str) == brute(docs)


def test_other_lengths_tags_and_empty_tables(spark):
    docs = corpus(9, 60)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.monotonically_increasing_id())
    got = repeats.without_repeats(df, length=8, tag="key").collect()
    assert sorted((tuple(x)[:4] for x in got), key=str) == brute(docs, 8)
    assert len({x.key for x in got}) == len(docs)
    assert repeats.without_repeats(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        repeats.without_repeats(df, length=7)


def test_long_text_and_many_copies(spark):
    r = random.Random(4)
    long = " ".join(f"u{r.randrange(10**7)}" for _ in range(150_000))
    passage = " ".join(f"p{i}" for i in range(55))
    docs = [(0, long), (1, "head " + long[: len(long) // 2])] + [(i, f"n{i} {passage} m{i}") for i in range(2, 3000)]
    got = {x.doc_id: x for x in repeats.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert (got[0].n_removed, got[1].kept_text.split()[0]) == (0, "head") and got[1].n_words - got[1].n_removed <= 2
    assert got[2].n_removed == 0 and all(got[i].kept_text == f"n{i} m{i}" for i in range(3, 3000))


def test_automaton_finds_each_longest_run():
    r = random.Random(6)
    for size in (3, 400):
        for _ in range(60):
            words = [str(r.randrange(size)).encode() for _ in range(400)]
            at = [r.randrange(300) for _ in range(4)]
            tree = repeats.Automaton([(words[a : a + r.randint(8, 60)], (0, 0, 0)) for a in at], 8)
            text = words[50:90] + [b"-"] + words[r.randrange(200) :][:150]
            found = {(k, b, a, n) for k, b, a, n in tree.find(text)}
            want = set()
            for k, (own, _) in enumerate(tree.passages):
                for a in range(len(text)):
                    for b in range(len(own)):
                        if text[a] == own[b] and (not a or not b or text[a - 1] != own[b - 1]):
                            n = 0
                            while a + n < len(text) and b + n < len(own) and text[a + n] == own[b + n]:
                                n += 1
                            if n >= 8:
                                want.add((k, b, a, n))
            assert found == want
