"""Fingerprints against a plain version of their definition."""

import hashlib
import random

import pytest
import xxhash

from worksight.llm import fingerprints
from worksight.llm.fingerprints import PARTS, K, S

FIELDS = "doc_id long, text string, fingerprint string"


def value(data):
    h = xxhash.xxh64(data, seed=42).intdigest()
    return h - (1 << 64) if h >= 1 << 63 else h


def brute_anchors(text):
    """(hash, position) of the k-mers whose least inner hash lies at an edge."""
    data = text.encode()
    out = []
    for i in range(len(data) - K + 1):
        inner = [value(data[i + j : i + j + S]) for j in range(K - S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((value(data[i : i + K]), i))
    if data and not out:
        out = [(value(data), 0)]
    return [((h & (1 << 64) - 1) >> 32 | 1 << 31, p) for h, p in out]


def brute_print(text):
    found = brute_anchors(text)
    return "".join(f"{h:08x}{min(255, p - q):02x}" for (h, p), (_, q) in zip(found, [(0, 0), *found]))


def brute_likeness(one, two):
    sides = [(brute_anchors(t), len(t.encode())) for t in (one, two)]
    if not any(found for found, _ in sides):
        return 1.0
    longer = max(1, *(n for _, n in sides))
    scores = []
    for place in (lambda p, n: p, lambda p, n: n - p):
        a, b = ({(h, place(p, n) * PARTS // longer) for h, p in found} for found, n in sides)
        scores.append(len(a & b) / len(a | b))
    return max(scores)


def chosen_texts():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9)))
    texts = ["", None, "x", "é漢😀 b", " \n\t ", "y" * 700, "ab" * 300, "".join(chr(0x4E00 + r.randrange(900)) for _ in range(600))]
    texts += [" ".join(word() for _ in range(r.randint(1, 200))) for _ in range(60)]
    line = " ".join(word() for _ in range(12))
    return [*texts, texts[20], "\n".join([line] * 9), "\n".join([line, texts[21], line]), "z" * 27, "z" * 28, "".join(chr(97 + i % 26) for i in range(40))]


@pytest.mark.parametrize("rows_a_bucket", [3, 2000])
def test_edited_fingerprints_equal_the_definition(spark, monkeypatch, rows_a_bucket):
    monkeypatch.setattr(fingerprints, "ROWS", rows_a_bucket)
    rows = [(i * 7 - 3, t, "f") for i, t in enumerate(chosen_texts())] + [(2**62, "far above", "f"), (-(2**63), "least", "f")]
    df = spark.createDataFrame(rows, FIELDS)
    got = {x.doc_id: x for x in fingerprints.edited_fingerprints(df.repartition(5)).collect()}
    order = sorted(((d, t or "") for d, t, _ in rows), reverse=True)
    assert len(got) == len(rows)
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        edited = t[: len(t) - k] + n[:k]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (brute_print(t), brute_print(edited))
        assert got[d].near_edited == pytest.approx(brute_likeness(t, edited))
        assert got[d].near_next == pytest.approx(brute_likeness(t, n))


def test_long_texts_in_pieces_equal_the_definition(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "CHUNK", 50)
    df = spark.createDataFrame([(i, t or "", "") for i, t in enumerate(chosen_texts())], FIELDS)
    got = {x.doc_id: x for x in fingerprints.fingerprints(df).collect()}
    assert {d: x.fingerprint for d, x in got.items()} == {i: brute_print(t or "") for i, t in enumerate(chosen_texts())}
    assert all(x.n_anchors == len(x.fingerprint) / 10 for x in got.values())


def test_edits_without_spaces_and_order(spark):
    r = random.Random(3)
    han = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(600))
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    halves = letters[1500:] + letters[:1500]
    parts = [letters[i : i + 300] for i in range(0, 3000, 300)]
    mixed = "".join(parts[i] for i in (7, 2, 9, 0, 5, 3, 8, 1, 6, 4))
    rows = [(9, "一" + han), (8, han), (7, "q" + letters), (6, letters), (5, halves), (4, letters), (3, mixed), (2, letters), (1, letters)]
    df = spark.createDataFrame([(d, t, "") for d, t in rows], FIELDS)
    near = {x.doc_id: x.near_next for x in fingerprints.edited_fingerprints(df).collect()}
    assert near[9] > 0.9 and near[7] > 0.9 and near[2] == 1.0
    assert near[8] < 0.05 and near[5] < 0.4 and near[3] < 0.5


def test_repeats_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c", ""), (1, "a b c", ""), (None, "q", ""), (None, None, ""), (1, "other", "")], FIELDS)
    got = fingerprints.edited_fingerprints(df).collect()
    assert sorted((x.doc_id or 0, x.n_chars) for x in got) == [(0, 0), (0, 1), (1, 5), (1, 5), (1, 5)]
    assert fingerprints.edited_fingerprints(df.where("false")).count() == 0
    assert fingerprints.fingerprints(df.where("false")).count() == 0
    one = fingerprints.edited_fingerprints(df.where("text = 'other'")).first()
    assert (one.edited_sha256, one.near_next) == (hashlib.sha256(b"otheo").hexdigest(), 1.0)


def test_one_id_for_many_rows_is_dealt_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS", 10)
    df = spark.range(400).selectExpr("case when id < 300 then 5 else id end as doc_id", "concat('text number ', id) as text", "'' as fingerprint")
    got = fingerprints.edited_fingerprints(df).select("doc_id", "edited_sha256").collect()
    texts = [(max(5, i) if i >= 300 else 5, f"text number {i}") for i in range(400)]
    order = sorted(texts, key=lambda x: (-x[0], value(x[1].encode())))
    want = sorted((d, hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()) for (d, t), (_, n) in zip(order, order[1:] + order[:1]))
    assert sorted((x.doc_id, x.edited_sha256) for x in got) == want
