"""Token counts, mixing, languages, quality."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from worksight.llm import language_id, mixing, quality, token_counts

DOCS = "doc_id long, text string, source string, lang string, size string"


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_counts_are_the_librarys(spark, tokenizer):
    from tokenizers import Tokenizer

    r = random.Random(3)
    pool = "aZé ñ\t\n\r\x0b\x1c\x1f\x85\xa0  　'\"s'll've<|endoftext|>123٣½.,;!?-_😀漢字́​\x00"
    texts = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "it's  we'll\n\n x", " " * 50, "x" * 3000, "don't 'Stop'"]
    texts += ["".join(r.choice(pool) for _ in range(r.randint(1, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "s", "en", "z") for i, t in enumerate(texts)] + [(None, None, None, None, None)], DOCS)
    got = {r.doc_id: r for r in token_counts.token_counts(df, tokenizer, sample=50).collect()}
    want = Tokenizer.from_file(tokenizer).encode_batch(texts, add_special_tokens=False)
    assert [got[i].n_tokens for i in range(len(texts))] == [len(w) for w in want]
    assert [got[i].n_bytes for i in range(len(texts))] == [len(t.encode()) for t in texts]
    assert (got[None].n_bytes, got[None].n_tokens, got[None].over_limit) == (0, 0, False)
    assert token_counts.token_counts(df.where("false"), tokenizer).count() == 0


def test_other_tokenizers_are_refused(tokenizer):
    from tokenizers import AddedToken, Tokenizer, normalizers, pre_tokenizers

    def changed(**steps):
        t = Tokenizer.from_file(tokenizer)
        for name, value in steps.items():
            setattr(t, name, value)
        return t

    token_counts.checked(changed())
    stripped = changed()
    stripped.add_special_tokens([AddedToken("<x>", lstrip=True)])
    for t in (changed(normalizer=normalizers.NFC()), changed(pre_tokenizer=pre_tokenizers.Whitespace()), changed(pre_tokenizer=pre_tokenizers.ByteLevel(add_prefix_space=True)), stripped):
        with pytest.raises(token_counts.TokenizerError):
            token_counts.checked(t)


def test_repeats_and_long_texts_are_counted(spark, tokenizer):
    from tokenizers import Tokenizer

    texts = ["word and more " * 40_000, "x" * 100_000, "same", "same"]
    df = spark.createDataFrame([(1, t, "s", "en", "z") for t in texts], DOCS)
    want = [len(e) for e in Tokenizer.from_file(tokenizer).encode_batch(texts, add_special_tokens=False)]
    assert sorted(r.n_tokens for r in token_counts.token_counts(df, tokenizer).collect()) == sorted(want)


def filled(sizes, weights, total, cap):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        open_ = [s for s in names if s not in full]
        level = (total - sum(cap * sizes[s] for s in full)) / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def test_mix_meets_targets(spark):
    r = random.Random(2)
    names = ["b", "a", "ä", "", "c", "Z", None]
    rows = [(i, " ".join(["w"] * r.randint(0, 300)), names[min(6, int(r.expovariate(0.6)))], "en", "z") for i in range(3000)]
    rows += [(9001, None, "a", "en", "z"), (9002, "", None, "en", "z"), (9002, "x y", None, "en", "z"), (None, "x y z", "c", "en", "z"), (9003, None, "empty", "en", "z")]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes = {}
    for _, text, source, _, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = filled(sizes, (5, 2, 1), 1.5 * sum(sizes.values()), 2)
    by_id = {(d, t): s for d, t, s, _, _ in rows}
    source = {d: s for d, t, s, _, _ in rows}
    taken, targets = {}, {}
    for x in got:
        s = source[x.doc_id]
        taken[s] = taken.get(s, 0) + x.taken
        targets[s] = x.target
        assert 0 <= x.taken <= 2 * x.size and x.source_size == sizes[s]
    for s in sizes:
        assert targets[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - want[s]) <= 2
    assert by_id
    assert mixing.mix_sources(df.where("false")).count() == 0


def test_newton_reaches_the_optimum(spark):
    df = spark.createDataFrame([("a", 100, 5.0), ("b", 100, 200.0), ("c", 7, 7.0), ("d", 10, 0.0), ("e", 0, 0.0)], "source string, source_size long, target double")
    got = {r.source: r.rate for r in mixing.tilted(df).collect()}
    assert got == pytest.approx({"a": 0.05, "b": 2.0, "c": 1.0, "d": 0.0, "e": 0.0}, abs=1e-9)


def test_newton_reaches_small_rates(spark):
    wanted = {f"s{i}": 10.0 ** -i for i in range(1, 12)} | {"up": 40.0, "tiny": 1e-300}
    df = spark.createDataFrame([(s, 10**6, 10**6 * r) for s, r in wanted.items()], "source string, source_size long, target double")
    got = {r.source: r.rate for r in mixing.tilted(df).collect()}
    assert got == pytest.approx(wanted, rel=1e-9, abs=0)


def test_mix_of_long_texts_repeats_and_one_source(spark):
    rows = [(1, "w " * 300_000, "a", "", ""), (1, "w " * 300_000, "a", "", "")] + [(None, f"x{i} y", "a", "", "") for i in range(50)]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS)).collect()
    assert sum(x.taken for x in got) == round(1.5 * sum(x.size for x in got)) and all(0 <= x.taken <= 2 * x.size for x in got)


def test_languages_equal_plain_compression(spark):
    """Dictionaries and predictions against a second computation with the library alone."""
    import xxhash
    import zstandard

    r = random.Random(11)
    pool = {"aa": "abcde fgh", "bb": "fghij abé", "cc": "漢字仮名 ab"}
    say = lambda lang, n: "".join(r.choice(pool[lang]) for _ in range(n))
    rows = [(i, say(lang := r.choice("abc") * 2, r.choice([1, 30, 900, 6000])), "s", lang, "z") for i in range(120)] + [(7, say("aa", 50), "s", "aa", "z")] * 2
    docs = [*rows, (900, None, "s", None, "z"), (901, "", "s", None, "z"), (902, "١٢٣ ?!", "s", None, "z"), (None, say("bb", 20_000), "s", None, "z")]
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    of_long = lambda x, seed: xxhash.xxh64((x & (1 << 64) - 1).to_bytes(8, "little"), seed=seed & (1 << 64) - 1).intdigest()
    of_text = lambda t, seed: xxhash.xxh64(t.encode(), seed=seed).intdigest()
    picked, counts = {}, {}
    for d, text, _, lang, _ in rows:
        mixed = signed(of_text(text, of_long(d, 42)))
        at = signed(of_text("place", of_long(mixed, 42))) % max(1, len(text) - 63)
        key = (lang, mixed % 8)
        mine = (signed(of_text("rank", of_long(mixed, 42))), text[at : at + 64])
        picked[key] = min(picked.get(key, mine), mine)
        counts[lang] = counts.get(lang, 0) + 1
    contents = {lang: b"\n".join(language_id.normalized(picked[key][1]).encode() for key in sorted(picked) if key[0] == lang) for lang in counts}
    level = [(lang, zstandard.ZstdCompressor(level=5, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)) for lang, c in contents.items()]

    def brute(text):
        plain = language_id.normalized(text or "").encode()
        if not any(map(str.isalpha, plain.decode())):
            return "und"
        size = lambda c: sum(len(c.compress(plain[i : i + 2048])) for i in range(0, len(plain), 2048))
        return min(level, key=lambda x: (size(x[1]), -counts[x[0]], x[0]))[0]

    df = spark.createDataFrame(docs, DOCS).withColumns({"score": F.lit("s"), "found": F.lit("f"), "rejected": F.lit("r")})
    got = language_id.predict_languages(df.repartition(3), spark.createDataFrame(rows, DOCS), excerpts=8, length=64).collect()
    assert sorted(((x.doc_id, x.lang_pred) for x in got), key=str) == sorted(((d, brute(t)) for d, t, _, _, _ in docs), key=str)
    assert {x.found for x in got} == {"f"} and all(0 <= x.score <= 1 for x in got)
    assert language_id.predict_languages(df.where("false"), spark.createDataFrame(rows, DOCS)).count() == 0


def test_languages_on_held_out_texts(spark):
    vocabulary = {"aa": "the of and tion ing er ly wh".split(), "bb": "der die und sch ung ein keit ß".split()}
    r = random.Random(4)
    say = lambda lang, n: " ".join("".join(r.choice(vocabulary[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, say(lang := r.choice(["aa", "bb"]), r.randint(5, 400)), "s", lang, "z") for i in range(300)]
    test = [(1000 + i, say(lang, 40), "s", lang, "z") for i, lang in enumerate(["aa", "bb"] * 20)]
    odd = [(2000, None, "s", None, "z"), (2001, "", "s", None, "z"), (2002, "123 +-!", "s", None, "z")]
    training = spark.createDataFrame([*rows, (1, "zzz", "s", None, "z"), (2, None, "s", "aa", "z")], DOCS)
    got = {x.doc_id: x for x in language_id.predict_languages(spark.createDataFrame(test + odd, DOCS), training).collect()}
    assert all(got[d].lang_pred == lang for d, _, _, lang, _ in test)
    assert all(0 <= x.score <= 1 for x in got.values())
    assert [got[d].lang_pred for d in (2000, 2001, 2002)] == ["und"] * 3
    none = language_id.predict_languages(spark.createDataFrame(test, DOCS), training.where("false")).collect()
    assert {x.lang_pred for x in none} == {"und"}


def test_quality_on_held_out_texts(spark):
    r = random.Random(6)
    good = lambda: " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(60)) + "."
    bad = lambda: r.choice([good().upper().replace(" ", "!! "), "spam " * 60, good().replace(" ", "*** ")])
    rows = [(i, good() if i % 4 else bad(), "s", "en", "z") for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None, "s", "en", "z"), (901, "", "s", "en", "z")], DOCS)
    labels = docs.where("doc_id < 300").select("doc_id", (F.col("doc_id") % 4 > 0).cast("int").alias("label"))
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (6, 1)], "doc_id long, label int"))
    model = quality.train(docs, labels)
    got = {x.doc_id: x for x in quality.with_quality(docs, model).collect()}
    held = [got[i] for i in range(300, 400)]
    assert np.mean([x.predicted == int(x.doc_id % 4 > 0) for x in held]) >= 0.97
    assert all(0 <= x.score <= 1 for x in got.values())
    again = quality.train(docs.repartition(5), labels)
    assert np.array_equal(model.weights, again.weights)
    empty = quality.with_quality(docs, quality.train(docs, labels.where("false"))).collect()
    assert {x.score for x in empty} == {0.5}


def test_quality_equals_a_plain_fit(spark):
    """Weights and scores against a second computation of ratios, dual and scores."""
    r = random.Random(9)
    rows = [(i, "".join(r.choice("abcd " if i % 3 else "cdef ") for _ in range(r.choice([0, 5, 80, 3000]))), "s", "en", "z") for i in range(90)]
    df = spark.createDataFrame([*rows, (5, rows[5][1], "s", "en", "z"), (None, "abc", "s", "en", "z")], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, label int").withColumn("score", F.lit(1))
    model = quality.train(df, labels, epochs=4)

    def grams(text):
        words, data = text.encode().split(), text.encode()
        if any(a == b for a, b in zip(words, words[1:])):
            data = b" ".join([words[0], *(b"\x01" if a == b else b for a, b in zip(words, words[1:]))])
        slot = lambda g: ((int.from_bytes(bytes([0] * (7 - len(g))) + bytes([len(g)]) + g, "big") & (1 << 64) - 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 48
        return sorted({slot(data[i : i + n]) for n in (1, 2, 3) for i in range(len(data) - n + 1)})

    own = [i for i in range(90) if i % 5 != 4]
    x, y = [grams(rows[i][1]) for i in own], [1 if i % 3 else -1 for i in own]
    count = {s: np.full(quality.SLOTS, 1.0) for s in (1, -1)}
    for at, s in zip(x, y):
        count[s][at] += 1
    ratio = np.log(count[1] / count[1].sum() / (count[-1] / count[-1].sum()))
    dense = np.zeros((len(own), quality.SLOTS))
    for i, at in enumerate(x):
        dense[i, at] = ratio[at] / max(1, len(at)) ** 0.5
    w, bias, alpha = np.zeros(quality.SLOTS), 0.0, np.zeros(len(own))
    limit = [len(y) / (2 * y.count(s)) for s in y]
    order = np.random.default_rng(7)
    for _ in range(4):
        for i in order.permutation(len(own)):
            new = min(max(alpha[i] - (y[i] * (dense[i] @ w + bias) - 1) / (dense[i] @ dense[i] + 1), 0), limit[i])
            w, bias, alpha[i] = w + (new - alpha[i]) * y[i] * dense[i], bias + (new - alpha[i]) * y[i], new
    assert model.weights == pytest.approx(w * ratio, abs=1e-9) and model.bias == pytest.approx(bias)
    got = {g.doc_id: g.score for g in quality.with_quality(df.withColumn("predicted", F.lit("p")), model).collect()}
    for i, text, *_ in rows:
        at = grams(text)
        margin = (w * ratio)[at].sum() / max(1, len(at)) ** 0.5 + bias
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.offset))))
    assert quality.with_quality(df.where("false"), model).count() == 0


def test_slots_of_long_texts_are_bounded():
    r = np.random.default_rng(3)
    for n in (0, 1, 4095, 4096, 60_000):
        at = np.sort(r.choice(quality.SLOTS, n, replace=False)).astype(np.int32)
        data = quality.packed(at)
        assert len(data) <= quality.SLOTS // 8 and np.array_equal(quality.unpacked(data), at)


@pytest.mark.skipif(not __import__("pathlib").Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    from worksight.llm.queries import op5_language_id, op9_quality

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = op5_language_id(spark, folder).where("held_out").join(docs.where("lang is not null and text is not null").select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = op9_quality(spark, folder).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([x.predicted == x.quality for x in scored]) > 0.95
