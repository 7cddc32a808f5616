"""Decontamination and personal data against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from worksight.llm import decontaminate, pii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, length=13):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(0, len(w) - length) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + length]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for d, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_bytes", [1 << 22, 300])
def test_contamination(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(decontaminate, "PIECE", 100_000 if slice_bytes > 300 else 15)
    r = random.Random(9)
    say = lambda n, k: [r.choice("abcdefghij") * r.randint(1, 3) for _ in range(n)] if k else [f"u{r.randrange(10**6)}" for _ in range(n)]
    items = [(i, " ".join(say(r.randint(1, 40), i % 3 == 0))) for i in range(25)] + [(7, "second row of seven " * 5), (None, "no id here"), (99, None), (98, "---"), (97, "Été à la MER, très LOIN"), (40, "a" * 20)]
    docs = []
    for d in range(60):
        parts = say(r.randint(0, 60), d % 2)
        for _ in range(r.randint(0, 3)):
            text = WORD.findall(lower(r.choice(items)[1]))
            at = r.randint(0, max(0, len(text) - 13))
            parts[r.randint(0, len(parts)) : 0] = text[at : at + r.randint(10, 20)]
        docs.append((d, " ".join(p.upper() if r.random() < 0.3 else p for p in parts)))
    docs += [(100, None), (101, ""), (102, "Été.à la-MER;très'LOIN"), (102, "repeated id"), (None, "no id here"), (103, "x" * 50_000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, item_id string, n_words int")
    bench = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    got = [tuple(x) for x in decontaminate.contamination(df, bench).collect()]
    assert sorted(got, key=str) == brute(docs, items)
    shuffled = decontaminate.contamination(df.repartition(5).withColumn("mark", F.xxhash64("text")), bench.unionByName(bench), tag="mark")
    assert sorted((tuple(x)[:-1] for x in shuffled.collect()), key=str) == brute(docs, items)
    none = decontaminate.contamination(df, bench.where("false")).collect()
    assert len(none) == len(docs) and not any(x.contaminated for x in none)
    assert decontaminate.contamination(df.where("false"), bench).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def check_digit(digits):
    total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and check_digit(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def test_spans_equal_the_patterns():
    r = random.Random(12)
    pools = ["0123456789 .-", "ab.@-_%+", "+12 ().-3", "0159.@ab+- é\n", "0123456789"]
    for i in range(6000):
        text = "".join(r.choice(pools[i % len(pools)]) for _ in range(r.randint(0, 40)))
        assert [s for s in pii.find(text) if s[0] in pii.BASE] == base_spans(text), text


def test_added_kinds_and_redaction(spark):
    text = "IBAN: DE89 3704 0044 0532 0130 00, ftp://bob:pw1@host.example/x, token = \"abcdef0123456789abcdef\" and jo.e@mail.example.com."
    kinds = [k for k, _, _ in pii.find(text)]
    assert kinds == ["email", "iban", "login", "secret"] or set(kinds) >= {"email", "iban", "login", "secret"}
    clean = pii.redacted(text, pii.find(text))
    assert not any(s in clean for s in ("3704", "pw1", "abcdef0123", "jo.e@"))
    assert pii.find("tokens of trust, password reset, IBAN unknown, http://example.com/a?b=1") == []
    df = spark.createDataFrame([(1, text, "q"), (2, None, "q"), (3, "", "q"), (3, "clean text", "q")], "doc_id long, text string, spans string")
    got = pii.with_personal_data(df, redact=True).collect()
    assert [(x.doc_id, x.redacted__) for x in got] == [(1, clean), (2, None), (3, ""), (3, "clean text")]
    assert all(x.spans == "q" for x in got)
    assert pii.with_personal_data(df.where("false")).count() == 0


def test_numbers_with_many_zeros():
    for text in ("0" * 5000 + ".1.1.1", "1.2." + "0" * 9000 + "7.0", "0" * 5000 + "256.1.1.1", "00.000.0.255", "9" * 5000 + ".1.1.1"):
        assert [s for s in pii.find(text) if s[0] == "ip"] == [("ip", *m.span()) for m in IP.finditer(text) if all(int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split("."))]


def test_query_lists_the_spans_of_the_patterns(spark, tmp_path):
    from worksight.llm.queries import op8_personal_data

    texts = [None, "", "a@b.c 1.2.3.4, +1 (555) 555-0100; é 4111 1111 1111 1111 and bad 4111 1111 1111 1112", "x" * 3000 + " q@r.st " + "0" * 5000 + ".1.1.1", "漢字 jo@ex.org", "漢字 jo@ex.org"]
    spark.createDataFrame([(i % 5, t, "q", "r") for i, t in enumerate(texts)], "doc_id long, text string, spans string, found string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_personal_data(spark, str(tmp_path)).collect()
    spell = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    base = lambda t: [s for k in pii.BASE for s in base_spans_of(t or "") if s[0] == k]
    want = sorted((i % 5, *[sum(s[0] == k for s in base(t)) for k in pii.BASE], hashlib.sha256(spell(base(t)).encode()).hexdigest(), spell(pii.find(t or ""))) for i, t in enumerate(texts))
    assert sorted((x.doc_id, x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256, x.spans) for x in got) == want


def base_spans_of(text):
    """base_spans where numbers may have more digits than int() takes."""
    return [s for s in base_spans(re.sub(r"0{4000,}", lambda m: "\x00" * len(m[0]), text))] + [("ip", *m.span()) for m in IP.finditer(text) if re.search(r"0{4000,}", m[0])]


def test_columns_with_clashing_names_pass(spark):
    df = spark.createDataFrame([(1, "a@b.c", "x", "y", "z")], "doc_id long, text string, found string, spans__ string, redacted__ string")
    got = pii.with_personal_data(df, redact=True).first()
    assert (got.found, got.redacted__, len(got.spans__)) == ("x", "[email]", 1)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "@" * 200_000, "+1 " * 60_000, "1 2-" * 50_000, "a.b@" * 50_000):
        pii.find(text)
