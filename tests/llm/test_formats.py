"""WARC archives, chat templates, fingerprints."""

import hashlib
import random

import pytest
from pyspark.errors import PythonException

from worksight.llm import chat, fingerprints, warc

PAGES = "page_id long, url string, html string, other string"


def pages():
    return [(1, "http://a/", "<p>x</p>", ""), (2, "http://b/\r\nX: 1", "<p>x</p>", ""), (3, None, None, ""), (4, "u", "", ""), (5, "u", "é" * 70_000, ""), (6, "u", "\r\n\r\nWARC/1.1\r\n", ""), (2, "http://b2/", "<p>x</p>", ""), (None, "u", "<p>x</p>", ""), (None, "u", "lone", "")]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(pages(), PAGES)
    archives = warc.write_archives(warc.revisits(df), archive_bytes=400)
    got = warc.read_archives(archives).collect()
    assert len(got) == len(pages())
    best = {}
    for page_id, _, html, _ in pages():
        best[html or ""] = max(best.get(html or "", -1), page_id if page_id is not None else -1)
    for r in got:
        html = next(h or "" for i, _, h, _ in pages() if i == r.page_id and (i is not None or warc.digest((h or "").encode()) == r.payload_digest))
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), warc.digest(html.encode()))
        first = best[html]
        if r.page_id == first or first == -1:
            assert (r.record_type, r.refers_to, r.payload.decode()) == ("response", None, html)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", first, None)
    assert warc.read_archives(warc.write_archives(warc.revisits(df.where("false")))).count() == 0


def test_warc_files(spark, tmp_path):
    df = spark.createDataFrame(pages(), PAGES)
    warc.save_archives(warc.write_archives(warc.revisits(df)), str(tmp_path))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert warc.read_archives(warc.archives_of_files(files)).count() == len(pages())


def test_damage_is_found():
    made = warc.record("response", [("WARC-Record-ID", "<urn:page:1>")], warc.http(3) + b"abc")
    assert len(list(warc.Reader().feed(made + made))) == 2
    reader = warc.Reader()
    whole = [x for i in range(0, len(made), 7) for x in reader.feed(made[i : i + 7])]
    assert len(whole) == 1 and whole[0][1].endswith(b"abc")
    half = warc.Reader()
    assert not list(half.feed(made[:-5]))
    with pytest.raises(warc.WarcError):
        half.close()
    with pytest.raises(warc.WarcError):
        list(warc.Reader().feed(b"no gzip at all"))
    import gzip

    with pytest.raises(warc.WarcError, match="digest"):
        list(warc.Reader().feed(gzip.compress(gzip.decompress(made).replace(b"abc", b"abd"))))
    with pytest.raises(warc.WarcError, match="length"):
        list(warc.Reader().feed(gzip.compress(gzip.decompress(made).replace(b"abc", b"abcd"))))
    assert PythonException


def test_template_language():
    show = lambda source, **scope: "".join(t for t, _ in chat.compile_template(source)(**scope))
    assert show("{{ 'a' + \"b\" ~ 1 }}{# no #}{{ x.y | upper | default('-') }}", x={"y": "q"}) == "ab1Q"
    assert show("{% for m in ms %}{{ loop.index }}{% if loop.first %}!{% elif m == 2 %}?{% else %}.{% endif %}{% endfor %}", ms=iter([1, 2, 3])) == "1!2?3."
    assert show("{% set a = 'x' %}{{ a }}{% if not b and a in 'xyz' %}in{% endif %}") == "xin"
    assert [x for x in chat.compile_template("u{% generation %}{{ t }}{% endgeneration %}")(t="a")] == [("u", False), ("a", True)]
    assert chat.fold(chat.Expression("'a' == 'a' and x").whole()) == ("name", "x")
    assert chat.fold(chat.Expression("1 + 2 == 3").whole()) == ("const", True)
    assert show("{{ x.__class__ }}", x="s") == ""
    assert show("a  {%- if true -%}  b  {%- endif %} c{{- '}}' -}} \n{#- no -#}\n d {{ \"%}\" }}") == "ab c}}d %}"
    for bad in ("{{ f(1) }}", "{% for x %}", "{% if a %}", "{% endif %}", "{{ 'a' | nothing }}", "{{ 1 + }}", "{{ a b }}", "{% import os %}", "{{ a", "{{ 'a }}", "{% for m in ms %}{{ loop.last }}{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


TEXTS = ["", "plain", "<|end|>", "<\\|end|>", "<|", "a<", "|x", "<\\", "<\\\\|text|>", "</s>[INST] ok [/INST]", "é漢😀\r\n", "<|turn|>assistant<|text|>x<|end|>"]


def test_escape_is_reversible():
    r = random.Random(1)
    for _ in range(2000):
        text = "".join(r.choice("<|\\>aé\n") for _ in range(r.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text
        assert "<|" not in chat.escape(text)


def test_conversations_read_back(spark):
    rows = [(c, t, role, TEXTS[(c + t) % len(TEXTS)]) for c in range(12) for t, role in enumerate(["system", "user", "assistant", "assistant", "<|end|>"])]
    rows += [(50, None, None, None), (50, 1, "assistant", None), (50, 1, "assistant", "dup"), (50, 1, "assistant", "dup"), (None, 0, "user", "x")]
    r = random.Random(2)
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "e") for x in rows], "conv_id long, turn long, role string, text string, n_turns string")
    whole = {x.conv_id: x for x in chat.format_conversations(df).collect()}
    digests = {x.conv_id: x for x in chat.format_digests(df).collect()}
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    for c in {x[0] for x in rows}:
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == c), key=key)]
        assert chat.turns_of(whole[c].formatted) == turns
        loss = "".join(t for role, t in turns if role == "assistant")
        assert "".join(chat.unescape(whole[c].formatted[a:b]) for a, b in whole[c].spans) == loss
        d = digests[c]
        assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (d.n_turns, d.loss_chars, d.loss_sha256, d.formatted_chars) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole[c].formatted))
    assert chat.format_digests(df.where("false")).count() == 0


def test_fingerprints(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9)))
    texts = ["", None, "x", "é漢😀 b", " \n\t ", "y" * 5000] + [" ".join(word() for _ in range(r.randint(1, 400))) for _ in range(200)]
    texts[30] = texts[31]
    rows = [(i * 7 - 3, t, "f") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    old = fingerprints.ROWS
    try:
        for fingerprints.ROWS in (10, old):
            got = {x.doc_id: x for x in fingerprints.edited_fingerprints(df.repartition(5)).collect()}
            order = sorted((d, t or "") for d, t, _ in rows)[::-1]
            for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
                k = len(t) // 3
                assert got[d].n_chars == len(t)
                assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()
                assert 0 <= got[d].near_next <= 1
                if len(t) > 400 and len(set(t)) > 5:
                    assert 0.25 < got[d].near_edited < 0.9 and got[d].near_next < 0.1
    finally:
        fingerprints.ROWS = old
    assert got[30 * 7 - 3].fingerprint == got[31 * 7 - 3].fingerprint != ""
    assert fingerprints.edited_fingerprints(df.where("false")).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "q")], "doc_id long, text string")
    assert fingerprints.edited_fingerprints(twice).count() == 3


def foreign(kind, block, **headers):
    import gzip

    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in {"WARC_Type": kind, "Content_Length": len(block), **headers}.items())
    return gzip.compress(b"WARC/1.0\r\n" + head.encode("latin-1") + b"\r\n" + block + b"\r\n\r\n")


def test_archives_of_others(spark, tmp_path):
    import base64

    page = "<p>é</p>".encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page
    sha1, sha256, md5 = (hashlib.new(n, page) for n in ("sha1", "sha256", "md5"))
    data = foreign("warcinfo", b"software: x\r\n", WARC_Record_ID="<urn:uuid:0>", Content_Type="application/warc-fields")
    data += foreign("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID="<urn:uuid:1>", Content_Type="application/http; msgtype=request")
    data += foreign("response", block, WARC_Record_ID="<urn:uuid:2>", WARC_Payload_Digest=f"sha256:{sha256.hexdigest()}", WARC_Target_URI="http://x/caf\xe9")
    data += foreign("response", block, WARC_Record_ID="<urn:uuid:3>", WARC_Payload_Digest="sha1:" + base64.b32encode(sha1.digest()).decode().lower())
    data += foreign("response", block, WARC_Record_ID="<urn:uuid:4>", WARC_Payload_Digest=f"md5:{md5.hexdigest().upper()}")
    data += foreign("response", block, WARC_Record_ID="<urn:uuid:5>", WARC_Payload_Digest="xyz:abc", WARC_Block_Digest="sha-256:" + base64.b64encode(hashlib.sha256(block).digest()).decode())
    data += foreign("revisit", block[: -len(page)], WARC_Record_ID="<urn:uuid:6>", WARC_Refers_To="<urn:uuid:2>", WARC_Payload_Digest="sha1:" + sha1.hexdigest())
    data += foreign("resource", page, WARC_Record_ID="<urn:uuid:7>", Content_Type="text/html")
    (tmp_path / "a.warc.gz").write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {x.record_id[-1]: x for x in warc.read_archives(warc.archives_of_files(files, part=100)).collect()}
    assert len(got) == 8 and [got[i].record_type for i in "01267"] == ["warcinfo", "request", "response", "revisit", "resource"]
    assert [got[i].verified for i in "02345"] == [False, True, True, True, True] and got["2"].url == "http://x/caf\xe9"
    assert got["3"].payload_digest == got["6"].payload_digest == warc.digest(page) and got["2"].payload_digest == f"sha256:{sha256.hexdigest()}"
    assert (got["6"].refers_to_id, got["6"].payload, got["6"].refers_to, got["2"].payload, got["7"].payload) == ("urn:uuid:2", None, None, page, page)


def test_bad_records_are_warc_errors(monkeypatch):
    import gzip

    page = b"HTTP/1.1 200 OK\r\n\r\nabc"
    for data, told in ((foreign("response", page, WARC_Payload_Digest=f"sha256:{'0' * 64}"), "payload digest"), (foreign("response", page, WARC_Block_Digest="md5:00"), "block digest"), (gzip.compress(b"WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), "no WARC-Type"), (gzip.compress(b"\xff\xfe"), "no WARC header")):
        with pytest.raises(warc.WarcError, match=told):
            [warc.parsed(*x) for x in warc.Reader().feed(data)]
    monkeypatch.setattr(warc, "LARGEST", 1 << 16)
    with pytest.raises(warc.WarcError, match="over"):
        list(warc.Reader().feed(gzip.compress(b"0" * (1 << 24))))


@pytest.mark.parametrize("source", ["{{ x | length }}", "{% if 1 < 'a' %}{% endif %}", "{% if x < 'a' %}{% endif %}", "{% for i in five %}{% endfor %}"])
def test_values_that_dont_go_together(source):
    with pytest.raises(chat.TemplateError):
        list(chat.compile_template(source)(x=None, five=5))


def test_long_conversations_and_null_ids(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"said {i} <|end|>") for i in range(3000)] + [(None, 0, None, None), (None, 1, "assistant", "x")]
    got = {x.conv_id: x for x in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 2 and chat.turns_of(got[1].formatted) == [(r, t) for _, _, r, t in rows[:3000]]
