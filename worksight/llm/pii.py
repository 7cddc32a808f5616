"""Personal data by anchor expansion.

An Aho-Corasick automaton goes once over a text and finds anchors: at-signs, schemes, plus
signs, and the pairs of digits with which numbers begin. From each anchor a local parser
expands to the value's boundaries and validates it. Parsers move only forward, so a text
takes time in proportion to its length.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.llm.common import unused

#: Base kinds in the order in which spans are listed, then those this method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "login", "secret")
KINDS = BASE + ADDED

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
FOUR = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
CALL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
LOGIN = re.compile(r"[A-Za-z0-9._~%!$&*+=-]+:[^\s:/?#@]+@[A-Za-z0-9.-]+")
SECRET = re.compile(r"[ \t]{0,4}[=:][ \t]{0,4}[\"']?([A-Za-z0-9_+/=-]{16,})")
DIGITS = "0123456789"
SEPARATORS = str.maketrans("", "", " -")


def luhn(digits: str) -> bool:
    """Whether the last digit is the right check digit."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += (2 * d - 9 * (d > 4)) if i % 2 else d
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


@functools.lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("://", ("login", 3))
    for cue in ("token", "secret", "password", "passwd", "api_key", "apikey", "Token", "Secret", "Password", "API_KEY", "API key"):
        found.add_word(cue, ("secret", len(cue)))
    for cue in ("IBAN", "iban", "Iban"):
        found.add_word(cue, ("iban", len(cue)))
    for a in DIGITS:
        found.add_word(f"+{a}", ("phone", 2))
        for b in DIGITS:
            found.add_word(f"{a}.{b}", ("ip", 3))
            for pair in (f"{a}{b}", f"{a} {b}", f"{a}-{b}"):
                found.add_word(pair, ("card", len(pair)))
    found.make_automaton()
    return found


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data, by kind as in KINDS, then by start."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, length) in automaton().iter(text):
        at = last + 1 - length
        if kind == "card":
            if at < done["card"]:
                continue
            m = CHAIN.match(text, at)
            done["card"] = m.end()
            digits = m[0].translate(SEPARATORS)
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans["card"].append(m.span())
        elif kind == "email":
            start, low = at, done["email"]
            while start > low and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                spans["email"].append((start, m.end()))
        elif kind == "ip":
            start, low = at + 1, done["ip"]
            while start > low and text[start - 1] in DIGITS:
                start -= 1
            if start <= at and (m := FOUR.match(text, start)):
                done["ip"] = m.end()
                if all(len(p) < 4 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
                    spans["ip"].append(m.span())
        elif kind == "phone":
            if at >= done["phone"] and (m := CALL.match(text, at)):
                done["phone"] = m.end()
                if 8 <= sum(c in DIGITS for c in m[0]) <= 15:
                    spans["phone"].append(m.span())
        elif kind == "iban":
            start = at + length
            while start < len(text) and start < at + length + 4 and text[start] in " :#.":
                start += 1
            if start >= done["iban"] and (m := IBAN.match(text, start)) and mod97(m[0].replace(" ", "")):
                done["iban"] = m.end()
                spans["iban"].append(m.span())
        elif kind == "login":
            if at >= done["login"] and (m := LOGIN.match(text, at + length)):
                done["login"] = m.end()
                spans["login"].append(m.span())
        elif at >= done["secret"] and (m := SECRET.match(text, at + length)):
            done["secret"] = m.end()
            spans["secret"].append(m.span(1))
    return [(k, a, b) for k in KINDS for a, b in spans[k]]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping ones by one."""
    parts, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def with_personal_data(docs: DataFrame, redact: bool = False) -> DataFrame:
    """docs with spans__ array<struct<kind, start, end>>, code points, end exclusive.

    With `redact`, also redacted__: the text with every span replaced by its kind. Null texts
    have no spans and stay null; empty texts have none, empty tables give empty ones. A text
    is read once from start to end, however long. Every row stands for itself, repeated ones
    too. Other columns pass, save those named spans__ and redacted__, which are replaced.
    """
    docs = docs.drop("spans__", "redacted__") if redact else docs.drop("spans__")
    name = unused(docs, "found")

    @F.pandas_udf("spans array<struct<kind string, start int, end int>>, text string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [find(t) if t else [] for t in texts]
            clean = [redacted(t, s) if s else t for t, s in zip(texts, found, strict=True)] if redact else None
            yield pd.DataFrame({"spans": [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], "text": clean})

    out = docs.withColumn(name, run(F.col("text").cast("string"))).withColumn("spans__", F.col(f"{name}.spans"))
    return (out.withColumn("redacted__", F.col(f"{name}.text")) if redact else out).drop(name)
