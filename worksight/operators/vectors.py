"""Text vectors of works: a labelled search text, hashed, weighed by rarity, of unit length."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.functions.scalar import search_text
from worksight.operators.pairs import normalize_texts
from worksight.sources.durable import durable

# The labels of the fields of a search text, in order.
LABELS = {"description": "work", "sector": "sector", "sub_sector": "sub sector", "state": "state", "district": "district", "block": "block", "village": "village"}
DIMENSIONS = 512
#: Tokens whose slot a worker remembers.
REMEMBERED = 1 << 18
#: Characters of ASCII and, in folded case, of Latin-1: letters and digits stay, all others part words.
ASCII = "".join(chr(c).lower() if chr(c).isalnum() else " " for c in range(1 << 7))
LATIN = bytes(c if chr(c).isalnum() else 32 for c in range(1 << 8))
WORDS = re.compile(r"[^\W_]+")
#: Vectors that a task unpacks at a time.
STEP = 512


def search_texts(works: DataFrame, fields: dict[str, str] = LABELS) -> DataFrame:
    """work_id, text: "label value | label value" of normalized fields, empty and null ones left out."""
    out = works
    for name in fields:
        out = normalize_texts(out.withColumn(f"{name}__t", F.col(name).cast("string")), f"{name}__t", f"{name}__n")
    return out.select("work_id", search_text([(label, F.col(f"{name}__n")) for name, label in fields.items()]).alias("text"))


def slot(token: str, dimensions: int) -> int:
    """The first 12 bits of MD5 modulo the dimensions, which any engine can tell."""
    return int(hashlib.md5(token.encode()).hexdigest()[:3], 16) % dimensions


def words(text: str) -> list[str]:
    """The words of a text as `normalize_texts` has it, which isn't made for this."""
    if text.isascii():
        return text.translate(ASCII).split()
    folded = unicodedata.normalize("NFKC", text).casefold()
    try:
        return folded.encode("latin-1").translate(LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORDS.findall(folded.lower())


class Slots(dict):
    """The slot of each word that is asked for, REMEMBERED of them kept."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        at = self[token] = slot(token, self.dimensions)
        return at


def term_counts(texts: DataFrame, dimensions: int) -> DataFrame:
    """work_id, v: how many tokens of each text (work_id, text) fall into each slot, packed; texts without a token have none."""
    return counted(texts.select(F.col("work_id").cast("long"), F.col("text").cast("string")), lambda row: [t for t in (row[0] or "").split(" ") if t and t != "|"], dimensions)


def search_counts(works: DataFrame, fields: dict[str, str], dimensions: int) -> DataFrame:
    """The term_counts of the search_texts of works, each text read once and counted where it is read."""
    labels = [label.split(" ") for label in fields.values()]

    def tokens(row: list[str | None]) -> list[str]:
        out = []
        for label, text in zip(labels, row):
            if text and (own := words(text)):
                out += label + own
        return out

    return counted(works.select(F.col("work_id").cast("long"), *[F.col(name).cast("string") for name in fields]), tokens, dimensions)


def counted(rows: DataFrame, tokens: Callable[[list[str | None]], list[str]], dimensions: int) -> DataFrame:
    """work_id, v: packed counts by slot of what `tokens` makes of the other columns of each row."""
    schema = pa.schema([("work_id", pa.int64()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(dimensions)
        for batch in batches:
            out = []
            for row in zip(*batch.columns[1:]):  # a text at a time, as a batch may hold many long ones
                found = tokens([x.as_py() for x in row])
                out.append(packed(np.bincount([slots[t] for t in found], minlength=dimensions)) if found else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], schema=schema)

    return rows.mapInArrow(run, "work_id long, v binary")


def packed(counts: np.ndarray) -> bytes:
    """Counts by slot: the bytes of a count, a bit for each slot that has one, and these in order."""
    some = counts[counts > 0]
    width = 1 if some.max(initial=0) < 1 << 8 else 4
    return bytes([width]) + np.packbits(counts > 0).tobytes() + some.astype(f"<u{width}").tobytes()


def unpacked(column: Iterable[bytes], dimensions: int) -> np.ndarray:
    """The packed counts of a column as rows of doubles."""
    rows = list(column)
    out = np.zeros((len(rows), dimensions))
    bits = -(-dimensions // 8)
    for width in (1, 4):
        own = [i for i, r in enumerate(rows) if r[0] == width]
        if own:
            held = np.frombuffer(b"".join(rows[i][1 : 1 + bits] for i in own), np.uint8).reshape(len(own), bits)
            part = np.zeros((len(own), dimensions))
            part[np.unpackbits(held, axis=1, count=dimensions).astype(bool)] = np.frombuffer(b"".join(rows[i][1 + bits :] for i in own), f"<u{width}")
            out[own] = part
    return out


def document_frequencies(counted: DataFrame, dimensions: int) -> tuple[int, np.ndarray]:
    """(texts, texts that have each slot); a task hands over one row."""
    schema = pa.schema([("rows", pa.int64()), ("held", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(dimensions, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for at in range(0, batch.num_rows, STEP):
                held += (unpacked(batch.column(0)[at : at + STEP].drop_null().to_pylist(), dimensions) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([held], pa.list_(pa.int64()))], schema=schema)

    parts = counted.select("v").mapInArrow(run, "rows long, held array<long>")
    got = parts.select("rows", F.posexplode("held").alias("slot", "n")).groupBy("slot").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).collect()  # a row per slot
    held = np.zeros(dimensions, np.int64)
    for r in got:
        held[r.slot] = r.n
    return (got[0].rows if got else 0), held


class Weighed:
    """Turns packed counts into vectors: counts by slot times the slot's rarity, of length 1."""

    def __init__(self, rarity: np.ndarray):
        self.rarity = rarity

    def __call__(self, column: Iterable[bytes]) -> np.ndarray:
        x = unpacked(column, len(self.rarity)) * self.rarity
        return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]


def packed_vectors(texts: DataFrame, dimensions: int = DIMENSIONS) -> tuple[DataFrame, Weighed]:
    """work_id, v of every text with a token, packed to some bytes a slot that it has, and what makes vectors of them.

    The vectors are those of `text_vectors`. Rows are small enough to be shuffled and kept;
    tasks unpack what they compare. Equal texts have equal bytes.
    """
    return weighed_counts(durable(term_counts(texts, dimensions)), dimensions)


def search_vectors(works: DataFrame, fields: dict[str, str] = LABELS, dimensions: int = DIMENSIONS) -> tuple[DataFrame, Weighed]:
    """The packed_vectors of the search_texts of works."""
    return weighed_counts(durable(search_counts(works, fields, dimensions)), dimensions)


def weighed_counts(counts: DataFrame, dimensions: int) -> tuple[DataFrame, Weighed]:
    n, held = document_frequencies(counts, dimensions)
    return counts.where("v is not null"), Weighed(np.log((1 + n) / (1 + held)) + 1)


def text_vectors(texts: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """work_id, v of every text (work_id, text) with a token: counts by hash slot times ln((1 + n) / (1 + held)) + 1, of length 1.

    `dimensions` is 4,096 at most. Null and empty texts have no vector; equal texts have
    equal ones, bit by bit. Three passes, none of them shuffles a text.
    """
    counted, weighed = packed_vectors(texts, dimensions)
    schema = pa.schema([("work_id", pa.int64()), ("v", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                x = weighed(batch.column(1)[at : at + STEP].to_pylist())
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dimensions, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + STEP], values], schema=schema)

    return counted.mapInArrow(run, "work_id long, v array<double>")
