"""What the text operators share: tables, durable intermediate results, hashing of words."""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPACE = frozenset(b" \t\n\r\x0b\x0c")
#: Bytes of text hashed at a time; bounds the arrays of a task.
BLOCK = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """The rows of df written to the cluster's checkpoint folder, lineage cut.

    The folder is the session's spark.checkpoint.dir. Only where that is unset and all runs
    in one process, as in tests, a temporary folder takes its place; on a cluster other
    executors could not see it, so there it must be set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all others."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


BASE = 0x9E3779B97F4A7C15
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below n."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about BLOCK bytes; a longer text stands alone."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BLOCK:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def outside_of(keep) -> np.ndarray:
    """A table of the 256 bytes, true for those that end a word."""
    return np.array([not keep(b) for b in range(256)])


#: Words of anything but ASCII white space; words of digits, letters and non-ASCII.
SPACED = outside_of(lambda b: b not in SPACE)
ALNUM = outside_of(lambda b: b >= 128 or chr(b).isalnum())


class Spans:
    """Where the words of a block of texts are: data, starts, ends, and first, the index of
    each text's first word, with the number of words at its end. lower: A-Z as a-z."""

    def __init__(self, texts: list[bytes], outside: np.ndarray = SPACED, lower: bool = True):
        data = b"\n".join(texts) + b"\n"
        self.data = data.lower() if lower else data
        self.raw = np.frombuffer(self.data, np.uint8)
        edge = np.flatnonzero(np.diff((~outside[self.raw]).view(np.int8), prepend=np.int8(0)))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))


class Words(Spans):
    """The words of a block of texts with their hashes."""

    def __init__(self, texts: list[bytes], outside: np.ndarray = SPACED, lower: bool = True):
        super().__init__(texts, outside, lower)
        n = len(self.raw)
        up, down = powers(max(2 * BLOCK, 1 << n.bit_length()))
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(BYTE_VALUES[self.raw] * up[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])


def slot_counts(texts: DataFrame, hashes: Callable[[list[bytes]], np.ndarray], slots: int) -> np.ndarray:
    """How many of the hashes of all texts (one string column) fall into each slot.

    A task gives one array of fixed size; these are added up in a few tasks before the
    driver gets them, so it sees MERGES arrays however large the input is.
    """
    schema = pa.schema([("counts", pa.binary())])
    row = lambda total: pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            rows = encoded(batch.column(0))
            for a, b in blocks(rows):
                total += np.bincount((hashes(rows[a:b]) % np.uint64(slots)).astype(np.int64), minlength=slots)
        yield row(np.minimum(total, 2**31 - 1).astype(np.int32))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for counts in batch.column(0):
                total += np.frombuffer(counts.as_py(), np.int32)
        yield row(np.minimum(total, 2**31 - 1).astype(np.int32))

    found = texts.mapInArrow(count, "counts binary").repartition(MERGES).mapInArrow(add, "counts binary").toArrow()
    return sum((np.frombuffer(c.as_py(), np.int32).astype(np.int64) for c in found.column(0)), np.zeros(slots, np.int64))


MERGES = 4
STEPS = mix(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Per text the hashes of its k-word shingles in order, repeats kept.

    A text of fewer words, but not none, has its whole sequence as one shingle.
    Two shingles get one hash with a chance of 2 ** -64.
    """
    found = Words(texts)
    words, first = found.hashes, found.first
    n = len(words) - k + 1
    if n > 0:
        sums = words[:n] * STEPS[0]
        for j in range(1, k):
            sums += words[j : n + j] * STEPS[j]
        whole = mix(sums)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(whole[a : b - k + 1])
        elif b > a:
            out.append(mix(np.sum(words[a:b] * STEPS[: b - a], keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def encoded(column) -> list[bytes]:
    """UTF-8 of an Arrow string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
