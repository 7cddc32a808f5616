"""Importance resampling towards a target distribution.

Documents and target texts are bags of hashed runs of one to three words. A document's
weight sums, over its features, the log ratio of the target's and the corpus's share of the
feature's bucket, from an array of one gain a bucket. Gumbel noise that only the document's
id determines turns weights into scores, whose largest are a draw without replacement.

Scale: counting and scoring are a pass over the texts each, without a shuffle; what tasks
hand over is an array of one count a bucket. The draw shuffles hardly more rows than it
draws: every partition sorts its best eligible rows and cuts this run at the borders of
ranges; each range's pieces of runs are merged by a tournament tree, in the order of their
heads, so that a piece is opened when its first row is next; ranges behind the draw are not
merged, and the last one stops at the exact count. A range's first rank is what the ranges
before it hold. Borders come from a sample of fixed size; they decide which task merges a
row, never its rank.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksight.llm.common import ALNUM, MERGES, Spans, blocks, durable, encoded, partitions, unused

#: Bytes of words whose checksums are computed side by side; longer ones take their own turn.
LONG = 64
#: Rows of a piece of a run.
PIECE = 4096
#: Rows drawn that a range is meant to hold, ranges at most, and rows sampled for their borders.
RANGE_ROWS, RANGES, SAMPLE = 200_000, 2048, 1 << 16


def _checksum_tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of a byte, and what a checksum becomes by 0 to LONG + 1 zero bytes, by its four bytes."""
    step = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)
    shift = np.empty((LONG + 2, 4, 256), np.uint32)
    for part in range(4):
        shift[0, part] = np.arange(256, dtype=np.uint32) << np.uint32(8 * part)
    for n in range(1, LONG + 2):
        shift[n] = step[shift[n - 1] & 255] ^ (shift[n - 1] >> np.uint32(8))
    return step, shift


STEP, SHIFT = _checksum_tables()


def shifted(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What CRC-32 sums contribute to the sum of a text that goes on for so many bytes."""
    n = np.minimum(lengths, LONG + 1)
    out = SHIFT[n, 0, sums & 255] ^ SHIFT[n, 1, (sums >> np.uint32(8)) & 255] ^ SHIFT[n, 2, (sums >> np.uint32(16)) & 255] ^ SHIFT[n, 3, sums >> np.uint32(24)]
    for i in np.flatnonzero(lengths > LONG + 1):
        zeros = bytes(int(lengths[i]))
        out[i] = zlib.crc32(zeros, int(sums[i])) ^ zlib.crc32(zeros)
    return out


def word_sums(w: Spans) -> np.ndarray:
    """CRC-32 of every word."""
    lengths = w.ends - w.starts
    sums = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    left = np.flatnonzero(lengths <= LONG)
    for j in range(LONG):
        left = left[lengths[left] > j]
        if not len(left):
            break
        own = sums[left]
        sums[left] = STEP[(own ^ w.raw[w.starts[left] + j]) & 255] ^ (own >> np.uint32(8))
    sums ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > LONG):
        sums[i] = zlib.crc32(w.data[w.starts[i] : w.ends[i]])
    return sums


def feature_buckets(texts: list[bytes], buckets: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For runs of one, two and three words their buckets and the index of their first word; and each text's first word."""
    w = Spans(texts, ALNUM)
    n = len(w.starts)
    lengths = (w.ends - w.starts).astype(np.int64)
    sums = word_sums(w)
    spaced = shifted(np.full(n, zlib.crc32(b" "), np.uint32), lengths) ^ sums
    end = np.repeat(w.first[1:], np.diff(w.first))
    at = [np.arange(n)]
    runs = [sums]
    for size in (2, 3):
        fits = at[-1][at[-1] + size <= end[at[-1]]]
        before = runs[-1][at[-1] + size <= end[at[-1]]]
        last = fits + size - 1
        runs.append(shifted(before, lengths[last] + 1) ^ spaced[last])
        at.append(fits)
    return [(r % np.uint32(buckets)).astype(np.int64) for r in runs], at, w.first


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts (one string column) fall into each bucket, exactly."""
    schema = pa.schema([("counts", pa.binary())])
    row = lambda total: pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            rows = encoded(batch.column(0))
            for a, b in blocks(rows):
                for found in feature_buckets(rows[a:b], buckets)[0]:
                    total += np.bincount(found, minlength=buckets)
        yield row(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for counts in batch.column(0):
                total += np.frombuffer(counts.as_py(), np.int64)
        yield row(total)

    found = texts.mapInArrow(count, "counts binary").repartition(MERGES).mapInArrow(add, "counts binary").toArrow()
    return sum((np.frombuffer(c.as_py(), np.int64) for c in found.column(0)), np.zeros(buckets, np.int64))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of shares, of a bucket each, with one added to every count; floors."""
    n = len(corpus)
    s, t = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: str) -> int:
    """Thousandths of standard Gumbel noise that an id determines; no id is the empty string."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_scores(docs: DataFrame, target: DataFrame, buckets: int = 10_000, seed: str = "42", tag: str | None = None) -> DataFrame:
    """doc_id, tag, n_words, n_features, weight, score of every row of docs (doc_id, text), target having text.

    Words are runs of digits, letters and non-ASCII, A-Z as a-z. Null and empty texts have
    no features and weight 0. Rows stand for themselves, repeated ones too; a null doc_id
    has the noise of the empty string. `tag` names a long column of docs that comes along;
    others are ignored. A text of over half a MB is hashed alone and takes about 100 times
    its size. Empty tables count as no features, or give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), (F.col(tag) if tag else F.lit(None)).cast("long").alias("tag"), F.col("text").cast("string"))
    own = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs.select("text"), buckets), bucket_counts(target.select(F.col("text").cast("string")), buckets)))
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "tag", "n_words", "n_features", "weight", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = own.value
        for batch in batches:
            ids, texts = batch.column(0), encoded(batch.column(2))
            for a, b in blocks(texts):
                found, at, first = feature_buckets(texts[a:b], buckets)
                total = np.zeros(first[-1] + 1, np.int64)
                for where, k in zip(at, found, strict=True):
                    total[where + 1] += gain[k]
                total = np.cumsum(total)
                weight = total[first[1:]] - total[first[:-1]]
                words = np.diff(first)
                features = words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0)
                score = weight + np.array([noise(x, seed) for x in ids.slice(a, b - a).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(x, pa.int64()) for x in (words, features, weight, score))], schema=schema)

    return docs.mapInArrow(run, "doc_id long, tag long, n_words long, n_features long, weight long, score long")


class Tournament:
    """A tree of matches between the heads of sorted runs; the least head stands at its root."""

    def __init__(self) -> None:
        self.runs: list[Iterator[tuple]] = [iter(())]
        self.tree: list[tuple | None] = [None, None]  # leaves from len(runs) on: (head, leaf)
        self.free = [0]

    def enter(self, run: Iterator[tuple]) -> None:
        if not self.free:
            n = len(self.runs)
            self.free = list(range(n, 2 * n))
            self.runs += [iter(())] * n
            self.tree = [None] * (2 * n) + self.tree[n:] + [None] * n
            for i in range(2 * n - 1, 0, -1):
                self.tree[i] = self._better(2 * i)
        leaf = self.free.pop()
        self.runs[leaf] = run
        self._advance(leaf)

    def _better(self, i: int) -> tuple | None:
        a, b = self.tree[i], self.tree[i + 1]
        return a if b is None or (a is not None and a <= b) else b

    def _advance(self, leaf: int) -> None:
        head = next(self.runs[leaf], None)
        if head is None:
            self.free.append(leaf)
        i = len(self.runs) + leaf
        self.tree[i] = None if head is None else (head, leaf)
        while i > 1:
            i //= 2
            self.tree[i] = self._better(2 * i)

    def winners(self, before: tuple | None = None) -> Iterator[tuple]:
        """Rows in order, all of them or those less than a given one."""
        while (best := self.tree[1]) is not None and (before is None or best[0] < before):
            self._advance(best[1])
            yield best[0]


#: A row of a run: its place in the order first, then what comes along; none and untagged say where doc_id and tag are null.
ROW = ("worse", "none", "id", "n_features", "weight", "n_words", "untagged", "mark")


def place() -> list[Column]:
    return [(-F.col("score")).alias("worse"), F.col("doc_id").isNull().cast("long").alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id")]


def before(border: tuple[int, int, int] | None) -> Column:
    """Whether a row's place is before a border; all are before none."""
    return F.lit(True) if border is None else F.struct(*place()) < F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(border, ROW, strict=False)])


def runs_of(rows: DataFrame, borders: list[tuple[int, int, int] | None]) -> DataFrame:
    """Pieces (range, worse, none, id, rows, lists of ROW) of every partition's sorted run of rows."""
    names = [f"{c}s" for c in ROW]
    ends = [b for b in borders if b is not None]
    schema = pa.schema([("range", pa.int32()), *((c, pa.int64()) for c in ROW[:3]), ("rows", pa.int64()), *((c, pa.list_(pa.int64())) for c in names)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            at = 0
            while at < len(heads):
                number = bisect_right(ends, heads[at])
                end = len(heads) if number == len(ends) else bisect_left(heads, ends[number], at)
                end = min(end, at + PIECE)
                lists = [pa.ListArray.from_arrays(pa.array([0, end - at], pa.int32()), c.slice(at, end - at)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([x]) for x in heads[at]), pa.array([end - at]), *lists], schema=schema)
                at = end

    flat = rows.select(*place(), "n_features", "weight", "n_words", F.col("tag").isNull().cast("long").alias("untagged"), F.coalesce("tag", F.lit(0)).cast("long").alias("mark"))
    return flat.sortWithinPartitions(*ROW).mapInArrow(cut, "range int, worse long, none long, id long, rows long, " + ", ".join(f"{c} array<long>" for c in names))


def merged(runs: DataFrame, first_rank: dict[int, int], draw: int) -> DataFrame:
    """The rows of runs, ranked; those behind the draw have no rank."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "tag", "n_words", "n_features", "weight", "score", "rank")])

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rank, tree, found = None, 0, Tournament(), []

        def take(winners: Iterator[tuple]) -> None:
            nonlocal rank
            for worse, none, key, features, weight, words, untagged, mark in winners:
                rank += 1
                found.append((None if none else key, None if untagged else mark, words, features, weight, -worse, rank if rank <= draw else None))

        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column(0)[i].as_py()
                run = list(zip(*(batch.column(4 + j)[i].as_py() for j in range(1, 1 + len(ROW))), strict=True))
                if number != at:
                    take(tree.winners())
                    at, rank, tree = number, first_rank[number], Tournament()
                take(tree.winners(run[0]))
                tree.enter(iter(run))
                if len(found) >= PIECE:
                    yield rows(found)
                    found = []
        take(tree.winners())
        yield rows(found)

    dealt = runs.repartition("range").sortWithinPartitions("range", *ROW[:3])
    return dealt.mapInArrow(play, "doc_id long, tag long, n_words long, n_features long, weight long, score long, rank long")


def drawn(scored: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """Adds rank: 1, 2, 3.. for the floor(percent * n / 100) largest scores of the n rows of least_words or more.

    Ties go to the smaller doc_id, a null one last, and then to fewer features. The other
    rows have a null rank. scored has the columns of importance_scores.
    """
    scored = durable(scored)
    eligible = scored.where(F.col("n_words") >= least_words)
    n = eligible.count()
    draw = percent * n // 100
    if not draw:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    heads = sorted(tuple(r) for r in eligible.sample(False, min(1.0, SAMPLE / n), 7).select(*place()).collect())  # about SAMPLE rows
    wanted = min(RANGES, max(partitions(scored.sparkSession), draw // RANGE_ROWS + 1))
    share = percent / 100
    while True:
        share = min(1.0, share * 1.25 + 0.002)  # more than the draw, whatever the sample
        best = heads[: math.ceil(share * len(heads))]
        borders: list[tuple[int, int, int] | None] = sorted({best[i * len(best) // wanted] for i in range(1, wanted)}) if best else []
        borders.append(None if share == 1.0 or not best else best[-1])
        borders = [b for i, b in enumerate(borders) if b is None or i == 0 or b != borders[i - 1]]
        runs = durable(runs_of(eligible.where(before(borders[-1])), borders))
        sizes = {r["range"]: r.n for r in runs.groupBy("range").agg(F.sum("rows").alias("n")).collect()}  # RANGES at most
        if sum(sizes.values()) >= draw:
            break
    first, total, last = {}, 0, 0
    for number in sorted(sizes):
        if total < draw:
            first[number], last = total, number
        total += sizes[number]
    taken = merged(runs.where(F.col("range") <= last), first, draw)
    rest = scored.where(~((F.col("n_words") >= least_words) & before(borders[last])))
    return taken.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: str = "42", tag: str | None = None) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs: a draw that resembles the target's texts.

    See importance_scores for nulls, repeated rows and columns, and drawn for ties. The
    same rows give the same draw in any partitioning.
    """
    out = drawn(importance_scores(docs, target, buckets, seed, tag), percent, least_words)
    return out.select("doc_id", "n_features", "weight", "score", "rank", *([F.col("tag").alias(tag)] if tag else []))


def drawn_documents(docs: DataFrame, target: DataFrame, percent: int = 5, **how) -> DataFrame:
    """The rows of docs that the draw takes, whole, with draw_rank; of rows with one doc_id and text any stands for its ranks."""
    ranks = resampled(docs.select("doc_id", "text", F.xxhash64("text").alias("mark__")), target, percent, tag="mark__", **how)
    ranks = ranks.where("rank is not null").select(F.col("doc_id").alias("key__"), F.col("mark__"), F.col("rank").alias(unused(docs, "draw_rank")))
    text = unused(docs, "text__")
    own = docs.withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text])
    return own.join(ranks, own["doc_id"].eqNullSafe(F.col("key__")) & (F.col(text) == F.col("mark__"))).drop("key__", "mark__", text)
