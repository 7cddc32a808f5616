"""Finding benchmark passages in documents by a prefix-filtered set join.

An item is the set of its 13-word windows. A document holds a window only if it holds all
of its words, so one word per window is a sufficient prefix: its rarest in the corpus. The
join looks documents' words up among these anchors, derives where the window would have to
start, drops starts that don't fit into the document, compares the window's hash there,
and last the words themselves.

Scale: the documents are read twice and never shuffled. Rarity comes from word counts in a
table of fixed size. Windows go to the executors in slices of bounded size. A benchmark of
up to SLICE_BYTES is one slice; a larger one takes a pass over all documents for each, whose
rows are written out and numbered first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.llm.common import ALNUM, STEPS, Words, blocks, durable, encoded, mix, slot_counts

#: Slots of the table of word counts.
SLOTS = 1 << 18
#: Bytes of item texts whose windows are broadcast at a time.
SLICE_BYTES = 8 << 20
#: Words of a piece of an item; longer items are dealt in pieces that overlap by a window.
PIECE = 100_000
#: The prefilter of anchors has so many bits.
BITS = 1 << 22


def rarity(docs: DataFrame) -> np.ndarray:
    """Counts of all documents' words by hash slot."""
    return slot_counts(docs.select("text"), lambda texts: Words(texts, ALNUM).hashes, SLOTS)


class Windows:
    """The distinct windows of a slice of items, by anchor; their words stay in the items.

    All windows are hashed and given their anchors side by side; two sequences are taken for
    one with a chance of 2 ** -128.
    """

    def __init__(self, items: list[tuple[str, bytes]], length: int, counts: np.ndarray):
        self.names = [name for name, _ in items]
        w = Words([text for _, text in items], ALNUM)
        self.data, self.starts, self.ends = w.data, w.starts.astype(np.int32), w.ends.astype(np.int32)
        words = np.diff(w.first)
        full = np.repeat(w.first[:-1], words), np.repeat(np.arange(len(items)), words)
        inside = np.arange(len(w.hashes)) + length <= w.first[1:][full[1]]
        short = np.flatnonzero((words > 0) & (words < length))
        first = np.concatenate([np.flatnonzero(inside), w.first[:-1][short]])
        item = np.concatenate([full[1][inside], short])
        size = np.concatenate([np.full(int(inside.sum()), length, np.int64), words[short]])
        seldom = counts[(w.hashes % np.uint64(SLOTS)).astype(np.int64)]
        sums, other = np.zeros((2, len(first)), np.uint64)
        rarest, offset = np.full(len(first), np.iinfo(np.int64).max), np.zeros(len(first), np.int64)
        for j in range(length):
            some = size > j
            at = first[some] + j
            sums[some] += w.hashes[at] * STEPS[j]
            other[some] += w.hashes[at] * STEPS[length + j]
            better = some.copy()
            better[some] = seldom[at] < rarest[some]
            rarest[better], offset[better] = seldom[first[better] + j], j
        hashes, other = mix(sums + size.astype(np.uint64)), mix(other + size.astype(np.uint64))
        order = np.lexsort((item, other, hashes))
        new = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (other[order][1:] != other[order][:-1])])[: len(order)]
        group = np.cumsum(new) - 1
        own = order[new]
        #: Names of windows that several items hold, by their place in the arrays below.
        shared: dict[int, set[str]] = {}
        for g, i in zip(group[~new].tolist(), item[order][~new].tolist(), strict=True):
            shared.setdefault(g, {self.names[item[own[g]]]}).add(self.names[i])
        anchors = w.hashes[first[own] + offset[own]] if len(own) else np.empty(0, np.uint64)
        by_anchor = np.argsort(anchors, kind="stable")
        place = np.empty(len(own), np.int64)
        place[by_anchor] = np.arange(len(own))
        self.shared = {int(place[g]): sorted(names) for g, names in shared.items() if len(names) > 1}
        own = own[by_anchor]
        self.anchors, self.offsets, self.lengths, self.hashes = anchors[by_anchor], offset[own], size[own], hashes[own]
        self.item, self.first = item[own].astype(np.int32), first[own].astype(np.int32)
        self.bits = np.zeros(BITS, bool)
        self.bits[(self.anchors % np.uint64(BITS)).astype(np.int64)] = True

    def text(self, k: int) -> bytes:
        a = int(self.first[k])
        return b" ".join(self.data[self.starts[i] : self.ends[i]] for i in range(a, a + int(self.lengths[k])))

    def holders(self, k: int) -> list[str]:
        """Names of the items that hold a window."""
        return self.shared.get(k) or [self.names[self.item[k]]]


def occurrences(w: Words, windows: Windows) -> Iterator[tuple[int, int, int]]:
    """(index of the first word, number of words, window) wherever a window occurs in a text."""
    at = np.flatnonzero(windows.bits[(w.hashes % np.uint64(BITS)).astype(np.int64)])
    if not len(at):
        return
    low, high = (np.searchsorted(windows.anchors, w.hashes[at], side) for side in ("left", "right"))
    at, low, high = (x[high > low] for x in (at, low, high))
    n = high - low
    if not n.sum():
        return
    place = np.repeat(at, n)
    window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    start, size = place - windows.offsets[window], windows.lengths[window]
    text = np.searchsorted(w.first, place, "right") - 1
    fits = (start >= w.first[text]) & (start + size <= w.first[text + 1])
    start, size, window = start[fits], size[fits], window[fits]
    for length in np.unique(size):
        some = size == length
        s, k = start[some], window[some]
        sums = np.zeros(len(s), np.uint64)
        for j in range(length):
            sums += w.hashes[s + j] * STEPS[j]
        same = mix(sums + np.uint64(length)) == windows.hashes[k]
        for a, b in zip(s[same].tolist(), k[same].tolist(), strict=True):
            if b" ".join(w.data[w.starts[i] : w.ends[i]] for i in range(a, a + int(length))) == windows.text(b):
                yield a, int(length), b


def marked(docs: DataFrame, windows: Windows) -> DataFrame:
    """row__, doc_id, tag, n_words, hits (ranges of words), items of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    schema = pa.schema([("row__", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            texts = encoded(batch.column(3))
            hits: list[list[int]] = [[] for _ in texts]
            items: list[set[str]] = [set() for _ in texts]
            counts: list[int] = []
            for a, b in blocks(texts):
                w = Words(texts[a:b], ALNUM)
                counts += np.diff(w.first).tolist()
                for start, length, k in occurrences(w, windows):
                    text = int(np.searchsorted(w.first, start, "right")) - 1
                    first = start - int(w.first[text])
                    hits[a + text] += [first, first + length]
                    items[a + text].update(windows.holders(k))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(counts, pa.int64()), pa.array(list(map(united, hits)), pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], schema=schema)

    return docs.select("row__", "doc_id", "tag", "text").mapInArrow(run, "row__ long, doc_id long, tag long, n_words long, hits array<long>, items array<string>")


def united(ranges: list[int]) -> list[int]:
    """Ranges [a, b, a, b, ..] as disjoint ones in order."""
    out: list[int] = []
    for a, b in sorted(zip(ranges[::2], ranges[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def pieces(items: DataFrame, length: int) -> DataFrame:
    """items (item, text), long texts as pieces of PIECE words that hold the same windows."""
    schema = pa.schema([("item", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
                w = Words([text], ALNUM)
                n, at = len(w.starts), 0
                while at == 0 or at + length - 1 < n:
                    end = min(n, at + PIECE)
                    part = w.data[w.starts[at] : w.ends[end - 1]] if n else b""
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part.decode()])], schema=schema)
                    at = max(1, end - length + 1)

    return items.mapInArrow(run, "item string, text string")


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 13, one_in: int = 20, tag: str | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs.

    docs has doc_id and text, benchmark item_id and text. An item of fewer than `length`
    words, but not none, is one window. A document word inside an occurrence of a window
    is hit; a document is contaminated when at least one in `one_in` of its words is.
    Null and empty texts have no words. Rows that repeat an item_id count as one item, a
    null item_id as an item named by the empty string, rows that repeat a doc_id each for
    themselves. `tag` names a long column of docs that comes along; other columns are
    ignored. Empty tables give no hits or no rows. A text of over half a MB is hashed alone and
    takes about 50 times its size.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (F.col(tag) if tag else F.lit(None)).cast("long").alias("tag"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    items = durable(pieces(items, length))
    counts = rarity(docs)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-size // SLICE_BYTES))
    # Rows keep their numbers over all passes only because they are written out with them.
    docs = docs.withColumn("row__", F.lit(0).cast("long")) if slices == 1 else durable(docs.withColumn("row__", F.monotonically_increasing_id()))
    dealt = items.withColumn("slice__", F.pmod(F.xxhash64("item", "text"), F.lit(slices)))
    found = None
    for k in range(slices):
        rows = [(r.item, r.text.encode()) for r in dealt.where(F.col("slice__") == k).orderBy("item", "text").collect()]  # about SLICE_BYTES
        part = marked(docs, Windows(rows, length, counts))
        part = part if slices == 1 else durable(part)
        found = part if found is None else found.unionByName(part)
    if slices > 1:
        merge = F.pandas_udf(lambda s: s.map(lambda x: united([int(y) for r in x for y in r])), "array<long>")
        found = found.groupBy("row__").agg(F.first("doc_id").alias("doc_id"), F.first("tag").alias("tag"), F.first("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = found.withColumn("hits", merge("hits"))
    n_hit = F.expr("aggregate(sequence(1, size(hits) div 2), 0L, (n, i) -> n + coalesce(hits[2 * i - 1] - hits[2 * i - 2], 0L))")
    out = found.withColumn("n_hit", F.when(F.size("hits") > 0, n_hit).otherwise(F.lit(0).cast("long")))
    contaminated = (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated.alias("contaminated"), *([F.col("tag").alias(tag)] if tag else []))
