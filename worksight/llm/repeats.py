"""Removing passages that stand earlier in the corpus, with automata of the repeated phrases.

A window is a run of `length` words. Of every window the least of its hashed `length` / 2 word
runs is its anchor, so equal windows have equal anchors, and a piece is what one anchor
covers of a document: windows in a row, a few for each word run chosen.

1. Anchors are counted. A table of fixed size tells which may be there twice; all others are
   out, and most unique text with them.
2. The pieces that remain meet by anchor and confirm which of their windows recur, and where
   each stands first. Rows in a row of such windows whose first places are in a row too are a
   phrase: a place in a document, and where the corpus has it first.
3. Phrases and whole documents meet in buckets of documents. Of a bucket's phrases blocks of
   words, of which every window holds one, are compiled to an Aho-Corasick automaton. All documents of
   the bucket stream through it; block hits grow to the longest common runs of words, and
   the words of those that stand later than the phrase's first place go.

Scale: an automaton holds the phrases of one bucket, so it is bounded by the bucket's text;
a phrase goes once to each bucket that has it, however often it is in there, as a place
in one of the bucket's documents, not as text. Anchors with very many pieces are dealt in
slices by document, and their windows' first places are found by an aggregation over the
slices. Texts are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.llm.common import STEPS, Words, blocks, durable, encoded, mix

#: Bits of the table of anchors that may recur, and of one page of it as the aggregate makes them.
TABLE, PAGE = 1 << 26, 1 << 15
#: An anchor with more pieces, and more than one in HOTTEST of all, is dealt in slices of as many; there are HOTTEST at most.
SLICE, HOTTEST = 1024, 1 << 20
#: Bytes of text that a bucket is meant to hold, and pieces that are resolved at a time.
BUCKET_BYTES, RESOLVE = 4 << 20, 50_000
#: Symbols of the automata; a word is spelled in a few of them, so that no node has more children.
SYMBOLS = 128
#: Words that are compared at a time.
STRIDE = 12


class Pieces:
    """The pieces of a block of texts: text, first word in it, anchor, and the hashes of their windows from low to high."""

    def __init__(self, texts: list[bytes], length: int, windows: bool = True):
        w = Words(texts, lower=False)
        half = length // 2
        n = len(w.hashes) - length + 1
        self.windows = self.anchors = np.empty(0, np.uint64)
        self.text = self.start = self.low = self.high = np.empty(0, np.int64)
        if n <= 0:
            return
        runs = len(w.hashes) - half + 1
        sums = w.hashes[:runs] * STEPS[0]
        for j in range(1, half):
            sums += w.hashes[j : runs + j] * STEPS[j]
        sums = mix(sums)
        span = length - half + 1
        least = sums[:n].copy()
        for j in range(1, span):
            np.minimum(least, sums[j : n + j], out=least)
        at = np.zeros(n, np.int64)
        for j in range(span - 1, -1, -1):  # the leftmost of equal ones
            at[sums[j : n + j] == least] = j
        at += np.arange(n)
        if windows:
            self.windows = mix(sums[:n] * STEPS[40] + sums[length - half : n + length - half] * STEPS[41])
        text = np.repeat(np.arange(len(texts)), np.diff(w.first))[:n]
        whole = np.arange(n) + length <= w.first[1:][text]
        new = whole & np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]])
        self.low = np.flatnonzero(new)
        ends = np.flatnonzero(whole & np.concatenate([new[1:] | ~whole[1:], [True]]))
        self.high = ends + 1
        self.text, self.anchors = text[self.low], least[self.low]
        self.start = self.low - w.first[self.text]


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """anchor of every piece of docs (text)."""
    schema = pa.schema([("anchor", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(0))
            for a, b in blocks(texts):
                yield pa.RecordBatch.from_arrays([pa.array(Pieces(texts[a:b], length, windows=False).anchors.view(np.int64))], schema=schema)

    return docs.select("text").mapInArrow(run, "anchor long")


def recurring(counted: DataFrame) -> np.ndarray:
    """A table of TABLE bits, packed: set where an anchor of counted may be."""
    slot = (F.pmod("anchor", F.lit(TABLE)) + 1).alias("slot")
    pages = counted.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros((TABLE // PAGE, PAGE // 8), np.uint8)
    for row in pages.collect():  # TABLE / 8 bytes in all
        out[row.page - 1, : len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def pieces(docs: DataFrame, length: int, table: np.ndarray, hot: dict[int, int], hot_ones: bool) -> DataFrame:
    """anchor, slice, bucket, none, doc_id, mark, start, windows of the pieces of docs whose anchor may recur.

    hot has the slices of anchors that need several, from 1; pieces of one document are in one
    slice. Either these come out, or all others, whose slice is 0.
    """
    known = docs.sparkSession.sparkContext.broadcast((table, np.array(sorted(hot), np.int64), np.array([hot[k] for k in sorted(hot)], np.int64)))
    schema = pa.schema([("anchor", pa.int64()), ("slice", pa.int32()), ("bucket", pa.int64()), ("none", pa.int32()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("windows", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, keys, slices = known.value
        for batch in batches:
            texts = encoded(batch.column(5))
            bucket, none, ids, marks, deal = (batch.column(i).to_numpy() for i in range(5))
            for a, b in blocks(texts):
                p = Pieces(texts[a:b], length)
                anchor = p.anchors.view(np.int64)
                slot = anchor & (TABLE - 1)
                keep = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                text, anchor = p.text[keep] + a, anchor[keep]
                part = np.zeros(len(keep), np.int64)
                if len(keys):
                    found = np.minimum(np.searchsorted(keys, anchor), len(keys) - 1)
                    part = np.where(keys[found] == anchor, 1 + deal[text] % slices[found], 0)
                chosen = np.flatnonzero((part > 0) == hot_ones)
                keep, text, anchor, part = keep[chosen], text[chosen], anchor[chosen], part[chosen]
                data = [p.windows[x:y].tobytes() for x, y in zip(p.low[keep], p.high[keep], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part, pa.int32()), pa.array(bucket[text]), pa.array(none[text], pa.int32()), pa.array(ids[text]), pa.array(marks[text]), pa.array(p.start[keep]), pa.array(data, pa.binary())], schema=schema)

    return docs.select("bucket", "none", "doc_id", "mark", "deal", "text").mapInArrow(run, "anchor long, slice int, bucket long, none int, doc_id long, mark long, start long, windows binary")


PHRASE = "anchor long, slice int, window long, bucket long, none int, doc_id long, mark long, start long, windows long, rows long, first_none int, first_id long, first_start long"


def resolved(found: DataFrame) -> DataFrame:
    """Phrases of pieces, each bucket's first places of them; rows of PHRASE.

    Where slice is 0, all pieces of the anchor were seen: phrases are of windows that recur,
    as many in a row as can be. Else a phrase is one window, and rows is how often the
    slice has it in that bucket; others may know an earlier place.
    """
    schema = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in PHRASE.split(", ")])

    def solve(t: pa.Table) -> pa.RecordBatch:
        data = t.column("windows").combine_chunks()
        data = data if isinstance(data, pa.Array) else pa.concat_arrays(data.chunks)
        sizes = np.array([len(x) // 8 for x in data.to_pylist()], np.int64)
        window = np.frombuffer(b"".join(data.to_pylist()), np.int64)
        piece = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(window)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        col = lambda c: t.column(c).to_numpy()
        anchor, part, bucket, none, ids, marks, start = (col(c)[piece] for c in ("anchor", "slice", "bucket", "none", "doc_id", "mark", "start"))
        start = start + at
        place = (start, ids, none)
        order = np.lexsort((*place, window, part, anchor))
        same = lambda *cs: np.concatenate([[False], np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in cs])])
        new = ~same(anchor, part, window)
        group = np.cumsum(new) - 1
        head = order[np.flatnonzero(new)]
        rows, first = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        rows[order], first[order] = np.bincount(group, minlength=1)[group], head[group]
        order = np.lexsort((*place, bucket, window, part, anchor))
        leads = np.zeros(len(order), bool)
        leads[order] = ~same(anchor, part, window, bucket)
        inside = np.zeros(len(order), np.int64)
        number = np.cumsum(leads[order]) - 1
        inside[order] = np.bincount(number, minlength=1)[number]
        hot = part > 0
        # A place that is the only one of its bucket, and the first of all, has nothing to tell there.
        keep = leads & (hot | ((rows > 1) & ((inside > 1) | (first != np.arange(len(first))))))
        k = np.flatnonzero(keep)
        follows = np.zeros(len(k), bool)
        if len(k) > 1:
            p, q = k[:-1], k[1:]
            follows[1:] = (q == p + 1) & (piece[q] == piece[p]) & ~hot[q] & (first[q] == first[p] + 1) & (piece[first[q]] == piece[first[p]])
        lead = np.flatnonzero(~follows)
        length = np.diff(np.concatenate([lead, [len(k)]]))
        k = k[lead]
        f = first[k]
        values = [anchor[k], part[k], window[k], bucket[k], none[k], ids[k], marks[k], start[k], length, np.where(hot[k], inside[k], rows[k]), none[f], ids[f], start[f]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            keys = [(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()) for i in (0, batch.num_rows - 1)] if batch.num_rows else []
            if not keys:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= RESOLVE and keys[0] != keys[1]:
                # The last group may go on in the next batch.
                a, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cut = int(np.flatnonzero((a != a[-1]) | (s != s[-1]))[-1]) + 1
                held[-1] = batch.slice(0, cut)
                yield solve(pa.Table.from_batches(held))
                held, rows = [batch.slice(cut)], batch.num_rows - cut
        if held:
            yield solve(pa.Table.from_batches(held))

    return found.mapInArrow(run, PHRASE)


def phrases(docs: DataFrame, length: int, table: np.ndarray, hot: dict[int, int]) -> DataFrame:
    """bucket, none, doc_id, mark, start, windows, first_none, first_id, first_start of the phrases of docs."""
    columns = ["bucket", "none", "doc_id", "mark", "start", "windows", "first_none", "first_id", "first_start"]

    def found(hot_ones: bool) -> DataFrame:
        dealt = pieces(docs, length, table, hot, hot_ones).repartition("anchor", "slice")
        return resolved(dealt.sortWithinPartitions("anchor", "slice", "none", "doc_id", "start"))

    out = found(False).select(columns)
    if not hot:
        return out
    # What the slices know of a bucket's places of a window is one row.
    lead = F.min(F.struct("none", "doc_id", "start", "mark")).alias("lead")
    parts = found(True).groupBy("anchor", "window", "bucket").agg(lead, F.sum("rows").alias("rows"))
    parts = durable(parts.select("anchor", "window", "bucket", "lead.*", F.lit(1).cast("long").alias("windows"), "rows"))
    places = parts.groupBy("anchor", "window").agg(F.min(F.struct("none", "doc_id", "start")).alias("first"), F.sum("rows").alias("rows")).where("rows > 1")
    joined = parts.drop("rows").join(places, ["anchor", "window"])
    joined = joined.withColumns({"first_none": F.col("first.none"), "first_id": F.col("first.doc_id"), "first_start": F.col("first.start")})
    return out.unionByName(joined.select(columns))


class Automaton:
    """Blocks of the phrases of a bucket; finds where texts hold `length` words or more of one."""

    def __init__(self, passages: list[tuple[list[bytes], tuple[int, int, int]]], length: int):
        self.passages, self.length, self.block = passages, length, max(1, length // 3)
        ids: dict[bytes, int] = {}
        for words, _ in passages:
            for x in words:
                ids.setdefault(x, len(ids) + 1)
        self.digits = 1
        while SYMBOLS**self.digits <= len(ids):
            self.digits += 1
        self.none = "\0" * self.digits
        self.code = {x: "".join(chr(i // SYMBOLS**d % SYMBOLS) for d in range(self.digits)) for x, i in ids.items()}
        self.places: list[list[tuple[int, int]]] = []
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, (words, _) in enumerate(passages):
            # So far apart that every `length` words hold one whole.
            for at in range(0, len(words) - self.block + 1, length - self.block + 1):
                key = "".join(map(self.code.__getitem__, words[at : at + self.block]))
                number = self.tree.get(key, -1)
                if number < 0:
                    number = len(self.places)
                    self.places.append([])
                    self.tree.add_word(key, number)
                self.places[number].append((k, at))
        if self.places:
            self.tree.make_automaton()

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(passage, word in it, word in the text, words) of the longest common runs of `length` or more."""
        if len(words) < self.length or not self.places:
            return
        text = "".join([self.code.get(x, self.none) for x in words])
        upto: dict[tuple[int, int], int] = {}
        for end, number in self.tree.iter(text):
            if (end + 1) % self.digits:
                continue
            here = (end + 1) // self.digits - self.block
            for k, at in self.places[number]:
                if upto.get((k, here - at), -1) > here:
                    continue
                own = self.passages[k][0]
                a, b, x, y = here, at, here + self.block, at + self.block
                # Many words at a time as long as they agree, then one by one.
                while a >= STRIDE and b >= STRIDE and words[a - STRIDE : a] == own[b - STRIDE : b]:
                    a, b = a - STRIDE, b - STRIDE
                while a and b and words[a - 1] == own[b - 1]:
                    a, b = a - 1, b - 1
                while x + STRIDE <= len(words) and y + STRIDE <= len(own) and words[x : x + STRIDE] == own[y : y + STRIDE]:
                    x, y = x + STRIDE, y + STRIDE
                while x < len(words) and y < len(own) and words[x] == own[y]:
                    x, y = x + 1, y + 1
                upto[k, here - at] = x
                if x - a >= self.length:
                    yield k, b, a, x - a


def cleaned(docs: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """doc_id, tag, n_words, n_removed, kept_text of every row of docs; found has the phrases."""
    refs = found.withColumns({"leg": F.lit(0), "tag": F.lit(None).cast("long"), "text": F.lit(None).cast("string")})
    nothing = F.lit(None).cast("long")
    rows = docs.withColumns({"leg": F.lit(1), **{c: nothing for c in ("start", "windows", "first_id", "first_start")}, "first_none": F.lit(None).cast("int")})
    columns = ["bucket", "leg", "none", "doc_id", "mark", "start", "windows", "first_none", "first_id", "first_start", "tag", "text"]
    both = refs.select(columns).unionByName(rows.select(columns)).repartition("bucket").sortWithinPartitions("bucket", "leg", "none", "doc_id", "mark", "start")
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def passages(refs: list[tuple], words: dict[tuple, list[bytes]]) -> list[tuple[list[bytes], tuple[int, int, int]]]:
        out, at = [], 0
        while at < len(refs):
            doc, start, n, first = refs[at]
            at += 1
            # Phrases that follow each other here and where they stand first are one.
            while at < len(refs) and refs[at][0] == doc and refs[at][1] == start + n and refs[at][3] == (first[0], first[1], first[2] + n):
                n += refs[at][2]
                at += 1
            if doc in words:
                out.append((words[doc][start : start + n + length - 1], first))
        return out

    def clean(refs: list[tuple], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        texts = [text.split() for *_, text in rows]
        tree = Automaton(passages(refs, {row[:3]: w for row, w in zip(rows, texts, strict=True)}), length) if refs else None
        out: list[tuple] = []
        size = 0
        for (none, doc_id, _, tag, text), words in zip(rows, texts, strict=True):
            gone = np.zeros(len(words), bool)
            if tree is not None:
                for k, b, a, n in tree.find(words):
                    first = tree.passages[k][1]
                    if (none, doc_id, a) > (first[0], first[1], first[2] + b):
                        gone[a : a + n] = True
            removed = int(gone.sum())
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed else words
            out.append((None if none else doc_id, tag, len(words), removed, b" ".join(kept)))
            size += len(text)
            if size > BUCKET_BYTES:
                yield batch_of(out)
                out, size = [], 0
        yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary()).cast(pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, refs, rows = None, [], []
        for batch in batches:
            buckets, legs, none, ids, marks, starts, windows, first_none, first_id, first_start, tags = (batch.column(i).to_pylist() for i in range(11))
            texts = encoded(batch.column(11))
            for i in range(batch.num_rows):
                if buckets[i] != at:
                    yield from clean(refs, rows)
                    at, refs, rows = buckets[i], [], []
                if legs[i] == 0:
                    refs.append(((none[i], ids[i], marks[i]), starts[i], windows[i], (first_none[i], first_id[i], first_start[i])))
                else:
                    rows.append((none[i], ids[i], marks[i], tags[i], texts[i]))
        yield from clean(refs, rows)

    return both.mapInArrow(run, "doc_id long, tag long, n_words long, n_removed long, kept_text string")


def without_repeats(docs: DataFrame, length: int = 20, tag: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row of docs (doc_id, text).

    Words are runs of anything but ASCII white space, unchanged. A window of `length` words
    (even, 2 to 64) goes where its words also stand earlier: at a smaller doc_id, or under the same doc_id at a
    smaller place; so of rows that repeat a doc_id none is earlier than the other at one
    place, and equal ones stay. A null doc_id comes after all others. Windows are judged on
    the texts as they are; kept_text joins the words left with a space. Null, empty and
    short texts lose nothing. `tag` names a long column of docs that comes along; others are
    ignored. Sequences are compared as hashes of 128 bits between buckets and as words
    within; a text of over half a MB is hashed alone and takes about 100 times its size, and
    one larger than a bucket is a bucket's load of its own. No rows in, none out.
    """
    if length % 2 or not 2 <= length <= 64:
        raise ValueError("length must be even, from 2 to 64")
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc_id"), (F.col(tag) if tag else F.lit(None)).cast("long").alias("tag"), text.alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("mark"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = F.shiftrightunsigned(F.xxhash64("none", "doc_id", "mark"), 1)
    buckets = size // BUCKET_BYTES + 1
    docs = docs.withColumn("dealt", dealt).withColumns({"bucket": F.col("dealt") % buckets, "deal": F.expr(f"dealt div {buckets}")}).drop("dealt")
    counted = anchors(docs, length).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    counted = durable(counted)
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(SLICE, total // HOTTEST)
    hot = {r.anchor: -(-r.n // least) for r in counted.where(F.col("n") > least).collect()}  # HOTTEST at most
    out = cleaned(docs, phrases(docs, length, recurring(counted), hot), length)
    return out.select("doc_id", "n_words", "n_removed", "kept_text", *([F.col("tag").alias(tag)] if tag else []))
