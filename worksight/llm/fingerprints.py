"""Document fingerprints from closed syncmers, by DataFrame functions only.

A text is the sequence of its UTF-8 bytes. A k-mer of K bytes is a closed syncmer when the
least hash of its inner substrings of S bytes lies at its first or last one. That depends
on the k-mer alone, not on what stands around it, so an edit changes anchors only where it
touches them, spaces or none. Of K - S neighbouring k-mers at least one is chosen.

An anchor is a long: a hash of the k-mer in the upper half, its position in bytes in the
lower one. The fingerprint lists all anchors in text order, each as eight hexadecimal
digits of the hash and two of the distance from the anchor before. A text that has no
syncmer but isn't empty has one anchor, the hash of all of it.

Likeness matches anchors by position: two anchors match when they have one hash and lie in
the same of PARTS equal parts of the longer text, counted from the start of either text or,
where that gives more, from its end. Matches over the pairs of hash and part that either
text has is the likeness. So passages that changed their order count as changed, text put
before or after the rest moves nothing else, and runs of one letter, where every k-mer is
chosen, count once a part.

Scale: a text is shuffled once, and its anchors are computed once, in pieces of CHUNK bytes.
Those of an edited text are the anchors left in its two parts and those across the seam.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worksight.llm.common import durable

K, S = 28, 4
#: Start positions that are looked at together; bounds the arrays of hashes.
CHUNK = 4096
#: Documents of a bucket in the walk to the next document, about: ROWS, and up to MOST where
#: that keeps the number of buckets, and with it a broadcast, small.
ROWS, MOST = 256, 4096
#: Buckets are dealt by so many quantiles of the ids, and evenly between two of these.
QUANTILES = 256
#: First rows of buckets that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Parts of the longer text in which anchors match.
PARTS = 8
UPPER, LOWER, SIGN = -(1 << 32), (1 << 32) - 1, -(1 << 63)


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def position(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit(LOWER))


def anchor_of(data: Column, at: Column) -> Column:
    return F.xxhash64(data).bitwiseOR(F.lit(SIGN)).bitwiseAND(F.lit(UPPER)) + at


def chunk_anchors(part: Column, base: Column) -> Column:
    """Anchors of the closed syncmers of some bytes (K at least), positions counted from base."""
    ends = K - S
    hashes = F.transform(F.sequence(F.lit(1), F.octet_length(part) - (S - 1)), lambda i: F.xxhash64(F.substring(part, i, F.lit(S))))
    least_of = lambda h, d: F.zip_with(h, F.slice(h, F.lit(1 + d), F.size(h)), lambda a, b: F.least(a, b))

    def chosen(h: Column, m: Column) -> Column:
        """m[i] is the least of the width hashes from i on; two of these cover what lies between the ends."""
        closed = lambda i: F.least(F.get(h, i), F.get(h, i + ends)) <= F.least(F.get(m, i + 1), F.get(m, i + (ends - width)))
        found = F.filter(F.sequence(F.lit(0), F.octet_length(part) - K), closed)
        return F.transform(found, lambda i: anchor_of(F.substring(part, i + 1, F.lit(K)), base + i))

    width = 1
    step = lambda h, m, d: chosen(h, m) if 2 * d > ends - 1 else bind(least_of(m, d), lambda m2: step(h, m2, 2 * d))
    while 2 * width <= ends - 1:
        width *= 2
    return bind(hashes, lambda h: step(h, h, 1))


def syncmers(data: Column, base: Column | None = None) -> Column:
    """Anchors of all closed syncmers of some bytes, in order."""
    base = F.lit(0).cast("long") if base is None else base
    starts = F.when(F.octet_length(data) >= K, F.sequence(F.lit(0), F.octet_length(data) - K, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda c: bind(F.substring(data, c + 1, F.lit(CHUNK + K - 1)), lambda part: chunk_anchors(part, base + c))))


def whole(found: Column, text: Column) -> Column:
    """The anchors, or for a text without any the one that stands for all of it."""
    return F.when((F.size(found) == 0) & (text != ""), F.array(anchor_of(text.cast("binary"), F.lit(0).cast("long")))).otherwise(found)


def anchors(text: Column) -> Column:
    """All anchors of a text, in order; none only where it is empty."""
    return bind(syncmers(text.cast("binary")), lambda found: whole(found, text))


def shown(found: Column) -> Column:
    """Ten hexadecimal digits an anchor. Hashes have their highest bit set, so that none has fewer."""
    before = F.concat(F.array(F.lit(0).cast("long")), found)
    digits = F.zip_with(found, F.slice(before, F.lit(1), F.size(found)), lambda x, y: F.hex(F.shiftrightunsigned(x, 32) * 256 + F.least(position(x) - position(y), F.lit(255))))
    return F.lower(F.array_join(digits, ""))


def likeness(a: Column, a_bytes: Column, b: Column, b_bytes: Column) -> Column:
    """Of two lists of anchors and their texts' lengths, 0 to 1; two empty lists are alike."""
    longer = F.greatest(a_bytes, b_bytes, F.lit(1))
    # The part in which an anchor lies takes the place of its position.
    placed = lambda found, place: F.transform(found, lambda x: x.bitwiseAND(F.lit(UPPER)) + F.floor(place(position(x)) * PARTS / longer))
    jaccard = lambda x, y: bind(x, lambda x: bind(y, lambda y: F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))))
    forward = jaccard(placed(a, lambda p: p), placed(b, lambda p: p))
    backward = jaccard(placed(a, lambda p: a_bytes - p), placed(b, lambda p: b_bytes - p))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(F.greatest(forward, backward)).cast("double")


def successors(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, no nulls in text) with found, next_text and next_found.

    The next row is the one with the next smaller doc_id, null last, and after the last
    one the first. Rows with one doc_id follow by a hash of the text, then by the text.

    Rows are dealt into buckets by their place in that order: QUANTILES quantiles, and
    between two of them evenly, so that buckets stay small however many rows there are. Rows that repeat a doc_id have places between it and the next. The first row of
    each bucket joins the one before it as its last, so every text is shuffled once.
    """
    mixed = F.xxhash64("text")
    between = mixed / F.lit(2.0**64) + 0.5
    id_ = F.col("doc_id").cast("double")
    # Never falls in that order. Rows that have one place share a bucket.
    place = F.when(id_.isNull(), F.lit(2.0**63) * (1 + between)).when(F.abs(id_) < 2.0**40, F.floor(between * 4096) / 4096 - id_).otherwise(-id_)
    rows = docs.withColumns({"late": F.col("doc_id").isNull(), "down": F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")), "mixed": mixed, "place": place})
    count, bounds = rows.agg(F.count("*"), F.percentile_approx("place", [i / QUANTILES for i in range(QUANTILES + 1)], 20 * QUANTILES)).first()
    wanted = max(1, -(-count // min(max(ROWS, count // BROADCAST_ROWS), max(ROWS, MOST))))
    coarse = min(QUANTILES, wanted)
    fine = -(-wanted // coarse)
    bounds = [bounds[i * QUANTILES // coarse] for i in range(coarse + 1)] if count else [0.0, 0.0]
    every = F.array(*[F.lit(float(b)) for b in bounds])
    at = F.size(F.filter(F.slice(every, 2, coarse - 1), lambda b: b <= F.col("place"))) if coarse > 1 else F.lit(0)
    low, high = F.get(every, F.col("coarse")), F.get(every, F.col("coarse") + 1)
    share = F.when(high > low, F.floor((F.col("place") - low) / (high - low) * fine)).otherwise(F.lit(0))
    inside = F.greatest(F.lit(0), F.least(F.lit(fine - 1), share)).cast("long")
    dealt = rows.withColumn("coarse", at).withColumn("bucket", F.col("coarse") * fine + inside).drop("place").withColumn("extra", F.lit(0))

    key = ["late", "down", "mixed"]
    firsts = dealt.groupBy("coarse", "bucket").agg(F.min(F.struct(*key)).alias("first"))
    firsts = durable(firsts)
    # A row per quantile: QUANTILES at most.
    groups = firsts.groupBy("coarse").agg(F.max("bucket").alias("last"))
    ring = W.orderBy("coarse")
    groups = groups.select("coarse", F.coalesce(F.lag("last").over(ring), F.max("last").over(W.orderBy(F.lit(0)))).alias("last"))
    to = F.coalesce(F.lag("bucket").over(W.partitionBy("coarse").orderBy("bucket")), F.col("last"))
    moved = firsts.join(F.broadcast(groups), "coarse").select(*[F.col(f"first.{c}").alias(f"{c}__") for c in key], to.alias("to"))
    moved = F.broadcast(moved) if wanted <= 2 * BROADCAST_ROWS else moved
    more = dealt.join(moved, [F.col(c) == F.col(f"{c}__") for c in key]).select("doc_id", "text", *key, "coarse", F.col("to").alias("bucket"), F.lit(1).alias("extra"))
    order = ["extra", *key, "text"]
    walk = dealt.unionByName(more).repartition("bucket").sortWithinPartitions("bucket", *order)
    walk = walk.withColumn("found", syncmers(F.col("text").cast("binary")))
    window = W.partitionBy("bucket").orderBy(*order)
    walk = walk.withColumns({"next_text": F.lead("text").over(window), "next_found": F.lead("found").over(window)})
    return walk.where("extra = 0").select("doc_id", "text", "found", "next_text", "next_found")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row of docs (doc_id, text), n_anchors the number of all.

    Equal texts have equal fingerprints; null and empty ones an empty fingerprint.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), anchors(text).alias("found"))
    return rows.select("doc_id", shown(F.col("found")).alias("fingerprint"), F.size("found").cast("long").alias("n_anchors"))


def edited_found(found: Column, kept: Column, head: Column, next_found: Column) -> Column:
    """Syncmers of kept + head, where kept begins a text, head the next one, and theirs are known."""
    left, right = F.octet_length(kept), F.octet_length(head)
    inside = lambda anchors_, length: F.filter(anchors_, lambda x: position(x) + K <= length)
    overlap = F.least(F.lit(K - 1), left)
    seam = F.concat(F.substring(kept.cast("binary"), left - overlap + 1, overlap), F.substring(head.cast("binary"), F.lit(1), F.least(F.lit(K - 1), right)))
    across = bind(seam, lambda data: syncmers(data, (left - overlap).cast("long")))
    return F.concat(inside(found, left), across, F.transform(inside(next_found, right), lambda x: x + left))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next.

    A document's edited text has its last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next document by descending doc_id, the first after the
    last. Null texts are empty. A null doc_id comes last; of rows that repeat a doc_id the
    next is the one whose text has the next greater hash, and every row stays. A single row is its
    own next document. Other columns are ignored. Empty in, empty out. A text needs about
    four times its size in memory.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = successors(rows).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    out = out.withColumns({"left": F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), "head": F.substring("next_text", F.lit(1), third)})
    edited = F.concat("left", "head")
    out = out.withColumn("edited_found", edited_found(F.col("found"), F.col("left"), F.col("head"), F.col("next_found")))
    out = out.select("doc_id", "n_chars", F.sha2(edited, 256).alias("edited_sha256"), whole(F.col("found"), F.col("text")).alias("found"), whole(F.col("next_found"), F.col("next_text")).alias("next_found"), whole(F.col("edited_found"), edited).alias("edited_found"), F.octet_length("text").alias("bytes"), F.octet_length(edited).alias("edited_bytes"), F.octet_length("next_text").alias("next_bytes"))
    near = lambda other, size: likeness(F.col("found"), F.col("bytes"), F.col(other), F.col(size))
    return out.select("doc_id", "n_chars", "edited_sha256", shown(F.col("found")).alias("fingerprint"), shown(F.col("edited_found")).alias("edited_fingerprint"), near("edited_found", "edited_bytes").alias("near_edited"), near("next_found", "next_bytes").alias("near_next"))
