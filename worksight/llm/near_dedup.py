"""Near-duplicate groups by min-max hashing.

Every document is the set of its word shingles. Under each of `permutations` hash
permutations both the smallest and the largest value are kept, so half as many hash
evaluations give a signature of two values each. Bands of `rows` values are bucket keys.

Scale: documents with equal sets become one class first. A bucket is never expanded into
its pairs: each class is compared with the bucket's most central one, and the confirmed
links are joined into components. Classes that share a bucket and still lie in different
components are open. Links among open classes of different components come from an exact
prefix filter: two sets that are similar enough share one of their rarest shingles at
positions that leave room for the overlap they need. So a group of copies costs about as
many comparisons as it has members, and of the links between classes that share a bucket
none is lost to the choice of a center. Two classes that share no bucket may be missed; the
tests and README say how rarely.
Comparisons stream, dealt by (center, slice of its partners), so that a hot class is
compared by many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.llm.common import blocks, durable, encoded, mix, partitions, shingle_hashes, slot_counts

#: Slots of the table of shingle counts.
SLOTS = 1 << 18
#: Partners of one class that a slice of comparisons holds.
SLICE = 128
EMPTY = np.empty(0, np.uint64)


def class_key(unique: np.ndarray) -> bytes:
    """128 bits that stand for a set given as its sorted hashes."""
    return hashlib.blake2b(unique.tobytes(), digest_size=16).digest()


def prefix(unique: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """32 bits of each of a set's rarest shingles, rarest first: as many as a partner must share one of."""
    n = len(unique)
    need = n - -(-percent * n // 100) + 1
    keys = (counts[(unique % np.uint64(len(counts))).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (unique >> np.uint64(32))
    return (np.sort(np.partition(keys, need - 1)[:need]) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, k: int, permutations: int, rows: int, percent: int) -> DataFrame:
    """doc_id, tag, n_shingles, digest, bands, prefix: one row per document (doc_id, text, tag); lists are empty without shingles."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("tag").cast("long"))
    rarity = docs.sparkSession.sparkContext.broadcast(slot_counts(docs.select("text"), lambda texts: np.concatenate(shingle_hashes(texts, k)), SLOTS))
    multipliers = mix(np.arange(7001, 7001 + permutations, dtype=np.uint64)) | np.uint64(1)
    weights = mix(np.arange(9001, 9001 + rows, dtype=np.uint64)) | np.uint64(1)
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int32()))])

    def bands(sets: list[np.ndarray]) -> np.ndarray:
        full = [s for s in sets if len(s)]
        if not full:
            return np.empty((0, 2 * permutations // rows), np.int64)
        flat, at = np.concatenate(full), np.cumsum([0, *(len(s) for s in full)])[:-1]
        values = np.empty((len(full), 2 * permutations), np.uint64)
        for i, m in enumerate(multipliers):
            hashed = flat * m
            values[:, 2 * i], values[:, 2 * i + 1] = np.minimum.reduceat(hashed, at), np.maximum.reduceat(hashed, at)
        keys = (mix(values).reshape(len(full), -1, rows) * weights).sum(axis=2, dtype=np.uint64)
        return mix(keys + np.arange(keys.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, tags = encoded(batch.column(1)), batch.column(0), batch.column(2)
            for a, b in blocks(texts):
                sets = [np.unique(s) for s in shingle_hashes(texts[a:b], k)]
                found = iter(bands(sets))
                lists = [next(found) if len(s) else EMPTY for s in sets]
                rarest = [prefix(s, rarity.value, percent) if len(s) else EMPTY for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), tags.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_key(s) if len(s) else None for s in sets], pa.binary()), pa.array(lists, pa.list_(pa.int64())), pa.array(rarest, pa.list_(pa.int32()))], schema=schema)

    return docs.mapInArrow(run, "doc_id long, tag long, n_shingles long, digest binary, bands array<long>, prefix array<int>")


#: A class with more partners than this, and than one in HOTTEST of all sides of pairs, is hot; there are HOTTEST at most.
HOT, HOTTEST = 128, 4096


def turned(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the hot class of each as a, of two hot ones that with more partners; partners is how many a hot a has.

    The texts of a class go once with each slice of its partners where it is a, and once
    with each pair where it is b.
    """
    pairs = durable(pairs.select("a", "b"))
    least = max(HOT, 2 * pairs.count() // HOTTEST)
    sides = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n")).where(F.col("n") > least)
    hot = durable(sides)
    of = lambda c: F.broadcast(hot.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}")))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    turn = F.coalesce("n_b", F.lit(0)) > F.coalesce("n_a", F.lit(0))
    return both.select(*[F.when(turn, F.col(y)).otherwise(F.col(x)).alias(name) for x, y, name in (("a", "b", "a"), ("b", "a", "b"), ("n_a", "n_b", "partners"))])


def linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the class pairs (a, b), those whose full sets have 100 * both >= percent * either."""
    pairs = durable(turned(pairs))
    others = pairs.where("partners is null").drop("partners")
    counted = others.join(others.groupBy("a").agg(F.count("*").alias("partners")), "a").unionByName(pairs.where("partners is not null"))
    dealt = counted.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / SLICE)).alias("slice"))
    legs = dealt.select("a", "slice", F.lit(1).alias("leg"), F.col("b").alias("class")).unionByName(dealt.select("a", "slice").distinct().withColumns({"leg": F.lit(0), "class": F.col("a")}))
    legs = legs.join(classes.select("class", "first_id", "digest"), "class")
    texts = docs.select(F.col("doc_id").cast("long").alias("first_id"), F.col("text").cast("string").alias("text"))
    streams = legs.join(texts, "first_id").select("a", "slice", "leg", "class", "text", "digest").repartition(partitions(docs.sparkSession), "a", "slice").sortWithinPartitions("a", "slice", "leg")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left = None, EMPTY
        for batch in batches:
            texts = encoded(batch.column(4))
            a, part, leg, keys, digests = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5))
            found: list[tuple[int, int]] = []
            for x, y in blocks(texts):
                for i, s in enumerate(shingle_hashes(texts[x:y], k), x):
                    unique = np.unique(s)
                    if class_key(unique) != digests[i]:  # another text under the same doc_id
                        continue
                    if leg[i] == 0:
                        at, left = (a[i], part[i]), unique
                    elif at == (a[i], part[i]):
                        both = len(np.intersect1d(left, unique, assume_unique=True)) if 100 * min(len(left), len(unique)) >= percent * max(len(left), len(unique)) else 0
                        if 100 * both >= percent * (len(left) + len(unique) - both):
                            found.append((a[i], keys[i]))
            yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in found], pa.int64()) for j in (0, 1)], schema=schema)

    return streams.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of the edges (a, b) reaches.

    Alternating large-star and small-star steps; every step pre-aggregates a node's
    neighbours and is written out, and the loop ends when a round changes no edge.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before = print_of(edges)
    while before[0]:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = durable(small)
        after = print_of(edges)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def shared_buckets(classes: DataFrame) -> DataFrame:
    """key, class, center of buckets that several classes share.

    The center is the class whose buckets hold most rows together: in a group of copies
    that differ by a few edits each, the one with the fewest edits.
    """
    members = classes.select("class", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = durable(members.join(sizes, "key"))
    ranks = members.groupBy("class").agg(F.sum("size").alias("central"))
    members = members.join(ranks, "class").select("key", "class", "central")
    centers = members.groupBy("key").agg(F.max(F.struct("central", "class"))["class"].alias("center"))
    return members.join(centers, "key").select("key", "class", "center")


def prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (class, component, n, prefix) that can be similar enough, of different components.

    Sets of n and m shingles that are similar enough share at least
    percent * (n + m) / (100 + percent). If the first they have in common stands at place p
    of one's prefix, at most n - p + 1 are shared; so place p allows partners of at most
    `most` shingles. Places that allow no partner as small as the token's smallest, and
    then tokens of one component, go before any two rows meet.
    """
    tokens = rows.select("class", "component", "n", F.posexplode("prefix").alias("p", "token")).withColumn("p", F.col("p") + 1)
    tokens = tokens.withColumn("most", F.expr(f"(n - p + 1) * (100 + {percent}) div {percent} - n")).where(f"100 * most >= {percent} * n")
    held = tokens.groupBy("token").agg(F.min("n").alias("least"), F.count("*").alias("rows")).where("rows > 1")
    tokens = durable(tokens.join(held.drop("rows"), "token").where("most >= least").drop("least"))
    mixed = tokens.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
    tokens = tokens.join(mixed, "token")
    other = tokens.select("token", *[F.col(c).alias(f"{c}2") for c in ("class", "component", "n", "most")])
    pairs = tokens.join(other, "token").where(f"class < class2 and component <> component2 and most >= n2 and most2 >= n and 100 * least(n, n2) >= {percent} * greatest(n, n2)")
    return pairs.select(F.col("class").alias("a"), F.col("class2").alias("b")).distinct()


#: A component of more classes than this, and than one in HOTTEST of all, gets its smallest doc_id by broadcast.
LARGE = 4096


def component_ids(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """digest, group, component_id (its smallest doc_id) of every class; groups (class, component) holds linked ones.

    Rows of the few large components stay where they are, so none is a task of its own.
    """
    rows = durable(classes.select("class", "digest", "first_id").join(groups, "class", "left").withColumn("group", F.coalesce("component", "class")))
    alone = rows.where("component is null").select("digest", "group", F.col("first_id").alias("component_id"))
    linked_rows = rows.where("component is not null").select("digest", "group", "first_id")
    smallest = durable(linked_rows.groupBy("group").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")))
    least = max(LARGE, (smallest.agg(F.sum("n")).first()[0] or 0) // HOTTEST)
    large = F.broadcast(smallest.where(F.col("n") > least).drop("n"))  # HOTTEST at most
    few = linked_rows.join(large.select("group"), "group", "left_anti").join(smallest.where(F.col("n") <= least).drop("n"), "group")
    return alone.unionByName(few.select("digest", "group", "component_id")).unionByName(linked_rows.join(large, "group").select("digest", "group", "component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75, permutations: int = 64, rows: int = 4, tag: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Documents are linked when 100 * shared >= percent * united distinct shingles; a
    component holds what links reach, and its smallest doc_id is kept. With the defaults,
    2 * 64 signature values in 32 bands of 4, a pair at exactly 0.75 shares no bucket with
    a chance of about 5e-6, and every bucket's candidates are confirmed on full sets.

    Null or empty texts have no shingles and link with nothing. Rows that repeat a doc_id
    are documents of their own. A row whose doc_id is null links with nothing, has a null
    component_id and is kept. `tag` names a long column of docs that comes along, to tell
    such rows apart, with the number of the component as group; other columns are ignored. Texts are hashed in blocks of about half a MB; a
    longer one is a block of its own and takes about 50 times its size. Empty in, empty out.
    """
    docs = docs.select("doc_id", "text", (F.col(tag) if tag else F.lit(None)).cast("long").alias("tag"))
    signed = signatures(docs, shingle, permutations, rows, percent)
    signed = durable(signed.withColumn("digest", F.when(F.col("doc_id").isNotNull(), F.col("digest"))))
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("prefix").alias("prefix"))
    # Numbers of their own: 64 bits of a digest would be one number for two of some billion classes.
    classes = durable(classes.withColumn("class", F.monotonically_increasing_id()))
    members = durable(shared_buckets(classes))
    stars = members.where("class <> center").select(F.col("center").alias("a"), F.col("class").alias("b")).distinct()
    links = durable(linked(stars, classes, docs, shingle, percent))
    groups = components(links)

    labelled = members.select("key", "class").join(groups.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    open_classes = labelled.join(open_keys, "key").select("class", "component").distinct()
    rest = prefix_pairs(open_classes.join(classes.select("class", "n", "prefix"), "class"), percent).join(stars, ["a", "b"], "left_anti")
    more = durable(linked(durable(rest), classes, docs, shingle, percent))
    if not more.isEmpty():
        groups = components(links.unionByName(more))
    groups = groups.select(F.col("node").alias("class"), "component")

    named = component_ids(groups, classes)
    out = signed.select("doc_id", "tag", "n_shingles", "digest").join(named, "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), *([F.col("tag").alias(tag), "group"] if tag else []))
