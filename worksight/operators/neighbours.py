"""Nearest neighbours by an index of lists round centres.

Centres are fitted to a bounded sample; every distinct vector stands in the list of its
nearest centre, and is compared with those of the `probes` lists whose centres are nearest
to it. With as many probes as lists the search is exact. Equal vectors are one class, of
which only the smallest ids take part, so groups of copies are never compared with
themselves. Lists are long and few, so that few probes find most neighbours and a
vector is shuffled few times; they are dealt in slices of BLOCK vectors, and what a slice
meets too, so that no task's input grows with a list.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worksight.operators.pairs import Unpack, best
from worksight.operators.serving import mutual, nearest
from worksight.sources.durable import durable

#: Vectors that a list is meant to hold, and lists at most.
LIST_ROWS, MAX_LISTS = 1 << 14, 4096
#: Lists that a search looks into: the least, and how many times the root of their number.
LEAST_PROBES, PROBES = 3, 0.7
#: Vectors of a slice of a list at most; of those that look into it, as many at most and, where there are few, LEAST or one in TASKS. Vectors compared at a time.
BLOCK, LEAST, TASKS, TILE = 1 << 16, 1 << 11, 24, 1 << 11
#: Partitions that slices are dealt to, at most, unless the session has more.
PARTITIONS = 1 << 8
#: Vectors and bytes of the sample that centres are fitted to, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 1 << 16, 64 << 20
ROUNDS = 8
#: Cosines go through the shuffles as whole numbers of this part, which take half the bytes of a rounded double.
PART = 1_000_000
#: Vectors that a task unpacks at a time.
STEP = 512
#: Classes of more rows than this, and than one in HOTTEST of all, get their lists by broadcast; there are HOTTEST at most.
HOT, HOTTEST = 4096, 4096


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column, all of one length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


def as_bytes(vectors: DataFrame) -> DataFrame:
    """id, v: arrays as the bytes of unit vectors, which `of_bytes` reads; rows without an id or a vector are left out."""
    schema = pa.schema([("id", pa.int64()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], schema=schema)

    return vectors.select(F.col("id").cast("long"), F.col("v").cast("array<double>")).where("id is not null and v is not null").mapInArrow(run, "id long, v binary")


def of_bytes(column: Iterable[bytes]) -> np.ndarray:
    rows = list(column)
    return np.frombuffer(b"".join(rows)).reshape(len(rows), -1) if rows else np.zeros((0, 1))


def classes(vectors: DataFrame) -> DataFrame:
    """id, class, v of packed vectors (id, v): class is a digest of the bytes."""
    return vectors.where("id is not null and v is not null").select(F.col("id").cast("long").alias("id"), F.unhex(F.md5("v")).alias("class"), "v")


def smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """class, ids: the k smallest distinct ids of each class, in order. Batches keep k of a class before they are shuffled."""
    schema = pa.schema([("class", pa.binary()), ("id", pa.int64())])

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pd.DataFrame({"class": batch.column(0).to_pylist(), "id": batch.column(1).to_numpy()}).drop_duplicates().sort_values("id")
            t = t[t.groupby("class").cumcount() < k]
            yield pa.RecordBatch.from_arrays([pa.array(t["class"].tolist(), pa.binary()), pa.array(t.id.to_numpy())], schema=schema)

    some = rows.select("class", "id").mapInArrow(prune, "class binary, id long").distinct()
    few = some.withColumn("n", F.row_number().over(W.partitionBy("class").orderBy("id"))).where(F.col("n") <= k)
    return few.groupBy("class").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def centres(distinct: DataFrame, n: int, unpack: Unpack, list_rows: int = LIST_ROWS) -> np.ndarray:
    """Unit centres fitted by spherical k-means to a sample of bounded size, the same for the same rows."""
    lists = min(MAX_LISTS, max(1, -(-n // list_rows)))
    first = distinct.select("v").first()
    size = unpack([first.v]).shape[1] if first else 1
    if lists == 1 or first is None:
        return np.zeros((1, size))
    most = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * size))
    lists = min(lists, max(1, most // 16))
    share = max(1, -(-n // most))
    rows = distinct.where(F.pmod(F.xxhash64("class"), F.lit(share)) == 0).select("class", "v").collect()  # about `most` rows
    x = unpack(r.v for r in sorted(rows, key=lambda r: bytes(r["class"])))
    found = x[:: max(1, len(x) // lists)][:lists].copy()  # digests are an order by chance
    for _ in range(ROUNDS):
        near = np.argmax(x @ found.T, axis=1)
        for c in range(len(found)):
            own = x[near == c].sum(axis=0)
            if (size := np.linalg.norm(own)) > 0:
                found[c] = own / size
    return found


def placed(rows: DataFrame, own: np.ndarray, probes: int, unpack: Unpack) -> DataFrame:
    """rep, v, lists: the `probes` lists whose centres are nearest to every row, the nearest first."""
    shared = rows.sparkSession.sparkContext.broadcast(own)  # MAX_LISTS x the vector's size
    schema = pa.schema([("rep", pa.int64()), ("v", pa.binary()), ("lists", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, STEP):
                batch = whole.slice(start, STEP)
                k = min(probes, len(shared.value))
                x = unpack(batch.column(1).to_pylist()) @ shared.value.T if len(shared.value) > 1 else np.zeros((batch.num_rows, 1))
                near = np.argsort(-x, axis=1, kind="stable")[:, :k]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * k, pa.int32()), pa.array(near.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], schema=schema)

    return rows.select("rep", "v").mapInArrow(run, "rep long, v binary, lists array<int>")


class Rows:
    """Packed vectors by place, unpacked when they are asked for."""

    def __init__(self, packed: list[bytes], unpack: Unpack):
        self.packed, self.unpack = packed, unpack

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.unpack([self.packed[i] for i in at])

    def thin(self) -> np.ndarray:
        """All of them in single precision."""
        return np.concatenate([self.unpack(self.packed[i : i + STEP]).astype(np.float32) for i in range(0, len(self.packed), STEP)])


def compared(rows: DataFrame, k: int, unpack: Unpack) -> DataFrame:
    """id, other, parts: the k best of the lists that each row (rep, v, lists) looks into, and the cosine in PARTs; it stands in the first.

    A list's rows go to slices of BLOCK at most, and so do those that look into it, so a row
    is shuffled once a list that it looks into, and again only for every further slice of the
    other side.
    """
    asked, held = (rows.select(lists.alias("list"), F.col("rep").alias("rep"), F.col("v").alias("v")) for lists in (F.explode("lists"), F.col("lists")[0]))  # names of their own, as both come from one table
    counts = asked.groupBy("list").agg(F.count("*").alias("asked")).join(held.groupBy("list").agg(F.count("*").alias("held")), "list")
    counts = durable(counts)  # a row per list
    most = max(1, min(BLOCK, max(LEAST, (counts.agg(F.sum("asked")).first()[0] or 0) // TASKS)))
    slices = counts.select("list", F.ceil(F.col("asked") / most).cast("int").alias("asked_slices"), F.ceil(F.col("held") / BLOCK).cast("int").alias("held_slices"))
    part = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = asked.join(F.broadcast(slices), "list").select("list", part("asked_slices").alias("a"), every("held_slices").alias("h"), "rep", "v")
    right = held.join(F.broadcast(slices), "list").select("list", every("asked_slices").alias("a"), part("held_slices").alias("h"), "rep", "v")

    def meet(a: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        ids, others = a.rep.to_numpy(np.int64), h.rep.to_numpy(np.int64)
        out = [best(ids[:0], others[:0], np.zeros((0, 0)), k)]
        if len(a) and len(h):
            y = Rows(h.v.tolist(), unpack)
            thin = y.thin()
            for at in range(0, len(a), TILE):
                out.append(nearest(ids[at : at + TILE], unpack(a.v.iloc[at : at + TILE]), others, y, thin, k, 6))
        found = pd.concat(out)
        return pd.DataFrame({"id": found.id, "other": found.other, "parts": np.rint(found.cosine * PART).astype(np.int32)})

    # Slices are few and small in bytes, but not in work: so many partitions that hardly two fall into one.
    cells = slices.agg(F.sum(F.col("asked_slices") * F.col("held_slices"))).first()[0] or 0
    parts = max(1, min(4 * cells, max(PARTITIONS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    left, right = (t.repartition(parts, "list", "a", "h").groupBy("list", "a", "h") for t in (left, right))
    found = left.cogroup(right).applyInPandas(meet, "id long, other long, parts int")
    nth = F.row_number().over(W.partitionBy("id").orderBy(F.desc("parts"), "other"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def met(rows: DataFrame, n: int, k: int, unpack: Unpack) -> DataFrame:
    """id, other, parts: the k best of all n rows (rep, v) for each, as `compared` has them; exact.

    Rows are dealt into blocks of BLOCK at most. Every block meets itself, and every two meet
    once, for both sides. The work is quadratic, as exact search is; no task's input grows, and
    a row is shuffled once a block.
    """
    size = min(BLOCK, max(LEAST, -(-n // 8)))
    blocks = max(1, -(-n // size))
    own = rows.select("rep", "v", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("own"))
    left = own.select(F.col("own").alias("a"), F.explode(F.sequence(F.col("own"), F.lit(blocks - 1))).alias("h"), F.col("rep").alias("rep"), F.col("v").alias("v"))
    right = own.where("own > 0").select(F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("a"), F.col("own").alias("h"), F.col("rep").alias("rep"), F.col("v").alias("v"))

    def meet(key: tuple, a: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        ids, others = a.rep.to_numpy(np.int64), h.rep.to_numpy(np.int64)
        out = [best(ids[:0], others[:0], np.zeros((0, 0)), k)]
        x = Rows(a.v.tolist(), unpack)
        if key[0] == key[1]:
            thin = x.thin()
            for at in range(0, len(a), TILE):
                out.append(nearest(ids[at : at + TILE], unpack(a.v.iloc[at : at + TILE]), ids, x, thin, k, 6))
        elif len(a) and len(h):
            y = Rows(h.v.tolist(), unpack)
            out.append(mutual(ids, x, others, y, y.thin(), k, 6))
        found = pd.concat(out)
        return pd.DataFrame({"id": found.id, "other": found.other, "parts": np.rint(found.cosine * PART).astype(np.int32)})

    cells = blocks * (blocks + 1) // 2
    parts = max(1, min(4 * cells, max(PARTITIONS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    left, right = (t.repartition(parts, "a", "h").groupBy("a", "h") for t in (left, right))
    found = left.cogroup(right).applyInPandas(meet, "id long, other long, parts int")
    nth = F.row_number().over(W.partitionBy("id").orderBy(F.desc("parts"), "other"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def neighbours(vectors: DataFrame, k: int, list_rows: int = LIST_ROWS, probes: int | None = None, unpack: Unpack | None = None) -> DataFrame:
    """The rows of `directed`, each once."""
    return directed(vectors, k, list_rows, probes, unpack).distinct()


def directed(vectors: DataFrame, k: int, list_rows: int = LIST_ROWS, probes: int | None = None, unpack: Unpack | None = None, exact: bool = False) -> DataFrame:
    """id, other, cosine: about the k nearest other rows of each of vectors (id, v), ties by id.

    v is an array, or packed bytes of which `unpack` makes rows of unit vectors: every vector
    is shuffled `probes` times, so bytes should be few.

    Cosines are rounded to six digits. Exact with up to `probes` lists; beyond, neighbours in
    lists that a search doesn't look into are missed, which tests and README measure. Rows that repeat an
    id and vector are one, those with another vector have neighbours of both, of which some may come twice; a row without
    id or vector has none. Without `probes`, PROBES times the root of the lists. Empty in, empty out.
    With `exact` there is no index: all are compared with all.
    """
    if unpack is None:
        vectors, unpack = as_bytes(vectors), of_bytes
    rows = classes(vectors)
    kept = durable(rows.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")))
    total = kept.agg(F.count("*").alias("classes"), F.sum("n").alias("n")).first()
    if exact:
        found = met(kept, total.classes, k, unpack)
    else:
        own = centres(kept, total.classes, unpack, list_rows)
        probes = probes or max(LEAST_PROBES, math.ceil(PROBES * math.sqrt(len(own))))
        found = compared(durable(placed(kept, own, probes, unpack)), k, unpack)

    members = durable(rows.select("id", "class"))
    ids = durable(smallest_ids(members, k + 1).join(kept.select("class", "rep", "n"), "class"))
    told = found.join(ids.select(F.col("rep").alias("other"), "ids"), "other").select(F.col("id").alias("rep"), "parts", "ids")
    told = told.unionByName(ids.where("n > 1").select("rep", F.lit(PART).alias("parts"), "ids"))
    told = told.select("rep", F.explode("ids").alias("other"), "parts")
    nth = F.row_number().over(W.partitionBy("rep").orderBy(F.desc("parts"), "other"))
    nearest = told.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    nearest = nearest.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("nth", "other", "parts"))).alias("near"))
    nearest = durable(ids.select("class", "rep", "n").join(nearest, "rep"))

    # A class's list goes to its rows; the few classes that hold many rows don't shuffle these.
    least = max(HOT, (total.n or 0) // HOTTEST)
    members = members.distinct()
    lists = nearest.select("class", "near", "n")
    hot = lists.where(F.col("n") > least).select("class", "near")  # HOTTEST at most
    cold = members.join(F.broadcast(hot.select("class")), "class", "left_anti").join(lists.where(F.col("n") <= least).select("class", "near"), "class")
    both = cold.select("id", "near").unionByName(members.join(F.broadcast(hot), "class").select("id", "near"))
    others = F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k)
    return both.select("id", F.explode(others).alias("x")).select("id", "x.other", (F.col("x.parts") / F.lit(float(PART))).alias("cosine"))
