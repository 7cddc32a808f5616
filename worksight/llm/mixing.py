"""Mixing sources to target weights by entropy balancing.

Among all ways to repeat documents that meet each source's token target, the mix takes the
one nearest to the corpus in relative entropy. The dual of that problem is convex with one
multiplier per source; its Hessian is diagonal, so Newton steps run on the distributed
table of source totals, until the dual's gradient vanishes. The optimum tilts every document by exp(multiplier). Rates become
copies in the end: whole ones in a reproducible random order, the last one in part.

Scale: one aggregation of the documents yields the source totals. Copies are dealt within
(source, bucket) groups of about BUCKET documents, so a hot source spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worksight.llm.common import durable

WORD = r"[^\x20\x09-\x0D]+"
BUCKET = 4096
#: Newton steps between two looks at the gradient, and looks at most. A step moves a
#: multiplier by 1 at most until it is near, and no rate of doubles is below exp(-745).
STEPS, LOOKS = 10, 100
#: What of a target the gradient may be in the end.
RESIDUAL = 1e-12


def numbered(sources: DataFrame) -> DataFrame:
    """Adds rank, from 0, in code point order with null last, without sorting in one task.

    Sources are dealt by range; a range's first rank is what the ranges before it hold.
    """
    order = [F.col("source").isNull(), F.col("source")]
    dealt = durable(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = {r.part: r.n for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row per partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    if not before:
        return dealt.withColumn("rank", F.lit(0).cast("long")).drop("part")
    starts = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    rank = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1 + F.element_at(starts, F.col("part"))
    return dealt.withColumn("rank", rank.cast("long")).drop("part")


def capped_targets(sources: DataFrame, weights: tuple[float, ...], total: float, cap: float) -> DataFrame:
    """Adds target: total shared by weight; none exceeds cap * source_size, the excess reshared."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    state = sources.withColumns({"weight": weight, "most": F.col("source_size") * F.lit(float(cap))}).withColumn("full", F.col("most") == 0)
    level, filled = 0.0, -1
    while True:
        row = state.agg(F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).alias("fixed"), F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).alias("open"), F.count(F.when(F.col("full"), 1)).alias("filled")).first()
        if not row.open or row.filled == filled:
            break
        level, filled = max(0.0, total - (row.fixed or 0.0)) / row.open, row.filled
        state = state.withColumn("full", F.col("full") | (F.col("weight") * level > F.col("most")))
    return state.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * level)).drop("weight", "most", "full")


def tilted(sources: DataFrame) -> DataFrame:
    """Adds rate = exp(multiplier), the multiplier found by Newton steps on the dual.

    The dual is size * exp(x) - target * x for each source, so a step adds
    (target - size * exp(x)) / (size * exp(x)); steps are damped to 1, which makes them
    descend from any start. They go on until no gradient exceeds RESIDUAL of its target, and
    it is an error if that never happens. A source with target 0 has no finite optimum and
    gets rate 0.
    """
    x = "multiplier"
    out = sources.withColumn(x, F.lit(0.0))
    has = (F.col("target") > 0) & (F.col("source_size") > 0)
    tokens = F.col("source_size") * F.exp(x)
    for _ in range(LOOKS):
        for _ in range(STEPS):
            out = out.withColumn(x, F.when(has, F.col(x) + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("target") - tokens) / tokens))).otherwise(F.lit(0.0)))
        out = durable(out)
        worst = out.where(has).agg(F.max(F.abs(tokens / F.col("target") - 1))).first()[0]
        if (worst or 0.0) <= RESIDUAL:
            return out.withColumn("rate", F.when(has, F.exp(x)).otherwise(F.lit(0.0)))
    raise ArithmeticError(f"Newton steps have left {worst} of a target")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs (doc_id, text, source).

    Sizes are words. Sources weigh `weights` in turn, by code point, null last and a source
    of its own, and share `share` times all words, none more than `cap` times its own.
    taken is how many words of the document the mix takes, repeats counted; it is at most
    ceil(cap) times size, and whole copies but for one document in about BUCKET.
    A source's taken words are within a word a bucket of its target. The same
    rows give the same result in any partitioning. Null and empty texts have size 0 and
    nothing taken; rows that repeat a doc_id are documents of their own, and of equal ones
    any may be the one taken in part. Long texts cost their words only. `keep` names columns
    of docs to carry along; others are ignored. Empty in, empty out.
    """
    own = [F.col(c).alias(f"kept_{c}") for c in keep]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = durable(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), F.xxhash64("doc_id", "text").alias("mixed"), *own))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    totals = numbered(totals)
    words = totals.agg(F.sum("source_size")).first()[0] or 0
    rates = tilted(capped_targets(totals, weights, share * words, cap)).withColumn("buckets", F.ceil(F.col("documents") / BUCKET))
    rates = durable(rates.select(F.col("source").alias("name"), "source_size", "target", "rate", "buckets"))
    rated = sized.join(rates, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rated = rated.withColumn("bucket", F.pmod(F.xxhash64("mixed", F.lit("bucket")), "buckets"))
    group = W.partitionBy("source", "bucket")
    order = group.orderBy(F.xxhash64("mixed", F.lit("order")), "mixed", "doc_id", "size")
    whole = F.floor(F.col("rate") + 1e-9)
    before = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wanted = F.round((F.col("rate") - F.floor(F.col("rate") + 1e-9)) * F.sum("size").over(group))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), wanted.cast("long") - before))
    return rated.select("doc_id", "size", "source_size", "target", (whole * F.col("size") + extra).cast("long").alias("taken"), *[F.col(f"kept_{c}").alias(c) for c in keep])
