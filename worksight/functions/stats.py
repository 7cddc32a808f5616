"""Statistics as window or aggregate expressions: percentiles, robust scores, runs, averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worksight.sources.durable import durable

OUTLIER = 3.5
MAD_FACTOR, IQR_FACTOR = 0.6745, 1.349


#: Rows that one task may put in order: with no more of them in all, they aren't dealt by range.
FEW = 1 << 20


def cumulated(df: DataFrame, keys: list[str], order: list[Column], value: Column | dict[str, Column], out: str | None = None, total: dict[str, str] | None = None) -> DataFrame:
    """Adds out: the sum of value over the rows of keys up to each one, in a total order.

    value may name several sums (out: value); total names columns for the sums over all rows
    of keys ({out: name}). Rows are dealt by range and written out; each range sums on its
    own, and what the ranges before it hold is added. So a hot key, or none at all, is no
    task of its own, unless all rows together are FEW.
    """
    values = value if isinstance(value, dict) else {out: value}
    return _ranged(df, keys, order, {o: lambda w, v=v: F.sum(v).over(w) for o, v in values.items()}, {o: F.sum(v) for o, v in values.items()}, lambda c, w: F.sum(c).over(w), lambda own, before: F.coalesce(before, F.lit(0)) + own, total or {})


def carried(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds out: the last value that isn't null among the rows of keys up to each one, found as in `cumulated`."""
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    latest = F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    return _ranged(df, keys, order, {out: lambda w: last(value, w)}, {out: latest}, lambda c, w: last(c, w), lambda own, before: F.coalesce(own, before), {})


def _ranged(df: DataFrame, keys: list[str], order: list[Column], own: dict, sums: dict[str, Column], before, both, total: dict[str, str]) -> DataFrame:
    df = durable(df)
    if df.count() <= FEW:
        w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
        upto = {o: f(w.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) for o, f in own.items()}
        return df.withColumns(upto | {name: own[o](w) for o, name in total.items()})
    dealt = durable(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("range__", F.spark_partition_id()))
    rows = dealt.withColumns({f"inside__{o}": f(W.partitionBy("range__", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) for o, f in own.items()})
    # A row for each range and key that meet: hardly more than there are ranges and keys.
    parts = dealt.groupBy("range__", *keys).agg(*[x.alias(f"found__{o}") for o, x in sums.items()])
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    earlier = group.orderBy("range__").rowsBetween(W.unboundedPreceding, -1)
    names = {k: f"key{i}__" for i, k in enumerate(keys)}
    parts = parts.select(F.col("range__").alias("at__"), *[F.col(k).alias(n) for k, n in names.items()], *[before(f"found__{o}", earlier).alias(f"earlier__{o}") for o in own], *[F.sum(f"found__{o}").over(group).alias(name) for o, name in total.items()])
    same = F.col("range__") == F.col("at__")
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    out = rows.join(parts, same, "left").withColumns({o: both(F.col(f"inside__{o}"), F.col(f"earlier__{o}")) for o in own})
    return out.drop("range__", "at__", *names.values(), *[f"{x}__{o}" for x in ("inside", "earlier") for o in own])


def average_rank(df: DataFrame, keys: list[str], value: str, out: str = "average_rank", n: str = "n") -> DataFrame:
    """Adds the average rank of value within keys (null values keep null) and the count of values.

    Equal values are counted first, so only distinct values are ranked. Rows without a value,
    which have no rank to meet, are dealt by a hash of the row.
    """
    values = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("same__"))
    values = cumulated(values, keys, [F.col(value)], F.col("same__"), "upto__", {"upto__": n})
    ranks = values.select(*keys, value, (F.col("upto__") - (F.col("same__") - 1) / F.lit(2.0)).alias(out), n, F.xxhash64(value).alias("deal__"))
    dealt = df.withColumn("deal__", F.when(F.col(value).isNull(), F.xxhash64(*df.columns)).otherwise(F.xxhash64(value)))
    return dealt.join(ranks, [*keys, value, "deal__"], "left").drop("deal__")


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], weight: str | None = None) -> DataFrame:
    """keys, n and a column for each wanted quantile, exact and interpolated; one row per key that has a value.

    Distinct values are counted, their running totals taken over ranges, and only the rows
    that a quantile falls on or between leave their task: no cohort's values meet in one.
    weight names a column that says how many rows a row stands for; such rows have been
    counted and aren't merged again, as equal values may stand in several rows.
    """
    given = df.where(F.col(value).isNotNull())
    v = F.col(value).cast("double").alias("v__")
    values = given.select(*keys, v, F.col(weight).alias("same__")) if weight else given.groupBy(*keys, v).agg(F.count("*").alias("same__"))
    placed = cumulated(values, keys, [F.col("v__")], F.col("same__"), "upto__", {"upto__": "n"})
    spots, picks = [], {}
    for i, (name, q) in enumerate(wanted.items()):
        at = (F.col("n") - 1) * F.lit(float(q))
        low, high = F.floor(at), F.ceil(at)
        inside = lambda r: (F.col("upto__") > r) & (F.col("upto__") - F.col("same__") <= r)
        spots += [F.when(inside(low), F.col("v__")).alias(f"low{i}__"), F.when(inside(high), F.col("v__")).alias(f"high{i}__")]
        picks[name] = (F.max(f"low{i}__") + (F.max(f"high{i}__") - F.max(f"low{i}__")) * F.max(at - low)).alias(name)
    marked = placed.select(*keys, "n", *spots)
    some = F.coalesce(*[F.col(f"{x}{i}__") for i in range(len(wanted)) for x in ("low", "high")]).isNotNull()
    return marked.where(some).groupBy(*keys).agg(F.max("n").alias("n"), *picks.values())


def spread(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], weight: str | None = None) -> DataFrame:
    """quantiles with median and mad, the median distance from the median, in two passes over distinct values."""
    counted = durable(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias(value)).agg((F.sum(weight) if weight else F.count("*")).alias("rows__")))
    first = durable(quantiles(counted, keys, value, {"median": 0.5} | wanted, "rows__"))
    middle = first.select(*[F.col(k).alias(f"{k}__m") for k in keys], F.col("median").alias("median__"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__m"))
    away = counted.join(middle, on).withColumn("away__", F.abs(F.col(value) - F.col("median__")))
    mad = quantiles(away.select(*keys, "away__", "rows__"), keys, "away__", {"mad": 0.5}, "rows__")
    mad = mad.select(*[F.col(k).alias(f"{k}__m") for k in keys], "mad")
    return first.join(mad, on, "left").drop(*[f"{k}__m" for k in keys])


def percentile_exclusive(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds (average rank - 1) / (n - 1) * 100; a lone value gets 100, null stays null."""
    ranked = average_rank(df, keys, value, "rank__", "n__")
    score = F.when(F.col("n__") == 1, F.lit(100.0)).otherwise((F.col("rank__") - 1) / (F.col("n__") - 1) * 100)
    return ranked.withColumn(out, F.when(F.col(value).isNotNull(), score)).drop("rank__", "n__")


def percentile_inclusive(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds average rank / n * 100."""
    return average_rank(df, keys, value, "rank__", "n__").withColumn(out, F.col("rank__") / F.col("n__") * 100).drop("rank__", "n__")


def robust_deviation(value: Column, median: Column, mad: Column, iqr: Column) -> Column:
    """0.6745 (x - med) / MAD, or (x - med) / (IQR / 1.349) without MAD, else null."""
    return F.when(mad > 0, MAD_FACTOR * (value - median) / mad).when(iqr > 0, (value - median) / (iqr / IQR_FACTOR))


def robust_method(value: Column, median: Column, mad: Column, iqr: Column) -> Column:
    return F.when(value.isNull() | median.isNull(), "OBSERVED_OR_PEER_VALUE_MISSING").when(mad > 0, "MODIFIED_Z_MAD").when(iqr > 0, "STANDARDIZED_IQR_FALLBACK").otherwise("UNAVAILABLE_CONSTANT_PEER_DISTRIBUTION")


def array_quantile(values: Column, q: float) -> Column:
    """Linear-interpolation quantile of a non-empty array of doubles, else null."""
    s = F.array_sort(values)
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(values) - 1))
    return F.when(F.size(values) > 0, a + (b - a) * (at - low))


def array_mad(values: Column, median: Column) -> Column:
    """Median absolute deviation of an array around a median."""
    return array_quantile(F.transform(values, lambda v: F.abs(v - median)), 0.5)


def ewma(values: Column, alpha: float = 0.3) -> Column:
    """Exponentially weighted average of an array, seeded with its first value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), F.get(values, F.lit(0)), lambda acc, v: acc * (1 - alpha) + v * alpha)


def runs(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """Per keys: flagged rows, the longest run of them, and the run that ends at the last row."""
    w = W.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("flag__", F.coalesce(flag, F.lit(False)))
    marked = marked.withColumn("run__", F.sum((~F.col("flag__")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    each = marked.groupBy(*keys, "run__").agg(F.count_if("flag__").alias("length__"))
    return each.groupBy(*keys).agg(F.sum("length__").alias("flagged"), F.max("length__").alias("longest_run"), F.max_by("length__", "run__").alias("latest_run"))


def ranking(df: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    """keys, roc_auc, average_precision of a 0/1 label by a score, from one ordered pass over distinct scores.

    ROC-AUC by rank sums, null without both classes; average precision as the sum over
    distinct scores of precision times the gain in recall.
    """
    steps = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count("*").alias("n__"), F.sum(label).alias("p__"))
    steps = cumulated(steps, keys, [F.col(score)], {"upto_n__": F.col("n__"), "upto_p__": F.col("p__")}, total={"upto_n__": "all_n__", "upto_p__": "all_p__"})
    rank = F.col("upto_n__") - (F.col("n__") - 1) / F.lit(2.0)
    # Rows from the greatest score down to this one.
    precision = (F.col("all_p__") - F.col("upto_p__") + F.col("p__")) / (F.col("all_n__") - F.col("upto_n__") + F.col("n__"))
    got = steps.groupBy(*keys).agg(F.sum(rank * F.col("p__")).alias("ranks__"), F.sum(precision * F.col("p__")).alias("hits__"), F.sum("p__").alias("positives"), (F.sum("n__") - F.sum("p__")).alias("negatives"))
    p, q = F.col("positives"), F.col("negatives")
    got = got.withColumns({"roc_auc": F.when((p > 0) & (q > 0), (F.col("ranks__") - p * (p + 1) / 2.0) / (p * q)), "average_precision": F.when(p > 0, F.col("hits__") / p)})
    return got.drop("ranks__", "hits__")
