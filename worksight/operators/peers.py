"""Hierarchical robust peer benchmarks: the most specific cohort with enough members decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksight.functions.stats import OUTLIER, robust_deviation, robust_method, spread
from worksight.sources.durable import durable

LEVELS = (("district", "sector", "sub_sector"), ("district", "sector"), ("sector", "sub_sector"), ("sector",), ())
MINIMUM = 20


def long_metrics(profile: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """One row per work and metric."""
    pairs = F.array(*[F.struct(F.lit(i).alias("metric_order"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for i, m in enumerate(metrics)])
    return profile.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def peer_stats(long: DataFrame, keys: list[str]) -> DataFrame:
    """Per cohort and metric: non-null count, quantiles, MAD and IQR (exact, interpolated); null without values."""
    by = [*keys, "metric"]
    found = spread(long, by, "value", {"p10": 0.1, "q25": 0.25, "q75": 0.75, "p90": 0.9}).drop("n")
    on = F.lit(True)
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__f"))
    found = found.withColumnsRenamed({k: f"{k}__f" for k in by})
    counts = long.groupBy(*by).agg(F.count("value").alias("n"))
    out = counts.join(found, on, "left").withColumn("iqr", F.col("q75") - F.col("q25"))
    return out.select(*by, "n", "p10", "q25", "median", "q75", "p90", "mad", "iqr")


def peer_evidence(profile: DataFrame, metrics: list[str], minimum: int = MINIMUM) -> DataFrame:
    """Per work and metric: value, the cohort level used, its statistics and the deviation.

    Equal values of the most specific cohorts are counted, and these counts go to the cohorts
    of all levels, which have numbers so that values are dealt by short rows. Null keys
    are a cohort of their own; the first of LEVELS with `minimum` non-null values of the metric
    is used, and is picked once for each most specific cohort. Without one, all is null.
    """
    every = ["district", "sector", "sub_sector"]
    finest = ["lifecycle", *every, "metric"]
    works = durable(profile.select("work_id", "lifecycle", *every, *metrics))
    counted = durable(long_metrics(works, metrics, ["lifecycle", *every]).groupBy(*finest, "value").agg(F.count("*").alias("rows")))

    at_level = [F.struct(F.lit(i).alias("level"), *[(F.col(k) if k in level else F.lit(None)).cast("string").alias(k) for k in every]) for i, level in enumerate(LEVELS)]
    groups = durable(counted.select(*finest).distinct())
    named = groups.select(F.struct(*finest).alias("own"), "lifecycle", "metric", F.explode(F.array(*at_level)).alias("at"))
    numbers = durable(named.select("lifecycle", "metric", "at").distinct().withColumn("cohort", F.monotonically_increasing_id())).toDF("lifecycle__n", "metric__n", "at__n", "cohort")
    same = F.lit(True)
    for c in ("lifecycle", "metric", "at"):
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__n"))
    named = durable(named.join(numbers, same).select("own", F.col("at.level").alias("level"), "cohort"))  # a row for each most specific cohort and level

    cohorts = named.groupBy("own").agg(F.collect_list("cohort").alias("cohorts"))
    values = counted.where("value is not null").withColumn("self", F.struct(*finest)).join(cohorts, F.col("self").eqNullSafe(F.col("own"))).select(F.explode("cohorts").alias("cohort"), "value", "rows")
    found = spread(values, ["cohort"], "value", {"q25": 0.25, "q75": 0.75}, "rows")
    rows = named.join(found, "cohort", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "iqr": F.col("q75") - F.col("q25")}).where(F.col("n") >= minimum)
    chosen = rows.groupBy("own").agg(F.min_by(F.struct("level", "n", "median", "mad", "iqr"), "level").alias("s"))
    # A work meets its cohort once, with what was chosen for each metric.
    own = F.struct(*[F.col(f"own.{c}").alias(c) for c in finest[:-1]])
    picks = chosen.groupBy(own.alias("cohort")).agg(F.map_from_entries(F.collect_list(F.struct("own.metric", "s"))).alias("picks"))
    met = works.join(picks, F.struct(*finest[:-1]).eqNullSafe(F.col("cohort")), "left")
    out = long_metrics(met, metrics, ["work_id", "lifecycle", "picks"]).withColumn("s", F.try_element_at("picks", F.col("metric")))
    args = (F.col("value"), F.col("s.median"), F.col("s.mad"), F.col("s.iqr"))
    return out.select("work_id", "lifecycle", "metric", "metric_order", "value", F.col("s.level").alias("level"), F.col("s.n").alias("peers"), F.col("s.median").alias("median"), robust_deviation(*args).alias("deviation"), robust_method(*args).alias("method"))


def peer_summary(evidence: DataFrame) -> DataFrame:
    """Per work: usable metrics, outliers, and the strongest deviation (first metric on ties)."""
    size = F.abs("deviation")
    best = F.max_by(F.struct("metric", size.alias("size")), F.when(size.isNotNull(), F.struct(size, -F.col("metric_order"))))
    out = evidence.groupBy("work_id", "lifecycle").agg(F.count("deviation").alias("usable_metrics"), F.count_if(size >= OUTLIER).alias("outlier_count"), best.alias("b"))
    return out.select("work_id", "lifecycle", "usable_metrics", "outlier_count", F.col("b.metric").alias("top_metric"), F.col("b.size").alias("max_deviation"))


def sector_deviation(df: DataFrame, value: str, by: str = "sector") -> DataFrame:
    """Adds deviation: (value - median) / (1.4826 MAD) within a group, null without spread."""
    found = spread(df.select(F.col(by).alias("by__"), F.col(value).alias("value__")), ["by__"], "value__", {}).select("by__", F.col("median").alias("median__"), F.col("mad").alias("mad__"))
    out = df.join(found, F.col(by).eqNullSafe(F.col("by__")), "left")
    return out.withColumn("deviation", F.when(F.col("mad__") > 0, (F.col(value) - F.col("median__")) / (1.4826 * F.col("mad__")))).drop("by__", "median__", "mad__")
