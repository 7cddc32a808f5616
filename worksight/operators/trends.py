"""Monthly series per group, causal robust baselines, hotspots and each work's trend context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worksight.functions.scalar import group_label, safe_ratio
from worksight.functions.stats import IQR_FACTOR, MAD_FACTOR, OUTLIER, array_mad, ewma, percentile_exclusive

GROUPS = {"STATE": ["state"], "DISTRICT": ["state", "district"], "SECTOR": ["sector"], "STATE_SECTOR": ["state", "sector"], "DISTRICT_SECTOR": ["state", "district", "sector"]}
#: From the most specific group to the least.
SPECIFIC = ("DISTRICT_SECTOR", "STATE_SECTOR", "DISTRICT", "SECTOR", "STATE")
MONTHS, MIN_MONTHS, MIN_EVENTS = 6, 4, 20


def group_pairs(groups: dict[str, list[str]] = GROUPS) -> Column:
    """Array of (group_type, group_value); exploding it is grouping sets with readable labels."""
    return F.array(*[F.struct(F.lit(g).alias("group_type"), group_label(c).alias("group_value")) for g, c in groups.items()])


def dense_months(events: DataFrame, as_of: str) -> DataFrame:
    """Month series of events (metric, event_on, value and group columns), zero-filled.

    Each group and metric runs from its first month to the last complete one before as_of.
    Null values and null group keys are left out. Events are summed by month and place (all
    group columns) before these rows, far fewer, are counted for each group.
    """
    last = F.date_sub(F.trunc(F.lit(as_of).cast("date"), "MM"), 1)
    place = sorted({c for columns in GROUPS.values() for c in columns})
    rows = events.where(F.col("value").isNotNull() & (F.col("event_on") <= last)).groupBy("metric", F.trunc("event_on", "MM").alias("month"), *place).agg(F.sum("value").alias("value"), F.count("*").alias("events"))
    keys = ["group_type", "group_value", "metric"]
    rows = rows.select("metric", "month", "value", "events", F.explode(group_pairs()).alias("g")).select("metric", "month", "value", "events", "g.*")
    months = rows.where("group_value is not null").groupBy(*keys, "month").agg(F.sum("value").alias("value"), F.sum("events").alias("events"))
    grid = months.groupBy(*keys).agg(F.min("month").alias("start")).withColumn("month", F.explode(F.sequence(F.col("start"), F.trunc(last, "MM"), F.expr("interval 1 month")))).drop("start")
    full = grid.join(months, [*keys, "month"], "left")
    return full.withColumns({"value": F.coalesce(F.col("value").cast("double"), F.lit(0.0)), "events": F.coalesce("events", F.lit(0))})


def causal_baseline(series: DataFrame) -> DataFrame:
    """Adds robust statistics of the up to six months before each, never of the month itself."""
    w = W.partitionBy("group_type", "group_value", "metric").orderBy("month").rowsBetween(-MONTHS, -1)
    out = series.withColumns({"history": F.collect_list("value").over(w), "support": F.coalesce(F.sum("events").over(w), F.lit(0)), "q": F.percentile("value", [0.1, 0.25, 0.5, 0.75, 0.9]).over(w)})
    out = out.select("*", F.size("history").alias("baseline_months"), *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p10", "q1", "median", "q3", "p90"))])
    out = out.withColumn("mad", array_mad(F.col("history"), F.col("median"))).withColumn("iqr", F.col("q3") - F.col("q1"))
    diff = F.col("value") - F.col("median")
    z = F.when(F.col("mad") > 0, MAD_FACTOR * diff / F.col("mad")).when(F.col("iqr") > 0, diff / (F.col("iqr") / IQR_FACTOR))
    method = F.when(F.col("baseline_months") == 0, "NO_HISTORY").when(F.col("mad") > 0, "MAD").when(F.col("iqr") > 0, "IQR_FALLBACK").otherwise("CONSTANT_BASELINE_NO_DEVIATION")
    status = F.when(F.col("baseline_months") < MIN_MONTHS, "INSUFFICIENT_PRIOR_MONTHS").when(F.col("support") < MIN_EVENTS, "INSUFFICIENT_HISTORICAL_EVENT_SUPPORT").otherwise("SUPPORTED")
    out = out.withColumns({"method": method, "status": status})
    out = out.withColumn("robust_z", F.when(F.col("status") == "SUPPORTED", z))
    return out.withColumn("flagged", F.coalesce(F.abs("robust_z") >= OUTLIER, F.lit(False))).drop("history", "q")


def monthly_ewma(series: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Adds the exponentially weighted average up to each month."""
    w = W.partitionBy("group_type", "group_value", "metric").orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    return series.withColumn("ewma", ewma(F.collect_list("value").over(w), alpha))


def trend_alerts(baseline: DataFrame) -> DataFrame:
    way = F.when(F.col("robust_z") > 0, "above").otherwise("below")
    text = F.format_string("%s of %s in %s is %s its causal baseline", "metric", "group_value", F.date_format("month", "yyyy-MM"), way)
    return baseline.where("flagged").select("group_type", "group_value", "metric", "month", "robust_z", text.alias("message"))


def hotspots(profile: DataFrame, flags: dict[str, Column], minimum: int = 20, groups: dict[str, list[str]] = GROUPS) -> DataFrame:
    """Per group of at least `minimum` works, counts and shares of flagged works."""
    rows = profile.select(F.explode(group_pairs(groups)).alias("g"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()]).select("g.*", *flags)
    got = rows.where("group_value is not null").groupBy("group_type", "group_value").agg(F.count("*").alias("works"), *[F.count_if(n).alias(f"{n}_count") for n in flags]).where(F.col("works") >= minimum)
    return got.select("*", *[safe_ratio(f"{n}_count", "works").alias(f"{n}_share") for n in flags])


def trend_context(works: DataFrame, baseline: DataFrame, as_of: str) -> DataFrame:
    """Per work the latest month's trend of its most specific supported group.

    Strength is the percentile of |z| among flagged groups of the month, else 0. The group is
    picked once for each place (all group columns), and places are far fewer than works; no work is multiplied
    by its groups.
    """
    last = F.trunc(F.date_sub(F.trunc(F.lit(as_of).cast("date"), "MM"), 1), "MM")
    month = baseline.where((F.col("month") == last) & F.col("robust_z").isNotNull()).withColumn("size", F.abs("robust_z"))
    best = F.max_by(F.struct("metric", "robust_z", "flagged", "size"), F.struct("size", "metric"))
    top = month.groupBy("group_type", "group_value").agg(best.alias("t")).select("group_type", "group_value", "t.*")
    flagged = percentile_exclusive(top.where("flagged"), [], "size", "strength").select("group_type", "group_value", "strength")
    top = top.join(flagged, ["group_type", "group_value"], "left").withColumn("strength", F.coalesce("strength", F.lit(0.0)))
    order = F.array(*[F.lit(g) for g in SPECIFIC])
    place = sorted({c for columns in GROUPS.values() for c in columns})
    own = works.select("work_id", F.struct(*place).alias("place"))
    choices = own.select("place").distinct().select("place", "place.*").select("place", F.explode(group_pairs()).alias("g")).select("place", "g.*").join(top, ["group_type", "group_value"])
    pick = choices.groupBy("place").agg(F.min_by(F.struct("group_type", "group_value", "metric", "robust_z", "flagged", "strength"), F.array_position(order, F.col("group_type"))).alias("t"))
    out = own.join(pick.withColumnRenamed("place", "at__"), F.col("place").eqNullSafe(F.col("at__")), "left")
    return out.select("work_id", F.coalesce("t.group_type", F.lit("NO_SUPPORTED_GROUP")).alias("trend_group"), F.col("t.metric").alias("trend_metric"), F.col("t.robust_z").alias("trend_z"), F.coalesce("t.flagged", F.lit(False)).alias("trend_flagged"), F.coalesce("t.strength", F.lit(0.0)).alias("trend_strength"))
