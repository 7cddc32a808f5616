"""As-of features: each history is aggregated to one row per work before any join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worksight.functions.scalar import clipped_excess, days_between, safe_ratio, visible

#: Canonical order of a work's payments; nulls last.
PAYMENT_ORDER = ("released_on", "stage", "payment_id")


def payment_order() -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in PAYMENT_ORDER]


def released(payments: DataFrame, as_of: str) -> DataFrame:
    """Payments that exist as of a date: released and not later."""
    return payments.where(F.col("is_released") & (F.col("released_on") <= F.lit(as_of).cast("date")))


def payments_as_of(payments: DataFrame, as_of: str) -> DataFrame:
    """Counts, totals, largest share, first and last date, vendor concentration.

    Vendors are summed first, so no distinct aggregation expands the rows.
    """
    rows = released(payments, as_of)
    vendors = rows.groupBy("work_id", "vendor_id").agg(
        F.count("*").alias("n"), F.sum("amount").alias("total"), F.max("amount").alias("largest"), F.min("released_on").alias("first"), F.max("released_on").alias("last"), F.count_if("is_final").alias("final"), F.count_if(F.col("amount") == 0).alias("zero")
    )
    out = vendors.groupBy("work_id").agg(
        F.sum("n").alias("payment_count"), F.sum("total").alias("released_total"), F.count("vendor_id").alias("vendor_count"), F.max("largest").alias("largest_payment"), F.min("first").alias("first_payment_on"), F.max("last").alias("last_payment_on"),
        F.sum("final").alias("final_payment_count"), F.sum("zero").alias("zero_payment_count"), F.sum(F.pow(F.col("total").cast("double"), 2)).alias("squares"),
    )
    return out.select(
        "work_id", "payment_count", "released_total", "vendor_count", "largest_payment", "first_payment_on", "last_payment_on", "final_payment_count", "zero_payment_count",
        safe_ratio("released_total", "payment_count").alias("mean_payment"),
        safe_ratio("largest_payment", "released_total").alias("largest_share"),
        F.when(F.col("released_total") > 0, F.col("squares") / F.pow(F.col("released_total").cast("double"), 2)).alias("vendor_hhi"),
        F.datediff(F.lit(as_of).cast("date"), "last_payment_on").alias("days_since_payment"),
    )


def progress_as_of(progress: DataFrame, as_of: str) -> DataFrame:
    """First and last reports, gaps, falls, same-day extras and monthly velocity per work."""
    rows = progress.where(F.col("report_date") <= F.lit(as_of).cast("date"))
    order = W.partitionBy("work_id").orderBy("report_date", "progress_id")
    rows = rows.withColumn("change", F.col("physical") - F.lag("physical").over(order))
    at = F.struct("report_date", "progress_id")
    at_physical, at_financial = (F.when(F.col(c).isNotNull(), at) for c in ("physical", "financial"))
    out = rows.groupBy("work_id").agg(
        F.count("*").alias("report_count"), F.min("report_date").alias("first_report_on"), F.max("report_date").alias("last_report_on"), F.min_by("physical", at_physical).alias("first_physical"), F.max_by("physical", at_physical).alias("last_physical"), F.max_by("financial", at_financial).alias("last_financial"),
        F.count_if(F.col("change") < 0).alias("decrease_count"), F.coalesce(F.max(F.when(F.col("change") < 0, -F.col("change"))), F.lit(0.0)).alias("largest_decrease"), (F.count("*") - F.countDistinct("report_date")).alias("same_day_extras"),
    )
    elapsed = days_between("last_report_on", "first_report_on")
    return out.withColumns({"financial_gap": F.col("last_financial") - F.col("last_physical"), "days_since_report": F.datediff(F.lit(as_of).cast("date"), "last_report_on"), "velocity": F.when(elapsed > 0, (F.col("last_physical") - F.col("first_physical")) / elapsed * 30)})


def latest_report(reports: DataFrame) -> DataFrame:
    """work_id, physical, financial of each work's last report."""
    last = F.max_by(F.struct("physical", "financial"), F.struct("report_date", "progress_id"))
    return reports.groupBy("work_id").agg(last.alias("x")).select("work_id", "x.physical", "x.financial")


ASSET_DATES = ("public_use_on", "handover_on", "certificate_on")


def assets_as_of(assets: DataFrame, as_of: str) -> DataFrame:
    """Assets completed by the date, with later events masked, not dropped."""
    rows = assets.where(F.col("completed_on") <= F.lit(as_of).cast("date"))
    marked = visible("marked_on", as_of)
    return rows.withColumns({"final_spend": F.when(marked.isNotNull(), F.col("final_spend")), **{c: visible(c, as_of) for c in ASSET_DATES}})


def asset_summary(assets: DataFrame, as_of: str) -> DataFrame:
    flags = [F.bool_or(F.col(c).isNotNull()).alias(f"any_{c.removesuffix('_on')}") for c in ASSET_DATES]
    return assets_as_of(assets, as_of).groupBy("work_id").agg(F.count("*").alias("asset_count"), F.max("completed_on").alias("completed_on"), F.sum("final_spend").alias("final_spend"), *flags)


def lifecycle(as_of: str) -> Column:
    """PRE_SANCTION if rejected or not sanctioned as of the date, else by completed assets."""
    sanctioned = (F.col("status") != "P") & (F.col("sanctioned_on") <= F.lit(as_of).cast("date"))
    return F.when(~F.coalesce(sanctioned, F.lit(False)), "PRE_SANCTION").when(F.col("asset_count") > 0, "COMPLETION").otherwise("EXECUTION")


ZERO_FILLED = ("payment_count", "released_total", "final_payment_count", "zero_payment_count", "asset_count")
PROFILE = (
    "work_id mp_id state district sector sub_sector status lifecycle sanctioned recommended_on sanctioned_on expected_on payment_count released_total vendor_count largest_share vendor_hhi days_since_payment final_payment_count zero_payment_count "
    "asset_count completed_on final_spend spend_ratio overrun overrun_pct overdue_days sanction_days planned_days schedule_ratio"
).split()


def work_profile(works: DataFrame, payments: DataFrame, assets: DataFrame, as_of: str) -> DataFrame:
    """Exactly one row per work, columns as in PROFILE.

    All joins are 1:1 on work_id, so the histories' aggregations are joined as they lie.
    """
    out = works.where(F.col("recommended_on") <= F.lit(as_of).cast("date")).join(payments_as_of(payments, as_of), "work_id", "left").join(asset_summary(assets, as_of), "work_id", "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ZERO_FILLED})
    out = out.withColumns({"sanctioned_on": visible("sanctioned_on", as_of), "lifecycle": lifecycle(as_of)})
    today = F.lit(as_of).cast("date")
    overrun = F.when(F.col("sanctioned_on").isNotNull(), clipped_excess("released_total", "sanctioned"))
    planned = days_between("expected_on", "recommended_on")
    overdue = F.when((F.col("lifecycle") == "EXECUTION") & (F.col("expected_on") < today), F.datediff(today, "expected_on")).when(F.col("lifecycle") == "EXECUTION", F.lit(0))
    out = out.withColumns({"overrun": overrun, "spend_ratio": safe_ratio("released_total", "sanctioned"), "overdue_days": overdue, "sanction_days": days_between("sanctioned_on", "recommended_on"), "planned_days": planned, "schedule_ratio": safe_ratio(days_between(today, "recommended_on"), planned)})
    return out.withColumn("overrun_pct", safe_ratio(F.col("overrun") * 100.0, "sanctioned")).select(*PROFILE)


def column_profile(df: DataFrame, numeric: list[str], keys: list[str] = ()) -> DataFrame:
    """Per column (and keys): non-null share, distinct values, moments, the dominant value's share.

    Columns are stacked, so one scan and two shuffles serve all of them.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in numeric])
    long = df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")
    values = long.groupBy(*keys, "feature", "value").agg(F.count("*").alias("n"))
    v, n = F.col("value"), F.col("n")
    filled = F.when(v.isNotNull(), n)
    out = values.groupBy(*keys, "feature").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(filled), F.lit(0)).cast("bigint").alias("non_null"), F.count("value").alias("distinct_values"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.sum(v * n).alias("s1"), F.coalesce(F.max(filled), F.lit(0)).alias("dominant"),
    )
    return out.select(*keys, "feature", "rows", "non_null", "distinct_values", "minimum", "maximum", safe_ratio("s1", "non_null").alias("mean"), safe_ratio("dominant", "non_null").alias("dominant_share"), (1 - safe_ratio("non_null", "rows")).alias("null_share"))


def feature_selection(profile: DataFrame, missing: float = 0.5, dominant: float = 0.99) -> DataFrame:
    """Adds reason: why a feature isn't used in its stage, by priority, or SELECTED."""
    reason = F.when(F.col("non_null") == 0, "INAPPLICABLE").when(F.col("null_share") > missing, "MISSING").when(F.col("distinct_values") <= 1, "ZERO_VARIANCE").when(F.col("dominant_share") >= dominant, "NEAR_ZERO_VARIANCE").otherwise("SELECTED")
    return profile.withColumn("reason", reason)
