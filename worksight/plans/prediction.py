"""Queries over landmarks and calibrated models and their DuckDB SQL; the catalog registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksight.functions.scalar import fixed
from worksight.operators import calibration, landmarks, models, signals
from worksight.plans import sql
from worksight.plans.catalog import Tables, query
from worksight.sources import domain
from worksight.sources.domain import AS_OF


def outcomes(t: Tables) -> DataFrame:
    return signals.outcomes_of_completed(t.profile, t.assets, AS_OF).select("work_id", "finished_on", "delayed", "overran")


def training_rows(t: Tables) -> DataFrame:
    """Landmarks of completed works before their end, with both outcomes and a part."""
    rows = landmarks.landmark_state(t.works, t.payments, domain.site_reports(t.spark, t.sf_dir), t.assets, outcomes(t))
    return models.split(rows, "overran")


@query
def landmark_state(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    rows = landmarks.landmark_state(t.works, t.payments, domain.site_reports(spark, d), t.assets)
    doubles = [c for c, kind in rows.dtypes if kind == "double" and c != "fraction"]
    return rows.withColumns({c: fixed(c, 6) for c in doubles}).withColumn("landmark", F.date_format("landmark", "yyyy-MM-dd"))


@query
def landmark_training(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    rows = landmarks.landmark_state(t.works, t.payments, domain.site_reports(spark, d), t.assets, outcomes(t))
    return rows.groupBy("fraction", "delayed", "overran").agg(F.count("*").alias("rows"), F.sum("payment_count").alias("payments"), F.sum("report_count").alias("reports"), F.sum("decrease_count").alias("decreases"), F.sum("asset_count").alias("assets"))


@query
def cost_snapshots(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    rows = landmarks.cost_snapshots(t.profile, t.payments, domain.site_reports(spark, d), t.assets, AS_OF)
    return rows.withColumns({c: fixed(c, 6) for c, kind in rows.dtypes if kind == "double"})


@query
def platt_fit(spark: SparkSession, d: str) -> DataFrame:
    """The calibration of a plain score, the share of spending in spending and sanction, on overruns at half time."""
    t = Tables(spark, d)
    rows = landmarks.landmark_state(t.works, t.payments, domain.site_reports(spark, d), t.assets, outcomes(t), (0.5,))
    score = F.col("released_total") / (F.col("released_total") + F.col("sanctioned"))
    slope, intercept = calibration.platt(rows.withColumn("score", score), "score", "overran")
    return spark.createDataFrame([(slope, intercept)], "slope double, intercept double").select(fixed("slope", 4).alias("slope"), fixed("intercept", 4).alias("intercept"))


@query
def train_models(spark: SparkSession, d: str) -> DataFrame:
    """VALIDATION and TEST metrics at half time of the models of overruns."""
    rows = training_rows(Tables(spark, d)).where("fraction = 0.5")
    return models.train_models(rows, landmarks.PREDICTORS, "overran")


@query
def model_slices(spark: SparkSession, d: str) -> DataFrame:
    return calibration.model_slices(calibration.landmark_scores(training_rows(Tables(spark, d)), landmarks.PREDICTORS, "overran"))


_at = "epoch(w.sanctioned_on) + f * 86400 * (w.expected_on - w.sanctioned_on)"
_day = "CAST(to_timestamp(t_) AT TIME ZONE 'UTC' AS DATE)"
sql.extend(
    {
        "site": "SELECT l_orderkey AS work_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS progress_id, CAST(l_shipdate AS DATE) + CAST(l_partkey % 15 AS INTEGER) AS report_date, least(100.0::DOUBLE, l_quantity * 2) AS physical, least(100.0::DOUBLE, floor(l_discount * 1000 + 0.5)) AS financial FROM lineitem",
        "site_p": "SELECT *, lag(physical) OVER x AS before_, lag(report_date) OVER x AS before_on FROM site WINDOW x AS (PARTITION BY work_id ORDER BY report_date, progress_id)",
        "lm_0": f"SELECT w.*, f, {_at} AS t_ FROM w, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS f) WHERE w.sanctioned_on < w.expected_on",
        "lm_p": "SELECT work_id, f, count(amount) AS payment_count, coalesce(sum(amount), 0)::BIGINT AS released_total, coalesce(max(amount), 0)::BIGINT AS largest_payment, max(released_on) AS last_on FROM lm_0 LEFT JOIN (SELECT work_id AS k, released_on, amount FROM pay WHERE is_released) ON k = work_id AND epoch(released_on) <= t_ GROUP BY work_id, f",
        "lm_r": """SELECT work_id, f, count(progress_id) AS report_count, arg_max(physical, (report_date, progress_id)) AS last_physical, arg_max(financial, (report_date, progress_id)) AS last_financial, max(report_date) AS last_day, min(report_date) AS first_day, arg_min(physical, (report_date, progress_id)) AS first_physical,
          count(*) FILTER (physical < before_) AS decrease_count, coalesce(max(before_ - physical) FILTER (physical < before_), 0) AS largest_decrease FROM lm_0 LEFT JOIN (SELECT work_id AS k, * EXCLUDE (work_id) FROM site_p) ON k = work_id AND epoch(report_date) <= t_ GROUP BY work_id, f""",
        "lm_a": "SELECT work_id, f, count(completed_on) AS asset_count FROM lm_0 LEFT JOIN (SELECT work_id AS k, completed_on FROM ast) ON k = work_id AND epoch(completed_on) <= t_ GROUP BY work_id, f",
        "lm_1": "SELECT * FROM lm_0 JOIN lm_p USING (work_id, f) JOIN lm_r USING (work_id, f) JOIN lm_a USING (work_id, f)",
        "out_w": "SELECT p.work_id, max(vis.completed_on) AS finished_on, (max(vis.completed_on) > expected_on)::INTEGER AS delayed, CASE WHEN bool_and(vis.final_spend IS NOT NULL) AND sanctioned > 0 THEN (sum(vis.final_spend) > sanctioned)::INTEGER END AS overran FROM p JOIN vis ON p.work_id = vis.work_id WHERE lifecycle = 'COMPLETION' GROUP BY p.work_id, expected_on, sanctioned",
        "lm_t": "SELECT * FROM lm_1 JOIN out_w USING (work_id) WHERE epoch(finished_on) > t_",
        "cs_0": """SELECT work_id, lifecycle, sanctioned, sanctioned_on, expected_on, sector, final_spend, CASE lifecycle WHEN 'EXECUTION' THEN DATE '1998-12-31' WHEN 'COMPLETION' THEN least(sanctioned_on + CAST(floor(greatest(60, expected_on - sanctioned_on) * 3 / 5.0) AS INTEGER), completed_on - 30) END AS day_ FROM p WHERE sanctioned_on IS NOT NULL""",
        "cs_1": "SELECT * FROM cs_0 WHERE day_ IS NOT NULL AND (lifecycle = 'EXECUTION' OR day_ > sanctioned_on)",
        "cs_p": "SELECT c.work_id, count(amount) AS n, coalesce(sum(amount), 0) AS paid_, coalesce(bool_or(authorized_on < requested_on), false) AS early FROM cs_1 c LEFT JOIN pay y ON y.work_id = c.work_id AND released_on <= day_ GROUP BY c.work_id",
        "cs_r": "SELECT c.work_id, arg_max((physical, financial, report_date, before_, before_on), (report_date, progress_id)) AS l FROM cs_1 c JOIN site_p s ON s.work_id = c.work_id AND report_date <= day_ GROUP BY c.work_id",
        "pl_x": "SELECT ln(s / (1 - s)) AS x, overran::DOUBLE AS y FROM (SELECT greatest(1e-6, least(1 - 1e-6, released_total::DOUBLE / (released_total + sanctioned))) AS s, overran FROM lm_t WHERE f = 0.5 AND overran IS NOT NULL)",
        "pl_i": """SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL SELECT i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM
          (SELECT any_value(i) AS i, any_value(a) AS a, any_value(b) AS b, sum((q - y) * x) + any_value(a) AS ga, sum(q - y) AS gb, sum(q * (1 - q) * x * x) + 1 AS haa, sum(q * (1 - q) * x) AS hab, sum(q * (1 - q)) AS hbb FROM (SELECT *, 1 / (1 + exp(-(a * x + b))) AS q FROM pl_i, pl_x WHERE i < 25) HAVING count(*) > 0)""",
    }
)
SQL = {
    "landmark_state": f"""SELECT work_id, f AS fraction, strftime({_day}, '%Y-%m-%d') AS landmark, sanctioned, sanctioned_on - recommended_on AS sanction_days, expected_on - sanctioned_on AS planned_days, payment_count, released_total, largest_payment,
      CASE WHEN payment_count > 0 THEN round(released_total::DOUBLE / payment_count, 6) END AS mean_payment, CASE WHEN released_total > 0 THEN round(largest_payment::DOUBLE / released_total, 6) END AS largest_share, {_day} - last_on AS days_since_payment,
      CASE WHEN sanctioned > 0 THEN round(released_total * 100.0::DOUBLE / sanctioned, 6) END AS expenditure_pct, CASE WHEN sanctioned > 0 THEN greatest(released_total - sanctioned, 0) END AS overrun, report_count, round(last_physical, 6) AS last_physical, round(last_financial, 6) AS last_financial,
      round(last_financial - last_physical, 6) AS reported_gap, decrease_count, round(largest_decrease, 6) AS largest_decrease, CASE WHEN last_day > first_day THEN round((last_physical - first_physical) / (last_day - first_day) * 30, 6) END AS velocity, expected_on - {_day} AS days_left,
      round(greatest(0, {_day} - sanctioned_on)::DOUBLE / (expected_on - sanctioned_on), 6) AS elapsed_ratio, asset_count FROM lm_1""",
    "landmark_training": "SELECT f AS fraction, delayed, overran, count(*) AS rows, sum(payment_count)::BIGINT AS payments, sum(report_count)::BIGINT AS reports, sum(decrease_count)::BIGINT AS decreases, sum(asset_count)::BIGINT AS assets FROM lm_t GROUP BY ALL",
    "cost_snapshots": """SELECT c.work_id, lifecycle = 'COMPLETION' AS for_training, strftime(day_, '%Y-%m-%d') AS snapshot_on, sanctioned, expected_on - sanctioned_on AS planned_days, CASE WHEN expected_on > sanctioned_on THEN round((day_ - sanctioned_on)::DOUBLE / (expected_on - sanctioned_on), 6) END AS elapsed_ratio,
      CASE WHEN sanctioned > 0 THEN round(paid_::DOUBLE / sanctioned::DOUBLE, 6) END AS released_ratio, round(l[1], 6) AS physical, round(l[2], 6) AS financial, round(l[2] - l[1], 6) AS gap, round((l[1] - l[4]) / greatest(1, l[3] - l[5]) * 30, 6) AS velocity, n AS payment_count, early AS early_authorization, sector,
      CASE WHEN lifecycle = 'COMPLETION' THEN (final_spend > sanctioned)::INTEGER END AS overran FROM cs_1 c JOIN cs_p USING (work_id) LEFT JOIN cs_r USING (work_id)""",
    "platt_fit": "SELECT round(a, 4) AS slope, round(b, 4) AS intercept FROM pl_i WHERE i = 25",
}
