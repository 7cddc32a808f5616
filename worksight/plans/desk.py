"""Queries of the review desk and their DuckDB SQL; the catalog registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksight.functions import scalar
from worksight.functions.scalar import fixed
from worksight.operators import desk, features, fusion, models, signals
from worksight.plans import register, sql
from worksight.plans.catalog import REPORT_ORDER, Tables, given, query, served, wide_signals
from worksight.sources import domain
from worksight.sources.domain import AS_OF, table

ALERT = "PAYMENT_AUTH_BEFORE_REQUEST"


def payment_alerts(t: Tables) -> DataFrame:
    return signals.payment_signals(t.profile, t.payments, AS_OF).select("work_id", F.col("signal_code").alias("alert_type"), F.when(F.col("severity") == "WARNING", 60.0).otherwise(90.0).alias("strength"))


@query
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """The second page of works in execution of a region that overspent and have an alert of a type."""
    t = Tables(spark, d)
    rows = served(t).withColumn("overspent", F.col("overrun") > 0)
    rows = desk.filtered(rows, {"lifecycle": "EXECUTION", "band": None}, {"overspent": True}, "ASIA", ("state", "district", "sector", "sub_sector"))
    rows = desk.with_alert(rows, payment_alerts(t), ALERT, 50.0).select("work_id", "score", "band")
    return desk.paged(rows, [F.desc("score"), F.col("work_id")], 2, 10)


@query
def alert_filter(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of a stage and a least strength, as far as the scope of a district reaches."""
    t = Tables(spark, d)
    scope = t.profile.where("district = 'NATION_7' and lifecycle = 'COMPLETION'").select("work_id")
    return payment_alerts(t).where("strength >= 90").join(scope, "work_id", "left_semi").groupBy("work_id", "alert_type").agg(F.count("*").alias("alerts"))


@query
def attention_levels(spark: SparkSession, d: str) -> DataFrame:
    rows = served(Tables(spark, d))
    flag = scalar.truth(F.when(F.col("overrun") > 0, " TRUE ").when(F.col("overdue_days") > 0, "1").otherwise("no"), also_one=True)
    rows = rows.select(scalar.attention("band", flag).alias("attention"), scalar.severity_band("overrun_pct").alias("overrun_band"), scalar.money_text("sanctioned").alias("told"))
    return rows.groupBy("attention", "overrun_band").agg(F.count("*").alias("works"), F.max("told").alias("last_text"))


@query
def distribution_summary(spark: SparkSession, d: str) -> DataFrame:
    return desk.distribution(Tables(spark, d).profile, "sanctioned", "lifecycle")


@query
def pair_audit(spark: SparkSession, d: str) -> DataFrame:
    near = register.near_pairs(table(spark, d, "embeddings").select(F.col("vec_id").alias("work_id"), F.col("embedding").alias("v")), 10)
    return desk.pair_audit(near.withColumn("cosine", fixed("cosine", 4)), "cosine", [0.2, 0.4, 0.6, 0.8]).withColumnRenamed("limit", "least_cosine")


@query
def snapshot_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return desk.visibility(domain.assets(spark, d), ["completed_on", "marked_on", "public_use_on", "handover_on", "certificate_on"], AS_OF)


@query
def fan_out_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return desk.fan_out(domain.payments(spark, d), domain.assets(spark, d), domain.progress(spark, d))


@query
def geo_status(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    works = t.profile.select("work_id", "lifecycle", "completed_on", *[F.expr(text.format("work_id")).alias(c) for c, text in domain.REGISTERED.items()])
    return desk.geo_status(domain.captures(spark, d), works, AS_OF).withColumn("metres", fixed("metres", 1))


@query
def last_velocity(spark: SparkSession, d: str) -> DataFrame:
    return desk.last_velocity(domain.progress(spark, d), REPORT_ORDER)


@query
def applicability(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    known = signals.outcomes_of_completed(t.profile, t.assets, AS_OF)
    feasible = {target: bool(models.feasibility(known, label).first().feasible) for target, label in (("delay", "delayed"), ("cost_overrun", "overran"))}
    return desk.applicability(t.profile, feasible)


@query
def runtime_checks(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    early = t.payments.groupBy("work_id").agg(F.bool_or(F.col("authorized_on") < F.col("requested_on")).alias("early_authorization"))
    told = features.latest_report(domain.site_reports(spark, d).where(F.col("report_date") <= F.lit(AS_OF).cast("date")))
    rows = t.profile.join(told, "work_id", "left").join(early, "work_id", "left").withColumn("finished", F.col("lifecycle") == "COMPLETION")
    return desk.runtime_checks(rows, AS_OF)


@query
def similar_costs(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.works(spark, d)
    return desk.similar_costs(rows, rows.where("work_id % 20 = 0"))


@query
def query_texts(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    wide, funds, found, rules = wide_signals(t, given)
    alerts = fusion.review_alerts(wide, funds, found, rules)
    return desk.query_texts(t.profile, fusion.family_evidence(wide), alerts, rules.where("result in ('NON_COMPLIANT', 'REVIEW')"))


DAY = "DATE '1998-12-31'"
SQL = {
    "review_queue": f"SELECT work_id, score, band, total, CAST(ceil(total / 10.0) AS BIGINT) AS total_pages FROM (SELECT work_id, score, band, count(*) OVER () AS total FROM served WHERE lifecycle = 'EXECUTION' AND overrun > 0 AND contains(lower(concat_ws(' ', state, district, sector, sub_sector)), 'asia') AND work_id IN (SELECT work_id FROM sigs WHERE signal_code = '{ALERT}')) ORDER BY score DESC, work_id LIMIT 10 OFFSET 10",
    "alert_filter": "SELECT work_id, signal_code AS alert_type, count(*) AS alerts FROM sigs WHERE severity <> 'WARNING' AND work_id IN (SELECT work_id FROM p WHERE district = 'NATION_7' AND lifecycle = 'COMPLETION') GROUP BY ALL",
    "attention_levels": """SELECT CASE WHEN band IN ('HIGH', 'CRITICAL') THEN CASE WHEN f THEN 'IMMEDIATE' ELSE 'PRIORITY' END WHEN f THEN 'WATCH' ELSE 'ROUTINE' END AS attention,
        CASE WHEN overrun_pct <= 0 THEN 'NORMAL' WHEN overrun_pct <= 5 THEN 'MINOR' WHEN overrun_pct <= 15 THEN 'MODERATE' WHEN overrun_pct <= 30 THEN 'HIGH' WHEN overrun_pct > 30 THEN 'SEVERE' END AS overrun_band, count(*) AS works,
        max(CASE WHEN sanctioned >= 1e7 THEN printf('%.2f crore', sanctioned / 1e7) WHEN sanctioned >= 1e5 THEN printf('%.2f lakh', sanctioned / 1e5) ELSE printf('%.0f', sanctioned::DOUBLE) END) AS last_text
      FROM (SELECT *, coalesce(overrun > 0 OR overdue_days > 0, false) AS f FROM served) GROUP BY ALL""",
    "distribution_summary": "SELECT coalesce(lifecycle, 'ALL') AS group_value, count(*) AS n, min(sanctioned) AS minimum, "
    + ", ".join(f"round(quantile_cont(sanctioned::DOUBLE, {q}), 4) AS {c}" for q, c in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.9, "p90")))
    + ", round(avg(sanctioned), 4) AS mean, max(sanctioned) AS maximum FROM p WHERE sanctioned IS NOT NULL GROUP BY GROUPING SETS ((lifecycle), ())",
    "pair_audit": f"SELECT l::DOUBLE AS least_cosine, count(DISTINCT (a, b)) AS pairs, count(DISTINCT id) AS records FROM (SELECT a, b, cosine, unnest([a, b]) AS id FROM ({sql.BODIES['vector_topk_pairs']})) JOIN (VALUES (0.2), (0.4), (0.6), (0.8)) t(l) ON cosine >= l::DOUBLE GROUP BY l",
    "snapshot_diagnostics": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} <= {DAY}) AS included, count(*) FILTER ({c} > {DAY}) AS future, count(*) FILTER ({c} IS NULL) AS missing FROM ast" for c in ("completed_on", "marked_on", "public_use_on", "handover_on", "certificate_on")),
    "fan_out_cardinality": "SELECT count(*) AS works, coalesce(sum(a * b * c), 0)::BIGINT AS joined_rows FROM (SELECT work_id, count(*) AS a FROM pay GROUP BY 1) JOIN (SELECT work_id, count(*) AS b FROM ast GROUP BY 1) USING (work_id) JOIN (SELECT work_id, count(*) AS c FROM prog GROUP BY 1) USING (work_id)",
    "geo_status": f"""SELECT work_id, lifecycle, monthly_status, completion_status, latest_evidence, strftime(latest_on, '%Y-%m-%d') AS latest_on, CASE WHEN metres IS NULL THEN 'LOCATION_UNAVAILABLE' WHEN metres <= 500 THEN 'LOCATION_CONSISTENT' ELSE 'LOCATION_REQUIRES_REVIEW' END AS location_status, round(metres, 1) AS metres, late, monthly_status = 'OVERDUE' AND month_first IS NULL AS missing_month FROM
      (SELECT *, CASE WHEN lifecycle <> 'EXECUTION' THEN 'NOT_APPLICABLE' WHEN month_first IS NOT NULL THEN CASE WHEN month_first <= DATE '1998-12-03' THEN 'RECORDED' ELSE 'OVERDUE' END ELSE 'OVERDUE' END AS monthly_status,
        CASE WHEN lifecycle <> 'COMPLETION' THEN 'NOT_APPLICABLE' WHEN done_on <= list_filter(generate_series(completed_on + 1, completed_on + 10, INTERVAL 1 DAY), lambda x: isodow(x) < 6)[3] THEN 'RECORDED' WHEN done_on IS NULL AND {DAY} <= list_filter(generate_series(completed_on + 1, completed_on + 10, INTERVAL 1 DAY), lambda x: isodow(x) < 6)[3] THEN 'DUE' ELSE 'OVERDUE' END AS completion_status,
        2 * 6371000.0::DOUBLE * asin(sqrt(sin(radians(la - (10 + (work_id % 200) * 0.05::DOUBLE)) / 2) ** 2 + cos(radians(10 + (work_id % 200) * 0.05::DOUBLE)) * cos(radians(la)) * sin(radians(lo - (75 + (work_id % 170) * 0.05::DOUBLE)) / 2) ** 2)) AS metres
      FROM (SELECT work_id, lifecycle, completed_on, e AS latest_evidence, c AS latest_on, la, lo, month_first, done_on, coalesce(late, 0) AS late FROM p LEFT JOIN
        (SELECT work_id, arg_max(evidence_id, (c, evidence_id)) AS e, max(c) AS c, arg_max(la, (c, evidence_id)) AS la, arg_max(lo, (c, evidence_id)) AS lo, min(c) FILTER (NOT fin AND c >= DATE '1998-12-01') AS month_first, max(c) FILTER (fin) AS done_on,
          count(*) FILTER (NOT fin AND c > list_filter(generate_series(date_trunc('month', c)::DATE, date_trunc('month', c)::DATE + 9, INTERVAL 1 DAY), lambda x: isodow(x) < 6)[3]) AS late
          FROM (SELECT l_orderkey AS work_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS evidence_id, CAST(l_shipdate AS DATE) + CAST(l_partkey % 15 AS INTEGER) AS c, l_returnflag = 'R' AS fin, 10 + (l_orderkey % 200) * 0.05::DOUBLE + (l_suppkey % 7) * 0.001::DOUBLE AS la, 75 + (l_orderkey % 170) * 0.05::DOUBLE AS lo FROM lineitem)
          WHERE c <= {DAY} GROUP BY work_id) USING (work_id)))""",
    "last_velocity": "SELECT work_id, physical, round((physical - b) / greatest(1, report_date - d) * 30, 6) AS velocity FROM (SELECT *, row_number() OVER v AS n, lead(physical) OVER v AS b, lead(report_date) OVER v AS d FROM prog WINDOW v AS (PARTITION BY work_id ORDER BY report_date DESC, progress_id DESC)) WHERE n = 1",
    "applicability": "SELECT work_id, "
    + ", ".join(f"CASE lifecycle WHEN 'COMPLETION' THEN 'OUTCOME_ALREADY_KNOWN' WHEN 'EXECUTION' THEN CASE WHEN NOT (SELECT count(*) FILTER ({label} = 1) >= 50 AND count(*) FILTER ({label} = 0) >= 50 FROM out_w) THEN 'INSUFFICIENT_SUPERVISED_OUTCOME_DATA' WHEN {seen} THEN '{word}' ELSE 'PREDICTED_EARLY_WARNING_ELIGIBLE' END ELSE 'NOT_APPLICABLE_STAGE' END AS {name}" for name, label, seen, word in (("delay", "delayed", "overdue_days > 0", "OBSERVED_OVERDUE"), ("cost_overrun", "overran", "spend_ratio > 1", "OBSERVED_OVER_SANCTION")))
    + " FROM p",
    "runtime_checks": f"""SELECT work_id, 'Payments' AS area, 'Strong Issue' AS level, 'Released payments are ' || format('{{:,}}', floor((released_total - sanctioned) / 100.0::DOUBLE + 0.5)::BIGINT) || ' above sanctioned cost.' AS message FROM p WHERE sanctioned > 0 AND released_total > sanctioned
      UNION ALL SELECT work_id, 'Payments & Progress', 'Attention', 'Financial and physical progress differ by ' || printf('%.1f', round(apart, 1)) || ' percentage points.' FROM p JOIN (SELECT work_id, abs(arg_max(financial, (report_date, progress_id)) - arg_max(physical, (report_date, progress_id))) AS apart FROM site WHERE report_date <= {DAY} GROUP BY work_id) USING (work_id) WHERE apart >= 25
      UNION ALL SELECT work_id, 'Schedule', 'Strong Issue', 'Expected completion is overdue by ' || ({DAY} - expected_on) || ' days.' FROM p WHERE expected_on < {DAY} AND lifecycle <> 'COMPLETION'
      UNION ALL SELECT work_id, 'Payment Dates', 'Attention', 'An authorization date is recorded before its payment request date.' FROM p WHERE work_id IN (SELECT work_id FROM pay WHERE authorized_on < requested_on)""",
    "similar_costs": """SELECT asked_id, work_id, similarity, row_number() OVER (PARTITION BY asked_id ORDER BY similarity DESC, work_id) AS place FROM
        (SELECT *, row_number() OVER (PARTITION BY asked_id ORDER BY similarity DESC, work_id) AS n FROM (SELECT a.work_id AS asked_id, b.work_id, a.sub_sector = b.sub_sector AS same_, round(least(a.sanctioned, b.sanctioned)::DOUBLE / greatest(a.sanctioned, b.sanctioned)::DOUBLE, 6) AS similarity
          FROM w a JOIN w b ON a.sector = b.sector AND a.work_id <> b.work_id AND a.sanctioned > 0 AND b.sanctioned > 0 WHERE a.work_id % 20 = 0) WHERE similarity >= 0.5) WHERE n <= 40 AND same_ QUALIFY place <= 5""",
    "query_texts": """SELECT work_id, concat_ws(' | ', 'lifecycle ' || lifecycle, 'sector ' || sector, 'sub-sector ' || sub_sector, codes, told, asked) AS text FROM p
      LEFT JOIN (SELECT work_id, string_agg(code, ' | ' ORDER BY points DESC, family) AS codes FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY points DESC, family) AS n FROM contrib WHERE points > 0) WHERE n <= 5 GROUP BY work_id) USING (work_id)
      LEFT JOIN (SELECT work_id, string_agg(alert_type, ' | ' ORDER BY strength DESC, alert_type) AS told FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY strength DESC, alert_type) AS n FROM alerts) WHERE n <= 5 GROUP BY work_id) USING (work_id)
      LEFT JOIN (SELECT work_id, string_agg(words, ' | ' ORDER BY o) AS asked FROM rule JOIN (VALUES """
    + ", ".join(f"('{rule}', {i}, '{title} clause {clause}')" for i, (rule, (title, clause)) in enumerate(desk.REFERENCES.items()))
    + """) t(r, o, words) ON r = rule_id WHERE result IN ('NON_COMPLIANT', 'REVIEW') GROUP BY work_id) USING (work_id)""",
}
