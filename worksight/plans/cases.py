"""Queries of officer cases and their DuckDB SQL; the catalog registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksight.functions.scalar import fixed
from worksight.operators import cases, desk, fusion, models, signals, trends
from worksight.plans import desk as desk_queries
from worksight.plans import sql
from worksight.plans.catalog import METRICS, Tables, given, query, trend_events, wide_signals
from worksight.plans.texts import nearest_texts, second_pairs
from worksight.sources import domain
from worksight.sources.domain import AS_OF
from worksight.sources.durable import durable


def places(t: Tables) -> DataFrame:
    return t.profile.select("work_id", "lifecycle", "completed_on", *[F.expr(text.format("work_id")).alias(c) for c, text in domain.REGISTERED.items()])


def second_rows(t: Tables) -> DataFrame:
    """Features of the second profile with closure records and the month's site evidence."""
    rows = cases.second_features(t.profile, t.payments, domain.site_reports(t.spark, t.sf_dir), AS_OF)
    closure = signals.record_status(t.assets, t.profile, AS_OF).select("work_id", "closure_requires_review")
    evidence = desk.geo_status(domain.captures(t.spark, t.sf_dir), places(t), AS_OF).select("work_id", "monthly_status")
    return rows.join(closure, "work_id", "left").join(evidence, "work_id", "left")


@query
def v2_work_features(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    rows = cases.second_features(t.profile, t.payments, domain.site_reports(spark, d), AS_OF)
    return rows.select("work_id", "lifecycle", "released", "payments", "early", "latest_release", "latest_report", *[fixed(c, 6).alias(c) for c in ("physical", "financial", "gap")], "observed_delay", "observed_overrun", "release_above_sanction")


@query
def geo_history(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return cases.geo_history(domain.captures(spark, d), places(t)).withColumn("metres", fixed("metres", 1))


@query
def case_dossier(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    compared = second_pairs(spark, d).where("review").select(F.explode(F.array("a", "b")).alias("work_id")).distinct().withColumn("has_pair", F.lit(True))
    rows = second_rows(t).join(compared, "work_id", "left")
    steps = cases.timeline(t.profile, t.payments, domain.site_reports(spark, d), t.assets, domain.captures(spark, d))
    return cases.dossier(rows, steps)


@query
def points_check(spark: SparkSession, d: str) -> DataFrame:
    evidence = fusion.family_evidence(wide_signals(Tables(spark, d), given)[0])
    evidence = durable(evidence)
    got = cases.checked_points(fusion.priority_scores(evidence), evidence)
    return got.withColumns({c: fixed(fixed(c, 6), 3) for c in ("score", "contribution_sum")})


@query
def v2_overview(spark: SparkSession, d: str) -> DataFrame:
    return cases.second_overview(second_rows(Tables(spark, d)))


@query
def v2_yearly_use(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    rows = cases.second_features(t.profile, t.payments, domain.site_reports(spark, d), AS_OF)
    return cases.yearly_use(rows).withColumns({c: fixed(c, 4) for c in ("use_pct", "change")})


@query
def v2_comparison(spark: SparkSession, d: str) -> DataFrame:
    return cases.second_comparison(second_rows(Tables(spark, d)).where("state = 'ASIA'"), "STATE")


@query
def v2_queue(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    told = domain.register(spark, d).select("work_id", "description")
    rows = second_rows(t).join(told, "work_id", "left").withColumn("requires_review", F.col("observed_delay") | F.col("release_above_sanction"))
    return cases.second_queue(rows, "the", {"lifecycle": "EXECUTION"}, True).select("work_id", "sector", "observed_delay", "release_above_sanction")


@query
def trend_view(spark: SparkSession, d: str) -> DataFrame:
    series = trends.dense_months(trend_events(Tables(spark, d)), AS_OF).withColumn("value", F.col("value").cast("bigint"))
    rows = cases.trend_view(series, cases.group_scope("STATE", "ASIA"), "RELEASED_AMOUNT", "DISTRICT", None, "1997-01-01", "1998-06-01", 200)
    return rows.select("group_type", "group_value", "metric", "month", "value", "events", "total")


@query
def alert_ids(spark: SparkSession, d: str) -> DataFrame:
    return cases.numbered_alerts(fusion.review_alerts(*wide_signals(Tables(spark, d), given))).select("alert_id", "work_id", "alert_type", "evidence_code")


@query
def stage_ranks(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d).profile.select("work_id", "lifecycle", F.coalesce("planned_days", F.lit(0)).alias("score"))
    return cases.within_stage_rank(rows, "score").select("work_id", "lifecycle", "stage_rank")


@query
def anomaly_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Works by the isolation forest, the oddest of each stage first."""
    got = cases.within_stage_rank(durable(models.isolation_forest(Tables(spark, d).profile, METRICS)))
    return got.select("work_id", "lifecycle", "stage_rank")


@query
def explanation_audit(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    asked = signals.rule_evidence(t.profile, t.assets, AS_OF).where("result in ('NON_COMPLIANT', 'REVIEW')").select("work_id", F.col("rule_id").alias("reference"))
    return cases.explanation_coverage(t.profile, asked)


@query
def retrieval_audit(spark: SparkSession, d: str) -> DataFrame:
    """For each asked work the place of the first near text of its sector, its district, and of neither."""
    near = nearest_texts(spark, d, 10)
    own = domain.register(spark, d).select("work_id", "sector", "district")
    side = lambda key, s: own.select(F.col("work_id").alias(key), F.col("sector").alias(f"sector_{s}"), F.col("district").alias(f"district_{s}"))
    rows = near.join(side("query_id", "a"), "query_id").join(side("chunk_id", "b"), "chunk_id")
    sector, district = F.col("sector_a") == F.col("sector_b"), F.col("district_a") == F.col("district_b")
    return cases.first_found(rows, {"same_sector": sector, "same_district": district, "neither": ~sector & ~district})


_day = desk_queries.DAY
_steps = " UNION ALL ".join(
    f"SELECT work_id, {on} AS on_, '{label}' AS label, '{kind}' AS kind FROM {source}"
    for on, label, kind, source in (
        ("recommended_on", "Recommendation", "RECORDED", "p"),
        ("sanctioned_on", "Sanction", "RECORDED", "p"),
        ("expected_on", "Expected Completion", "PLANNED", "p"),
        ("min(released_on)", "First Payment", "RECORDED", "pay GROUP BY work_id"),
        ("max(released_on)", "Latest Payment", "RECORDED", "pay GROUP BY work_id"),
        ("min(report_date)", "First Progress Report", "RECORDED", "site GROUP BY work_id"),
        ("max(report_date)", "Latest Progress Report", "RECORDED", "site GROUP BY work_id"),
        ("max(completed_on)", "Recorded Completion", "RECORDED", "ast GROUP BY work_id"),
        ("max(handover_on)", "Handover", "RECORDED", "ast GROUP BY work_id"),
        ("min(captured_on)", "First Site Evidence", "RECORDED", "capt GROUP BY work_id"),
        ("max(captured_on)", "Latest Site Evidence", "RECORDED", "capt GROUP BY work_id"),
    )
)
_window = "list_filter(generate_series(date_trunc('month', captured_on)::DATE, date_trunc('month', captured_on)::DATE + 9, INTERVAL 1 DAY), lambda x: isodow(x) < 6)"
_pair = lambda label, status: f"'{{\"label\":\"{label}\",\"status\":\"' || {status} || '\"}}'"
_ask = lambda test: f"CASE WHEN {test} THEN 'Requires Review' ELSE 'Normal' END"
_title = lambda test, title, status: f"CASE WHEN {test} THEN '{{\"title\":\"{title}\",\"status\":\"{status}\"}}' END"
sql.extend(
    {
        "capt": "SELECT l_orderkey AS work_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS evidence_id, CAST(l_shipdate AS DATE) + CAST(l_partkey % 15 AS INTEGER) AS captured_on, CASE WHEN l_returnflag = 'R' THEN 'COMPLETION' ELSE 'MONTHLY_PROGRESS' END AS stage, 10 + (l_orderkey % 200) * 0.05::DOUBLE + (l_suppkey % 7) * 0.001::DOUBLE AS la, 75 + (l_orderkey % 170) * 0.05::DOUBLE AS lo FROM lineitem",
        "sf_p": "SELECT work_id, sum(amount)::BIGINT AS released, count(*) AS payments, bool_or(authorized_on < requested_on) AS early, max(released_on) AS latest_release FROM pay GROUP BY work_id",
        "sf_r": "SELECT work_id, max(report_date) AS latest_report, arg_max(physical, (report_date, progress_id)) AS physical, arg_max(financial, (report_date, progress_id)) AS told FROM site GROUP BY work_id",
        "sf_0": "SELECT p.work_id, lifecycle, state, district, sector, sub_sector, mp_id, sanctioned, final_spend, expected_on, sanctioned_on, coalesce(released, 0) AS released, coalesce(payments, 0) AS payments, coalesce(early, false) AS early, latest_release, latest_report, physical, coalesce(told, CASE WHEN sanctioned > 0 THEN coalesce(released, 0) * 100.0::DOUBLE / sanctioned END) AS financial FROM p LEFT JOIN sf_p USING (work_id) LEFT JOIN sf_r USING (work_id)",
        "sf": f"SELECT *, financial - physical AS gap, lifecycle = 'EXECUTION' AND coalesce(expected_on < {_day}, false) AS observed_delay, coalesce(final_spend > sanctioned, false) AS observed_overrun, coalesce(released > sanctioned, false) AS release_above_sanction FROM sf_0",
        "sf_c": "SELECT work_id, lifecycle = 'COMPLETION' AND (bool_or(public_use_on IS NOT NULL) IS DISTINCT FROM true OR bool_or(handover_on IS NOT NULL) IS DISTINCT FROM true OR bool_or(certificate_on IS NOT NULL) IS DISTINCT FROM true) AS closure FROM p LEFT JOIN vis USING (work_id) GROUP BY work_id, lifecycle",
        "sf_m": f"SELECT work_id, CASE WHEN lifecycle <> 'EXECUTION' THEN 'NOT_APPLICABLE' WHEN min(captured_on) FILTER (stage = 'MONTHLY_PROGRESS' AND captured_on >= DATE '1998-12-01' AND captured_on <= {_day}) <= DATE '1998-12-03' THEN 'RECORDED' ELSE 'OVERDUE' END AS monthly FROM p LEFT JOIN capt USING (work_id) GROUP BY work_id, lifecycle",
        "sf_x": "SELECT * FROM sf JOIN sf_c USING (work_id) JOIN sf_m USING (work_id)",
        "tl_s": _steps,
        "tl_w": "SELECT work_id, '[' || string_agg('{\"on\":\"' || strftime(on_, '%Y-%m-%d') || '\",\"label\":\"' || label || '\",\"kind\":\"' || kind || '\"}', ',' ORDER BY on_, label) || ']' AS steps FROM tl_s WHERE on_ IS NOT NULL GROUP BY work_id",
    }
)
SQL = {
    "v2_work_features": "SELECT work_id, lifecycle, released, payments, early, strftime(latest_release, '%Y-%m-%d') AS latest_release, strftime(latest_report, '%Y-%m-%d') AS latest_report, round(physical, 6) AS physical, round(financial, 6) AS financial, round(gap, 6) AS gap, observed_delay, observed_overrun, release_above_sanction FROM sf",
    "geo_history": f"""SELECT work_id, evidence_id, strftime(captured_on, '%Y-%m-%d') AS captured_on, stage, CASE WHEN stage = 'MONTHLY_PROGRESS' THEN strftime({_window}[1], '%Y-%m-%d') || ' to ' || strftime({_window}[3], '%Y-%m-%d') END AS required_window,
      CASE WHEN stage = 'MONTHLY_PROGRESS' AND captured_on > {_window}[3] THEN 'SUBMITTED_LATE' ELSE 'RECORDED' END AS window_status, CASE WHEN metres <= 500 THEN 'LOCATION_CONSISTENT' ELSE 'LOCATION_REQUIRES_REVIEW' END AS location_status, round(metres, 1) AS metres
      FROM (SELECT *, 2 * 6371000.0::DOUBLE * asin(sqrt(sin(radians(la - (10 + (work_id % 200) * 0.05::DOUBLE)) / 2) ** 2 + cos(radians(10 + (work_id % 200) * 0.05::DOUBLE)) * cos(radians(la)) * sin(radians(lo - (75 + (work_id % 170) * 0.05::DOUBLE)) / 2) ** 2)) AS metres FROM capt WHERE work_id IN (SELECT work_id FROM p))""",
    "case_dossier": "SELECT work_id, lifecycle, steps AS timeline, '[' || concat_ws(',', "
    + ", ".join(
        _pair(label, status)
        for label, status in (
            ("Fund Utilization", "CASE WHEN sanctioned > 0 AND (released - sanctioned) * 100.0::DOUBLE / sanctioned > 30 THEN 'Very High Attention' ELSE " + _ask("released > sanctioned") + " END"),
            ("Physical Progress", _ask("gap > 25")),
            ("Schedule", "CASE WHEN observed_delay THEN 'Observed Delay' ELSE 'On Schedule' END"),
            ("Payments", _ask("early")),
            ("Compliance", _ask("closure")),
            ("Duplicate Review", "CASE WHEN work_id IN (SELECT id FROM hv_s WHERE review) THEN 'Requires Comparison' ELSE 'Normal' END"),
            ("Completion Records", "CASE WHEN closure THEN 'Requires Review' WHEN lifecycle <> 'COMPLETION' THEN 'Not yet due' ELSE 'Recorded' END"),
            ("Evidence Availability", "CASE WHEN monthly = 'OVERDUE' THEN 'Requires Review' ELSE 'Good' END"),
        )
    )
    + ") || ']' AS health, '[' || coalesce(nullif(concat_ws(',', "
    + ", ".join(
        _title(*x)
        for x in (
            ("gap > 25", "Financial progress is significantly ahead of physical progress", "Requires Review"),
            ("early", "Payment chronology is unusual", "Requires Review"),
            ("observed_delay", "The expected completion date has passed", "Observed Delay"),
            ("observed_overrun", "Final expenditure is above the sanctioned amount", "Observed Condition"),
        )
    )
    + "), ''), '{\"title\":\"No direct operational irregularity is currently flagged\",\"status\":\"Normal\"}') || ']' AS irregularities, CASE WHEN closure THEN 'REQUIRES_REVIEW' WHEN lifecycle <> 'COMPLETION' THEN 'NOT_YET_DUE' ELSE 'RECORDED' END AS completion_readiness FROM sf_x LEFT JOIN tl_w USING (work_id)",
    "points_check": "SELECT work_id, round(score, 3) AS score, round(score, 3) AS contribution_sum, n AS families FROM scores JOIN (SELECT work_id, count(*) AS n FROM contrib GROUP BY work_id) USING (work_id)",
    "v2_overview": "SELECT count(DISTINCT (state, district, sub_sector)) AS locations, count(*) AS works, sum(sanctioned)::BIGINT AS sanctioned, sum(released)::BIGINT AS released, sum(coalesce(final_spend, released))::BIGINT AS utilized, count(*) FILTER (lifecycle = 'COMPLETION') AS completed, count(*) FILTER (lifecycle = 'EXECUTION' AND NOT observed_delay) AS ongoing, count(*) FILTER (lifecycle = 'PRE_SANCTION') AS recommended, count(*) FILTER (observed_delay) AS delayed, count(*) FILTER (observed_overrun) AS over_budget, count(*) FILTER (closure) AS pending_records, count(*) FILTER (monthly = 'OVERDUE') AS evidence_overdue, (sum(released) - sum(coalesce(final_spend, released)))::BIGINT AS remaining, round(sum(coalesce(final_spend, released))::DOUBLE * 100 / sum(sanctioned)::DOUBLE, 1) AS utilization_pct FROM sf_x",
    "v2_yearly_use": "SELECT fiscal_year, sanctioned, released, round(u, 4) AS use_pct, round(u - lag(u) OVER (ORDER BY fiscal_year), 4) AS change FROM (SELECT (year(sanctioned_on) - (month(sanctioned_on) < 4)::INT)::INTEGER AS fiscal_year, sum(sanctioned)::BIGINT AS sanctioned, sum(released)::BIGINT AS released, sum(released)::DOUBLE * 100 / sum(sanctioned)::DOUBLE AS u FROM sf WHERE sanctioned_on IS NOT NULL GROUP BY 1)",
    "v2_comparison": "SELECT district AS label, count(*) AS works, round(sum(coalesce(final_spend, released))::DOUBLE * 100 / sum(sanctioned)::DOUBLE, 1) AS utilization_pct, round(avg((lifecycle = 'COMPLETION')::INT) * 100, 1) AS completion_pct, round(avg(observed_delay::INT) * 100, 1) AS delayed_pct, round(avg(closure::INT) * 100, 1) AS records_pct FROM sf_x WHERE state = 'ASIA' GROUP BY district",
    "v2_queue": "SELECT work_id, sector, observed_delay, release_above_sanction FROM sf_x LEFT JOIN (SELECT doc_id AS work_id, text FROM documents) USING (work_id) WHERE lifecycle = 'EXECUTION' AND (observed_delay OR release_above_sanction) AND contains(lower(concat_ws(' ', work_id::VARCHAR, text)), 'the')",
    "trend_view": "SELECT group_type, group_value, metric, strftime(month, '%Y-%m-%d') AS month, value, events, count(*) OVER () AS total FROM dense WHERE group_type = 'DISTRICT' AND metric = 'RELEASED_AMOUNT' AND list_contains(string_split(group_value, '|'), 'state=ASIA') AND month BETWEEN DATE '1997-01-01' AND DATE '1998-06-01' ORDER BY group_type, group_value, metric, dense.month LIMIT 200",
    "alert_ids": "SELECT 'D7-' || lpad(n::VARCHAR, 6, '0') AS alert_id, work_id, alert_type, evidence_code FROM (SELECT *, row_number() OVER (ORDER BY strength DESC, work_id, alert_type, evidence_code) AS n FROM alerts)",
    "stage_ranks": "SELECT work_id, lifecycle, row_number() OVER (PARTITION BY lifecycle ORDER BY coalesce(planned_days, 0) DESC, work_id) AS stage_rank FROM p",
    "explanation_audit": "SELECT count(*) AS works, count(n) AS with_references, coalesce(sum(n), 0)::BIGINT AS \"references\", coalesce(max(n), 0) AS most, (SELECT count(DISTINCT rule_id) FROM rule WHERE result IN ('NON_COMPLIANT', 'REVIEW')) AS distinct_references FROM p LEFT JOIN (SELECT work_id, count(*) AS n FROM rule WHERE result IN ('NON_COMPLIANT', 'REVIEW') GROUP BY work_id) USING (work_id)",
    "retrieval_audit": "SELECT x AS query_id, min(place) FILTER (p.sector = q.sector) AS same_sector, min(place) FILTER (p.district = q.district) AS same_district, min(place) FILTER (p.sector <> q.sector AND p.district <> q.district) AS neither FROM sw_k JOIN reg_w p ON p.work_id = x JOIN reg_w q ON q.work_id = y WHERE place <= 10 GROUP BY x",
}
