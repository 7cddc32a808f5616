"""The queries as DuckDB SQL over the same tables, to compare results with."""

from __future__ import annotations

from worksight.operators.fusion import ALERTS_V2, FAMILIES, WEIGHTS, WEIGHTS_V2
from worksight.operators.signals import PAYMENT_SIGNALS, RULES

AS_OF, EVENTS_AS_OF = "DATE '1998-12-31'", "DATE '2024-01-20'"
CENTS = "CAST(floor({} * 100 + 0.5) AS BIGINT)"

#: Common table expressions by name, in the order in which they build on each other.
CTES = {
    "w": f"""SELECT o_orderkey AS work_id, o_custkey AS mp_id, o_orderpriority AS sector, o_orderstatus AS status, {CENTS.format("o_totalprice")} AS sanctioned,
        CAST(o_orderdate AS DATE) AS recommended_on, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS sanctioned_on,
        CAST(o_orderdate AS DATE) + CAST(180 + o_orderkey % 400 AS INTEGER) AS expected_on, n_name AS district, r_name AS state, c_mktsegment AS sub_sector
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "pay": f"""SELECT l_orderkey AS work_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {CENTS.format("l_extendedprice")}) AS payment_id, l_suppkey AS vendor_id,
        CAST(l_shipdate AS DATE) - CAST(l_partkey % 7 AS INTEGER) AS requested_on, CAST(l_shipdate AS DATE) - CAST(l_suppkey % 9 - 2 AS INTEGER) AS authorized_on, CAST(l_shipdate AS DATE) AS released_on,
        {CENTS.format("(l_extendedprice * (1 - l_discount))")} AS amount, l_linenumber AS stage, l_returnflag = 'R' AS is_final, l_linestatus = 'F' AS is_released, concat('R', l_partkey % 300, '-', l_suppkey) AS reference FROM lineitem""",
    "prog": "SELECT user_id AS work_id, event_id AS progress_id, CAST(ts AS DATE) AS report_date, least(100.0::DOUBLE, value) AS physical, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS financial, event_type AS stage FROM events",
    "ast": """SELECT o_orderkey AS work_id, concat(o_orderkey, '-', part) AS asset_id, d + CAST(200 + o_orderkey % 300 AS INTEGER) AS completed_on, d + CAST(205 + o_orderkey % 300 AS INTEGER) AS marked_on,
        CAST(floor(o_totalprice * 100 * (80 + o_orderkey % 50) / 100 + 0.5) AS BIGINT) AS final_spend,
        CASE WHEN o_orderkey % 11 <> 0 THEN d + CAST(210 + o_orderkey % 320 + part AS INTEGER) END AS public_use_on, CASE WHEN o_orderkey % 13 <> 0 THEN d + CAST(208 + o_orderkey % 310 + part AS INTEGER) END AS handover_on,
        CASE WHEN o_orderkey % 17 <> 0 THEN d + CAST(220 + o_orderkey % 330 AS INTEGER) END AS certificate_on,
        CASE o_orderkey % 6 WHEN 0 THEN 'No' WHEN 1 THEN 'Pending' WHEN 2 THEN NULL ELSE 'Yes' END AS register_entry, CASE o_orderkey % 5 WHEN 0 THEN 'Pending' WHEN 1 THEN NULL ELSE 'Submitted' END AS certificate_status,
        CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('PHOTO-', o_orderkey) END AS photo
      FROM (SELECT *, CAST(o_orderdate AS DATE) AS d, unnest(CASE WHEN o_orderkey % 7 = 0 THEN [1, 2] ELSE [1] END) AS part FROM orders WHERE o_orderstatus = 'F')""",
    "rel": f"SELECT * FROM pay WHERE is_released AND released_on <= {AS_OF}",
    "vend": "SELECT work_id, vendor_id, sum(amount) AS v FROM rel GROUP BY ALL",
    "paid": f"""SELECT work_id, count(*) AS payment_count, CAST(sum(amount) AS BIGINT) AS released_total, count(DISTINCT vendor_id) AS vendor_count, max(amount) AS largest_payment, min(released_on) AS first_payment_on, max(released_on) AS last_payment_on,
        CAST(count(*) FILTER (is_final) AS BIGINT) AS final_payment_count, count(*) FILTER (amount = 0) AS zero_payment_count, CASE WHEN sum(amount) > 0 THEN max(amount)::DOUBLE / sum(amount)::DOUBLE END AS largest_share, {AS_OF} - max(released_on) AS days_since_payment FROM rel GROUP BY work_id""",
    "hhi": "SELECT work_id, CASE WHEN sum(v) > 0 THEN sum(v::DOUBLE * v::DOUBLE) / (sum(v)::DOUBLE * sum(v)::DOUBLE) END AS vendor_hhi FROM vend GROUP BY work_id",
    "vis": f"""SELECT work_id, asset_id, completed_on, CASE WHEN marked_on <= {AS_OF} THEN final_spend END AS final_spend, CASE WHEN public_use_on <= {AS_OF} THEN public_use_on END AS public_use_on, CASE WHEN handover_on <= {AS_OF} THEN handover_on END AS handover_on,
        CASE WHEN certificate_on <= {AS_OF} THEN certificate_on END AS certificate_on, register_entry, certificate_status, photo FROM ast WHERE completed_on <= {AS_OF}""",
    "asum": "SELECT work_id, count(*) AS asset_count, max(completed_on) AS completed_on, CAST(sum(final_spend) AS BIGINT) AS final_spend, bool_or(public_use_on IS NOT NULL) AS any_public_use, bool_or(handover_on IS NOT NULL) AS any_handover, bool_or(certificate_on IS NOT NULL) AS any_certificate FROM vis GROUP BY work_id",
    "p0": f"""SELECT w.* EXCLUDE (sanctioned_on), CASE WHEN sanctioned_on <= {AS_OF} THEN sanctioned_on END AS sanctioned_on, coalesce(payment_count, 0) AS payment_count, coalesce(released_total, 0) AS released_total, vendor_count, largest_share, vendor_hhi, days_since_payment,
        coalesce(final_payment_count, 0) AS final_payment_count, coalesce(zero_payment_count, 0) AS zero_payment_count, coalesce(asset_count, 0) AS asset_count, completed_on, final_spend,
        CASE WHEN NOT (status <> 'P' AND sanctioned_on <= {AS_OF}) THEN 'PRE_SANCTION' WHEN coalesce(asset_count, 0) > 0 THEN 'COMPLETION' ELSE 'EXECUTION' END AS lifecycle
      FROM w LEFT JOIN paid USING (work_id) LEFT JOIN hhi USING (work_id) LEFT JOIN asum USING (work_id) WHERE recommended_on <= {AS_OF}""",
    "p": f"""SELECT *, CASE WHEN sanctioned > 0 THEN released_total::DOUBLE / sanctioned::DOUBLE END AS spend_ratio, CASE WHEN sanctioned_on IS NOT NULL THEN greatest(released_total - sanctioned, 0) END AS overrun,
        CASE WHEN sanctioned > 0 AND sanctioned_on IS NOT NULL THEN greatest(released_total - sanctioned, 0) * 100.0::DOUBLE / sanctioned::DOUBLE END AS overrun_pct,
        CASE WHEN lifecycle = 'EXECUTION' THEN CASE WHEN expected_on < {AS_OF} THEN {AS_OF} - expected_on ELSE 0 END END AS overdue_days, sanctioned_on - recommended_on AS sanction_days, expected_on - recommended_on AS planned_days,
        CASE WHEN expected_on - recommended_on > 0 THEN ({AS_OF} - recommended_on)::DOUBLE / (expected_on - recommended_on)::DOUBLE END AS schedule_ratio FROM p0""",
    "gaps": "SELECT *, financial - physical AS gap FROM prog WHERE financial - physical IS NOT NULL",
    "gr": "SELECT *, sum(CASE WHEN gap >= 25 THEN 0 ELSE 1 END) OVER (PARTITION BY work_id ORDER BY report_date, progress_id ROWS UNBOUNDED PRECEDING) AS g FROM gaps",
    "grl": "SELECT work_id, g, count(*) FILTER (gap >= 25) AS n FROM gr GROUP BY ALL",
    "runs": """SELECT work_id, reports, latest_gap, largest_gap, positive_gaps, flagged, longest_run, latest_run FROM
        (SELECT work_id, count(*) AS reports, arg_max(gap, (report_date, progress_id)) AS latest_gap, max(gap) AS largest_gap, count(*) FILTER (gap > 0) AS positive_gaps FROM gaps GROUP BY work_id)
        JOIN (SELECT work_id, CAST(sum(n) AS BIGINT) AS flagged, max(n) AS longest_run, arg_max(n, g) AS latest_run FROM grl GROUP BY work_id) USING (work_id)""",
    "pa": f"SELECT *, physical - lag(physical) OVER (PARTITION BY work_id ORDER BY report_date, progress_id) AS change FROM prog WHERE report_date <= {EVENTS_AS_OF}",
    "latest": f"""SELECT work_id, count(*) AS report_count, min(report_date) AS first_report_on, max(report_date) AS last_report_on, arg_min(physical, (report_date, progress_id)) AS first_physical, arg_max(physical, (report_date, progress_id)) AS last_physical,
        arg_max(financial, (report_date, progress_id)) AS last_financial, count(*) FILTER (change < 0) AS decrease_count, coalesce(max(-change) FILTER (change < 0), 0) AS largest_decrease, count(*) - count(DISTINCT report_date) AS same_day_extras, {EVENTS_AS_OF} - max(report_date) AS days_since_report FROM pa GROUP BY work_id""",
    "fund0": "SELECT p.work_id, CASE WHEN sanctioned > 0 THEN released_total * 100.0::DOUBLE / sanctioned::DOUBLE END AS paid_pct, last_physical, last_financial, latest_run FROM p LEFT JOIN latest USING (work_id) LEFT JOIN runs USING (work_id) WHERE sanctioned > 0 AND sanctioned_on IS NOT NULL",
    "fund": """SELECT work_id, paid_pct, paid_pct - last_physical AS fund_gap, last_financial - last_physical AS reported_gap, last_financial - paid_pct AS reconciliation, coalesce(paid_pct - last_physical >= 25, false) AS current_large_gap,
        coalesce(latest_run >= 2, false) AS persistent_gap FROM fund0""",
    "seq": """SELECT r.*, completed_on, row_number() OVER (PARTITION BY reference ORDER BY released_on, stage, payment_id, r.work_id) AS use_, coalesce(max(is_final::INTEGER) OVER (PARTITION BY r.work_id ORDER BY released_on, stage, payment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS after_final,
        sum(is_final::INTEGER) OVER (PARTITION BY r.work_id ORDER BY released_on, stage, payment_id ROWS UNBOUNDED PRECEDING) AS finals FROM rel r LEFT JOIN p USING (work_id)""",
    "own": "SELECT * FROM seq WHERE work_id IN (SELECT work_id FROM p)",
    "sig": """SELECT work_id, payment_id, 'PAYMENT_AUTH_BEFORE_REQUEST' AS signal_code FROM own WHERE authorized_on < requested_on
      UNION ALL SELECT work_id, payment_id, 'PAYMENT_RELEASE_BEFORE_AUTH' FROM own WHERE released_on < authorized_on
      UNION ALL SELECT work_id, payment_id, 'DUPLICATE_PFMS_REFERENCE' FROM own WHERE use_ > 1
      UNION ALL SELECT work_id, payment_id, 'ZERO_VALUE_RELEASED_PAYMENT' FROM own WHERE amount = 0
      UNION ALL SELECT work_id, payment_id, 'PAYMENT_AFTER_COMPLETION' FROM own WHERE released_on > completed_on
      UNION ALL SELECT work_id, payment_id, 'PAYMENT_AFTER_FINAL_PAYMENT' FROM own WHERE after_final
      UNION ALL SELECT work_id, payment_id, 'MULTIPLE_FINAL_PAYMENTS' FROM own WHERE is_final AND finals > 1
      UNION ALL SELECT work_id, NULL, 'RELEASED_TOTAL_EXCEEDS_SANCTION' FROM p WHERE released_total > sanctioned AND sanctioned_on IS NOT NULL""",
    "sigs": "SELECT *, CASE WHEN signal_code IN ({}) THEN 'WARNING' ELSE 'STRONG_WARNING' END AS severity FROM sig".format(", ".join(f"'{c}'" for c, s in PAYMENT_SIGNALS.items() if s == "WARNING")),
    "ac": """SELECT work_id, count(*) AS assets, count(public_use_on) AS in_use, count(*) FILTER (trim(photo) <> '') AS with_photo, count(handover_on) AS handed, count(*) FILTER (handover_on IS NOT NULL AND register_entry IS NULL) AS hu,
        count(*) FILTER (handover_on IS NOT NULL AND lower(register_entry) = 'no') AS hn, count(*) FILTER (handover_on IS NOT NULL AND lower(register_entry) = 'yes') AS hy, count(*) FILTER (certificate_status IS NULL) AS cu, count(*) FILTER (certificate_status = 'Submitted' AND certificate_on IS NOT NULL) AS cok FROM vis GROUP BY work_id""",
    "rw": """SELECT p.work_id, lifecycle,
        CASE WHEN sanction_days IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN sanction_days BETWEEN 0 AND 45 THEN 'PASS' ELSE 'REVIEW' END AS r1, CASE WHEN sanctioned IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN sanctioned >= 25000000 THEN 'PASS' ELSE 'REVIEW' END AS r2,
        CASE WHEN planned_days IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN planned_days BETWEEN 0 AND 365 THEN 'PASS' ELSE 'REVIEW' END AS r3,
        CASE WHEN coalesce(assets, 0) = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN in_use = assets THEN 'PASS' ELSE 'REVIEW' END AS r4, CASE WHEN coalesce(assets, 0) = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN with_photo = assets THEN 'PASS' ELSE 'NON_COMPLIANT' END AS r5,
        CASE WHEN coalesce(assets, 0) = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN handed = assets THEN 'PASS' ELSE 'REVIEW' END AS r6,
        CASE WHEN coalesce(assets, 0) = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN handed = 0 THEN 'NOT_APPLICABLE' WHEN hu > 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN hn > 0 THEN 'NON_COMPLIANT' WHEN hy = handed THEN 'PASS' ELSE 'REVIEW' END AS r7,
        CASE WHEN coalesce(assets, 0) = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN cu > 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN cok = assets THEN 'PASS' ELSE 'REVIEW' END AS r8 FROM p LEFT JOIN ac USING (work_id)""",
    "rule": " UNION ALL ".join(
        f"SELECT work_id, lifecycle, '{rule}' AS rule_id, '{severity}' AS severity, CASE WHEN lifecycle IN ({', '.join(repr(s) for s in stages)}) THEN r{i} ELSE 'NOT_APPLICABLE' END AS result FROM rw" for i, (rule, (severity, stages)) in enumerate(RULES.items(), 1)
    ),
    "ev_r": "SELECT l_orderkey AS work_id, CAST(l_shipdate AS DATE) + CAST(l_partkey % 15 AS INTEGER) AS report_date FROM lineitem",
    "ev": """SELECT 'RELEASED_AMOUNT' AS metric, released_on AS event_on, amount AS value, state, district, sector FROM pay JOIN w USING (work_id) WHERE is_released
      UNION ALL SELECT 'RELEASED_PAYMENTS', released_on, 1, state, district, sector FROM pay JOIN w USING (work_id) WHERE is_released
      UNION ALL SELECT 'RECOMMENDATIONS', recommended_on, 1, state, district, sector FROM w
      UNION ALL SELECT 'RECOMMENDED_AMOUNT', recommended_on, sanctioned * (100 + work_id % 10) // 100, state, district, sector FROM w
      UNION ALL SELECT 'SANCTIONS', sanctioned_on, 1, state, district, sector FROM w WHERE status <> 'P'
      UNION ALL SELECT 'SANCTIONED_AMOUNT', sanctioned_on, sanctioned, state, district, sector FROM w WHERE status <> 'P'
      UNION ALL SELECT 'PROGRESS_REPORTS', report_date, 1, state, district, sector FROM ev_r JOIN w USING (work_id)""",    "evg": "SELECT metric, date_trunc('month', event_on)::DATE AS month, value, unnest(['STATE', 'DISTRICT', 'SECTOR', 'STATE_SECTOR', 'DISTRICT_SECTOR']) AS group_type, unnest(['state=' || state, 'state=' || state || '|district=' || district, 'sector=' || sector, 'state=' || state || '|sector=' || sector, 'state=' || state || '|district=' || district || '|sector=' || sector]) AS group_value FROM ev WHERE event_on <= DATE '1998-11-30' AND value IS NOT NULL",
    "mon": "SELECT group_type, group_value, metric, month, sum(value) AS value, count(*) AS events FROM evg WHERE group_value IS NOT NULL GROUP BY ALL",
    "grid": "SELECT group_type, group_value, metric, unnest(generate_series(min(month), DATE '1998-11-01', INTERVAL 1 MONTH))::DATE AS month FROM mon GROUP BY group_type, group_value, metric",
    "dense": "SELECT group_type, group_value, metric, month, coalesce(value, 0)::BIGINT AS value, coalesce(events, 0) AS events FROM grid LEFT JOIN mon USING (group_type, group_value, metric, month)",
    "base0": """SELECT *, count(*) OVER f AS baseline_months, coalesce(sum(events) OVER f, 0)::BIGINT AS support, list(value::DOUBLE) OVER f AS h, quantile_cont(value::DOUBLE, 0.5) OVER f AS median, quantile_cont(value::DOUBLE, 0.25) OVER f AS q1, quantile_cont(value::DOUBLE, 0.75) OVER f AS q3
      FROM dense WINDOW f AS (PARTITION BY group_type, group_value, metric ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""",
    "base1": "SELECT *, list_median(list_transform(h, lambda v: abs(v - median))) AS mad, q3 - q1 AS iqr FROM base0",
    "base2": """SELECT *, CASE WHEN baseline_months = 0 THEN 'NO_HISTORY' WHEN mad > 0 THEN 'MAD' WHEN iqr > 0 THEN 'IQR_FALLBACK' ELSE 'CONSTANT_BASELINE_NO_DEVIATION' END AS method,
        CASE WHEN baseline_months < 4 THEN 'INSUFFICIENT_PRIOR_MONTHS' WHEN support < 20 THEN 'INSUFFICIENT_HISTORICAL_EVENT_SUPPORT' ELSE 'SUPPORTED' END AS status FROM base1""",
    "base": "SELECT *, CASE WHEN status = 'SUPPORTED' THEN CASE WHEN mad > 0 THEN 0.6745 * (value - median) / mad WHEN iqr > 0 THEN (value - median) / (iqr / 1.349) END END AS robust_z FROM base2",
    "top0": "SELECT group_type, group_value, metric, robust_z, abs(robust_z) >= 3.5 AS flagged, abs(robust_z) AS size, row_number() OVER (PARTITION BY group_type, group_value ORDER BY abs(robust_z) DESC, metric DESC) AS rn FROM base WHERE month = DATE '1998-11-01' AND robust_z IS NOT NULL",
    "top1": "SELECT * FROM top0 WHERE rn = 1",
    "fl": "SELECT group_type, group_value, CASE WHEN count(*) OVER () = 1 THEN 100.0 ELSE (rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2.0 - 1) / (count(*) OVER () - 1) * 100 END AS strength FROM top1 WHERE flagged",
    "choice": """SELECT work_id, t.*, coalesce(strength, 0) AS strength, row_number() OVER (PARTITION BY work_id ORDER BY lvl) AS pick FROM (SELECT work_id, unnest(['DISTRICT_SECTOR', 'STATE_SECTOR', 'DISTRICT', 'SECTOR', 'STATE']) AS group_type, unnest([1, 2, 3, 4, 5]) AS lvl,
        unnest(['state=' || state || '|district=' || district || '|sector=' || sector, 'state=' || state || '|sector=' || sector, 'state=' || state || '|district=' || district, 'sector=' || sector, 'state=' || state]) AS group_value FROM w) c JOIN top1 t USING (group_type, group_value) LEFT JOIN fl USING (group_type, group_value)""",
    "ctx": "SELECT w.work_id, coalesce(group_type, 'NO_SUPPORTED_GROUP') AS trend_group, metric AS trend_metric, robust_z AS trend_z, coalesce(flagged, false) AS trend_flagged, coalesce(strength, 0) AS trend_strength FROM w LEFT JOIN (SELECT * FROM choice WHERE pick = 1) x ON w.work_id = x.work_id",
    "pl": "SELECT work_id, lifecycle, district, sector, sub_sector, 'released_total' AS metric, 0 AS mo, released_total::DOUBLE AS value FROM p UNION ALL SELECT work_id, lifecycle, district, sector, sub_sector, 'planned_days', 1, planned_days::DOUBLE FROM p",
}
LEVELS = (("district", "sector", "sub_sector"), ("district", "sector"), ("sector", "sub_sector"), ("sector",), ())
for _i, _keys in enumerate(LEVELS):
    _k = ", ".join(("lifecycle", *_keys, "metric"))
    CTES[f"ps{_i}"] = f"SELECT {_k}, {_i} AS level, count(value) AS n, quantile_cont(value, 0.5) AS median, mad(value) AS mad, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM pl GROUP BY {_k} HAVING count(value) >= 20"
_first = lambda c: "coalesce(" + ", ".join(f"ps{i}.{c}" for i in range(5)) + ")"
_pick = lambda c: "CASE " + " ".join(f"WHEN ps{i}.level IS NOT NULL THEN ps{i}.{c}" for i in range(5)) + " END"
CTES["pe0"] = "SELECT pl.work_id, pl.lifecycle, pl.metric, pl.mo, pl.value, " + ", ".join(f"{_pick(c)} AS {c}" for c in ("level", "n", "median", "mad", "iqr")) + " FROM pl " + " ".join("LEFT JOIN ps{0} ON {1}".format(i, " AND ".join(f"pl.{k} = ps{i}.{k}" for k in ("lifecycle", *keys, "metric"))) for i, keys in enumerate(LEVELS))
CTES["pe"] = "SELECT *, CASE WHEN mad > 0 THEN 0.6745 * (value - median) / mad WHEN iqr > 0 THEN (value - median) / (iqr / 1.349) END AS deviation, CASE WHEN value IS NULL OR median IS NULL THEN 'OBSERVED_OR_PEER_VALUE_MISSING' WHEN mad > 0 THEN 'MODIFIED_Z_MAD' WHEN iqr > 0 THEN 'STANDARDIZED_IQR_FALLBACK' ELSE 'UNAVAILABLE_CONSTANT_PEER_DISTRIBUTION' END AS method FROM pe0"
CTES["psum"] = "SELECT work_id, lifecycle, count(deviation) AS usable_metrics, count(*) FILTER (abs(deviation) >= 3.5) AS outlier_count, max(abs(deviation)) AS max_deviation FROM pe GROUP BY work_id, lifecycle"


def pct(value: str, keys: str = "", where: str = "true", inclusive: bool = False) -> str:
    """Percentile of value among rows where it isn't null and the condition holds."""
    part = f"PARTITION BY {keys}, " if keys else "PARTITION BY "
    v = f"CASE WHEN {where} THEN {value} END"
    rank = f"rank() OVER ({part}({v}) IS NULL ORDER BY {v}) + (count(*) OVER ({part}{v}) - 1) / 2.0"
    n = f"count(*) OVER ({part}({v}) IS NULL)"
    score = f"({rank}) / {n} * 100" if inclusive else f"CASE WHEN {n} = 1 THEN 100.0 ELSE ({rank} - 1) / ({n} - 1) * 100 END"
    return f"CASE WHEN ({v}) IS NOT NULL THEN {score} END"


_sev = lambda scores: "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scores.items()) + " ELSE 0 END"
CTES |= {
    "odd": f"SELECT work_id, {pct('planned_days', 'lifecycle')} AS odd FROM p",
    "pf": f"SELECT work_id, coalesce({pct('max_deviation', 'lifecycle', 'outlier_count > 0 AND max_deviation IS NOT NULL')}, 0) AS peer_score, CASE WHEN outlier_count > 0 THEN 'STATISTICAL_PEER_OUTLIER' ELSE 'NO_STATISTICAL_PEER_OUTLIER' END AS peer_code FROM psum",
    "ptop": "SELECT work_id, max(s) AS s, arg_min(signal_code, (-s, signal_code)) AS code FROM (SELECT *, {} AS s FROM sigs WHERE signal_code <> 'RELEASED_TOTAL_EXCEEDS_SANCTION') GROUP BY work_id".format(_sev({"INFO": 25.0, "WARNING": 60.0, "STRONG_WARNING": 90.0})),
    "pg0": f"SELECT p.work_id, coalesce(s, 0) AS s, code, fund_gap, coalesce(persistent_gap, false) AS keep, {pct('fund_gap', '', 'fund_gap > 0')} AS gp FROM p LEFT JOIN ptop USING (work_id) LEFT JOIN fund USING (work_id)",
    "pg": "SELECT *, least(100.0, coalesce(gp, 0) + CASE WHEN keep THEN 10.0 ELSE 0 END) AS gs FROM pg0",
    "payf": "SELECT work_id, greatest(s, gs) AS payment_score, CASE WHEN gs > 0 AND keep THEN 'PERSISTENT_FUND_PROGRESS_REVIEW' WHEN s > gs THEN code WHEN gs > 0 THEN 'FUND_PROGRESS_REVIEW' ELSE 'NO_PAYMENT_EXECUTION_SIGNAL' END AS payment_code, fund_gap IS NOT NULL AS payment_available FROM pg",
    "ob0": "SELECT work_id, overdue_days, overrun_pct, coalesce(lifecycle = 'EXECUTION' AND overdue_days > 0, false) AS late, coalesce(lifecycle = 'EXECUTION' AND overrun_pct > 0, false) AS over_ FROM p",
    "obf": f"SELECT work_id, late, over_, greatest(CASE WHEN late THEN 50 + 0.5 * {pct('overdue_days', '', 'late')} ELSE 0 END, CASE WHEN over_ THEN 75 + 0.25 * {pct('overrun_pct', '', 'over_')} ELSE 0 END) AS observed_score, CASE WHEN late AND over_ THEN 'OBSERVED_OVERDUE_AND_OVER_SANCTION' WHEN over_ THEN 'OBSERVED_OVER_SANCTION' WHEN late THEN 'OBSERVED_OVERDUE' ELSE 'NO_OBSERVED_CONDITION' END AS observed_code FROM ob0",
    "cf": "SELECT work_id, greatest(max(s), 0) AS compliance_score, CASE WHEN max(s) >= 0 THEN arg_min(rule_id, (-s, rule_id)) ELSE 'NO_ACTIONABLE_COMPLIANCE_RESULT' END AS compliance_code FROM (SELECT *, CASE WHEN result = 'NON_COMPLIANT' THEN 100.0 WHEN result = 'REVIEW' THEN {} ELSE -1.0 END AS s FROM rule) GROUP BY work_id".format(_sev({"INFO": 30.0, "WARNING": 60.0, "STRONG_WARNING": 80.0})),
    "sv": f"SELECT work_id, {pct('spend_ratio', '', chr(39).join(['lifecycle = ', 'EXECUTION', '']))} AS serving FROM p",
    "wide": """SELECT p.work_id, p.lifecycle, round(odd, 6) AS s0, 'LIFECYCLE_ANOMALY_PERCENTILE' AS c0, odd IS NOT NULL AS a0, round(peer_score, 6) AS s1, peer_code AS c1, peer_score IS NOT NULL AS a1, CASE WHEN p.work_id % 97 = 0 THEN 90.0 + p.work_id % 10 ELSE 0 END AS s2, CASE WHEN p.work_id % 97 = 0 THEN 'DUPLICATE_REVIEW_CANDIDATE' ELSE 'NO_DUPLICATE_REVIEW_CANDIDATE' END AS c2, p.work_id % 97 = 0 OR p.work_id % 3 <> 0 AS a2,
        round(payment_score, 6) AS s3, payment_code AS c3, payment_available AS a3, round(observed_score, 6) AS s4, observed_code AS c4, p.lifecycle = 'EXECUTION' AS a4, round(compliance_score, 6) AS s5, compliance_code AS c5, compliance_score IS NOT NULL AS a5,
        round(coalesce(serving, 0), 6) AS s6, CASE WHEN p.lifecycle = 'EXECUTION' THEN 'SECONDARY_EARLY_WARNING' ELSE 'NOT_APPLICABLE_STAGE' END AS c6, p.lifecycle = 'EXECUTION' AND serving IS NOT NULL AS a6,
        round(trend_strength, 6) AS s7, CASE WHEN trend_flagged THEN 'OPERATIONAL_TREND_DEVIATION' ELSE 'NO_OPERATIONAL_TREND_DEVIATION' END AS c7, trend_z IS NOT NULL AS a7
      FROM p LEFT JOIN odd USING (work_id) LEFT JOIN pf USING (work_id) LEFT JOIN payf USING (work_id) LEFT JOIN obf USING (work_id) LEFT JOIN cf USING (work_id) LEFT JOIN ctx USING (work_id) LEFT JOIN sv USING (work_id)""",
    "fam": " UNION ALL ".join(
        f"SELECT work_id, lifecycle, {i} AS fo, '{f}' AS family, s{i}::DOUBLE AS score, c{i} AS code, coalesce(a{i}, false) AS available, CASE lifecycle " + " ".join(f"WHEN '{stage}' THEN {w[f]}" for stage, w in WEIGHTS.items() if f in w) + f" END AS weight FROM wide WHERE lifecycle IN ({', '.join(repr(s) for s, w in WEIGHTS.items() if f in w)})"
        for i, f in enumerate(FAMILIES)
    ),
    "contrib": "SELECT *, round(coalesce(score, 0) * weight / 100, 6) AS points FROM fam",
    "sc": """SELECT work_id, lifecycle, round(sum(points), 6) AS score, CAST(sum(CASE WHEN available THEN weight ELSE 0 END) AS BIGINT) AS coverage, arg_min(family, (-points, fo)) FILTER (points > 0) AS top_family_1 FROM contrib GROUP BY work_id, lifecycle""",
    "scores": "SELECT *, CASE WHEN score < 25 THEN 'LOW' WHEN score < 50 THEN 'MEDIUM' WHEN score < 75 THEN 'HIGH' ELSE 'CRITICAL' END AS band FROM sc",
    "alerts": """SELECT work_id, 'STATISTICAL_ANOMALY' AS alert_type, 'LIFECYCLE_ANOMALY_TOP_DECILE' AS evidence_code, s0 AS strength FROM wide WHERE s0 >= 90
      UNION ALL SELECT work_id, 'PEER_DEVIATION', 'STATISTICAL_PEER_OUTLIER', s1 FROM wide WHERE c1 = 'STATISTICAL_PEER_OUTLIER'
      UNION ALL SELECT work_id, 'DUPLICATE_REVIEW_CANDIDATE', 'CORROBORATED_REVIEW_CANDIDATE', s2 FROM wide WHERE c2 = 'DUPLICATE_REVIEW_CANDIDATE'
      UNION ALL SELECT work_id, 'OBSERVED_OVERDUE', 'OBSERVED_OVERDUE_AS_OF', s4 FROM wide WHERE c4 IN ('OBSERVED_OVERDUE', 'OBSERVED_OVERDUE_AND_OVER_SANCTION')
      UNION ALL SELECT work_id, 'OBSERVED_OVER_SANCTION', 'OBSERVED_OVER_SANCTION_AS_OF', s4 FROM wide WHERE c4 IN ('OBSERVED_OVER_SANCTION', 'OBSERVED_OVERDUE_AND_OVER_SANCTION')
      UNION ALL SELECT work_id, 'COST_OVERRUN_EARLY_WARNING', 'SECONDARY_TOP_DECILE', s6 FROM wide WHERE s6 >= 90 AND c4 NOT IN ('OBSERVED_OVER_SANCTION', 'OBSERVED_OVERDUE_AND_OVER_SANCTION')
      UNION ALL SELECT work_id, 'OPERATIONAL_TREND_DEVIATION', 'SUPPORTED_LATEST_MONTH_OPERATIONAL_TREND', s7 FROM wide WHERE c7 = 'OPERATIONAL_TREND_DEVIATION'
      UNION ALL SELECT work_id, 'PAYMENT_IRREGULARITY', codes, least(100, s3) FROM (SELECT work_id, string_agg(DISTINCT signal_code, ';' ORDER BY signal_code) AS codes FROM sigs WHERE signal_code <> 'RELEASED_TOTAL_EXCEEDS_SANCTION' GROUP BY work_id) JOIN wide USING (work_id)
      UNION ALL SELECT work_id, 'FUND_PROGRESS_REVIEW', CASE WHEN persistent_gap THEN 'PERSISTENT_FUND_PROGRESS_REVIEW' ELSE 'CURRENT_LARGE_POSITIVE_FUND_GAP' END, least(100, s3) FROM fund JOIN wide USING (work_id) WHERE current_large_gap OR persistent_gap
      UNION ALL SELECT work_id, 'DETERMINISTIC_NON_COMPLIANCE', rule_id, 100.0 FROM rule WHERE result = 'NON_COMPLIANT'
      UNION ALL SELECT work_id, 'COMPLIANCE_REVIEW', rid, s5 FROM (SELECT work_id, arg_min(rule_id, (CASE severity WHEN 'STRONG_WARNING' THEN 0 ELSE 1 END, rule_id)) AS rid FROM rule WHERE result = 'REVIEW' GROUP BY work_id) JOIN wide USING (work_id)""",
    "v2f": f"""SELECT p.work_id, p.lifecycle, coalesce(odd, 0) AS v0, coalesce(dev, 0) AS v1, CASE WHEN p.work_id % 97 = 0 THEN 90.0 + p.work_id % 10 ELSE 0 END AS v2, coalesce(fund_gap, 0) AS gap, coalesce(serving, 0) AS v6,
        coalesce(final_spend > sanctioned, false) AS f1, coalesce(p.lifecycle = 'EXECUTION' AND overdue_days > 0, false) AS f2, p.work_id IN (SELECT work_id FROM sig WHERE signal_code = 'PAYMENT_AUTH_BEFORE_REQUEST') AS f3, sanctioned_on IS NOT NULL AND released_total > sanctioned AS f4,
        p.lifecycle = 'EXECUTION' AND p.work_id NOT IN (SELECT work_id FROM prog WHERE work_id IS NOT NULL AND date_trunc('month', report_date) = date_trunc('month', {EVENTS_AS_OF})) AS f5, false AS f6, p.lifecycle = 'COMPLETION' AND NOT (coalesce(any_public_use, false) AND coalesce(any_handover, false) AND coalesce(any_certificate, false)) AS f7, p.work_id % 97 = 0 AS f8
      FROM p LEFT JOIN odd USING (work_id) LEFT JOIN sv USING (work_id) LEFT JOIN fund USING (work_id) LEFT JOIN (SELECT work_id, any_public_use, any_handover, any_certificate FROM asum) x USING (work_id) LEFT JOIN (SELECT work_id, {pct('max_deviation', '', 'true', True)} AS dev FROM psum) z USING (work_id)""",
    "v2s": "SELECT *, greatest(CASE WHEN f3 THEN 80.0 ELSE 0 END, least(100.0, greatest(0.0, gap / 75 * 100))) AS v3, CASE WHEN f1 THEN 100.0 WHEN f2 THEN 80.0 WHEN f4 THEN 75.0 ELSE 0 END AS v4, CASE WHEN f7 THEN 80.0 ELSE 0 END AS v5 FROM v2f",
    "v2p": "SELECT work_id, lifecycle, f1 OR f2 OR f3 OR f4 OR f5 OR f6 OR f7 OR f8 AS requires_review, least(100.0, round(CASE lifecycle " + " ".join(f"WHEN '{stage}' THEN " + " + ".join(f"round(v{i} * {w[f]} / 100, 6)" for i, f in enumerate(FAMILIES) if f in w) for stage, w in WEIGHTS_V2.items()) + " END, 6)) AS score FROM v2s",
    "lab": "SELECT doc_id AS work_id, quality AS label, doc_id * 7919 % 1000 / 1000.0 AS score, CASE WHEN toxic = 1 THEN 'A' ELSE 'B' END AS model FROM labels",
    "served0": "SELECT *, round(least(100.0::DOUBLE, coalesce(spend_ratio, 0) * 20), 4) AS score FROM p",
    "served": "SELECT *, CASE WHEN score < 25 THEN 'LOW' WHEN score < 50 THEN 'MEDIUM' WHEN score < 75 THEN 'HIGH' ELSE 'CRITICAL' END AS band FROM served0",
}
ORDER = {name: i for i, name in enumerate(CTES)}


def extend(more: dict[str, str]) -> None:
    """Adds table expressions, which may build on those before them."""
    CTES.update(more)
    ORDER.update({name: i for i, name in enumerate(CTES)})


def using(body: str) -> str:
    """The body with the expressions that it needs, directly or through others."""
    import re

    words = {name: set(re.findall(r"\b\w+\b", text)) & set(CTES) - {name} for name, text in CTES.items()}
    need, todo = set(), list(set(re.findall(r"\b\w+\b", body)) & set(CTES))
    while todo:
        name = todo.pop()
        if name not in need:
            need.add(name)
            todo += [x for x in words[name] if ORDER[x] < ORDER[name]]
    listed = ", ".join(f"{n} AS ({CTES[n]})" for n in sorted(need, key=ORDER.get))
    return f"WITH RECURSIVE {listed} {body}" if need else body


KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"]}
LINKS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey")]
#: The detectors of hotspots and their conditions; the last one has no share.
HOT = [
    ("top_anomaly", "odd >= 90"),
    ("duplicate_review", "work_id % 97 = 0"),
    ("payment_evidence", "n_sig > 0"),
    ("persistent_gap", "persistent_gap"),
    ("overdue", "overdue_days > 0"),
    ("over_sanction", "overrun > 0"),
    ("compliance_review", "reviews_ > 0"),
    ("non_compliant", "fails_ > 0"),
]
BODIES = {
    "dq_primary_keys": " UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST(sum(n) AS BIGINT) AS row_count, CAST(coalesce(sum(n) FILTER ({' OR '.join(f'{c} IS NULL' for c in k)}), 0) AS BIGINT) AS null_keys, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS repeated_rows, CAST(coalesce(sum(n - 1) FILTER (n > 1), 0) AS BIGINT) AS extra_rows FROM (SELECT {', '.join(k)}, count(*) AS n FROM {t} GROUP BY ALL)" for t, k in KEYS.items()),
    "dq_foreign_keys": " UNION ALL ".join(f"SELECT '{c}.{k}' AS relationship, count(*) AS total, count(*) FILTER (c.{k} IS NULL) AS null_keys, count(*) FILTER (x.id IS NOT NULL) AS matched, count(*) FILTER (c.{k} IS NOT NULL AND x.id IS NULL) AS orphans, CASE WHEN count(*) FILTER (c.{k} IS NOT NULL AND x.id IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM {c} c LEFT JOIN (SELECT DISTINCT {pk} AS id FROM {p}) x ON c.{k} = x.id" for c, k, p, pk in LINKS),
    "dq_orphans": "SELECT 'ORPHAN_FOREIGN_KEY' AS issue_code, 'ERROR' AS severity, 'labels' AS table_name, doc_id::VARCHAR AS record_id, doc_id::VARCHAR AS work_id, doc_id::VARCHAR AS observed FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)",
    "dq_fk_type": "SELECT 'FOREIGN_KEY_UNEXPECTED_ENTITY_TYPE' AS issue_code, l_suppkey::VARCHAR AS observed, count(*) AS issues FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey >= 20 GROUP BY l_suppkey",
    "dq_ranges": "SELECT 'VALUE_OUT_OF_RANGE' AS issue_code, progress_id::VARCHAR AS record_id, work_id::VARCHAR AS work_id, 'physical' AS observed FROM prog WHERE NOT coalesce(physical BETWEEN 0 AND 90, false) UNION ALL SELECT 'VALUE_OUT_OF_RANGE', progress_id::VARCHAR, work_id::VARCHAR, 'financial' FROM prog WHERE NOT coalesce(financial BETWEEN 1 AND 98, false)",
    "dq_chronology": "SELECT issue_code, 'WARNING' AS severity, count(*) AS issues, count(DISTINCT work_id) AS works FROM (SELECT work_id, 'PAYMENT_AUTH_BEFORE_REQUEST' AS issue_code FROM pay WHERE authorized_on < requested_on UNION ALL SELECT work_id, 'PAYMENT_RELEASE_BEFORE_AUTH' FROM pay WHERE released_on < authorized_on UNION ALL SELECT work_id, 'PAYMENT_BEFORE_RECOMMENDATION' FROM pay JOIN w USING (work_id) WHERE released_on < recommended_on UNION ALL SELECT work_id, 'PAYMENT_BEFORE_SANCTION' FROM pay JOIN w USING (work_id) WHERE released_on < sanctioned_on) GROUP BY issue_code",
    "dq_future_events": " UNION ALL ".join(f"SELECT 'FUTURE_ACTUAL_EVENT' AS issue_code, asset_id AS record_id, '{c}' AS observed FROM ast WHERE {c} > {AS_OF}" for c in ("completed_on", "public_use_on", "handover_on", "certificate_on")),
    "dq_sequence_decrease": "SELECT 'PROGRESS_DECREASE' AS issue_code, 'WARNING' AS severity, progress_id::VARCHAR AS record_id, work_id::VARCHAR AS work_id FROM (SELECT *, physical - lag(physical) OVER (PARTITION BY work_id ORDER BY report_date, progress_id) AS c FROM prog) WHERE c < 0",
    "dq_duplicate_report_date": "SELECT 'DUPLICATE_WORK_REPORT_DATE' AS issue_code, progress_id::VARCHAR AS record_id, work_id::VARCHAR AS work_id FROM (SELECT *, row_number() OVER (PARTITION BY work_id, report_date ORDER BY progress_id) AS n FROM prog) WHERE n > 1",
    "dq_financial_over_100": "SELECT 'FINANCIAL_PROGRESS_OVER_100' AS issue_code, 'WARNING' AS severity, event_id::VARCHAR AS record_id, user_id::VARCHAR AS work_id FROM events WHERE value > 100",
    "dq_negative_money": "SELECT 'NEGATIVE_MONETARY_VALUE' AS issue_code, table_name, record_id, observed FROM (SELECT 'mp' AS table_name, c_custkey::VARCHAR AS record_id, 'c_acctbal' AS observed, c_acctbal AS v FROM customer UNION ALL SELECT 'entities', s_suppkey::VARCHAR, 's_acctbal', s_acctbal FROM supplier UNION ALL SELECT 'works', work_id::VARCHAR, 'sanctioned', sanctioned FROM w UNION ALL SELECT 'payments', payment_id, 'amount', amount FROM pay UNION ALL SELECT 'assets', asset_id, 'final_spend', final_spend FROM ast) WHERE v < 0",
    "dq_progress_after_completion": "SELECT 'PROGRESS_AFTER_COMPLETION' AS issue_code, 'WARNING' AS severity, progress_id::VARCHAR AS record_id, work_id::VARCHAR AS work_id, c::VARCHAR AS observed FROM prog JOIN (SELECT work_id, max(completed_on) AS c FROM ast GROUP BY work_id) USING (work_id) WHERE report_date > c",
    "dq_asset_date_order": "SELECT 'ASSET_DATE_ORDER_INCONSISTENCY' AS issue_code, asset_id AS record_id, work_id::VARCHAR AS work_id, observed FROM (SELECT asset_id, work_id, completed_on, unnest(['marked_on', 'certificate_on', 'handover_on', 'public_use_on']) AS observed, unnest([marked_on, certificate_on, handover_on, public_use_on]) AS v FROM ast) WHERE v < completed_on",
    "dq_zero_released": "SELECT count(*) AS payments, count(*) FILTER (is_released) AS released, count(*) FILTER (is_released AND amount = 0) AS issues FROM pay",
    "dq_cumulative_mismatch": "SELECT 'PAYMENT_CUMULATIVE_MISMATCH' AS issue_code, work_id::VARCHAR AS work_id, count(*) AS issues FROM (SELECT work_id, sum(amount) OVER (PARTITION BY work_id ORDER BY stage, payment_id ROWS UNBOUNDED PRECEDING) AS told, sum(amount) OVER (PARTITION BY work_id ORDER BY released_on, stage, payment_id ROWS UNBOUNDED PRECEDING) AS made FROM pay) WHERE told IS DISTINCT FROM made GROUP BY work_id",
    "dq_labels": "SELECT 'NULL_LABEL_KEY' AS issue_code, count(*) FILTER (doc_id IS NULL) AS issues FROM labels UNION ALL SELECT 'DUPLICATE_LABEL', count(doc_id) - count(DISTINCT doc_id) FROM labels UNION ALL SELECT 'ORPHAN_LABEL', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL) UNION ALL SELECT 'INVALID_QUALITY', count(*) FROM labels WHERE coalesce(quality NOT IN (0, 1), true) UNION ALL SELECT 'INVALID_TOXIC', count(*) FROM labels WHERE coalesce(toxic NOT IN (0, 1), true)",
    "dq_severity_counts": "SELECT 'ERROR' AS severity, count(*) FILTER (coalesce(physical NOT BETWEEN 0 AND 90, true)) AS issues FROM prog UNION ALL SELECT 'WARNING', count(*) FROM (SELECT physical - lag(physical) OVER (PARTITION BY work_id ORDER BY report_date, progress_id) AS c FROM prog) WHERE c < 0 UNION ALL SELECT 'INFO', 0",
    "dq_feature_contract": "SELECT unnest(['REPEATED_KEY', 'MISSING_KEY', 'UNEXPECTED_KEY', 'UNDECLARED_COLUMN', 'MISSING_COLUMN', 'LABEL_COLUMN']) AS rule, unnest([(SELECT count(*) - count(DISTINCT work_id) FROM p), (SELECT count(*) FROM w WHERE recommended_on <= DATE '1998-12-31' AND work_id NOT IN (SELECT work_id FROM p)), (SELECT count(*) FROM p WHERE work_id NOT IN (SELECT work_id FROM w)), 0, 0, 0]) AS violations",
    "policy_v2_scores": "SELECT work_id, lifecycle, requires_review, round(score, 3) AS score, CASE WHEN score < 25 THEN 'LOW' WHEN score < 50 THEN 'MEDIUM' WHEN score < 75 THEN 'HIGH' ELSE 'CRITICAL' END AS band FROM v2p",
    "policy_v2_alerts": "SELECT concat('V2-', work_id, '-', alert_type) AS alert_id, work_id, alert_type FROM (" + " UNION ALL ".join(f"SELECT work_id, '{a}' AS alert_type FROM v2f WHERE f{i}" for i, a in enumerate(ALERTS_V2, 1)) + ")",
    "dq_duplicate_reference": "SELECT work_id::VARCHAR AS work_id, count(*) AS issues FROM (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY released_on, stage, payment_id) AS n FROM pay WHERE reference IS NOT NULL) WHERE n > 1 GROUP BY work_id",
    "dq_total_mismatch": "SELECT work_id, sanctioned AS reported, paid FROM w JOIN (SELECT work_id, CAST(sum(amount) AS BIGINT) AS paid FROM pay GROUP BY work_id) USING (work_id) WHERE paid <> sanctioned",
    "dq_running_total": "SELECT work_id, CAST(max(c) AS BIGINT) AS final_total, CAST(sum(c) AS BIGINT) AS sum_of_totals, count(*) AS payments FROM (SELECT work_id, sum(amount) OVER (PARTITION BY work_id ORDER BY released_on, stage, payment_id ROWS UNBOUNDED PRECEDING) AS c FROM pay) GROUP BY work_id",
    "dq_cardinality_profile": "SELECT count(*) FILTER (n = 0) AS with_none, count(*) FILTER (n = 1) AS with_one, count(*) FILTER (n > 1) AS with_many, min(n) AS minimum, quantile_cont(n::DOUBLE, 0.5) AS median, avg(n) AS mean, max(n) AS maximum FROM (SELECT w.work_id, count(pay.work_id) AS n FROM w LEFT JOIN pay ON w.work_id = pay.work_id GROUP BY w.work_id)",
    "dq_status_inconsistency": "SELECT work_id, status, coalesce(a, 0) AS payments, coalesce(b, 0) AS reports, coalesce(c, 0)::BIGINT AS spent FROM w LEFT JOIN (SELECT work_id, count(*) AS a, sum(amount) AS c FROM pay WHERE is_released GROUP BY work_id) USING (work_id) LEFT JOIN (SELECT l_orderkey AS work_id, count(*) AS b FROM lineitem WHERE l_quantity * 2 > 0 OR floor(l_discount * 1000 + 0.5) > 0 GROUP BY 1) USING (work_id) WHERE status = 'P' AND (a > 0 OR b > 0 OR c > 0)",
    "dq_progress_chronology": "SELECT issue_code, 'WARNING' AS severity, count(*) AS issues, count(DISTINCT work_id) AS works FROM (SELECT work_id, 'PROGRESS_BEFORE_RECOMMENDATION' AS issue_code FROM ev_r JOIN w USING (work_id) WHERE report_date < recommended_on UNION ALL SELECT work_id, 'PROGRESS_BEFORE_SANCTION' FROM ev_r JOIN w USING (work_id) WHERE report_date < sanctioned_on) GROUP BY issue_code",
    "dq_required_keys": "SELECT 'NULL_REGISTER_AFTER_HANDOVER' AS issue_code, asset_id AS record_id, work_id::VARCHAR AS work_id, 'register_entry' AS observed FROM ast WHERE register_entry IS NULL AND handover_on IS NOT NULL UNION ALL SELECT 'NULL_CERTIFICATE_DATE', asset_id, work_id::VARCHAR, 'certificate_on' FROM ast WHERE certificate_on IS NULL AND certificate_status = 'Submitted' UNION ALL SELECT 'NULL_PUBLIC_USE', asset_id, work_id::VARCHAR, 'public_use_on' FROM ast WHERE public_use_on IS NULL AND handover_on IS NOT NULL AND register_entry = 'Yes'",
    "dq_value_contract": f"SELECT unnest(['INFINITE_VALUE', 'RATIO_NULLNESS', 'FUTURE_DATE', 'PAYMENTS_DONT_RECONCILE', 'COMPLETION_MISMATCH']) AS rule, unnest([0, (SELECT count(*) FILTER (planned_days <= 0 AND schedule_ratio IS NOT NULL) FROM p), (SELECT count(*) FILTER (recommended_on > {AS_OF}) + count(*) FILTER (sanctioned_on > {AS_OF}) + count(*) FILTER (expected_on > {AS_OF}) + count(*) FILTER (completed_on > {AS_OF}) FROM p), 0, 0]) AS violations",
    "dq_issue_summary": "SELECT severity, issue_code, count(*) AS issues, count(DISTINCT work_id) AS works FROM (SELECT work_id, 'PAYMENT_AUTH_BEFORE_REQUEST' AS issue_code, 'WARNING' AS severity FROM pay WHERE authorized_on < requested_on UNION ALL SELECT work_id, 'PAYMENT_RELEASE_BEFORE_AUTH', 'WARNING' FROM pay WHERE released_on < authorized_on UNION ALL SELECT work_id, 'PROGRESS_DECREASE', 'WARNING' FROM (SELECT *, physical - lag(physical) OVER (PARTITION BY work_id ORDER BY report_date, progress_id) AS c FROM prog) WHERE c < 0 UNION ALL SELECT work_id, 'VALUE_OUT_OF_RANGE', 'ERROR' FROM prog WHERE NOT coalesce(physical BETWEEN 0 AND 90, false)) GROUP BY ALL",
    "payments_as_of": "SELECT work_id, payment_count, released_total, vendor_count, largest_payment, first_payment_on, last_payment_on, final_payment_count, zero_payment_count, round(largest_share, 6) AS largest_share, round(vendor_hhi, 6) AS vendor_hhi, CAST(days_since_payment AS INTEGER) AS days_since_payment FROM paid JOIN hhi USING (work_id)",
    "progress_as_of": "SELECT work_id, report_count, first_report_on, last_report_on, first_physical, last_physical, last_financial, decrease_count, round(largest_decrease, 4) AS largest_decrease, same_day_extras, round(last_financial - last_physical, 4) AS financial_gap, CAST(days_since_report AS INTEGER) AS days_since_report, CASE WHEN last_report_on > first_report_on THEN round((last_physical - first_physical) / (last_report_on - first_report_on) * 30, 4) END AS velocity FROM latest",
    "asset_mask_as_of": "SELECT * FROM asum",
    "work_profile": "SELECT work_id, mp_id, state, district, sector, sub_sector, status, lifecycle, sanctioned, recommended_on, sanctioned_on, expected_on, payment_count, released_total, vendor_count, round(largest_share, 6) AS largest_share, round(vendor_hhi, 6) AS vendor_hhi, CAST(days_since_payment AS INTEGER) AS days_since_payment, final_payment_count, zero_payment_count, asset_count, completed_on, final_spend, round(spend_ratio, 6) AS spend_ratio, overrun, round(overrun_pct, 6) AS overrun_pct, CAST(overdue_days AS INTEGER) AS overdue_days, CAST(sanction_days AS INTEGER) AS sanction_days, CAST(planned_days AS INTEGER) AS planned_days, round(schedule_ratio, 6) AS schedule_ratio FROM p",
    "feature_quality": " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) FILTER (v IS NOT NULL) AS BIGINT) AS non_null, count(v) AS distinct_values, round(min(v), 4) AS minimum, round(max(v), 4) AS maximum, round(max(n) FILTER (v IS NOT NULL)::DOUBLE / sum(n) FILTER (v IS NOT NULL), 6) AS dominant_share, round(1 - sum(n) FILTER (v IS NOT NULL)::DOUBLE / sum(n), 6) AS null_share FROM (SELECT {c}::DOUBLE AS v, count(*) AS n FROM p GROUP BY ALL)" for c in ("released_total", "spend_ratio", "vendor_hhi", "payment_count", "planned_days")),
    "feature_selection": " UNION ALL ".join(f"SELECT lifecycle, '{c}' AS feature, CAST(coalesce(sum(n) FILTER (v IS NOT NULL), 0) AS BIGINT) AS non_null, CASE WHEN coalesce(sum(n) FILTER (v IS NOT NULL), 0) = 0 THEN 'INAPPLICABLE' WHEN 1 - sum(n) FILTER (v IS NOT NULL)::DOUBLE / sum(n) > 0.5 THEN 'MISSING' WHEN count(v) <= 1 THEN 'ZERO_VARIANCE' WHEN max(n) FILTER (v IS NOT NULL)::DOUBLE / sum(n) FILTER (v IS NOT NULL) >= 0.99 THEN 'NEAR_ZERO_VARIANCE' ELSE 'SELECTED' END AS reason FROM (SELECT lifecycle, {c}::DOUBLE AS v, count(*) AS n FROM p GROUP BY ALL) GROUP BY lifecycle" for c in ("released_total", "spend_ratio", "vendor_hhi", "payment_count", "planned_days", "overdue_days", "asset_count")),
    "peer_stats": "SELECT lifecycle, sector, metric, count(value) AS n, " + ", ".join(f"round(quantile_cont(value, {q}), 3) AS {n}" for n, q in (("p10", 0.1), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("p90", 0.9))) + ", round(mad(value), 3) AS mad, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 3) AS iqr FROM pl GROUP BY lifecycle, sector, metric",
    "peer_hierarchy": "SELECT work_id, metric, level, n AS peers, round(median, 2) AS median, round(deviation, 4) AS deviation, method FROM pe",
    "peer_summary": "SELECT work_id, lifecycle, usable_metrics, outlier_count, round(max_deviation, 4) AS max_deviation FROM psum",
    "sector_deviation": "SELECT work_id, p.sector, CASE WHEN m > 0 THEN round((released_total - med) / (1.4826 * m), 4) END AS deviation FROM p JOIN (SELECT sector, quantile_cont(released_total::DOUBLE, 0.5) AS med, mad(released_total::DOUBLE) AS m FROM p GROUP BY sector) USING (sector)".replace("p.sector", "sector"),
    "stage_percentile": f"SELECT work_id, lifecycle, round({pct('payment_count', 'lifecycle')}, 6) AS pct FROM p",
    "inclusive_percentile": f"SELECT work_id, lifecycle, round({pct('payment_count', 'lifecycle', inclusive=True)}, 6) AS pct FROM p",
    "vector_topk_pairs": "SELECT a, b, round(max(cosine), 4) AS cosine FROM (SELECT least(x, y) AS a, greatest(x, y) AS b, cosine FROM (SELECT a.vec_id AS x, b.vec_id AS y, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS n FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE n <= 10) GROUP BY a, b",
    "payment_signals": "SELECT work_id, signal_code, severity, count(*) AS signals FROM sigs GROUP BY ALL",
    "payment_signal_summary": "SELECT p.work_id, " + ", ".join(f"count(*) FILTER (signal_code = '{c}') AS {c.lower()}_count" for c in PAYMENT_SIGNALS) + ", count(signal_code) AS signal_count, count(signal_code) > 0 AS has_signal FROM p LEFT JOIN sigs ON p.work_id = sigs.work_id GROUP BY p.work_id",
    "gap_runs": "SELECT work_id, reports, round(latest_gap, 4) AS latest_gap, round(largest_gap, 4) AS largest_gap, positive_gaps, flagged, longest_run, latest_run FROM runs",
    "fund_progress": "SELECT work_id, round(paid_pct, 4) AS paid_pct, round(fund_gap, 4) AS fund_gap, round(reported_gap, 4) AS reported_gap, round(reconciliation, 4) AS reconciliation, current_large_gap, persistent_gap FROM fund",
    "rule_evidence": "SELECT * FROM rule",
    "rule_summary": "SELECT work_id, " + ", ".join(f"count(*) FILTER (result = '{r}') AS {r.lower()}_count" for r in ("NON_COMPLIANT", "REVIEW", "INSUFFICIENT_EVIDENCE", "PASS", "NOT_APPLICABLE")) + ", arg_min(rule_id, (list_position(['NON_COMPLIANT', 'REVIEW', 'INSUFFICIENT_EVIDENCE', 'PASS', 'NOT_APPLICABLE'], result), list_position(['STRONG_WARNING', 'WARNING', 'INFO'], severity), rule_id)) AS top_rule, count(*) FILTER (result IN ('PASS', 'REVIEW', 'NON_COMPLIANT')) AS evaluated_count FROM rule GROUP BY work_id",
    "record_status": "SELECT *, public_use = 'NOT_RECORDED' OR handover = 'NOT_RECORDED' OR certificate = 'NOT_RECORDED' AS closure_requires_review FROM (SELECT p.work_id, lifecycle, " + ", ".join(f"CASE WHEN lifecycle <> 'COMPLETION' THEN 'NOT_APPLICABLE' WHEN any_{c} THEN 'RECORDED' ELSE 'NOT_RECORDED' END AS {c}" for c in ("public_use", "handover", "certificate")) + " FROM p LEFT JOIN asum ON p.work_id = asum.work_id)",
    "landmark_snapshots": """SELECT w.work_id, f AS fraction, CAST(epoch(w.sanctioned_on) + floor(f * 86400 * (expected_on - w.sanctioned_on)) AS BIGINT) AS landmark_s, count(*) FILTER (epoch(released_on) <= epoch(w.sanctioned_on) + f * 86400 * (expected_on - w.sanctioned_on)) AS payment_count,
        CAST(coalesce(sum(amount) FILTER (epoch(released_on) <= epoch(w.sanctioned_on) + f * 86400 * (expected_on - w.sanctioned_on)), 0) AS BIGINT) AS released_total,
        round(coalesce(sum(amount) FILTER (epoch(released_on) <= epoch(w.sanctioned_on) + f * 86400 * (expected_on - w.sanctioned_on)), 0)::DOUBLE / w.sanctioned, 6) AS spend_ratio
      FROM w CROSS JOIN (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS f) LEFT JOIN (SELECT * FROM pay WHERE is_released) y ON w.work_id = y.work_id WHERE w.sanctioned_on < expected_on GROUP BY w.work_id, f, w.sanctioned_on, expected_on, w.sanctioned""",
    "work_outcomes": "SELECT p.work_id, max(vis.completed_on) AS finished_on, CASE WHEN bool_and(vis.final_spend IS NOT NULL) THEN CAST(sum(vis.final_spend) AS BIGINT) END AS final_spend, (max(vis.completed_on) > expected_on)::INTEGER AS delayed, CASE WHEN bool_and(vis.final_spend IS NOT NULL) AND sanctioned > 0 THEN (sum(vis.final_spend) > sanctioned)::INTEGER END AS overran FROM p JOIN vis ON p.work_id = vis.work_id WHERE lifecycle = 'COMPLETION' GROUP BY p.work_id, expected_on, sanctioned",
    "feasibility": "SELECT count(*) FILTER (o = 1) AS positives, count(*) FILTER (o = 0) AS negatives, count(*) FILTER (o = 1) >= 50 AND count(*) FILTER (o = 0) >= 50 AS feasible FROM (SELECT p.work_id, CASE WHEN bool_and(vis.final_spend IS NOT NULL) AND sanctioned > 0 THEN (sum(vis.final_spend) > sanctioned)::INTEGER END AS o FROM p JOIN vis ON p.work_id = vis.work_id WHERE lifecycle = 'COMPLETION' GROUP BY p.work_id, sanctioned)",
    "ranking_metrics": """SELECT model, rows, round(brier, 6) AS brier, round(prevalence, 6) AS prevalence, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM
        (SELECT model, count(*) AS rows, avg((score - label) * (score - label)) AS brier, avg(label) AS prevalence FROM lab GROUP BY model)
        JOIN (SELECT model, (sum(r) FILTER (label = 1) - p * (p + 1) / 2.0) / (p * q) AS roc_auc FROM (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r, count(*) FILTER (label = 1) OVER (PARTITION BY model) AS p, count(*) FILTER (label = 0) OVER (PARTITION BY model) AS q FROM lab) GROUP BY model, p, q) USING (model)
        JOIN (SELECT model, sum(tp::DOUBLE / n * d) / max(tp) AS average_precision FROM (SELECT model, score, sum(sum(label)) OVER v AS tp, sum(count(*)) OVER v AS n, sum(label) AS d FROM lab GROUP BY model, score WINDOW v AS (PARTITION BY model ORDER BY score DESC)) GROUP BY model) USING (model)""".replace(" p * (p + 1)", " np * (np + 1)").replace("(p * q)", "(np * nq)").replace("AS p, count", "AS np, count").replace("AS q FROM", "AS nq FROM").replace("GROUP BY model, p, q", "GROUP BY model, np, nq"),
    "calibration_error": "SELECT round(sum(n * abs(pp - y)) / sum(n), 6) AS calibration_error, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT count(*) AS n, avg(score) AS pp, avg(label) AS y FROM lab GROUP BY least(floor(score * 10), 9))",
    "top_fraction": "SELECT f::DOUBLE AS fraction, count(*) FILTER (pl_ <= greatest(1, ceil(n * f))) AS selected, CAST(coalesce(sum(label) FILTER (pl_ <= greatest(1, ceil(n * f))), 0) AS BIGINT) AS hits, CAST(sum(label) AS BIGINT) AS positives, round(coalesce(sum(label) FILTER (pl_ <= greatest(1, ceil(n * f))), 0)::DOUBLE / count(*) FILTER (pl_ <= greatest(1, ceil(n * f))), 6) AS precision, round(coalesce(sum(label) FILTER (pl_ <= greatest(1, ceil(n * f))), 0)::DOUBLE / sum(label), 6) AS recall FROM (SELECT label, row_number() OVER (ORDER BY score DESC, work_id) AS pl_, count(*) OVER () AS n FROM lab), (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE, 0.10::DOUBLE]) AS f) GROUP BY f",
    "threshold_search": "SELECT round(0.15 + k * 0.01, 4) AS threshold, round(f1, 6) AS f1 FROM (SELECT k, 2.0 * sum(label) FILTER (b >= k) / (count(*) FILTER (b >= k) + sum(label)) AS f1 FROM (SELECT label, least(floor((score - 0.15) / 0.01 + 1e-9), 70) AS b FROM lab), (SELECT unnest(range(71)) AS k) GROUP BY k) ORDER BY 2 DESC, 1 LIMIT 1",
    "serving_rank": "SELECT work_id, lifecycle, round(serving, 6) AS serving_percentile, CASE WHEN spend_ratio IS NOT NULL AND lifecycle = 'EXECUTION' THEN (row_number() OVER (PARTITION BY lifecycle ORDER BY spend_ratio DESC, work_id))::INTEGER END AS serving_rank FROM p JOIN sv USING (work_id)",
    "monthly_dense": "SELECT * FROM dense",
    "monthly_causal_z": "SELECT group_type, group_value, metric, month, CAST(baseline_months AS INTEGER) AS baseline_months, support, round(median, 2) AS median, round(mad, 2) AS mad, round(robust_z, 4) AS robust_z, method, status, coalesce(abs(robust_z) >= 3.5, false) AS flagged FROM base",
    "monthly_ewma": "SELECT group_value, metric, month, round(list_reduce(list(value::DOUBLE) OVER (PARTITION BY group_value, metric ORDER BY month), lambda a, x: 0.7 * a + 0.3 * x), 2) AS ewma FROM dense WHERE group_type = 'STATE'",
    "trend_alerts": "SELECT group_type, group_value, metric, month, metric || ' of ' || group_value || ' in ' || strftime(month, '%Y-%m') || ' is ' || CASE WHEN robust_z > 0 THEN 'above' ELSE 'below' END || ' its causal baseline' AS message FROM base WHERE abs(robust_z) >= 3.5",
    "hotspots": "SELECT *, " + ", ".join(f"round({n}_count::DOUBLE / works, 6) AS {n}_share" for n, _ in HOT[:-1]) + " FROM (SELECT group_type, group_value, count(*) AS works, " + ", ".join(f"count(*) FILTER ({test}) AS {n}_count" for n, test in HOT) + """ FROM (SELECT p.*, odd, n_sig, persistent_gap, reviews_, fails_, unnest(['STATE', 'DISTRICT', 'SECTOR', 'DISTRICT_SECTOR']) AS group_type, unnest(['state=' || state, 'state=' || state || '|district=' || district, 'sector=' || sector, 'state=' || state || '|district=' || district || '|sector=' || sector]) AS group_value
      FROM p LEFT JOIN odd USING (work_id) LEFT JOIN (SELECT work_id, count(*) AS n_sig FROM sigs GROUP BY work_id) USING (work_id) LEFT JOIN (SELECT work_id, persistent_gap FROM fund) USING (work_id) LEFT JOIN (SELECT work_id, count(*) FILTER (result = 'REVIEW') AS reviews_, count(*) FILTER (result = 'NON_COMPLIANT') AS fails_ FROM rule GROUP BY work_id) USING (work_id)) GROUP BY group_type, group_value HAVING count(*) >= 20)""",
    "trend_context": "SELECT work_id, trend_group, trend_metric, round(trend_z, 4) AS trend_z, trend_flagged, round(trend_strength, 4) AS trend_strength FROM ctx",
    "policy_contributions": "SELECT work_id, lifecycle, family, round(score, 4) AS score, code, available, weight, round(points, 3) AS points FROM contrib",
    "policy_scores": "SELECT work_id, lifecycle, round(score, 3) AS score, coverage, band, top_family_1, row_number() OVER (ORDER BY score DESC, work_id) AS rank, row_number() OVER (PARTITION BY lifecycle ORDER BY score DESC, work_id) AS rank_in_stage FROM scores",
    "policy_alerts": "SELECT work_id, alert_type, evidence_code, round(strength, 3)::DOUBLE AS strength FROM alerts",
    "policy_authority_summary": " UNION ALL ".join(f"SELECT '{t}' AS group_type, {v} AS group_value, count(*) AS works, round(round(avg(score), 4), 2) AS mean_score, count(*) FILTER (band = 'HIGH') AS high, count(*) FILTER (band = 'CRITICAL') AS critical FROM scores JOIN (SELECT work_id, state, district, sector FROM p) USING (work_id) GROUP BY {v}" for t, v in (("STATE", "state"), ("DISTRICT", "concat_ws(' / ', state, district)"), ("SECTOR", "sector"))),
    "working_days": "SELECT work_id, (list_filter(generate_series(date_trunc('month', recommended_on)::DATE, last_day(recommended_on), INTERVAL 1 DAY), lambda x: isodow(x) < 6))[3]::DATE AS third_working_day, (list_filter(generate_series(recommended_on + 1, recommended_on + 24, INTERVAL 1 DAY), lambda x: isodow(x) < 6))[5]::DATE AS fifth_after FROM w",
    "evidence_status": "SELECT work_id, CASE WHEN day(c) % 2 = 0 THEN CASE WHEN c <= DATE '2024-01-03' THEN 'RECORDED' ELSE 'OVERDUE' END ELSE 'OVERDUE' END AS monthly, CASE WHEN c IS NULL THEN 'NOT_APPLICABLE' WHEN l <= list_filter(generate_series(c + 1, c + 10, INTERVAL 1 DAY), lambda x: isodow(x) < 6)[3] THEN 'RECORDED' ELSE 'OVERDUE' END AS completion, c > DATE '2024-01-03' AS late FROM (SELECT work_id, min(report_date) AS c, max(report_date) AS l FROM prog GROUP BY work_id)",
    "haversine_pairs": "SELECT s_suppkey, round(m / 1000, 3) AS km, CASE WHEN m <= 500 THEN 'LOCATION_CONSISTENT' ELSE 'LOCATION_REQUIRES_REVIEW' END AS status FROM (SELECT a.s_suppkey, 2 * 6371000.0 * asin(sqrt(least(1.0, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) AS m FROM (SELECT s_suppkey, (s_suppkey * 37 % 160 - 80)::DOUBLE AS lat, (s_suppkey * 91 % 340 - 170)::DOUBLE AS lon FROM supplier) a JOIN (SELECT s_suppkey, (s_suppkey * 37 % 160 - 80)::DOUBLE AS lat, (s_suppkey * 91 % 340 - 170)::DOUBLE AS lon FROM supplier) b ON b.s_suppkey = a.s_suppkey + 1)",
    "scoped_queue": "SELECT work_id, district, sector, score, band FROM served WHERE state = 'ASIA' AND lifecycle = 'EXECUTION' AND contains(lower(concat_ws(' ', district, sector)), 'nation') ORDER BY score DESC, work_id LIMIT 25",
    "overview": "SELECT count(*) AS works, " + ", ".join(f"count(*) FILTER (band = '{b}') AS {b.lower()}" for b in ("LOW", "MEDIUM", "HIGH", "CRITICAL")) + ", " + ", ".join(f"count(*) FILTER (lifecycle = '{s}') AS {s.lower()}" for s in ("PRE_SANCTION", "EXECUTION", "COMPLETION")) + ", CAST(sum(sanctioned) AS BIGINT) AS sanctioned_total, CAST(sum(released_total) AS BIGINT) AS released_sum, round(count(*) FILTER (band IN ('HIGH', 'CRITICAL')) * 100.0::DOUBLE / count(*), 4) AS urgent_share, round(sum(released_total)::DOUBLE * 100 / sum(sanctioned)::DOUBLE, 4) AS utilisation FROM served",
    "comparison": "SELECT state AS group_value, count(*) AS works, count(*) FILTER (band IN ('HIGH', 'CRITICAL')) AS urgent, round(count(*) FILTER (band IN ('HIGH', 'CRITICAL')) * 100.0::DOUBLE / count(*), 1) AS urgent_rate, round(sum(released_total)::DOUBLE * 100 / sum(sanctioned)::DOUBLE, 1) AS utilisation FROM served GROUP BY state",
    "fund_flow": "SELECT *, round(released * 100.0::DOUBLE / sum(released) OVER (PARTITION BY fiscal_year), 4) AS share FROM (SELECT sector, CAST(year(released_on) - (month(released_on) < 4)::INTEGER AS INTEGER) AS fiscal_year, CAST(sum(amount) AS BIGINT) AS released, count(DISTINCT work_id) AS works FROM pay JOIN w USING (work_id) WHERE is_released GROUP BY ALL)",
    "precheck_costs": "SELECT work_id, sanctioned, level, round(m, 2) AS peer_median, round(q, 2) AS peer_q75, sanctioned > 1.25 * q AS high_cost FROM (SELECT w.*, CASE WHEN fn >= 5 THEN 'SUB_SECTOR' ELSE 'SECTOR' END AS level, CASE WHEN fn >= 5 THEN fm ELSE cm END AS m, CASE WHEN fn >= 5 THEN fq ELSE cq END AS q FROM w JOIN (SELECT sector, sub_sector, count(*) AS fn, quantile_cont(sanctioned::DOUBLE, 0.5) AS fm, quantile_cont(sanctioned::DOUBLE, 0.75) AS fq FROM w GROUP BY ALL) USING (sector, sub_sector) JOIN (SELECT sector, quantile_cont(sanctioned::DOUBLE, 0.5) AS cm, quantile_cont(sanctioned::DOUBLE, 0.75) AS cq FROM w GROUP BY ALL) USING (sector))",
    "work_dossier": "SELECT p.work_id, lifecycle, latest_payments, top_alerts FROM p LEFT JOIN (SELECT work_id, string_agg(payment_id || ':' || amount, ',' ORDER BY released_on DESC, payment_id) AS latest_payments FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY released_on DESC, payment_id) AS n FROM rel) WHERE n <= 10 GROUP BY work_id) x ON p.work_id = x.work_id LEFT JOIN (SELECT work_id, string_agg(signal_code, ',' ORDER BY signal_code) AS top_alerts FROM (SELECT work_id, signal_code, row_number() OVER (PARTITION BY work_id ORDER BY signal_code) AS n FROM (SELECT DISTINCT work_id, signal_code FROM sigs)) WHERE n <= 3 GROUP BY work_id) y ON p.work_id = y.work_id",
    "latest_status": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS records FROM events GROUP BY user_id",
    "retrieve_topk": "SELECT query_id, chunk_id, round(score, 4) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) DESC, b.vec_id) AS n FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE n <= 5",
    "evidence_select": "SELECT work_id, rule_id, place FROM (SELECT work_id, rule_id, CAST(row_number() OVER (PARTITION BY work_id ORDER BY result = 'NON_COMPLIANT' DESC, CASE WHEN result = 'REVIEW' THEN 2 ELSE 1 END DESC, rule_id) AS INTEGER) AS place FROM rule WHERE result <> 'NOT_APPLICABLE') WHERE place <= 4",
    "budget_trim": "SELECT doc_id, source, used FROM (SELECT doc_id, source, CAST(sum(length(text)) OVER (PARTITION BY source ORDER BY length(text), doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents) WHERE used <= 20000",
    "grounding_check": "SELECT doc_id AS id, 'UNKNOWN_EVIDENCE_CODES' AS fault FROM documents WHERE doc_id % 5 NOT IN (1, 2) OR lang <> 'en' UNION ALL SELECT doc_id, 'PROHIBITED_VERDICT_LANGUAGE' FROM documents WHERE doc_id % 10 = 0",
    "chapter_carry_forward": "SELECT source AS doc, doc_id AS page, last_value(nullif(regexp_extract(text, '^(Th[a-z]+)', 1), '') IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS chapter FROM documents",
}


#: Columns of the results that are dates; they come out as text.
OUTPUT_DATES = {
    "payments_as_of": ("first_payment_on", "last_payment_on"),
    "progress_as_of": ("first_report_on", "last_report_on"),
    "asset_mask_as_of": ("completed_on",),
    "work_profile": ("recommended_on", "sanctioned_on", "expected_on", "completed_on"),
    "work_outcomes": ("finished_on",),
    "monthly_dense": ("month",),
    "monthly_causal_z": ("month",),
    "monthly_ewma": ("month",),
    "trend_alerts": ("month",),
    "working_days": ("third_working_day", "fifth_after"),
}


def fixed(text: str) -> str:
    """round(x, n) as plain arithmetic, so that both engines round ties alike."""
    while (at := text.find("round(")) >= 0:
        depth, comma, i = 1, -1, at + 6
        while depth:
            depth += (text[i] in "([") - (text[i] in ")]")
            comma = i if text[i] == "," and depth == 1 else comma
            i += 1
        scale = f"1e{text[comma + 1 : i - 1].strip()}::DOUBLE"
        text = f"{text[:at]}(floor(({text[at + 6 : comma]}) * {scale} + 0.5) / {scale}){text[i:]}"
    return text


def all_sql(more: dict[str, str] | None = None) -> dict[str, str]:
    out = {}
    for name, body in (BODIES | (more or {})).items():
        body = f"SELECT * REPLACE ({', '.join(f'strftime({c}, $$%Y-%m-%d$$) AS {c}' for c in OUTPUT_DATES[name])}) FROM ({body})" if name in OUTPUT_DATES else body
        out[name] = fixed(using(body))
    return out
