"""Fusing evidence families into review-priority scores, ranks, queues and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksight.functions.scalar import band, fixed
from worksight.functions.stats import cumulated, percentile_exclusive
from worksight.operators.signals import TOTAL

# Evidence families in order, and their weights by lifecycle in percent.
FAMILIES = ("ANOMALY", "PEER_DEVIATION", "DUPLICATE_REVIEW", "PAYMENT_EXECUTION", "OBSERVED_CONDITIONS", "COMPLIANCE", "COST_OVERRUN_PREDICTION", "OPERATIONAL_TREND_CONTEXT")
WEIGHTS = {
    "PRE_SANCTION": {"ANOMALY": 30, "PEER_DEVIATION": 25, "DUPLICATE_REVIEW": 25, "OPERATIONAL_TREND_CONTEXT": 20},
    "EXECUTION": {"ANOMALY": 10, "PEER_DEVIATION": 10, "DUPLICATE_REVIEW": 15, "PAYMENT_EXECUTION": 25, "OBSERVED_CONDITIONS": 20, "COMPLIANCE": 10, "COST_OVERRUN_PREDICTION": 5, "OPERATIONAL_TREND_CONTEXT": 5},
    "COMPLETION": {"ANOMALY": 8, "PEER_DEVIATION": 7, "DUPLICATE_REVIEW": 15, "PAYMENT_EXECUTION": 20, "COMPLIANCE": 40, "OPERATIONAL_TREND_CONTEXT": 10},
}
#: The second profile; its weights before sanction sum to 80, as its policy has it.
WEIGHTS_V2 = {
    "PRE_SANCTION": {"ANOMALY": 30, "PEER_DEVIATION": 25, "DUPLICATE_REVIEW": 25},
    "EXECUTION": {"ANOMALY": 10, "PEER_DEVIATION": 10, "DUPLICATE_REVIEW": 15, "PAYMENT_EXECUTION": 25, "OBSERVED_CONDITIONS": 20, "COMPLIANCE": 10, "COST_OVERRUN_PREDICTION": 5},
    "COMPLETION": {"ANOMALY": 5, "PEER_DEVIATION": 5, "DUPLICATE_REVIEW": 10, "PAYMENT_EXECUTION": 10, "OBSERVED_CONDITIONS": 50, "COMPLIANCE": 20},
}
# Strength of a severity as a payment signal and as a rule result.
SEVERITY_SCORE = {"INFO": 25.0, "WARNING": 60.0, "STRONG_WARNING": 90.0}
REVIEW_SCORE = {"INFO": 30.0, "WARNING": 60.0, "STRONG_WARNING": 80.0}


def scored(column: str, scores: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for value, score in scores.items():
        out = F.when(F.col(column) == value, score).otherwise(out)
    return out


def among(df: DataFrame, keys: list[str], value: Column, where: Column, out: str) -> DataFrame:
    """Adds the exclusive percentile of value among the rows where a condition holds, else null."""
    df = df.withColumn("among__", F.when(F.coalesce(where, F.lit(False)), value.cast("double")))
    return percentile_exclusive(df, keys, "among__", out).drop("among__")


def payment_family(works: DataFrame, signals: DataFrame, funds: DataFrame) -> DataFrame:
    """work_id, payment_score, payment_code: the greater of severity and gap score, capped at 100."""
    usable = signals.where(F.col("signal_code") != TOTAL).withColumn("s", scored("severity", SEVERITY_SCORE))
    top = usable.groupBy("work_id").agg(F.max("s").alias("severity_score"), F.min_by("signal_code", F.struct(-F.col("s"), "signal_code")).alias("code"))
    rows = works.select("work_id").join(top, "work_id", "left").join(funds.select("work_id", "fund_gap", "persistent_gap"), "work_id", "left")
    rows = among(rows, [], F.col("fund_gap"), F.col("fund_gap") > 0, "gap_pct")
    keep = F.coalesce("persistent_gap", F.lit(False))
    gap = F.least(F.lit(100.0), F.coalesce("gap_pct", F.lit(0.0)) + F.when(keep, 10.0).otherwise(0.0))
    severity = F.coalesce("severity_score", F.lit(0.0))
    code = F.when((gap > 0) & keep, "PERSISTENT_FUND_PROGRESS_REVIEW").when(severity > gap, F.col("code")).when(gap > 0, "FUND_PROGRESS_REVIEW").otherwise("NO_PAYMENT_EXECUTION_SIGNAL")
    return rows.select("work_id", F.greatest(severity, gap).alias("payment_score"), code.alias("payment_code"), (F.col("fund_gap").isNotNull()).alias("payment_available"))


def observed_family(profile: DataFrame) -> DataFrame:
    """work_id, observed_score, observed_code of works in execution that are late or overspent."""
    execution = F.col("lifecycle") == "EXECUTION"
    rows = profile.select("work_id", "lifecycle", "overdue_days", "overrun_pct", (execution & (F.col("overdue_days") > 0)).alias("late"), (execution & (F.col("overrun_pct") > 0)).alias("over"))
    rows = among(among(rows, [], F.col("overdue_days"), F.col("late"), "late_pct"), [], F.col("overrun_pct"), F.col("over"), "over_pct")
    late, over = F.coalesce("late", F.lit(False)), F.coalesce("over", F.lit(False))
    score = F.greatest(F.when(late, 50 + 0.5 * F.col("late_pct")).otherwise(0.0), F.when(over, 75 + 0.25 * F.col("over_pct")).otherwise(0.0))
    code = F.when(late & over, "OBSERVED_OVERDUE_AND_OVER_SANCTION").when(over, "OBSERVED_OVER_SANCTION").when(late, "OBSERVED_OVERDUE").otherwise("NO_OBSERVED_CONDITION")
    return rows.select("work_id", score.alias("observed_score"), code.alias("observed_code"))


def compliance_family(evidence: DataFrame) -> DataFrame:
    """work_id, compliance_score, compliance_code: the strongest actionable rule result."""
    rows = evidence.withColumn("s", F.when(F.col("result") == "NON_COMPLIANT", 100.0).when(F.col("result") == "REVIEW", scored("severity", REVIEW_SCORE)).otherwise(-1.0))
    got = rows.groupBy("work_id").agg(F.max("s").alias("s"), F.min_by("rule_id", F.struct(-F.col("s"), "rule_id")).alias("rule"))
    return got.select("work_id", F.greatest("s", F.lit(0.0)).alias("compliance_score"), F.when(F.col("s") >= 0, F.col("rule")).otherwise("NO_ACTIONABLE_COMPLIANCE_RESULT").alias("compliance_code"))


def peer_family(summary: DataFrame) -> DataFrame:
    """work_id, peer_score, peer_code: percentile of the strongest deviation among outliers of a stage."""
    rows = among(summary, ["lifecycle"], F.col("max_deviation"), (F.col("outlier_count") > 0) & F.col("max_deviation").isNotNull(), "pct")
    out = F.col("outlier_count") > 0
    return rows.select("work_id", F.coalesce("pct", F.lit(0.0)).alias("peer_score"), F.when(out, "STATISTICAL_PEER_OUTLIER").otherwise("NO_STATISTICAL_PEER_OUTLIER").alias("peer_code"))


def duplicate_family(summary: DataFrame) -> DataFrame:
    """work_id, duplicate_score, duplicate_code: the best review candidate of a `pair_summary`; works outside it have none."""
    review = F.col("reviews") > 0
    return summary.select(F.col("id").alias("work_id"), F.when(review, F.col("best_review_score")).otherwise(0.0).alias("duplicate_score"), F.when(review, "DUPLICATE_REVIEW_CANDIDATE").otherwise("NO_DUPLICATE_REVIEW_CANDIDATE").alias("duplicate_code"))


def family_evidence(wide: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS) -> DataFrame:
    """work_id, lifecycle, family, score, code, available, weight, points; one row per weighted family.

    wide has <FAMILY>_score, _code and _available columns. Missing evidence gives no points and
    weights are not renormalised. Points are rounded here, before they are summed.
    """
    parts = []
    for i, f in enumerate(FAMILIES):
        weight = F.lit(None).cast("int")
        for stage, w in weights.items():
            if f in w:
                weight = F.when(F.col("lifecycle") == stage, w[f]).otherwise(weight)
        parts.append(F.struct(F.lit(i).alias("family_order"), F.lit(f).alias("family"), F.col(f"{f}_score").cast("double").alias("score"), F.col(f"{f}_code").alias("code"), F.coalesce(F.col(f"{f}_available"), F.lit(False)).alias("available"), weight.alias("weight")))
    rows = wide.select("work_id", "lifecycle", F.explode(F.array(*parts)).alias("e")).select("work_id", "lifecycle", "e.*").where("weight is not null")
    return rows.withColumn("points", fixed(F.coalesce("score", F.lit(0.0)) * F.col("weight") / 100, 6))


def priority_scores(evidence: DataFrame) -> DataFrame:
    """One row per work: score, coverage, band and the three families that add most."""
    top = F.slice(F.array_sort(F.collect_list(F.when(F.col("points") > 0, F.struct((-F.col("points")).alias("p"), "family_order", "family")))), 1, 3)
    out = evidence.groupBy("work_id", "lifecycle").agg(fixed(F.sum("points"), 6).alias("score"), F.sum(F.when(F.col("available"), F.col("weight")).otherwise(0)).alias("coverage"), top.alias("t"))
    return out.select("work_id", "lifecycle", "score", "coverage", band("score").alias("band"), *[F.get("t.family", F.lit(i)).alias(f"top_family_{i + 1}") for i in range(3)])


def ranked(scores: DataFrame) -> DataFrame:
    """Adds rank and rank_in_stage, by falling score; ties by work_id. No task sorts a stage."""
    order = [F.desc("score"), F.col("work_id")]
    return cumulated(cumulated(scores, [], order, F.lit(1), "rank"), ["lifecycle"], order, F.lit(1), "rank_in_stage")


def priority_queue(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("band").isin("HIGH", "CRITICAL")).orderBy(F.desc("score"), "work_id")


def review_alerts(wide: DataFrame, funds: DataFrame, signals: DataFrame, compliance: DataFrame) -> DataFrame:
    """work_id, alert_type, evidence_code, strength."""
    s = lambda f: F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.col(f"{f}_score"), F.lit(0.0))))
    # Alert types, their codes and families.
    tests = [
        ("STATISTICAL_ANOMALY", "LIFECYCLE_ANOMALY_TOP_DECILE", "ANOMALY", F.col("ANOMALY_score") >= 90),
        ("PEER_DEVIATION", "STATISTICAL_PEER_OUTLIER", "PEER_DEVIATION", F.col("PEER_DEVIATION_code") == "STATISTICAL_PEER_OUTLIER"),
        ("DUPLICATE_REVIEW_CANDIDATE", "CORROBORATED_REVIEW_CANDIDATE", "DUPLICATE_REVIEW", F.col("DUPLICATE_REVIEW_code") == "DUPLICATE_REVIEW_CANDIDATE"),
        ("OBSERVED_OVERDUE", "OBSERVED_OVERDUE_AS_OF", "OBSERVED_CONDITIONS", F.col("OBSERVED_CONDITIONS_code").isin("OBSERVED_OVERDUE", "OBSERVED_OVERDUE_AND_OVER_SANCTION")),
        ("OBSERVED_OVER_SANCTION", "OBSERVED_OVER_SANCTION_AS_OF", "OBSERVED_CONDITIONS", F.col("OBSERVED_CONDITIONS_code").isin("OBSERVED_OVER_SANCTION", "OBSERVED_OVERDUE_AND_OVER_SANCTION")),
        ("COST_OVERRUN_EARLY_WARNING", "SECONDARY_TOP_DECILE", "COST_OVERRUN_PREDICTION", (F.col("COST_OVERRUN_PREDICTION_score") >= 90) & ~F.col("OBSERVED_CONDITIONS_code").isin("OBSERVED_OVER_SANCTION", "OBSERVED_OVERDUE_AND_OVER_SANCTION")),
        ("OPERATIONAL_TREND_DEVIATION", "SUPPORTED_LATEST_MONTH_OPERATIONAL_TREND", "OPERATIONAL_TREND_CONTEXT", F.col("OPERATIONAL_TREND_CONTEXT_code") == "OPERATIONAL_TREND_DEVIATION"),
    ]
    single = wide.select("work_id", F.explode(F.array_compact(F.array(*[F.when(t, F.struct(F.lit(a).alias("alert_type"), F.lit(c).alias("evidence_code"), s(f).alias("strength"))) for a, c, f, t in tests]))).alias("a")).select("work_id", "a.*")
    strength = wide.select("work_id", s("PAYMENT_EXECUTION").alias("payment"), s("COMPLIANCE").alias("rules"))
    codes = signals.where(F.col("signal_code") != TOTAL).groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set("signal_code")), ";").alias("evidence_code"))
    paid = codes.join(strength, "work_id").select("work_id", F.lit("PAYMENT_IRREGULARITY").alias("alert_type"), "evidence_code", F.col("payment").alias("strength"))
    gaps = funds.where("current_large_gap or persistent_gap").join(strength, "work_id").select("work_id", F.lit("FUND_PROGRESS_REVIEW").alias("alert_type"), F.when(F.col("persistent_gap"), "PERSISTENT_FUND_PROGRESS_REVIEW").otherwise("CURRENT_LARGE_POSITIVE_FUND_GAP").alias("evidence_code"), F.col("payment").alias("strength"))
    hard = compliance.where("result = 'NON_COMPLIANT'").select("work_id", F.lit("DETERMINISTIC_NON_COMPLIANCE").alias("alert_type"), F.col("rule_id").alias("evidence_code"), F.lit(100.0).alias("strength"))
    review = compliance.where("result = 'REVIEW'").groupBy("work_id").agg(F.min_by("rule_id", F.struct(-scored("severity", REVIEW_SCORE), "rule_id")).alias("evidence_code"))
    soft = review.join(strength, "work_id").select("work_id", F.lit("COMPLIANCE_REVIEW").alias("alert_type"), "evidence_code", F.col("rules").alias("strength"))
    return single.unionByName(paid).unionByName(gaps).unionByName(hard).unionByName(soft)


# The second profile's alerts, in its order.
ALERTS_V2 = ("OBSERVED_COST_OVERRUN", "OBSERVED_DELAY", "PAYMENT_CHRONOLOGY_REVIEW", "RELEASE_ABOVE_VISIBLE_SANCTION", "MISSING_MONTHLY_SITE_EVIDENCE", "LOCATION_REQUIRES_REVIEW", "COMPLETION_RECORDS_REVIEW", "DUPLICATE_WORK_CANDIDATE")


def wide_v2(facts: DataFrame) -> DataFrame:
    """Family scores of the second profile from facts per work, which pass along.

    facts has work_id, lifecycle, odd, deviation_pct, best_duplicate, serving_percentile,
    fund_gap and one boolean for each of ALERTS_V2, in lower case. Strengths are fixed;
    evidence of the site weighs nothing.
    """
    flag = lambda name: F.coalesce(F.col(name.lower()), F.lit(False))
    gap = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(F.col("fund_gap"), F.lit(0.0)) / 75 * 100))
    scores = {
        "ANOMALY": F.coalesce("odd", F.lit(0.0)),
        "PEER_DEVIATION": F.coalesce("deviation_pct", F.lit(0.0)),
        "DUPLICATE_REVIEW": F.when(flag("DUPLICATE_WORK_CANDIDATE"), F.col("best_duplicate")).otherwise(0.0),
        "PAYMENT_EXECUTION": F.greatest(F.when(flag("PAYMENT_CHRONOLOGY_REVIEW"), 80.0).otherwise(0.0), gap),
        "OBSERVED_CONDITIONS": F.when(flag("OBSERVED_COST_OVERRUN"), 100.0).when(flag("OBSERVED_DELAY"), 80.0).when(flag("RELEASE_ABOVE_VISIBLE_SANCTION"), 75.0).otherwise(0.0),
        "COMPLIANCE": F.when(flag("COMPLETION_RECORDS_REVIEW"), 80.0).otherwise(0.0),
        "COST_OVERRUN_PREDICTION": F.coalesce("serving_percentile", F.lit(0.0)),
    }
    columns = []
    for name in FAMILIES:
        columns += [scores.get(name, F.lit(0.0)).alias(f"{name}_score"), F.lit(name).alias(f"{name}_code"), F.lit(name in scores).alias(f"{name}_available")]
    return facts.select("work_id", "lifecycle", *[flag(a).alias(a.lower()) for a in ALERTS_V2], *columns)


def priority_v2(wide: DataFrame) -> DataFrame:
    """work_id, lifecycle, score, band, requires_review by the second profile; a work is actionable if any alert holds."""
    scored_ = priority_scores(family_evidence(wide, WEIGHTS_V2)).select("work_id", F.least(F.lit(100.0), F.col("score")).alias("score"))
    flags = [F.col(a.lower()) for a in ALERTS_V2]
    return wide.select("work_id", "lifecycle", F.array_contains(F.array(*flags), True).alias("requires_review")).join(scored_, "work_id").withColumn("band", band("score"))


def alerts_v2(wide: DataFrame) -> DataFrame:
    """alert_id, work_id, alert_type: a row for each alert that holds."""
    found = F.array_compact(F.array(*[F.when(F.col(a.lower()), F.lit(a)) for a in ALERTS_V2]))
    rows = wide.select("work_id", F.explode(found).alias("alert_type"))
    return rows.select(F.concat_ws("-", F.lit("V2"), "work_id", "alert_type").alias("alert_id"), "work_id", "alert_type")


def authority_summary(scores: DataFrame, profile: DataFrame) -> DataFrame:
    """Works, mean score and urgent bands by state, district and sector: one pass of grouping sets."""
    rows = scores.join(profile.select("work_id", "state", "district", "sector"), "work_id")
    sets = rows.groupingSets([["state"], ["state", "district"], ["sector"]], "state", "district", "sector")
    out = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("works"), fixed(F.avg("score"), 4).alias("mean_score"), F.count_if(F.col("band") == "HIGH").alias("high"), F.count_if(F.col("band") == "CRITICAL").alias("critical"))
    kind = F.when(F.col("g") == 3, "STATE").when(F.col("g") == 1, "DISTRICT").otherwise("SECTOR")
    return out.select(kind.alias("group_type"), F.concat_ws(" / ", "state", "district", "sector").alias("group_value"), "works", "mean_score", "high", "critical")


def alert_summary(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_type").agg(F.countDistinct("work_id").alias("works"), F.count("*").alias("alerts"))
