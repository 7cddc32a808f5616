"""Payment signals, fund-against-progress gaps and deterministic rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worksight.functions.scalar import safe_ratio
from worksight.functions.stats import runs
from worksight.operators.features import assets_as_of, payment_order, released

# Signal codes and their severities.
PAYMENT_SIGNALS = {
    "PAYMENT_AUTH_BEFORE_REQUEST": "WARNING",
    "PAYMENT_RELEASE_BEFORE_AUTH": "STRONG_WARNING",
    "DUPLICATE_PFMS_REFERENCE": "STRONG_WARNING",
    "ZERO_VALUE_RELEASED_PAYMENT": "WARNING",
    "PAYMENT_AFTER_COMPLETION": "WARNING",
    "PAYMENT_AFTER_FINAL_PAYMENT": "STRONG_WARNING",
    "MULTIPLE_FINAL_PAYMENTS": "STRONG_WARNING",
    "RELEASED_TOTAL_EXCEEDS_SANCTION": "STRONG_WARNING",
}
TOTAL = "RELEASED_TOTAL_EXCEEDS_SANCTION"


def payment_signals(profile: DataFrame, payments: DataFrame, as_of: str) -> DataFrame:
    """work_id, payment_id, signal_code, severity. One window over a work's payments finds all.

    References repeat across works, so their first use is found in a window of its own;
    a reference is held by few payments.
    """
    order = W.partitionBy("work_id").orderBy(*payment_order())
    rows = released(payments, as_of).withColumn("use__", F.row_number().over(W.partitionBy("reference").orderBy(*payment_order(), "work_id")))
    rows = rows.join(profile.select("work_id", "completed_on"), "work_id")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"after_final__": F.coalesce(F.max(F.col("is_final").cast("int")).over(before), F.lit(0)) > 0, "finals__": F.sum(F.col("is_final").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))})
    tests = [
        ("PAYMENT_AUTH_BEFORE_REQUEST", F.col("authorized_on") < F.col("requested_on")),
        ("PAYMENT_RELEASE_BEFORE_AUTH", F.col("released_on") < F.col("authorized_on")),
        ("DUPLICATE_PFMS_REFERENCE", F.col("reference").isNotNull() & (F.col("use__") > 1)),
        ("ZERO_VALUE_RELEASED_PAYMENT", F.col("amount") == 0),
        ("PAYMENT_AFTER_COMPLETION", F.col("released_on") > F.col("completed_on")),
        ("PAYMENT_AFTER_FINAL_PAYMENT", F.col("after_final__")),
        ("MULTIPLE_FINAL_PAYMENTS", F.col("is_final") & (F.col("finals__") > 1)),
    ]
    found = rows.select("work_id", "payment_id", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in tests]))).alias("signal_code"))
    over = profile.where("released_total > sanctioned and sanctioned_on is not null").select("work_id", F.lit(None).cast("string").alias("payment_id"), F.lit(TOTAL).alias("signal_code"))
    severity = F.when(F.col("signal_code").isin(*[c for c, s in PAYMENT_SIGNALS.items() if s == "WARNING"]), "WARNING").otherwise("STRONG_WARNING")
    return found.unionByName(over).withColumn("severity", severity)


def signal_summary(profile: DataFrame, signals: DataFrame) -> DataFrame:
    """Per work the count of each signal, of all, and whether there is any."""
    counts = [F.count_if(F.col("signal_code") == c).alias(f"{c.lower()}_count") for c in PAYMENT_SIGNALS]
    got = signals.groupBy("work_id").agg(*counts, F.count("*").alias("signal_count"))
    names = [*[f"{c.lower()}_count" for c in PAYMENT_SIGNALS], "signal_count"]
    out = profile.select("work_id").join(got, "work_id", "left")
    return out.select("work_id", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names], (F.coalesce("signal_count", F.lit(0)) > 0).alias("has_signal"))


def gap_runs(progress: DataFrame, threshold: float = 25.0) -> DataFrame:
    """Per work the gap financial - physical: latest, extremes, and runs of at least `threshold`.

    Reports without a gap are left out before runs are counted.
    """
    rows = progress.withColumn("gap", F.col("financial") - F.col("physical")).where("gap is not null")
    at = F.struct("report_date", "progress_id")
    basic = rows.groupBy("work_id").agg(F.count("*").alias("reports"), F.max_by("gap", at).alias("latest_gap"), F.max("gap").alias("largest_gap"), F.avg("gap").alias("mean_gap"), F.count_if(F.col("gap") > 0).alias("positive_gaps"))
    return basic.join(runs(rows, ["work_id"], ["report_date", "progress_id"], F.col("gap") >= threshold), "work_id")


def fund_progress(profile: DataFrame, gaps: DataFrame, latest: DataFrame, threshold: float = 25.0) -> DataFrame:
    """Works with a sanction: paid share against reported progress, and review flags."""
    rows = profile.where("sanctioned > 0 and sanctioned_on is not null").join(latest.select("work_id", "last_physical", "last_financial"), "work_id", "left").join(gaps.select("work_id", "flagged", "longest_run", "latest_run"), "work_id", "left")
    paid = safe_ratio(F.col("released_total") * 100.0, "sanctioned")
    rows = rows.withColumns({"paid_pct": paid, "fund_gap": paid - F.col("last_physical"), "reported_gap": F.col("last_financial") - F.col("last_physical")})
    return rows.select("work_id", "paid_pct", "fund_gap", "reported_gap", (F.col("last_financial") - F.col("paid_pct")).alias("reconciliation"), F.coalesce(F.col("fund_gap") >= threshold, F.lit(False)).alias("current_large_gap"), F.coalesce(F.col("latest_run") >= 2, F.lit(False)).alias("persistent_gap"))


#: Rule ids, their severities and the lifecycle stages in which they apply.
STAGES_AFTER = ("EXECUTION", "COMPLETION")
RULES = {
    "SANCTION_WITHIN_45_DAYS": ("WARNING", STAGES_AFTER),
    "MINIMUM_SANCTION": ("WARNING", STAGES_AFTER),
    "PLAN_WITHIN_ONE_YEAR": ("WARNING", STAGES_AFTER),
    "PUBLIC_USE": ("WARNING", ("COMPLETION",)),
    "COMPLETION_PHOTO": ("WARNING", ("COMPLETION",)),
    "HANDOVER": ("WARNING", ("COMPLETION",)),
    "ASSET_REGISTER": ("STRONG_WARNING", ("COMPLETION",)),
    "UTILISATION_CERTIFICATE": ("STRONG_WARNING", ("COMPLETION",)),
}


def asset_counts(assets: DataFrame, as_of: str) -> DataFrame:
    """What the rules ask of a work's assets, counted once."""
    a = assets_as_of(assets, as_of)
    handed = F.col("handover_on").isNotNull()
    register = F.lower("register_entry")
    return a.groupBy("work_id").agg(
        F.count("*").alias("assets"), F.count("public_use_on").alias("in_use"), F.count_if(F.trim("photo") != "").alias("with_photo"), F.count("handover_on").alias("handed"),
        F.count_if(handed & F.col("register_entry").isNull()).alias("handed_unknown"), F.count_if(handed & (register == "no")).alias("handed_no"), F.count_if(handed & (register == "yes")).alias("handed_yes"),
        F.count_if(F.col("certificate_status").isNull()).alias("certificate_unknown"), F.count_if((F.col("certificate_status") == "Submitted") & F.col("certificate_on").isNotNull()).alias("certified"),
    )


def in_bounds(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNull(), "INSUFFICIENT_EVIDENCE").when(value.between(low, high), "PASS").otherwise("REVIEW")


def all_of(count: str, failing: str = "REVIEW") -> Column:
    return F.when(F.coalesce("assets", F.lit(0)) == 0, "INSUFFICIENT_EVIDENCE").when(F.col(count) == F.col("assets"), "PASS").otherwise(failing)


def outcomes() -> dict[str, Column]:
    """Each rule's outcome where it applies; a column expression, so rules can be added freely."""
    register = F.when(F.coalesce("assets", F.lit(0)) == 0, "INSUFFICIENT_EVIDENCE").when(F.col("handed") == 0, "NOT_APPLICABLE").when(F.col("handed_unknown") > 0, "INSUFFICIENT_EVIDENCE").when(F.col("handed_no") > 0, "NON_COMPLIANT").when(F.col("handed_yes") == F.col("handed"), "PASS").otherwise("REVIEW")
    certificate = F.when(F.coalesce("assets", F.lit(0)) == 0, "INSUFFICIENT_EVIDENCE").when(F.col("certificate_unknown") > 0, "INSUFFICIENT_EVIDENCE").when(F.col("certified") == F.col("assets"), "PASS").otherwise("REVIEW")
    return {
        "SANCTION_WITHIN_45_DAYS": in_bounds(F.col("sanction_days"), 0, 45),
        "MINIMUM_SANCTION": in_bounds(F.col("sanctioned"), 25_000_000, float("inf")),
        "PLAN_WITHIN_ONE_YEAR": in_bounds(F.col("planned_days"), 0, 365),
        "PUBLIC_USE": all_of("in_use"),
        "COMPLETION_PHOTO": all_of("with_photo", "NON_COMPLIANT"),
        "HANDOVER": all_of("handed"),
        "ASSET_REGISTER": register,
        "UTILISATION_CERTIFICATE": certificate,
    }


def rule_evidence(profile: DataFrame, assets: DataFrame, as_of: str, rules: dict[str, Column] | None = None) -> DataFrame:
    """Exactly works x rules rows: work_id, lifecycle, rule_id, severity, result. No shuffle beyond the asset join."""
    rules = rules or outcomes()
    rows = profile.join(asset_counts(assets, as_of), "work_id", "left")
    gated = []
    for rule, result in rules.items():
        severity, stages = RULES.get(rule, ("INFO", STAGES_AFTER))
        gated.append(F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.when(F.col("lifecycle").isin(*stages), result).otherwise("NOT_APPLICABLE").alias("result")))
    return rows.select("work_id", "lifecycle", F.explode(F.array(*gated)).alias("r")).select("work_id", "lifecycle", "r.*")


RESULT_ORDER = ("NON_COMPLIANT", "REVIEW", "INSUFFICIENT_EVIDENCE", "PASS", "NOT_APPLICABLE")


def rule_summary(evidence: DataFrame) -> DataFrame:
    """Per work the count of each result and the rule that matters most."""
    rank = F.array_position(F.array(*[F.lit(r) for r in RESULT_ORDER]), F.col("result"))
    severe = F.array_position(F.array(*[F.lit(s) for s in ("STRONG_WARNING", "WARNING", "INFO")]), F.col("severity"))
    counts = [F.count_if(F.col("result") == r).alias(f"{r.lower()}_count") for r in RESULT_ORDER]
    out = evidence.groupBy("work_id").agg(*counts, F.min_by("rule_id", F.struct(rank, severe, "rule_id")).alias("top_rule"))
    return out.withColumn("evaluated_count", F.col("pass_count") + F.col("review_count") + F.col("non_compliant_count"))


def rule_traceability(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rules (rule_id, chunk_id, clause) whose chunk is missing or doesn't mention the clause."""
    both = registry.join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    fault = F.when(F.col("text").isNull(), "MISSING_CHUNK").when(~F.contains("text", "clause"), "CLAUSE_NOT_FOUND")
    return both.select("rule_id", fault.alias("fault")).where("fault is not null")


def record_status(assets: DataFrame, works: DataFrame, as_of: str) -> DataFrame:
    """Per work, whether each closure record is there, and whether closure needs review."""
    a = assets_as_of(assets, as_of).groupBy("work_id").agg(*[F.max(F.col(c).isNotNull().cast("int")).alias(c) for c in ("public_use_on", "handover_on", "certificate_on")])
    out = works.select("work_id", "lifecycle").join(a, "work_id", "left")
    status = {c.removesuffix("_on"): F.when(F.col("lifecycle") != "COMPLETION", "NOT_APPLICABLE").when(F.col(c) == 1, "RECORDED").otherwise("NOT_RECORDED") for c in ("public_use_on", "handover_on", "certificate_on")}
    out = out.select("work_id", "lifecycle", *[v.alias(k) for k, v in status.items()])
    return out.withColumn("closure_requires_review", (F.col("public_use") == "NOT_RECORDED") | (F.col("handover") == "NOT_RECORDED") | (F.col("certificate") == "NOT_RECORDED"))


def outcomes_of_completed(profile: DataFrame, assets: DataFrame, as_of: str) -> DataFrame:
    """Completed works: last completion, final spend if all assets' is visible, delay and overrun labels."""
    a = assets_as_of(assets, as_of)
    got = a.groupBy("work_id").agg(F.max("completed_on").alias("finished_on"), F.sum("final_spend").alias("spend"), F.bool_and(F.col("final_spend").isNotNull()).alias("all_visible"))
    out = profile.where("lifecycle = 'COMPLETION'").select("work_id", "sanctioned", "expected_on").join(got, "work_id")
    return out.select("work_id", "finished_on", F.when(F.col("all_visible"), F.col("spend")).alias("final_spend"), (F.datediff("finished_on", "expected_on") > 0).cast("int").alias("delayed"), F.when(F.col("all_visible") & (F.col("sanctioned") > 0), (F.col("spend") > F.col("sanctioned")).cast("int")).alias("overran"))

