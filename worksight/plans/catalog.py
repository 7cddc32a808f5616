"""All queries over a folder of tables. Each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worksight.functions import scalar, stats
from worksight.functions.scalar import fixed
from worksight.operators import checks, features, fusion, models, pairs, peers, serving, signals, trends
from worksight.plans import register, sql
from worksight.sources import domain
from worksight.sources.durable import durable, together
from worksight.sources.domain import AS_OF, EVENTS_AS_OF, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Registers a query; its dates come out as text, which all clients read alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])

    REGISTERED[f.__name__] = functools.wraps(f)(run)
    return f


class Tables:
    """The domain tables of a folder and what is derived from them, each built once on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.works, self.payments = domain.works(spark, sf_dir), domain.payments(spark, sf_dir)
        self.progress, self.assets = domain.progress(spark, sf_dir), domain.assets(spark, sf_dir)
        self._profile = None

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def profile(self) -> DataFrame:
        if self._profile is None:
            self._profile = features.work_profile(self.works, self.payments, self.assets, AS_OF)
        return self._profile


METRICS = ["released_total", "spend_ratio", "vendor_hhi", "payment_count", "planned_days"]
REPORT_ORDER = ["report_date", "progress_id"]


# Validation


@query
def dq_primary_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"]}
    out = None
    for name, key in keys.items():
        part = checks.key_faults(table(spark, d, name), key).select(F.lit(name).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query
def dq_foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    links = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey")]
    out = None
    for child, key, parent, parent_key in links:
        part = checks.relationship(t(child), key, t(parent), parent_key, f"{child}.{key}")
        out = part if out is None else out.unionByName(part)
    return out


@query
def dq_orphans(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return checks.orphans(table(spark, d, "labels").withColumn("work_id", F.col("doc_id")), "doc_id", docs, "doc_id", "ORPHAN_FOREIGN_KEY", "labels", "doc_id")


@query
def dq_fk_type(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return checks.wrong_type(t.payments, "vendor_id", t.raw("supplier"), "s_suppkey", F.col("s_nationkey") < 20, "FOREIGN_KEY_UNEXPECTED_ENTITY_TYPE", "payments", "payment_id").groupBy("issue_code", "observed").agg(F.count("*").alias("issues"))


@query
def dq_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.progress(spark, d)
    return checks.out_of_range(rows, {"physical": (0, 90), "financial": (1, 98)}, "progress", "progress_id").select("issue_code", "record_id", "work_id", "observed")


@query
def dq_chronology(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    pairs_ = {"PAYMENT_AUTH_BEFORE_REQUEST": ("requested_on", "authorized_on"), "PAYMENT_RELEASE_BEFORE_AUTH": ("authorized_on", "released_on")}
    own = checks.chronology(t.payments, pairs_, "payments", "payment_id")
    joined = t.payments.join(t.works.select("work_id", "recommended_on", "sanctioned_on"), "work_id")
    cross = checks.chronology(joined, {"PAYMENT_BEFORE_RECOMMENDATION": ("recommended_on", "released_on"), "PAYMENT_BEFORE_SANCTION": ("sanctioned_on", "released_on")}, "payments", "payment_id")
    return own.unionByName(cross).groupBy("issue_code", "severity").agg(F.count("*").alias("issues"), F.countDistinct("work_id").alias("works"))


@query
def dq_future_events(spark: SparkSession, d: str) -> DataFrame:
    return checks.future_events(domain.assets(spark, d), ["completed_on", "public_use_on", "handover_on", "certificate_on"], AS_OF, "assets", "asset_id").select("issue_code", "record_id", "observed")


@query
def dq_sequence_decrease(spark: SparkSession, d: str) -> DataFrame:
    return checks.sequence_decrease(domain.progress(spark, d), "physical", REPORT_ORDER, "progress", "progress_id").select("issue_code", "severity", "record_id", "work_id")


@query
def dq_duplicate_report_date(spark: SparkSession, d: str) -> DataFrame:
    return checks.repeated(domain.progress(spark, d), ["work_id", "report_date"], [F.col("progress_id")], "DUPLICATE_WORK_REPORT_DATE", "progress", "progress_id").select("issue_code", "record_id", "work_id")


@query
def dq_duplicate_reference(spark: SparkSession, d: str) -> DataFrame:
    found = checks.repeated(domain.payments(spark, d), ["reference"], features.payment_order(), "DUPLICATE_PFMS_REFERENCE", "payments", "payment_id")
    return found.groupBy("work_id").agg(F.count("*").alias("issues"))


@query
def dq_total_mismatch(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return checks.total_mismatch(t.works, "sanctioned", t.payments)


@query
def dq_running_total(spark: SparkSession, d: str) -> DataFrame:
    rows = checks.running_totals(domain.payments(spark, d), features.payment_order())
    return rows.groupBy("work_id").agg(F.max("cumulative").alias("final_total"), F.sum("cumulative").alias("sum_of_totals"), F.count("*").alias("payments"))


@query
def dq_financial_over_100(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("work_id", F.col("user_id"))
    return checks.above(rows, "value", 100, "FINANCIAL_PROGRESS_OVER_100", "progress", "event_id").select("issue_code", "severity", "record_id", "work_id")


@query
def dq_negative_money(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    found = checks.negative_money(t.raw("customer"), ["c_acctbal"], "mp", "c_custkey", "c_custkey")
    found = found.unionByName(checks.negative_money(t.raw("supplier"), ["s_acctbal"], "entities", "s_suppkey", "s_suppkey"))
    found = found.unionByName(checks.negative_money(t.works, ["sanctioned"], "works", "work_id", "work_id"))
    found = found.unionByName(checks.negative_money(t.payments, ["amount"], "payments", "payment_id", "work_id"))
    return found.unionByName(checks.negative_money(t.assets, ["final_spend"], "assets", "asset_id", "work_id")).select("issue_code", "table_name", "record_id", "observed")


@query
def dq_progress_after_completion(spark: SparkSession, d: str) -> DataFrame:
    return checks.after_completion(domain.progress(spark, d), domain.assets(spark, d)).select("issue_code", "severity", "record_id", "work_id", "observed")


@query
def dq_asset_date_order(spark: SparkSession, d: str) -> DataFrame:
    return checks.asset_date_order(domain.assets(spark, d), ["marked_on", "certificate_on", "handover_on", "public_use_on"]).select("issue_code", "record_id", "work_id", "observed")


@query
def dq_zero_released(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.payments(spark, d)
    found = checks.issues(rows, F.col("is_released") & (F.col("amount") == 0), "ZERO_RELEASED_PAYMENT", "WARNING", "payments", "payment_id")
    return rows.agg(F.count("*").alias("payments"), F.count_if("is_released").alias("released")).crossJoin(found.agg(F.count("*").alias("issues")))  # one row each


@query
def dq_cumulative_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """The running total by number of payment, as reported, against that of the canonical order."""
    rows = domain.payments(spark, d)
    own = W.partitionBy("work_id").orderBy("stage", "payment_id").rowsBetween(W.unboundedPreceding, 0)
    found = checks.cumulative_mismatch(rows.withColumn("told", F.sum("amount").over(own)), F.col("told"), features.payment_order())
    return found.groupBy("issue_code", "work_id").agg(F.count("*").alias("issues"))


@query
def dq_labels(spark: SparkSession, d: str) -> DataFrame:
    return checks.label_faults(table(spark, d, "labels"), "doc_id", table(spark, d, "documents"), ["quality", "toxic"])


@query
def dq_severity_counts(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    found = checks.sequence_decrease(t.progress, "physical", REPORT_ORDER, "progress", "progress_id")
    return checks.severity_counts(found.unionByName(checks.out_of_range(t.progress, {"physical": (0, 90)}, "progress", "progress_id")))


@query
def dq_feature_contract(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return checks.feature_contract(t.profile, "work_id", t.works.where(F.col("recommended_on") <= F.lit(AS_OF).cast("date")), list(features.PROFILE), ["quality", "toxic", "label"])


@query
def dq_cardinality_profile(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return checks.cardinality(t.works, t.payments)


@query
def dq_status_inconsistency(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return checks.status_inconsistency(t.works, F.col("status") == "P", t.payments.where("is_released"), domain.site_reports(spark, d))


@query
def dq_progress_chronology(spark: SparkSession, d: str) -> DataFrame:
    limits = {"PROGRESS_BEFORE_RECOMMENDATION": "recommended_on", "PROGRESS_BEFORE_SANCTION": "sanctioned_on"}
    found = checks.before_parent(domain.site_reports(spark, d), "report_date", domain.works(spark, d), limits, "progress", "progress_id")
    return found.groupBy("issue_code", "severity").agg(F.count("*").alias("issues"), F.countDistinct("work_id").alias("works"))


@query
def dq_required_keys(spark: SparkSession, d: str) -> DataFrame:
    """Records that a completed work's assets must have once it is handed over."""
    rows = domain.assets(spark, d)
    handed = F.col("handover_on").isNotNull()
    rules = {"NULL_REGISTER_AFTER_HANDOVER": ("register_entry", handed), "NULL_CERTIFICATE_DATE": ("certificate_on", F.col("certificate_status") == "Submitted"), "NULL_PUBLIC_USE": ("public_use_on", handed & (F.col("register_entry") == "Yes"))}
    return checks.required_keys(rows, rules, "assets", "asset_id").select("issue_code", "record_id", "work_id", "observed")


@query
def dq_value_contract(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    ratios = {"spend_ratio": ("released_total", "sanctioned"), "schedule_ratio": ("planned_days", "planned_days"), "largest_share": ("payment_count", "released_total")}
    return checks.value_contract(t.profile, ratios, ["recommended_on", "sanctioned_on", "expected_on", "completed_on"], AS_OF, t.payments)


@query
def dq_issue_summary(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    found = checks.chronology(t.payments, {"PAYMENT_AUTH_BEFORE_REQUEST": ("requested_on", "authorized_on"), "PAYMENT_RELEASE_BEFORE_AUTH": ("authorized_on", "released_on")}, "payments", "payment_id")
    found = found.unionByName(checks.sequence_decrease(t.progress, "physical", REPORT_ORDER, "progress", "progress_id"))
    found = found.unionByName(checks.out_of_range(t.progress, {"physical": (0, 90)}, "progress", "progress_id"))
    return checks.summary(found)


# Features


@query
def payments_as_of(spark: SparkSession, d: str) -> DataFrame:
    return features.payments_as_of(domain.payments(spark, d), AS_OF).select("work_id", "payment_count", "released_total", "vendor_count", "largest_payment", "first_payment_on", "last_payment_on", "final_payment_count", "zero_payment_count", fixed("largest_share", 6).alias("largest_share"), fixed("vendor_hhi", 6).alias("vendor_hhi"), "days_since_payment")


@query
def progress_as_of(spark: SparkSession, d: str) -> DataFrame:
    out = features.progress_as_of(domain.progress(spark, d), EVENTS_AS_OF)
    return out.select("work_id", "report_count", "first_report_on", "last_report_on", "first_physical", "last_physical", "last_financial", "decrease_count", fixed("largest_decrease", 4).alias("largest_decrease"), "same_day_extras", fixed("financial_gap", 4).alias("financial_gap"), "days_since_report", fixed("velocity", 4).alias("velocity"))


@query
def asset_mask_as_of(spark: SparkSession, d: str) -> DataFrame:
    return features.asset_summary(domain.assets(spark, d), AS_OF)


@query
def work_profile(spark: SparkSession, d: str) -> DataFrame:
    p = Tables(spark, d).profile
    rounded = {c: fixed(c, 6) for c in ("largest_share", "vendor_hhi", "spend_ratio", "overrun_pct", "schedule_ratio")}
    return p.withColumns(rounded)


@query
def feature_quality(spark: SparkSession, d: str) -> DataFrame:
    got = features.column_profile(Tables(spark, d).profile, METRICS)
    return got.select("feature", "rows", "non_null", "distinct_values", fixed("minimum", 4).alias("minimum"), fixed("maximum", 4).alias("maximum"), fixed("dominant_share", 6).alias("dominant_share"), fixed("null_share", 6).alias("null_share"))


@query
def feature_selection(spark: SparkSession, d: str) -> DataFrame:
    got = features.feature_selection(features.column_profile(Tables(spark, d).profile, [*METRICS, "overdue_days", "asset_count"], ["lifecycle"]))
    return got.select("lifecycle", "feature", "non_null", "reason")


# Peers and anomalies


@query
def peer_stats(spark: SparkSession, d: str) -> DataFrame:
    long = peers.long_metrics(Tables(spark, d).profile, ["released_total", "planned_days"], ["lifecycle", "sector"])
    got = peers.peer_stats(long, ["lifecycle", "sector"])
    return got.select("lifecycle", "sector", "metric", "n", *[fixed(c, 3).alias(c) for c in ("p10", "q25", "median", "q75", "p90", "mad", "iqr")])


@query
def peer_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    got = peers.peer_evidence(Tables(spark, d).profile, ["released_total", "planned_days"])
    return got.select("work_id", "metric", "level", "peers", fixed("median", 2).alias("median"), fixed("deviation", 4).alias("deviation"), "method")


@query
def peer_summary(spark: SparkSession, d: str) -> DataFrame:
    got = peers.peer_summary(peers.peer_evidence(Tables(spark, d).profile, ["released_total", "planned_days"]))
    return got.select("work_id", "lifecycle", "usable_metrics", "outlier_count", fixed("max_deviation", 4).alias("max_deviation"))


@query
def sector_deviation(spark: SparkSession, d: str) -> DataFrame:
    got = peers.sector_deviation(Tables(spark, d).profile.select("work_id", "sector", "released_total"), "released_total")
    return got.select("work_id", "sector", fixed("deviation", 4).alias("deviation"))


@query
def stage_percentile(spark: SparkSession, d: str) -> DataFrame:
    got = stats.percentile_exclusive(Tables(spark, d).profile.select("work_id", "lifecycle", "payment_count"), ["lifecycle"], "payment_count", "pct")
    return got.select("work_id", "lifecycle", fixed("pct", 6).alias("pct"))


@query
def inclusive_percentile(spark: SparkSession, d: str) -> DataFrame:
    got = stats.percentile_inclusive(Tables(spark, d).profile.select("work_id", "lifecycle", "payment_count"), ["lifecycle"], "payment_count", "pct")
    return got.select("work_id", "lifecycle", fixed("pct", 6).alias("pct"))


@query
def isolation_forest(spark: SparkSession, d: str) -> DataFrame:
    got = models.isolation_forest(Tables(spark, d).profile, METRICS)
    return stats.percentile_exclusive(got, ["lifecycle"], "anomaly_score", "anomaly_percentile")


# Pairs


@query
def vector_topk_pairs(spark: SparkSession, d: str) -> DataFrame:
    got = register.near_pairs(table(spark, d, "embeddings").select(F.col("vec_id").alias("work_id"), F.col("embedding").alias("v")), 10)
    return got.select("a", "b", fixed("cosine", 4).alias("cosine"))


@query
def pair_score(spark: SparkSession, d: str) -> DataFrame:
    rows = register.scored(spark, d)
    return rows.select("a", "b", *[fixed(c, n).alias(c) for c, n in (("cosine", 4), ("km", 3), ("location", 4), ("amount", 4), ("date", 4), ("score", 3))])


@query
def pair_review_policy(spark: SparkSession, d: str) -> DataFrame:
    return register.scored(spark, d).select("a", "b", F.array_join("reasons", ",").alias("reasons"))


@query
def pair_symmetric_summary(spark: SparkSession, d: str) -> DataFrame:
    return register.summary(spark, d).withColumns({c: fixed(c, 3) for c in ("best_score", "best_review_score")})


@query
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return pairs.normalize_texts(table(spark, d, "documents").select("doc_id", "text"), "text", "normalized").select("doc_id", F.sha2("normalized", 256).alias("normalized_sha256"), F.length("normalized").alias("normalized_chars"))


# Payments, gaps, rules


@query
def payment_signals(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return signals.payment_signals(t.profile, t.payments, AS_OF).groupBy("work_id", "signal_code", "severity").agg(F.count("*").alias("signals"))


@query
def payment_signal_summary(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return signals.signal_summary(t.profile, signals.payment_signals(t.profile, t.payments, AS_OF))


@query
def gap_runs(spark: SparkSession, d: str) -> DataFrame:
    got = signals.gap_runs(domain.progress(spark, d))
    return got.select("work_id", "reports", fixed("latest_gap", 4).alias("latest_gap"), fixed("largest_gap", 4).alias("largest_gap"), "positive_gaps", "flagged", "longest_run", "latest_run")


def funds(t: Tables) -> DataFrame:
    return signals.fund_progress(t.profile, signals.gap_runs(t.progress), features.progress_as_of(t.progress, EVENTS_AS_OF))


@query
def fund_progress(spark: SparkSession, d: str) -> DataFrame:
    return funds(Tables(spark, d)).withColumns({c: fixed(c, 4) for c in ("paid_pct", "fund_gap", "reported_gap", "reconciliation")})


@query
def rule_evidence(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return signals.rule_evidence(t.profile, t.assets, AS_OF)


@query
def rule_summary(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return signals.rule_summary(signals.rule_evidence(t.profile, t.assets, AS_OF))


@query
def record_status(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return signals.record_status(t.assets, t.profile, AS_OF)


# Prediction


@query
def landmark_snapshots(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    got = models.landmark_rows(t.works, t.payments)
    return got.select("work_id", "fraction", F.unix_seconds("landmark").alias("landmark_s"), "payment_count", "released_total", fixed("spend_ratio", 6).alias("spend_ratio"))


@query
def work_outcomes(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return signals.outcomes_of_completed(t.profile, t.assets, AS_OF)


@query
def feasibility(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return models.feasibility(signals.outcomes_of_completed(t.profile, t.assets, AS_OF), "overran")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents' labels with a score to rank: a share from a fixed hash, by source of the label."""
    return table(spark, d, "labels").select(F.col("doc_id").alias("work_id"), F.col("quality").alias("label"), (F.col("doc_id") * 7919 % 1000 / 1000.0).alias("score"), F.when(F.col("toxic") == 1, "A").otherwise("B").alias("model"))


@query
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    got = models.ranking_metrics(labelled(spark, d), "score", "label", ["model"])
    return got.select("model", "rows", *[fixed(c, 6).alias(c) for c in ("brier", "prevalence", "roc_auc", "average_precision")])


@query
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return models.calibration_error(labelled(spark, d), "score", "label").select(fixed("calibration_error", 6).alias("calibration_error"), "rows")


@query
def top_fraction(spark: SparkSession, d: str) -> DataFrame:
    return models.top_fraction(labelled(spark, d), "score", "label").select("fraction", "selected", "hits", "positives", fixed("precision", 6).alias("precision"), fixed("recall", 6).alias("recall"))


@query
def threshold_search(spark: SparkSession, d: str) -> DataFrame:
    return models.threshold_search(labelled(spark, d), "score", "label").select(fixed("threshold", 4).alias("threshold"), fixed("f1", 6).alias("f1"))


@query
def serving_rank(spark: SparkSession, d: str) -> DataFrame:
    got = models.serving_rank(Tables(spark, d).profile.select("work_id", "lifecycle", "spend_ratio"), "spend_ratio")
    return got.select("work_id", "lifecycle", fixed("serving_percentile", 6).alias("serving_percentile"), "serving_rank")


@query
def work_split(spark: SparkSession, d: str) -> DataFrame:
    return models.split(Tables(spark, d).works.withColumn("label", F.col("status")), "label").select("work_id", "part")


# Trends


def trend_events(t: Tables) -> DataFrame:
    """Events of the seven metrics; what is recommended is somewhat more than what is sanctioned."""
    place = ["state", "district", "sector"]
    w = t.works.select("work_id", *place)
    one = F.lit(1).cast("bigint")
    asked = F.expr("sanctioned * (100 + work_id % 10) div 100")
    sides = lambda *metrics: F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in metrics])).alias("m")
    works = t.works.select(F.col("recommended_on").alias("event_on"), *place, sides(("RECOMMENDATIONS", one), ("RECOMMENDED_AMOUNT", asked)))
    sanctions = t.works.where("status <> 'P'").select(F.col("sanctioned_on").alias("event_on"), *place, sides(("SANCTIONS", one), ("SANCTIONED_AMOUNT", F.col("sanctioned"))))
    paid = t.payments.where("is_released").join(w, "work_id").select(F.col("released_on").alias("event_on"), *place, sides(("RELEASED_PAYMENTS", one), ("RELEASED_AMOUNT", F.col("amount"))))
    told = domain.site_reports(t.spark, t.sf_dir).select("work_id", "report_date").join(w, "work_id").select(F.col("report_date").alias("event_on"), *place, sides(("PROGRESS_REPORTS", one)))
    rows = works.unionByName(sanctions).unionByName(paid).unionByName(told)
    return rows.select("m.metric", "event_on", "m.value", *place)


def baseline(t: Tables) -> DataFrame:
    return trends.causal_baseline(trends.dense_months(trend_events(t), AS_OF))


@query
def monthly_dense(spark: SparkSession, d: str) -> DataFrame:
    return trends.dense_months(trend_events(Tables(spark, d)), AS_OF).withColumn("value", F.col("value").cast("bigint"))


@query
def monthly_causal_z(spark: SparkSession, d: str) -> DataFrame:
    got = baseline(Tables(spark, d))
    return got.select("group_type", "group_value", "metric", "month", "baseline_months", "support", fixed("median", 2).alias("median"), fixed("mad", 2).alias("mad"), fixed("robust_z", 4).alias("robust_z"), "method", "status", "flagged")


@query
def monthly_ewma(spark: SparkSession, d: str) -> DataFrame:
    got = trends.monthly_ewma(trends.dense_months(trend_events(Tables(spark, d)), AS_OF).where("group_type = 'STATE'"))
    return got.select("group_value", "metric", "month", fixed("ewma", 2).alias("ewma"))


@query
def trend_alerts(spark: SparkSession, d: str) -> DataFrame:
    return trends.trend_alerts(baseline(Tables(spark, d))).select("group_type", "group_value", "metric", "month", "message")


@query
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    """Groups by the eight detectors, the model families being the plain numbers of `given`."""
    t = Tables(spark, d)
    groups = {g: c for g, c in trends.GROUPS.items() if g != "STATE_SECTOR"}
    e = given_detectors(t)
    rows = t.profile
    for part in e:
        rows = rows.join(part, "work_id", "left")
    flags = {
        "top_anomaly": F.col("odd") >= 90,
        "duplicate_review": F.col("duplicate_code") == "DUPLICATE_REVIEW_CANDIDATE",
        "payment_evidence": F.col("signals") > 0,
        "persistent_gap": F.col("persistent_gap"),
        "overdue": F.col("overdue_days") > 0,
        "over_sanction": F.col("overrun") > 0,
        "compliance_review": F.col("review_count") > 0,
        "non_compliant": F.col("non_compliant_count") > 0,
    }
    got = trends.hotspots(rows, flags, 20, groups).drop("non_compliant_share")
    return got.withColumns({f"{n}_share": fixed(f"{n}_share", 6) for n in flags if n != "non_compliant"})


def given_detectors(t: Tables) -> list[DataFrame]:
    odd, duplicates, _ = given_models(t)
    found = signals.payment_signals(t.profile, t.payments, AS_OF).groupBy("work_id").agg(F.count("*").alias("signals"))
    rules = signals.rule_summary(signals.rule_evidence(t.profile, t.assets, AS_OF)).select("work_id", "review_count", "non_compliant_count")
    return [odd, duplicates.select("work_id", "duplicate_code"), found, funds(t).select("work_id", "persistent_gap"), rules]


@query
def trend_context(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    got = trends.trend_context(t.works, durable(baseline(t)), AS_OF)
    return got.select("work_id", "trend_group", "trend_metric", fixed("trend_z", 4).alias("trend_z"), "trend_flagged", fixed("trend_strength", 4).alias("trend_strength"))


# Fusion


WARNED_BY = ["payment_count", "released_total", "spend_ratio", "planned_days"]


def overrun_warning(t: Tables) -> DataFrame:
    """work_id, probability, status of works in execution, from completed ones at landmarks before their end."""
    ended = signals.outcomes_of_completed(t.profile, t.assets, AS_OF).select("work_id", "finished_on", "overran")
    rows = models.landmark_rows(t.works, t.payments).join(ended, "work_id").where("landmark < finished_on").join(t.profile.select("work_id", "planned_days"), "work_id")
    return models.guarded_probability(models.split(rows, "overran"), t.profile.where("lifecycle = 'EXECUTION'"), WARNED_BY, "overran")


class Evidence:
    """What the fusion policies read, each part written once, when it is first asked for; the three model families are given.

    odd has work_id, odd; duplicates work_id, duplicate_score, duplicate_code of works that
    were compared; warned work_id, serving_percentile, status.
    """

    def __init__(self, t: Tables, odd: DataFrame, duplicates: DataFrame, warned: DataFrame):
        self.tables = t
        self.profile, self.assets, self.odd, self.duplicates, self.warned = t.profile, t.assets, odd, duplicates, warned

    @functools.cached_property
    def signals(self) -> DataFrame:
        """The signals of each work; no policy asks which payment gave one, and its id is half of a row."""
        return durable(signals.payment_signals(self.profile, self.tables.payments, AS_OF).drop("payment_id"))

    @functools.cached_property
    def rules(self) -> DataFrame:
        return durable(signals.rule_evidence(self.profile, self.assets, AS_OF))

    @functools.cached_property
    def funds(self) -> DataFrame:
        return durable(funds(self.tables))

    @functools.cached_property
    def peers(self) -> DataFrame:
        return durable(peers.peer_summary(peers.peer_evidence(self.profile, ["released_total", "planned_days"])))

    @functools.cached_property
    def trend(self) -> DataFrame:
        return trends.trend_context(self.tables.works, durable(baseline(self.tables)), AS_OF)

    def wide(self) -> DataFrame:
        """Scores, codes and availability of the eight families, one row per work."""
        p = self.profile
        wide = p.select("work_id", "lifecycle")
        together(p.sparkSession, lambda: self.peers, lambda: self.signals, lambda: self.funds, lambda: self.rules, lambda: self.trend)
        families = together(p.sparkSession, lambda: fusion.peer_family(self.peers), lambda: fusion.payment_family(p, self.signals, self.funds), lambda: fusion.observed_family(p))
        for part in (self.odd, self.duplicates, *families, fusion.compliance_family(self.rules), self.trend, self.warned):
            wide = wide.join(part, "work_id", "left")
        execution = F.col("lifecycle") == "EXECUTION"
        named = {
            "ANOMALY": (F.col("odd"), F.lit("LIFECYCLE_ANOMALY_PERCENTILE"), F.col("odd").isNotNull()),
            "PEER_DEVIATION": (F.col("peer_score"), F.col("peer_code"), F.col("peer_score").isNotNull()),
            "DUPLICATE_REVIEW": (F.coalesce("duplicate_score", F.lit(0.0)), F.coalesce("duplicate_code", F.lit("NO_DUPLICATE_REVIEW_CANDIDATE")), F.col("duplicate_code").isNotNull()),
            "PAYMENT_EXECUTION": (F.col("payment_score"), F.col("payment_code"), F.col("payment_available")),
            "OBSERVED_CONDITIONS": (F.col("observed_score"), F.col("observed_code"), execution),
            "COMPLIANCE": (F.col("compliance_score"), F.col("compliance_code"), F.col("compliance_score").isNotNull()),
            "COST_OVERRUN_PREDICTION": (F.coalesce("serving_percentile", F.lit(0.0)), F.when(execution, F.col("status")).otherwise("NOT_APPLICABLE_STAGE"), execution & F.col("serving_percentile").isNotNull()),
            "OPERATIONAL_TREND_CONTEXT": (F.col("trend_strength"), F.when(F.col("trend_flagged"), "OPERATIONAL_TREND_DEVIATION").otherwise("NO_OPERATIONAL_TREND_DEVIATION"), F.col("trend_z").isNotNull()),
        }
        columns = [F.col(c) for c in ("work_id", "lifecycle")]
        for name, (score, code, there) in named.items():
            columns += [fixed(score, 6).alias(f"{name}_score"), code.alias(f"{name}_code"), there.alias(f"{name}_available")]
        return durable(wide.select(*columns))

    def facts(self, reported: DataFrame) -> DataFrame:
        """What the second profile reads; reported has the work_id of works with a report of the current month.

        The tables have no coordinates, so no location asks for a review.
        """
        p = self.profile
        together(p.sparkSession, lambda: self.signals, lambda: self.peers, lambda: self.funds)
        chron = self.signals.where("signal_code = 'PAYMENT_AUTH_BEFORE_REQUEST'").select("work_id", F.lit(True).alias("payment_chronology_review")).distinct()
        records = signals.record_status(self.assets, p, AS_OF).where("closure_requires_review").select("work_id", F.lit(True).alias("completion_records_review"))
        deviation = stats.percentile_inclusive(self.peers.select("work_id", "max_deviation"), [], "max_deviation", "deviation_pct").select("work_id", "deviation_pct")
        duplicates = self.duplicates.select("work_id", F.col("duplicate_score").alias("best_duplicate"), (F.col("duplicate_code") == "DUPLICATE_REVIEW_CANDIDATE").alias("duplicate_work_candidate"))
        rows = p.select("work_id", "lifecycle", (F.col("final_spend") > F.col("sanctioned")).alias("observed_cost_overrun"), ((F.col("lifecycle") == "EXECUTION") & (F.col("overdue_days") > 0)).alias("observed_delay"), (F.col("sanctioned_on").isNotNull() & (F.col("released_total") > F.col("sanctioned"))).alias("release_above_visible_sanction"), F.lit(False).alias("location_requires_review"))
        for part in (self.odd, deviation, duplicates, self.warned.select("work_id", "serving_percentile"), self.funds.select("work_id", "fund_gap"), chron, records, reported.select("work_id", F.lit(True).alias("reported__")).distinct()):
            rows = rows.join(part, "work_id", "left")
        return rows.withColumn("missing_monthly_site_evidence", (F.col("lifecycle") == "EXECUTION") & F.col("reported__").isNull()).drop("reported__")


def modelled(t: Tables) -> Evidence:
    """Evidence with the isolation forest, the compared records and the guarded model."""
    t._profile = durable(t.profile)

    def odd() -> DataFrame:
        return stats.percentile_exclusive(durable(models.isolation_forest(t.profile, METRICS)), ["lifecycle"], "anomaly_score", "odd").select("work_id", "odd")

    def warned() -> DataFrame:
        rows = durable(overrun_warning(t)).withColumn("lifecycle", F.lit("EXECUTION"))
        return models.serving_rank(rows, "probability").select("work_id", "serving_percentile", "status")

    def duplicates() -> DataFrame:
        return fusion.duplicate_family(register.summary(t.spark, t.sf_dir))

    return Evidence(t, *together(t.spark, odd, duplicates, warned))


def given_models(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plain numbers for the three model families, so that SQL can follow the policies.

    The percentile of planned days, a candidate for each work whose id is divisible by 97,
    and the percentile of the share spent.
    """
    p = t._profile = durable(t.profile)
    odd = stats.percentile_exclusive(p.select("work_id", "lifecycle", "planned_days"), ["lifecycle"], "planned_days", "odd").select("work_id", "odd")
    candidate = F.col("work_id") % 97 == 0
    compared = p.select("work_id", F.when(candidate, 90.0 + F.col("work_id") % 10).otherwise(0.0).alias("duplicate_score"), F.when(candidate, "DUPLICATE_REVIEW_CANDIDATE").when(F.col("work_id") % 3 != 0, "NO_DUPLICATE_REVIEW_CANDIDATE").alias("duplicate_code"))
    warned = models.serving_rank(p.select("work_id", "lifecycle", "spend_ratio"), "spend_ratio").select("work_id", "serving_percentile", F.lit("SECONDARY_EARLY_WARNING").alias("status"))
    return odd, compared, warned


def given(t: Tables) -> Evidence:
    """Evidence with the plain numbers of `given_models`."""
    return Evidence(t, *given_models(t))


def wide_signals(t: Tables, evidence: Callable[[Tables], Evidence] = modelled) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(wide families, funds, payment signals, rule evidence) of all works."""
    e = evidence(t)
    return e.wide(), e.funds, e.signals, e.rules


def second_profile(t: Tables, evidence: Callable[[Tables], Evidence]) -> DataFrame:
    reported = t.progress.where(F.trunc("report_date", "month") == F.trunc(F.lit(EVENTS_AS_OF).cast("date"), "month"))
    return durable(fusion.wide_v2(evidence(t).facts(reported)))


@query
def family_signals(spark: SparkSession, d: str) -> DataFrame:
    return fusion.family_evidence(wide_signals(Tables(spark, d))[0]).select("work_id", "family", fixed("score", 4).alias("score"), "code", "available")


@query
def contributions(spark: SparkSession, d: str) -> DataFrame:
    return fusion.family_evidence(wide_signals(Tables(spark, d))[0]).select("work_id", "lifecycle", "family", "weight", fixed("points", 3).alias("points"))


def scores(t: Tables) -> DataFrame:
    return fusion.priority_scores(fusion.family_evidence(wide_signals(t)[0]))


@query
def priority_scores(spark: SparkSession, d: str) -> DataFrame:
    got = fusion.ranked(scores(Tables(spark, d)))
    return got.select("work_id", "lifecycle", fixed("score", 3).alias("score"), "coverage", "band", "top_family_1", "rank", "rank_in_stage")


@query
def priority_queue(spark: SparkSession, d: str) -> DataFrame:
    return fusion.priority_queue(fusion.ranked(scores(Tables(spark, d)))).select("work_id", "lifecycle", fixed("score", 3).alias("score"), "band")


@query
def review_alerts(spark: SparkSession, d: str) -> DataFrame:
    return fusion.review_alerts(*wide_signals(Tables(spark, d))).select("work_id", "alert_type", "evidence_code", fixed("strength", 3).alias("strength"))


@query
def alert_summary(spark: SparkSession, d: str) -> DataFrame:
    return fusion.alert_summary(fusion.review_alerts(*wide_signals(Tables(spark, d))))


@query
def authority_summary(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return fusion.authority_summary(scores(t), t.profile).withColumn("mean_score", fixed("mean_score", 2))


@query
def policy_contributions(spark: SparkSession, d: str) -> DataFrame:
    got = fusion.family_evidence(wide_signals(Tables(spark, d), given)[0])
    return got.select("work_id", "lifecycle", "family", fixed("score", 4).alias("score"), "code", "available", "weight", fixed("points", 3).alias("points"))


@query
def policy_scores(spark: SparkSession, d: str) -> DataFrame:
    got = fusion.ranked(fusion.priority_scores(fusion.family_evidence(wide_signals(Tables(spark, d), given)[0])))
    return got.select("work_id", "lifecycle", fixed("score", 3).alias("score"), "coverage", "band", "top_family_1", "rank", "rank_in_stage")


@query
def policy_alerts(spark: SparkSession, d: str) -> DataFrame:
    return fusion.review_alerts(*wide_signals(Tables(spark, d), given)).select("work_id", "alert_type", "evidence_code", fixed("strength", 3).alias("strength"))


@query
def policy_authority_summary(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    got = fusion.priority_scores(fusion.family_evidence(wide_signals(t, given)[0]))
    return fusion.authority_summary(got, t.profile).withColumn("mean_score", fixed("mean_score", 2))


@query
def policy_v2_scores(spark: SparkSession, d: str) -> DataFrame:
    return fusion.priority_v2(second_profile(Tables(spark, d), given)).withColumn("score", fixed("score", 3))


@query
def policy_v2_alerts(spark: SparkSession, d: str) -> DataFrame:
    return fusion.alerts_v2(second_profile(Tables(spark, d), given))


@query
def v2_priority(spark: SparkSession, d: str) -> DataFrame:
    return fusion.priority_v2(second_profile(Tables(spark, d), modelled)).withColumn("score", fixed("score", 3))


@query
def v2_alerts(spark: SparkSession, d: str) -> DataFrame:
    return fusion.alerts_v2(second_profile(Tables(spark, d), modelled))


# Geography and calendar


@query
def working_days(spark: SparkSession, d: str) -> DataFrame:
    w = domain.works(spark, d)
    return w.select("work_id", F.element_at(scalar.first_working_days("recommended_on", 3), 3).alias("third_working_day"), scalar.add_working_days("recommended_on", 5).alias("fifth_after"))


@query
def evidence_status(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.progress(spark, d).groupBy("work_id").agg(F.min("report_date").alias("captured_on"), F.max("report_date").alias("latest_on"))
    late = F.when(F.dayofmonth("captured_on") % 2 == 0, F.col("captured_on"))
    today = F.lit("2024-01-04").cast("date")
    return rows.select("work_id", scalar.monthly_evidence(late, F.lit("2024-01-01").cast("date"), today).alias("monthly"), scalar.completion_evidence("captured_on", "latest_on", today).alias("completion"), (F.col("captured_on") > F.lit("2024-01-03").cast("date")).alias("late"))


@query
def haversine_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % 160 - 80).cast("double").alias("lat"), (F.col("s_suppkey") * 91 % 340 - 170).cast("double").alias("lon"))
    other = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    metres = scalar.haversine("lat", "lon", "lat2", "lon2")
    return s.join(other, "s_suppkey").select("s_suppkey", fixed(metres / 1000, 3).alias("km"), scalar.location_status(metres).alias("status"))


# Serving


def served(t: Tables) -> DataFrame:
    """Scores by a cheap deterministic proxy joined with the profile, for the serving queries."""
    pct = F.least(F.lit(100.0), F.coalesce(F.col("spend_ratio"), F.lit(0.0)) * 20)
    return t.profile.withColumn("score", fixed(pct, 4)).withColumn("band", scalar.band("score"))


@query
def scoped_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = served(Tables(spark, d))
    got = serving.queue(rows, serving.scope("STATE", state="ASIA"), {"lifecycle": "EXECUTION"}, "nation", ("district", "sector"), "score")
    return serving.page(got, 1, 25).select("work_id", "district", "sector", "score", "band")


@query
def overview(spark: SparkSession, d: str) -> DataFrame:
    return serving.overview(served(Tables(spark, d)))


@query
def comparison(spark: SparkSession, d: str) -> DataFrame:
    return serving.comparison(served(Tables(spark, d)), "state")


@query
def fund_flow(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return serving.fund_flow(t.works, t.payments.where("is_released"))


@query
def precheck_costs(spark: SparkSession, d: str) -> DataFrame:
    return serving.precheck_costs(domain.works(spark, d)).withColumns({"peer_median": fixed("peer_median", 2), "peer_q75": fixed("peer_q75", 2)})


@query
def work_dossier(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    alerts = signals.payment_signals(t.profile, t.payments, AS_OF).select("work_id", F.col("signal_code").alias("alert_type"), F.col("severity").alias("evidence_code"), F.lit(1.0).alias("strength")).distinct()
    return serving.dossier(t.profile, features.released(t.payments, AS_OF), alerts)


@query
def latest_status(spark: SparkSession, d: str) -> DataFrame:
    return serving.latest_status(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


# The workflow's events by type of event; where a type has several, event_id picks one.
STEPS = {"view": ("submit", "progress"), "click": ("review",), "signup": ("accept",), "purchase": ("sanction", "pay", "complete"), "error": ("clarify",)}


@query
def workflow_fold(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[x for kind, steps in STEPS.items() for x in (F.lit(kind), F.array(*[F.lit(s) for s in steps]))])
    steps = F.element_at(names, F.col("event_type"))
    log = table(spark, d, "events").select("user_id", "ts", "event_id", F.get(steps, F.pmod(F.col("event_id"), F.size(steps)).cast("int")).alias("event"))
    return serving.workflow_fold(log, "user_id", "event", ["ts", "event_id"])


# Retrieval


@query
def retrieve_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    got = serving.cosine_topk(e.where("id % 20 = 0"), e, 5)
    return got.select("query_id", "chunk_id", fixed("score", 4).alias("score"))


@query
def evidence_select(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    rules = signals.rule_evidence(t.profile, t.assets, AS_OF).where("result <> 'NOT_APPLICABLE'").select("work_id", (F.col("result") == "NON_COMPLIANT").alias("mandatory"), F.when(F.col("result") == "REVIEW", 2.0).otherwise(1.0).alias("points"), F.col("rule_id").alias("family_order"))
    return serving.evidence_selection(rules, 4).select("work_id", F.col("family_order").alias("rule_id"), "place")


@query
def budget_trim(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("chars"))
    got = serving.within_budget(docs, 20_000, "source", [F.col("chars"), F.col("doc_id")], F.col("chars"))
    return got.select("doc_id", "source", "used")


@query
def grounding_check(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    answers = docs.select(F.col("doc_id").alias("id"), F.array(F.concat(F.lit("C"), F.col("doc_id") % 5), F.col("lang")).alias("codes"), F.when(F.col("doc_id") % 10 == 0, "a fraud").otherwise("a note").alias("text"))
    known = docs.select(F.col("doc_id").alias("id"), F.array(F.lit("C1"), F.lit("C2"), F.lit("en")).alias("codes"))
    return serving.grounding_faults(answers, known)


@query
def chapter_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    return serving.carried_chapters(chunks, r"^(Th[a-z]+)").select("doc", "page", "chapter")


@query
def explanations(spark: SparkSession, d: str) -> DataFrame:
    return serving.explanation(scores(Tables(spark, d)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.priority_queue(fusion.ranked(scores(Tables(spark, sf_dir))))


def queries() -> dict[str, Query]:
    from worksight.plans import prediction, retrieval, texts, desk, cases, flows, evidence  # noqa: F401  register their queries, in the order in which their SQL builds

    return dict(REGISTERED)


def oracle_sql() -> dict[str, str]:
    from worksight.plans import prediction, retrieval, texts, desk, cases, flows, evidence

    return {name: text for name, text in sql.all_sql(cases.SQL | evidence.SQL | flows.SQL | desk.SQL | texts.SQL | prediction.SQL | retrieval.SQL).items() if name in REGISTERED}
