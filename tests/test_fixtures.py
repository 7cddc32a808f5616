"""Operators on hand-made rows with known answers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from worksight.functions import scalar, stats
from worksight.operators import checks, features, fusion, models, pairs, serving, signals, trends

D = dt.date.fromisoformat
AS_OF = "2026-09-01"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def date(text):
    return F.lit(text).cast("date")


@pytest.fixture(scope="module")
def payments(spark):
    rows = [
        ("W", "P-1", 1, D("2026-01-05"), D("2026-01-04"), D("2026-01-02"), 0, 1, True, "DUP"),
        ("W", "P-2", 1, D("2026-01-02"), D("2026-01-02"), D("2026-01-03"), 150, 2, False, "DUP"),
        ("W", "P-10", 2, D("2026-01-02"), D("2026-01-02"), D("2026-01-03"), 25, 10, True, "P10"),
        ("W", "P-F", 2, D("2026-01-01"), D("2026-01-01"), D("2027-01-01"), 999, 3, False, "FUT"),
    ]
    return spark.createDataFrame(rows, "work_id string, payment_id string, vendor_id long, requested_on date, authorized_on date, released_on date, amount long, stage int, is_final boolean, reference string").withColumn("is_released", F.lit(True))


def test_payment_signals(spark, payments):
    profile = spark.createDataFrame([("W", D("2026-01-01"), 175, 100, D("2025-06-01"))], "work_id string, completed_on date, released_total long, sanctioned long, sanctioned_on date")
    found = signals.payment_signals(profile, payments, AS_OF)
    counts = {r.signal_code: r.n for r in found.groupBy("signal_code").agg(F.count("*").alias("n")).collect()}
    assert counts == {"PAYMENT_AFTER_COMPLETION": 3, "PAYMENT_AFTER_FINAL_PAYMENT": 2, "PAYMENT_AUTH_BEFORE_REQUEST": 1, "PAYMENT_RELEASE_BEFORE_AUTH": 1, "ZERO_VALUE_RELEASED_PAYMENT": 1, "DUPLICATE_PFMS_REFERENCE": 1, "MULTIPLE_FINAL_PAYMENTS": 1, "RELEASED_TOTAL_EXCEEDS_SANCTION": 1}
    assert signals.signal_summary(profile, found).first().signal_count == 11
    order = [r.payment_id for r in features.released(payments, AS_OF).orderBy(*features.payment_order()).collect()]
    assert order == ["P-1", "P-2", "P-10"]


def test_payments_as_of(payments):
    r = features.payments_as_of(payments, AS_OF).first()
    assert (r.payment_count, r.released_total, r.vendor_count, r.final_payment_count, r.zero_payment_count) == (3, 175, 2, 2, 1)
    assert r.largest_share == pytest.approx(150 / 175) and r.vendor_hhi == pytest.approx((150**2 + 25**2) / 175**2)


def progress(spark, gaps):
    rows = [("W", i, D("2026-01-01") + dt.timedelta(days=i), 10.0, 10.0 + g) for i, g in enumerate(gaps)]
    return spark.createDataFrame(rows, "work_id string, progress_id int, report_date date, physical double, financial double")


def test_gap_runs(spark):
    r = signals.gap_runs(progress(spark, [30, 40, 0, 26, 27, 28])).first()
    assert (r.flagged, r.longest_run, r.latest_run, r.latest_gap) == (5, 3, 3, 28.0)
    r = signals.gap_runs(progress(spark, [30, 40, 0])).first()
    assert (r.longest_run, r.latest_run) == (2, 0)


@pytest.mark.parametrize("x, med, mad, iqr, want, method", [(12, 10, 2, 5, 0.6745, "MODIFIED_Z_MAD"), (12, 10, 0, 4, 2 / (4 / 1.349), "STANDARDIZED_IQR_FALLBACK"), (12, 10, 0, 0, None, "UNAVAILABLE_CONSTANT_PEER_DISTRIBUTION")])
def test_robust_deviation(spark, x, med, mad, iqr, want, method):
    args = [F.lit(float(v)) for v in (x, med, mad, iqr)]
    got = value(spark, stats.robust_deviation(*args))
    assert got is None if want is None else got == pytest.approx(want)
    assert value(spark, stats.robust_method(*args)) == method


def series(spark, values, counts):
    rows = [("G", "g", "m", D(f"2026-{i + 1:02d}-01"), float(v), n) for i, (v, n) in enumerate(zip(values, counts))]
    return spark.createDataFrame(rows, "group_type string, group_value string, metric string, month date, value double, events long")


def test_causal_baseline(spark):
    last = lambda v, n: trends.causal_baseline(series(spark, v, n)).orderBy(F.desc("month")).first()
    r = last([1, 2, 3, 4, 5, 6, 10000], [10] * 7)
    assert (r.baseline_months, r.median, r.method, r.flagged) == (6, 3.5, "MAD", True) and r.p90 < 10000
    r = last([1, 1, 1, 100], [10] * 4)
    assert (r.status, r.robust_z) == ("INSUFFICIENT_PRIOR_MONTHS", None)
    r = last([1, 2, 3, 4, 5], [1, 1, 1, 1, 100])
    assert (r.support, r.status, r.flagged) == (4, "INSUFFICIENT_HISTORICAL_EVENT_SUPPORT", False)
    assert last([1, 1, 1, 1, 2, 3, 9], [10] * 7).method == "IQR_FALLBACK"
    assert last([5] * 7, [10] * 7).method == "CONSTANT_BASELINE_NO_DEVIATION"
    ewma = trends.monthly_ewma(series(spark, [1, 2, 3, 4, 5, 6, 10000], [10] * 7)).orderBy(F.desc("month")).first().ewma
    assert ewma == pytest.approx(3002.841181, abs=1e-6)


def test_similarities(spark):
    assert value(spark, scalar.amount_similarity(F.lit(80), F.lit(100))) == pytest.approx(0.8)
    assert value(spark, scalar.amount_similarity(F.lit(0), F.lit(0))) == 1.0
    assert value(spark, scalar.amount_similarity(F.lit(None).cast("long"), F.lit(1))) is None
    assert value(spark, scalar.haversine(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0))) is None
    assert value(spark, scalar.haversine(F.lit(95.0), F.lit(1.0), F.lit(1.0), F.lit(1.0))) is None
    assert value(spark, scalar.location_status(scalar.haversine(F.lit(20.0), F.lit(80.0), F.lit(20.0005), F.lit(80.0005)))) == "LOCATION_CONSISTENT"
    assert value(spark, scalar.location_status(scalar.haversine(F.lit(20.0), F.lit(80.0), F.lit(20.02), F.lit(80.02)))) == "LOCATION_REQUIRES_REVIEW"
    parts = dict(zip(pairs.PAIR_WEIGHTS, [F.lit(float(v)) for v in (0.9, 0.8, 0.7, 0.6, 1, 1, 0)]))
    assert value(spark, pairs.pair_score(parts)) == pytest.approx(81.5)


PAIR = {"score": 93.0, "text": 0.98, "same_district": True, "same_block": True, "same_village": True, "km": 0.5, "amount": 0.95, "days": 60, "same_sector": True, "same_sub_sector": True}


def test_review_policy(spark):
    reasons = lambda **x: spark.range(1).select(*[F.lit(v).alias(k) for k, v in (PAIR | x).items()]).select(pairs.review_reasons().alias("r")).first().r
    assert reasons() == []
    for k, v in {"score": 89.99, "text": 0.969, "same_district": False, "same_block": False, "same_village": False, "km": 1.01, "amount": 0.899, "days": 121, "same_sector": False, "same_sub_sector": False}.items():
        assert len(reasons(**{k: v})) == 1


WORK = {"lifecycle": "COMPLETION", "sanction_days": 31, "sanctioned": 30_000_000, "planned_days": 333}
ASSET = {"completed_on": "2026-08-31", "marked_on": "2026-08-31", "final_spend": 1, "public_use_on": "2026-09-01", "handover_on": "2026-09-01", "certificate_on": "2026-09-01", "register_entry": "Yes", "certificate_status": "Submitted", "photo": "PHOTO-1"}
CASES = [
    ("SANCTION_WITHIN_45_DAYS", {}, {}, "PASS"), ("SANCTION_WITHIN_45_DAYS", {"sanction_days": 59}, {}, "REVIEW"), ("SANCTION_WITHIN_45_DAYS", {"lifecycle": "PRE_SANCTION"}, {}, "NOT_APPLICABLE"), ("SANCTION_WITHIN_45_DAYS", {"sanction_days": None}, {}, "INSUFFICIENT_EVIDENCE"),
    ("MINIMUM_SANCTION", {"sanctioned": 24_999_900}, {}, "REVIEW"), ("MINIMUM_SANCTION", {"sanctioned": None}, {}, "INSUFFICIENT_EVIDENCE"), ("PLAN_WITHIN_ONE_YEAR", {"planned_days": 424}, {}, "REVIEW"), ("PLAN_WITHIN_ONE_YEAR", {"planned_days": None}, {}, "INSUFFICIENT_EVIDENCE"),
    ("PUBLIC_USE", {}, {}, "PASS"), ("PUBLIC_USE", {}, {"public_use_on": "2026-09-02"}, "REVIEW"), ("PUBLIC_USE", {"lifecycle": "EXECUTION"}, {}, "NOT_APPLICABLE"), ("PUBLIC_USE", {}, None, "INSUFFICIENT_EVIDENCE"),
    ("COMPLETION_PHOTO", {}, {"photo": ""}, "NON_COMPLIANT"), ("COMPLETION_PHOTO", {}, {}, "PASS"), ("HANDOVER", {}, {"handover_on": "2026-09-02"}, "REVIEW"), ("HANDOVER", {}, {}, "PASS"),
    ("ASSET_REGISTER", {}, {}, "PASS"), ("ASSET_REGISTER", {}, {"register_entry": "Pending"}, "REVIEW"), ("ASSET_REGISTER", {}, {"register_entry": "No"}, "NON_COMPLIANT"), ("ASSET_REGISTER", {}, {"handover_on": "2026-09-02"}, "NOT_APPLICABLE"), ("ASSET_REGISTER", {}, {"register_entry": None}, "INSUFFICIENT_EVIDENCE"),
    ("UTILISATION_CERTIFICATE", {}, {}, "PASS"), ("UTILISATION_CERTIFICATE", {}, {"certificate_status": "Pending", "certificate_on": None}, "REVIEW"), ("UTILISATION_CERTIFICATE", {}, {"certificate_status": None}, "INSUFFICIENT_EVIDENCE"),
]


def test_rules(spark):
    works, assets = [], []
    for i, (_, w, a, _) in enumerate(CASES):
        works.append((i, *(WORK | w).values()))
        if a is not None:
            assets.append((i, *(ASSET | a).values()))
    profile = spark.createDataFrame(works, "work_id long, lifecycle string, sanction_days int, sanctioned long, planned_days int")
    names = list(ASSET)
    raw = spark.createDataFrame(assets, "work_id long, " + ", ".join(f"{n} {'long' if n == 'final_spend' else 'string'}" for n in names))
    table = raw.withColumns({n: F.col(n).cast("date") for n in names if n.endswith("_on")})
    evidence = signals.rule_evidence(profile, table, AS_OF)
    got = {(r.work_id, r.rule_id): r.result for r in evidence.collect()}
    assert len(got) == 8 * len(CASES)
    for i, (rule, _, _, want) in enumerate(CASES):
        assert got[i, rule] == want, CASES[i]


def test_bands_ratios_calendar(spark):
    bands = {0: "LOW", 24.999: "LOW", 25: "MEDIUM", 49.999: "MEDIUM", 50: "HIGH", 74.999: "HIGH", 75: "CRITICAL", 100: "CRITICAL"}
    assert {k: value(spark, scalar.band(F.lit(float(k)))) for k in bands} == bands
    assert [value(spark, scalar.safe_ratio(F.lit(10), F.lit(d))) for d in (2, 0, -1)] == [5.0, None, None]
    assert value(spark, scalar.first_working_days(date("2026-09-15"), 3)) == [D("2026-09-01"), D("2026-09-02"), D("2026-09-03")]
    status = lambda today: value(spark, scalar.monthly_evidence(F.lit(None).cast("date"), date("2026-09-01"), date(today)))
    assert (status("2026-09-02"), status("2026-09-05"), status("2026-08-20")) == ("DUE", "OVERDUE", "UPCOMING")
    assert value(spark, scalar.completion_evidence(date("2026-08-28"), date("2026-09-02"), date("2026-09-05"))) == "RECORDED"
    assert value(spark, scalar.add_working_days(date("2026-09-04"), 1)) == D("2026-09-07")
    assert [value(spark, scalar.money_text(F.lit(v))) for v in (25_000_000, 250_000, 99)] == ["2.50 crore", "2.50 lakh", "99"]
    assert value(spark, scalar.normalized_text(F.lit("  Road_work -- Phase II (new)! "))) == "road work phase ii new"


def test_percentiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None), ("b", 7.0)], "k string, v double")
    got = sorted((r.k, r.v or 0, r.p) for r in stats.percentile_exclusive(df, ["k"], "v", "p").collect())
    assert got == [("a", 0, None), ("a", 1.0, 0.0), ("a", 2.0, 75.0), ("a", 2.0, 75.0), ("b", 7.0, 100.0)]
    got = sorted((r.k, r.v or 0, r.p) for r in stats.percentile_inclusive(df, ["k"], "v", "p").collect() if r.v)
    assert got == [("a", 1.0, pytest.approx(100 / 3)), ("a", 2.0, pytest.approx(250 / 3)), ("a", 2.0, pytest.approx(250 / 3)), ("b", 7.0, 100.0)]


def test_contributions_add_up(spark):
    names = [(f"{f}_score", 50.0 + i) for i, f in enumerate(fusion.FAMILIES)] + [(f"{f}_code", "C") for f in fusion.FAMILIES] + [(f"{f}_available", True) for f in fusion.FAMILIES]
    wide = spark.range(3).select(F.col("id").alias("work_id"), F.get(F.array(*[F.lit(s) for s in fusion.WEIGHTS]), F.col("id").cast("int")).alias("lifecycle"), *[F.lit(v).alias(n) for n, v in names])
    evidence = fusion.family_evidence(wide)
    scores = fusion.priority_scores(evidence)
    both = scores.join(evidence.groupBy("work_id").agg(F.sum("points").alias("total")), "work_id").collect()
    assert all(r.score == pytest.approx(r.total, abs=1e-5) and r.coverage == 100 and r.band == "HIGH" for r in both)
    assert all(sum(w.values()) == 100 for w in fusion.WEIGHTS.values())
    assert sum(fusion.WEIGHTS_V2["PRE_SANCTION"].values()) == 80


def test_landmarks_equal_the_snapshot(spark, payments):
    works = spark.createDataFrame([("W", 100, D("2026-01-01"), D("2026-01-09"))], "work_id string, sanctioned long, sanctioned_on date, expected_on date")
    for r in models.landmark_rows(works, payments).collect():
        snap = features.payments_as_of(payments, r.landmark.date().isoformat()).first()
        assert (r.payment_count, r.released_total) == ((snap.payment_count, snap.released_total) if snap else (0, 0))


def test_scopes_and_workflow(spark):
    with pytest.raises(serving.ScopeError):
        serving.scope("DISTRICT", state="A")
    with pytest.raises(serving.ScopeError):
        serving.queue(spark.range(1), F.lit(True), sort="name; drop")
    log = [(1, i, e) for i, e in enumerate(["submit", "review", "clarify", "review", "accept", "sanction", "pay", "complete"])] + [(2, 0, "accept"), (2, 1, "submit")]
    got = {r.id: r for r in serving.workflow_fold(spark.createDataFrame(log, "id long, n int, event string"), "id", "event", ["n"]).collect()}
    assert (got[1].state, got[1].refused) == ("COMPLETED", 0) and (got[2].state, got[2].refused) == ("RECOMMENDED", 1)


def test_grounding(spark):
    known = spark.createDataFrame([(1, ["A", "B"]), (2, ["A"])], "id long, codes array<string>")
    answers = spark.createDataFrame([(1, ["A"], "fine"), (2, ["Z"], "this is fraud"), (9, ["A"], "fine")], "id long, codes array<string>, text string")
    got = {(r.id, r.fault) for r in serving.grounding_faults(answers, known).collect()}
    assert got == {(2, "UNKNOWN_EVIDENCE_CODES"), (2, "PROHIBITED_VERDICT_LANGUAGE"), (9, "WORK_ID_MISMATCH"), (9, "UNKNOWN_EVIDENCE_CODES")}


def test_checks(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "k long")
    assert tuple(checks.key_faults(df, ["k"]).first()) == (5, 1, 3, 2)
    r = checks.relationship(df, "k", spark.createDataFrame([(1,)], "id long"), "id", "x").first()
    assert (r.total, r.null_keys, r.matched, r.orphans, r.status) == (5, 1, 3, 1, "FAIL")


def test_isolation_forest_finds_the_odd_one(spark):
    rows = [(i, "EXECUTION", float(i % 10), float(i % 7)) for i in range(2000)] + [(9999, "EXECUTION", 500.0, -300.0), (10000, "COMPLETION", 1.0, None)]
    df = spark.createDataFrame(rows, "work_id long, lifecycle string, a double, b double")
    got = {r.work_id: r.anomaly_score for r in models.isolation_forest(df, ["a", "b"], trees=20, sample=64).collect()}
    assert len(got) == 2002 and got[9999] == max(v for k, v in got.items() if k != 10000) and all(0 < v <= 1 for v in got.values())
    again = {r.work_id: r.anomaly_score for r in models.isolation_forest(df.repartition(3), ["a", "b"], trees=20, sample=64).collect()}
    assert got == again


def test_neighbours_and_pair_summary(spark):
    import numpy as np

    v = np.random.default_rng(3).normal(size=(60, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    old, pairs.BLOCK = pairs.BLOCK, 16
    try:
        got = {(r.id, r.other): r.cosine for r in pairs.topk_neighbours(df, 4).collect()}
    finally:
        pairs.BLOCK = old
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.round(unit.astype(np.float32).astype(float) @ unit.astype(np.float32).astype(float).T, 4)
    for i in range(60):
        best = sorted((j for j in range(60) if j != i), key=lambda j: (-cos[i, j], j))[:4]
        assert sorted(round(got[i, j], 3) for a, j in got if a == i) == pytest.approx(sorted(cos[i, best]), abs=2e-3)
    rows = spark.createDataFrame([(1, 2, 90.0, True), (1, 3, 95.0, False), (2, 3, 90.0, True)], "a long, b long, score double, review boolean")
    got = {r.id: r for r in pairs.pair_summary(spark.range(1, 5), rows, "score", "review").collect()}
    assert (got[1].candidates, got[1].best, got[1].reviews, got[1].best_review) == (2, 3, 1, 2)
    assert (got[2].candidates, got[2].best, got[3].best, got[4].candidates, got[4].best) == (2, 1, 1, 0, None)


def test_text_normalization(spark):
    df = spark.createDataFrame([("ＲＯＡＤ  Straße_(No.１)!",), (None,)], "t string")
    assert [r.n for r in pairs.normalize_texts(df, "t", "n").collect()] == ["road strasse no 1", None]


def test_explanation_names_what_leads(spark):
    df = spark.createDataFrame([(7, "EXECUTION", 61.5, "HIGH", "COMPLIANCE", "ANOMALY", None)], "work_id long, lifecycle string, score double, band string, top_family_1 string, top_family_2 string, top_family_3 string")
    assert serving.explanation(df).first().text == "Work 7 is in EXECUTION with review priority 61.50 (HIGH). Leading evidence: COMPLIANCE, ANOMALY. A human decides."


def test_running_sums_and_last_values_over_ranges(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.randint(-5, 5), r.choice([None, None, f"h{i}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, v long, h string")
    got = {x.id: x for x in stats.cumulated(df.repartition(6), ["k"], [F.desc("id")], F.col("v"), "upto").collect()}
    seen = {x.id: x.last for x in stats.carried(df.repartition(6), ["k"], [F.col("id")], F.col("h"), "last").collect()}
    for i, k, _, _ in rows:
        assert got[i].upto == sum(v for j, q, v, _ in rows if q == k and j >= i)
        assert seen[i] == next((h for j, q, _, h in reversed(rows) if q == k and j <= i and h), None)
    whole = stats.cumulated(df, [], [F.col("id")], F.lit(1), "place").collect()
    assert sorted((x.id, x.place) for x in whole) == [(i, i + 1) for i in range(400)]
    assert stats.cumulated(df.where("false"), ["k"], [F.col("id")], F.lit(1), "place").count() == 0
