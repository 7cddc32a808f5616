"""Landmark states, snapshots, calibration and its slices against plain versions."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from worksight.operators import calibration, desk, landmarks

WORKS = "work_id long, sanctioned long, recommended_on date, sanctioned_on date, expected_on date, sector string, lifecycle string, completed_on date, final_spend long"
PAYMENTS = "work_id long, payment_id string, released_on date, requested_on date, authorized_on date, amount long, is_released boolean"
REPORTS = "work_id long, progress_id string, report_date date, physical double, financial double"
START = date(2020, 1, 1)


def histories(seed, n=40):
    r = random.Random(seed)
    day = lambda k: START + timedelta(days=k)
    works, paid, told, built = [], [], [], []
    for w in range(n):
        s, length = r.randint(0, 60), r.choice([0, 50, 101, 400])
        stage = r.choice(["COMPLETION", "EXECUTION", "PRE_SANCTION"])
        done = s + r.randint(1, 500)
        works.append((w, r.choice([0, 1000, 2500]), day(0), day(s) if r.random() < 0.9 else None, day(s + length), "x", stage, day(done) if stage == "COMPLETION" else None, r.choice([900, 2600])))
        for k in range(r.randint(0, 6)):
            on = s + r.randint(-10, 500)
            paid.append((w, f"p{k}", day(on), day(on - 3), day(on - r.randint(1, 5)), r.randint(0, 900), r.random() < 0.8))
        for k in range(r.randint(0, 6)):
            told.append((w, f"r{k}", day(s + r.choice([5, 5, 30, 60, 200])), float(r.randint(0, 100)), float(r.randint(0, 100))))
        if stage == "COMPLETION":
            built.append((w, day(done)))
    return works, paid, told, built


def plain_state(work, at, paid, told, built):
    p = [x for x in paid if x[0] == work[0] and x[6] and x[2] <= at]
    t = sorted((x for x in told if x[0] == work[0] and x[2] <= at), key=lambda x: (x[2], x[1]))
    drops = [a[3] - b[3] for a, b in zip(t, t[1:]) if b[3] < a[3]]
    total, largest = sum(x[5] for x in p), max((x[5] for x in p), default=0)
    span = (t[-1][2] - t[0][2]).days if t else 0
    ratio = lambda a, b: a / b if b and b > 0 else None
    return {
        "payment_count": len(p), "released_total": total, "largest_payment": largest, "mean_payment": ratio(total, len(p)), "largest_share": ratio(largest, total), "days_since_payment": (at - max(x[2] for x in p)).days if p else None,
        "expenditure_pct": ratio(total * 100, work[1]), "overrun": max(total - work[1], 0) if work[1] > 0 else None, "report_count": len(t), "last_physical": t[-1][3] if t else None, "last_financial": t[-1][4] if t else None,
        "reported_gap": t[-1][4] - t[-1][3] if t else None, "decrease_count": len(drops), "largest_decrease": max(drops, default=0.0), "velocity": (t[-1][3] - t[0][3]) / span * 30 if span > 0 else None, "asset_count": sum(b[0] == work[0] and b[1] <= at for b in built),
    }


def tables(spark, seed):
    works, paid, told, built = histories(seed)
    frames = [spark.createDataFrame(rows, schema).repartition(3) for rows, schema in ((works, WORKS), (paid, PAYMENTS), (told, REPORTS), (built, "work_id long, completed_on date"))]
    return (works, paid, told, built), frames


def test_state_at_landmarks_is_the_state_as_of_that_day(spark):
    (works, paid, told, built), (w, p, r, a) = tables(spark, 3)
    got = {(x.work_id, x.fraction): x for x in landmarks.landmark_state(w, p, r, a).collect()}
    planned = [x for x in works if x[3] and x[3] < x[4]]
    assert set(got) == {(x[0], f) for x in planned for f in landmarks.LANDMARKS}
    for x in planned:
        for f in landmarks.LANDMARKS:
            at = x[3] + timedelta(seconds=math.floor(f * 86400 * (x[4] - x[3]).days) // 86400 * 86400)
            for name, value in plain_state(x, at, paid, told, built).items():
                assert got[x[0], f][name] == (None if value is None else pytest.approx(value)), (x[0], f, name)
    ended = spark.createDataFrame([(x[0], x[7], 1) for x in works if x[7]], "work_id long, finished_on date, overran int")
    for x in landmarks.landmark_state(w, p, r, a, ended).collect():
        assert x.landmark.date() < x.finished_on and x.asset_count == 0
    assert landmarks.landmark_state(w.where("false"), p, r, a).count() == 0


def test_snapshots_of_the_second_profile(spark):
    (works, paid, told, _), (w, p, r, a) = tables(spark, 4)
    got = {x.work_id: x for x in landmarks.cost_snapshots(w, p, r, a, "2021-01-01").collect()}
    want = 0
    for x in works:
        at = date(2021, 1, 1) if x[6] == "EXECUTION" and x[3] else None
        if x[6] == "COMPLETION" and x[3]:
            at = min(x[3] + timedelta(days=int(max(60, (x[4] - x[3]).days) * 0.6)), x[7] - timedelta(days=30))
            at = at if at > x[3] else None
        assert (x[0] in got) == (at is not None)
        if at is None:
            continue
        want += 1
        row = got[x[0]]
        mine = [q for q in paid if q[0] == x[0] and q[2] <= at]
        reports = sorted((q for q in told if q[0] == x[0] and q[2] <= at), key=lambda q: (q[2], q[1]))
        assert (row.snapshot_on, row.payment_count, row.early_authorization) == (at, len(mine), any(q[4] < q[3] for q in mine))
        assert row.released_ratio == (pytest.approx(sum(q[5] for q in mine) / x[1]) if x[1] else None)
        velocity = (reports[-1][3] - reports[-2][3]) / max(1, (reports[-1][2] - reports[-2][2]).days) * 30 if len(reports) > 1 else None
        assert row.velocity == (None if velocity is None else pytest.approx(velocity))
        assert row.overran == (int(x[8] > x[1]) if x[6] == "COMPLETION" else None)
    assert want > 10


def scored(seed, n=400):
    r = random.Random(seed)
    return [(i, f, part, m, r.random() ** (2 if m == "a" else 1), int(r.random() < 0.4)) for i in range(n) for f in (0.25, 0.5) for part in [r.choice(["VALIDATION", "TEST"])] for m in "ab"]


def test_calibration_equals_a_plain_fit(spark):
    rows = [(x[4], x[5]) for x in scored(1)] + [(0.0, 1), (1.0, 0)]
    a, b = calibration.platt(spark.createDataFrame(rows, "s double, y int"), "s", "y")
    x = np.log(np.clip([s for s, _ in rows], 1e-6, 1 - 1e-6) / (1 - np.clip([s for s, _ in rows], 1e-6, 1 - 1e-6)))
    y = np.array([v for _, v in rows], float)
    p = 1 / (1 + np.exp(-(a * x + b)))
    assert abs(((p - y) * x).sum() + a) < 1e-6 and abs((p - y).sum()) < 1e-6  # the gradient of log-loss and penalty
    with pytest.raises(ValueError):
        calibration.platt(spark.createDataFrame([(0.1, 1)], "s double, y int"), "s", "y")


def test_slices_guard_against_one_class(spark):
    rows = [(i, f, part, m, "RAW", y if f < 0.5 else 1, s) for i, f, part, m, s, y in scored(2)]
    got = {(x.part, x.model, x.fraction): x for x in calibration.model_slices(spark.createDataFrame(rows, "work_id long, fraction double, part string, model string, kind string, label int, score double")).collect()}
    assert len(got) == 2 * 2 * 3
    for (part, model, fraction), x in got.items():
        own = [(s, y) for _, f, q, m, _, y, s in rows if q == part and m == model and fraction in (None, f)]
        assert x.rows == len(own) and x.prevalence == pytest.approx(sum(y for _, y in own) / len(own))
        if fraction == 0.5:
            assert (x.status, x.roc_auc, x.brier, x.calibration_error) == ("INSUFFICIENT_CLASSES_AT_LANDMARK", None, None, None)
            continue
        pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
        assert x.roc_auc == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg))
        assert x.brier == pytest.approx(sum((s - y) ** 2 for s, y in own) / len(own))
        bins = {}
        for s, y in own:
            bins.setdefault(min(int(s * 10), 9), []).append((s, y))
        assert x.calibration_error == pytest.approx(sum(abs(sum(s for s, _ in v) - sum(y for _, y in v)) for v in bins.values()) / len(own))


def test_site_evidence_by_working_days(spark):
    works = spark.createDataFrame([(1, "EXECUTION", None), (2, "EXECUTION", None), (3, "COMPLETION", date(2026, 8, 28)), (4, "COMPLETION", date(2026, 8, 28)), (5, "PRE_SANCTION", None), (6, "EXECUTION", None)], "work_id long, lifecycle string, completed_on date")
    works = works.withColumns({"latitude": F.lit(20.0), "longitude": F.lit(80.0)})
    rows = [(1, "a", date(2026, 9, 3), "MONTHLY_PROGRESS", 20.0005, 80.0005), (1, "b", date(2026, 8, 6), "MONTHLY_PROGRESS", 20.0, 80.0), (2, "c", date(2026, 9, 4), "MONTHLY_PROGRESS", 20.02, 80.02), (3, "d", date(2026, 9, 2), "COMPLETION", 20.0, 80.0), (4, "e", date(2026, 9, 3), "COMPLETION", None, None)]
    captures = spark.createDataFrame(rows, "work_id long, evidence_id string, captured_on date, stage string, latitude double, longitude double")
    got = {x.work_id: x for x in desk.geo_status(captures, works, "2026-09-05").collect()}
    assert [got[i].monthly_status for i in (1, 2, 6, 5)] == ["RECORDED", "OVERDUE", "OVERDUE", "NOT_APPLICABLE"]
    assert [got[i].completion_status for i in (3, 4, 1)] == ["RECORDED", "OVERDUE", "NOT_APPLICABLE"]
    assert [got[i].late for i in (1, 2, 6)] == [1, 1, 0] and [got[i].missing_month for i in (1, 2, 6)] == [False, False, True]
    assert [got[i].location_status for i in (1, 2, 6)] == ["LOCATION_CONSISTENT", "LOCATION_REQUIRES_REVIEW", "LOCATION_UNAVAILABLE"]
    due = {x.work_id: x.monthly_status for x in desk.geo_status(captures.where("false"), works, "2026-09-02").collect()}
    assert due[1] == "DUE"


def test_what_applies_and_what_fails_now(spark):
    profile = spark.createDataFrame([(1, "EXECUTION", 0, 0.5), (2, "EXECUTION", 9, 1.5), (3, "COMPLETION", None, 0.1), (4, "PRE_SANCTION", None, None)], "work_id long, lifecycle string, overdue_days int, spend_ratio double")
    got = {x.work_id: (x.delay, x.cost_overrun) for x in desk.applicability(profile, {"delay": True, "cost_overrun": False}).collect()}
    assert got == {1: ("PREDICTED_EARLY_WARNING_ELIGIBLE", "INSUFFICIENT_SUPERVISED_OUTCOME_DATA"), 2: ("OBSERVED_OVERDUE", "INSUFFICIENT_SUPERVISED_OUTCOME_DATA"), 3: ("OUTCOME_ALREADY_KNOWN",) * 2, 4: ("NOT_APPLICABLE_STAGE",) * 2}
    rows = spark.createDataFrame([(1, 1_234_500, 0 + 100, 10.0, 35.0, date(2020, 1, 1), False, True), (2, 5, 10, 30.0, 40.0, date(2020, 1, 1), True, None), (3, 5, None, None, 40.0, None, False, False)], "work_id long, released_total long, sanctioned long, physical double, financial double, expected_on date, finished boolean, early_authorization boolean")
    got = [(x.work_id, x.area, x.message) for x in desk.runtime_checks(rows, "2020-01-11").collect()]
    assert [x[1] for x in got] == ["Payments", "Payments & Progress", "Schedule", "Payment Dates"] and {x[0] for x in got} == {1}
    assert [x[2] for x in got[:3]] == ["Released payments are 12,344 above sanctioned cost.", "Financial and physical progress differ by 25.0 percentage points.", "Expected completion is overdue by 10 days."]
    reports = spark.createDataFrame([(1, "a", date(2020, 1, 1), 10.0), (1, "b", date(2020, 1, 11), 30.0), (2, "c", date(2020, 1, 1), 5.0)], "work_id long, progress_id string, report_date date, physical double")
    assert {x.work_id: x.velocity for x in desk.last_velocity(reports, ["report_date", "progress_id"]).collect()} == {1: 60.0, 2: None}
