"""Bundles, grounding and audits on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from worksight.operators import evidence, serving


def test_bundles_leave_out_what_is_empty(spark):
    works = spark.createDataFrame([(1, "EXECUTION"), (2, None)], "work_id long, lifecycle string")
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "c", 9)], "work_id long, code string, n long")
    told = evidence.listed(rows, "codes", [-F.col("n"), F.col("code")], "code", top=2)
    got = {x.work_id: json.loads(x.bundle) for x in evidence.bundle(works, told, evidence.listed(rows.where("false"), "none", [F.col("code")], "code")).collect()}
    assert got == {1: {"work_id": 1, "lifecycle": "EXECUTION", "codes": [{"code": "c"}, {"code": "a"}]}, 2: {"work_id": 2}}


def test_answers_must_stay_on_their_ground(spark):
    cited = "array<struct<chunk_id: string, page: long, clause: string>>"
    rows = [
        (1, 1, ["C1"], [("k", 3, "3.2")], "RULE-1 asks for a look"),
        (2, 9, ["C1", "C7"], [("z", 1, None)], "RULE-2 and RULE-1"),
        (3, 3, None, [("k", 9, "4.4"), ("k", None, " 5.1 ")], "He is GUILTY"),
        (4, 4, [], [], None),
        (5, 5, ["C1"], [("k", 2, "")], "fraud detected? proven misuse"),
    ]
    answers = spark.createDataFrame(rows, f"id long, work_id long, codes array<string>, cited {cited}, text string")
    known = spark.createDataFrame([(i, i, ["C1"], ["RULE-1"]) for i in (1, 2, 3, 5)], "id long, known_work long, known_codes array<string>, known_rules array<string>")
    chunks = spark.createDataFrame([("k", 2, 4, ["3.2"], "intro\n *5.1 Clause\nmore")], "chunk_id string, first_page long, last_page long, clauses array<string>, text string")
    got = {}
    for x in evidence.grounding_issues(answers, known, chunks).collect():
        got.setdefault(x.id, set()).add(x.issue)
    assert got == {2: {"WORK_ID_MISMATCH", "UNKNOWN_EVIDENCE_CODES", "UNKNOWN_CHUNK_ID", "INVENTED_COMPLIANCE_RULE"}, 3: {"UNSUPPORTED_PAGE", "UNSUPPORTED_CLAUSE", "PROHIBITED_VERDICT_LANGUAGE"}, 4: {"WORK_ID_MISMATCH"}, 5: {"PROHIBITED_VERDICT_LANGUAGE"}}


def test_strongest_peer(spark):
    rows = [(1, "m", 0, 5.0, 1.0, -4.0, 2, 30, "MAD"), (1, "k", 1, 5.0, 1.0, 4.0, 2, 30, "MAD"), (2, "m", 0, None, None, None, None, None, "x")]
    peers = spark.createDataFrame(rows, "work_id long, metric string, metric_order int, value double, median double, deviation double, level int, peers long, method string")
    got = {x.work_id: (x.metric, x.deviation, x.outliers) for x in evidence.with_strongest_peer(spark.createDataFrame([(1, 0.5), (2, 0.1)], "work_id long, s double"), peers).collect()}
    assert got == {1: ("m", -4.0, 2), 2: (None, None, 0)}


def test_audits(spark):
    got = evidence.confusion(spark.createDataFrame([(0.5, 1), (0.5, 0), (0.1, 1), (0.1, 0), (0.9, 1)], "s double, y int"), "s", "y", 0.5, []).first()
    assert (got.true_positive, got.false_positive, got.false_negative, got.true_negative) == (2, 1, 1, 1) and got.f1 == pytest.approx(2 / 3)
    groups = spark.createDataFrame([(1, "g"), (2, "g"), (3, "g"), (4, None), (5, "h")], "work_id long, group_id string")
    told = evidence.known_pairs(groups, spark.createDataFrame([(3, 1), (4, 5)], "a long, b long")).first()
    assert (told.known, told.retrieved) == (2, 1)
    works = spark.createDataFrame([(1, 7, "COMPLETION", 10, "F", False), (2, 8, "EXECUTION", 10, "O", False)], "work_id long, mp_id long, lifecycle string, sanctioned long, status string, needs_attention boolean")
    asked = spark.createDataFrame([(5, 7, 3, "NEEDS_CLARIFICATION", False), (6, 7, 3, "SANCTIONED", False)], "recommendation_id long, mp_id long, cost long, status string, needs_attention boolean")
    assert {(x.record_type, x.id, x.category, x.needs_attention) for x in evidence.my_works(works, asked, 7).collect()} == {("ANALYTICAL_WORK", "1", "COMPLETED", False), ("RUNTIME_RECOMMENDATION", "5", "RECOMMENDED", True), ("RUNTIME_RECOMMENDATION", "6", "ONGOING", False)}
    df = spark.createDataFrame([("a", 1), ("b", 2)], "agency string, n int")
    assert [x.n for x in df.where(serving.scope("IA", agency="b")).collect()] == [2]
    with pytest.raises(serving.ScopeError):
        serving.scope("IA")
