"""Chunks, excerpts, budgets, dossiers and views on hand-made rows and against plain versions."""

import json
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from worksight.operators import cases, passages
from worksight.operators.serving import ScopeError


def test_web_pages_become_lines(spark):
    html = "<html><head><title>t</title></head><body><nav><ul><li><a href='x'>one</a></li><li>two</li></ul></nav><!-- c --><h1>Big &amp; <b>bold</b></h1><p>a\n b<br>c</p><script>x</script><p>&lt;d&gt;</p></body></html>"
    got = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(passages.page_text("h").alias("t")).collect()
    assert got[0].t.strip("\n").split("\n") == ["one", "two", "", "# Big & bold", "", "a b", "c", "", "<d>"]
    assert (got[1].t, got[2].t) == (None, "")


def test_pages_lose_running_heads_and_numbers(spark):
    rows = [("a", i, f"HEAD LINE\n\n# Part {i}\n3.{i}.1 Clause text\n  *4.{i} Other\n3.{i}.1 again\n\n\n\nend {i}\n{n}") for i, n in enumerate(["1", "22", "iv", "100", "x y"])]
    rows += [("b", 1, "HEAD LINE\nkept"), ("b", 2, "other\nHEAD LINE"), ("c", 1, None), ("c", 2, ""), ("c", 3, "7")]
    df = spark.createDataFrame(rows, "doc string, page long, text string").repartition(4)
    got = {(x.doc, x.page): x for x in passages.cleaned(df).collect()}
    assert got["a", 0].text == "# Part 0\n3.0.1 Clause text\n*4.0 Other\n3.0.1 again\n\nend 0" and got["a", 0].printed_page == "1"
    assert [got["a", i].printed_page for i in range(5)] == ["1", "22", "iv", None, None] and got["a", 3].text.endswith("\n100")
    assert got["b", 1].text == "HEAD LINE\nkept" and (got["c", 1].text, got["c", 3].text, got["c", 3].printed_page) == ("", "", "7")
    found = passages.chunks(df, 30).orderBy("doc", "page", "piece").collect()
    for x in found:
        whole = got[x.doc, x.page].text
        assert whole[x.start : x.end] == x.text and len(x.text) <= 30
    assert "".join(x.text for x in found if (x.doc, x.page) == ("a", 1)).replace("\n", "") == got["a", 1].text.replace("\n", "")
    assert {x.chapter for x in found if x.doc == "a" and x.page == 2} == {"Part 2"} and {x.chapter for x in found if x.doc == "b"} == {"FRONT MATTER"}
    assert [c for x in found if (x.doc, x.page) == ("a", 0) for c in x.clauses] == ["3.0.1", "4.0", "3.0.1"] or [c for x in found if (x.doc, x.page) == ("a", 0) for c in x.clauses] == ["3.0.1", "4.0"]
    assert passages.chunks(df.where("false")).count() == 0


def plain_best(text, query, limit=650):
    terms = sorted(set(re.findall(r"\w+", query.lower())))
    best = None
    for m in re.finditer(r"(.*?)\n\s*\n", text + "\n\n", re.S):
        if not m[1].strip():
            continue
        held = [t for t in terms if t in m[1].lower()]
        if best is None or len(held) > best[0]:
            size = len(m[1])
            focus = min((m[1].lower().find(t) for t in held), default=0)
            shift = 0 if size <= limit else min(max(0, focus - 150), size - limit)
            best = (len(held), m.start() + shift, m.start() + shift + min(limit, size))
    n, a, b = best or (0, 0, min(limit, len(text)))
    b = min(b, len(text))
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b, n


def test_best_paragraph(spark):
    r = random.Random(5)
    rows = []
    for i in range(60):
        parts = [" ".join(r.choice(["road", "Bridge", "school", "x", "longer words"]) for _ in range(r.choice([3, 20, 300]))) for _ in range(r.randint(1, 5))]
        rows.append((i, r.choice(["\n\n", "\n \n", "\n\n\n"]).join(parts) + r.choice(["", "\n", "  "]), r.choice(["bridge", "School road!", "none of it", "ROAD x"])))
    rows += [(100, "", "road"), (101, "  \n\n ", "road"), (102, "only", "")]
    got = {x.id: (x.start, x.end, x.words) for x in passages.best_spans(spark.createDataFrame(rows, "id long, text string, query string")).collect()}
    for i, text, query in rows[:60]:
        assert got[i] == plain_best(text, query), (i, text, query)
    assert got[100] == (0, 0, 0) and got[101][0] == got[101][1] and got[102] == (0, 4, 0)


def test_clause_spans(spark):
    text = "Intro 9.9 here\n3.2 First clause\nmore\n 3.2.9 Second " + "w " * 900 + "\n4.1 Last"
    rows = [(i, text, c) for i, c in enumerate(["3.2", "3.2.9", "4.1", "9.9", "8.8"])]
    got = {x.id: text[x.start : x.end] for x in passages.clause_spans(spark.createDataFrame(rows, "id long, text string, clause string")).collect()}
    assert got[0] == "3.2 First clause\nmore" and got[2] == "4.1 Last"
    assert got[1].startswith("3.2.9 Second") and len(got[1]) <= 1200
    assert got[3].startswith("Intro 9.9") and got[4].startswith("Intro") and len(got[4]) <= 1200


def plain_budget(pieces, items, similar, budget, frame):
    kind = lambda k: sorted((p for p in pieces if p[1] == k), key=lambda p: (p[2], p[3]))
    must, direct, may, like = (kind(k) for k in passages.KINDS)
    overflow = len(must) > items
    may, like = may[: max(0, items - len(must))], like[:similar]
    size = lambda: frame + sum(p[4] for p in must + direct + may + like)
    while size() > budget and (like or may):
        (like or may).pop()
    reason = "MANDATORY_EVIDENCE_EXCEEDS_ITEM_CAP" if overflow else "MANDATORY_DIRECT_CONTEXT_EXCEEDS_REQUEST_BUDGET" if size() > budget else None
    return {(p[1], p[3]) for p in must + direct + may + like}, reason


def test_budget_drops_in_order(spark):
    r = random.Random(7)
    pieces = [(w, r.choice(passages.KINDS), r.randint(1, 3), f"p{i}", r.choice([10, 100, 400])) for w in range(80) for i in range(r.randint(0, 9))]
    pieces += [(900, "MANDATORY", 1, f"m{i}", 10) for i in range(5)]
    df = spark.createDataFrame(pieces, "work_id long, kind string, priority int, piece string, bytes int").repartition(5)
    rows = passages.budgeted(df, 4, 2, 900, 50)
    got = {}
    for x in rows.collect():
        got.setdefault(x.work_id, (set(), set()))[1].add(x.reason)
        if x.kept:
            got[x.work_id][0].add((x.kind, x.piece))
    for w in got:
        kept, reason = plain_budget([p for p in pieces if p[0] == w], 4, 2, 900, 50)
        assert got[w] == (kept, {reason}), w
    assert {x.reason for x in passages.budget_summary(rows).collect()} == {None, "MANDATORY_EVIDENCE_EXCEEDS_ITEM_CAP", "MANDATORY_DIRECT_CONTEXT_EXCEEDS_REQUEST_BUDGET"}


def test_sums_of_points_must_give_the_score(spark):
    scores = spark.createDataFrame([(1, 30.0), (2, 0.0)], "work_id long, score double")
    points = spark.createDataFrame([(1, 10.0), (1, 20.000001)], "work_id long, points double")
    got = {x.work_id: (x.contribution_sum, x.families) for x in cases.checked_points(scores, points).collect()}
    assert got == {1: (pytest.approx(30.000001), 2), 2: (0.0, 0)}
    with pytest.raises(Exception, match="does not reproduce score for 1"):
        cases.checked_points(scores.withColumn("score", F.col("score") + 1), points).collect()


def test_dossier(spark):
    d = date
    works = spark.createDataFrame([(1, d(2020, 1, 1), d(2020, 2, 1), d(2021, 1, 1)), (2, d(2020, 1, 1), None, None)], "work_id long, recommended_on date, sanctioned_on date, expected_on date")
    paid = spark.createDataFrame([(1, d(2020, 3, 1)), (1, d(2020, 2, 1))], "work_id long, released_on date")
    told = spark.createDataFrame([(1, d(2020, 5, 1))], "work_id long, report_date date")
    built = spark.createDataFrame([(1, d(2021, 3, 1), None)], "work_id long, completed_on date, handover_on date")
    seen = spark.createDataFrame([], "work_id long, captured_on date")
    steps = cases.timeline(works, paid, told, built, seen)
    got = {x.work_id: [(str(s.on), s.label) for s in x.timeline] for x in steps.collect()}
    assert got[2] == [("2020-01-01", "Recommendation")]
    assert got[1] == [("2020-01-01", "Recommendation"), ("2020-02-01", "First Payment"), ("2020-02-01", "Sanction"), ("2020-03-01", "Latest Payment"), ("2020-05-01", "First Progress Report"), ("2020-05-01", "Latest Progress Report"), ("2021-01-01", "Expected Completion"), ("2021-03-01", "Recorded Completion")]
    rows = spark.createDataFrame([(1, "COMPLETION", 140, 100, 30.0, False, True, True, True, None, "NOT_APPLICABLE"), (2, "EXECUTION", 0, None, None, True, False, False, None, True, "OVERDUE")], "work_id long, lifecycle string, released long, sanctioned long, gap double, observed_delay boolean, early boolean, observed_overrun boolean, closure_requires_review boolean, has_pair boolean, monthly_status string")
    out = {x.work_id: x for x in cases.dossier(rows, steps).collect()}
    state = {x["label"]: x["status"] for x in json.loads(out[1].health)}
    assert state == {"Fund Utilization": "Very High Attention", "Physical Progress": "Requires Review", "Schedule": "On Schedule", "Payments": "Requires Review", "Compliance": "Requires Review", "Duplicate Review": "Normal", "Completion Records": "Requires Review", "Evidence Availability": "Good"}
    assert [x["status"] for x in json.loads(out[2].health)] == ["Normal", "Normal", "Observed Delay", "Normal", "Normal", "Requires Comparison", "Not yet due", "Requires Review"]
    assert len(json.loads(out[1].irregularities)) == 3 and [x["status"] for x in json.loads(out[2].irregularities)] == ["Observed Delay"]
    assert (out[1].completion_readiness, out[2].completion_readiness) == ("REQUIRES_REVIEW", "NOT_YET_DUE")


def test_scopes_of_groups(spark):
    df = spark.createDataFrame([("state=A", "m", 1), ("state=A|district=D", "m", 2), ("state=AB", "m", 3), ("sector=S", "m", 4)], "group_value string, metric string, v int").withColumns({"group_type": F.lit("G"), "month": F.lit("2020-01-01").cast("date")})
    seen = lambda *scope: {x.v for x in df.where(cases.group_scope(*scope)).collect()}
    assert (seen("NATIONAL"), seen("MP"), seen("STATE", "A"), seen("DISTRICT", "A", "D")) == ({1, 2, 3, 4}, set(), {1, 2}, {2})
    for bad in (("STATE",), ("DISTRICT", "A"), ("NOBODY", "A", "D")):
        with pytest.raises(ScopeError):
            cases.group_scope(*bad)
    got = cases.trend_view(df, cases.group_scope("STATE", "A"), "m", "G", {"district": "D"}, "2020-01-01", "2020-01-01", 5).collect()
    assert [(x.v, x.total) for x in got] == [(2, 1)]


def test_ranks_and_audits(spark):
    scores = spark.createDataFrame([(1, "E", 0.5), (2, "E", 0.9), (3, "E", 0.5), (4, "C", 0.1)], "work_id long, lifecycle string, anomaly_score double")
    assert {x.work_id: x.stage_rank for x in cases.within_stage_rank(scores).collect()} == {2: 1, 1: 2, 3: 3, 4: 1}
    alerts = spark.createDataFrame([(1, "B", "x", 50.0), (1, "A", "x", 50.0), (2, "A", "y", 90.0)], "work_id long, alert_type string, evidence_code string, strength double")
    assert [(x.alert_id, x.work_id, x.alert_type) for x in cases.numbered_alerts(alerts).orderBy("alert_id").collect()] == [("D7-000001", 2, "A"), ("D7-000002", 1, "A"), ("D7-000003", 1, "B")]
    told = cases.explanation_coverage(spark.range(3).withColumnRenamed("id", "work_id"), spark.createDataFrame([(0, "r"), (0, "s"), (1, "r")], "work_id long, reference string")).first()
    assert (told.works, told.with_references, told.references, told.most, told.distinct_references) == (3, 2, 3, 2, 2)
    results = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False)], "query_id long, place int, good boolean")
    assert {x.query_id: (x.good, x.bad) for x in cases.first_found(results, {"good": F.col("good"), "bad": ~F.col("good")}).collect()} == {1: (2, 1), 2: (None, 1)}


def test_queue_of_the_second_profile(spark):
    rows = spark.createDataFrame([(17, "New Road", "E", True), (2, "bridge 17", "E", None), (3, "x", "C", True)], "work_id long, description string, lifecycle string, requires_review boolean")
    ids = lambda **how: [x.work_id for x in cases.second_queue(rows, **how).collect()]
    assert (ids(search="17"), ids(search="ROAD"), ids(requires_review=True), ids(requires_review=False), ids(equal={"lifecycle": "C"})) == ([17, 2], [17], [17, 3], [2], [3])
