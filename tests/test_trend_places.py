"""A work's trend group is picked once for its place, without a row for each of its groups."""

from datetime import date

from worksight.operators import trends

PLACES = [("N", "D1", "R"), ("N", "D1", "S"), ("N", None, "R"), (None, None, None), ("X", "D9", "Z")]


def test_trend_context_picks_by_place(spark):
    works = spark.createDataFrame([(i, *PLACES[i % 5]) for i in range(50)], "work_id long, state string, district string, sector string")
    month = date(1998, 11, 1)
    rows = [("DISTRICT_SECTOR", "state=N|district=D1|sector=R", "A", 4.0), ("STATE", "state=N", "A", 1.0), ("STATE", "state=N", "B", -5.0), ("SECTOR", "sector=R", "A", 0.5)]
    base = spark.createDataFrame([(g, v, m, month, z, abs(z) >= 3.5) for g, v, m, z in rows], "group_type string, group_value string, metric string, month date, robust_z double, flagged boolean")
    got = trends.trend_context(works, base, "1998-12-31")
    told = {r.work_id: (r.trend_group, r.trend_metric, r.trend_z, r.trend_flagged, r.trend_strength) for r in got.collect()}
    want = [("DISTRICT_SECTOR", "A", 4.0, True, 0.0), ("STATE", "B", -5.0, True, 100.0), ("SECTOR", "A", 0.5, False, 0.0), ("NO_SUPPORTED_GROUP", None, None, False, 0.0), ("NO_SUPPORTED_GROUP", None, None, False, 0.0)]
    assert told == {i: want[i % 5] for i in range(50)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [work_id" not in plan and "Generate" in plan
