"""Steps of the policies over evidence: what is not asked for is not made, and no task takes all rows without a value."""

from datetime import date

from pyspark.sql import functions as F

from tests.test_index_shuffles import next_stage, shuffled_rows
from worksight.functions import stats
from worksight.operators import trends
from worksight.plans import catalog


def test_second_profile_makes_neither_trends_nor_rules(monkeypatch):
    made = []
    monkeypatch.setattr(catalog, "durable", lambda x: x)
    for module, name in ((catalog.signals, "rule_evidence"), (catalog.trends, "trend_context"), (catalog.peers, "peer_evidence")):
        monkeypatch.setattr(module, name, lambda *a, n=name: made.append(n))
    monkeypatch.setattr(catalog, "baseline", lambda t: None)
    monkeypatch.setattr(catalog.peers, "peer_summary", lambda x: "peers")

    class Some:
        profile = works = payments = assets = None

    e = catalog.Evidence(Some, None, None, None)
    assert made == [] and e.peers == "peers" and e.peers == "peers" and made == ["peer_evidence"]


def test_rows_without_a_value_are_dealt(spark):
    df = spark.range(4000).select("id", F.lit("A").alias("k"), F.when(F.col("id") % 100 == 0, F.col("id") % 7).cast("double").alias("x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = stats.percentile_exclusive(df, ["k"], "x", "pct").withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(got) == 4000 and all((r.pct is None) == (r.id % 100 != 0) for r in got)
    parts = [r.part for r in got if r.x is None]
    assert max(parts.count(p) for p in set(parts)) < 2000
    some = sorted(r.x for r in got if r.x is not None)
    assert all(abs(r.pct - (sum(v < r.x for v in some) + (some.count(r.x) - 1) / 2) / (len(some) - 1) * 100) < 1e-9 for r in got if r.x is not None)


def test_months_are_summed_by_place_first(spark):
    rows = [("A", date(1998, 1 + i % 3, 1 + i % 28), i if i % 9 else None, ["N", "M", None][i % 3], ["D", None][i % 2], "R") for i in range(3000)]
    df = spark.createDataFrame(rows, "metric string, event_on date, value long, state string, district string, sector string").repartition(4).cache()
    df.count()
    first = next_stage(spark)
    got = {(r.group_type, r.group_value, r.month.month): (r.value, r.events) for r in trends.dense_months(df, "1998-05-10").collect()}
    assert shuffled_rows(spark, first) < 1500  # a row for each event and group were 10,000 or so
    for g, columns in (("STATE", (3,)), ("SECTOR", (5,)), ("DISTRICT_SECTOR", (3, 4, 5))):
        for month in (1, 2, 3, 4):
            for key in {tuple(r[c] for c in columns) for r in rows if None not in [r[c] for c in columns]}:
                own = [r[2] for r in rows if r[2] is not None and r[1].month == month and tuple(r[c] for c in columns) == key]
                label = "|".join(f"{n}={v}" for n, v in zip(trends.GROUPS[g], key))
                assert got.get((g, label, month), (0, 0)) == (sum(own), len(own))
