"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import math
from pathlib import Path

import pytest

from worksight.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Take the evidence of queries that run here, in another form; the tests of their operators hold it against its parts.
SLOW = {"family_signals", "contributions", "priority_queue", "alert_summary", "authority_summary", "explanations", "train_models", "v2_alerts", "v2_priority"}
SLOW |= {"policy_contributions", "policy_alerts", "policy_authority_summary", "policy_v2_alerts", "points_check", "alert_ids", "query_texts", "evidence_bundle", "model_slices", "anomaly_ranks"}
SLOW |= {"duplicate_distribution", "pair_score", "pair_symmetric_summary", "copies_retrieved", "v2_pairs", "v2_yearly_use", "v2_comparison", "v2_work_features", "retrieval_audit", "text_topk", "clause_extract", "rule_traces"}
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return f"{float(value):.6f}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(names, listed):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([plain(r[i]) for i in order] for r in listed)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - SLOW))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    got = df.collect()
    if name in catalog.oracle_sql():
        cursor = duck.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, cursor.fetchall())


def test_results_dont_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append([sorted(map(str, catalog.queries()[q](spark, FOLDER).collect())) for q in ("payment_signals", "serving_rank", "monthly_causal_z", "work_split")])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
