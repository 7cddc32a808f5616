"""The workflow machine and verifications: streams, batches and plain folds agree."""

import random

import pytest
from pyspark.sql import functions as F

from worksight.streaming import events as streams
from worksight.streaming import workflow


def plain(log):
    out = {}
    for key, _, _, action, role in sorted(log, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])):
        status, checked, n, roles, steps = out.get(key, ("DRAFT", False, 0, 0, 0))
        if workflow.ROLES.get(action, role) != role:
            roles += 1
        elif action == "PRECHECK":
            checked = True
        elif status in workflow.MOVES.get(action, {}) and (action != "SUBMIT" or checked):
            status = workflow.MOVES[action][status]
        else:
            steps += 1
        out[key] = (status, checked, n + 1, roles, steps)
    return {k: (n, status, checked, roles, steps) for k, (status, checked, n, roles, steps) in out.items()}


def logs(seed, keys=12, hot=2000):
    r = random.Random(seed)
    actions = [*workflow.ROLES, "PRECHECK", "REOPEN", None]
    rows = []
    for i in range(hot + 300):
        key = 1 if i < hot else r.choice([*range(2, keys), None])
        action = r.choice(actions)
        own = workflow.ROLES.get(action, "MP")
        rows.append((key, r.randrange(10**6), i, action, own if r.random() < 0.9 else r.choice(["MP", "DISTRICT", None])))
    path = ["PRECHECK", "SUBMIT", "REQUEST_CLARIFICATION", "PROVIDE_CLARIFICATION", "ACCEPT_FOR_PROCESSING", "ADD_SANCTION", "ADD_PAYMENT", "UPDATE_PROGRESS", "MARK_COMPLETED"]
    return rows + [(99, i, i, a, workflow.ROLES.get(a, "MP")) for i, a in enumerate(path)] + [(98, i, i, a, workflow.ROLES.get(a, "MP")) for i, a in enumerate(path[1:])]


SCHEMA = "key long, at long, n long, action string, role string"


@pytest.mark.parametrize("parts", [1, 9])
def test_fold_over_ranges_is_a_plain_fold(spark, parts):
    rows = logs(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {x.key: (x.actions, x.status, x.prechecked, x.refused_roles, x.refused_steps) for x in workflow.folded(spark.createDataFrame(rows, SCHEMA).repartition(5), "key", ["at", "n"]).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain(rows)
    assert got[99][1] == "COMPLETED" and got[98][1] == "DRAFT"
    assert workflow.folded(spark.createDataFrame([], SCHEMA), "key", ["at", "n"]).count() == 0


def test_stream_of_actions_equals_the_batch(spark, tmp_path):
    rows = [r for r in logs(3, hot=60) if r[0] is not None]
    rows = [(k, i, i, a, x) for i, (k, _, _, a, x) in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))]
    for i in range(3):  # a file a trigger, in the order of the log
        spark.createDataFrame(rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    query = workflow.followed(streams.event_stream(spark, str(tmp_path / "log"), SCHEMA), "key", ["at", "n"]).writeStream.outputMode("update").format("memory").queryName("t_workflow").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    last = spark.table("t_workflow").groupBy("key").agg(F.max_by(F.struct("status", "prechecked", "refused_roles", "refused_steps"), "actions").alias("l"), F.max("actions").alias("actions")).select("key", "actions", "l.*")
    assert {x.key: tuple(x)[1:] for x in last.collect()} == plain(rows)


def test_verifications_as_streams_and_batches(spark, tmp_path):
    sent = [(i, 1_700_000_000 + 3600 * i) for i in range(60)]
    told = [(i, 1_700_000_000 + 3600 * (i + d), f"r{d}") for i in range(0, 60, 2) for d in (1, 5, 200)] + [(3, 1_700_000_000, "before"), (777, 1_700_000_000, "unknown")]
    times = lambda df, c: df.withColumn(c, F.timestamp_seconds(c))
    a = times(spark.createDataFrame(sent, "evidence_id long, submitted_at long"), "submitted_at")
    b = times(spark.createDataFrame(told, "evidence_id long, verified_at long, result string"), "verified_at")
    batch = workflow.verified(a, b)
    latest = {x.evidence_id: (x.result, x.verifications) for x in workflow.latest_verification(batch).collect()}
    assert latest == {i: ("r5", 2) if i % 2 == 0 else (None, 0) for i in range(60)}
    # Rows far ahead move both watermarks on, so that all that can't be verified any more comes out.
    ahead = 1_700_000_000 + 86400 * 400
    a.coalesce(1).write.parquet(str(tmp_path / "a"))
    b.coalesce(1).write.parquet(str(tmp_path / "b"))
    times(spark.createDataFrame([(10_000, ahead)], "evidence_id long, submitted_at long"), "submitted_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    times(spark.createDataFrame([(10_001, ahead, "z")], "evidence_id long, verified_at long, result string"), "verified_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
    read = lambda name, schema: spark.readStream.schema(schema).parquet(str(tmp_path / name))
    query = workflow.verified(read("a", "evidence_id long, submitted_at timestamp"), read("b", "evidence_id long, verified_at timestamp, result string")).writeStream.outputMode("append").format("memory").queryName("t_verified").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.table("t_verified").where("evidence_id < 10000")
    assert got.exceptAll(batch).isEmpty() and batch.exceptAll(got).isEmpty()
