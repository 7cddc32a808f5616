"""Contracts, manifests, sinks, synthetic tables and streams."""

import pytest
from pyspark.sql import functions as F

from worksight.sources import contracts, synth
from worksight.streaming import events as streams

MP = contracts.CONTRACTS["mp"]


def write(path, rows, header=None):
    path.write_text("﻿" + "\n".join([",".join(header or MP.names()), *rows]), encoding="utf-8")
    return str(path)


GOOD = "M1,Name,LS,2024-29,S1,State,Con,Dist,50000000,1,0,2026-01-01,src,ref,True"


def test_strict_scan(spark, tmp_path):
    df = contracts.load(spark, write(tmp_path / "a.csv", [GOOD]), MP)
    r = df.first()
    assert (r.mp_id, r.annual_entitlement_inr, str(r.record_effective_date), r.synthetic_marker) == ("M1", 50_000_000, "2026-01-01", True)
    with pytest.raises(contracts.ContractError, match="out of order"):
        contracts.scan_csv(spark, write(tmp_path / "b.csv", [GOOD], MP.names()[::-1]), MP)
    with pytest.raises(contracts.ContractError, match="missing"):
        contracts.scan_csv(spark, write(tmp_path / "c.csv", [GOOD], [*MP.names()[:-1], "other"]), MP)
    with pytest.raises(contracts.ContractError, match="record_effective_date"):
        contracts.load(spark, write(tmp_path / "d.csv", [GOOD.replace("2026-01-01", "01/02/2026")]), MP)
    with pytest.raises(contracts.ContractError, match="1.5"):
        contracts.load(spark, write(tmp_path / "e.csv", [GOOD.replace("50000000", "1.5")]), MP)
    with pytest.raises(contracts.ContractError, match="mp_name"):
        contracts.load(spark, write(tmp_path / "f.csv", [GOOD.replace("Name", " ")]), MP)


def test_sinks_and_manifest(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.createDataFrame([(1, float("nan")), (2, 3.5)], "id long, x double")
    contracts.write_jsonl(df, root, f"{root}/j")
    assert sorted(r.value for r in spark.read.text(f"{root}/j").collect()) == ['{"id":1,"x":null}', '{"id":2,"x":3.5}']
    assert contracts.read_jsonl(spark, f"{root}/j", "id long, x double", "id").count() == 2
    with pytest.raises(contracts.ContractError):
        contracts.read_jsonl(spark, [f"{root}/j", f"{root}/j"], "id long, x double", "id")
    contracts.write_csv(df, root, f"{root}/c")
    with pytest.raises(contracts.ContractError):
        contracts.write_csv(df, root, f"{root}/../elsewhere")
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a").write_text("a")
    (tmp_path / "m/b").write_text("b")
    listed = contracts.manifest(spark, str(tmp_path / "m"))
    expected = spark.createDataFrame([("a", listed.where("file = 'a'").first().sha256), ("b", "0"), ("z", "1")], "file string, sha256 string")
    assert {(r.file, r.fault) for r in contracts.manifest_faults(listed, expected).collect()} == {("b", "CHANGED"), ("z", "MISSING")}
    assert contracts.content_hash(df).first() == contracts.content_hash(df.repartition(3)).first()


def test_synthetic_tables_are_deterministic(spark):
    works = synth.synth_works(spark, 200)
    one, two = contracts.content_hash(works).first(), contracts.content_hash(synth.synth_works(spark, 200).repartition(3)).first()
    assert one == two
    paid = synth.synth_payments(works)
    assert paid.join(works, "work_id", "left_anti").count() == 0
    assert paid.groupBy("work_id").agg(F.count_if("is_final").alias("n")).where("n <> 1").count() == 0
    assert synth.synth_progress(works).count() == 2400


SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def run(query, name, mode):
    q = query.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_streams_equal_batches(spark, tmp_path):
    events = spark.createDataFrame([(i, 60 * 37 * i, i % 3, "abc"[i % 2], float(i)) for i in range(200)], "event_id long, s long, user_id long, event_type string, value double")
    events = events.select("event_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props"))
    folder = str(tmp_path / "events")
    events.orderBy("ts").coalesce(1).write.parquet(folder)
    run(streams.tumbling(streams.event_stream(spark, folder, SCHEMA)), "t_tumbling", "complete")
    batch = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "events", "total")
    assert spark.table("t_tumbling").exceptAll(batch).isEmpty() and batch.exceptAll(spark.table("t_tumbling")).isEmpty()
    run(streams.latest_status(streams.event_stream(spark, folder, SCHEMA)), "t_latest", "update")
    from worksight.operators import serving

    want = {(r.user_id, r.status, r.records) for r in serving.latest_status(events, "user_id", "event_type", ["ts", "event_id"]).collect()}
    assert {tuple(r) for r in spark.table("t_latest").collect()} == want
    run(streams.sessions(streams.event_stream(spark, folder, SCHEMA)), "t_sessions", "complete")
    assert spark.table("t_sessions").agg(F.sum("events")).first()[0] == 200
    late = streams.late_evidence(spark.createDataFrame([("2026-09-03", "2026-09-01"), ("2026-09-04", "2026-09-20")], "a string, b string").select(F.col("a").cast("date").alias("captured_on"), F.col("b").cast("date").alias("due_month")))
    assert [r.late for r in late.orderBy("captured_on").collect()] == [False, True]


def test_settings_supplements_labels_and_profiles(spark, tmp_path):
    (tmp_path / "meta.json").write_text('﻿{"synthetic_demo_data": true, "n": 3}', encoding="utf-8")
    assert contracts.read_json(spark, str(tmp_path / "meta.json"), {"synthetic_demo_data": True})["n"] == 3
    with pytest.raises(contracts.ContractError, match="synthetic"):
        contracts.read_json(spark, str(tmp_path / "meta.json"), {"synthetic_demo_data": False})
    (tmp_path / "extra.csv").write_text("﻿a,b\n1,x\n2,\"y,\nz\"\n", encoding="utf-8")
    extra = contracts.load_supplements(spark, str(tmp_path), {"extra": "extra.csv"})["extra"]
    assert dict(extra.dtypes) == {"a": "string", "b": "string"} and {r.b for r in extra.collect()} == {"x", "y,\nz"}
    known = spark.createDataFrame([("M1",), ("M2",)], "mp_id string")
    assert contracts.load_labels(spark, write(tmp_path / "l.csv", [GOOD]), MP, known, "mp_id").count() == 1
    with pytest.raises(contracts.ContractError, match="M1"):
        contracts.load_labels(spark, write(tmp_path / "m.csv", [GOOD, GOOD]), MP, known, "mp_id")
    with pytest.raises(contracts.ContractError, match="M1"):
        contracts.load_labels(spark, write(tmp_path / "n.csv", [GOOD]), MP, known.where("mp_id = 'M2'"), "mp_id")
    got = contracts.load_profile(spark, str(tmp_path), "meta.json", {"l.csv": MP}, {"synthetic_demo_data": True})
    assert got["mp"].count() == 1
    with pytest.raises(contracts.ContractError):
        contracts.load_profile(spark, str(tmp_path), "meta.json", {"l.csv": MP}, {"n": 4})


def test_summaries_manifests_and_unchanged_inputs(spark, tmp_path):
    root = str(tmp_path / "out")
    contracts.write_summary(spark.createDataFrame([(float("inf"), 2, None)], "z double, a long, m string"), root, f"{root}/s")
    assert [r.value for r in spark.read.text(f"{root}/s").collect()] == ['{"a":2,"m":null,"z":null}']
    with pytest.raises(contracts.ContractError):
        contracts.write_summary(spark.range(2), root, f"{root}/t")
    spark.range(5).write.parquet(f"{root}/five")
    inputs = {"five": spark.read.parquet(f"{root}/five")}
    assert contracts.unchanged(inputs, lambda: 7) == 7

    def spoil():
        spark.range(5, 6).write.mode("append").parquet(f"{root}/five")
        inputs["five"] = spark.read.parquet(f"{root}/five")

    with pytest.raises(contracts.ContractError, match="five"):
        contracts.unchanged(inputs, spoil)
    listed = contracts.artifact_manifest(spark, root, {"five": "five"}).first()
    assert (listed.table, listed.rows, len(listed.sha256)) == ("five", 6, 64) and listed.files >= 2
    a, b = spark.createDataFrame([(1,), (1,), (None,)], "k long"), spark.createDataFrame([(1, 9)], "id long, k long")
    faults = contracts.integrity_faults({"a": a, "b": b}, spark.createDataFrame([("a", 3), ("b", 2)], "table string, rows long"), {"a": "k"}, [("b", "k", "a", "k")])
    assert {(r.table, r.fault, r.found) for r in faults.collect()} == {("b", "ROW_COUNT", 1), ("a", "REPEATED_KEY", 1), ("a", "NULL_KEY", 1), ("b", "ORPHAN_k", 1)}


def test_rules_of_values_and_states(spark):
    from datetime import date

    from worksight.operators import checks

    rows = spark.createDataFrame([(1, 0.5, 1, 2, date(2020, 1, 1), 1, 10, "EXECUTION", 0), (2, float("inf"), None, 0, date(2021, 1, 1), 0, 0, "COMPLETION", 0), (3, None, 1, 0, None, 1, 5, "EXECUTION", 0)], "work_id long, r double, a long, b long, on date, payment_count long, released_total long, lifecycle string, asset_count long")
    paid = spark.createDataFrame([(1, date(2020, 1, 1), 10, True), (3, date(2020, 1, 1), 6, True)], "work_id long, released_on date, amount long, is_released boolean")
    got = {r.rule: r.violations for r in checks.value_contract(rows, {"r": ("a", "b")}, ["on"], "2020-06-01", paid).collect()}
    assert got == {"INFINITE_VALUE": 1, "RATIO_NULLNESS": 1, "FUTURE_DATE": 1, "PAYMENTS_DONT_RECONCILE": 1, "COMPLETION_MISMATCH": 1}
    needs = spark.createDataFrame([(1, 1, None, True), (2, 1, None, False), (3, 1, "x", True)], "id long, work_id long, k string, done boolean")
    assert [r.record_id for r in checks.required_keys(needs, {"NULL_K": ("k", F.col("done"))}, "t", "id").collect()] == ["1"]
    works = spark.createDataFrame([(1, "P"), (2, "P"), (3, "F")], "work_id long, status string")
    told = spark.createDataFrame([(2, 0.0, 5.0), (1, 0.0, 0.0)], "work_id long, physical double, financial double")
    assert [(r.work_id, r.reports) for r in checks.status_inconsistency(works, F.col("status") == "P", paid.where("work_id = 3"), told).collect()] == [(2, 1)]
