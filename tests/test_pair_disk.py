"""What the queries on near pairs write: pairs once, no more columns than are asked for, vectors once a large slice."""

from datetime import date

import numpy as np

from tests.test_index_shuffles import next_stage, stages
from worksight.operators import evidence, neighbours
from worksight.plans import catalog, register

ONE = ("Roads", "S", "R", "D", "B", "V", 10.0, 75.0, 100, 100, date(2024, 1, 1), "a")
RECORD = "work_id long, sector string, sub_sector string, state string, district string, block string, village string, latitude double, longitude double, recommended long, sanctioned long, recommended_on date, agency string, description string"


def given(spark, monkeypatch):
    """Three works of which two pairs are near, in place of the tables."""
    records = spark.createDataFrame([(1, *ONE, "x"), (2, *ONE, "y"), (3, *ONE, "z")], RECORD)
    monkeypatch.setattr(register.domain, "register", lambda spark, d: records)
    monkeypatch.setattr(register, "search_vectors", lambda spark, d: None)
    monkeypatch.setattr(register, "text_pairs", lambda found, k: spark.createDataFrame([(1, 2, 0.98), (1, 3, 0.5)], "a long, b long, cosine double"))


def checkpoints(monkeypatch):
    """Every frame that is written from now on."""
    from pyspark.sql.classic.dataframe import DataFrame

    written, plain = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, eager=True: written.append((self.columns, self.count())) or plain(self, eager))
    return written


def test_summary_writes_no_pairs(spark, monkeypatch):
    given(spark, monkeypatch)
    written = checkpoints(monkeypatch)
    got = {r.id: (r.candidates, r.best, r.reviews, r.best_review) for r in register.summary(spark, "").collect()}
    assert got == {1: (2, 2, 1, 2), 2: (1, 1, 1, 1), 3: (1, 1, 0, None)}
    assert written == []


def test_audits_write_what_they_ask_for(spark, monkeypatch):
    given(spark, monkeypatch)
    written = checkpoints(monkeypatch)
    told = catalog.queries()["duplicate_audit"](spark, "").collect()
    assert {r.least: r.pairs for r in told} == {60.0: 2, 75.0: 2, 85.0: 1, 90.0: 1}
    assert all("cosine" not in columns and "location" not in columns for columns, _ in written)
    written.clear()
    one = catalog.queries()["duplicate_distribution"](spark, "").first()
    assert (one.pairs, one.minimum, one.maximum) == (2, 75.0, 99.0) and one.p50 == 87.0
    assert all("same" in columns or "same__" in columns for columns, _ in written)  # counts of scores, not pairs
    pairs = spark.createDataFrame([(s, s / 100, 1.0, 0.9, 3, *[True] * 6) for s in (50.0, 59.9, 80.0, 95.0)], "score double, text double, km double, amount double, days int, same_district boolean, same_block boolean, same_village boolean, same_sector boolean, same_sub_sector boolean, same_agency boolean")
    written.clear()
    assert {r.least: r.pairs for r in evidence.structured_audit(pairs, (60.0, 90.0)).collect()} == {60.0: 2, 90.0: 1}
    assert set(written[0][0]) == set(pairs.columns)


def test_signals_are_kept_without_payments(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "p", "ZERO_VALUE_RELEASED_PAYMENT", "WARNING")], "work_id long, payment_id string, signal_code string, severity string")
    monkeypatch.setattr(catalog.signals, "payment_signals", lambda *_: rows)
    tables = type("T", (), {"profile": None, "assets": None, "payments": None})()
    assert catalog.Evidence(tables, None, None, None).signals.columns == ["work_id", "signal_code", "severity"]


def test_slices_that_look_into_a_list_are_as_large_as_those_of_it(spark, monkeypatch):
    for name, n in (("BLOCK", 256), ("LEAST", 16), ("TASKS", 1)):
        monkeypatch.setattr(neighbours, name, n)
    x = np.random.default_rng(4).normal(size=(2048, 8))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>").repartition(4).cache()
    df.count()
    first = next_stage(spark)
    got = neighbours.neighbours(df, 1).collect()
    # One list of eight slices, which eight slices look into; with slices of half the size these were sixteen.
    assert max(s.shuffleWriteRecords() for s in stages(spark) if s.stageId() >= first) == 8 * 2048
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T
    np.fill_diagonal(cos, -1)
    assert all(r.cosine == np.floor(cos[r.id].max() * 1e6 + 0.5) / 1e6 for r in got) and len(got) == 2048
