"""Models impute exact medians without holding values on the driver."""

import random

import pytest
from pyspark.sql import functions as F

from worksight.functions import stats
from worksight.operators import models


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_medians_are_the_lower_ones(spark, monkeypatch, few):
    monkeypatch.setattr(stats, "FEW", few)
    r = random.Random(3)
    rows = [(r.choice([None, float("nan"), float(r.randint(0, 9))]), r.gauss(0, 1), None) for _ in range(200)]
    got = models.medians(spark.createDataFrame(rows, "a double, b double, c double").repartition(3), ["a", "b", "c"])
    for i, f in enumerate("ab"):
        own = sorted(x[i] for x in rows if x[i] is not None and x[i] == x[i])
        assert got[f] == own[(len(own) + 1) // 2 - 1]
    assert got["c"] == 0.0


def test_models_fit_without_sending_values_to_the_driver(spark, monkeypatch):
    from pyspark.ml import feature

    monkeypatch.delattr(feature, "Imputer")
    r = random.Random(5)
    rows = [(i, r.choice(["TRAIN", "TRAIN", "VALIDATION", "TEST"]), r.choice([None, r.gauss(0, 1)]), float(i % 2) + r.gauss(0, 1), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "work_id long, part string, a double, b double, y int")
    got = {(x.part, x.model): x for x in models.train_models(df, ["a", "b"], "y").collect()}
    assert len(got) == 6 and all(0.6 < x.roc_auc < 0.95 for x in got.values())
    assert {x.part: x.rows for x in got.values()} == {x.part: x["count"] for x in df.where(F.col("part") != "TRAIN").groupBy("part").count().collect()}
