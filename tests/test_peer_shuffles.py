"""Peer cohorts of all levels: the figures of each, and how often a value is shuffled for them."""

import random

import numpy as np

from tests.test_index_shuffles import next_stage, shuffled_rows
from worksight.operators import peers


def test_values_are_shuffled_a_few_times_and_cohorts_are_right(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["A", "B"]), r.choice(["d1", "d2", None]), r.choice(["s1", "s2"]), r.choice(["u1", "u2", "u3"]) if i % 50 else f"own{i % 400}", r.choice([None, r.random()]), float(r.randint(0, 9))) for i in range(4000)]
    df = spark.createDataFrame(rows, "work_id long, lifecycle string, district string, sector string, sub_sector string, x double, y double").repartition(4).cache()
    df.count()
    first = next_stage(spark)
    got = {(g.work_id, g.metric): g for g in peers.peer_evidence(df, ["x", "y"]).collect()}
    shuffled = shuffled_rows(spark, first)
    names = ("district", "sector", "sub_sector")
    for w in r.sample(rows, 60):
        own = dict(zip(names, w[2:5]))
        for at, metric in ((5, "x"), (6, "y")):
            g = got[w[0], metric]
            for level, keys in enumerate(peers.LEVELS):
                v = [q[at] for q in rows if q[1] == w[1] and q[at] is not None and all(q[2 + names.index(k)] == own[k] for k in keys)]
                if len(v) >= peers.MINIMUM:
                    assert (g.level, g.peers, round(g.median, 9)) == (level, len(v), round(float(np.median(v)), 9))
                    break
    assert len(got) == 8000 and shuffled < 15 * 4000
