"""What the neighbour index shuffles stays in proportion to its vectors, however unevenly these lie."""

import numpy as np

from worksight.operators import neighbours


def stages(spark):
    sc = spark.sparkContext
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


def next_stage(spark):
    return 1 + max(s.stageId() for s in stages(spark))


def shuffled_rows(spark, first):
    return sum(s.shuffleWriteRecords() for s in stages(spark) if s.stageId() >= first)


def test_a_row_is_shuffled_a_few_times(spark):
    draw = np.random.default_rng(2)
    middle = draw.normal(size=(2, 16))
    x = middle[(draw.random(6000) < 0.1).astype(int)] + 0.2 * draw.normal(size=(6000, 16))  # nine of ten in one heap
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>").repartition(4).cache()
    df.count()
    first = next_stage(spark)
    assert neighbours.neighbours(df, 5).count() == 5 * 6000
    assert shuffled_rows(spark, first) < 30 * 6000
