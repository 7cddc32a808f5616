"""Calibrated probabilities, and how good they are by landmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksight.functions.stats import ranking
from worksight.operators import models
from worksight.sources.durable import durable

EDGE = 1e-6
ROUNDS, CLOSE = 50, 1e-10


def logit(probability: Column) -> Column:
    p = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), probability))
    return F.ln(p / (1 - p))


def platt(rows: DataFrame, score: str, label: str, penalty: float = 1.0) -> tuple[float, float]:
    """(slope, intercept) of the logistic in the score's logit that fits a 0/1 label best.

    Least log-loss plus penalty / 2 * slope ** 2, by Newton steps: each is one aggregation
    of six sums over the rows, and the driver solves two equations. Steps that don't lessen the
    loss are halved. Both classes must occur.
    """
    rows = durable(rows.where(F.col(label).isNotNull()).select(logit(F.col(score)).alias("x"), F.col(label).cast("double").alias("y")))
    classes = rows.agg(F.min("y").alias("low"), F.max("y").alias("high")).first()
    if (classes.low, classes.high) != (0.0, 1.0):
        raise ValueError("calibration needs both classes")

    def sums(a: float, b: float):
        z = a * F.col("x") + b
        p = 1 / (1 + F.exp(-z))
        # Written so that no exponential overflows.
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("y") * z
        q = p * (1 - p)
        return rows.agg(F.sum(loss).alias("loss"), F.sum((p - F.col("y")) * F.col("x")).alias("ga"), F.sum(p - F.col("y")).alias("gb"), F.sum(q * F.col("x") * F.col("x")).alias("haa"), F.sum(q * F.col("x")).alias("hab"), F.sum(q).alias("hbb")).first()

    cost = lambda s, a: s.loss + penalty / 2 * a * a
    a = b = 0.0
    at = sums(a, b)
    for _ in range(ROUNDS):
        ga, haa = at.ga + penalty * a, at.haa + penalty
        area = haa * at.hbb - at.hab * at.hab
        if area <= 0:
            break
        da, db = (at.hbb * ga - at.hab * at.gb) / area, (haa * at.gb - at.hab * ga) / area
        step = 1.0
        while cost(new := sums(a - step * da, b - step * db), a - step * da) > cost(at, a) and step > 1e-6:
            step /= 2
        a, b, at = a - step * da, b - step * db, new
        if abs(step * da) + abs(step * db) < CLOSE:
            break
    return a, b


def calibrated(score: Column, fitted: tuple[float, float]) -> Column:
    return 1 / (1 + F.exp(-(fitted[0] * logit(score) + fitted[1])))


def calibration_errors(rows: DataFrame, score: str, label: str, keys: list[str], bins: int = 10) -> DataFrame:
    """Per keys the expected calibration error over equal-width bins, the last one closed."""
    each = rows.groupBy(*keys, F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin__")).agg(F.count("*").alias("n__"), F.avg(score).alias("p__"), F.avg(label).alias("y__"))
    return each.groupBy(*keys).agg((F.sum(F.col("n__") * F.abs(F.col("p__") - F.col("y__"))) / F.sum("n__")).alias("calibration_error"))


def slices(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: works, rows, prevalence, status, and, with both classes, the metrics of score against label."""
    basic = scores.groupBy(*keys).agg(F.countDistinct("work_id").alias("works"), F.count("*").alias("rows"), F.avg("label").alias("prevalence"), F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"))
    got = basic.join(ranking(scores, "score", "label", keys).drop("positives", "negatives"), keys).join(calibration_errors(scores, "score", "label", keys), keys)
    both = F.col("roc_auc").isNotNull()
    status = F.when(both, "EVALUATED").otherwise("INSUFFICIENT_CLASSES_AT_LANDMARK")
    return got.select(*keys, "works", "rows", "prevalence", status.alias("status"), *[F.when(both, F.col(c)).alias(c) for c in ("roc_auc", "average_precision", "brier", "calibration_error")])


def landmark_scores(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """work_id, fraction, part, model, kind, label, score of VALIDATION and TEST rows by each of the fitted models.

    kind is RAW or CALIBRATED, the calibration being fitted to VALIDATION rows alone. Written
    out, so that every metric reads the same table.
    """
    rows = models.as_doubles(rows.where(F.col(label).isNotNull()), [*features, label])
    rows = durable(rows.select("work_id", "fraction", "part", *features, label).repartition("work_id").sortWithinPartitions("work_id", "fraction"))
    raw = None
    for name, fitted in models.fitted_models(rows, features, label).items():
        scored = models.probability(fitted, rows.where("part <> 'TRAIN'")).select("work_id", "fraction", "part", F.lit(name).alias("model"), F.col(label).cast("int").alias("label"), "score")
        raw = scored if raw is None else raw.unionByName(scored)
    raw = durable(raw)
    out = raw.select("work_id", "fraction", "part", "model", F.lit("RAW").alias("kind"), "label", "score")
    for name in [r.model for r in raw.select("model").distinct().collect()]:  # a row per model
        own = raw.where(F.col("model") == name)
        try:
            fitted = platt(own.where("part = 'VALIDATION'"), "score", "label")
        except ValueError:
            continue
        out = out.unionByName(own.select("work_id", "fraction", "part", "model", F.lit("CALIBRATED").alias("kind"), "label", calibrated(F.col("score"), fitted).alias("score")))
    return durable(out)


def model_slices(scores: DataFrame) -> DataFrame:
    """Metrics of each part, model and kind at every landmark, and over all of them (fraction null), where works repeat."""
    keys = ["part", "model", "kind", "fraction"]
    every = slices(scores.withColumn("fraction", F.lit(-1.0)), keys).withColumn("fraction", F.lit(None).cast("double"))
    return slices(scores, keys).unionByName(every)
