"""Point-in-time training rows, splits, models, isolation forests and ranking metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worksight.functions.scalar import fixed, fractional_instant, safe_ratio
from worksight.functions.stats import average_rank, cumulated, quantiles, ranking
from worksight.sources.durable import durable

LANDMARKS = (0.25, 0.5, 0.75)
#: What a model must reach on TEST rows: ROC-AUC, and average precision above prevalence.
USEFUL = {"roc_auc": 0.65, "lift": 0.05}


def landmark_rows(works: DataFrame, payments: DataFrame, fractions: tuple[float, ...] = LANDMARKS) -> DataFrame:
    """One row per work and landmark: what its payments were at that instant.

    Payments meet their work by an equi-join and are counted conditionally for every
    landmark at once, so histories are read once and never multiplied by the landmarks.
    """
    spine = works.where("sanctioned_on < expected_on").select("work_id", "sanctioned", "sanctioned_on", "expected_on", *[fractional_instant("sanctioned_on", "expected_on", F.lit(f)).alias(f"at_{i}") for i, f in enumerate(fractions)])
    joined = spine.join(payments.where("is_released").select("work_id", "released_on", "amount"), "work_id", "left")
    aggs = []
    for i in range(len(fractions)):
        seen = F.col("released_on").cast("timestamp") <= F.col(f"at_{i}")
        aggs += [F.count_if(seen).alias(f"n_{i}"), F.coalesce(F.sum(F.when(seen, F.col("amount"))), F.lit(0)).cast("bigint").alias(f"paid_{i}")]
    got = joined.groupBy("work_id", "sanctioned", *[f"at_{i}" for i in range(len(fractions))]).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("fraction"), F.col(f"at_{i}").alias("landmark"), F.col(f"n_{i}").alias("payment_count"), F.col(f"paid_{i}").alias("released_total")) for i, f in enumerate(fractions)])
    out = got.select("work_id", "sanctioned", F.explode(rows).alias("r")).select("work_id", "sanctioned", "r.*")
    return out.withColumn("spend_ratio", safe_ratio("released_total", "sanctioned"))


def split(works: DataFrame, label: str, shares: tuple[float, float] = (0.70, 0.15), seed: int = 42) -> DataFrame:
    """Adds TRAIN, VALIDATION or TEST by a hash of the work, stratified by label.

    The hash decides alone, so every row of a work falls into one part in any
    partitioning, no rank over a stratum is needed, and strata are split alike on average.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), "work_id", F.coalesce(F.col(label).cast("string"), F.lit(""))), F.lit(1_000_000)) / 1e6
    return works.withColumn("part", F.when(u < shares[0], "TRAIN").when(u < sum(shares), "VALIDATION").otherwise("TEST"))


def feasibility(rows: DataFrame, label: str, minimum: int = 50) -> DataFrame:
    """Whether a target has enough works of either label."""
    got = rows.agg(F.countDistinct(F.when(F.col(label) == 1, F.col("work_id"))).alias("positives"), F.countDistinct(F.when(F.col(label) == 0, F.col("work_id"))).alias("negatives"))
    return got.withColumn("feasible", (F.col("positives") >= minimum) & (F.col("negatives") >= minimum))


def ranking_metrics(rows: DataFrame, score: str, label: str, keys: list[str] = ()) -> DataFrame:
    """Per keys ROC-AUC, average precision, Brier score and prevalence."""
    keys = list(keys)
    basic = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"), F.avg(label).alias("prevalence"))
    if not keys:
        return basic.crossJoin(ranking(rows, score, label, []))  # one row each
    return basic.join(ranking(rows, score, label, keys), keys)


def calibration_error(rows: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins, the last one closed."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    each = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("p"), F.avg(label).alias("y"))
    return each.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("calibration_error"), F.sum("n").alias("rows"))


def top_fraction(rows: DataFrame, score: str, label: str, fractions: tuple[float, ...] = (0.01, 0.05, 0.10)) -> DataFrame:
    """Precision and recall among the ceil(n f) best rows. Ranks come from counts per score."""
    ranked = average_rank(rows.withColumn("neg__", -F.col(score)), [], "neg__", "r__", "n__")
    ties = F.row_number().over(W.partitionBy("neg__").orderBy("work_id"))
    size = F.count("*").over(W.partitionBy("neg__"))
    ranked = ranked.withColumn("place", F.col("r__") - (size - 1) / F.lit(2.0) + ties - 1)
    parts = [F.struct(F.lit(f).alias("fraction"), (F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("n__") * f))).alias("inside")) for f in fractions]
    long = ranked.select(label, F.explode(F.array(*parts)).alias("p")).select(label, "p.*")
    got = long.groupBy("fraction").agg(F.count_if("inside").alias("selected"), F.sum(F.when(F.col("inside"), F.col(label)).otherwise(0)).alias("hits"), F.sum(label).alias("positives"))
    return got.withColumns({"precision": safe_ratio("hits", "selected"), "recall": safe_ratio("hits", "positives")})


def threshold_search(rows: DataFrame, score: str, label: str, low: float = 0.15, steps: int = 71, width: float = 0.01) -> DataFrame:
    """The threshold of a grid with the best F1, the lowest on ties; scores are binned first."""
    bins = rows.groupBy(F.least(F.floor((F.col(score) - low) / width + 1e-9), F.lit(steps - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum(label).alias("p"))
    grid = bins.select("n", "p", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("k"), "bin")
    got = grid.groupBy("k").agg(F.sum(F.when(F.col("bin") >= F.col("k"), F.col("n")).otherwise(0)).alias("chosen"), F.sum(F.when(F.col("bin") >= F.col("k"), F.col("p")).otherwise(0)).alias("hits"), F.sum("p").alias("positives"))
    f1 = F.when(F.col("chosen") + F.col("positives") > 0, 2 * F.col("hits") / (F.col("chosen") + F.col("positives"))).otherwise(0.0)
    return got.select((F.lit(low) + F.col("k") * width).alias("threshold"), f1.alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


def serving_rank(rows: DataFrame, score: str) -> DataFrame:
    """Percentile and rank of the raw score among works in execution; others get none. Ties rank by work.

    Distinct scores are put in order once; both follow from how many rows stand before them.
    """
    serving = F.when(F.col("lifecycle") == "EXECUTION", F.col(score))
    rows = rows.withColumn("serving", serving)
    values = rows.where("serving is not null").groupBy("serving").agg(F.count("*").alias("same__"))
    values = cumulated(values, [], [F.col("serving")], F.col("same__"), "upto__", {"upto__": "n__"}).select(F.col("serving").alias("serving__"), "same__", "upto__", "n__")
    out = rows.join(values, F.col("serving") == F.col("serving__"), "left")
    average = F.col("upto__") - (F.col("same__") - 1) / F.lit(2.0)
    percentile = F.when(F.col("n__") == 1, F.lit(100.0)).otherwise((average - 1) / (F.col("n__") - 1) * 100)
    tie = F.row_number().over(W.partitionBy("serving__", "lifecycle").orderBy("work_id"))
    place = (F.col("n__") - F.col("upto__") + tie).cast("int")
    told = F.col("serving").isNotNull()
    return out.withColumns({"serving_percentile": F.when(told, percentile), "serving_rank": F.when(told, place)}).drop("serving__", "same__", "upto__", "n__")


def early_warning(probability: Column, threshold: float, useful: bool) -> Column:
    if not useful:
        return F.lit("UNAVAILABLE")
    return F.when(probability >= min(0.95, 1.35 * threshold), "HIGH_EARLY_WARNING").when(probability >= threshold, "ELEVATED_EARLY_WARNING").otherwise("NO_EARLY_WARNING")


def medians(rows: DataFrame, features: list[str]) -> dict[str, float]:
    """The lower median of each feature's values that aren't null or NaN, 0 without one; found over ranges of distinct values."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v__")) for f in features])).alias("x")).select("x.*")
    values = long.where("v__ is not null and not isnan(v__)").groupBy("feature", "v__").agg(F.count("*").alias("same__"))
    placed = cumulated(values, ["feature"], [F.col("v__")], F.col("same__"), "upto__", {"upto__": "n__"})
    middle = F.ceil(F.col("n__") / 2)
    found = placed.where((F.col("upto__") >= middle) & (F.col("upto__") - F.col("same__") < middle)).select("feature", "v__").collect()  # a row per feature
    return dict.fromkeys(features, 0.0) | {r.feature: r.v__ for r in found}


def fitted_models(rows: DataFrame, features: list[str], label: str) -> dict:
    """Logistic regression, a forest and boosted trees by name, fitted to the TRAIN rows.

    rows has `part`, the features and a 0/1 label. Classes weigh alike; medians are
    imputed from TRAIN. TRAIN rows are prepared and written out once for all models; Spark's
    own Imputer would hold all values of all features on the driver for exact medians.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler

    train = rows.where("part = 'TRAIN'")
    share = train.agg(F.avg(label)).first()[0] or 0.5
    weight = F.when(F.col(label) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9))
    filled = ", ".join(f"coalesce(nanvl(`{f}`, null), {v!r}D) AS `{f}__i`" for f, v in medians(train, features).items())
    imputer, assembler = SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"), VectorAssembler(inputCols=[f"{f}__i" for f in features], outputCol="raw__")
    raw = assembler.transform(imputer.transform(train)).select("raw__", label, weight.alias("weight__"))
    scaler = StandardScaler(inputCol="raw__", outputCol="x__", withMean=True).fit(raw)
    train = durable(scaler.transform(raw).select("x__", label, "weight__"))
    common = {"featuresCol": "x__", "labelCol": label, "weightCol": "weight__"}
    models = {"logistic": LogisticRegression(maxIter=30, regParam=0.01, **common), "forest": RandomForestClassifier(numTrees=30, maxDepth=5, seed=42, **common), "boosted": GBTClassifier(maxIter=15, maxDepth=3, seed=42, **common)}
    return {name: PipelineModel([imputer, assembler, scaler, model.fit(train)]) for name, model in models.items()}


def as_doubles(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("double") for c in columns})


def one_layout(rows: DataFrame, features: list[str]) -> DataFrame:
    """The rows written out in one layout in any partitioning, as forests draw their samples by partition."""
    rows = durable(rows)
    return durable(rows.repartition(max(8, -(-rows.count() // 100_000)), "work_id").sortWithinPartitions("work_id", *features))


def probability(model, rows: DataFrame) -> DataFrame:
    """Adds score, the fitted probability of label 1."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn("score", fixed(vector_to_array("probability")[1], 6))


def train_models(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """Metrics of VALIDATION and TEST of the `fitted_models`: part, model, roc_auc, average_precision, brier, rows."""
    from pyspark.ml.functions import vector_to_array

    rows = one_layout(as_doubles(rows.where(F.col(label).isNotNull()), [*features, label]).select("work_id", "part", *features, label), features)
    out = None
    for name, fitted in fitted_models(rows, features, label).items():
        scored = fitted.transform(rows.where("part <> 'TRAIN'")).select("part", F.lit(name).alias("model"), label, vector_to_array("probability")[1].alias("score"))
        got = ranking_metrics(scored, "score", label, ["part", "model"])
        out = got if out is None else out.unionByName(got)
    return out


def guarded_probability(rows: DataFrame, serving: DataFrame, features: list[str], label: str) -> DataFrame:
    """work_id, probability, status of the serving rows by the best of the `fitted_models`.

    The model is the one with the best average precision (then ROC-AUC) on VALIDATION rows,
    the threshold that of its best F1 there. Where a label has too few works, or the TEST
    rows show less than USEFUL over chance, no probability is served: null, UNAVAILABLE.
    """
    rows = as_doubles(rows.where(F.col(label).isNotNull()), [*features, label])
    serving = as_doubles(serving.select("work_id", *features), features)
    none = serving.select("work_id", F.lit(None).cast("double").alias("probability"), early_warning(F.lit(None).cast("double"), 0.0, False).alias("status"))
    if not feasibility(rows, label).first().feasible:
        return none
    rows = one_layout(rows, features)
    best = None
    for name, fitted in fitted_models(rows, features, label).items():
        held = durable(probability(fitted, rows.where("part <> 'TRAIN'")).select("part", label, "score"))
        got = {r.part: r for r in ranking_metrics(held, "score", label, ["part"]).collect()}
        if any(got.get(part) is None or got[part].roc_auc is None for part in ("VALIDATION", "TEST")):
            continue
        rank = (got["VALIDATION"].average_precision, got["VALIDATION"].roc_auc)
        if best is None or rank > best[0]:
            best = (rank, fitted, held, got["TEST"])
    if best is None:
        return none
    _, fitted, held, test = best
    if test.roc_auc < USEFUL["roc_auc"] or test.average_precision < test.prevalence + USEFUL["lift"]:
        return none
    threshold = threshold_search(held.where("part = 'VALIDATION'"), "score", label).first().threshold
    return probability(fitted, serving).select("work_id", F.col("score").alias("probability"), early_warning(F.col("score"), threshold, True).alias("status"))


TREES, SAMPLE = 100, 256


def isolation_forest(profile: DataFrame, features: list[str], by: str = "lifecycle", trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """work_id, lifecycle, anomaly_score (0 to 1, higher is odder), one forest per stage.

    Trees are grown on bounded samples chosen by hash, in the order of the hash; a sample
    needs a slot of the hash per row, so no stage is sorted or sent to one task. Growing
    takes `trees` x `sample` rows per stage; scoring streams all rows past the forests.
    """
    long = profile.select(by, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")).select(by, "x.*")
    middle = quantiles(long, [by, "feature"], "value", {"median": 0.5})
    medians = middle.groupBy(by).agg(*[F.max(F.when(F.col("feature") == f, F.col("median"))).alias(f"{f}__m") for f in features])
    medians = profile.select(by).distinct().join(medians, by, "left")
    rows = profile.join(F.broadcast(medians), by).select("work_id", by, *[F.coalesce(F.col(f).cast("double"), F.col(f"{f}__m"), F.lit(0.0)).alias(f) for f in features])  # a row per stage
    slots = trees * sample
    slot = F.pmod(F.xxhash64("work_id", F.lit("forest")), F.lit(slots))
    chosen = rows.withColumn("slot", slot).groupBy(by, "slot").agg(F.min_by(F.array(*features), F.xxhash64("work_id")).alias("x")).select(by, (F.col("slot") % trees).cast("int").alias("tree"), "x")

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows.x.to_numpy()).astype(float)
        x = x[np.lexsort(x.T[::-1])]
        draw = np.random.default_rng([42, int(key[1])])
        nodes: list[tuple] = []
        limit = int(np.ceil(np.log2(max(2, len(x)))))

        def node(part: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append(())
            low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(0), np.zeros(0))
            open_ = np.flatnonzero(high > low)
            if depth >= limit or len(part) <= 1 or not len(open_):
                nodes[at] = (at, -1, 0.0, depth + path_length(len(part)), -1, -1)
                return at
            f = int(draw.choice(open_))
            cut = float(draw.uniform(low[f], high[f]))
            left, right = node(part[part[:, f] < cut], depth + 1), node(part[part[:, f] >= cut], depth + 1)
            nodes[at] = (at, f, cut, 0.0, left, right)
            return at

        node(x, 0)
        out = pd.DataFrame(nodes, columns=["at", "feature", "cut", "depth", "low", "high"])
        return out.assign(stage=key[0], tree=int(key[1]), grown=len(x))

    forest = chosen.groupBy(by, "tree").applyInPandas(grow, "stage string, tree int, grown int, at int, feature int, cut double, depth double, low int, high int")
    grown = forest.toPandas()  # trees x 2 sample nodes a stage at most
    shared = profile.sparkSession.sparkContext.broadcast({s: [(int(t.grown.iloc[0]), t.sort_values("at")[["feature", "cut", "depth", "low", "high"]].to_numpy()) for _, t in g.groupby("tree")] for s, g in grown.groupby("stage")})

    def score(batches):
        for rows in batches:
            out = np.zeros(len(rows))
            for stage, at in rows.groupby(by).indices.items():
                x = rows[features].to_numpy()[at]
                forests = shared.value.get(stage, [])
                total, norm = np.zeros(len(at)), 0.0
                for n, nodes in forests:
                    place = np.zeros(len(at), int)
                    while (inner := nodes[place, 0] >= 0).any():
                        k = np.flatnonzero(inner)
                        f = nodes[place[k], 0].astype(int)
                        place[k] = np.where(x[k, f] < nodes[place[k], 1], nodes[place[k], 3], nodes[place[k], 4]).astype(int)
                    total += nodes[place, 2]
                    norm += path_length(n)
                out[at] = 2.0 ** (-total / max(norm, 1e-9)) if forests else 0.5
            yield pd.DataFrame({"work_id": rows.work_id, "lifecycle": rows[by], "anomaly_score": out})

    return rows.mapInPandas(score, "work_id long, lifecycle string, anomaly_score double")


def path_length(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
