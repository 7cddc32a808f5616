"""Similar-record pairs: exact top-k neighbours by cosine, pair scores and the review policy."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worksight.functions.geodesic import geodesic_km
from worksight.functions.scalar import amount_similarity, available_mean, date_proximity, haversine, ratio_similarity, same_text

#: Makes rows of unit vectors from packed ones.
Unpack = Callable[[Iterable[bytes]], np.ndarray]
#: Vectors of a block; two blocks meet in one task.
BLOCK = 2048


def best(ids: np.ndarray, others: np.ndarray, cos: np.ndarray, k: int) -> pd.DataFrame:
    """id, other, cosine of the k greatest finite entries of each row, ties by other."""
    if not (own := min(k, len(others))):
        return pd.DataFrame({"id": [], "other": [], "cosine": []}).astype({"id": "int64", "other": "int64", "cosine": "float64"})
    # All that reach the k-th cosine, ties included; only these are sorted.
    row, at = np.nonzero((cos >= np.partition(cos, len(others) - own, axis=1)[:, len(others) - own, None]) & np.isfinite(cos))
    order = np.lexsort((others[at], -cos[row, at], row))
    row, at = row[order], at[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, at = row[kept], at[kept]
    return pd.DataFrame({"id": ids[row], "other": others[at], "cosine": cos[row, at]})


def topk_neighbours(vectors: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, other, cosine of the k nearest other vectors of each, ties by id; exact.

    Vectors are dealt into blocks. Every block meets every block as two grouped tables of
    BLOCK rows each, multiplied as matrices; a task keeps k per row, and a second step
    keeps k of all. The work is quadratic, as exact search is; no task's input grows.
    """
    n = vectors.count()
    blocks = max(1, -(-n // BLOCK))
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<float>").alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("b")).where("id is not null and v is not null")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = own.withColumn("o", every).select("b", "o", "id", "v")
    right = own.withColumn("o", every).select(F.col("o").alias("b"), F.col("b").alias("o"), "id", "v")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "other": [], "cosine": []}).astype({"id": "int64", "other": "int64", "cosine": "float64"})
        x, y = (np.stack(t.v.to_numpy()).astype(np.float64) for t in (a, b))
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
        ids, others = a.id.to_numpy(), b.id.to_numpy()
        cos = np.round(x @ y.T, 6)
        cos[ids[:, None] == others[None, :]] = -np.inf
        return best(ids, others, cos, k)

    pairs = left.groupBy("b", "o").cogroup(right.groupBy("b", "o")).applyInPandas(meet, "id long, other long, cosine double")
    nth = F.row_number().over(W.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    return pairs.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def canonical_pairs(neighbours: DataFrame) -> DataFrame:
    """Unordered pairs (a, b), each once, with the greatest cosine."""
    return neighbours.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "cosine").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


# Component weights of a pair's score.
PAIR_WEIGHTS = {"text": 0.50, "location": 0.15, "amount": 0.15, "date": 0.10, "sector": 0.05, "sub_sector": 0.03, "agency": 0.02}


def pair_score(components: dict[str, Column]) -> Column:
    """0 to 100; missing components leave the weights of the others renormalised."""
    return available_mean([(components[c], w) for c, w in PAIR_WEIGHTS.items()]) * 100


def location_similarity(state: Column, district: Column, block: Column, village: Column, km: Column) -> Column:
    near = F.when(km.isNotNull(), F.greatest(F.lit(0.0), 1 - km / 25))
    return available_mean([(state.cast("double"), 0.40), (district.cast("double"), 0.25), (block.cast("double"), 0.15), (village.cast("double"), 0.10), (near, 0.10)])


# What a pair must reach to be worth a review.
POLICY = {"score": 90.0, "text": 0.97, "km": 1.0, "amount": 0.90, "days": 120}


def review_reasons() -> Column:
    """Names of the policy's checks that a pair fails; empty for a review candidate.

    Needs score, text, same_district, same_block, same_village, km, amount, days,
    same_sector and same_sub_sector; a missing value fails its check.
    """
    checks = {
        "score": F.col("score") >= POLICY["score"],
        "text": F.col("text") >= POLICY["text"],
        "district": F.col("same_district"),
        "block": F.col("same_block"),
        "village": F.col("same_village"),
        "distance": F.col("km") <= POLICY["km"],
        "amount": F.col("amount") >= POLICY["amount"],
        "date": F.col("days") <= POLICY["days"],
        "sector": F.col("same_sector"),
        "sub_sector": F.col("same_sub_sector"),
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def with_sides(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs (a, b, ..) with every column of the records (work_id, ..) of either side, as NAME_a and NAME_b."""
    side = lambda s: records.select(*[F.col(c).alias(f"{c}_{s}") for c in records.columns])
    return pairs.join(side("a"), F.col("a") == F.col("work_id_a")).join(side("b"), F.col("b") == F.col("work_id_b"))


def scored_pairs(near: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs (a, b, cosine) with their evidence, score and what the review policy needs.

    records has work_id, sector, sub_sector, state, district, block, village, latitude,
    longitude, recommended, sanctioned, recommended_on, agency. Amounts are compared by both
    the recommended and the sanctioned one, distances on the ellipsoid; what is missing on
    either side leaves the weights of the rest.
    """
    both = with_sides(near, records)
    same = {f"same_{c}": same_text(f"{c}_a", f"{c}_b") for c in ("state", "district", "block", "village", "sector", "sub_sector", "agency")}
    both = both.withColumns({**same, "km": geodesic_km("latitude_a", "longitude_a", "latitude_b", "longitude_b"), "days": F.abs(F.datediff("recommended_on_a", "recommended_on_b"))})
    both = both.withColumns({
        "location": location_similarity(*[F.col(f"same_{c}") for c in ("state", "district", "block", "village")], F.col("km")),
        "amount": available_mean([(amount_similarity("recommended_a", "recommended_b"), 0.6), (amount_similarity("sanctioned_a", "sanctioned_b"), 0.4)]),
        "date": date_proximity("recommended_on_a", "recommended_on_b"),
        "text": F.col("cosine"),
    })
    parts = {"text": F.col("text"), "location": F.col("location"), "amount": F.col("amount"), "date": F.col("date"), **{c: F.col(f"same_{c}").cast("double") for c in ("sector", "sub_sector", "agency")}}
    return both.withColumn("score", pair_score(parts)).select("a", "b", "cosine", "text", "km", "days", "location", "amount", "date", *same, "score")


# What corroborates a neighbour in the second profile.
CORROBORATED = {"text": 0.90, "amount": 0.90, "metres": 1500.0}


def corroborated_pairs(near: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs (a, b, cosine) by the second profile: ratio of amounts, great-circle metres, and whether all agree."""
    both = with_sides(near, records.select("work_id", "sector", "district", "sanctioned", "latitude", "longitude"))
    amount = F.coalesce(ratio_similarity("sanctioned_a", "sanctioned_b"), F.lit(0.0))
    both = both.withColumns({"amount": amount, "metres": haversine("latitude_a", "longitude_a", "latitude_b", "longitude_b"), "same_sector": F.coalesce(F.col("sector_a") == F.col("sector_b"), F.lit(False)), "same_district": F.coalesce(F.col("district_a") == F.col("district_b"), F.lit(False))})
    agreed = (F.col("cosine") >= CORROBORATED["text"]) & F.col("same_sector") & (F.col("amount") >= CORROBORATED["amount"]) & (F.col("metres") <= CORROBORATED["metres"])
    return both.select("a", "b", "cosine", "amount", "metres", "same_sector", "same_district", F.coalesce(agreed, F.lit(False)).alias("review"))


def best_candidates(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per id its best partner, review candidates before others, then by similarity, then by id."""
    both = symmetric(pairs, "cosine", "review")
    order = F.struct(~F.col("review"), -F.col("cosine"), F.col("other"))
    got = both.groupBy("id").agg(F.min_by(F.struct("other", "cosine", "review"), order).alias("x"))
    return ids.select("id").join(got, "id", "left").select("id", F.coalesce("x.review", F.lit(False)).alias("has_candidate"), F.col("x.other").alias("best"), F.col("x.cosine").alias("best_cosine"))


def symmetric(pairs: DataFrame, *carried: str) -> DataFrame:
    """Each pair from both sides: id, other and the carried columns."""
    sides = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))
    return pairs.select(F.explode(sides).alias("s"), *carried).select("s.*", *carried)


def pair_summary(ids: DataFrame, pairs: DataFrame, score: str, review: str) -> DataFrame:
    """Per id: candidates, the best one (by score, then id), and the same for review candidates."""
    both = symmetric(pairs, score, review)
    order = F.struct(-F.col(score), F.col("other"))
    good = F.col(review)
    got = both.groupBy("id").agg(F.count("*").alias("candidates"), F.min_by("other", order).alias("best"), F.max(score).alias("best_score"), F.count_if(good).alias("reviews"), F.min_by("other", F.when(good, order)).alias("best_review"), F.max(F.when(good, F.col(score))).alias("best_review_score"))
    out = ids.select("id").join(got, "id", "left")
    return out.select("id", F.coalesce("candidates", F.lit(0)).alias("candidates"), "best", "best_score", F.coalesce("reviews", F.lit(0)).alias("reviews"), "best_review", "best_review_score")


def normalize_texts(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds text in NFKC and folded case, letters, digits and hyphens only, single spaces.

    Texts go to Python a hundred at a time: an Arrow batch holds 10,000, however long, and
    is copied for every step.
    """
    nfkc = F.udf(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold(), "string", useArrow=False)

    from worksight.functions.scalar import normalized_text

    return df.withColumn(out, nfkc(F.col(column))).withColumn(out, normalized_text(out))
