"""Queries over texts of works and their DuckDB SQL; the catalog registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksight.functions.scalar import fixed
from worksight.operators import desk, pairs, serving, vectors
from worksight.plans import register, sql
from worksight.plans.catalog import query
from worksight.sources import domain
from worksight.sources.durable import durable


@query
def work_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors.search_texts(domain.register(spark, d))
    return rows.select("work_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("bigint").alias("chars"))


@query
def text_vectors(spark: SparkSession, d: str) -> DataFrame:
    entries = F.filter(F.transform("v", lambda x, i: F.struct(fixed(x, 6).alias("weight"), (-i).alias("slot"))), lambda e: e["weight"] > 0)
    rows = vectors.text_vectors(vectors.search_texts(domain.register(spark, d))).select("work_id", entries.alias("e"))
    top = F.array_max("e")
    return rows.select("work_id", F.size("e").cast("bigint").alias("slots"), (-top["slot"]).cast("bigint").alias("top_slot"), top["weight"].alias("top_weight"))


@query
def text_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Works among each other's ten nearest by search text, through the index."""
    return register.text_pairs(register.search_vectors(spark, d), 10).withColumn("cosine", fixed("cosine", 4))


def nearest_texts(spark: SparkSession, d: str, k: int) -> DataFrame:
    """query_id, chunk_id, score, place for the works whose id is divisible by 20, exact."""
    rows, unpack = register.description_vectors(spark, d)
    rows = rows.select(F.col("work_id").alias("id"), "v")
    return serving.cosine_topk(rows.where("id % 20 = 0"), rows, k, unpack)


@query
def text_topk(spark: SparkSession, d: str) -> DataFrame:
    return nearest_texts(spark, d, 5).select("query_id", "chunk_id", fixed("score", 4).alias("score"), "place")


@query
def similar_works(spark: SparkSession, d: str) -> DataFrame:
    got = desk.similar_works(nearest_texts(spark, d, 40), domain.register(spark, d).drop("description"))
    return got.withColumn("score", fixed("score", 4))


def second_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Works among each other's five nearest by description, all compared with all, and whether all else agrees."""
    near = register.text_pairs(register.description_vectors(spark, d), 5, exact=True)
    return pairs.corroborated_pairs(near, domain.register(spark, d).drop("description"))


@query
def v2_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = second_pairs(spark, d)
    return rows.select("a", "b", fixed("cosine", 4).alias("cosine"), fixed("amount", 6).alias("amount"), fixed("metres", 1).alias("metres"), "same_sector", "same_district", "review")


@query
def v2_pair_summary(spark: SparkSession, d: str) -> DataFrame:
    ids = domain.register(spark, d).where("work_id is not null").select(F.col("work_id").alias("id")).distinct()
    return pairs.best_candidates(ids, durable(second_pairs(spark, d))).withColumn("best_cosine", fixed("best_cosine", 4))


N = vectors.DIMENSIONS
_norm = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(nfc_normalize({c})), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g'), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _vectors(name: str, texts: str) -> dict[str, str]:
    """Expressions NAME_v (work_id, v) and NAME_nn (x, y, cosine, n) of texts (work_id, text)."""
    return {
        f"{name}_s": f"SELECT work_id, (('0x' || substr(md5(tok), 1, 3))::INT % {N}) AS slot, count(*) AS tf FROM (SELECT work_id, unnest(string_split(text, ' ')) AS tok FROM {texts}) WHERE tok NOT IN ('', '|') GROUP BY ALL",
        f"{name}_f": f"SELECT slot, ln((1 + (SELECT count(*) FROM {texts}))::DOUBLE / (1 + count(*))) + 1 AS rarity FROM {name}_s GROUP BY slot",
        f"{name}_w": f"SELECT work_id, slot, tf * rarity AS x, sqrt(sum(tf * rarity * tf * rarity) OVER (PARTITION BY work_id)) AS norm FROM {name}_s JOIN {name}_f USING (slot)",
        f"{name}_v": f"SELECT work_id, list(coalesce(x / norm, 0) ORDER BY slot) AS v FROM (SELECT work_id, slot FROM (SELECT DISTINCT work_id FROM {name}_w), (SELECT unnest(range({N})) AS slot)) LEFT JOIN {name}_w USING (work_id, slot) GROUP BY work_id",
        f"{name}_nn": f"SELECT *, row_number() OVER (PARTITION BY x ORDER BY cosine DESC, y) AS n FROM (SELECT p.work_id AS x, q.work_id AS y, round(list_cosine_similarity(p.v, q.v), 6) AS cosine FROM {name}_v p JOIN {name}_v q ON p.work_id <> q.work_id)",
    }


_f, _a = "(1 / 298.257223563::DOUBLE)", "6378137.0::DOUBLE"
_b2 = f"(({_a}) * (1 - {_f}))"
sql.extend(
    {
        "reg_w": """SELECT doc_id AS work_id, text AS description, lang AS sector, 'S' || (n_chars // 3000) AS sub_sector, 'R' || (n_chars // 8000) AS state, 'D' || (n_chars // 2000) AS district, 'B' || (n_chars // 500) AS block, 'V' || (n_chars // 100) AS village,
          10 + (n_chars // 100) * 0.01::DOUBLE AS latitude, 75 + (n_chars % 100) * 0.0001::DOUBLE AS longitude, n_chars * 100000 AS recommended, n_chars * 1000 * (90 + doc_id % 15) AS sanctioned, DATE '1997-01-01' + CAST(doc_id % 400 AS INTEGER) AS recommended_on, source AS agency FROM documents""",
        "reg_t": "SELECT work_id, concat_ws(' | ', " + ", ".join(f"CASE WHEN length({_norm(c)}) > 0 THEN '{label} ' || {_norm(c)} END" for c, label in vectors.LABELS.items()) + ") AS text FROM reg_w",
        "reg_d": f"SELECT work_id, CASE WHEN length({_norm('description')}) > 0 THEN 'work ' || {_norm('description')} ELSE '' END AS text FROM reg_w",
    }
    | _vectors("tx", "reg_t")
    | _vectors("dx", "reg_d")
    | {
        "tx_pairs": "SELECT least(x, y) AS a, greatest(x, y) AS b, max(cosine) AS cosine FROM tx_nn WHERE n <= 10 GROUP BY ALL",
        "dx_pairs": "SELECT least(x, y) AS a, greatest(x, y) AS b, max(cosine) AS cosine FROM dx_nn WHERE n <= 5 GROUP BY ALL",
        "geo_0": f"""SELECT a, b, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, dl, dl AS lam, 0 AS i FROM
          (SELECT a, b, atan((1 - {_f}) * tan(radians(p.latitude))) AS u1, atan((1 - {_f}) * tan(radians(q.latitude))) AS u2, radians(q.longitude - p.longitude) AS dl FROM tx_pairs JOIN reg_w p ON p.work_id = a JOIN reg_w q ON q.work_id = b)""",
        "geo_i": f"""SELECT * FROM geo_0 UNION ALL SELECT a, b, s1, c1, s2, c2, dl, dl + (1 - c) * {_f} * az * (arc + c * si * (mid + c * co * (2 * mid * mid - 1))), i + 1 FROM
          (SELECT *, {_f} / 16 * q * (4 + {_f} * (4 - 3 * q)) AS c, CASE WHEN q <= 0 THEN 0 ELSE co - 2 * s1 * s2 / q END AS mid FROM
            (SELECT *, 1 - az * az AS q, atan2(si, co) AS arc FROM (SELECT *, CASE WHEN si = 0 THEN 0 ELSE c1 * c2 * sin(lam) / si END AS az FROM
              (SELECT *, sqrt((c2 * sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * cos(lam)) ** 2) AS si, s1 * s2 + c1 * c2 * cos(lam) AS co FROM geo_i WHERE i < 6))))""",
        "geo_m": f"""SELECT a, b, {_b2} * (1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768))) * (arc - bb * si * (mid + bb / 4 * (co * (2 * mid * mid - 1) - bb / 6 * mid * (4 * si * si - 3) * (4 * mid * mid - 3)))) / 1000 AS km FROM
          (SELECT *, u / 1024 * (256 + u * (u * (74 - 47 * u) - 128)) AS bb FROM (SELECT *, q * (({_a}) ** 2 - {_b2} ** 2) / {_b2} ** 2 AS u, CASE WHEN q <= 0 THEN 0 ELSE co - 2 * s1 * s2 / q END AS mid FROM
            (SELECT *, 1 - az * az AS q, atan2(si, co) AS arc FROM (SELECT *, CASE WHEN si = 0 THEN 0 ELSE c1 * c2 * sin(lam) / si END AS az FROM
              (SELECT *, sqrt((c2 * sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * cos(lam)) ** 2) AS si, s1 * s2 + c1 * c2 * cos(lam) AS co FROM geo_i WHERE i = 6)))))""",
        "pe_0": """SELECT a, b, cosine, km, p.state = q.state AS st, p.district = q.district AS di, p.block = q.block AS bl, p.village = q.village AS vi, p.sector = q.sector AS se, p.sub_sector = q.sub_sector AS su, p.agency = q.agency AS ag,
          0.6 * (1 - abs(p.recommended - q.recommended)::DOUBLE / greatest(p.recommended, q.recommended)) + 0.4 * (1 - abs(p.sanctioned - q.sanctioned)::DOUBLE / greatest(p.sanctioned, q.sanctioned)) AS amount, abs(p.recommended_on - q.recommended_on) AS days
          FROM tx_pairs JOIN geo_m USING (a, b) JOIN reg_w p ON p.work_id = a JOIN reg_w q ON q.work_id = b""",
        "pe_1": "SELECT *, 0.4 * st::INT + 0.25 * di::INT + 0.15 * bl::INT + 0.1 * vi::INT + 0.1 * greatest(0, 1 - km / 25) AS place_, greatest(0, 1 - days / 365.0::DOUBLE) AS near_ FROM pe_0",
        "pe_2": "SELECT *, 100 * (0.5 * cosine + 0.15 * place_ + 0.15 * amount + 0.1 * near_ + 0.05 * se::INT + 0.03 * su::INT + 0.02 * ag::INT) AS score_ FROM pe_1",
        "pe_3": "SELECT *, concat_ws(',', CASE WHEN score_ < 90 THEN 'score' END, CASE WHEN cosine < 0.97 THEN 'text' END, CASE WHEN NOT di THEN 'district' END, CASE WHEN NOT bl THEN 'block' END, CASE WHEN NOT vi THEN 'village' END, CASE WHEN km > 1 THEN 'distance' END, CASE WHEN amount < 0.9 THEN 'amount' END, CASE WHEN days > 120 THEN 'date' END, CASE WHEN NOT se THEN 'sector' END, CASE WHEN NOT su THEN 'sub_sector' END) AS reasons FROM pe_2",
        "pe_s": "SELECT a AS id, b AS other, score_ AS s, reasons = '' AS ok FROM pe_3 UNION ALL SELECT b, a, score_, reasons = '' FROM pe_3",
        "hv_0": "SELECT a, b, cosine, p.sector = q.sector AS same_sector, p.district = q.district AS same_district, least(p.sanctioned, q.sanctioned)::DOUBLE / greatest(p.sanctioned, q.sanctioned) AS amount, 2 * 6371000.0::DOUBLE * asin(sqrt(sin(radians(q.latitude - p.latitude) / 2) ** 2 + cos(radians(p.latitude)) * cos(radians(q.latitude)) * sin(radians(q.longitude - p.longitude) / 2) ** 2)) AS metres FROM dx_pairs JOIN reg_w p ON p.work_id = a JOIN reg_w q ON q.work_id = b",
        "hv_1": "SELECT *, cosine >= 0.9 AND same_sector AND amount >= 0.9 AND metres <= 1500 AS review FROM hv_0",
        "hv_s": "SELECT a AS id, b AS other, cosine, review FROM hv_1 UNION ALL SELECT b, a, cosine, review FROM hv_1",
        "sw_n": "SELECT x, y, floor(c * 100000 + 0.5) / 100000 AS score FROM (SELECT p.work_id AS x, q.work_id AS y, list_inner_product(p.v, q.v) AS c FROM dx_v p JOIN dx_v q ON p.work_id <> q.work_id WHERE p.work_id % 20 = 0)",
        "sw_k": "SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) AS place FROM sw_n",
        "sw_l": """SELECT x, y, score, place, p.sector = q.sector AS se, p.district = q.district AS di, 1 - abs(p.recommended - q.recommended)::DOUBLE / greatest(p.recommended, q.recommended) AS amount, p.sub_sector = q.sub_sector AS su,
          2 * 6371.0088::DOUBLE * asin(sqrt(sin(radians(q.latitude - p.latitude) / 2) ** 2 + cos(radians(p.latitude)) * cos(radians(q.latitude)) * sin(radians(q.longitude - p.longitude) / 2) ** 2)) AS km FROM sw_k JOIN reg_w p ON p.work_id = x JOIN reg_w q ON q.work_id = y WHERE place <= 40""",
    }
)
SQL = {
    "work_texts": "SELECT work_id, sha256(text) AS text_sha256, length(text) AS chars FROM reg_t",
    "text_vectors": "SELECT work_id, count(*) AS slots, arg_max(slot, (w, -slot))::BIGINT AS top_slot, max(w) AS top_weight FROM (SELECT work_id, slot, round(x / norm, 6) AS w FROM tx_w) WHERE w > 0 GROUP BY work_id",
    "text_pairs": "SELECT a, b, round(cosine, 4) AS cosine FROM tx_pairs",
    "pair_score": "SELECT a, b, round(cosine, 4) AS cosine, round(km, 3) AS km, round(place_, 4) AS location, round(amount, 4) AS amount, round(near_, 4) AS date, round(score_, 3) AS score FROM pe_2",
    "pair_review_policy": "SELECT a, b, reasons FROM pe_3",
    "pair_symmetric_summary": "SELECT work_id AS id, count(other) AS candidates, arg_min(other, (-s, other)) AS best, round(max(s), 3) AS best_score, count(*) FILTER (ok) AS reviews, arg_min(other, (-s, other)) FILTER (ok) AS best_review, round(max(s) FILTER (ok), 3) AS best_review_score FROM reg_w LEFT JOIN pe_s ON id = work_id GROUP BY work_id",
    "text_topk": "SELECT x AS query_id, y AS chunk_id, round(score, 4) AS score, place FROM sw_k WHERE place <= 5",
    "similar_works": "SELECT x AS asked_id, y AS work_id, row_number() OVER (PARTITION BY x ORDER BY place) AS nth, round(score, 4) AS score, round(km, 2) AS km, CASE WHEN score >= 0.72 AND se AND amount >= 0.7 AND (km <= 5 OR di) THEN 'High' ELSE 'Possible' END AS match FROM sw_l WHERE score >= 0.45 OR (se AND su AND di) QUALIFY nth <= 5",
    "v2_pairs": "SELECT a, b, round(cosine, 4) AS cosine, round(amount, 6) AS amount, round(metres, 1) AS metres, same_sector, same_district, review FROM hv_1",
    "v2_pair_summary": "SELECT work_id AS id, coalesce(bool_or(review), false) AS has_candidate, arg_min(other, (NOT review, -cosine, other)) AS best, round(arg_min(cosine, (NOT review, -cosine, other)), 4) AS best_cosine FROM reg_w LEFT JOIN hv_s ON id = work_id GROUP BY work_id",
}
