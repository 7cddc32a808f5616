"""Queries of evidence as it is told and their DuckDB SQL; the catalog registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksight.functions.scalar import fixed
from worksight.operators import evidence, fusion, passages, peers, serving, signals
from worksight.plans import flows, register, retrieval, sql
from worksight.plans.catalog import Tables, given, given_models, labelled, query, wide_signals
from worksight.plans.texts import nearest_texts
from worksight.sources import domain
from worksight.sources.domain import AS_OF, table

#: A piece that no page has, however long; pieces count from 0.
NO_PIECE = -1


@query
def anomaly_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The given anomaly percentile of each work with its strongest peer deviation."""
    t = Tables(spark, d)
    odd = given_models(t)[0]
    rows = evidence.with_strongest_peer(odd, peers.peer_evidence(t.profile, ["released_total", "planned_days"]))
    return rows.select("work_id", fixed("odd", 4).alias("odd"), "metric", "level", "peers", fixed("deviation", 4).alias("deviation"), "method", "outliers")


@query
def evidence_bundle(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    wide, funds, found, rules = wide_signals(t, given)
    points = fusion.family_evidence(wide).where("points > 0").withColumn("points", F.floor(F.col("points") * 1000 + 0.5).cast("bigint"))
    told = fusion.review_alerts(wide, funds, found, rules)
    counted = found.groupBy("work_id", "signal_code").agg(F.count("*").alias("n"))
    sections = [
        evidence.listed(points, "contributions", [-F.col("points"), F.col("family")], "family", "code", "points"),
        evidence.listed(told, "alerts", [F.col("alert_type"), F.col("evidence_code")], "alert_type", "evidence_code"),
        evidence.listed(counted, "payments", [F.col("signal_code")], "signal_code", "n"),
        evidence.listed(rules.where("result in ('NON_COMPLIANT', 'REVIEW')"), "rules", [F.col("rule_id")], "rule_id", "result"),
    ]
    return evidence.bundle(t.profile, *sections)


@query
def grounding_audit(spark: SparkSession, d: str) -> DataFrame:
    """Answers made from the chunks of pages, some of which claim what isn't there."""
    held = passages.chunks(retrieval.site_pages(spark, d))
    chunks = held.select(F.concat_ws("-", "page", "piece").alias("chunk_id"), F.col("page").alias("first_page"), F.col("page").alias("last_page"), "clauses", "text")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"))
    k = lambda n: F.col("id") % n
    cited = F.array(F.struct(F.concat_ws("-", F.col("id"), F.when(k(5) == 0, NO_PIECE).otherwise(0)).alias("chunk_id"), (F.col("id") + (k(3) == 0).cast("int")).alias("page"), F.when(k(4) == 0, "1.2").alias("clause")))
    answers = pages.select("id", F.col("id").alias("work_id"), F.array(F.lit("C1"), F.concat(F.lit("C"), k(4).cast("string"))).alias("codes"), cited.alias("cited"), F.concat(F.lit("a note on RULE-"), k(3).cast("string"), F.when(k(13) == 0, ", guilty").otherwise(".")).alias("text"))
    known = pages.select("id", (F.col("id") + (k(11) == 0).cast("int")).alias("known_work"), F.array(*[F.lit(c) for c in ("C1", "C2", "C3")]).alias("known_codes"), F.array(F.lit("RULE-1"), F.lit("RULE-2")).alias("known_rules"))
    return evidence.grounding_issues(answers, known, chunks)


@query
def duplicate_distribution(spark: SparkSession, d: str) -> DataFrame:
    rows = evidence.score_distribution(register.scored(spark, d))
    return rows.withColumns({c: fixed(c, 3) for c, kind in rows.dtypes if kind == "double"})


@query
def duplicate_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = evidence.structured_audit(register.scored(spark, d), (60.0, 75.0, 85.0, 90.0))
    return rows.withColumns({c: fixed(c, 3) for c, kind in rows.dtypes if kind == "double" and c != "least"})


@query
def copies_retrieved(spark: SparkSession, d: str) -> DataFrame:
    """Documents with one text, and how many of them the pairs by text find with the first."""
    told = table(spark, d, "documents").where("text <> ''").select(F.col("doc_id").alias("work_id"), F.xxhash64("text").alias("group_id"))
    return evidence.known_pairs(told, register.text_pairs(register.description_vectors(spark, d), 10))


@query
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = evidence.confusion(labelled(spark, d), "score", "label", 0.4, ["model"])
    return rows.withColumns({c: fixed(c, 6) for c in ("precision", "recall", "f1")})


@query
def my_works(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    works = t.profile.withColumn("needs_attention", F.coalesce(F.col("overdue_days") > 0, F.lit(False)))
    asked = flows.workflow_states(spark, d).select(F.col("user_id").alias("recommendation_id"), F.col("user_id").alias("mp_id"), (F.col("actions") * 1000).alias("cost"), "status", (F.col("refused_steps") > 45).alias("needs_attention"))
    return evidence.my_works(works, asked, 7)


@query
def two_channel(spark: SparkSession, d: str) -> DataFrame:
    """For each asked work the two records after it, which it refers to, then the most similar texts not among them."""
    own = domain.register(spark, d).select(F.col("work_id").alias("chunk_id"))
    asked = own.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.explode(F.array(F.col("chunk_id") + 1, F.col("chunk_id") + 2)).alias("chunk_id"))
    direct = asked.join(own, "chunk_id", "left_semi")
    return serving.two_channel(direct, nearest_texts(spark, d, 15), 6, 5).select("query_id", "chunk_id", "channel", "place")


@query
def rule_traces(spark: SparkSession, d: str) -> DataFrame:
    """Rules that point to the first chunk of a page and quote its chapter or a clause; those whose chunk or quotation isn't there."""
    held = passages.chunks(retrieval.site_pages(spark, d))
    chunks = held.select(F.concat_ws("-", "page", "piece").alias("chunk_id"), "text")
    first = held.where("piece = 0").select(F.col("page").alias("p"), "chapter")
    rules = table(spark, d, "pages").select(F.col("page_id").alias("p")).join(first, "p", "left")
    rules = rules.select(F.concat(F.lit("RULE-"), "p").alias("rule_id"), F.concat_ws("-", F.col("p"), F.when(F.col("p") % 5 == 0, NO_PIECE).otherwise(0)).alias("chunk_id"), F.when(F.col("p") % 2 == 0, "9.9.9").otherwise(F.coalesce("chapter", F.lit("FRONT"))).alias("clause"))
    return signals.rule_traceability(rules, chunks)


_json = lambda fields: "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in fields.items()) + " || '}'"
_s = lambda c: f"'\"' || {c} || '\"'"
sql.extend(
    {
        "ae_0": "SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY abs(deviation) DESC, mo) AS first_, count(*) FILTER (abs(deviation) >= 3.5) OVER (PARTITION BY work_id) AS outs FROM pe WHERE deviation IS NOT NULL",
        "eb_c": f"SELECT work_id, '\"contributions\":[' || string_agg({_json({'family': _s('family'), 'code': _s('code'), 'points': 'floor(points * 1000 + 0.5)::BIGINT'})}, ',' ORDER BY floor(points * 1000 + 0.5) DESC, family) || ']' AS a FROM contrib WHERE points > 0 GROUP BY work_id",
        "eb_a": f"SELECT work_id, '\"alerts\":[' || string_agg({_json({'alert_type': _s('alert_type'), 'evidence_code': _s('evidence_code')})}, ',' ORDER BY alert_type, evidence_code) || ']' AS b FROM alerts GROUP BY work_id",
        "eb_p": f"SELECT work_id, '\"payments\":[' || string_agg({_json({'signal_code': _s('signal_code'), 'n': 'n'})}, ',' ORDER BY signal_code) || ']' AS c FROM (SELECT work_id, signal_code, count(*) AS n FROM sigs GROUP BY ALL) GROUP BY work_id",
        "eb_r": f"SELECT work_id, '\"rules\":[' || string_agg({_json({'rule_id': _s('rule_id'), 'result': _s('result')})}, ',' ORDER BY rule_id) || ']' AS d FROM rule WHERE result IN ('NON_COMPLIANT', 'REVIEW') GROUP BY work_id",
        "ga_c": "SELECT page || '-' || piece AS cid FROM ck_3",
        "da_0": "SELECT * FROM pe_2, (SELECT unnest([60.0, 75.0, 85.0, 90.0])::DOUBLE AS least_) WHERE score_ >= least_",
        "tc_0": "SELECT p.work_id AS x, q.work_id AS y FROM reg_w p JOIN reg_w q ON q.work_id IN (p.work_id + 1, p.work_id + 2) WHERE p.work_id % 20 = 0",
        "tc_1": "SELECT x, y, 0 AS channel, 0.0::DOUBLE AS score FROM tc_0 UNION ALL SELECT x, y, 1, score FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) AS n FROM (SELECT * FROM sw_k WHERE place <= 15) k WHERE NOT EXISTS (SELECT 1 FROM tc_0 WHERE tc_0.x = k.x AND tc_0.y = k.y)) WHERE n <= 5",
        "tc_2": "SELECT *, row_number() OVER (PARTITION BY x ORDER BY channel, score DESC, y) AS place, count(*) FILTER (channel = 0) OVER (PARTITION BY x) AS directs FROM tc_1",
    }
)
_pct = lambda c: f"round(100 * avg({c}::INT), 3)"
_q = lambda c, q: f"round(quantile_cont({c}::DOUBLE, {q}), 3)"
SQL = {
    "anomaly_evidence": "SELECT work_id, round(odd, 4) AS odd, metric, level, n AS peers, round(deviation, 4) AS deviation, method, coalesce(outs, 0) AS outliers FROM odd LEFT JOIN (SELECT * FROM ae_0 WHERE first_ = 1) USING (work_id)",
    "evidence_bundle": "SELECT work_id, '{' || concat_ws(',', '\"work_id\":' || work_id, '\"lifecycle\":\"' || lifecycle || '\"', a, b, c, d) || '}' AS bundle FROM p LEFT JOIN eb_c USING (work_id) LEFT JOIN eb_a USING (work_id) LEFT JOIN eb_p USING (work_id) LEFT JOIN eb_r USING (work_id)",
    "grounding_audit": " UNION ALL ".join(
        f"SELECT page_id AS id, '{issue}' AS issue FROM pages WHERE {test}"
        for issue, test in (
            ("WORK_ID_MISMATCH", "page_id % 11 = 0"),
            ("UNKNOWN_EVIDENCE_CODES", "page_id % 4 = 0"),
            ("INVENTED_COMPLIANCE_RULE", "page_id % 3 = 0"),
            ("PROHIBITED_VERDICT_LANGUAGE", "page_id % 13 = 0"),
            ("UNKNOWN_CHUNK_ID", "page_id % 5 = 0 OR page_id || '-0' NOT IN (SELECT cid FROM ga_c)"),
            ("UNSUPPORTED_PAGE", "page_id % 5 <> 0 AND page_id % 3 = 0 AND page_id || '-0' IN (SELECT cid FROM ga_c)"),
            ("UNSUPPORTED_CLAUSE", "page_id % 5 <> 0 AND page_id % 4 = 0 AND page_id || '-0' IN (SELECT cid FROM ga_c)"),
        )
    ),
    "rule_traces": "SELECT 'RULE-' || page_id AS rule_id, CASE WHEN f.page IS NULL OR page_id % 5 = 0 THEN 'MISSING_CHUNK' ELSE 'CLAUSE_NOT_FOUND' END AS fault FROM pages LEFT JOIN (SELECT page, body_, chapter FROM ck_3 WHERE piece = 0) f ON f.page = page_id WHERE f.page IS NULL OR page_id % 5 = 0 OR NOT contains(body_, CASE WHEN page_id % 2 = 0 THEN '9.9.9' ELSE chapter END)",
    "duplicate_distribution": "SELECT count(*) AS pairs, round(min(score_), 3) AS minimum, round(max(score_), 3) AS maximum, " + ", ".join(f"{_q('score_', q)} AS {c}" for c, q in (("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p97_5", 0.975), ("p99", 0.99))) + " FROM pe_2",
    "duplicate_audit": "SELECT least_ AS least, count(*) AS pairs, "
    + ", ".join(f"{_pct(c)} AS same_{name}_pct" for name, c in (("district", "di"), ("block", "bl"), ("village", "vi"), ("sector", "se"), ("sub_sector", "su"), ("agency", "ag")))
    + ", "
    + ", ".join(f"{_q(c, q)} AS {name}" for name, c, q in (("text_median", "cosine", 0.5), ("text_p90", "cosine", 0.9), ("km_median", "km", 0.5), ("km_p90", "km", 0.9), ("amount_p10", "amount", 0.1), ("amount_median", "amount", 0.5), ("days_median", "days", 0.5), ("days_p90", "days", 0.9)))
    + " FROM da_0 GROUP BY least_",
    "copies_retrieved": "SELECT count(*) AS known, count(*) FILTER (n <= 10 OR back <= 10) AS retrieved FROM (SELECT least_ AS a, doc_id AS b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS least_ FROM documents WHERE text <> '') WHERE doc_id <> least_) k LEFT JOIN (SELECT x, y, n FROM dx_nn) f ON f.x = a AND f.y = b LEFT JOIN (SELECT x, y, n AS back FROM dx_nn) g ON g.x = b AND g.y = a",
    "confusion_matrix": "SELECT *, CASE WHEN true_positive + false_positive > 0 THEN round(true_positive::DOUBLE / (true_positive + false_positive), 6) END AS precision, CASE WHEN true_positive + false_negative > 0 THEN round(true_positive::DOUBLE / (true_positive + false_negative), 6) END AS recall, round(2.0::DOUBLE * true_positive / (2 * true_positive + false_positive + false_negative), 6) AS f1 FROM (SELECT CASE WHEN toxic = 1 THEN 'A' ELSE 'B' END AS model, count(*) FILTER (s >= 0.4 AND quality = 1) AS true_positive, count(*) FILTER (s >= 0.4 AND quality <> 1) AS false_positive, count(*) FILTER (s < 0.4 AND quality = 1) AS false_negative, count(*) FILTER (s < 0.4 AND quality <> 1) AS true_negative FROM (SELECT *, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS s FROM labels) GROUP BY 1)",
    "my_works": "SELECT 'ANALYTICAL_WORK' AS record_type, work_id::VARCHAR AS id, sanctioned AS cost, status, CASE lifecycle WHEN 'COMPLETION' THEN 'COMPLETED' WHEN 'EXECUTION' THEN 'ONGOING' ELSE 'RECOMMENDED' END AS category, coalesce(overdue_days > 0, false) AS needs_attention FROM p WHERE mp_id = 7 UNION ALL SELECT 'RUNTIME_RECOMMENDATION', user_id::VARCHAR, actions * 1000, status, CASE WHEN status IN ('COMPLETED', 'CLOSED') THEN 'COMPLETED' WHEN status IN ('SANCTIONED', 'IN_PROGRESS') THEN 'ONGOING' ELSE 'RECOMMENDED' END, refused > 45 OR status = 'NEEDS_CLARIFICATION' FROM (SELECT user_id, max(n) AS actions, arg_max(status, n) AS status, max(no_step) AS refused FROM wf_i GROUP BY user_id) WHERE user_id = 7",
    "two_channel": "SELECT x AS query_id, y AS chunk_id, channel, place FROM tc_2 WHERE place <= greatest(6, directs)",
}
