"""Queries over pages, excerpts and the budget of evidence, and their DuckDB SQL; the catalog registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worksight.operators import passages, signals
from worksight.plans import sql
from worksight.plans.catalog import Tables, query
from worksight.sources import domain
from worksight.sources.domain import AS_OF, table

HOST = r"^https?://([^/]*)"


def site_pages(spark: SparkSession, d: str) -> DataFrame:
    """Web pages as the pages of documents: doc is the host, page the page's id."""
    return table(spark, d, "pages").select(F.regexp_extract("url", HOST, 1).alias("doc"), F.col("page_id").alias("page"), passages.page_text("html").alias("text"))


@query
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = passages.chunks(site_pages(spark, d))
    return rows.select("doc", "page", F.col("piece").cast("bigint").alias("piece"), "start", "end", "chapter", F.array_join("clauses", ",").alias("clauses"), "printed_page", F.sha2("text", 256).alias("text_sha256"))


@query
def clause_extract(spark: SparkSession, d: str) -> DataFrame:
    """Per document its chapters in the chunks, and the numbered clauses of these."""
    rows = passages.chunks(site_pages(spark, d), 300)
    return rows.groupBy("doc", "chapter").agg(F.count("*").alias("chunks"), F.sum(F.size("clauses")).alias("clauses"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query
def excerpt_spans(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts of pages for the title of the next page of the same host."""
    pages = site_pages(spark, d)
    title = F.regexp_extract("text", passages.CHAPTER, 1)
    rows = passages.cleaned(pages).select("page", "text", "doc", title.alias("title"))
    rows = rows.withColumn("query", F.lead("title").over(W.partitionBy("doc").orderBy("page"))).where("query <> ''").withColumnRenamed("page", "id")
    return passages.best_spans(rows.select("id", "text", "query")).select(F.col("id").alias("page"), "start", "end", F.col("words").cast("bigint").alias("words"))


def evidence_pieces(t: Tables) -> DataFrame:
    """Rules that fail and strong signals must be told, reviews and other signals may be, and what describes the work."""
    rules = signals.rule_evidence(t.profile, t.assets, AS_OF).where("result in ('NON_COMPLIANT', 'REVIEW')")
    rules = rules.select("work_id", F.when(F.col("result") == "NON_COMPLIANT", "MANDATORY").otherwise("OPTIONAL").alias("kind"), F.lit(1).alias("priority"), F.col("rule_id").alias("piece"), (200 + 40 * F.length("rule_id")).alias("bytes"))
    found = signals.payment_signals(t.profile, t.payments, AS_OF).groupBy("work_id", "signal_code", "severity").agg(F.count("*").alias("n"))
    found = found.select("work_id", F.when(F.col("severity") == "STRONG_WARNING", "MANDATORY").otherwise("OPTIONAL").alias("kind"), F.lit(2).alias("priority"), F.col("signal_code").alias("piece"), (300 * F.col("n")).alias("bytes"))
    told = domain.register(t.spark, t.sf_dir).where("description is not null").select("work_id", F.lit("SEMANTIC").alias("kind"), F.lit(1).alias("priority"), F.lit("DESCRIPTION").alias("piece"), F.least(F.lit(passages.SEMANTIC), F.length("description")).alias("bytes"))
    return rules.unionByName(found).unionByName(told)


@query
def evidence_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = passages.budgeted(evidence_pieces(Tables(spark, d)), items=4, budget=3000, frame=300)
    return passages.budget_summary(rows)


def _text(html: str) -> str:
    steps = [
        (r"(?s)<(?:script|style|head)\b.*?</(?:script|style|head)>|<!--.*?-->", ""),
        (r"\s+", " "),
        (r"<h[1-6][^>]*>", "' || chr(10) || chr(10) || '# "),
        (r"</h[1-6]>|</?(?:p|article|footer|nav|div|body)\b[^>]*>", "' || chr(10) || chr(10) || '"),
        (r"<(?:br|li|tr)\b[^>]*>", "' || chr(10) || '"),
        (r"<[^>]*>", ""),
        *((f"&{name};", sign) for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("middot", "·"), ("copy", "©"), ("nbsp", " "), ("amp", "&"))),
        (r" *\n *", "' || chr(10) || '"),
        (r"\n{3,}", "' || chr(10) || chr(10) || '"),
    ]
    out = html
    for pattern, into in steps:
        out = f"regexp_replace({out}, '{pattern}', '{into}', 'g')"
    return f"trim({out})"


_host = f"regexp_extract(url, '{HOST}', 1)"
_cut = lambda n: f"regexp_extract_all(body || chr(10), '(?s)(?:.{{1,{n - 1}}}\\n|.{{1,{n}}})')"


def _chunks(name: str, n: int) -> dict[str, str]:
    return {
        f"{name}_0": f"SELECT doc, page, unnest({_cut(n)}) AS piece_text, unnest(range(len({_cut(n)}))) AS piece FROM pg_c WHERE body <> ''",
        f"{name}_1": f"SELECT doc, page, piece, coalesce(sum(length(piece_text)) OVER (PARTITION BY doc, page ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_, regexp_replace(piece_text, '\\n+$', '') AS body_ FROM {name}_0",
        f"{name}_2": f"SELECT *, nullif(regexp_extract(body_, '(?m)^# (.+)$', 1), '') AS heading_ FROM {name}_1 WHERE body_ <> ''",
        f"{name}_3": f"SELECT *, coalesce(last_value(heading_ IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page, piece ROWS UNBOUNDED PRECEDING), 'FRONT MATTER') AS chapter, list_distinct(regexp_extract_all(body_, '(?m)^[ \\t]*\\*?(\\d+(?:\\.\\d+){{1,3}})\\s', 1)) AS found_ FROM {name}_2",
    }


sql.extend(
    {
        "pg_t": f"SELECT {_host} AS doc, page_id AS page, list_transform(string_split({_text('html')}, chr(10)), lambda x: trim(x)) AS ls FROM pages",
        "pg_h": "SELECT doc, list(head_) AS heads_ FROM (SELECT doc, head_, count(*) AS n FROM (SELECT doc, list_filter(ls, lambda x: x <> '')[1] AS head_ FROM pg_t) WHERE head_ IS NOT NULL GROUP BY ALL) JOIN (SELECT doc, count(*) AS all_ FROM pg_t GROUP BY doc) USING (doc) WHERE n >= greatest(3, all_ / 2.0) GROUP BY doc",
        "pg_k": "SELECT doc, page, regexp_replace(regexp_replace(array_to_string(list_filter(ls, lambda x: NOT coalesce(list_contains(heads_, x), false)), chr(10)), '^\\n+', ''), '\\n+$', '') AS raw_ FROM pg_t LEFT JOIN pg_h USING (doc)",
        "pg_n": f"SELECT *, CASE WHEN regexp_matches(string_split(raw_, chr(10))[-1], '{passages.PAGE_NUMBER}') THEN string_split(raw_, chr(10))[-1] END AS printed_ FROM pg_k",
        "pg_c": "SELECT doc, page, printed_, regexp_replace(regexp_replace(CASE WHEN printed_ IS NULL THEN raw_ ELSE raw_[1:length(raw_) - length(printed_)] END, '\\n{3,}', chr(10) || chr(10), 'g'), '\\n+$', '') AS body FROM pg_n",
    }
    | _chunks("ck", passages.PIECE)
    | _chunks("cl", 300)
    | {
        "ex_q": "SELECT * FROM (SELECT page, body, lead(regexp_extract(body, '(?m)^# (.+)$', 1)) OVER (PARTITION BY doc ORDER BY page) AS asked_ FROM pg_c) WHERE asked_ <> ''",
        "ex_w": "SELECT page, body, list_sort(list_distinct(regexp_extract_all(lower(asked_), '[\\p{L}\\p{N}_]+'))) AS words_, regexp_extract_all(body || chr(10) || chr(10), '(?s)(.*?)\\n\\s*\\n') AS parts_ FROM ex_q",
        "ex_p": "SELECT page, words_, unnest(parts_) AS part_, unnest(range(len(parts_))) AS n FROM ex_w",
        "ex_a": "SELECT page, words_, n, coalesce(sum(length(part_)) OVER (PARTITION BY page ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_, regexp_replace(part_, '\\n\\s*\\n$', '') AS para_ FROM ex_p",
        "ex_h": "SELECT *, list_filter(words_, lambda x: contains(lower(para_), x)) AS held_ FROM ex_a WHERE regexp_matches(para_, '\\S')",
        "ex_s": f"SELECT page, len(held_) AS score_, at_, at_ + CASE WHEN length(para_) <= {passages.SEMANTIC} THEN 0 ELSE least(greatest(0, coalesce(list_min(list_transform(held_, lambda x: instr(lower(para_), x) - 1)), 0) - {passages.LEAD}), length(para_) - {passages.SEMANTIC}) END AS from_, least({passages.SEMANTIC}, length(para_)) AS size_ FROM ex_h",
        "ex_b": "SELECT page, arg_max((from_, from_ + size_, score_), (score_, -at_)) AS b FROM ex_s GROUP BY page",
        "ex_i": "SELECT page, b[1] AS s_, least(length(body), b[2]) AS e_, b[3] AS score_, body[b[1] + 1:least(length(body), b[2])] AS in_ FROM ex_q JOIN ex_b USING (page)",
        "bg_0": """SELECT work_id, CASE result WHEN 'NON_COMPLIANT' THEN 'MANDATORY' ELSE 'OPTIONAL' END AS kind, 1 AS priority, rule_id AS item, 200 + 40 * length(rule_id) AS size_ FROM rule WHERE result IN ('NON_COMPLIANT', 'REVIEW')
          UNION ALL SELECT work_id, CASE severity WHEN 'STRONG_WARNING' THEN 'MANDATORY' ELSE 'OPTIONAL' END, 2, signal_code, 300 * count(*) FROM sigs GROUP BY work_id, severity, signal_code
          UNION ALL SELECT doc_id, 'SEMANTIC', 1, 'DESCRIPTION', least(650, length(text)) FROM documents WHERE text IS NOT NULL""",
        "bg_1": "SELECT *, CASE kind WHEN 'MANDATORY' THEN 1 WHEN 'OPTIONAL' THEN 3 ELSE 4 END AS o, row_number() OVER (PARTITION BY work_id, kind ORDER BY priority, item) AS n, count(*) FILTER (kind = 'MANDATORY') OVER (PARTITION BY work_id) AS must FROM bg_0",
        "bg_2": "SELECT *, kind = 'MANDATORY' OR (kind = 'OPTIONAL' AND n <= 4 - must) OR (kind = 'SEMANTIC' AND n <= 2) AS listed FROM bg_1",
        "bg_3": "SELECT *, listed AND (kind = 'MANDATORY' OR 300 + sum(CASE WHEN listed THEN size_ ELSE 0 END) OVER (PARTITION BY work_id ORDER BY o, n) <= 3000) AS kept, CASE WHEN must > 4 THEN 'MANDATORY_EVIDENCE_EXCEEDS_ITEM_CAP' WHEN 300 + sum(CASE WHEN kind = 'MANDATORY' THEN size_ ELSE 0 END) OVER (PARTITION BY work_id) > 3000 THEN 'MANDATORY_DIRECT_CONTEXT_EXCEEDS_REQUEST_BUDGET' END AS why FROM bg_2",
    }
)
SQL = {
    "page_chunks": "SELECT doc, page, piece, start_ AS start, start_ + length(body_) AS \"end\", chapter, array_to_string(found_, ',') AS clauses, printed_ AS printed_page, sha256(body_) AS text_sha256 FROM ck_3 JOIN pg_c USING (doc, page)",
    "clause_extract": "SELECT doc, chapter, count(*) AS chunks, sum(len(found_))::BIGINT AS clauses, sum(length(body_))::BIGINT AS chars FROM cl_3 GROUP BY doc, chapter",
    "excerpt_spans": "SELECT page, s_ + length(regexp_extract(in_, '^\\s*')) AS start, e_ - length(regexp_extract(in_, '\\s*$')) AS \"end\", score_ AS words FROM ex_i",
    "evidence_budget": "SELECT work_id, count(*) FILTER (kept AND kind = 'MANDATORY') AS mandatory, 0 AS direct, count(*) FILTER (kept AND kind = 'OPTIONAL') AS optional, count(*) FILTER (kept AND kind = 'SEMANTIC') AS semantic, count(*) FILTER (NOT kept) AS dropped, coalesce(sum(size_) FILTER (kept), 0)::BIGINT AS bytes, max(why) AS reason FROM bg_3 GROUP BY work_id",
}
