"""Evidence as it is told: bundles, grounding of answers, audits of pairs and scores, and both kinds of works in one list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksight.functions.scalar import safe_ratio
from worksight.functions.stats import quantiles
from worksight.sources.durable import durable

#: What a rule's id looks like in a text.
RULE_ID = r"\bRULE-[A-Z0-9._-]*[A-Z0-9]\b"
# Verdicts that no explanation may speak.
VERDICTS = (
    r"\bfraud (?:detected|confirmed)\b",
    r"\bthis work is fraudulent\b",
    r"\bcorrupt official\b",
    r"\bguilty\b",
    r"\bcriminal project\b",
    r"\bproven misuse\b",
)


def with_strongest_peer(scores: DataFrame, evidence: DataFrame) -> DataFrame:
    """scores (work_id, ..), each with its work's strongest peer deviation, the first metric on ties; nulls where it has none.

    Both stay apart: the deviation accompanies the score and explains none of it.
    """
    size = F.abs("deviation")
    best = F.max_by(F.struct("metric", "value", "median", "deviation", "level", "peers", "method"), F.struct(size, (-F.col("metric_order")).alias("o")))
    found = evidence.where("deviation is not null").groupBy("work_id").agg(best.alias("b"), F.count_if(size >= 3.5).alias("outliers"))
    return scores.join(found, "work_id", "left").select(*scores.columns, "b.*", F.coalesce("outliers", F.lit(0)).alias("outliers"))


def listed(rows: DataFrame, name: str, order: list[Column], *fields: str, top: int | None = None) -> DataFrame:
    """work_id and an array of the fields of its rows in an order, the first `top` of them if asked."""
    packed = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}__") for i, o in enumerate(order)], *fields)))
    packed = F.slice(packed, 1, top) if top else packed
    return rows.groupBy("work_id").agg(F.transform(packed, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))


def bundle(works: DataFrame, *sections: DataFrame) -> DataFrame:
    """work_id, bundle: the sections (work_id, one column) of each work as JSON; null and empty ones are left out."""
    out = works.select("work_id", "lifecycle")
    names = []
    for section in sections:
        name = next(c for c in section.columns if c != "work_id")
        names.append(name)
        out = out.join(section, "work_id", "left")
    filled = [F.when(F.size(n) > 0, F.col(n)).alias(n) for n in names]
    return out.select("work_id", F.to_json(F.struct("work_id", "lifecycle", *filled)).alias("bundle"))


def grounding_issues(answers: DataFrame, known: DataFrame, chunks: DataFrame, rule_id: str = RULE_ID) -> DataFrame:
    """id, issue of answers that say what they weren't given; answers without an issue have no row.

    answers has id, work_id, codes, cited (array of chunk_id, page, clause) and text; known id,
    known_work, known_codes, known_rules; chunks chunk_id, first_page, last_page, clauses and
    text. Issues: WORK_ID_MISMATCH, UNKNOWN_EVIDENCE_CODES, UNKNOWN_CHUNK_ID, UNSUPPORTED_PAGE,
    UNSUPPORTED_CLAUSE, INVENTED_COMPLIANCE_RULE, PROHIBITED_VERDICT_LANGUAGE. A null page or
    clause claims nothing; an answer without a known bundle has the first issue.
    """
    empty = F.array().cast("array<string>")
    both = answers.join(known, "id", "left")
    unknown = F.array_except(F.coalesce("codes", empty), F.coalesce("known_codes", empty))
    invented = F.array_except(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rule_id), F.lit(0)), F.coalesce("known_rules", empty))
    verdict = F.coalesce("text", F.lit("")).rlike("(?i)" + "|".join(VERDICTS))
    tests = {
        "WORK_ID_MISMATCH": ~F.coalesce(F.col("work_id") == F.col("known_work"), F.lit(False)),
        "UNKNOWN_EVIDENCE_CODES": F.size(unknown) > 0,
        "INVENTED_COMPLIANCE_RULE": F.size(invented) > 0,
        "PROHIBITED_VERDICT_LANGUAGE": verdict,
    }
    own = both.select("id", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))).alias("issue"))
    cited = answers.select("id", F.explode("cited").alias("c")).select("id", "c.*")
    held = chunks.select(F.col("chunk_id").alias("key__"), "first_page", "last_page", "clauses", F.col("text").alias("chunk_text"))
    cited = cited.join(held, F.col("chunk_id") == F.col("key__"), "left")
    clause = F.trim("clause")
    stands = F.array_contains("clauses", clause) | F.exists(F.split("chunk_text", "\n"), lambda x: F.regexp_replace(F.ltrim(x), r"^\*", "").startswith(F.concat(clause, F.lit(" "))))
    faults = F.array_compact(F.array(
        F.when(F.col("key__").isNull(), "UNKNOWN_CHUNK_ID"),
        F.when(F.col("key__").isNotNull() & ~F.col("page").between(F.col("first_page"), F.col("last_page")), "UNSUPPORTED_PAGE"),
        F.when(F.col("key__").isNotNull() & (clause != "") & ~F.coalesce(stands, F.lit(False)), "UNSUPPORTED_CLAUSE"),
    ))
    return own.unionByName(cited.select("id", F.explode(faults).alias("issue"))).distinct()


def score_distribution(pairs: DataFrame) -> DataFrame:
    """One row: pairs, least and greatest score, and its percentiles up to the 99th. Equal scores are counted first; only the counts are written."""
    names = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p97_5": 0.975, "p99": 0.99}
    counted = durable(pairs.groupBy("score").agg(F.count("*").alias("same")))  # a filter of its own would make scores twice
    basic = counted.agg(F.coalesce(F.sum(F.when(F.col("score").isNotNull(), F.col("same"))), F.lit(0)).alias("pairs"), F.min("score").alias("minimum"), F.max("score").alias("maximum"))
    return basic.crossJoin(quantiles(counted, [], "score", names, "same").drop("n"))  # one row each


def structured_audit(pairs: DataFrame, limits: tuple[float, ...] = (85.0, 90.0, 92.5, 95.0)) -> DataFrame:
    """Per least score: pairs, medians and tails of their evidence, and how many percent agree in each field.

    What isn't asked for isn't written.
    """
    fields = ("district", "block", "village", "sector", "sub_sector", "agency")
    kept = pairs.select("score", "text", "km", "amount", "days", *[f"same_{f}" for f in fields])
    rows = durable(kept).select("*", F.explode(F.array(*[F.lit(x) for x in limits])).alias("least")).where(F.col("score") >= F.col("least"))
    out = rows.groupBy("least").agg(F.count("*").alias("pairs"), *[(100 * F.avg(F.col(f"same_{f}").cast("int"))).alias(f"same_{f}_pct") for f in fields])
    wanted = {"text": {"text_median": 0.5, "text_p90": 0.9}, "km": {"km_median": 0.5, "km_p90": 0.9}, "amount": {"amount_p10": 0.1, "amount_median": 0.5}, "days": {"days_median": 0.5, "days_p90": 0.9}}
    for value, names in wanted.items():
        out = out.join(quantiles(rows, ["least"], value, names).drop("n"), "least", "left")
    return out


def confusion(rows: DataFrame, score: str, label: str, threshold: float, keys: list[str]) -> DataFrame:
    """Per keys the counts of a 0/1 label against score >= threshold, precision, recall and F1."""
    told, true = F.col(score) >= threshold, F.col(label) == 1
    got = rows.groupBy(*keys).agg(F.count_if(told & true).alias("true_positive"), F.count_if(told & ~true).alias("false_positive"), F.count_if(~told & true).alias("false_negative"), F.count_if(~told & ~true).alias("true_negative"))
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    return got.withColumns({"precision": safe_ratio(tp, tp + fp), "recall": safe_ratio(tp, tp + fn), "f1": F.coalesce(safe_ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))})


def known_pairs(groups: DataFrame, pairs: DataFrame, group: str = "group_id") -> DataFrame:
    """One row: the pairs that records (work_id, group) known to be one make with the smallest of their group, and how many of these pairs (a, b) has."""
    first = groups.where(F.col(group).isNotNull()).groupBy(group).agg(F.min("work_id").alias("a"))
    known = groups.join(first, group).where("work_id <> a").select("a", F.col("work_id").alias("b"))
    both = known.intersect(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return known.agg(F.count("*").alias("known")).crossJoin(both.agg(F.count("*").alias("retrieved")))  # one row each


def my_works(works: DataFrame, recommendations: DataFrame, mp_id: int) -> DataFrame:
    """Works and running recommendations of a proponent in one list: record_type, id, cost, status, category, needs_attention.

    works has work_id, mp_id, lifecycle, sanctioned, status, needs_attention; recommendations
    recommendation_id, mp_id, cost, status, needs_attention.
    """
    stage = F.when(F.col("lifecycle") == "COMPLETION", "COMPLETED").when(F.col("lifecycle") == "EXECUTION", "ONGOING").otherwise("RECOMMENDED")
    step = F.when(F.col("status").isin("COMPLETED", "CLOSED"), "COMPLETED").when(F.col("status").isin("SANCTIONED", "IN_PROGRESS"), "ONGOING").otherwise("RECOMMENDED")
    own = works.where(F.col("mp_id") == mp_id).select(F.lit("ANALYTICAL_WORK").alias("record_type"), F.col("work_id").cast("string").alias("id"), F.col("sanctioned").alias("cost"), "status", stage.alias("category"), "needs_attention")
    asked = recommendations.where(F.col("mp_id") == mp_id).select(F.lit("RUNTIME_RECOMMENDATION").alias("record_type"), F.col("recommendation_id").cast("string").alias("id"), "cost", "status", step.alias("category"), (F.col("needs_attention") | (F.col("status") == "NEEDS_CLARIFICATION")).alias("needs_attention"))
    return own.unionByName(asked)
