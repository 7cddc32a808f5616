"""Role scopes, queues, dashboards, workflow folds, retrieval and explanations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worksight.functions.scalar import fixed, safe_ratio
from worksight.functions.stats import carried, cumulated, quantiles
from worksight.operators.pairs import Unpack, best

ROLES = {"NATIONAL": (), "STATE": ("state",), "DISTRICT": ("state", "district"), "MP": ("mp_id",), "IA": ("agency",)}
SORTS = {"score": F.desc, "work_id": F.asc, "sanctioned": F.desc}


class ScopeError(ValueError):
    """A role lacks what its scope needs, or doesn't exist."""


def scope(role: str, **values) -> Column:
    """The predicate of the works that a role may see."""
    if role not in ROLES:
        raise ScopeError(f"no role {role}")
    missing = [c for c in ROLES[role] if values.get(c) is None]
    if missing:
        raise ScopeError(f"{role} needs {missing}")
    out = F.lit(True)
    for c in ROLES[role]:
        out = out & (F.col(c) == F.lit(values[c]))
    return out


def queue(rows: DataFrame, where: Column, filters: dict[str, object] | None = None, search: str | None = None, searched: tuple[str, ...] = (), sort: str = "score") -> DataFrame:
    """Rows of a scope under equality filters and a free-text search, in an allowed order."""
    if sort not in SORTS:
        raise ScopeError(f"can't sort by {sort}")
    out = rows.where(where)
    for c, v in (filters or {}).items():
        if v is not None:
            out = out.where(F.col(c) == F.lit(v))
    if search:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", *searched)), F.lit(search.lower())))
    return out.orderBy(SORTS[sort](sort), "work_id") if sort != "work_id" else out.orderBy("work_id")


def page(ordered: DataFrame, number: int, size: int) -> DataFrame:
    return ordered.offset((number - 1) * size).limit(size)


def overview(rows: DataFrame) -> DataFrame:
    """Counts by band and lifecycle and totals, in one pass."""
    bands = [F.count_if(F.col("band") == b).alias(b.lower()) for b in ("LOW", "MEDIUM", "HIGH", "CRITICAL")]
    stages = [F.count_if(F.col("lifecycle") == s).alias(s.lower()) for s in ("PRE_SANCTION", "EXECUTION", "COMPLETION")]
    out = rows.agg(F.count("*").alias("works"), *bands, *stages, F.sum("sanctioned").alias("sanctioned_total"), F.sum("released_total").alias("released_sum"))
    return out.withColumns({"urgent_share": fixed(safe_ratio((F.col("high") + F.col("critical")) * 100.0, "works"), 4), "utilisation": fixed(safe_ratio(F.col("released_sum") * 100.0, "sanctioned_total"), 4)})


def comparison(rows: DataFrame, by: str) -> DataFrame:
    """Works, urgent works and rates of each value of a column, most urgent first."""
    out = rows.groupBy(F.col(by).alias("group_value")).agg(F.count("*").alias("works"), F.count_if(F.col("band").isin("HIGH", "CRITICAL")).alias("urgent"), F.sum("sanctioned").alias("sanctioned_total"), F.sum("released_total").alias("released_sum"))
    return out.select("group_value", "works", "urgent", fixed(safe_ratio(F.col("urgent") * 100.0, "works"), 1).alias("urgent_rate"), fixed(safe_ratio(F.col("released_sum") * 100.0, "sanctioned_total"), 1).alias("utilisation"))


def fund_flow(rows: DataFrame, spent: DataFrame) -> DataFrame:
    """Per sector: sanctioned, released by fiscal year (April on), and the sector's share."""
    year = F.year("released_on") - (F.month("released_on") < 4).cast("int")
    flows = spent.join(rows.select("work_id", "sector"), "work_id").groupBy("sector", year.alias("fiscal_year")).agg(F.sum("amount").alias("released"), F.countDistinct("work_id").alias("works"))
    total = F.sum("released").over(W.partitionBy("fiscal_year"))
    return flows.withColumn("share", fixed(safe_ratio(F.col("released") * 100.0, total), 4))


def precheck_costs(rows: DataFrame, peers: int = 5, factor: float = 1.25) -> DataFrame:
    """Per work: median and upper quartile of peers (sub-sector if enough, else sector), and whether its cost is high."""
    wanted = {"median": 0.5, "q75": 0.75}
    costs = rows.select("sector", "sub_sector", "sanctioned")
    fine = costs.groupBy("sector", "sub_sector").agg(F.count("*").alias("fn")).join(quantiles(costs, ["sector", "sub_sector"], "sanctioned", wanted).drop("n"), ["sector", "sub_sector"], "left")
    fine = fine.select("sector", "sub_sector", "fn", F.array("median", "q75").alias("fq"))
    coarse = quantiles(costs, ["sector"], "sanctioned", wanted).select("sector", F.array("median", "q75").alias("cq"))
    out = rows.join(fine, ["sector", "sub_sector"], "left").join(coarse, "sector", "left")
    q = F.when(F.col("fn") >= peers, F.col("fq")).otherwise(F.col("cq"))
    out = out.select("work_id", "sanctioned", F.when(F.col("fn") >= peers, "SUB_SECTOR").otherwise("SECTOR").alias("level"), F.get(q, F.lit(0)).alias("peer_median"), F.get(q, F.lit(1)).alias("peer_q75"))
    return out.withColumn("high_cost", F.col("sanctioned") > factor * F.col("peer_q75"))


def dossier(profile: DataFrame, payments: DataFrame, alerts: DataFrame, top: int = 10) -> DataFrame:
    """Per work its latest payments and strongest alerts as JSON; both histories pre-ranked."""
    paid = payments.withColumn("n", F.row_number().over(W.partitionBy("work_id").orderBy(F.desc("released_on"), "payment_id"))).where(F.col("n") <= top)
    paid = paid.groupBy("work_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "payment_id", "amount"))), lambda s: F.concat_ws(":", s["payment_id"], s["amount"])).alias("latest_payments"))
    told = alerts.withColumn("n", F.row_number().over(W.partitionBy("work_id").orderBy(F.desc("strength"), "alert_type", "evidence_code"))).where(F.col("n") <= 3)
    told = told.groupBy("work_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "alert_type"))), lambda s: s["alert_type"]).alias("top_alerts"))
    out = profile.select("work_id", "lifecycle").join(paid, "work_id", "left").join(told, "work_id", "left")
    return out.select("work_id", "lifecycle", F.array_join("latest_payments", ",").alias("latest_payments"), F.array_join("top_alerts", ",").alias("top_alerts"))


def latest_status(log: DataFrame, key: str, status: str, at: list[str]) -> DataFrame:
    """The last record's status per key and how many records there are."""
    return log.groupBy(key).agg(F.max_by(status, F.struct(*at)).alias("status"), F.count("*").alias("records"))


# The workflow's guarded transitions (state, event) -> state.
TRANSITIONS = {
    ("DRAFT", "submit"): "RECOMMENDED",
    ("RECOMMENDED", "review"): "UNDER_REVIEW",
    ("UNDER_REVIEW", "clarify"): "NEEDS_CLARIFICATION",
    ("NEEDS_CLARIFICATION", "review"): "UNDER_REVIEW",
    ("UNDER_REVIEW", "accept"): "ACCEPTED_FOR_PROCESSING",
    ("ACCEPTED_FOR_PROCESSING", "sanction"): "SANCTIONED",
    ("SANCTIONED", "progress"): "IN_PROGRESS",
    ("SANCTIONED", "pay"): "IN_PROGRESS",
    ("IN_PROGRESS", "complete"): "COMPLETED",
}


def workflow_fold(events: DataFrame, key: str, event: str, order: list[str]) -> DataFrame:
    """Per key the state that its events lead to in order, and how many were not allowed."""
    moves = F.create_map(*[x for (s, e), t in TRANSITIONS.items() for x in (F.lit(f"{s}/{e}"), F.lit(t))])
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(event).alias("event__")))), lambda s: s["event__"])
    start = F.struct(F.lit("DRAFT").alias("state"), F.lit(0).cast("bigint").alias("refused"))

    def step(acc, e):
        to = F.try_element_at(moves, F.concat_ws("/", acc["state"], e))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["refused"] + to.isNull().cast("bigint")).alias("refused"))

    out = events.groupBy(key).agg(listed.alias("l")).select(key, F.size("l").alias("events"), F.aggregate("l", start, step).alias("f"))
    return out.select(key, "events", F.col("f.state").alias("state"), F.col("f.refused").alias("refused"))


#: Chunks of a group in a search at most and, where there are few, at least; queries are twice the most. Rows that a task compares at a time.
BLOCK, LEAST, TILE = 1 << 15, 1 << 11, 1 << 11
#: More than single precision and rounding can move a score.
SLACK = 1e-4


def cosine_topk(queries: DataFrame, chunks: DataFrame, k: int, unpack: Unpack | None = None) -> DataFrame:
    """query_id, chunk_id, score, place of the k most similar chunks; both have (id, v), unit vectors.

    v is an array, or packed bytes of which `unpack` makes rows. Blocks of queries meet blocks
    of chunks of BLOCK rows at most, so no task grows with either, and a row is
    shuffled once for every block of the other side. Single precision finds what may be among
    the k best, double precision scores it. Scores are rounded to five digits, ties by chunk;
    rows without an id or a vector take no part.
    """
    if unpack is None:
        plain = lambda t: t.where("id is not null and v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
        rows, unpack = [plain(queries), plain(chunks)], lambda column: np.stack(list(column))
    else:
        rows = [t.where("id is not null and v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").alias("v")) for t in (queries, chunks)]  # names of their own, as both may come from one table
    counts = [t.count() for t in rows]
    sizes = (2 * BLOCK, min(BLOCK, max(LEAST, -(-counts[1] // 48))))
    blocks = [max(1, -(-n // size)) for n, size in zip(counts, sizes)]
    own = [t.withColumn(c, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")) for t, c, n in zip(rows, "bo", blocks)]
    every = [t.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) for t, c, n in zip(own, "ob", reversed(blocks))]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [best(a.id.to_numpy(np.int64)[:0], b.id.to_numpy(np.int64)[:0], np.zeros((0, 0)), k)]
        if len(a) and len(b):
            b = b.sort_values("id")
            b = b[b.v.map(bytes if isinstance(b.v.iloc[0], bytes) else lambda v: v.tobytes()).pipe(lambda v: v.groupby(v).cumcount()) <= k]  # of copies the first ones decide
            others, y = b.id.to_numpy(np.int64), unpack(b.v)
            thin = y.astype(np.float32)
            for at in range(0, len(a), TILE):
                part = a.iloc[at : at + TILE]
                out.append(nearest(part.id.to_numpy(np.int64), unpack(part.v), others, y, thin, k))
        return pd.concat(out)

    pairs = every[0].groupBy("b", "o").cogroup(every[1].groupBy("b", "o")).applyInPandas(meet, "id long, other long, cosine double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return pairs.toDF("query_id", "chunk_id", "score").withColumn("place", place).where(F.col("place") <= k)


def nearest(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, thin: np.ndarray, k: int, digits: int = 5) -> pd.DataFrame:
    """id, other, cosine of the k best rows of y for each of x, ties by other; thin is y in single precision.

    Of y only the rows that are scored are asked for, so it may unpack them then.
    """
    own = x.astype(np.float32)
    found = Best(len(ids), k)
    same = np.flatnonzero(np.isin(others, ids))
    for start in range(0, len(others), 2 * TILE):
        near = own @ thin[start : start + 2 * TILE].T
        mine = same[np.searchsorted(same, start) : np.searchsorted(same, start + near.shape[1])]
        r, c = np.nonzero(ids[:, None] == others[None, mine])
        near[r, mine[c] - start] = -np.inf
        if start == 0:
            found.begin(near)
        r, c, v = reached(near, found.least[:, None])
        found.add(r, c + start, v)
    return found.scored(ids, x, others, y, digits)


def mutual(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, thin: np.ndarray, k: int, digits: int = 5) -> pd.DataFrame:
    """The rows of `nearest` for both sides, which have no id in common: of y for each of x, and of x for each of y. Each two rows are multiplied once."""
    starts = range(0, len(others), 2 * TILE)
    theirs = [Best(len(thin[start : start + 2 * TILE]), k) for start in starts]
    out = []
    for at in range(0, len(ids), TILE):
        rows = x[np.arange(at, min(at + TILE, len(ids)))]
        own, mine = rows.astype(np.float32), Best(len(rows), k)
        for start, other in zip(starts, theirs):
            near = own @ thin[start : start + 2 * TILE].T
            if start == 0:
                mine.begin(near)
            if at == 0:
                other.begin(near.T)
            r, c, v = reached(near, np.minimum(mine.least[:, None], other.least[None, :]))
            for side, row, column in ((mine, r, c + start), (other, c, r + at)):
                good = v >= side.least[row] - SLACK
                side.add(row[good], column[good], v[good])
        out.append(mine.scored(ids[at : at + TILE], rows, others, y, digits))
    for start, other in zip(starts, theirs):
        own = others[start : start + 2 * TILE]
        out.append(other.scored(own, y[np.arange(start, start + len(own))], ids, x, digits))
    return pd.concat(out)


class Best:
    """What may be among the k best of each row, from values in single precision that come tile by tile."""

    def __init__(self, rows: int, k: int):
        self.k, self.least = k, np.full(rows, -np.inf, np.float32)  # the k-th best so far
        self.row, self.at, self.rough = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)

    def begin(self, near: np.ndarray) -> None:
        """Takes a bound from the first tile."""
        if (size := near.shape[1]) >= self.k:
            self.least = np.partition(near, size - self.k, axis=1)[:, size - self.k]

    def add(self, row: np.ndarray, at: np.ndarray, rough: np.ndarray) -> None:
        row, at, rough = np.concatenate([self.row, row]), np.concatenate([self.at, at]), np.concatenate([self.rough, rough])
        order = np.lexsort((-rough, row))
        r, v = row[order], rough[order]
        kth = np.flatnonzero(np.arange(len(r)) - np.searchsorted(r, r) == self.k - 1)
        self.least[r[kth]] = np.maximum(self.least[r[kth]], v[kth])
        keep = rough >= self.least[row] - SLACK
        self.row, self.at, self.rough = row[keep], at[keep], rough[keep]

    def scored(self, ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, digits: int) -> pd.DataFrame:
        """id, other, cosine of the k best, in double precision, ties by other."""
        row, at = self.row, self.at
        score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[row[i : i + TILE]], y[at[i : i + TILE]]) for i in range(0, len(row), TILE))])
        score = np.floor(score * 10.0**digits + 0.5) / 10.0**digits
        order = np.lexsort((others[at], -score, row))
        row, at, score = row[order], at[order], score[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        return pd.DataFrame({"id": ids[row[kept]], "other": others[at[kept]], "cosine": score[kept]})


def reached(near: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the finite entries that come up to a least value, but for SLACK."""
    flat = np.flatnonzero((near >= least - np.float32(SLACK)).ravel())
    value = near.ravel()[flat]
    there = np.isfinite(value)
    return (flat[there] // near.shape[1]), (flat[there] % near.shape[1]), value[there]


def two_channel(direct: DataFrame, similar: DataFrame, cap: int = 10, extra: int = 5) -> DataFrame:
    """Direct references first, then similar chunks not among them, `extra` at most, `cap` in all unless more are direct."""
    a = direct.select("query_id", "chunk_id", F.lit(0).alias("channel"), F.lit(0.0).alias("score"))
    b = similar.join(direct.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("n") <= extra).select("query_id", "chunk_id", F.lit(1).alias("channel"), "score")
    both = a.distinct().unionByName(b)
    w = W.partitionBy("query_id")
    both = both.withColumns({"place": F.row_number().over(w.orderBy("channel", F.desc("score"), "chunk_id")), "directs": F.count_if(F.col("channel") == 0).over(w)})
    return both.where(F.col("place") <= F.greatest(F.lit(cap), F.col("directs"))).drop("directs")


def evidence_selection(evidence: DataFrame, cap: int = 8) -> DataFrame:
    """At most `cap` pieces per work: mandatory ones first, then by points."""
    n = F.row_number().over(W.partitionBy("work_id").orderBy(F.desc("mandatory"), F.desc("points"), "family_order"))
    return evidence.withColumn("place", n).where(F.col("place") <= cap)


def within_budget(pieces: DataFrame, budget: int, key: str, order: list[Column], size: Column) -> DataFrame:
    """Pieces of each key, in order, while their sizes together stay within a budget."""
    return cumulated(pieces, [key], order, size, "used").where(F.col("used") <= budget)


PROHIBITED = r"(?i)\b(fraud|corrupt\w*|guilty|criminal|scam|embezzl\w*)\b"


def grounding_faults(answers: DataFrame, known: DataFrame) -> DataFrame:
    """Faults of answers (id, codes array, text) against known (id, codes array): one row each."""
    both = answers.join(known.select("id", F.col("codes").alias("known")), "id", "left")
    unknown = F.array_except(F.coalesce("codes", F.array().cast("array<string>")), F.coalesce("known", F.array().cast("array<string>")))
    faults = F.array_compact(F.array(F.when(F.col("known").isNull(), "WORK_ID_MISMATCH"), F.when(F.size(unknown) > 0, "UNKNOWN_EVIDENCE_CODES"), F.when(F.coalesce(F.col("text"), F.lit("")).rlike(PROHIBITED), "PROHIBITED_VERDICT_LANGUAGE")))
    return both.select("id", F.explode(faults).alias("fault"))


def explanation(scores: DataFrame) -> DataFrame:
    """The deterministic explanation of each work's score."""
    text = F.format_string("Work %d is in %s with review priority %.2f (%s). Leading evidence: %s. A human decides.", "work_id", "lifecycle", "score", "band", F.coalesce(F.concat_ws(", ", "top_family_1", "top_family_2", "top_family_3"), F.lit("none")))
    return scores.select("work_id", text.alias("text"))


def carried_chapters(chunks: DataFrame, pattern: str) -> DataFrame:
    """Chunks (doc, page, text) with the latest chapter heading up to each page."""
    found = F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    return carried(chunks.withColumn("heading", found).drop("text"), ["doc"], [F.col("page")], F.col("heading"), "chapter").drop("heading")
