"""Queries of workflows and verifications and their DuckDB SQL; the catalog registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksight.plans import sql
from worksight.plans.catalog import query
from worksight.sources.domain import table
from worksight.streaming import workflow

# Actions by type of event; where a type has several, event_id picks one. Every seventeenth event is by the other role.
ACTIONS = {
    "view": ("PRECHECK", "UPDATE_PROGRESS", "REQUEST_CLARIFICATION"),
    "click": ("SUBMIT", "ADD_PAYMENT"),
    "signup": ("ACCEPT_FOR_PROCESSING",),
    "purchase": ("ADD_SANCTION", "MARK_COMPLETED"),
    "error": ("PROVIDE_CLARIFICATION", "REOPEN"),
}


@query
def workflow_states(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[x for kind, steps in ACTIONS.items() for x in (F.lit(kind), F.array(*[F.lit(s) for s in steps]))])
    steps = F.element_at(names, F.col("event_type"))
    action = F.get(steps, F.pmod(F.floor(F.col("event_id") / 7), F.size(steps)).cast("int"))
    own = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in workflow.ROLES.items() for x in pair]), F.col("action")), F.lit("MP"))
    role = F.when(F.col("event_id") % 17 == 0, F.when(own == "MP", "DISTRICT").otherwise("MP")).otherwise(own)
    log = table(spark, d, "events").select("user_id", "ts", "event_id", action.alias("action")).withColumn("role", role)
    return workflow.folded(log, "user_id", ["ts", "event_id"])


def verification_rows(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Views and clicks as submissions, other events as verifications of one of the three events before them."""
    seen = events.where("event_type in ('view', 'click')").select(F.col("event_id").alias("evidence_id"), F.col("ts").alias("submitted_at"))
    checked = events.where("event_type not in ('view', 'click')").select((F.col("event_id") - 1 - F.col("event_id") % 3).alias("evidence_id"), F.col("ts").alias("verified_at"), F.col("event_type").alias("result"))
    return seen, checked


@query
def geo_verifications(spark: SparkSession, d: str) -> DataFrame:
    rows = workflow.latest_verification(workflow.verified(*verification_rows(table(spark, d, "events"))))
    return rows.select("evidence_id", F.unix_seconds(F.col("verified_at").cast("timestamp")).alias("verified_s"), "result", "verifications")


_action = "CASE event_type " + " ".join(f"WHEN '{kind}' THEN [{', '.join(repr(s) for s in steps)}][(event_id // 7) % {len(steps)} + 1]" for kind, steps in ACTIONS.items()) + " END"
_own = "CASE WHEN a IN ({}) THEN 'DISTRICT' ELSE 'MP' END".format(", ".join(repr(a) for a, r in workflow.ROLES.items() if r == "DISTRICT"))
_need = "CASE " + " ".join(f"WHEN a = '{a}' THEN '{r}'" for a, r in workflow.ROLES.items()) + " ELSE r END"
_to = "CASE " + " ".join(f"WHEN a = '{a}' AND status = '{s}'{' AND checked' if a == 'SUBMIT' else ''} THEN '{t}'" for a, moves in workflow.MOVES.items() for s, t in moves.items()) + " END"
sql.extend(
    {
        "wf_0": f"SELECT user_id, {_action} AS a, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events",
        "wf_1": f"SELECT user_id, n, a, CASE WHEN event_id % 17 = 0 THEN CASE {_own} WHEN 'MP' THEN 'DISTRICT' ELSE 'MP' END ELSE {_own} END AS r FROM wf_0",
        "wf_2": f"SELECT user_id, n, a, r = {_need} AS may FROM wf_1",
        "wf_i": f"""SELECT DISTINCT user_id, 0::BIGINT AS n, 'DRAFT' AS status, false AS checked, 0::BIGINT AS no_role, 0::BIGINT AS no_step FROM wf_2
          UNION ALL SELECT user_id, n, CASE WHEN may THEN coalesce(t, status) ELSE status END, checked OR (may AND a = 'PRECHECK'), no_role + (NOT may)::INT, no_step + (may AND t IS NULL AND a <> 'PRECHECK')::INT
          FROM (SELECT x.user_id, y.n, status, checked, no_role, no_step, a, may, {_to} AS t FROM wf_i x JOIN wf_2 y ON y.user_id = x.user_id AND y.n = x.n + 1)""",
    }
)
SQL = {
    "workflow_states": "SELECT user_id, max(n) AS actions, arg_max(status, n) AS status, arg_max(checked, n) AS prechecked, max(no_role) AS refused_roles, max(no_step) AS refused_steps FROM wf_i GROUP BY user_id",
    "geo_verifications": "SELECT s.event_id AS evidence_id, max(floor(epoch(v.ts))::BIGINT) AS verified_s, arg_max(v.event_type, (v.ts, v.event_type)) AS result, count(v.ts) AS verifications FROM (SELECT event_id, ts FROM events WHERE event_type IN ('view', 'click')) s LEFT JOIN (SELECT event_id - 1 - event_id % 3 AS e, ts, event_type FROM events WHERE event_type NOT IN ('view', 'click')) v ON e = event_id AND v.ts BETWEEN s.ts AND s.ts + INTERVAL 7 DAY GROUP BY s.event_id",
}
