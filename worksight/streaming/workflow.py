"""The workflow of recommendations as a machine of few states: folded over ranges in batch, kept per key in a stream.

Every state is a pair of a status and whether the pre-check was run. A part of a log maps each
state to the one that it leads to, and such maps can be joined; so a key's log is cut
into ranges, each range is folded for all states at once, and the few maps of a key are
joined in order. No log is ever one array or one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksight.sources.durable import durable

# The statuses, who may do what, and from where to where each action leads.
STATUSES = ("DRAFT", "RECOMMENDED", "NEEDS_CLARIFICATION", "UNDER_REVIEW", "ACCEPTED_FOR_PROCESSING", "SANCTIONED", "IN_PROGRESS", "COMPLETED")
ROLES = {
    "SUBMIT": "MP",
    "PROVIDE_CLARIFICATION": "MP",
    "REQUEST_CLARIFICATION": "DISTRICT",
    "ACCEPT_FOR_PROCESSING": "DISTRICT",
    "ADD_SANCTION": "DISTRICT",
    "UPDATE_PROGRESS": "DISTRICT",
    "ADD_PAYMENT": "DISTRICT",
    "MARK_COMPLETED": "DISTRICT",
}
MOVES = {
    "SUBMIT": {"DRAFT": "RECOMMENDED"},
    "REQUEST_CLARIFICATION": {"RECOMMENDED": "NEEDS_CLARIFICATION", "UNDER_REVIEW": "NEEDS_CLARIFICATION"},
    "PROVIDE_CLARIFICATION": {"NEEDS_CLARIFICATION": "UNDER_REVIEW"},
    "ACCEPT_FOR_PROCESSING": {"RECOMMENDED": "ACCEPTED_FOR_PROCESSING", "UNDER_REVIEW": "ACCEPTED_FOR_PROCESSING"},
    "ADD_SANCTION": {"ACCEPTED_FOR_PROCESSING": "SANCTIONED"},
    "UPDATE_PROGRESS": {"SANCTIONED": "IN_PROGRESS", "IN_PROGRESS": "IN_PROGRESS"},
    "ADD_PAYMENT": {"SANCTIONED": "IN_PROGRESS", "IN_PROGRESS": "IN_PROGRESS"},
    "MARK_COMPLETED": {"IN_PROGRESS": "COMPLETED"},
}
PRECHECK = "PRECHECK"
#: A state's number is twice its status's, and one more once the pre-check was run.
STATES = 2 * len(STATUSES)


def step(action: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Where an action leads from each state, and where it is refused; unknown ones are refused everywhere."""
    to, refused = np.arange(STATES), np.zeros(STATES, np.int64)
    for state in range(STATES):
        status, checked = STATUSES[state // 2], state % 2
        if action == PRECHECK:
            to[state] = state | 1
        elif status in MOVES.get(action, {}) and (action != "SUBMIT" or checked):
            to[state] = 2 * STATUSES.index(MOVES[action][status]) + checked
        else:
            refused[state] = 1
    return to, refused


STEPS = {action: step(action) for action in (*MOVES, PRECHECK, None)}


def allowed(action: str | None, role: str | None) -> bool:
    return ROLES.get(action, role) == role


def folded(log: DataFrame, key: str, order: list[str], action: str = "action", role: str = "role") -> DataFrame:
    """key, actions, status, prechecked, refused_roles, refused_steps of each key's log.

    Actions by the wrong role are refused before their step is looked at. A null key is a
    key of its own; order must tell a key's rows apart. Empty in, empty out.
    """
    rows = log.select(F.col(key).cast("long").alias("key"), F.col(action).cast("string").alias("action"), F.col(role).cast("string").alias("role"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    by = ["key", *[f"o{i}" for i in range(len(order))]]
    dealt = durable(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    names = ["part", "key", "actions", "refused_roles", "to", "refused"]
    schema = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("actions", pa.int64()), ("refused_roles", pa.int64()), ("to", pa.list_(pa.int32())), ("refused", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, roles, state, refused = None, 0, 0, np.arange(STATES), np.zeros(STATES, np.int64)
        done: list[tuple] = []
        row = lambda: (*at, n, roles, state.astype(np.int32), refused)

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], schema.field(c).type) for i, c in enumerate(names)], schema=schema)

        for batch in batches:
            part, keys, actions, actors = (batch.column(i).to_pylist() for i in range(4))
            for p, k, a, r in zip(part, keys, actions, actors, strict=True):
                if at != (p, k):
                    if at is not None:
                        done.append(row())
                    at, n, roles, state, refused = (p, k), 0, 0, np.arange(STATES), np.zeros(STATES, np.int64)
                n += 1
                if not allowed(a, r):
                    roles += 1
                    continue
                to, no = STEPS.get(a, STEPS[None])
                refused = refused + no[state]
                state = to[state]
            yield batch_of()
            done = []
        if at is not None:
            done.append(row())
        yield batch_of()

    maps = dealt.sortWithinPartitions(*by).select("part", "key", "action", "role").mapInArrow(run, "part int, key long, actions long, refused_roles long, to array<int>, refused array<long>")
    # A row for each range and key that meet.
    listed = maps.groupBy("key").agg(F.sum("actions").alias("actions"), F.sum("refused_roles").alias("refused_roles"), F.array_sort(F.collect_list(F.struct("part", "to", "refused"))).alias("maps"))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("refused"))
    joined = F.aggregate("maps", start, lambda acc, m: F.struct(F.get(m["to"], acc["state"]).alias("state"), (acc["refused"] + F.get(m["refused"], acc["state"])).alias("refused")))
    out = listed.select("key", "actions", "refused_roles", joined.alias("f"))
    return out.select(F.col("key").alias(key), "actions", status_of(F.col("f.state")).alias("status"), (F.col("f.state") % 2 == 1).alias("prechecked"), "refused_roles", F.col("f.refused").alias("refused_steps"))


def status_of(state: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.floor(state / 2).cast("int") + 1)


def followed(log: DataFrame, key: str, order: list[str], action: str = "action", role: str = "role") -> DataFrame:
    """The stream's form of `folded`: per key the state after each trigger, from a few numbers kept per key.

    Rows of one trigger are taken in order; rows of later ones come after them. Update mode.
    """
    names = [*order, action, role]

    def update(found: tuple, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        state, n, roles, steps = kept.get if kept.exists else (0, 0, 0, 0)
        rows = pd.concat([b[names] for b in batches]).sort_values(order)
        for a, r in zip(rows[action], rows[role], strict=True):
            n += 1
            if not allowed(a, r):
                roles += 1
                continue
            to, no = STEPS.get(a, STEPS[None])
            steps += int(no[state])
            state = int(to[state])
        kept.update((state, n, roles, steps))
        yield pd.DataFrame({key: [found[0]], "actions": [n], "status": [STATUSES[state // 2]], "prechecked": [state % 2 == 1], "refused_roles": [roles], "refused_steps": [steps]})

    return log.groupBy(key).applyInPandasWithState(update, f"{key} long, actions long, status string, prechecked boolean, refused_roles long, refused_steps long", "state int, n long, roles long, steps long", "update", "NoTimeout")


def verified(submissions: DataFrame, verifications: DataFrame, within: str = "7 days", late: str = "1 day") -> DataFrame:
    """Every submission (evidence_id, submitted_at, ..) with each verification (evidence_id, verified_at, result) up to `within` after it.

    As streams both are watermarked, and a submission without a verification comes out with
    nulls once none can come any more; a verification that is late within the watermark
    still counts. As batches the same rows come out at once.
    """
    a = submissions.withWatermark("submitted_at", late) if submissions.isStreaming else submissions
    b = verifications.withWatermark("verified_at", late) if verifications.isStreaming else verifications
    b = b.select(F.col("evidence_id").alias("of__"), "verified_at", "result")
    near = (F.col("evidence_id") == F.col("of__")) & (F.col("verified_at") >= F.col("submitted_at")) & (F.col("verified_at") <= F.col("submitted_at") + F.expr(f"interval {within}"))
    return a.join(b, near, "leftOuter").drop("of__")


def latest_verification(rows: DataFrame) -> DataFrame:
    """Per evidence_id of `verified` rows the last verification: verified_at, result, and how many there were."""
    last = F.max_by(F.struct("verified_at", "result"), F.struct("verified_at", "result"))
    got = rows.groupBy("evidence_id", "submitted_at").agg(last.alias("l"), F.count("verified_at").alias("verifications"))
    return got.select("evidence_id", "submitted_at", "l.verified_at", "l.result", "verifications")
