"""What was known of a work at given instants: payments, site reports and assets, each history read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worksight.functions.scalar import clipped_excess, fractional_instant, safe_ratio

LANDMARKS = (0.25, 0.5, 0.75)


def with_previous(reports: DataFrame) -> DataFrame:
    """Reports with the one before each, by date and id: previous_on, previous_physical."""
    w = W.partitionBy("work_id").orderBy("report_date", "progress_id")
    return reports.withColumns({"previous_on": F.lag("report_date").over(w), "previous_physical": F.lag("physical").over(w)})


def history_at(spine: DataFrame, instants: list[str], payments: DataFrame, reports: DataFrame, assets: DataFrame) -> DataFrame:
    """work_id, at (index of the instant) and what each history shows up to it, for every work and instant of the spine.

    spine has one row per work and a timestamp column for each instant. A history meets its
    work once and is aggregated conditionally for all instants, so it is never multiplied by
    them. The last report but one is the one that the last report carries with it.
    """
    slim = spine.select("work_id", *instants)

    def states(history: DataFrame, when: str, aggregates) -> DataFrame:
        joined = slim.join(history, "work_id", "left")
        seen = {i: F.col(when).cast("timestamp") <= F.col(i) for i in instants}
        aggs = [F.struct(F.lit(k).alias("at"), *[v.alias(n) for n, v in aggregates(seen[i]).items()]).alias(f"s{k}") for k, i in enumerate(instants)]
        return joined.groupBy("work_id").agg(*aggs).select("work_id", F.array(*[f"s{k}" for k in range(len(instants))]).alias("s"))

    def of_payments(seen: Column) -> dict[str, Column]:
        amount = F.when(seen, F.col("amount"))
        last = F.max(F.when(seen, F.col("released_on")))
        early = F.coalesce(F.bool_or(seen & (F.col("authorized_on") < F.col("requested_on"))), F.lit(False))
        return {"payment_count": F.count_if(seen), "released_total": F.coalesce(F.sum(amount), F.lit(0)).cast("bigint"), "largest_payment": F.coalesce(F.max(amount), F.lit(0)).cast("bigint"), "last_payment_on": last, "early_authorization": early}

    def of_reports(seen: Column) -> dict[str, Column]:
        place = F.when(seen, F.struct("report_date", "progress_id"))
        change = F.col("physical") - F.col("previous_physical")
        own = F.struct("physical", "financial", "report_date", "previous_on", "previous_physical")
        return {
            "report_count": F.count_if(seen & F.col("progress_id").isNotNull()),
            "last": F.max_by(own, place),
            "first": F.min_by(F.struct("physical", "report_date"), place),
            "decrease_count": F.count_if(seen & (change < 0)),
            "largest_decrease": F.coalesce(F.max(F.when(seen & (change < 0), -change)), F.lit(0.0)),
        }

    def of_assets(seen: Column) -> dict[str, Column]:
        return {"asset_count": F.count_if(seen)}

    paid = states(payments.select("work_id", "released_on", "requested_on", "authorized_on", "amount"), "released_on", of_payments)
    told = states(with_previous(reports.select("work_id", "progress_id", "report_date", "physical", "financial")), "report_date", of_reports)
    built = states(assets.select("work_id", "completed_on"), "completed_on", of_assets)
    both = paid.select("work_id", F.col("s").alias("p")).join(told.select("work_id", F.col("s").alias("r")), "work_id").join(built.select("work_id", F.col("s").alias("a")), "work_id")
    rows = both.select("work_id", F.explode(F.arrays_zip("p", "r", "a")).alias("x"))
    return rows.select("work_id", "x.p.at", "x.p.payment_count", "x.p.released_total", "x.p.largest_payment", "x.p.last_payment_on", "x.p.early_authorization", "x.r.report_count", "x.r.last", "x.r.first", "x.r.decrease_count", "x.r.largest_decrease", "x.a.asset_count")


def predictors(rows: DataFrame) -> DataFrame:
    """Point-in-time predictors of rows with a work's columns, landmark and `history_at`'s columns."""
    day = F.col("landmark").cast("date")
    span = F.datediff(F.col("last.report_date"), F.col("first.report_date"))
    return rows.withColumns({
        "mean_payment": safe_ratio("released_total", "payment_count"),
        "largest_share": safe_ratio("largest_payment", "released_total"),
        "days_since_payment": F.datediff(day, "last_payment_on"),
        "expenditure_pct": safe_ratio(F.col("released_total") * 100.0, "sanctioned"),
        "overrun": F.when(F.col("sanctioned") > 0, clipped_excess("released_total", "sanctioned")),
        "last_physical": F.col("last.physical"),
        "last_financial": F.col("last.financial"),
        "reported_gap": F.col("last.financial") - F.col("last.physical"),
        "velocity": F.when(span > 0, (F.col("last.physical") - F.col("first.physical")) / span * 30),
        "sanction_days": F.datediff("sanctioned_on", "recommended_on"),
        "planned_days": F.datediff("expected_on", "sanctioned_on"),
        "days_left": F.datediff("expected_on", day),
        "elapsed_ratio": safe_ratio(F.greatest(F.lit(0), F.datediff(day, "sanctioned_on")), F.datediff("expected_on", "sanctioned_on")),
    })


PREDICTORS = (
    "sanctioned sanction_days planned_days payment_count released_total largest_payment mean_payment largest_share days_since_payment expenditure_pct overrun report_count last_physical last_financial reported_gap decrease_count largest_decrease velocity days_left elapsed_ratio"
).split()


def landmark_state(works: DataFrame, payments: DataFrame, reports: DataFrame, assets: DataFrame, outcomes: DataFrame | None = None, fractions: tuple[float, ...] = LANDMARKS) -> DataFrame:
    """work_id, fraction, landmark and PREDICTORS of each work at shares of its planned time, asset_count besides.

    Plans run from sanction to expected end; others have no landmark. With outcomes
    (work_id, finished_on, ..) only works that have one, at landmarks before their end, come
    out, their outcome columns with them, so no row knows its outcome.
    """
    spine = works.where("sanctioned_on < expected_on")
    instants = {f"at_{i}": fractional_instant("sanctioned_on", "expected_on", F.lit(f)) for i, f in enumerate(fractions)}
    spine = spine.select("work_id", "sanctioned", "recommended_on", "sanctioned_on", "expected_on").withColumns(instants)
    if outcomes is not None:
        spine = spine.join(outcomes, "work_id")
    state = history_at(spine, list(instants), payments.where("is_released"), reports, assets)
    share = F.element_at(F.array(*[F.lit(f) for f in fractions]), F.col("at") + 1)
    landmark = F.element_at(F.array(*instants), F.col("at") + 1)
    rows = spine.join(state, "work_id").withColumns({"fraction": share, "landmark": landmark})
    rows = rows if outcomes is None else rows.where("finished_on > landmark")
    extra = [] if outcomes is None else [c for c in outcomes.columns if c != "work_id"]
    return predictors(rows).select("work_id", "fraction", "landmark", *PREDICTORS, "asset_count", *extra)


def cost_snapshots(works: DataFrame, payments: DataFrame, reports: DataFrame, assets: DataFrame, as_of: str) -> DataFrame:
    """The second profile's snapshots, a row per work that has one.

    works has lifecycle, completed_on and final_spend besides its own columns. A completed work is seen
    min(start + 0.6 * max(60, planned days), completion - 30 days), if that is after its
    start, with the target final spend above sanction; a work in execution on the day itself.
    Velocity is the change between the last two reports, over a day at least, in 30 days.
    """
    planned = F.datediff("expected_on", "sanctioned_on")
    past = F.least(F.date_add("sanctioned_on", F.floor(F.greatest(F.lit(60), planned) * 3 / 5).cast("int")), F.date_sub("completed_on", 30))
    day = F.when(F.col("lifecycle") == "COMPLETION", F.when(F.col("expected_on").isNotNull() & (past > F.col("sanctioned_on")), past)).when(F.col("lifecycle") == "EXECUTION", F.lit(as_of).cast("date"))
    spine = works.where("sanctioned_on is not null").withColumn("snapshot_on", day).where("snapshot_on is not null")
    spine = spine.select("work_id", "lifecycle", "sector", "sanctioned", "sanctioned_on", "expected_on", "final_spend", "snapshot_on")
    spine = spine.withColumn("at_0", F.to_timestamp(F.date_add("snapshot_on", 0)))
    rows = spine.join(history_at(spine, ["at_0"], payments, reports, assets), "work_id")
    before = F.greatest(F.lit(1), F.datediff("last.report_date", "last.previous_on"))
    return rows.select(
        "work_id",
        (F.col("lifecycle") == "COMPLETION").alias("for_training"),
        "snapshot_on",
        "sanctioned",
        planned.alias("planned_days"),
        safe_ratio(F.datediff("snapshot_on", "sanctioned_on"), planned).alias("elapsed_ratio"),
        safe_ratio("released_total", "sanctioned").alias("released_ratio"),
        F.col("last.physical").alias("physical"),
        F.col("last.financial").alias("financial"),
        (F.col("last.financial") - F.col("last.physical")).alias("gap"),
        ((F.col("last.physical") - F.col("last.previous_physical")) / before * 30).alias("velocity"),
        "payment_count",
        "early_authorization",
        "sector",
        F.when(F.col("lifecycle") == "COMPLETION", (F.col("final_spend") > F.col("sanctioned")).cast("int")).alias("overran"),
    )
