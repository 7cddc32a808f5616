"""Officer cases: work features of the second profile, dossiers, site history, overviews and filtered trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worksight.functions import scalar
from worksight.functions.scalar import fixed, safe_ratio
from worksight.operators.serving import ScopeError

#: What a sum of points may differ from the score that it explains.
TOLERANCE = 1e-5


def second_features(profile: DataFrame, payments: DataFrame, reports: DataFrame, today: str) -> DataFrame:
    """Features of the second profile, one row per work of `profile`.

    All payments and reports count, whatever their date. A work without a report has the
    share of its sanction that is paid as financial progress; what is observed is flagged.
    """
    paid = payments.groupBy("work_id").agg(F.sum("amount").alias("released"), F.count("*").alias("payments"), F.bool_or(F.col("authorized_on") < F.col("requested_on")).alias("early"), F.max("released_on").alias("latest_release"))
    last = F.max_by(F.struct("report_date", "physical", "financial"), F.struct("report_date", "progress_id"))
    told = reports.groupBy("work_id").agg(last.alias("l"))
    rows = profile.select("work_id", "lifecycle", "state", "district", "sector", "sub_sector", "mp_id", "sanctioned", "final_spend", "expected_on", "sanctioned_on").join(paid, "work_id", "left").join(told, "work_id", "left")
    rows = rows.withColumns({"released": F.coalesce("released", F.lit(0)).cast("bigint"), "payments": F.coalesce("payments", F.lit(0)), "early": F.coalesce("early", F.lit(False))})
    financial = F.coalesce(F.col("l.financial"), safe_ratio(F.col("released") * 100.0, "sanctioned"))
    rows = rows.withColumns({"latest_report": F.col("l.report_date"), "physical": F.col("l.physical"), "financial": financial, "gap": financial - F.col("l.physical")})
    flags = {
        "observed_delay": (F.col("lifecycle") == "EXECUTION") & F.coalesce(F.col("expected_on") < F.lit(today).cast("date"), F.lit(False)),
        "observed_overrun": F.coalesce(F.col("final_spend") > F.col("sanctioned"), F.lit(False)),
        "release_above_sanction": F.coalesce(F.col("released") > F.col("sanctioned"), F.lit(False)),
    }
    return rows.withColumns(flags).drop("l")


def geo_history(captures: DataFrame, works: DataFrame) -> DataFrame:
    """Every capture with the window that its month requires, whether it came in it, and how far from the registered place it is."""
    rows = captures.join(works.select("work_id", F.col("latitude").alias("own_latitude"), F.col("longitude").alias("own_longitude")), "work_id")
    days = scalar.first_working_days("captured_on", 3)
    monthly = F.col("stage") == "MONTHLY_PROGRESS"
    window = F.when(monthly, F.concat_ws(" to ", F.element_at(days, 1).cast("string"), F.element_at(days, 3).cast("string")))
    status = F.when(monthly & (F.col("captured_on") > F.element_at(days, 3)), "SUBMITTED_LATE").otherwise("RECORDED")
    metres = scalar.haversine("own_latitude", "own_longitude", "latitude", "longitude")
    rows = rows.withColumn("metres", metres)
    return rows.select("work_id", "evidence_id", "captured_on", "stage", window.alias("required_window"), status.alias("window_status"), scalar.location_status("metres").alias("location_status"), "metres")


def timeline(works: DataFrame, payments: DataFrame, reports: DataFrame, assets: DataFrame, captures: DataFrame) -> DataFrame:
    """work_id, timeline: the dated steps of each work (on, label, kind), in order, from five histories.

    Of a history only the first and the last date come in, so a work has few steps however
    long its histories are. Steps without a date are left out; those of one day go by label.
    """
    step = lambda on, label, kind="RECORDED": F.struct(F.col(on).cast("date").alias("on"), F.lit(label).alias("label"), F.lit(kind).alias("kind"))

    def ends(history: DataFrame, when: str, label: str) -> DataFrame:
        got = history.groupBy("work_id").agg(F.min(when).alias("first"), F.max(when).alias("last"))
        return got.select("work_id", F.array(step("first", f"First {label}"), step("last", f"Latest {label}")).alias("s"))

    own = works.select("work_id", F.array(step("recommended_on", "Recommendation"), step("sanctioned_on", "Sanction"), step("expected_on", "Expected Completion", "PLANNED")).alias("s"))
    done = assets.groupBy("work_id").agg(F.max("completed_on").alias("done"), F.max("handover_on").alias("handed")).select("work_id", F.array(step("done", "Recorded Completion"), step("handed", "Handover")).alias("s"))
    out = own
    for i, part in enumerate((ends(payments, "released_on", "Payment"), ends(reports, "report_date", "Progress Report"), done, ends(captures, "captured_on", "Site Evidence"))):
        out = out.join(part.withColumnRenamed("s", f"s{i}"), "work_id", "left")
    empty = F.array().cast("array<struct<on: date, label: string, kind: string>>")
    steps = F.concat("s", *[F.coalesce(f"s{i}", empty) for i in range(4)])
    return out.select("work_id", F.array_sort(F.filter(steps, lambda x: x["on"].isNotNull())).alias("timeline"))


def health(rows: DataFrame) -> Column:
    """The eight dimensions that are watched, as an array of (label, status).

    rows has released, sanctioned, gap, observed_delay, early, closure_requires_review, has_pair,
    lifecycle and monthly_status.
    """
    above = F.col("released") - F.col("sanctioned")
    closure = F.coalesce("closure_requires_review", F.lit(False))
    asked = lambda test: F.when(F.coalesce(test, F.lit(False)), "Requires Review").otherwise("Normal")
    dimensions = {
        "Fund Utilization": F.when(safe_ratio(above * 100.0, "sanctioned") > 30, "Very High Attention").otherwise(asked(above > 0)),
        "Physical Progress": asked(F.col("gap") > 25),
        "Schedule": F.when(F.col("observed_delay"), "Observed Delay").otherwise("On Schedule"),
        "Payments": asked(F.col("early")),
        "Compliance": asked(closure),
        "Duplicate Review": F.when(F.coalesce("has_pair", F.lit(False)), "Requires Comparison").otherwise("Normal"),
        "Completion Records": F.when(closure, "Requires Review").when(F.col("lifecycle") != "COMPLETION", "Not yet due").otherwise("Recorded"),
        "Evidence Availability": F.when(F.col("monthly_status") == "OVERDUE", "Requires Review").otherwise("Good"),
    }
    return F.array(*[F.struct(F.lit(k).alias("label"), v.alias("status")) for k, v in dimensions.items()])


def irregularities(rows: DataFrame) -> Column:
    """What of a work asks for a look, or that nothing does, as an array of (title, status)."""
    found = [
        (F.col("gap") > 25, "Financial progress is significantly ahead of physical progress", "Requires Review"),
        (F.col("early"), "Payment chronology is unusual", "Requires Review"),
        (F.col("observed_delay"), "The expected completion date has passed", "Observed Delay"),
        (F.col("observed_overrun"), "Final expenditure is above the sanctioned amount", "Observed Condition"),
    ]
    told = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(title).alias("title"), F.lit(status).alias("status"))) for t, title, status in found]))
    none = F.array(F.struct(F.lit("No direct operational irregularity is currently flagged").alias("title"), F.lit("Normal").alias("status")))
    return F.when(F.size(told) > 0, told).otherwise(none)


def dossier(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """work_id, lifecycle and the sections of a case as JSON: timeline, health, irregularities, completion readiness."""
    closure = F.coalesce("closure_requires_review", F.lit(False))
    readiness = F.when(closure, "REQUIRES_REVIEW").when(F.col("lifecycle") != "COMPLETION", "NOT_YET_DUE").otherwise("RECORDED")
    out = rows.join(steps, "work_id", "left")
    return out.select("work_id", "lifecycle", F.to_json("timeline").alias("timeline"), F.to_json(health(rows)).alias("health"), F.to_json(irregularities(rows)).alias("irregularities"), readiness.alias("completion_readiness"))


def checked_points(scores: DataFrame, contributions: DataFrame) -> DataFrame:
    """work_id, score, contribution_sum, families of every score; a sum of points that isn't the score is an error.

    The error is raised in the job itself, so no dossier is served on a score that its
    contributions don't reproduce.
    """
    sums = contributions.groupBy("work_id").agg(F.sum("points").alias("contribution_sum"), F.count("*").alias("families"))
    rows = scores.select("work_id", "score").join(sums, "work_id", "left").withColumn("contribution_sum", F.coalesce("contribution_sum", F.lit(0.0)))
    wrong = F.raise_error(F.format_string("Contribution sum does not reproduce score for %s", F.col("work_id").cast("string"))).cast("double")
    checked = F.when(F.abs(F.col("score") - F.col("contribution_sum")) <= TOLERANCE, F.col("contribution_sum")).otherwise(wrong)
    return rows.select("work_id", "score", checked.alias("contribution_sum"), F.coalesce("families", F.lit(0)).alias("families"))


def second_overview(rows: DataFrame) -> DataFrame:
    """One row of totals and counts over features of the second profile with closure_requires_review and monthly_status."""
    spent = F.coalesce("final_spend", "released")
    closure, delayed = F.coalesce("closure_requires_review", F.lit(False)), F.col("observed_delay")
    got = rows.agg(
        F.countDistinct(F.struct("state", "district", "sub_sector")).alias("locations"),
        F.count("*").alias("works"),
        F.sum("sanctioned").alias("sanctioned"),
        F.sum("released").alias("released"),
        F.sum(spent).alias("utilized"),
        F.count_if(F.col("lifecycle") == "COMPLETION").alias("completed"),
        F.count_if((F.col("lifecycle") == "EXECUTION") & ~delayed).alias("ongoing"),
        F.count_if(F.col("lifecycle") == "PRE_SANCTION").alias("recommended"),
        F.count_if(delayed).alias("delayed"),
        F.count_if("observed_overrun").alias("over_budget"),
        F.count_if(closure).alias("pending_records"),
        F.count_if(F.col("monthly_status") == "OVERDUE").alias("evidence_overdue"),
    )
    return got.withColumns({"remaining": F.col("released") - F.col("utilized"), "utilization_pct": fixed(safe_ratio(F.col("utilized") * 100.0, "sanctioned"), 1)})


def yearly_use(rows: DataFrame) -> DataFrame:
    """Per fiscal year of sanction (April on) the share of the sanctioned that is released, and its change on the year before in points."""
    year = F.year("sanctioned_on") - (F.month("sanctioned_on") < 4).cast("int")
    years = rows.where("sanctioned_on is not null").groupBy(year.alias("fiscal_year")).agg(F.sum("sanctioned").alias("sanctioned"), F.sum("released").alias("released"))
    years = years.withColumn("use_pct", safe_ratio(F.col("released") * 100.0, "sanctioned"))
    before = years.select((F.col("fiscal_year") + 1).alias("fiscal_year"), F.col("use_pct").alias("before"))  # a row per year
    return years.join(before, "fiscal_year", "left").withColumn("change", F.col("use_pct") - F.col("before")).drop("before")


#: What each role compares.
COMPARED = {"NATIONAL": "state", "STATE": "district", "DISTRICT": "mp_id", "IA": "sub_sector", "MP": "sector"}


def second_comparison(rows: DataFrame, role: str) -> DataFrame:
    """Rates of the groups that a role compares, to one digit."""
    if role not in COMPARED:
        raise ScopeError(f"no role {role}")
    rate = lambda test: fixed(F.avg(F.coalesce(test, F.lit(False)).cast("int")) * 100, 1)
    use = fixed(safe_ratio(F.sum(F.coalesce("final_spend", "released")) * 100.0, F.sum("sanctioned")), 1)
    return rows.groupBy(F.col(COMPARED[role]).cast("string").alias("label")).agg(F.count("*").alias("works"), use.alias("utilization_pct"), rate(F.col("lifecycle") == "COMPLETION").alias("completion_pct"), rate(F.col("observed_delay")).alias("delayed_pct"), rate(F.col("closure_requires_review")).alias("records_pct"))


def group_scope(role: str, state: str | None = None, district: str | None = None) -> Column:
    """Which encoded groups ("state=..|district=..|..") a role may see; a state's role sees no group without its state, MP none."""
    if role == "NATIONAL":
        return F.lit(True)
    if role == "MP":
        return F.lit(False)
    if role not in ("STATE", "DISTRICT", "IA") or state is None or (role == "DISTRICT" and district is None):
        raise ScopeError(f"{role} lacks its place")
    held = lambda name, value: F.array_contains(F.split("group_value", r"\|"), f"{name}={value}")
    return held("state", state) & held("district", district) if role == "DISTRICT" else held("state", state)


def trend_view(series: DataFrame, allowed: Column, metric: str | None = None, group_type: str | None = None, tokens: dict[str, str] | None = None, first: str | None = None, last: str | None = None, limit: int = 100) -> DataFrame:
    """The first `limit` rows of a scope's series under filters, by group, metric and month, with the total of all."""
    rows = series.where(allowed)
    for name, value in (("metric", metric), ("group_type", group_type)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    for name, value in (tokens or {}).items():
        rows = rows.where(F.array_contains(F.split("group_value", r"\|"), f"{name}={value}"))
    rows = rows if first is None else rows.where(F.col("month") >= F.lit(first).cast("date"))
    rows = rows if last is None else rows.where(F.col("month") <= F.lit(last).cast("date"))
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("group_type", "group_value", "metric", "month").limit(limit).crossJoin(total)  # total has one row


def second_queue(rows: DataFrame, search: str | None = None, equal: dict[str, object] | None = None, requires_review: bool | None = None) -> DataFrame:
    """Rows under equality, a text that id or description holds in any case, and whether they ask for a review."""
    for name, value in (equal or {}).items():
        rows = rows if value is None else rows.where(F.col(name) == F.lit(value))
    if search:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", F.col("work_id").cast("string"), "description")), F.lit(search.lower())))
    return rows if requires_review is None else rows.where(F.coalesce("requires_review", F.lit(False)) == F.lit(requires_review))


def within_stage_rank(scores: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Adds stage_rank, 1 for the greatest score of a lifecycle stage, ties by work; found over ranges."""
    from worksight.functions.stats import cumulated

    return cumulated(scores, ["lifecycle"], [F.desc(score), F.col("work_id")], F.lit(1), "stage_rank")


def numbered_alerts(alerts: DataFrame, prefix: str = "D7") -> DataFrame:
    """Alerts with ids PREFIX-000001.. in the order of strength, work, type and code, numbered over ranges."""
    from worksight.functions.stats import cumulated

    rows = cumulated(alerts, [], [F.desc("strength"), F.col("work_id"), F.col("alert_type"), F.col("evidence_code")], F.lit(1), "n__")
    return rows.withColumn("alert_id", F.format_string(f"{prefix}-%06d", "n__")).drop("n__")


def explanation_coverage(works: DataFrame, references: DataFrame) -> DataFrame:
    """Of an explanation run: works, those with direct references, references in all, distinct ones, and the most of one work."""
    own = references.groupBy("work_id").agg(F.count("*").alias("n"))
    rows = works.select("work_id").join(own, "work_id", "left")
    basic = rows.agg(F.count("*").alias("works"), F.count("n").alias("with_references"), F.coalesce(F.sum("n"), F.lit(0)).alias("references"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    return basic.crossJoin(references.agg(F.countDistinct("reference").alias("distinct_references")))  # one row each


def first_found(results: DataFrame, categories: dict[str, Column]) -> DataFrame:
    """Per query the place of the first result that meets each category, null where none does."""
    found = [F.min(F.when(test, F.col("place"))).alias(name) for name, test in categories.items()]
    return results.groupBy("query_id").agg(*found)
