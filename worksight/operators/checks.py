"""Integrity checks; each gives issue rows (issue_code, severity, table_name, record_id, work_id, observed)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEVERITIES = ("ERROR", "WARNING", "INFO")
ISSUE = ["issue_code", "severity", "table_name", "record_id", "work_id", "observed"]


def issues(df: DataFrame, bad: Column, code: str, severity: str, table: str, record: str, work: str = "work_id", observed: Column | None = None) -> DataFrame:
    """The rows where `bad` holds, as issues; a null condition is no issue."""
    seen = observed if observed is not None else F.lit(None)
    return df.where(bad).select(F.lit(code).alias("issue_code"), F.lit(severity).alias("severity"), F.lit(table).alias("table_name"), F.col(record).cast("string").alias("record_id"), F.col(work).cast("string").alias("work_id"), seen.cast("string").alias("observed"))


def key_faults(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows, null keys, repeated rows (all and without the first)."""
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key))
    groups = df.groupBy(*key).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).cast("bigint").alias("null_keys"), F.coalesce(F.sum(F.when((F.col("n") > 1) & ~null, F.col("n"))), F.lit(0)).cast("bigint").alias("repeated_rows"), F.coalesce(F.sum(F.when((F.col("n") > 1) & ~null, F.col("n") - 1)), F.lit(0)).cast("bigint").alias("extra_rows"))


def relationship(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """One row: how many child rows have a key, match, and don't; PASS without orphans.

    Child keys are counted first, so the join sees each key once however skewed it is.
    """
    counts = child.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    marked = counts.join(parent.select(F.col(parent_key).alias("k")).distinct().withColumn("found", F.lit(True)), "k", "left")
    n, found = F.col("n"), F.col("found").isNotNull()
    out = marked.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("k").isNull(), n)), F.lit(0)).cast("bigint").alias("null_keys"), F.coalesce(F.sum(F.when(found, n)), F.lit(0)).cast("bigint").alias("matched"))
    out = out.withColumn("orphans", F.col("total") - F.col("matched") - F.col("null_keys"))
    return out.select(F.lit(name).alias("relationship"), "*", F.when(F.col("orphans") == 0, "PASS").otherwise("FAIL").alias("status"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, code: str, table: str, record: str) -> DataFrame:
    rows = child.join(parent.select(F.col(parent_key).alias("k__")).distinct(), F.col(key) == F.col("k__"), "left_anti")
    return issues(rows.where(F.col(key).isNotNull()), F.lit(True), code, "ERROR", table, record, observed=F.col(key))


def wrong_type(child: DataFrame, key: str, parent: DataFrame, parent_key: str, wanted: Column, code: str, table: str, record: str) -> DataFrame:
    """Keys that exist among the parents, but not among those of the wanted kind."""
    kinds = parent.groupBy(F.col(parent_key).alias("k__")).agg(F.bool_or(wanted).alias("right__"))
    rows = child.join(kinds, F.col(key) == F.col("k__")).where(~F.coalesce("right__", F.lit(False)))
    return issues(rows, F.lit(True), code, "ERROR", table, record, observed=F.col(key))


def out_of_range(df: DataFrame, ranges: dict[str, tuple[float, float]], table: str, record: str) -> DataFrame:
    """Values outside inclusive ranges, null ones too; one row per field and record."""
    parts = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for c, (a, b) in ranges.items()])
    long = df.select(record, "work_id", F.explode(parts).alias("p")).select(record, "work_id", "p.*")
    return issues(long, ~F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(False)), "VALUE_OUT_OF_RANGE", "ERROR", table, record, observed=F.col("field"))


def chronology(df: DataFrame, pairs: dict[str, tuple[str, str]], table: str, record: str) -> DataFrame:
    """Per code (earlier, later): the later date lies before the earlier. One scan for all."""
    tests = F.array_compact(F.array(*[F.when(F.col(later) < F.col(earlier), F.lit(code)) for code, (earlier, later) in pairs.items()]))
    long = df.select(record, "work_id", F.explode(tests).alias("code"))
    return long.select(F.col("code").alias("issue_code"), F.lit("WARNING").alias("severity"), F.lit(table).alias("table_name"), F.col(record).cast("string").alias("record_id"), F.col("work_id").cast("string").alias("work_id"), F.lit(None).cast("string").alias("observed"))


def future_events(df: DataFrame, dates: list[str], as_of: str, table: str, record: str) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.col(d) > F.lit(as_of).cast("date"), F.lit(d)) for d in dates]))
    return issues(df.select(record, "work_id", F.explode(found).alias("field")), F.lit(True), "FUTURE_ACTUAL_EVENT", "WARNING", table, record, observed=F.col("field"))


def sequence_decrease(df: DataFrame, value: str, order: list[str], table: str, record: str) -> DataFrame:
    change = F.col(value) - F.lag(value).over(W.partitionBy("work_id").orderBy(*order))
    return issues(df.withColumn("change__", change), F.col("change__") < 0, "PROGRESS_DECREASE", "WARNING", table, record)


def repeated(df: DataFrame, by: list[str], order: list[Column], code: str, table: str, record: str, severity: str = "WARNING") -> DataFrame:
    """All but the first row, in the given order, of rows that share `by`; a null in it shares nothing."""
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in by))
    nth = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return issues(df.where(known).withColumn("nth__", nth), F.col("nth__") > 1, code, severity, table, record)


def above(df: DataFrame, value: str, limit: float, code: str, table: str, record: str) -> DataFrame:
    """Values above a limit, which later rules have to interpret."""
    return issues(df, F.col(value) > limit, code, "WARNING", table, record, observed=F.col(value))


def negative_money(df: DataFrame, fields: list[str], table: str, record: str, work: str) -> DataFrame:
    """Negative amounts; one row per field and record."""
    found = F.array_compact(F.array(*[F.when(F.col(f) < 0, F.lit(f)) for f in fields]))
    rows = df.select(F.col(record).alias("record__"), F.col(work).alias("work__"), F.explode(found).alias("field"))
    return issues(rows, F.lit(True), "NEGATIVE_MONETARY_VALUE", "WARNING", table, "record__", "work__", F.col("field"))


def after_completion(progress: DataFrame, assets: DataFrame) -> DataFrame:
    """Reports dated after the last completion of their work."""
    ended = assets.groupBy("work_id").agg(F.max("completed_on").alias("completed_on"))
    return issues(progress.join(ended, "work_id"), F.col("report_date") > F.col("completed_on"), "PROGRESS_AFTER_COMPLETION", "WARNING", "progress", "progress_id", observed=F.col("completed_on"))


def asset_date_order(assets: DataFrame, fields: list[str]) -> DataFrame:
    """Dates of an asset that lie before its completion."""
    found = F.array_compact(F.array(*[F.when(F.col(f) < F.col("completed_on"), F.lit(f)) for f in fields]))
    return issues(assets.select("asset_id", "work_id", F.explode(found).alias("field")), F.lit(True), "ASSET_DATE_ORDER_INCONSISTENCY", "WARNING", "assets", "asset_id", observed=F.col("field"))


def cumulative_mismatch(payments: DataFrame, reported: Column, order: list[Column]) -> DataFrame:
    """Payments whose reported running total is not that of the canonical order; a null one is a mismatch."""
    rows = running_totals(payments.withColumn("reported__", reported), order)
    return issues(rows, ~F.col("reported__").eqNullSafe(F.col("cumulative")), "PAYMENT_CUMULATIVE_MISMATCH", "WARNING", "payments", "payment_id", observed=F.col("cumulative"))


def label_faults(labels: DataFrame, key: str, parent: DataFrame, fields: list[str]) -> DataFrame:
    """issue_code, issues of a label table: null, repeated and unknown keys, values other than 0 and 1; zeros too."""
    keys = labels.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(F.col(f).isin(0, 1), F.lit(False))).alias(f"bad_{f}") for f in fields])
    marked = keys.join(parent.select(F.col(key).alias("k")).where("k is not null").distinct().withColumn("found", F.lit(True)), "k", "left")
    n, known = F.col("n"), F.col("k").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    counts = {"NULL_LABEL_KEY": total(F.when(~known, n)), "DUPLICATE_LABEL": total(F.when(known & (n > 1), n - 1)), "ORPHAN_LABEL": total(F.when(known & F.col("found").isNull(), n))}
    counts |= {f"INVALID_{f.upper()}": total(F.col(f"bad_{f}")) for f in fields}
    row = marked.agg(*[c.alias(name) for name, c in counts.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("issue_code"), F.col(name).alias("issues")) for name in counts])).alias("c")).select("c.*")


def severity_counts(found: DataFrame) -> DataFrame:
    """Issues of every severity, zero for those without any."""
    row = found.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return row.select(F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("issues")) for s in SEVERITIES])).alias("c")).select("c.*")


def feature_contract(table: DataFrame, key: str, expected: DataFrame, columns: list[str], forbidden: list[str]) -> DataFrame:
    """rule, violations of a feature table: one row per expected key, no others, declared columns only, no labels."""
    keys = table.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    both = keys.join(expected.select(F.col(key).alias("k"), F.lit(True).alias("wanted")).distinct(), "k", "full")
    counts = both.agg(F.count_if(F.col("n") > 1).alias("REPEATED_KEY"), F.count_if(F.col("n").isNull()).alias("MISSING_KEY"), F.count_if(F.col("wanted").isNull()).alias("UNEXPECTED_KEY"))
    fixed_ = {"UNDECLARED_COLUMN": len(set(table.columns) - set(columns)), "MISSING_COLUMN": len(set(columns) - set(table.columns)), "LABEL_COLUMN": len(set(forbidden) & set(table.columns))}
    rows = [F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in ("REPEATED_KEY", "MISSING_KEY", "UNEXPECTED_KEY")] + [F.struct(F.lit(r).alias("rule"), F.lit(v).cast("bigint").alias("violations")) for r, v in fixed_.items()]
    return counts.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def required_keys(df: DataFrame, rules: dict[str, tuple[str, Column]], table: str, record: str) -> DataFrame:
    """Rows without a key that their state asks for: rules by code, (key column, whether the row needs it)."""
    found = F.array_compact(F.array(*[F.when(F.col(key).isNull() & F.coalesce(needed, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(key).alias("key"))) for code, (key, needed) in rules.items()]))
    rows = df.select(record, "work_id", F.explode(found).alias("x"))
    return rows.select(F.col("x.code").alias("issue_code"), F.lit("ERROR").alias("severity"), F.lit(table).alias("table_name"), F.col(record).cast("string").alias("record_id"), F.col("work_id").cast("string").alias("work_id"), F.col("x.key").alias("observed"))


def before_parent(children: DataFrame, when: str, parents: DataFrame, limits: dict[str, str], table: str, record: str) -> DataFrame:
    """Children dated before a date of their work: limits by code, the parent's date column; null dates are no issue."""
    joined = children.join(parents.select("work_id", *limits.values()), "work_id")
    return chronology(joined, {code: (limit, when) for code, limit in limits.items()}, table, record)


def status_inconsistency(works: DataFrame, idle: Column, payments: DataFrame, reports: DataFrame) -> DataFrame:
    """Works that haven't begun by their status, but have payments, progress or spending."""
    paid = payments.groupBy("work_id").agg(F.count("*").alias("payments"), F.sum("amount").alias("spent"))
    told = reports.where("physical > 0 or financial > 0").groupBy("work_id").agg(F.count("*").alias("reports"))
    rows = works.where(idle).select("work_id", "status").join(paid, "work_id", "left").join(told, "work_id", "left")
    rows = rows.select("work_id", "status", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("payments", "reports", "spent")])
    return rows.where("payments > 0 or reports > 0 or spent > 0")


def value_contract(table: DataFrame, ratios: dict[str, tuple[str, str]], dates: list[str], as_of: str, payments: DataFrame) -> DataFrame:
    """rule, violations of a feature table's values, in one pass and a join with the payments' sums.

    No number is infinite; a ratio (its numerator, its denominator) is null exactly where the denominator is null or
    not positive or the numerator null; no date lies after as_of; totals and counts are those of the
    visible payments; the completion flag fits the assets counted.
    """
    numbers = [c for c, kind in table.dtypes if kind in ("double", "float")]
    day = F.lit(as_of).cast("date")
    infinite = [F.count_if(F.coalesce(F.abs(F.col(c)) == float("inf"), F.lit(False)) | F.coalesce(F.isnan(c), F.lit(False))) for c in numbers]
    odd = [F.count_if(F.col(r).isNull() != (~F.coalesce(F.col(d) > 0, F.lit(False)) | F.col(n).isNull())) for r, (n, d) in ratios.items()]
    late = [F.count_if(F.col(c) > day) for c in dates]
    sums = payments.where("is_released").where(F.col("released_on") <= day).groupBy("work_id").agg(F.count("*").alias("n__"), F.sum("amount").alias("s__"))
    rows = table.join(sums, "work_id", "left")
    added = lambda parts: reduce(lambda a, b: a + b, parts, F.lit(0).cast("long"))
    got = rows.agg(
        added(infinite).alias("INFINITE_VALUE"),
        added(odd).alias("RATIO_NULLNESS"),
        added(late).alias("FUTURE_DATE"),
        F.count_if((F.col("payment_count") != F.coalesce("n__", F.lit(0))) | (F.col("released_total") != F.coalesce("s__", F.lit(0)))).alias("PAYMENTS_DONT_RECONCILE"),
        F.count_if((F.col("lifecycle") == "COMPLETION") & (F.col("asset_count") == 0) | (F.col("lifecycle") == "EXECUTION") & (F.col("asset_count") > 0)).alias("COMPLETION_MISMATCH"),
    )
    names = ["INFINITE_VALUE", "RATIO_NULLNESS", "FUTURE_DATE", "PAYMENTS_DONT_RECONCILE", "COMPLETION_MISMATCH"]
    return got.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in names])).alias("c")).select("c.*")


def total_mismatch(works: DataFrame, reported: str, payments: DataFrame) -> DataFrame:
    """Works with payments whose sum is not the reported total."""
    sums = payments.groupBy("work_id").agg(F.sum("amount").alias("paid"))
    return works.join(sums, "work_id").where(F.col("paid") != F.col(reported)).select("work_id", F.col(reported).alias("reported"), "paid")


def running_totals(payments: DataFrame, order: list[Column]) -> DataFrame:
    """payments with the cumulative amount of their work in canonical order."""
    w = W.partitionBy("work_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return payments.withColumn("cumulative", F.sum("amount").over(w))


def cardinality(parents: DataFrame, children: DataFrame) -> DataFrame:
    """How many children parents have: none, one, more, and their distribution."""
    counts = parents.select("work_id").join(children.groupBy("work_id").agg(F.count("*").alias("n")), "work_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return counts.agg(F.count_if(F.col("n") == 0).alias("with_none"), F.count_if(F.col("n") == 1).alias("with_one"), F.count_if(F.col("n") > 1).alias("with_many"), F.min("n").alias("minimum"), F.percentile("n", 0.5).alias("median"), F.avg("n").alias("mean"), F.max("n").alias("maximum"))


def summary(found: DataFrame) -> DataFrame:
    """Issues by severity and code."""
    return found.groupBy("severity", "issue_code").agg(F.count("*").alias("issues"), F.countDistinct("work_id").alias("works"))
