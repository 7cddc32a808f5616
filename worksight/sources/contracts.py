"""Typed table contracts: strict CSV scans, parse reports, manifests, guarded sinks."""

from __future__ import annotations

import dataclasses
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"string": "string", "category": "string", "date": "date", "integer": "bigint", "float": "double", "boolean": "boolean"}
BOM = "\ufeff"


class ContractError(ValueError):
    """A table doesn't keep its contract."""


@dataclasses.dataclass(frozen=True)
class Contract:
    """Ordered columns "name[:kind][?]" (string without kind; ? for nullable) and the key."""

    name: str
    key: tuple[str, ...]
    columns: tuple[str, ...]

    def parsed(self) -> list[tuple[str, str, bool]]:
        out = []
        for c in self.columns:
            name, _, kind = c.rstrip("?").partition(":")
            out.append((name, kind or "string", c.endswith("?")))
        return out

    def names(self) -> list[str]:
        return [n for n, _, _ in self.parsed()]


def _contract(name: str, key: str, columns: str) -> Contract:
    return Contract(name, tuple(key.split()), tuple(columns.split()))


# The column contracts of the operational tables.
CONTRACTS = {
    c.name: c
    for c in (
        _contract("mp", "mp_id", "mp_id mp_name house_type:category tenure state_code state_name constituency nodal_district annual_entitlement_inr:integer allocated_limit_inr:integer calamity_consent_amount_inr:integer record_effective_date:date source_type source_reference synthetic_marker:boolean"),
        _contract("entities", "entity_id", "entity_id entity_type:category entity_name state_name district registration_or_office_code vendor_category:category? active_status:category source_type synthetic_marker:boolean"),
        _contract("works", "work_id", "work_id mp_id house_type:category tenure state_name constituency nodal_district recommendation_date:date recommendation_type:category sector:category sub_sector:category work_description work_location_state district block village latitude:float longitude:float recommended_amount_inr:integer technical_estimate_amount_inr:integer sanctioned_amount_inr:integer sanction_date:date? sanction_status:category implementing_agency_id? expected_start_date:date? expected_completion_date:date? actual_start_date:date? current_status:category current_physical_progress_pct:float current_expenditure_inr:integer duplicate_group_reference? source_type source_reference synthetic_marker:boolean"),
        _contract("payments", "payment_id", "payment_id work_id vendor_id payment_request_date:date authorization_date:date payment_release_date:date payment_amount_inr:integer payment_stage invoice_number cumulative_expenditure_inr:integer payment_status:category payment_mode pfms_reference authorized_by_agency_id concurrence_authority is_final_payment:boolean source_type synthetic_marker:boolean"),
        _contract("progress", "progress_id", "progress_id work_id report_date:date physical_progress_pct:float financial_progress_pct:float expected_progress_pct_by_date:float execution_stage:category reported_status:category reported_by_agency_id photo_reference geo_latitude:float geo_longitude:float remarks source_type synthetic_marker:boolean"),
        _contract("assets", "asset_id work_id", "work_id completion_date:date completion_marked_date:date final_expenditure_inr:integer utilization_certificate_status:category utilization_certificate_date:date? asset_id asset_type user_agency asset_register_entry:category handover_date:date public_use_date:date audit_status:category audit_date:date? audit_observation_category compliance_status:category maintenance_agency completion_photo_reference source_type synthetic_marker:boolean"),
    )
}


def parsed(raw: Column, kind: str) -> Column:
    """The typed value of a text, blank as null and null if it can't be parsed."""
    text = F.when(F.trim(raw) != "", F.trim(raw))
    if kind == "date":
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    if kind == "integer":
        number = text.try_cast("decimal(38,6)")
        return F.when(number == F.floor(number), number.cast("decimal(38,0)").try_cast("bigint"))
    if kind == "float":
        number = text.try_cast("double")
        return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    if kind == "boolean":
        return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)
    return text


def scan_csv(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """The CSV as text columns, in the contract's order; the header must match exactly."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip(BOM).strip() for c in raw.columns])
    wanted = contract.names()
    if raw.columns != wanted:
        missing, extra = [c for c in wanted if c not in raw.columns], [c for c in raw.columns if c not in wanted]
        raise ContractError(f"{contract.name}: missing {missing}, unexpected {extra}" if missing or extra else f"{contract.name}: columns out of order")
    return raw


def typed(raw: DataFrame, contract: Contract) -> DataFrame:
    return raw.select(*[parsed(F.col(n), k).cast(TYPES[k]).alias(n) for n, k, _ in contract.parsed()])


def parse_report(raw: DataFrame, contract: Contract, examples: int = 5) -> DataFrame:
    """Per column: values that can't be parsed, up to five of them, and missing required ones. One pass."""
    pieces = []
    for n, k, nullable in contract.parsed():
        bad = (F.trim(F.col(n)) != "") & parsed(F.col(n), k).isNull()
        absent = F.coalesce(F.trim(F.col(n)) == "", F.lit(True)) & F.lit(not nullable)
        pieces.append(F.struct(F.lit(n).alias("column"), F.lit(k).alias("kind"), F.when(bad, F.col(n)).alias("bad"), absent.alias("absent")))
    rows = raw.select(F.explode(F.array(*pieces)).alias("p")).select("p.*")
    some = F.slice(F.array_sort(F.collect_set(F.substring("bad", 1, 80))), 1, examples)
    return rows.groupBy("column", "kind").agg(F.count("bad").alias("unparsed"), F.count_if("absent").alias("missing_required"), some.alias("examples"))


def load(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """A typed table whose every value parses and whose required values are there."""
    raw = scan_csv(spark, path, contract)
    faults = parse_report(raw, contract).where("unparsed > 0 or missing_required > 0").orderBy("column").limit(20).collect()
    if faults:
        raise ContractError(f"{contract.name}: " + "; ".join(f"{r.column}: {r.unparsed} unparsed {r.examples}, {r.missing_required} missing" for r in faults))
    return typed(raw, contract)


def load_all(spark: SparkSession, folder: str, files: dict[str, str]) -> dict[str, DataFrame]:
    return {name: load(spark, f"{folder}/{file}", CONTRACTS[name]) for name, file in files.items()}


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """file, bytes, sha256 of every file of a folder."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_faults(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or changed (expected: file, sha256)."""
    both = actual.select("file", F.col("sha256").alias("found")).join(expected.select("file", "sha256"), "file", "full")
    kind = F.when(F.col("found").isNull(), "MISSING").when(F.col("sha256").isNull(), "UNEXPECTED").when(F.col("found") != F.col("sha256"), "CHANGED")
    return both.select("file", kind.alias("fault")).where("fault is not null")


def content_hash(df: DataFrame) -> DataFrame:
    """rows and an order-free hash of all values; equal before and after proves no change."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).cast("string").alias("hash"))


def guarded(root: str, path: str) -> str:
    """path, which must lie below root."""
    root, path = os.path.normpath(root), os.path.normpath(path)
    if os.path.commonpath([root, path]) != root or root == path:
        raise ContractError(f"{path} is outside {root}")
    return path


def write_csv(df: DataFrame, root: str, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(guarded(root, path))


def write_jsonl(df: DataFrame, root: str, path: str) -> None:
    """One JSON record a line; NaN and infinity become null."""
    from worksight.functions.scalar import json_safe

    safe = df.select(*[json_safe(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    safe.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(guarded(root, path))


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Records by key; a repeated key is an error."""
    df = spark.read.schema(schema).json(path)
    twice = df.groupBy(key).count().where("count > 1").limit(5).collect()
    if twice:
        raise ContractError(f"repeated {key}: {[r[0] for r in twice]}")
    return df


def read_json(spark: SparkSession, path: str, needs: dict[str, object] | None = None) -> dict:
    """A small JSON file of settings or metadata, from any store, as a dict; `needs` are values that it must have.

    It is read by Spark, whole, on the driver; a file of over a MB is an error.
    """
    found = spark.read.format("binaryFile").load(path).where("length <= 1048576").select("content").take(2)
    if len(found) != 1:
        raise ContractError(f"{path} is not one file of up to a MB")
    got = json.loads(found[0].content.decode("utf-8-sig"))
    wrong = {k: got.get(k) for k, v in (needs or {}).items() if got.get(k) != v}
    if wrong:
        raise ContractError(f"{path}: {wrong} where {({k: needs[k] for k in wrong})} is needed")
    return got


def load_supplements(spark: SparkSession, folder: str, files: dict[str, str]) -> dict[str, DataFrame]:
    """Supplementary CSV files by name, all columns as text, joined with nothing; headers must have no blank or repeated names."""
    out = {}
    for name, file in files.items():
        raw = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(f"{folder}/{file}")
        names = [c.lstrip(BOM).strip() for c in raw.columns]
        if "" in names or len(set(names)) < len(names):
            raise ContractError(f"{name}: columns {names}")
        out[name] = raw.toDF(*names)
    return out


def load_labels(spark: SparkSession, path: str, contract: Contract, known: DataFrame, key: str) -> DataFrame:
    """Labels for evaluation alone, one row per key, all of them known; no scoring operator reads them.

    known has the key of everything that may be labelled. A repeated or unknown key is an error.
    """
    rows = load(spark, path, contract)
    odd = rows.groupBy(key).agg(F.count("*").alias("n")).join(known.select(key, F.lit(True).alias("known__")).distinct(), key, "left")
    bad = odd.where("n > 1 or known__ is null").limit(5).collect()
    if bad:
        raise ContractError(f"{contract.name}: repeated or unknown {[r[key] for r in bad]}")
    return rows


def load_profile(spark: SparkSession, folder: str, metadata: str, files: dict[str, Contract], needs: dict[str, object]) -> dict[str, DataFrame]:
    """Typed tables of a profile, only if its metadata file says what is needed, such as that its data are synthetic."""
    read_json(spark, f"{folder}/{metadata}", needs)
    return {contract.name: load(spark, f"{folder}/{file}", contract) for file, contract in files.items()}


def write_summary(df: DataFrame, root: str, path: str) -> None:
    """The one row of df as one JSON object, keys in order, NaN and infinity as null."""
    from worksight.functions.scalar import json_safe

    rows = df.limit(2).count()
    if rows != 1:
        raise ContractError(f"a summary is one row, not {'none' if not rows else 'more'}")
    safe = df.select(*[(json_safe(c) if t in ("double", "float") else F.col(c)).alias(c) for c, t in sorted(df.dtypes)])
    safe.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(guarded(root, path))


def unchanged(inputs: dict[str, DataFrame], run):
    """run()'s result, if the inputs hold the same rows after it as before; else an error that names those that don't."""
    hashes = lambda: {name: tuple(content_hash(df).first()) for name, df in inputs.items()}
    before = hashes()
    out = run()
    changed = [name for name, now in hashes().items() if now != before[name]]
    if changed:
        raise ContractError(f"inputs changed: {changed}")
    return out


def artifact_manifest(spark: SparkSession, folder: str, tables: dict[str, str]) -> DataFrame:
    """table, files, bytes, rows, sha256 of Parquet tables below a folder (table: its path in it); the hash is over the files' hashes in order."""
    out = None
    for name, path in tables.items():
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{folder}/{path}").select("path", "length", F.sha2("content", 256).alias("sha256"))
        listed = files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.element_at(F.split("path", "/"), -1).alias("file"), "sha256"))), lambda x: x["sha256"]), ","), 256).alias("sha256"))
        rows = spark.read.parquet(f"{folder}/{path}").agg(F.count("*").alias("rows"))
        one = listed.crossJoin(rows).select(F.lit(name).alias("table"), "files", "bytes", "rows", "sha256")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def integrity_faults(tables: dict[str, DataFrame], expected: DataFrame, keys: dict[str, str], links: list[tuple[str, str, str, str]]) -> DataFrame:
    """table, fault, found of tables that don't fit: rows other than expected (table, rows), repeated or null keys, children without parents."""
    parts = []
    for name, df in tables.items():
        counted = df.agg(F.count("*").alias("rows")).withColumn("table", F.lit(name))
        both = counted.join(expected.withColumnRenamed("rows", "wanted"), "table", "left")
        parts.append(both.where("wanted is null or wanted <> rows").select("table", F.lit("ROW_COUNT").alias("fault"), F.col("rows").alias("found")))
        if name in keys:
            twice = df.groupBy(keys[name]).agg(F.count("*").alias("n")).where(F.col("n") > 1).agg(F.count("*").alias("found"))
            empty = df.agg(F.count_if(F.col(keys[name]).isNull()).alias("found"))
            parts += [x.where("found > 0").select(F.lit(name).alias("table"), F.lit(fault).alias("fault"), "found") for x, fault in ((twice, "REPEATED_KEY"), (empty, "NULL_KEY"))]
    for child, key, parent, parent_key in links:
        lost = tables[child].where(F.col(key).isNotNull()).join(tables[parent].select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
        parts.append(lost.agg(F.count("*").alias("found")).where("found > 0").select(F.lit(child).alias("table"), F.lit(f"ORPHAN_{key}").alias("fault"), "found"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
