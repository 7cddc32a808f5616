"""The star-schema tables in the roles of the lifecycle domain.

orders are works, their customers the proponents, lineitem the payments, suppliers the
vendors, events the progress reports. Amounts are integer hundredths, so that sums don't
depend on their order. Dates that the tables lack are fixed offsets from those they have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-12-31"
EVENTS_AS_OF = "2024-01-20"

CENTS = "cast(floor({} * 100 + 0.5) as bigint)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proponents with their geography. Nations and regions are small; Spark sizes the joins."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey as mp_id", "n_name as district", "r_name as state", "c_mktsegment as sub_sector")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as work_id",
        "o_custkey as mp_id",
        "o_orderpriority as sector",
        "o_orderstatus as status",
        f"{CENTS.format('o_totalprice')} as sanctioned",
        "cast(o_orderdate as date) as recommended_on",
        "date_add(cast(o_orderdate as date), cast(o_orderkey % 60 as int)) as sanctioned_on",
        "date_add(cast(o_orderdate as date), cast(180 + o_orderkey % 400 as int)) as expected_on",
    )
    return orders.join(dimension(spark, sf_dir), "mp_id")


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as work_id",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(floor(l_extendedprice * 100 + 0.5) as bigint)) as payment_id",
        "l_suppkey as vendor_id",
        "date_sub(cast(l_shipdate as date), cast(l_partkey % 7 as int)) as requested_on",
        "date_sub(cast(l_shipdate as date), cast(l_suppkey % 9 - 2 as int)) as authorized_on",
        "cast(l_shipdate as date) as released_on",
        f"{CENTS.format('(l_extendedprice * (1 - l_discount))')} as amount",
        "l_linenumber as stage",
        "l_returnflag = 'R' as is_final",
        "l_linestatus = 'F' as is_released",
        "concat('R', l_partkey % 300, '-', l_suppkey) as reference",
    )


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id as work_id",
        "event_id as progress_id",
        "ts",
        "cast(ts as date) as report_date",
        "least(100.0D, value) as physical",
        "cast(get_json_object(props, '$.k') as double) as financial",
        "event_type as stage",
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset of each completed work, two of every seventh."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey as work_id", "cast(o_orderdate as date) as d", "o_totalprice as price", "explode(if(o_orderkey % 7 = 0, array(1, 2), array(1))) as part")
    return done.selectExpr(
        "work_id",
        "concat(work_id, '-', part) as asset_id",
        "date_add(d, cast(200 + work_id % 300 as int)) as completed_on",
        "date_add(d, cast(205 + work_id % 300 as int)) as marked_on",
        "cast(floor(price * 100 * (80 + work_id % 50) / 100 + 0.5) as bigint) as final_spend",
        "if(work_id % 11 = 0, null, date_add(d, cast(210 + work_id % 320 + part as int))) as public_use_on",
        "if(work_id % 13 = 0, null, date_add(d, cast(208 + work_id % 310 + part as int))) as handover_on",
        "if(work_id % 17 = 0, null, date_add(d, cast(220 + work_id % 330 as int))) as certificate_on",
        "case work_id % 6 when 0 then 'No' when 1 then 'Pending' when 2 then null else 'Yes' end as register_entry",
        "case work_id % 5 when 0 then 'Pending' when 1 then null else 'Submitted' end as certificate_status",
        "if(work_id % 9 = 0, '', concat('PHOTO-', work_id)) as photo",
    )


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Described works: documents in the role of work descriptions.

    Places and amounts are cut from the length of the text, finer from level to level, so
    that copies and near copies lie close together, as records entered twice do.
    """
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as work_id",
        "text as description",
        "lang as sector",
        "concat('S', n_chars div 3000) as sub_sector",
        "concat('R', n_chars div 8000) as state",
        "concat('D', n_chars div 2000) as district",
        "concat('B', n_chars div 500) as block",
        "concat('V', n_chars div 100) as village",
        "10 + (n_chars div 100) * 0.01D as latitude",
        "75 + (n_chars % 100) * 0.0001D as longitude",
        "n_chars * 100000 as recommended",
        "n_chars * 1000 * (90 + doc_id % 15) as sanctioned",
        "date_add(date'1997-01-01', cast(doc_id % 400 as int)) as recommended_on",
        "source as agency",
    )


def site_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports from the site of a work: a payment's line some days later, its quantity and discount as progress."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as work_id",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(floor(l_extendedprice * 100 + 0.5) as bigint)) as progress_id",
        "date_add(cast(l_shipdate as date), cast(l_partkey % 15 as int)) as report_date",
        "least(100.0D, l_quantity * 2) as physical",
        "least(100.0D, floor(l_discount * 1000 + 0.5)) as financial",
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence from the site with its place: a payment's line some days later, a final one of the completion."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as work_id",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(floor(l_extendedprice * 100 + 0.5) as bigint)) as evidence_id",
        "date_add(cast(l_shipdate as date), cast(l_partkey % 15 as int)) as captured_on",
        "if(l_returnflag = 'R', 'COMPLETION', 'MONTHLY_PROGRESS') as stage",
        f"{REGISTERED['latitude'].format('l_orderkey')} + (l_suppkey % 7) * 0.001D as latitude",
        f"{REGISTERED['longitude'].format('l_orderkey')} as longitude",
    )


# Where works are registered, a place by the work's id.
REGISTERED = {"latitude": "10 + ({0} % 200) * 0.05D", "longitude": "75 + ({0} % 170) * 0.05D"}
