"""The test tables in the roles of the data model, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

AS_OF = "1998-06-15 00:00:00"
RUNS_AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def runs_as_of() -> Column:
    return F.lit(RUNS_AS_OF).cast("timestamp")


def areas(spark, d) -> DataFrame:
    return table(spark, d, "region").select(F.col("r_regionkey").alias("area_id"), F.col("r_name").alias("area_name"))


def regions(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(
        F.col("n_nationkey").alias("region_id"),
        F.col("n_name").alias("region_name"),
        F.format_string("R%02d", "n_nationkey").alias("region_code"),
        F.col("n_regionkey").alias("area_id"),
    )


def facilities(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("facility_id"),
        F.col("c_nationkey").alias("region_id"),
        F.col("c_name").alias("facility_name"),
        F.col("c_mktsegment").alias("facility_type"),
        (F.col("c_acctbal") > 0).alias("is_active"),
    )


def listings(spark, d) -> DataFrame:
    """Orders as listings; the deadline of one category is missing."""
    day = F.col("o_orderdate").cast("date")
    pri = F.col("o_orderpriority")
    st = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("listing_id"),
        F.col("o_custkey").alias("facility_id"),
        F.format_string("L-%08d", "o_orderkey").alias("external_id"),
        F.when(pri.isin("1-URGENT", "2-HIGH"), "cat").when(pri.isin("3-MEDIUM", "4-NOT SPECIFIED"), "dog")
        .otherwise("unknown").alias("animal_type"),
        F.when(F.col("o_orderkey") % 3 == 0, "male").when(F.col("o_orderkey") % 3 == 1, "female")
        .otherwise("unknown").alias("gender"),
        F.when(st == "P", "available").when(st == "O", "adopted").otherwise("pending").alias("status"),
        pri.alias("category"),
        F.when(pri != "4-NOT SPECIFIED", day).alias("deadline_date"),
        F.date_add(day, -30).alias("protection_date"),
        F.date_add(day, 1).alias("last_scraped_at"),
        (F.col("o_totalprice") > 300000).alias("transfer_decided"),
        F.col("o_totalprice").alias("price"),
    )


def runs(spark, d) -> DataFrame:
    """Events as runs of scrapers."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "signup", "mismatch").when(kind == "view", "empty").otherwise("success")
    n = F.floor("value").cast("int")
    found = F.when(kind == "view", 0).otherwise(n)
    return table(spark, d, "events").select(
        F.col("event_id").alias("run_id"),
        F.concat(F.lit("p"), F.col("user_id") % 8, F.lit("/s"), F.col("user_id")).alias("scraper_id"),
        F.col("user_id").alias("facility_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        status.alias("status"),
        (found + F.when(kind == "signup", 3).otherwise(0)).alias("html_count"),
        found.alias("yaml_count"),
        F.when(F.col("event_id") % 10 == 0, F.greatest(found - 1, F.lit(0))).otherwise(found).alias("db_count"),
        F.when(kind == "error", F.concat(F.lit("failed at "), F.col("props"))).alias("error_message"),
        F.when(kind == "signup", F.lit("lost 3")).alias("warning"),
        (F.col("value") * 1000).cast("bigint").alias("duration_ms"),
        F.floor(found / 2).cast("int").alias("added"),
        (found - F.floor(found / 2)).cast("int").alias("updated"),
        (F.col("event_id") % 3).cast("int").alias("removed"),
    )


# the same roles for the SQL twins
LISTING = """listing AS (
  SELECT o_orderkey AS listing_id, o_custkey AS facility_id, printf('L-%08d', o_orderkey) AS external_id,
    CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'cat'
         WHEN o_orderpriority IN ('3-MEDIUM','4-NOT SPECIFIED') THEN 'dog' ELSE 'unknown' END AS animal_type,
    CASE o_orderkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unknown' END AS gender,
    CASE o_orderstatus WHEN 'P' THEN 'available' WHEN 'O' THEN 'adopted' ELSE 'pending' END AS status,
    o_orderpriority AS category,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(o_orderdate AS DATE) END AS deadline_date,
    CAST(CAST(o_orderdate AS DATE) - 30 AS DATE) AS protection_date, CAST(CAST(o_orderdate AS DATE) + 1 AS DATE) AS last_scraped_at,
    o_totalprice > 300000 AS transfer_decided, o_totalprice AS price
  FROM orders)"""
FACILITY = """facility AS (
  SELECT c_custkey AS facility_id, c_nationkey AS region_id, c_name AS facility_name,
    c_mktsegment AS facility_type, c_acctbal > 0 AS is_active FROM customer)"""
REGION = """reg AS (
  SELECT n_nationkey AS region_id, n_name AS region_name, printf('R%02d', n_nationkey) AS region_code,
    n_regionkey AS area_id FROM nation)"""
RUNS = """runs AS (
  SELECT event_id AS run_id, 'p' || (user_id % 8) || '/s' || user_id AS scraper_id, user_id AS facility_id, ts,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'mismatch' WHEN 'view' THEN 'empty' ELSE 'success' END AS status,
    CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor(value) AS INTEGER) END
      + CASE WHEN event_type = 'signup' THEN 3 ELSE 0 END AS html_count,
    CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor(value) AS INTEGER) END AS yaml_count,
    CASE WHEN event_id % 10 = 0 THEN greatest(CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor(value) AS INTEGER) END - 1, 0)
         ELSE CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor(value) AS INTEGER) END END AS db_count,
    CASE WHEN event_type = 'error' THEN 'failed at ' || props END AS error_message,
    CASE WHEN event_type = 'signup' THEN 'lost 3' END AS warning,
    CAST(trunc(value * 1000) AS BIGINT) AS duration_ms,
    CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor(value) AS INTEGER) END // 2 AS added,
    CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor(value) AS INTEGER) - CAST(floor(value) AS INTEGER) // 2 END AS updated,
    event_id % 3 AS removed
  FROM events)"""
SERVE = f"WITH {LISTING}, {FACILITY}, {REGION}"
DETAIL = f"""{SERVE}, detail AS (
  SELECT l.*, f.facility_name, f.facility_type, f.is_active, r.region_id, r.region_name, r.region_code,
    CASE WHEN deadline_date IS NOT NULL THEN greatest(0, date_diff('day', DATE '1998-06-15', deadline_date)) END AS days_remaining,
    CASE WHEN deadline_date <= DATE '1998-06-18' THEN 'urgent' WHEN deadline_date <= DATE '1998-06-22' THEN 'warning'
         WHEN deadline_date <= DATE '1998-06-29' THEN 'caution' ELSE 'normal' END AS urgency_level
  FROM listing l LEFT JOIN facility f ON l.facility_id = f.facility_id LEFT JOIN reg r ON f.region_id = r.region_id)"""
