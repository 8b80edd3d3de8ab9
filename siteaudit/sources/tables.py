"""The library's tables, mapped from the tables at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days that reports look back from.
AUDITS_AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, email, created_at, plan, subscription_status, suspended_at, admin_note, tap_customer_id`` and subscription columns."""
    key = F.col("c_custkey")
    plan = F.when(F.col("c_mktsegment") == "BUILDING", "owner").when(F.col("c_mktsegment").isin("AUTOMOBILE", "MACHINERY"), "pro").otherwise("free")
    status = F.element_at(F.array(*map(F.lit, ("active", "trialing", "past_due", "cancelled"))), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
        F.timestamp_seconds(F.lit(1_672_531_200) + (key % 365) * 86_400).alias("created_at"),
        plan.alias("plan"),
        status.alias("subscription_status"),
        F.when(F.col("c_acctbal") < 0, at("2024-01-01 00:00:00")).alias("suspended_at"),
        F.lit(None).cast("string").alias("admin_note"),
        F.concat(F.lit("cus_"), key.cast("string")).alias("tap_customer_id"),
        F.lit(None).cast("string").alias("tap_subscription_id"),
        F.lit(None).cast("string").alias("subscription_interval"),
        F.lit(None).cast("timestamp").alias("subscription_current_period_end"),
    )


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, user_id, url, title, created_at, duration_ms, perf_available, deleted_at, is_shareable``."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.when(key % 10 != 0, F.col("o_custkey")).alias("user_id"),
        F.concat(F.lit("https://site"), (key % 97).cast("string"), F.lit(".example.com/")).alias("url"),
        F.when(key % 5 != 0, F.concat(F.lit("Site "), (key % 97).cast("string"))).alias("title"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.floor("o_totalprice").cast("int").alias("duration_ms"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("perf_available"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate").cast("timestamp")).alias("deleted_at"),
        (key % 3 == 0).alias("is_shareable"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, key, user_id, ts`` of requests."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "user_id", F.col("ts").cast("timestamp").alias("ts"))


def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, usage_date, count, updated_at``: a row for each user and day."""
    return requests(spark, sf_dir).groupBy("key", F.to_date("ts").alias("usage_date")).agg(F.count("*").alias("count"), F.max("ts").alias("updated_at"))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, url, at, message`` of failed audits."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    host = F.concat(F.when(F.col("user_id") % 2 == 0, "www.").otherwise(""), F.lit("site"), (F.col("user_id") % 20).cast("string"))
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("https://"), host, F.lit(".example.com/")).alias("url"), F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("error "), (F.col("event_id") % 7).cast("string")).alias("message"))


#: The same tables in SQL.
SQL_USERS = """users AS (SELECT c_custkey AS id, lower(replace(c_name, '#', '.')) || '@example.com' AS email,
  TIMESTAMP '2023-01-01 00:00:00' + INTERVAL 1 DAY * CAST(c_custkey % 365 AS INTEGER) AS created_at,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'owner' WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'pro' ELSE 'free' END AS plan,
  CASE c_nationkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' WHEN 2 THEN 'past_due' ELSE 'cancelled' END AS subscription_status,
  CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS suspended_at, CAST(NULL AS VARCHAR) AS admin_note,
  'cus_' || c_custkey AS tap_customer_id FROM customer),
planned AS (SELECT *, CASE WHEN plan = 'owner' THEN 'owner' WHEN plan = 'pro' AND subscription_status IN ('active', 'trialing', 'past_due') THEN 'pro' ELSE 'free' END AS eff FROM users)"""
SQL_AUDITS = """audits AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS user_id,
  'https://site' || (o_orderkey % 97) || '.example.com/' AS url, CASE WHEN o_orderkey % 5 <> 0 THEN 'Site ' || (o_orderkey % 97) END AS title,
  CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(floor(o_totalprice) AS INTEGER) AS duration_ms,
  CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS perf_available,
  CASE WHEN o_orderpriority = '5-LOW' THEN CAST(o_orderdate AS TIMESTAMP) END AS deleted_at, o_orderkey % 3 = 0 AS is_shareable FROM orders)"""
SQL_REQUESTS = """requests AS (SELECT event_id AS id, user_id AS key, user_id, CAST(ts AS TIMESTAMP) AS ts FROM events)"""
SQL_USAGE = (
    SQL_REQUESTS
    + """, usage AS (SELECT key, CAST(ts AS DATE) AS usage_date, count(*) AS count, max(ts) AS updated_at FROM requests GROUP BY 1, 2)"""
)
SQL_FAILURES = """failures AS (SELECT event_id AS id, 'https://' || CASE WHEN user_id % 2 = 0 THEN 'www.' ELSE '' END || 'site' || (user_id % 20) || '.example.com/' AS url,
  CAST(ts AS TIMESTAMP) AS at, 'error ' || (event_id % 7) AS message FROM events WHERE event_type = 'error')"""
