"""Queries that run the streaming jobs over ``events`` to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit.functions.accounts import daily_limit, effective_plan
from siteaudit.sources import tables as t
from siteaudit.sources.staging import shared_path
from siteaudit.sources.tables import SQL_FAILURES, SQL_USERS
from siteaudit.streaming import jobs

from .registry import query


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def requests(e: DataFrame) -> DataFrame:
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts")


def _windows(source: str) -> str:
    """Requests of each key in order, each with the start of its window and its number in it."""
    return f"""o AS (SELECT event_id AS id, user_id AS key, epoch(CAST(ts AS TIMESTAMP)) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM {source}),
w AS (SELECT id, key, s, i, s AS start, 1 AS n FROM o WHERE i = 1
  UNION ALL SELECT o.id, o.key, o.s, o.i, CASE WHEN o.s > w.start + 60 THEN o.s ELSE w.start END, CASE WHEN o.s > w.start + 60 THEN 1 ELSE w.n + 1 END FROM w JOIN o ON o.key = w.key AND o.i = w.i + 1)"""


_ADMITTED = f"WITH RECURSIVE {_windows('events')} SELECT id, key, n <= 2 AS admitted FROM w"


#: How much later than its time a request may come, in seconds.
DELAY_S = 2 * 86_400


def scattered(requests_: DataFrame, lots: int = 3) -> str:
    """``requests_(id, key, ts, ...)`` as files written one after another, each request up to ``DELAY_S`` later than its time, so that files overlap and rows within them have no order. The last file holds one row without an id, long after all others."""
    spark = requests_.sparkSession
    path, all_of = shared_path(spark, "arrivals"), shared_path(spark, "lots")
    late = F.pmod(F.xxhash64("id"), F.lit(DELAY_S)).cast("double")
    arrival = F.col("ts").cast("double") + late
    first, last = requests_.agg(F.min(F.col("ts").cast("double")), F.max(F.col("ts").cast("double") + DELAY_S)).first()
    lot = F.least(F.lit(lots - 1), F.floor((arrival - F.lit(first)) / F.lit(max(1.0, (last - first) / lots)))).cast("int")
    requests_.withColumn("lot", lot).write.partitionBy("lot").parquet(all_of)
    held = spark.read.schema(requests_.schema.add("lot", "integer")).parquet(all_of)
    for k in range(lots):
        held.where(F.col("lot") == k).drop("lot").orderBy(F.xxhash64("id", "ts")).coalesce(1).write.mode("append").parquet(path)
    end = F.timestamp_seconds(F.lit(last) + 10 * DELAY_S)
    spark.range(1).select(F.lit(None).cast("long").alias("id"), F.lit(-1).cast("long").alias("key"), end.alias("ts"), *[F.lit(None).cast(kind).alias(c) for c, kind in requests_.dtypes[3:]]).coalesce(1).write.mode("append").parquet(path)
    return path


@query(_ADMITTED)
def r1_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over many files out of order, one a batch."""
    e = t.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    arrivals = jobs.stream(spark, scattered(requests(e)) + "/", files=1).withWatermark("ts", f"{DELAY_S} seconds")
    return jobs.drain(jobs.rate_limit(arrivals, limit=2, slice_s=3_600)).select("id", "key", "admitted")


@query(_ADMITTED)
def r1_rate_limit_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.rate_limit_batch(requests(e), limit=2).select("id", "key", "admitted")


@query(f"""WITH RECURSIVE {SQL_USERS}, live AS (SELECT * FROM events WHERE user_id NOT IN (SELECT id FROM users WHERE suspended_at IS NOT NULL)), {_windows("live")},
r AS (SELECT id, key, n <= 2 AS in_rate, row_number() OVER (PARTITION BY key, CAST(floor(s / 86400) AS BIGINT), n <= 2 ORDER BY s, id) AS nth FROM w)
SELECT r.id, r.key, in_rate, in_rate AND nth <= CASE eff WHEN 'owner' THEN 999999 WHEN 'pro' THEN 50 ELSE 5 END - r.key % 4 AS admitted FROM r LEFT JOIN planned p ON p.id = r.key""")
def r1_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspended users, rate limit and daily quota as one stream, over many files out of order."""
    users = t.users(spark, sf_dir)
    limits = users.select(F.col("id").alias("key"), daily_limit(effective_plan(F.col("plan"), F.col("subscription_status"))).alias("daily_limit"))
    e = t.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    usage = e.select(F.col("user_id").alias("key"), F.to_date("ts").alias("usage_date"), (F.col("user_id") % 4).alias("count")).distinct()
    arrivals = jobs.stream(spark, scattered(requests(e)) + "/", files=1).withWatermark("ts", f"{DELAY_S} seconds")
    return jobs.drain(jobs.admission(arrivals, users, limits, usage, limit=2, slice_s=3_600)).select("id", "key", "in_rate", "admitted")


@query("""SELECT user_id AS key, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n, least(count(*), 3) AS admitted FROM events GROUP BY 1, 2""")
def r2_daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts")
    out = jobs.drain(jobs.daily_quota(r, F.lit(3), "60 days"), ["key", "day"])
    return out.select("key", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "admitted")


@query("SELECT DISTINCT user_id % 400 AS id FROM events")
def r3_dedupe_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = events(spark, sf_dir).select((F.col("user_id") % 400).alias("id"), "ts")
    return jobs.drain(jobs.dedupe_reports(r, "60 days")).select("id")


_REPORTS = """WITH RECURSIVE o AS (SELECT event_id AS id, user_id % 400 AS key, epoch_us(CAST(ts AS TIMESTAMP)) AS s, event_id % 3 = 0 AS save, row_number() OVER (PARTITION BY user_id % 400 ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT id, key, s, save, i, CASE WHEN save THEN s END AS at_, FALSE AS there FROM o WHERE i = 1
  UNION ALL SELECT o.id, o.key, o.s, o.save, o.i, CASE WHEN o.save AND (w.at_ IS NULL OR o.s > w.at_ + 172800000000) THEN o.s ELSE w.at_ END, coalesce(o.s <= w.at_ + 172800000000, FALSE) FROM w JOIN o ON o.key = w.key AND o.i = w.i + 1)
SELECT id, key, s AS us, CASE WHEN save AND there THEN 'duplicate' WHEN save THEN 'saved' WHEN there THEN 'found' ELSE 'missing' END AS what FROM w
UNION ALL SELECT DISTINCT -1, key, at_ + 172800000000, 'evicted' FROM w WHERE at_ IS NOT NULL"""


def report_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 400).alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3 == 0).cast("int").alias("kind"))


def answers(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce("id", F.lit(-1)).alias("id"), "key", F.unix_micros("ts").alias("us"), "what")


@query(_REPORTS)
def r3_report_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over files out of order: reports are there for 48 hours, and go."""
    arrivals = jobs.stream(spark, scattered(report_requests(spark, sf_dir)) + "/", files=1).withWatermark("ts", f"{DELAY_S} seconds")
    return answers(jobs.drain(jobs.report_store(arrivals, slice_s=6 * 3_600)))


@query(_REPORTS)
def r3_report_store_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(jobs.report_store_batch(report_requests(spark, sf_dir)))


@query("""SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS perf_ok, count(*) FILTER (WHERE event_type = 'error') AS perf_fail FROM events GROUP BY 1""")
def r4_running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = events(spark, sf_dir).select("ts", (F.col("event_type") != "error").alias("perf_available"))
    out = jobs.drain(jobs.running_counts(a, "60 days"), ["day"])
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "total", "perf_ok", "perf_fail")


@query(f"""WITH {SQL_FAILURES}, h AS (SELECT regexp_extract(url, '^https://(www\\.)?([^/]+)', 2) AS host, date_trunc('hour', failures.at) AS hr FROM failures),
w AS (SELECT host, hr + INTERVAL 1 HOUR * CAST(k AS INTEGER) AS until FROM h, (SELECT unnest(generate_series(1, 24)) AS k)) SELECT host, strftime(until, '%Y-%m-%d %H:%M:%S') AS until, count(*) AS n FROM w GROUP BY 1, 2""")
def r5_failures_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'error'")
    host = F.concat(F.when(F.col("user_id") % 2 == 0, "www.").otherwise(""), F.lit("site"), (F.col("user_id") % 20).cast("string"))
    f = e.select("ts", F.concat(F.lit("https://"), host, F.lit(".example.com/")).alias("url"))
    out = jobs.drain(jobs.failures_24h(f, "60 days"), ["host", "until"])
    return out.select("host", F.date_format("until", "yyyy-MM-dd HH:mm:ss").alias("until"), "n")
