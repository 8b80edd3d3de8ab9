"""Queries of the audit log's reports and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit.functions.accounts import daily_limit, effective_plan, visitor_key
from siteaudit.functions.addresses import MAPPED, PRIVATE, address_key, is_private_ip, ranges
from siteaudit.operators import auditlog as log
from siteaudit.operators import changes
from siteaudit.sources import tables as t
from siteaudit.sources.audit_sink import append_batch, read_audits
from siteaudit.sources.payloads import export_users_csv
from siteaudit.sources.registers import Registers
from siteaudit.sources.staging import shared_path
from siteaudit.sources.tables import AUDITS_AS_OF, EVENTS_AS_OF, SQL_AUDITS, SQL_FAILURES, SQL_REQUESTS, SQL_USAGE, SQL_USERS, at

from .registry import query

A, E = f"TIMESTAMP '{AUDITS_AS_OF}'", f"TIMESTAMP '{EVENTS_AS_OF}'"
LIMIT = "CASE {0} WHEN 'owner' THEN 999999 WHEN 'pro' THEN 50 ELSE 5 END"


def stamp(name: str, to: str | None = None):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(to or name)


def sql_stamp(name: str, to: str | None = None) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {to or name}"


@query(f"""WITH {SQL_USERS}, {SQL_USAGE}, newest AS (SELECT * FROM planned ORDER BY created_at DESC, id LIMIT 200)
SELECT id, email, eff AS plan, subscription_status, coalesce(count, 0) AS daily_used, CAST({LIMIT.format('eff')} AS BIGINT) AS daily_limit,
  CAST(greatest(0, {LIMIT.format('eff')} - coalesce(count, 0)) AS BIGINT) AS daily_remaining, {sql_stamp('created_at')}, {sql_stamp('suspended_at')}, coalesce(admin_note, '') AS admin_note
FROM newest LEFT JOIN usage ON id = key AND usage_date = CAST({E} AS DATE)""")
def a1_users_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = log.users_today(t.users(spark, sf_dir), t.daily_usage(spark, sf_dir), at(EVENTS_AS_OF))
    return out.select("id", "email", "plan", "subscription_status", "daily_used", F.col("daily_limit").cast("long"), F.col("daily_remaining").cast("long"), stamp("created_at"), stamp("suspended_at"), "admin_note")


@query(f"WITH {SQL_USERS} SELECT id, eff AS plan, CAST({LIMIT.format('eff')} AS BIGINT) AS daily_limit FROM planned")
def a2_effective_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = t.users(spark, sf_dir).select("id", effective_plan(F.col("plan"), F.col("subscription_status")).alias("plan"))
    return out.withColumn("daily_limit", daily_limit(F.col("plan")).cast("long"))


@query(f"""WITH {SQL_USERS}, {SQL_USAGE}, x AS (SELECT id AS key, eff AS plan, {LIMIT.format('eff')} AS lim, coalesce(count, 0) AS n FROM planned LEFT JOIN usage ON id = key AND usage_date = DATE '2024-01-15')
SELECT key, plan, CAST(lim AS BIGINT) AS daily_limit, n AS daily_used, CAST(greatest(0, lim - n) AS BIGINT) AS daily_remaining, 'user' AS kind FROM x
UNION ALL SELECT key, 'free', 5, count, greatest(0, 5 - count), 'visitor' FROM usage WHERE usage_date = DATE '2024-01-15'""")
def a3_usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage, day = t.daily_usage(spark, sf_dir), at("2024-01-15 12:00:00")
    both = [log.usage_summary(usage, day, who).withColumn("kind", F.lit(kind)) for who, kind in ((t.users(spark, sf_dir), "user"), (None, "visitor"))]
    return both[0].unionByName(both[1]).withColumns({c: F.col(c).cast("long") for c in ("daily_limit", "daily_used", "daily_remaining")})


@query(f"""WITH {SQL_USAGE} SELECT key, count AS daily_used, CAST(5 AS BIGINT) AS daily_limit, greatest(0, 5 - count) AS daily_remaining, {sql_stamp('updated_at')}
FROM (SELECT * FROM usage WHERE usage_date = DATE '2024-01-15' ORDER BY updated_at DESC, key LIMIT 200)""")
def a4_visitors_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = log.visitors_today(t.daily_usage(spark, sf_dir), at("2024-01-15 12:00:00"))
    return out.select("key", "daily_used", F.col("daily_limit").cast("long"), F.col("daily_remaining").cast("long"), stamp("updated_at"))


@query("""WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'visitor-' || user_id WHEN 1 THEN 'a b' WHEN 2 THEN '' END AS vid,
  CASE WHEN event_id % 3 = 0 THEN ' 10.0.0.' || (user_id % 250) || ' , 8.8.8.8' WHEN event_id % 3 = 1 THEN '' END AS fwd,
  CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN '[::1]:80' ELSE '192.168.1.' || (user_id % 250) || ':443' END AS addr FROM events)
SELECT event_id, CASE WHEN regexp_matches(trim(vid), '^[A-Za-z0-9_-]{8,128}$') THEN trim(vid) WHEN length(trim(split_part(fwd, ',', 1))) > 0 THEN 'ip:' || trim(split_part(fwd, ',', 1))
  WHEN addr = '' THEN 'anon:unknown' WHEN addr LIKE '[%' THEN 'ip:::1' ELSE 'ip:' || split_part(addr, ':', 1) END AS visitor FROM x""")
def a5_visitor_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, u = F.col("event_id"), F.col("user_id").cast("string")
    vid = F.when(n % 4 == 0, F.concat(F.lit("visitor-"), u)).when(n % 4 == 1, "a b").when(n % 4 == 2, "")
    octet = (F.col("user_id") % 250).cast("string")
    fwd = F.when(n % 3 == 0, F.concat(F.lit(" 10.0.0."), octet, F.lit(" , 8.8.8.8"))).when(n % 3 == 1, "")
    address = F.when(n % 5 == 0, "").when(n % 5 == 1, "[::1]:80").otherwise(F.concat(F.lit("192.168.1."), octet, F.lit(":443")))
    return t.table(spark, sf_dir, "events").select("event_id", visitor_key(vid, fwd, address).alias("visitor"))


@query(f"""WITH {SQL_USERS}, {SQL_AUDITS} SELECT a.id, url, coalesce(title, '') AS title, coalesce(email, '') AS email, {sql_stamp('a.created_at', 'created_at')}
FROM (SELECT * FROM audits ORDER BY created_at DESC, id LIMIT 20) a LEFT JOIN users u ON u.id = a.user_id""")
def a6_recent_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = log.recent_audits(t.audits(spark, sf_dir), t.users(spark, sf_dir))
    return out.select("id", "url", "title", "email", stamp("created_at"))


@query(f"""WITH {SQL_AUDITS}, c AS (SELECT CAST(created_at AS DATE) AS d, count(*) AS n FROM audits WHERE created_at >= {A} - INTERVAL 14 DAY GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(generate_series({A} - INTERVAL 13 DAY, {A}, INTERVAL 1 DAY)) AS DATE) AS day) LEFT JOIN c ON d = day""")
def a7_audits_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.audits_by_day(t.audits(spark, sf_dir), at(AUDITS_AS_OF)).select(F.col("day").cast("string").alias("day"), "n")


@query(f"WITH {SQL_AUDITS} SELECT url, count(*) AS n FROM audits WHERE created_at >= {A} - INTERVAL 30 DAY GROUP BY url ORDER BY n DESC, url LIMIT 10")
def a8_top_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.top_urls(t.audits(spark, sf_dir), at(AUDITS_AS_OF))


@query(f"""WITH {SQL_AUDITS} SELECT id, url, duration_ms, {sql_stamp('created_at')} FROM audits
WHERE duration_ms IS NOT NULL AND deleted_at IS NULL AND created_at > {A} - INTERVAL 30 DAY ORDER BY duration_ms DESC, id LIMIT 10""")
def a9_slow_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.slow_audits(t.audits(spark, sf_dir), at(AUDITS_AS_OF)).select("id", "url", "duration_ms", stamp("created_at"))


@query(f"""WITH {SQL_AUDITS}, x AS (SELECT CAST(created_at AS DATE) AS d, count(*) AS total, count(*) FILTER (WHERE perf_available) AS ok FROM audits
  WHERE deleted_at IS NULL AND created_at > {A} - INTERVAL 14 DAY GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS day, total, ok AS perf_ok, total - ok AS perf_fail, CAST(floor(ok * 100.0 / total + 0.5) AS BIGINT) AS rate FROM x""")
def a10_audit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = log.audit_outcomes(t.audits(spark, sf_dir), at(AUDITS_AS_OF))
    return out.select(F.col("day").cast("string").alias("day"), "total", "perf_ok", "perf_fail", F.col("rate").cast("long").alias("rate"))


@query(f"""WITH {SQL_AUDITS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rank FROM audits WHERE user_id IS NOT NULL AND deleted_at IS NULL)
SELECT user_id, CAST(rank AS INTEGER) AS rank, id, url, coalesce(title, '') AS title, {sql_stamp('created_at')} FROM r WHERE rank <= 5""")
def a11_user_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.user_history(t.audits(spark, sf_dir), k=5).select("user_id", "rank", "id", "url", "title", stamp("created_at"))


@query(f"""WITH {SQL_USERS}, {SQL_AUDITS}, {SQL_USAGE}, p AS (SELECT count(*) AS users, count(*) FILTER (WHERE eff = 'pro') AS pro, count(*) FILTER (WHERE eff = 'free') AS free FROM planned)
SELECT users, pro, free, floor(pro * 1000.0 / users + 0.5) / 10 AS pro_rate, (SELECT count(*) FROM audits WHERE created_at >= {A} - INTERVAL 14 DAY) AS audits_14d,
  (SELECT count(*) FROM audits WHERE CAST(created_at AS DATE) = CAST({A} AS DATE)) AS audits_today, CAST(0 AS BIGINT) AS analyses_today, CAST(0 AS BIGINT) AS visitors_today, CAST(0 AS BIGINT) AS guest_analyses_today FROM p""")
def a12_business_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = t.daily_usage(spark, sf_dir)
    return log.business_metrics(t.users(spark, sf_dir), t.audits(spark, sf_dir), usage, usage, at(AUDITS_AS_OF))


@query(f"WITH {SQL_USERS} SELECT id, email, eff AS plan FROM planned WHERE contains(lower(email), '1@exam') AND eff = 'pro'")
def a13_search_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.search_users(t.users(spark, sf_dir), " 1@EXAM ", "pro").select("id", "email", "plan")


@query(f"WITH {SQL_FAILURES} SELECT id, url, message, {sql_stamp('failures.at', chr(34) + 'at' + chr(34))} FROM failures ORDER BY failures.at DESC, id LIMIT 50")
def a14_failure_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.failure_log(t.failures(spark, sf_dir)).select("id", "url", "message", stamp("at"))


@query(f"""WITH {SQL_FAILURES} SELECT regexp_extract(url, '^https://(www\\.)?([^/]+)', 2) AS host, count(*) AS n FROM failures GROUP BY 1 ORDER BY n DESC, host LIMIT 5""")
def a14_failing_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.failing_hosts(t.failures(spark, sf_dir))


@query(f"WITH {SQL_FAILURES} SELECT count(*) AS failures FROM failures WHERE failures.at > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR")
def a14_failures_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.failures_since(t.failures(spark, sf_dir), at("2024-01-20 00:00:00"))


@query(f"""WITH c AS (SELECT 'dep' || (user_id % 50) AS dependency, CAST(ts AS TIMESTAMP) AS ts, event_type <> 'error' AS ok, 'm' || event_id AS message FROM events),
g AS (SELECT dependency, max(ts) FILTER (WHERE ok) AS s, max(ts) FILTER (WHERE NOT ok) AS e FROM c GROUP BY 1),
m AS (SELECT c.dependency, max(message) AS error_message FROM c JOIN g ON c.dependency = g.dependency AND c.ts = g.e AND NOT c.ok GROUP BY 1)
SELECT g.dependency, {sql_stamp('s', 'last_success')}, {sql_stamp('e', 'last_error')}, error_message, s IS NOT NULL AND (e IS NULL OR s >= e) AS healthy FROM g LEFT JOIN m ON g.dependency = m.dependency""")
def a15_dependency_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.table(spark, sf_dir, "events")
    calls = e.select(F.concat(F.lit("dep"), (F.col("user_id") % 50).cast("string")).alias("dependency"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "error").alias("ok"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message"))
    return log.dependency_health(calls).select("dependency", stamp("last_success"), stamp("last_error"), "error_message", "healthy")


@query(f"""WITH {SQL_USAGE}, ch AS (SELECT user_id AS key, CAST(ts AS DATE) AS usage_date, event_id % 9 AS count, CAST(ts AS TIMESTAMP) + INTERVAL 40 DAY AS updated_at FROM events WHERE event_id % 3 = 0),
l AS (SELECT *, row_number() OVER (PARTITION BY key, usage_date ORDER BY updated_at DESC, count DESC) AS rn FROM ch)
SELECT coalesce(u.key, l.key) AS key, strftime(coalesce(u.usage_date, l.usage_date), '%Y-%m-%d') AS usage_date, coalesce(l.count, u.count) AS count
FROM usage u FULL JOIN (SELECT * FROM l WHERE rn = 1) l ON u.key = l.key AND u.usage_date = l.usage_date""")
def a16_upsert_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = t.requests(spark, sf_dir).where(F.col("id") % 3 == 0)
    changes = r.select("key", F.to_date("ts").alias("usage_date"), (F.col("id") % 9).alias("count"), (F.col("ts") + F.expr("interval 40 days")).alias("updated_at"))
    return log.upsert_usage(t.daily_usage(spark, sf_dir), changes).select("key", F.col("usage_date").cast("string").alias("usage_date"), "count")


@query(f"""WITH {SQL_USERS}, {SQL_REQUESTS}, r AS (SELECT id, key, CAST(ts AS DATE) AS d, row_number() OVER (PARTITION BY key, CAST(ts AS DATE) ORDER BY ts, id) AS nth FROM requests)
SELECT r.id, r.key, strftime(d, '%Y-%m-%d') AS day, CAST(nth AS INTEGER) AS nth, nth <= coalesce({LIMIT.format('eff')}, 5) - r.key % 5 AS admitted FROM r LEFT JOIN planned p ON p.id = r.key""")
def a17_admit_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = t.users(spark, sf_dir).select(F.col("id").alias("key"), daily_limit(effective_plan(F.col("plan"), F.col("subscription_status"))).alias("daily_limit"))
    r = t.requests(spark, sf_dir)
    used = r.select("key", F.to_date("ts").alias("usage_date"), (F.col("key") % 5).alias("count")).distinct()
    return log.admit_requests(r, limits, used).select("id", "key", F.col("day").cast("string").alias("day"), "nth", "admitted")


@query(f"""WITH {SQL_AUDITS} SELECT id, user_id, CASE WHEN deleted_at IS NOT NULL THEN strftime(deleted_at, '%Y-%m-%d %H:%M:%S') WHEN user_id % 7 = 0 OR (id % 11 = 0 AND user_id IS NOT NULL) THEN '{AUDITS_AS_OF}' END AS deleted_at FROM audits""")
def a18_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits = t.audits(spark, sf_dir)
    every = audits.where("user_id % 7 = 0").select("user_id", F.lit(None).cast("long").alias("id")).distinct()
    one = audits.where("id % 11 = 0").select("user_id", "id")
    return log.soft_delete(audits, every.unionByName(one), at(AUDITS_AS_OF)).select("id", "user_id", stamp("deleted_at"))


@query(f"""WITH {SQL_USERS} SELECT id, CASE id % 6 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE plan END AS plan,
  CASE id % 6 WHEN 0 THEN 'inactive' WHEN 1 THEN 'active' ELSE subscription_status END AS subscription_status,
  CASE WHEN id % 5 = 0 THEN strftime(coalesce(suspended_at, {E}), '%Y-%m-%d %H:%M:%S') WHEN id % 5 = 1 THEN NULL ELSE strftime(suspended_at, '%Y-%m-%d %H:%M:%S') END AS suspended_at,
  CASE WHEN id % 4 = 0 THEN 'note ' || id END AS admin_note FROM users""")
def a19_patch_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, n = t.users(spark, sf_dir), F.col("id")
    patches = users.where((n % 6 < 2) | (n % 5 < 2) | (n % 4 < 2)).select(
        "id", F.when(n % 6 == 0, "free").when(n % 6 == 1, "pro").alias("plan"), F.when(n % 5 == 0, True).when(n % 5 == 1, False).alias("suspended"),
        F.when(n % 4 == 0, F.concat(F.lit(" note "), n.cast("string"), F.lit(" "))).when(n % 4 == 1, "  ").alias("admin_note"),
    )
    return log.patch_users(users, patches, at(EVENTS_AS_OF)).select("id", "plan", "subscription_status", stamp("suspended_at"), "admin_note")


@query(f"""WITH {SQL_USERS}, e AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, 1 + user_id % 100 AS uid, event_id % 3 AS kind, event_id % 2 AS yearly FROM events WHERE event_type IN ('signup', 'purchase')),
l AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts DESC, event_id DESC) AS rn FROM e)
SELECT id, CASE WHEN kind = 2 THEN 'free' WHEN kind IS NOT NULL THEN 'pro' ELSE plan END AS plan, CASE WHEN kind = 2 THEN 'cancelled' WHEN kind IS NOT NULL THEN 'active' ELSE subscription_status END AS subscription_status,
  CASE WHEN kind < 2 THEN CASE WHEN yearly = 1 THEN 'yearly' ELSE 'monthly' END END AS subscription_interval, CASE WHEN kind < 2 THEN 'sub_' || event_id END AS tap_subscription_id
FROM users LEFT JOIN (SELECT * FROM l WHERE rn = 1) l ON id = uid""")
def a20_subscription_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, n = t.users(spark, sf_dir), F.col("event_id")
    e = t.table(spark, sf_dir, "events").where("event_type in ('signup', 'purchase')")
    uid = (1 + F.col("user_id") % 100).cast("string")
    by_id = (n % 4) < 2
    payload = F.to_json(F.struct(
        F.when(n % 3 == 0, "SUBSCRIPTION_ACTIVATED").when(n % 3 == 1, "SUBSCRIPTION_UPDATED").otherwise("SUBSCRIPTION_CANCELLED").alias("status"),
        F.struct(F.concat(F.lit("sub_"), n.cast("string")).alias("id"), F.struct(F.concat(F.lit("cus_"), uid).alias("id")).alias("customer"), F.struct(F.when(n % 2 == 1, "yearly").otherwise("monthly").alias("id")).alias("plan"), F.struct(F.when(by_id, uid).alias("user_id")).alias("metadata")).alias("subscription"),
    ))
    out = log.apply_subscription_events(users, e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), payload.alias("payload")))
    return out.select("id", "plan", "subscription_status", "subscription_interval", "tap_subscription_id")


_CHANGES = """ch AS (SELECT event_id, user_id AS key, CAST(ts AS DATE) AS usage_date, event_id % 9 AS count, CAST(ts AS TIMESTAMP) + INTERVAL 1 HOUR * CAST(event_id % 50 - 25 AS INTEGER) AS moment FROM events)"""


def changed(spark: SparkSession, name: str, key: list[str], fields: dict, lots: list[DataFrame], buckets: int = 8) -> DataFrame | None:
    """The changes merged as they come, the first ones once more at the end."""
    table = Registers(spark, shared_path(spark, name), key, fields, buckets)
    for part in [*lots, lots[0]]:
        table.merge(part)
    return table.read()


@query(f"""WITH {SQL_USAGE}, {_CHANGES}, l AS (SELECT *, row_number() OVER (PARTITION BY key, usage_date ORDER BY moment DESC, count DESC) AS rn FROM ch)
SELECT u.key, strftime(u.usage_date, '%Y-%m-%d') AS usage_date, CASE WHEN l.moment >= u.updated_at THEN l.count ELSE u.count END AS count
FROM usage u JOIN (SELECT * FROM l WHERE rn = 1) l ON u.key = l.key AND u.usage_date = l.usage_date""")
def a16_merge_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes in three lots, neither sorted nor apart, into buckets by key."""
    e = t.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), F.to_date("ts").alias("usage_date"), (F.col("event_id") % 9).alias("count"), (F.col("ts").cast("timestamp") + F.make_dt_interval(hours=(F.col("event_id") % 50 - 25).cast("int"))).alias("updated_at"))
    lots = [changes.usage_changes(e.where(F.col("event_id") % 3 <= k)) for k in (1, 0, 2)]
    out = changes.current_usage(t.daily_usage(spark, sf_dir), changed(spark, "usage", ["key", "usage_date"], changes.USAGE, lots))
    return out.select("key", F.col("usage_date").cast("string").alias("usage_date"), "count")


@query(f"""WITH {SQL_AUDITS}, w AS (SELECT 1 + event_id * 13 % 60000 AS id, user_id, CAST(ts AS TIMESTAMP) - INTERVAL 9000 DAY AS moment, event_id % 20 = 0 AS everything FROM events),
one AS (SELECT id, user_id, min(moment) AS moment FROM w WHERE NOT everything GROUP BY 1, 2),
every AS (SELECT a.id, min(w.moment) AS moment FROM audits a JOIN w ON a.user_id = w.user_id AND everything AND w.moment >= a.created_at GROUP BY 1)
SELECT a.id, {sql_stamp("coalesce(deleted_at, least(coalesce(one.moment, every.moment), coalesce(every.moment, one.moment)))", "deleted_at")} FROM audits a LEFT JOIN one ON one.id = a.id AND one.user_id = a.user_id LEFT JOIN every ON every.id = a.id""")
def a18_merge_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions of audits and of all that a user has, in lots, the later ones first."""
    w = t.table(spark, sf_dir, "events").select((1 + F.col("event_id") * 13 % 60000).alias("id"), "user_id", (F.col("ts").cast("timestamp") - F.expr("interval 9000 days")).alias("at"), (F.col("event_id") % 20 == 0).alias("everything"))
    w = w.withColumn("id", F.when(~F.col("everything"), F.col("id")))
    lots = [w.where(F.pmod(F.xxhash64("at"), F.lit(2)) == k) for k in (1, 0)]
    one = changed(spark, "audit-deletes", ["id", "user_id"], changes.AUDIT_DELETES, [changes.audit_delete_changes(x) for x in lots])
    every = changed(spark, "user-deletes", ["user_id"], changes.USER_DELETES, [changes.user_delete_changes(x) for x in lots])
    return changes.current_audits(t.audits(spark, sf_dir), one, every).select("id", stamp("deleted_at"))


@query(f"""WITH {SQL_USERS}, e AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS moment, 1 + user_id % 100 AS uid, event_id % 3 AS kind, event_id % 2 AS yearly FROM events WHERE event_type IN ('signup', 'purchase')),
p AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS moment, 1 + user_id % 120 AS uid, event_id % 7 AS kind FROM events WHERE event_type IN ('click', 'error')),
plans AS (SELECT uid, moment, event_id, CASE WHEN kind = 2 THEN 'free' ELSE 'pro' END AS plan, CASE WHEN kind = 2 THEN 'cancelled' ELSE 'active' END AS status FROM e
  UNION ALL SELECT uid, moment, event_id, CASE kind WHEN 0 THEN 'free' ELSE 'pro' END, CASE kind WHEN 0 THEN 'inactive' ELSE 'active' END FROM p WHERE kind < 2),
l AS (SELECT uid, arg_max((plan, status), (moment, event_id)) AS x FROM plans GROUP BY 1), s AS (SELECT uid, arg_max(CASE WHEN kind < 2 THEN 'sub_' || event_id ELSE '' END, (moment, event_id)) AS sub FROM e GROUP BY 1),
i AS (SELECT uid, arg_max(CASE WHEN yearly = 1 THEN 'yearly' ELSE 'monthly' END, (moment, event_id)) AS x FROM e WHERE kind < 2 GROUP BY 1), n AS (SELECT uid, arg_max(CASE WHEN kind = 6 THEN '' ELSE 'note ' || event_id END, (moment, event_id)) AS note FROM p WHERE kind IN (5, 6) GROUP BY 1),
lifted AS (SELECT uid, max((moment, event_id)) AS moment FROM p WHERE kind = 3 GROUP BY 1),
held AS (SELECT p.uid, min(p.moment) AS moment FROM p LEFT JOIN lifted ON lifted.uid = p.uid WHERE kind IN (2, 4) AND (lifted.moment IS NULL OR (p.moment, p.event_id) > lifted.moment) GROUP BY 1)
SELECT id, coalesce(l.x[1], users.plan) AS plan, coalesce(l.x[2], subscription_status) AS subscription_status, coalesce(sub, '') AS tap_subscription_id, coalesce(i.x, '') AS subscription_interval, coalesce(note, '') AS admin_note,
  {sql_stamp("CASE WHEN lifted.moment IS NULL THEN coalesce(suspended_at, held.moment) ELSE held.moment END", "suspended_at")}
FROM users LEFT JOIN (SELECT uid, [struct_extract(x, 1), struct_extract(x, 2)] AS x FROM l) l ON l.uid = id LEFT JOIN s ON s.uid = id LEFT JOIN i ON i.uid = id LEFT JOIN n ON n.uid = id LEFT JOIN lifted ON lifted.uid = id LEFT JOIN held ON held.uid = id""")
def a19_a20_merge_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches and subscription events in one table of changes, lots of both by turns and out of order."""
    users, n, uid = t.users(spark, sf_dir), F.col("event_id"), (1 + F.col("user_id") % 100).cast("string")
    e = t.table(spark, sf_dir, "events").where("event_type in ('signup', 'purchase')")
    payload = F.to_json(F.struct(
        F.when(n % 3 == 0, "SUBSCRIPTION_ACTIVATED").when(n % 3 == 1, "SUBSCRIPTION_UPDATED").otherwise("SUBSCRIPTION_CANCELLED").alias("status"),
        F.struct(F.concat(F.lit("sub_"), n.cast("string")).alias("id"), F.struct(F.concat(F.lit("cus_"), uid).alias("id")).alias("customer"), F.struct(F.when(n % 2 == 1, "yearly").otherwise("monthly").alias("id")).alias("plan"), F.struct(F.when(n % 4 < 2, uid).alias("user_id")).alias("metadata")).alias("subscription"),
    ))
    e = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), payload.alias("payload"))
    kind = n % 7
    p = t.table(spark, sf_dir, "events").where("event_type in ('click', 'error')").select(
        (1 + F.col("user_id") % 120).alias("id"), F.col("ts").cast("timestamp").alias("at"), n.alias("patch_id"), F.when(kind == 0, "free").when(kind == 1, "pro").alias("plan"), F.when(kind.isin(2, 4), True).when(kind == 3, False).alias("suspended"),
        F.when(kind == 5, F.concat(F.lit(" note "), n.cast("string"))).when(kind == 6, "  ").alias("admin_note"),
    )
    lots = [changes.event_changes(e.where(n % 2 == 1), users), changes.patch_changes(p.where("patch_id % 3 = 0")), changes.event_changes(e.where(n % 2 == 0), users), changes.patch_changes(p)]
    out = changes.current_users(users, changed(spark, "users", ["id"], changes.USERS, lots))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("id", "plan", "subscription_status", text("tap_subscription_id"), text("subscription_interval"), text("admin_note"), stamp("suspended_at"))


@query(f"""WITH {SQL_AUDITS}, b AS (SELECT id, 0 AS batch, url, created_at FROM audits WHERE id % 2 = 0 UNION ALL SELECT id, 1, url || '1', created_at FROM audits WHERE id % 3 = 0 UNION ALL SELECT id, 2, url || '2', created_at + INTERVAL 1 DAY FROM audits WHERE id % 5 = 0)
SELECT id, arg_min(url, batch) AS url, strftime(date_trunc('month', arg_min(created_at, batch)), '%Y-%m-%d') AS day FROM b GROUP BY id""")
def s5_audit_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches that overlap, the first two of them run again."""
    audits, path = t.audits(spark, sf_dir), shared_path(spark, "audits")
    batches = [audits.where("id % 2 = 0"), audits.where("id % 3 = 0").withColumn("url", F.concat("url", F.lit("1"))), audits.where("id % 5 = 0").withColumns({"url": F.concat("url", F.lit("2")), "created_at": F.col("created_at") + F.expr("interval 1 day")})]
    for number in (0, 1, 2, 1, 0):
        append_batch(batches[number], path, number, parts=8, period="month")
    return read_audits(spark, path).select("id", "url", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query(f"""WITH {SQL_AUDITS}, q AS (SELECT event_id AS request_id, 1 + event_id * 7 % 60000 AS id, user_id FROM events)
SELECT request_id, q.id, q.user_id, url FROM q JOIN audits a ON a.id = q.id WHERE is_shareable OR a.user_id = q.user_id""")
def a21_visible_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = t.table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), (1 + F.col("event_id") * 7 % 60000).alias("id"), "user_id")
    return log.visible_reports(wanted, t.audits(spark, sf_dir))


@query(f"WITH {SQL_USERS} SELECT DISTINCT email FROM (SELECT trim(CASE WHEN id % 10 = 0 THEN ' ' ELSE email END) AS email FROM users) WHERE email <> ''")
def a22_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.recipients(t.users(spark, sf_dir).withColumn("email", F.when(F.col("id") % 10 == 0, " ").otherwise(F.col("email"))))


@query(f"WITH {SQL_USERS}, {SQL_REQUESTS} SELECT id, user_id FROM requests WHERE user_id NOT IN (SELECT id FROM users WHERE suspended_at IS NOT NULL)")
def a23_drop_suspended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.drop_suspended(t.requests(spark, sf_dir), t.users(spark, sf_dir)).select("id", "user_id")


#: Addresses of all forms, and what only looks like one.
_ADDRESSES = (
    "'10.' || (event_id % 256) || '.0.1'", "'172.' || (event_id % 64) || '.9.9'", "'192.168.' || (event_id % 300) || '.1'", "(event_id % 256) || '.64.0.' || (user_id % 256)", "'fe80::' || (event_id % 10)",
    "'2001:db8::' || (event_id % 9)", "'host'", "CAST(NULL AS STRING)", "'0::' || (event_id % 3)", "'::000' || (event_id % 3)", "'::ffff:7f00:' || (event_id % 20)", "'::ffff:a' || (event_id % 10) || '0:1'",
    "' FE80::1%eth' || (event_id % 4)", "'::FFFF:10.0.0.' || (event_id % 300)", "'1:2:3:4:5:6:' || (event_id % 9) || '::'", "'2001:db8:::' || (event_id % 9)", "'0:0:0:00:0:0:0:' || (event_id % 3)", "'fd' || (event_id % 90 + 10) || '::1:2'",
    "'ff02::fb:' || (event_id % 12345)", "'::'", "'1::2::' || (event_id % 9)", "'1:2:3:4:5:6:7:8:' || (event_id % 9)", "'fec0::' || (event_id % 9)", "'0:0:0:0:0:ffff:192.168.1.' || (event_id % 256)", "'::10.0.0.' || (event_id % 9)", "'febf:ffff::%z'", "'012.1.1.' || (event_id % 9)",
)
_ADDRESS = f"CASE event_id % {len(_ADDRESSES)} " + " ".join(f"WHEN {k} THEN {a}" for k, a in enumerate(_ADDRESSES)) + " END"
_QUAD = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NETWORKS = " OR ".join(f"k BETWEEN '{a}' AND '{b}'" for a, b in ranges(PRIVATE))


@query(f"""WITH x AS (SELECT event_id, regexp_replace(lower(trim({_ADDRESS.replace("STRING", "VARCHAR")})), '%.*$', '') AS s FROM events),
d AS (SELECT *, regexp_extract(s, '[^:]*$') AS tail FROM x),
q AS (SELECT *, CASE WHEN regexp_full_match(tail, '{_QUAD}[.]{_QUAD}[.]{_QUAD}[.]{_QUAD}') THEN list_reduce(list_transform(string_split(tail, '.'), lambda p: CAST(p AS BIGINT)), lambda a, b: a * 256 + b) END AS n FROM d),
g AS (SELECT event_id, s, n, CASE WHEN s NOT LIKE '%.%' THEN s WHEN n IS NOT NULL THEN regexp_replace(s, '[^:]*$', '') || printf('%x:%x', n // 65536, n % 65536) END AS t FROM q),
h AS (SELECT event_id, s, n, string_split(t, '::') AS sides, list_filter(string_split_regex(t, ':+'), lambda p: p <> '') AS parts, list_filter(string_split(list_extract(string_split(t, '::'), 1), ':'), lambda p: p <> '') AS lefts, t FROM g),
k AS (SELECT event_id, CASE WHEN s NOT LIKE '%:%' THEN '{MAPPED}' || printf('%08x', n)
  WHEN NOT regexp_matches(t, ':::|^:[^:]|[^:]:$|[^0-9a-f:]|[0-9a-f]{{5}}') AND (len(sides) = 1 AND len(parts) = 8 OR len(sides) = 2 AND len(parts) <= 7)
  THEN array_to_string(list_transform(parts[:len(lefts)] || list_transform(range(8 - len(parts)), lambda i: '0') || parts[len(lefts) + 1:], lambda p: lpad(p, 4, '0')), '') END AS k FROM h)
SELECT event_id, coalesce(k, '') AS address, coalesce({_NETWORKS}, FALSE) AS private FROM k""")
def s3_private_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.table(spark, sf_dir, "events").select("event_id", F.expr(_ADDRESS).alias("ip"))
    return e.select("event_id", F.coalesce(address_key(F.col("ip")), F.lit("")).alias("address"), is_private_ip(F.col("ip")).alias("private"))


@query(f"""WITH {SQL_USERS} SELECT id, email, {sql_stamp('created_at')}, plan, subscription_status, coalesce({sql_stamp('suspended_at').rpartition(' AS ')[0]}, '') AS suspended_at FROM users""")
def s6_export_users_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV and read back as text."""
    path = shared_path(spark, "users-csv")
    export_users_csv(t.users(spark, sf_dir).select("id", "email", "created_at", "plan", "subscription_status", "suspended_at"), path)
    schema = "id long, email string, created_at string, plan string, subscription_status string, suspended_at string"
    return spark.read.schema(schema).csv(path, header=True, escape='"').withColumn("suspended_at", F.coalesce("suspended_at", F.lit("")))
