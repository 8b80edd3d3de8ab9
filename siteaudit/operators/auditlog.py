"""Reports and changes over users, audits and usage.

Every function that depends on the time takes ``as_of``. Filters on time come first, so
that a table partitioned by day is pruned; top-k reports end in a total order and run as
TakeOrderedAndProject; counts are partially aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.functions.accounts import DAILY_LIMITS, daily_limit, effective_plan


def _day(as_of: Column) -> Column:
    return F.to_date(as_of)


def _since(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def users_today(users: DataFrame, usage: DataFrame, as_of: Column, k: int = 200) -> DataFrame:
    """Newest ``k`` users with plan in effect and today's usage. The k rows are taken before the join: it keeps the left rows."""
    newest = users.orderBy(F.desc("created_at"), "id").limit(k)
    today = usage.where(F.col("usage_date") == _day(as_of)).select(F.col("key"), F.col("count").alias("daily_used"))
    out = newest.join(today, newest["id"] == today["key"], "left").withColumn("daily_used", F.coalesce("daily_used", F.lit(0)))
    out = out.withColumn("plan", effective_plan(F.col("plan"), F.col("subscription_status"))).withColumn("daily_limit", daily_limit(F.col("plan")))
    left = F.greatest(F.lit(0), F.col("daily_limit") - F.col("daily_used"))
    return out.select("id", "email", "plan", "subscription_status", "daily_used", "daily_limit", left.alias("daily_remaining"), "created_at", "suspended_at", F.coalesce("admin_note", F.lit("")).alias("admin_note"))


def usage_summary(usage: DataFrame, as_of: Column, users: DataFrame | None = None) -> DataFrame:
    """Plan, limit, used and remaining of each key today: signed-in users if ``users`` is given, else visitors."""
    today = usage.where(F.col("usage_date") == _day(as_of)).select(F.col("key"), F.col("count").alias("n"))
    if users is None:
        keyed = today.withColumn("plan", F.lit("free"))
    else:
        own = users.select(F.col("id"), effective_plan(F.col("plan"), F.col("subscription_status")).alias("plan"))
        keyed = own.join(today, own["id"] == today["key"], "left").select(F.col("id").alias("key"), "plan", "n")
    used = F.greatest(F.lit(0), F.coalesce("n", F.lit(0)))
    keyed = keyed.select("key", "plan", daily_limit(F.col("plan")).alias("daily_limit"), used.alias("daily_used"))
    return keyed.withColumn("daily_remaining", F.greatest(F.lit(0), F.col("daily_limit") - F.col("daily_used")))


def visitors_today(usage: DataFrame, as_of: Column, k: int = 200) -> DataFrame:
    today = usage.where(F.col("usage_date") == _day(as_of)).orderBy(F.desc("updated_at"), "key").limit(k)
    free = DAILY_LIMITS["free"]
    return today.select("key", F.col("count").alias("daily_used"), F.lit(free).alias("daily_limit"), F.greatest(F.lit(0), F.lit(free) - F.col("count")).alias("daily_remaining"), "updated_at")


def recent_audits(audits: DataFrame, users: DataFrame, k: int = 20) -> DataFrame:
    newest = audits.orderBy(F.desc("created_at"), "id").limit(k).select("id", "user_id", "url", F.coalesce("title", F.lit("")).alias("title"), "created_at")
    own = users.select(F.col("id").alias("owner"), "email")
    return newest.join(own, newest["user_id"] == own["owner"], "left").select("id", "url", "title", F.coalesce("email", F.lit("")).alias("email"), "created_at")


def audits_by_day(audits: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Calendar days up to ``as_of``, days without audits included; soft-deleted audits count."""
    counts = audits.where(F.col("created_at") >= _since(as_of, days)).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    span = audits.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(_day(as_of), days - 1), _day(as_of))).alias("day"))
    return span.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def top_urls(audits: DataFrame, as_of: Column, days: int = 30, k: int = 10) -> DataFrame:
    return audits.where(F.col("created_at") >= _since(as_of, days)).groupBy("url").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "url").limit(k)


def slow_audits(audits: DataFrame, as_of: Column, days: int = 30, k: int = 10) -> DataFrame:
    live = audits.where(F.col("duration_ms").isNotNull() & F.col("deleted_at").isNull() & (F.col("created_at") > _since(as_of, days)))
    return live.orderBy(F.desc("duration_ms"), "id").limit(k).select("id", "url", "duration_ms", "created_at")


def audit_outcomes(audits: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Per day: audits, those with and without performance data (null is without), and the rounded share with."""
    live = audits.where(F.col("deleted_at").isNull() & (F.col("created_at") > _since(as_of, days)))
    ok = F.count_if(F.coalesce("perf_available", F.lit(False)))
    out = live.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("total"), ok.alias("perf_ok"))
    return out.select("day", "total", "perf_ok", (F.col("total") - F.col("perf_ok")).alias("perf_fail"), F.floor(F.col("perf_ok") * 100 / F.col("total") + 0.5).alias("rate"))


def user_history(audits: DataFrame, k: int = 100) -> DataFrame:
    """Newest ``k`` audits that aren't deleted of every user; anonymous audits have no history. Spark's window group limit prunes before the shuffle."""
    live = audits.where("user_id is not null and deleted_at is null")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), "id"))
    return live.withColumn("rank", rank).where(F.col("rank") <= k).select("user_id", "rank", "id", "url", F.coalesce("title", F.lit("")).alias("title"), "created_at")


def business_metrics(users: DataFrame, audits: DataFrame, usage: DataFrame, visitors: DataFrame, as_of: Column) -> DataFrame:
    """One row: users by plan in effect, the paying share with one decimal, audits today and in 14 days, visitors today."""
    plan = effective_plan(F.col("plan"), F.col("subscription_status"))
    people = users.select(plan.alias("plan")).agg(F.count("*").alias("users"), F.count_if(F.col("plan") == "pro").alias("pro"), F.count_if(F.col("plan") == "free").alias("free"))
    rate = F.when(F.col("users") > 0, F.floor(F.col("pro") * 1000 / F.col("users") + 0.5) / 10).otherwise(F.lit(0.0))
    people = people.withColumn("pro_rate", rate)
    recent = audits.where(F.col("created_at") >= _since(as_of, 14)).agg(F.count("*").alias("audits_14d"), F.count_if(F.to_date("created_at") == _day(as_of)).alias("audits_today"))
    spent = usage.where(F.col("usage_date") == _day(as_of)).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("analyses_today"))
    guests = visitors.where(F.col("usage_date") == _day(as_of)).agg(F.count("*").alias("visitors_today"), F.coalesce(F.sum("count"), F.lit(0)).alias("guest_analyses_today"))
    parts = people
    for one in (recent, spent, guests):
        parts = parts.unionByName(one, allowMissingColumns=True)  # of one row each
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def search_users(users: DataFrame, text: str = "", plan: str = "all") -> DataFrame:
    """Users whose e-mail contains ``text`` in any case, and of one plan in effect unless ``plan`` is "all"."""
    out = users.withColumn("plan", effective_plan(F.col("plan"), F.col("subscription_status")))
    out = out.where(F.contains(F.lower("email"), F.lit(text.strip().lower())))
    return out if plan == "all" else out.where(F.col("plan") == plan)


def failure_log(failures: DataFrame, k: int = 50) -> DataFrame:
    return failures.orderBy(F.desc("at"), "id").limit(k)


def failures_since(failures: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return failures.where(F.col("at") > as_of - F.make_dt_interval(F.lit(0), F.lit(hours))).agg(F.count("*").alias("failures"))


def failing_hosts(failures: DataFrame, k: int = 5) -> DataFrame:
    host = F.regexp_replace(F.lower(F.expr("try_parse_url(url, 'HOST')")), r"^www\.", "")
    return failures.groupBy(F.coalesce(host, F.col("url")).alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(k)


def dependency_health(calls: DataFrame) -> DataFrame:
    """``calls(dependency, at, ok, message)``: latest success, latest error and its message, and whether the former is no older."""
    good, bad = F.when(F.col("ok"), F.col("at")), F.when(~F.col("ok"), F.col("at"))
    out = calls.groupBy("dependency").agg(F.max(good).alias("last_success"), F.max(bad).alias("last_error"), F.max_by(F.when(~F.col("ok"), F.col("message")), F.when(~F.col("ok"), F.struct("at", "message"))).alias("error_message"))
    healthy = F.col("last_success").isNotNull() & (F.col("last_error").isNull() | (F.col("last_success") >= F.col("last_error")))
    return out.withColumn("healthy", healthy)


def upsert_usage(usage: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes(key, usage_date, count, updated_at)`` set counts; the latest change of a key and day wins, then the larger count."""
    new = changes.groupBy("key", "usage_date").agg(F.max(F.struct("updated_at", "count")).alias("new"))
    old = usage.select("key", "usage_date", F.struct("updated_at", "count").alias("old"))
    out = old.join(new, ["key", "usage_date"], "full")
    got = F.coalesce("new", "old")
    return out.select("key", "usage_date", got["count"].alias("count"), got["updated_at"].alias("updated_at"))


def admit_requests(requests: DataFrame, limits: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """Whether each of ``requests(id, key, ts)`` is within its key's limit for the day: the first ``limit - used`` are. Keys without a row in ``limits(key, daily_limit)`` are free."""
    day = F.to_date("ts").alias("day")
    rank = F.row_number().over(Window.partitionBy("key", "day").orderBy("ts", "id"))
    ranked = requests.select("id", "key", "ts", day).withColumn("nth", rank)
    out = ranked.join(limits, "key", "left")
    if usage is not None:
        used = usage.select("key", F.col("usage_date").alias("day"), F.col("count").alias("used"))
        out = out.join(used, ["key", "day"], "left")
    else:
        out = out.withColumn("used", F.lit(0))
    room = F.coalesce("daily_limit", F.lit(DAILY_LIMITS["free"])) - F.coalesce("used", F.lit(0))
    return out.select("id", "key", "ts", "day", "nth", (F.col("nth") <= room).alias("admitted"))


def soft_delete(audits: DataFrame, wanted: DataFrame, when: Column) -> DataFrame:
    """``wanted(user_id, id)``: a null id deletes all of a user's audits. Owners only; what is deleted stays as it was."""
    one = wanted.where("id is not null").select("user_id", "id", F.lit(True).alias("one")).distinct()
    every = wanted.where("id is null").select("user_id", F.lit(True).alias("every")).distinct()
    out = audits.join(one, ["user_id", "id"], "left").join(every, "user_id", "left")
    hit = F.coalesce("one", "every", F.lit(False))
    return out.withColumn("deleted_at", F.when(hit, F.coalesce("deleted_at", when)).otherwise(F.col("deleted_at"))).select(*audits.columns)


def patch_users(users: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """``patches(id, plan, suspended, admin_note)``, one a user: only fields that aren't null change.

    A plan sets the status (free: inactive, else active); suspending again keeps the first time; a blank note is none.
    """
    p = patches.select(F.col("id"), F.col("plan").alias("_plan"), F.col("suspended").alias("_suspended"), F.col("admin_note").alias("_note"))
    out = users.join(p, "id", "left")
    status = F.when(F.col("_plan").isNull(), F.col("subscription_status")).when(F.col("_plan") == "free", "inactive").otherwise("active")
    suspended = F.when(F.col("_suspended"), F.coalesce("suspended_at", now)).when(~F.col("_suspended"), F.lit(None)).otherwise(F.col("suspended_at"))
    note = F.when(F.col("_note").isNull(), F.col("admin_note")).otherwise(F.nullif(F.trim("_note"), F.lit("")))
    return out.withColumns({"plan": F.coalesce("_plan", "plan"), "subscription_status": status, "suspended_at": suspended, "admin_note": note}).select(*users.columns)


#: Fields read of an event's JSON.
EVENT = (
    "status string, subscription struct<id:string,customer:struct<id:string>,plan:struct<id:string>,"
    "period:struct<current_period_end:double>,metadata:struct<user_id:string>>"
)


def subscription_changes(events: DataFrame, users: DataFrame, yearly_plan: str = "yearly") -> DataFrame:
    """What each event that counts says of its user: ``event_id, ts, id, customer_id, on, sub_id, interval, period_end, direct``; ``direct`` if it names the user by id."""
    sub = "e.subscription."
    uid = F.expr(f"try_cast({sub}metadata.user_id as bigint)")
    e = events.select("event_id", "ts", F.from_json("payload", EVENT).alias("e")).where("e.status in ('SUBSCRIPTION_ACTIVATED', 'SUBSCRIPTION_UPDATED', 'SUBSCRIPTION_CANCELLED') and e.subscription is not null")
    e = e.select(
        "event_id", "ts", F.when(uid != 0, uid).alias("id"), F.nullif(F.col(sub + "customer.id"), F.lit("")).alias("customer_id"),
        (F.col("e.status") != "SUBSCRIPTION_CANCELLED").alias("on"), F.nullif(F.col(sub + "id"), F.lit("")).alias("sub_id"),
        F.when(F.col(sub + "plan.id") == yearly_plan, "yearly").otherwise("monthly").alias("interval"),
        F.timestamp_seconds(F.floor(sub + "period.current_period_end")).alias("period_end"),
    )
    own = users.select(F.col("id").alias("owner"), F.col("tap_customer_id").alias("customer_id"))
    found = e.where("id is null and customer_id is not null").join(own, "customer_id").withColumn("id", F.col("owner")).select(*e.columns)
    return e.where("id is not null").withColumn("direct", F.lit(True)).unionByName(found.withColumn("direct", F.lit(False)))


def apply_subscription_events(users: DataFrame, events: DataFrame, yearly_plan: str = "yearly") -> DataFrame:
    """``events(event_id, ts, payload)`` as JSON: SUBSCRIPTION_ACTIVATED and _UPDATED make a user pro and active, _CANCELLED free.

    An event names its user by id or else by customer id, each an equi-join; of a user's events the last by (ts, event_id) counts.
    """
    last = F.max_by(F.struct("on", F.when(F.col("direct"), F.col("customer_id")).alias("customer_id"), "sub_id", "interval", "period_end"), F.struct("ts", "event_id")).alias("e")
    latest = subscription_changes(events, users, yearly_plan).groupBy("id").agg(last)
    out = users.join(latest, "id", "left")
    on, any_ = F.coalesce("e.on", F.lit(False)), F.col("e").isNotNull()
    pick = lambda yes, column, no=None: F.when(on, yes).when(any_ & F.lit(no is not None), F.lit(no)).otherwise(F.col(column))
    return out.withColumns(
        {
            "plan": pick(F.lit("pro"), "plan", "free"),
            "subscription_status": pick(F.lit("active"), "subscription_status", "cancelled"),
            "tap_customer_id": pick(F.coalesce("e.customer_id", "tap_customer_id"), "tap_customer_id"),
            "tap_subscription_id": F.when(on, F.col("e.sub_id")).when(any_, F.lit(None)).otherwise(F.col("tap_subscription_id")),
            "subscription_interval": pick(F.col("e.interval"), "subscription_interval"),
            "subscription_current_period_end": pick(F.col("e.period_end"), "subscription_current_period_end"),
        }
    ).select(*users.columns)


def visible_reports(requests: DataFrame, audits: DataFrame) -> DataFrame:
    """``requests(request_id, id, user_id)`` for audits that are shared or the requester's own."""
    live = audits.select("id", F.col("user_id").alias("owner"), "url", "is_shareable")
    return requests.join(live, "id").where(F.coalesce("is_shareable", F.lit(False)) | (F.col("owner") == F.col("user_id"))).select("request_id", "id", "user_id", "url")


def recipients(users: DataFrame) -> DataFrame:
    return users.select(F.trim("email").alias("email")).where("email <> ''").distinct()


def drop_suspended(requests: DataFrame, users: DataFrame) -> DataFrame:
    return requests.join(users.where("suspended_at is not null").select(F.col("id").alias("user_id")), "user_id", "left_anti")
