"""Changes of users, usage and audits as rows for ``sources.registers``, and the tables that come of them.

Each function makes changes with a time and a number from its input; merged in any order, late or repeated, they give what applying them one after another by time gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.operators.auditlog import subscription_changes
from siteaudit.sources.registers import FIRST, LAST, LOG, put

USAGE = {"count": (LAST, "bigint")}
USERS = {
    **{f: (LAST, "string") for f in ("plan", "subscription_status", "admin_note", "tap_customer_id", "tap_subscription_id", "subscription_interval")},
    "subscription_current_period_end": (LAST, "timestamp"), "suspended": (LOG, "boolean"),
}
AUDIT_DELETES = {"deleted_at": (FIRST, "timestamp")}
USER_DELETES = {"cleared": (LOG, "timestamp")}


def usage_changes(changes: DataFrame) -> DataFrame:
    """``changes(key, usage_date, count, updated_at)``: of changes at one time the larger count wins."""
    return changes.select("key", "usage_date", F.col("updated_at").alias("at"), F.lit(0).cast("long").alias("seq"), put(F.col("count").cast("long")).alias("count"))


def current_usage(usage: DataFrame, state: DataFrame | None) -> DataFrame:
    """``usage(key, usage_date, count, updated_at)`` with the changes: a change counts if it isn't older than what stands."""
    if state is None:
        return usage
    new = state.select("key", "usage_date", F.struct(F.col("count.at").alias("updated_at"), F.col("count.value").alias("count")).alias("new"))
    out = usage.select("key", "usage_date", F.struct("updated_at", F.col("count").cast("long").alias("count")).alias("old")).join(new, ["key", "usage_date"], "full")
    got = F.when(F.col("old").isNull() | (F.col("new.updated_at") >= F.col("old.updated_at")), F.col("new")).otherwise(F.col("old"))
    return out.select("key", "usage_date", got["count"].alias("count"), got["updated_at"].alias("updated_at"))


def patch_changes(patches: DataFrame) -> DataFrame:
    """``patches(id, at, patch_id, plan, suspended, admin_note)``: only fields that aren't null change. A plan sets the status (free: inactive, else active); a blank note is none."""
    set_ = lambda c, value: F.when(F.col(c).isNotNull(), put(value))
    return patches.select(
        "id", "at", F.col("patch_id").cast("long").alias("seq"), set_("plan", F.col("plan")).alias("plan"), set_("plan", F.when(F.col("plan") == "free", "inactive").otherwise("active")).alias("subscription_status"),
        set_("suspended", F.col("suspended")).alias("suspended"), set_("admin_note", F.nullif(F.trim("admin_note"), F.lit(""))).alias("admin_note"),
    )


def event_changes(events: DataFrame, users: DataFrame, yearly_plan: str = "yearly") -> DataFrame:
    """``events(event_id, ts, payload)`` of subscriptions. A user is named by id, or by the customer id in ``users(id, tap_customer_id)``."""
    e = subscription_changes(events, users, yearly_plan)
    on = F.col("on")
    when_on = lambda value: F.when(on, put(value))
    return e.select(
        "id", F.col("ts").alias("at"), F.col("event_id").cast("long").alias("seq"), put(F.when(on, "pro").otherwise("free")).alias("plan"), put(F.when(on, "active").otherwise("cancelled")).alias("subscription_status"),
        F.when(on & F.col("direct") & F.col("customer_id").isNotNull(), put(F.col("customer_id"))).alias("tap_customer_id"), put(F.when(on, F.col("sub_id"))).alias("tap_subscription_id"),
        when_on(F.col("interval")).alias("subscription_interval"), when_on(F.col("period_end")).alias("subscription_current_period_end"),
    )


def suspended_at(log: Column, before: Column) -> Column:
    """Suspending again keeps the first time, lifting it clears it: folded over the log in order of time, from what was ``before``."""
    return F.aggregate(F.coalesce(log, F.array().cast("array<struct<at:timestamp,seq:bigint,value:boolean>>")), before.cast("timestamp"), lambda t, x: F.when(x["value"], F.coalesce(t, x["at"])))


def current_users(users: DataFrame, state: DataFrame | None) -> DataFrame:
    """``users`` with the changes of ``state``; users that only changes know aren't made."""
    if state is None:
        return users
    fields = [f for f, (kind, _) in USERS.items() if kind == LAST]
    s = state.select("id", *[F.col(f).alias(f"_{f}") for f in USERS])
    out = users.join(s, "id", "left")
    new = {f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value")).otherwise(F.col(f)) for f in fields}
    return out.withColumns(new | {"suspended_at": suspended_at(F.col("_suspended"), F.col("suspended_at"))}).select(*users.columns)


def audit_delete_changes(wanted: DataFrame) -> DataFrame:
    """``wanted(user_id, id, at)`` with an id: that audit, if it is the user's."""
    one = wanted.where("id is not null and user_id is not null")
    return one.select("id", "user_id", "at", F.lit(0).cast("long").alias("seq"), put(F.col("at")).alias("deleted_at"))


def user_delete_changes(wanted: DataFrame) -> DataFrame:
    """``wanted(user_id, id, at)`` without an id: all of a user's audits of before."""
    every = wanted.where("id is null")
    return every.select("user_id", "at", F.lit(0).cast("long").alias("seq"), put(F.col("at")).alias("cleared"))


def current_audits(audits: DataFrame, one: DataFrame | None, every: DataFrame | None) -> DataFrame:
    """``audits`` with deletions: the first of those of an audit and those of its user since it was made. What was deleted stays as it was; audits that come late are judged as others."""
    out, times = audits, F.array().cast("array<timestamp>")
    if one is not None:
        out = out.join(one.select("id", "user_id", F.col("deleted_at.value").alias("_one")), ["id", "user_id"], "left")
        times = F.concat(times, F.array("_one"))
    if every is not None:
        out = out.join(every.select("user_id", F.col("cleared").alias("_every")), "user_id", "left")
        since = F.transform(F.filter("_every", lambda x: x["value"] >= F.col("created_at")), lambda x: x["value"])
        times = F.concat(times, F.coalesce(since, F.array().cast("array<timestamp>")))
    return out.withColumn("deleted_at", F.coalesce("deleted_at", F.array_min(F.array_compact(times)))).select(*audits.columns)
