"""Column functions over plans, quotas and visitors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Analyses a day by plan.
DAILY_LIMITS = {"owner": 999_999, "pro": 50, "free": 5}
#: Subscription states in which a paid plan holds.
PAYING = ("active", "trialing", "past_due")

def effective_plan(plan: Column, status: Column) -> Column:
    return F.when(plan == "owner", "owner").when((plan == "pro") & status.isin(*PAYING), "pro").otherwise("free")


def daily_limit(plan: Column) -> Column:
    return F.when(plan == "owner", DAILY_LIMITS["owner"]).when(plan == "pro", DAILY_LIMITS["pro"]).otherwise(DAILY_LIMITS["free"])


def visitor_key(visitor_id: Column, forwarded: Column, address: Column) -> Column:
    """A valid visitor id, else the first forwarded address, else the remote host, else unknown."""
    own = F.trim(visitor_id)
    first = F.trim(F.get(F.split(forwarded, ","), 0))
    host = F.regexp_extract(address, r"^\[?(.+?)\]?:[^:\]]*$", 1)
    return (
        F.when(own.rlike(r"^[A-Za-z0-9_-]{8,128}$"), own)
        .when(F.length(first) > 0, F.concat(F.lit("ip:"), first))
        .when(F.length(host) > 0, F.concat(F.lit("ip:"), host))
        .when(F.length(address) > 0, F.concat(F.lit("ip:"), address))
        .otherwise("anon:unknown")
    )
