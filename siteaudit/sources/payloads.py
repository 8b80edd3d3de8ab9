"""JSON payloads: performance reports, domain records, and audits themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siteaudit.operators.tech import vital_rating

_SPEED = (
    "lighthouseResult struct<categories:map<string,struct<score:double>>,audits:map<string,struct<numericValue:double,displayValue:string,details:struct<items:array<struct<entity:string,transferSize:double>>>>>>, "
    "loadingExperience struct<initial_url:string,metrics:map<string,struct<percentile:double,category:string>>>"
)
#: Names of metrics in the payload.
LAB = {"fcp": "first-contentful-paint", "lcp": "largest-contentful-paint", "tbt": "total-blocking-time", "cls": "cumulative-layout-shift", "si": "speed-index"}
FIELD = {"lcp": "LARGEST_CONTENTFUL_PAINT_MS", "cls": "CUMULATIVE_LAYOUT_SHIFT_SCORE", "inp": "INTERACTION_TO_NEXT_PAINT", "fcp": "FIRST_CONTENTFUL_PAINT_MS"}


def parse_pagespeed(df: DataFrame, json_col: str) -> DataFrame:
    """``speed``: four category scores (0 to 100; 0 if missing), lab metrics and field metrics with ratings, and third parties; null for what isn't JSON."""
    df = df.withColumn("_p", F.from_json(json_col, _SPEED))
    score = lambda k: F.coalesce(F.floor(F.element_at("_p.lighthouseResult.categories", k)["score"] * 100 + 0.5), F.lit(0)).cast("int")
    scores = [score(k).alias(k.replace("-", "_")) for k in ("performance", "accessibility", "best-practices", "seo")]

    def lab(k):
        a = F.element_at("_p.lighthouseResult.audits", LAB[k])
        return F.when(a.isNotNull(), F.struct(F.coalesce(a["numericValue"], F.lit(0.0)).alias("value"), vital_rating(k, F.coalesce(a["numericValue"], F.lit(0.0))).alias("rating")))

    there = (F.coalesce(F.length("_p.loadingExperience.initial_url"), F.lit(0)) > 0)

    def crux(k):
        m = F.element_at("_p.loadingExperience.metrics", FIELD[k])
        v = m["percentile"] / (100 if k == "cls" else 1)
        return F.when(there & m.isNotNull(), F.struct(v.alias("value"), vital_rating(k, v).alias("rating")))

    parties = F.filter(F.element_at("_p.lighthouseResult.audits", "third-parties-insight")["details"]["items"], lambda x: x["entity"] != "")
    out = F.struct(*scores, *[lab(k).alias(k) for k in LAB], *[crux(k).alias(f"field_{k}") for k in FIELD], F.transform(parties, lambda x: F.struct(x["entity"].alias("entity"), x["transferSize"].cast("long").alias("bytes"))).alias("third_parties"))
    return df.withColumn("speed", F.when(F.col("_p.lighthouseResult").isNotNull(), out)).drop("_p")


_RDAP = "events array<struct<eventAction:string,eventDate:string>>, entities array<struct<roles:array<string>,vcardArray:string>>"


def parse_rdap(df: DataFrame, json_col: str, as_of: Column) -> DataFrame:
    """``domain``: days of registration and expiry, registrar (the fn of its vCard) and age in years (-1: unknown); null without a registration."""
    df = df.withColumn("_r", F.from_json(json_col, _RDAP))
    dated = F.filter("_r.events", lambda e: F.length(e["eventDate"]) >= 10)
    day = lambda what: F.substring(F.try_element_at(F.filter(dated, lambda e: F.lower(e["eventAction"]) == what), F.lit(-1))["eventDate"], 1, 10)
    registrars = F.filter("_r.entities", lambda e: F.exists(e["roles"], lambda r: F.lower(r) == "registrar"))
    card = F.try_element_at(registrars, F.lit(-1))["vcardArray"]
    name = F.regexp_extract(card, r'(?i)\[\s*"fn"\s*,\s*\{[^}]*\}\s*,\s*"[^"]*"\s*,\s*"((?:[^"\\]|\\.)*)"', 1)
    df = df.withColumn("_day", day("registration")).withColumn("_end", day("expiration"))
    since = F.try_to_date("_day", "yyyy-MM-dd")
    age = F.when(since.isNotNull(), F.year(as_of) - F.year(since)).otherwise(-1)
    out = F.struct(F.col("_day").alias("registered_at"), F.coalesce("_end", F.lit("")).alias("expires_at"), F.coalesce(name, F.lit("")).alias("registrar"), age.cast("int").alias("age_years"))
    return df.withColumn("domain", F.when(F.coalesce(F.length("_day"), F.lit(0)) > 0, out)).drop("_r", "_day", "_end")


def rdap_domain(url: Column) -> Column:
    """Last two labels of an address's host."""
    from siteaudit.operators.extract import host

    labels = F.split(host(url), r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".")


def enrich_domain(pages: DataFrame, rdap: DataFrame) -> DataFrame:
    """``pages`` with the ``domain`` record of ``rdap(domain_name, domain)``: a left join on the registrable domain, of which records are kept once."""
    out = pages.withColumn("domain_name", rdap_domain(F.col("url")))
    return out.join(rdap.dropDuplicates(["domain_name"]), "domain_name", "left")


def to_audit_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``result``, its ``columns`` as one JSON string in which nulls stay."""
    return df.withColumn("result", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def from_audit_json(df: DataFrame, schema: StructType | str) -> DataFrame:
    """``audit``: the JSON in ``result`` read with a schema; name only the fields that are needed."""
    return df.withColumn("audit", F.from_json("result", schema))


def append_audits(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``existing`` and the rows of ``new`` whose id it lacks; of new rows with one id the earliest by created_at stays."""
    first = new.groupBy("id").agg(F.min_by(F.struct(*new.columns), F.struct("created_at", *[c for c in new.columns if c not in ("id", "created_at")])).alias("r")).select("r.*")
    return existing.unionByName(first.join(existing.select("id"), "id", "left_anti").select(*existing.columns))


def export_users_csv(users: DataFrame, path: str) -> None:
    """Users as CSV with a header, one file for each task."""
    columns = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t == "timestamp" else F.col(c) for c, t in users.dtypes]
    users.select(*columns).write.mode("errorifexists").csv(path, header=True, quoteAll=True, escape='"')
