"""The audit of a crawl: every analysis of every page, one row a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.operators import extract, insights, seo, tech, ux
from siteaudit.operators.tokens import prepared
from siteaudit.sources.payloads import enrich_domain, parse_pagespeed, parse_rdap
from siteaudit.sources.staging import staged


def analysed(pages: DataFrame, as_of: Column) -> DataFrame:
    """Per-page columns of the extraction layer. Pages are tokenized once: the tokens are staged, so no analysis runs their patterns again."""
    df = staged(prepared(pages).drop("lower", "text"), "page-tokens")
    df = df.withColumn("lower", F.lower(F.coalesce("html", F.lit("")))).withColumn("text", F.array_join("text_nodes", " "))  # cheap to make again, and half of what would be staged
    for step in (extract.page_links, extract.page_stats, extract.overview, extract.image_audit, extract.font_audit, extract.theme_color, extract.readability, extract.copy_specificity, extract.intent_alignment, seo.seo_checks, seo.seo_score, ux.ux_signals, tech.ai_builder):
        df = step(df)
    return extract.freshness(df, as_of)


#: Columns of tokens that later steps don't need.
HEAVY = ("html", "lower", "refs", "bare", "tags", "text_nodes", "text")


def with_tech(df: DataFrame, stack: DataFrame) -> DataFrame:
    """Adds ``tech``, a page's technologies in the order shown, and ``tech_categories``: one shuffle on page_id, of a few rows a page."""
    own = stack.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("shown", "name", "category", "confidence"))).alias("tech"))
    empty = F.array().cast("array<struct<shown:int,name:string,category:string,confidence:string>>")
    out = df.join(own, "page_id", "left").withColumn("tech", F.coalesce("tech", empty))
    return out.withColumn("tech_categories", F.array_distinct(F.transform("tech", lambda t: t["category"])))


INSIGHTS = (
    insights.page_intent, insights.customer_view, insights.conversion_scores, insights.first_impression, insights.opportunity, insights.positioning, insights.prioritized_issues, insights.plain_findings,
    insights.weak_points, insights.overall_scores, insights.fix_list, insights.blockers, insights.weakest_dimension, insights.summary,
)


def audit_pages(pages: DataFrame, as_of: Column, rules: DataFrame, headers: DataFrame | None = None, pagespeed: DataFrame | None = None, rdap: DataFrame | None = None, probes: DataFrame | None = None, suffixes: DataFrame | None = None) -> DataFrame:
    """One row for each of ``pages(page_id, url, html)`` with all analyses, scores and issues.

    Optional: ``headers(page_id, headers)``, ``pagespeed(page_id, mobile, desktop)`` as JSON, ``rdap(domain_name, record)`` as JSON, ``probes(href, status,
    final_url)``, ``suffixes`` as ``functions.suffixes`` has them. What is missing counts as no data. The joins are equi-joins on page_id or domain; page text isn't in them, as the columns of ``HEAVY`` are left behind before.
    """
    base = analysed(pages, as_of)
    stack = tech.tech_stack(tech.tech_scores(tech.tech_matches(pages, rules, suffixes)))
    lean = staged(base.drop(*HEAVY), "page-analyses")
    out = with_tech(lean, stack)
    if headers is not None:
        out = out.join(headers, "page_id", "left")
    else:
        out = out.withColumn("headers", F.lit(None).cast("map<string,string>"))
    out = extract.security_headers(out.withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>"))))
    if headers is None:
        out = out.withColumn("security", F.slice("security", 1, 0))
    if pagespeed is not None:
        speeds = parse_pagespeed(parse_pagespeed(pagespeed, "mobile").withColumnRenamed("speed", "m"), "desktop")
        speeds = speeds.select("page_id", F.struct(F.col("m.performance").alias("mobile"), F.col("speed.performance").alias("desktop"), *[F.col(f"m.{k}.rating").alias(k) for k in ("lcp", "cls", "tbt")]).alias("performance"))
        out = out.join(speeds, "page_id", "left")
    else:
        out = out.withColumn("performance", F.lit(None).cast("struct<mobile:int,desktop:int,lcp:string,cls:string,tbt:string>"))
    if rdap is not None:
        out = enrich_domain(out, parse_rdap(rdap, "record", as_of).select("domain_name", "domain"))
    if probes is not None:
        health = extract.link_health(extract.external_links(lean), probes).select("page_id", F.col("broken").alias("broken_links"))
        out = out.join(health, "page_id", "left").withColumn("broken_links", F.coalesce("broken_links", F.lit(0)))
    else:
        out = out.withColumn("broken_links", F.lit(0))
    out = insights.with_status(out)
    for step in INSIGHTS:
        out = step(out)
    return out.drop("seo_status", "tech_categories", "marks")
