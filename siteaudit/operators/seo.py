"""The search checks of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .page_marks import SITEMAP_PLUGINS, SITEMAPS, holds, with_marks
from .tokens import attr, contains_any, hidden, last, pick, values

CHECK = "id string, status string, measure int, details array<string>"


def _check(id_: str, status: Column, measure: Column | None = None, details: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(F.lit(id_).alias("id"), status.alias("status"), (F.lit(None) if measure is None else measure).cast("int").alias("measure"), F.coalesce(none if details is None else details, none).alias("details"))


def _length(text: Column, least: int, most: int) -> Column:
    n = F.octet_length(text)
    return F.when(text == "", "fail").when((n < least) | (n > most), "warning").otherwise("pass")


def seo_checks(df: DataFrame) -> DataFrame:
    """``seo``: array of checks ``id, status, measure, details`` of a prepared page; mixed_content is there only on https pages.

    The last title, description, canonical link and og value count; lengths are bytes; hidden headings and decorative images don't count.
    """
    meta = lambda key, name: last(values(pick("meta", lambda t: F.lower(attr(t, key)) == name), "content"))
    link = lambda rel: pick("link", lambda t: F.lower(attr(t, "rel")) == rel)
    some = lambda ok, otherwise="fail": F.when(ok, "pass").otherwise(otherwise)
    mixed = F.slice(F.array_distinct(F.slice(F.regexp_extract_all("html", F.lit(r"(?i)(?:src|href)=[\"'](http://[^\"'>\s]{4,100})[\"']"), F.lit(1)), 1, 20)), 1, 8)
    images = pick("img", lambda t: (attr(t, "role") != "presentation") & ~hidden(t))
    robots = values(pick("meta", lambda t: F.lower(attr(t, "name")) == "robots"), "content")
    ld = pick("script", lambda t: F.lower(attr(t, "type")) == "application/ld+json")
    bodies = F.regexp_extract_all("html", F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)(?:</script|$)"), F.lit(1))
    types = F.array_distinct(F.flatten(F.transform(bodies, lambda b: F.slice(F.regexp_extract_all(b, F.lit(r"\"@type\"\s*:\s*\"([^\"]+)\""), F.lit(1)), 1, 10))))
    langs = F.filter(values(link("alternate"), "hreflang"), lambda x: x != "")
    df = with_marks(df).withColumns({
        "_og": F.array(meta("property", "og:title"), meta("property", "og:description"), meta("property", "og:image")), "_images": images, "_mixed": mixed, "_canonical": last(values(link("canonical"), "href")),
        "_h1": F.size(pick("h1", lambda t: ~hidden(t))), "_langs": langs, "_ld": F.size(ld), "_types": types, "_robots": robots,
    })
    https = F.startswith(F.lower("url"), F.lit("https://"))
    missing = F.size(F.filter("_images", lambda t: F.trim(attr(t, "alt")) == ""))
    share = F.floor(missing * 100 / F.size("_images"))
    alt = F.when((F.size("_images") == 0) | (missing == 0), "pass").when(share > 30, "fail").otherwise("warning")
    og = F.when(F.forall("_og", lambda x: x != ""), "pass").when((F.get("_og", F.lit(0)) != "") | (F.get("_og", F.lit(1)) != ""), "warning").otherwise("fail")
    micro = F.exists("tags", lambda t: (attr(t, "itemscope") != "") | (attr(t, "itemtype") != ""))
    noindex = F.exists("_robots", lambda x: F.lower(x).contains("noindex"))
    viewport = F.exists("tags", lambda t: (t["tag"] == "meta") & (F.lower(attr(t, "name")) == "viewport"))
    map_ = (F.size(link("sitemap")) > 0) | holds(*SITEMAPS, *SITEMAP_PLUGINS)
    checks = [
        _check("https", some(https)),
        F.when(https, _check("mixed_content", some(F.size("_mixed") == 0, "warning"), F.size("_mixed"), F.col("_mixed"))),
        _check("title", _length(F.col("title"), 10, 60), F.octet_length("title"), F.array("title")),
        _check("meta_desc", _length(F.col("description"), 70, 160), F.octet_length("description"), F.array("description")),
        _check("canonical", some(F.col("_canonical") != ""), None, F.array("_canonical")),
        _check("h1_count", F.when(F.col("_h1") == 0, "fail").when(F.col("_h1") == 1, "pass").otherwise("warning"), F.col("_h1")),
        _check("img_alt", alt, missing, F.slice(F.filter(F.transform("_images", lambda t: F.when(F.trim(attr(t, "alt")) == "", F.when(attr(t, "src") != "", attr(t, "src")).otherwise(attr(t, "data-src")))), lambda x: x != ""), 1, 8)),
        _check("og_tags", og, None, F.col("_og")),
        _check("schema", some((F.col("_ld") > 0) | micro), F.size("_types"), F.col("_types")),
        _check("viewport", some(viewport)),
        _check("robots", F.when(noindex, "fail").otherwise("pass")),
        _check("hreflang", some(F.size("_langs") > 0, "warning"), F.size("_langs"), F.array_distinct("_langs")),
        _check("sitemap", some(map_, "warning")),
    ]
    return df.withColumn("seo", F.array_compact(F.array(*checks))).drop("_og", "_images", "_mixed", "_canonical", "_h1", "_langs", "_ld", "_types", "_robots")


def seo_checks_long(df: DataFrame) -> DataFrame:
    """A row for each check. A page always has some; explode_outer, because for explode the optimizer infers a filter on the
    whole array and pushes it down, and the checks' expressions with it, below the tokens."""
    return df.select("page_id", F.explode_outer("seo").alias("c")).select("page_id", "c.*")


def seo_score(df: DataFrame) -> DataFrame:
    """``seo_score``: rounded share of checks passed, and the counts."""
    n = lambda s: F.size(F.filter("seo", lambda c: c["status"] == s))
    score = F.when(F.size("seo") == 0, 0).otherwise(F.floor(n("pass") * 100 / F.size("seo") + 0.5)).cast("int")
    return df.withColumn("seo_score", F.struct(score.alias("score"), n("pass").alias("passed"), n("warning").alias("warnings"), n("fail").alias("failed")))


def seo_rollup(df: DataFrame) -> DataFrame:
    """Pages by check and status; partial sums before the shuffle, few keys."""
    long = seo_checks_long(df)
    return long.groupBy(F.col("id").alias("check")).pivot("status", ["pass", "warning", "fail"]).agg(F.count(F.lit(1))).na.fill(0)


def host_scores(df: DataFrame, url_host: Column) -> DataFrame:
    """Pages and mean score by host, with a total of all hosts (null host)."""
    return df.rollup(url_host.alias("host")).agg(F.count("*").alias("pages"), F.avg("seo_score.score").alias("mean_score"))
