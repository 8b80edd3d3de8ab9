"""A plain-text report of an audited page, all of it in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE = "-" * 60
#: What each search check is called, what its measure counts, and what is said where there is nothing to tell.
CHECKS = {
    "https": ("Secure address", "", "page is served over https", "page is served without encryption"),
    "mixed_content": ("Insecure resources", "on a secure page", "none", "some"),
    "title": ("Page title", "bytes", "present", "missing"),
    "meta_desc": ("Description", "bytes", "present", "missing"),
    "canonical": ("Canonical link", "", "present", "missing"),
    "h1_count": ("Main headings", "visible", "one", "not exactly one"),
    "img_alt": ("Image texts", "images without one", "none missing", "some missing"),
    "og_tags": ("Social preview", "", "title, description and image", "incomplete"),
    "schema": ("Structured data", "types", "present", "missing"),
    "viewport": ("Viewport", "", "set for phones", "not set"),
    "robots": ("Indexing", "", "allowed", "forbidden"),
    "hreflang": ("Language versions", "", "linked", "none linked"),
    "sitemap": ("Sitemap", "", "found", "not found"),
}
#: What each prioritized issue says, what it harms, and why it counts.
ISSUES = {
    "noindex": ("Indexing is forbidden", "SEO", "the page can't be found through a search engine"),
    "https": ("Not on https", "SEO + Trust", "browsers warn of it, and it ranks lower"),
    "cta": ("No call to action", "Conversion", "visitors don't see what to do next"),
    "h1": ("No main heading", "SEO + Clarity", "neither visitors nor engines see at once what the page is about"),
    "title": ("No title", "SEO", "a search result has no name to show"),
    "render_blocking": ("Scripts block rendering", "Performance", "nothing shows until they are loaded"),
    "img_alt_most": ("Most images lack a text", "Accessibility + SEO", "screen readers and image search skip them"),
    "credibility": ("No sign of trust or of other customers", "Conversion + Trust", "nothing speaks for the site"),
    "meta_desc": ("No description", "SEO", "engines choose a snippet by themselves"),
    "canonical": ("No canonical address", "SEO", "copies of the page compete with it"),
    "img_alt_some": ("Some images lack a text", "Accessibility + SEO", "screen readers and image search skip them"),
    "og_tags": ("No social preview", "Reach", "shared links show no picture and no text"),
    "contact": ("No way to contact", "Trust + Conversion", "who can't be reached is trusted less"),
}
SIGNALS = (
    ("social_proof", "Social proof"), ("trust_signals", "Trust signals"), ("contact_info", "Contact"), ("mobile_ready", "Fit for phones"), ("cookie_banner", "Cookie banner"), ("live_chat", "Live chat"), ("video", "Video"),
    ("newsletter", "Newsletter"), ("privacy_policy", "Privacy policy"),
)


def _words(table: dict, key: Column, k: int) -> Column:
    """The ``k``-th word of a table's entry, the key itself if it has none."""
    pairs = F.create_map(*[F.lit(x) for name, entry in table.items() for x in (name, entry[k])])
    return F.coalesce(F.element_at(pairs, key), key)


def _line(label: str, value: Column, none: str = "-") -> Column:
    text = value.cast("string")
    return F.concat(F.rpad(F.lit(f"  {label}:"), 22, " "), F.when(F.coalesce(text, F.lit("")) == "", none).otherwise(text))


def _yes(flag: Column) -> Column:
    return F.when(flag, "yes").otherwise("no")


def _list(items: Column, entry, none: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, entry), "\n")).otherwise(f"  {none}")


def _numbered(items: Column, none: str) -> Column:
    return _list(items, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x), none)


def _check(c: Column) -> Column:
    measured = F.concat(c["measure"].cast("string"), F.lit(" "), _words(CHECKS, c["id"], 1))
    said = F.when(c["status"] == "pass", _words(CHECKS, c["id"], 2)).otherwise(_words(CHECKS, c["id"], 3))
    told = F.array_join(F.filter(c["details"], lambda d: d != ""), ", ")
    detail = F.concat_ws("; ", F.when(c["measure"].isNotNull() & (_words(CHECKS, c["id"], 1) != ""), measured).otherwise(said), F.when(told != "", told))
    return F.concat(F.lit("  ["), F.rpad(F.upper(c["status"]), 7, " "), F.lit("] "), _words(CHECKS, c["id"], 0), F.lit(": "), detail)


def _statements() -> Column:
    """What a visitor would say."""
    c = F.col("customer")
    return F.array(
        F.when(c["offer_clear"], "I see at once what is offered.").otherwise("I don't see what is offered."),
        F.when(c["cta_clear"], "I know what to do next.").otherwise("I don't know what to do next."),
        F.when(c["trust_level"] == "strong", "I have good reasons to trust this site.").when(c["trust_level"] == "moderate", "I have some reasons to trust this site.").otherwise("I have no reason to trust this site."),
        F.when(c["heavy_page"], "I may have to wait for the page.").otherwise("I don't have to wait for the page."),
        F.when(c["value_clear"], "I understand why I should choose this.").otherwise("I don't understand why I should choose this."),
    )


def format_report(df: DataFrame, analysed_at: Column | None = None) -> DataFrame:
    """``report``: a plain-text report of a page of ``plans.audit.audit_pages``, for ``write.text``. ``analysed_at``: when it was audited, shown in the session's time zone.

    What a page lacks is shown as missing, never left out: no technologies, no issues, null scores.
    """
    score = lambda k: F.col(f"conversion.{k}")
    rated = lambda k: F.concat(score(k).cast("string"), F.lit("/100"), F.when(F.coalesce(score(f"{k}_note"), F.lit("")) != "", F.concat(F.lit(" - "), score(f"{k}_note"))).otherwise(""))
    counted = lambda flag, n, what: F.when(F.col(f"ux.{flag}"), F.concat(F.lit("yes, "), F.col(f"ux.{n}").cast("string"), F.lit(f" {what}"))).otherwise("none found")
    at = F.date_format(F.lit(None).cast("timestamp") if analysed_at is None else analysed_at, "yyyy-MM-dd HH:mm:ss")
    sections = {
        "OVERVIEW": [_line("title", F.col("title"), "(none)"), _line("description", F.col("overview.description"), "(none)"), _line("language", F.col("overview.language"), "unknown"), _line("weight", F.col("overview.load_hint"))],
        "KIND OF SITE": [_line("intent", F.col("intent.label")), _line("opportunity", F.col("opportunity")), _line("positioning", F.col("positioning"))],
        "VISITOR'S VIEW": [_line("trust", F.col("customer.trust_level")), _line("offer clear", _yes(F.col("customer.offer_clear"))), _line("next step clear", _yes(F.col("customer.cta_clear"))), _list(_statements(), lambda s: F.concat(F.lit("    > "), s), "")],
        "TECHNOLOGIES": [_list(F.col("tech"), lambda t: F.concat(F.lit("  - "), t["name"], F.lit(" ("), t["category"], F.lit(", "), F.when(t["confidence"] == "low", "possible").otherwise(t["confidence"]), F.lit(")")), "none found")],
        "SEARCH CHECKS": [_list(F.col("seo"), _check, "none")],
        "CONVERSION": [_line("overall", F.concat(score("overall").cast("string"), F.lit("/100"))), *[_line(k, rated(k)) for k in ("clarity", "trust", "cta", "friction")]],
        "SIGNALS": [_line("Call to action", counted("has_cta", "cta_count", "found")), _line("Form", counted("has_forms", "form_count", "found")), *[_line(label, _yes(F.col(f"ux.{k}"))) for k, label in SIGNALS]],
        "ISSUES": [_list(F.col("issues"), lambda x: F.concat(F.lit("  #"), x["rank"].cast("string"), F.lit(" ["), _words(ISSUES, x["id"], 1), F.lit("] "), _words(ISSUES, x["id"], 0), F.lit("\n      why: "), _words(ISSUES, x["id"], 2)), "none")],
        "WEAK POINTS": [_numbered(F.col("weak_points"), "none of weight")],
        "RECOMMENDATIONS": [_numbered(F.col("recommendations"), "none")],
        "FINDINGS": [_list(F.col("findings"), lambda x: F.concat(F.lit("  - "), x), "none")],
    }
    impression = F.concat(F.col("impression.score").cast("string"), F.lit("/10, "), F.col("impression.label"))
    parts = [F.lit("PAGE AUDIT"), F.lit(RULE), _line("address", F.col("url")), _line("analysed", at), _line("impression", impression)]
    for name, lines in sections.items():
        parts += [F.lit(RULE), F.lit(name), *lines]
    return df.withColumn("report", F.concat_ws("\n", *parts, F.lit(RULE)))
