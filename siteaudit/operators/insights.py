"""Scores and ranked issues: column logic over a page's analyses, nothing is shuffled.

Inputs are the columns that ``extract``, ``seo``, ``ux`` and ``tech`` add. Issues have stable
ids and short messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .page_marks import PHRASES, holds, with_marks
from .tokens import contains_any


def status(check: str) -> Column:
    """Status of a search check of the page; null if it wasn't made."""
    return F.element_at("seo_status", check)


def with_status(df: DataFrame) -> DataFrame:
    """``seo_status``: check id -> status."""
    return df.withColumn("seo_status", F.map_from_entries(F.transform("seo", lambda c: F.struct(c["id"], c["status"]))))


def _is(check: str, *states: str) -> Column:
    return F.coalesce(status(check).isin(*states), F.lit(False))


def _failed(check: str) -> Column:
    return _is(check, "fail")


def _points(*parts: tuple) -> Column:
    out = F.lit(0)
    for when, points in parts:
        out = out + F.when(when, points).otherwise(0)
    return out


def _has_tech(category: str) -> Column:
    return F.array_contains("tech_categories", category)


#: What titles or descriptions of pages of a kind say.
NAMES = {
    "software": ("platform", "software", "app", "tool", "suite"), "portfolio": ("portfolio", "my work", "hire me"),
    "service": ("agency", "studio", "consulting", "consultancy", "services", "solutions", "firm", "freelance", "specialist"), "company": ("inc", "corp", "ltd", "llc", "group", "holdings", "enterprise", "global"),
}


def page_intent(df: DataFrame) -> DataFrame:
    """``intent``: category and label. Each category scores points; the first to reach its bound wins, then four fallbacks. Expects ``tech_categories``."""
    said = F.lower(F.concat("title", "overview.description"))
    has = lambda group: holds(*PHRASES[group])
    named = lambda group: contains_any(said, NAMES[group])
    ux, stats = lambda c: F.col(f"ux.{c}"), lambda c: F.col(f"stats.{c}")

    shop, cart, purchase = _has_tech("ecommerce"), has("cart"), has("purchase") & has("fulfilment")
    ecommerce = F.when(shop & cart, 6).when(shop & purchase, 5).when(cart & has("checkout"), 5).when(cart, 4).otherwise(0)
    saas = _points((has("trial"), 4), (has("subscription"), 4), (has("signup") & named("software"), 3), (has("app") & _has_tech("framework"), 2))
    portfolio = _points((named("portfolio"), 4), (has("person") & has("creative"), 4), (has("work"), 2))
    blog = _points((has("published"), 4), (has("dated"), 3), (has("replies") & (stats("words") > 800), 3), (has("posts"), 3))
    narrow, short, many = stats("internal_links") <= 4, stats("words") < 500, ux("cta_count") >= 4
    landing = _points((has("urgency") & (narrow | many), 4), (has("assurance") & many, 3)) + F.when(narrow & short & many, 4).when(narrow & short, 2).otherwise(0)
    service = _points((has("services"), 3), (named("service"), 3), (ux("has_forms") & ux("contact_info"), 2), (has("clients"), 2))
    parts = _points(*[(has(group), 1) for group in ("about", "careers", "press", "investors")])
    corporate = F.when(parts >= 2, parts * 2).otherwise(0) + _points((named("company"), 2), ((stats("internal_links") > 25) & (stats("words") > 1000), 1))
    kind = lambda category, label: F.struct(F.lit(category).alias("category"), F.lit(label).alias("label"))
    intent = (
        F.when(ecommerce >= 5, kind("ecommerce", "store"))
        .when(saas >= 5, kind("saas", "web app"))
        .when(portfolio >= 4, kind("portfolio", "portfolio"))
        .when(blog >= 4, kind("blog", "blog"))
        .when(landing >= 4, kind("landing", "landing page"))
        .when(service >= 5, kind("service", "service business"))
        .when(corporate >= 5, kind("corporate", "corporate site"))
        .when(_has_tech("media") & (stats("external_links") > 10) & (stats("h2") > 5), kind("media", "news site"))
        .when(ux("has_cta") & ux("has_forms") & ux("contact_info"), kind("service", "business site"))
        .when((stats("words") > 1500) & (stats("h2") > 4), kind("blog", "informational site"))
        .when(ux("has_cta") & (ux("cta_count") >= 2), kind("landing", "promotional site"))
        .otherwise(kind("general", "general site"))
    )
    return with_marks(df).withColumn("intent", intent)


def _https() -> Column:
    return F.startswith(F.lower("url"), F.lit("https://"))


def _described() -> Column:
    return F.octet_length("overview.description") >= 50


def customer_view(df: DataFrame) -> DataFrame:
    """``customer``: is the offer clear, is the next step, how strong is trust, is the page heavy."""
    offer = (F.octet_length("title") >= 15) & ((F.col("stats.h1") == 1) | _described())
    trust, proof = F.col("ux.trust_signals"), F.col("ux.social_proof")
    level = F.when((_https() & trust & F.col("ux.privacy_policy")) | (trust & proof), "strong").when(~trust & ~proof & ~F.col("ux.contact_info"), "weak").otherwise("moderate")
    heavy = (F.col("stats.render_blocking") >= 3) | (F.col("stats.scripts") > 12)
    return df.withColumn("customer", F.struct(offer.alias("offer_clear"), F.col("ux.has_cta").alias("cta_clear"), level.alias("trust_level"), heavy.alias("heavy_page"), _described().alias("value_clear")))


def conversion_scores(df: DataFrame) -> DataFrame:
    """``conversion``: clarity, trust, CTA strength, friction (high is good) and overall, each with its first two reasons."""
    ux, blocking, level = lambda c: F.col(f"ux.{c}"), F.col("stats.render_blocking"), F.col("reading.level")
    h1 = F.col("stats.h1")
    clarity = _points((h1 == 1, 28), (_is("meta_desc", "pass"), 24), (_is("title", "pass"), 20), (ux("has_cta"), 18), (level.isin("simple", "moderate"), 10))
    trust = _points((_https(), 25), (ux("privacy_policy"), 20), (ux("trust_signals"), 20), (ux("contact_info"), 20), (ux("social_proof"), 15))
    cta = _points((ux("has_cta"), 50), (ux("has_cta") & (ux("cta_count") >= 3), 20), (ux("has_forms"), 20), (ux("newsletter"), 10))
    lost = F.when(blocking >= 3, 25).when(blocking >= 1, 10).otherwise(0) + _points((F.col("stats.scripts") > 12, 15), (level == "advanced", 15), (~ux("has_cta"), 15), (~ux("mobile_ready"), 15))
    friction = F.greatest(F.lit(0), 100 - lost)
    note = lambda *reasons: F.array_join(F.slice(F.array_compact(F.array(*reasons)), 1, 2), ", ")
    either = lambda ok, yes, no=None: F.when(ok, yes).otherwise(F.lit(no))
    notes = {
        "clarity_note": note(F.when(h1 == 1, "one main heading").when(h1 == 0, "no main heading"), either(_is("meta_desc", "pass"), "good description", "description missing or weak"), either(_is("title", "pass"), "good title"), either(ux("has_cta"), "call to action", "no call to action")),
        "trust_note": note(either(_https(), "https", "no https"), either(ux("privacy_policy"), "privacy policy", "no privacy policy"), either(ux("trust_signals"), "trust signals", "no trust signals")),
        "cta_note": note(either(ux("has_cta"), "calls to action", "no calls to action"), F.when(ux("has_cta") & (ux("cta_count") >= 3), "several of them"), F.when(ux("has_forms"), "form"), F.when(ux("newsletter"), "newsletter")),
        "friction_note": note(F.when(blocking >= 1, "scripts block rendering"), F.when(F.col("stats.scripts") > 12, "many scripts"), F.when(level == "advanced", "hard to read"), F.when(~ux("has_cta"), "no next step"), F.when(~ux("mobile_ready"), "not made for phones"), F.when(lost == 0, "no friction found")),
    }
    df = df.withColumns({"_a": clarity, "_b": trust, "_c": cta, "_d": friction})
    overall = F.floor((F.col("_a") * 30 + F.col("_b") * 25 + F.col("_c") * 30 + F.col("_d") * 15) / 100).cast("int")
    scores = {"overall": overall, "clarity": F.col("_a"), "trust": F.col("_b"), "cta": F.col("_c"), "friction": F.col("_d")}
    return df.withColumn("conversion", F.struct(*[v.cast("int").alias(k) for k, v in scores.items()], *[v.alias(k) for k, v in notes.items()])).drop("_a", "_b", "_c", "_d")


def first_impression(df: DataFrame) -> DataFrame:
    """``impression``: 0 to 10 and a label."""
    score = _points(
        (F.col("stats.h1") == 1, 2), (F.col("ux.has_cta"), 2), (_https(), 1), (_is("meta_desc", "pass"), 1), (F.col("ux.mobile_ready"), 1), (F.col("ux.trust_signals") | F.col("ux.social_proof"), 1),
        (_described(), 1), ((F.col("stats.render_blocking") == 0) & (F.col("stats.scripts") <= 8), 1),
    )
    df = df.withColumn("_score", score)
    label = F.when(F.col("_score") <= 2, "Poor").when(F.col("_score") <= 4, "Weak").when(F.col("_score") <= 6, "Fair").when(F.col("_score") <= 8, "Good").otherwise("Strong")
    return df.withColumn("impression", F.struct(F.col("_score").cast("int").alias("score"), label.alias("label"))).drop("_score")


def _no_credit() -> Column:
    return ~F.col("ux.trust_signals") & ~F.col("ux.social_proof")


def opportunity(df: DataFrame) -> DataFrame:
    """``opportunity``: id of the first rule that holds."""
    rules = (
        ("noindex", _failed("robots")), ("https", _failed("https")), ("cta", ~F.col("ux.has_cta")), ("h1", _failed("h1_count")), ("title", _failed("title")), ("render_blocking", F.col("stats.render_blocking") >= 3),
        ("credibility", _no_credit()), ("img_alt", _failed("img_alt")), ("meta_desc", _failed("meta_desc")), ("contact", ~F.col("ux.contact_info")),
    )
    return df.withColumn("opportunity", F.coalesce(*[F.when(when, k) for k, when in rules], F.lit("structure")))


def positioning(df: DataFrame) -> DataFrame:
    """``positioning``: what sets such a site apart, by intent and what the page lacks."""
    kind = F.col("intent.category")
    out = (
        F.when((kind == "ecommerce") & _no_credit(), "store_without_proof").when(kind == "ecommerce", "store")
        .when((kind == "saas") & ~F.col("ux.has_forms"), "saas_without_signup").when(kind == "saas", "saas")
        .when((kind == "portfolio") & ~F.col("ux.contact_info"), "portfolio_without_contact").when(kind == "portfolio", "portfolio")
        .when((kind == "service") & ~F.col("ux.contact_info"), "service_without_contact").when(kind.isin("service", "blog", "landing", "corporate"), kind).otherwise("unclear")
    )
    return df.withColumn("positioning", out)


def _listed(rules, most: int | None = None) -> Column:
    out = F.array_compact(F.array(*[F.when(when, item if isinstance(item, Column) else F.lit(item)) for item, when in rules]))
    return F.slice(out, 1, most) if most else out


def prioritized_issues(df: DataFrame) -> DataFrame:
    """``issues``: the first five of 13 rules in order of priority, with rank."""
    rules = (
        ("noindex", _failed("robots")), ("https", ~_https()), ("cta", ~F.col("ux.has_cta")), ("h1", _failed("h1_count")), ("title", _failed("title")), ("render_blocking", F.col("stats.render_blocking") >= 3),
        ("img_alt_most", _failed("img_alt")), ("credibility", _no_credit()), ("meta_desc", _failed("meta_desc")), ("canonical", _failed("canonical")), ("img_alt_some", _is("img_alt", "warning")),
        ("og_tags", _failed("og_tags")), ("contact", ~F.col("ux.contact_info")),
    )
    return df.withColumn("issues", F.transform(_listed(rules, 5), lambda x, i: F.struct((i + 1).alias("rank"), x.alias("id"))))


def plain_findings(df: DataFrame) -> DataFrame:
    """``findings``: the first eight of 17 rules."""
    rules = (
        ("https", _failed("https")), ("noindex", _failed("robots")), ("title_missing", _failed("title")), ("title_length", _is("title", "warning")), ("desc_missing", _failed("meta_desc")),
        ("desc_length", _is("meta_desc", "warning")), ("h1_missing", _failed("h1_count")), ("h1_many", _is("h1_count", "warning")), ("img_alt", _is("img_alt", "fail", "warning")), ("canonical", _failed("canonical")),
        ("og_tags", _failed("og_tags")), ("schema", _failed("schema")), ("viewport", _failed("viewport")), ("cta", ~F.col("ux.has_cta")), ("credibility", _no_credit()), ("contact", ~F.col("ux.contact_info")),
        ("privacy", ~F.col("ux.privacy_policy")),
    )
    return df.withColumn("findings", _listed(rules, 8))


#: What to do about each weak point.
ADVICE = {
    "title_missing": "write a title of 50 to 60 characters", "title_length": "bring the title to 50 to 60 characters", "desc_missing": "write a description of 120 to 160 characters", "desc_length": "bring the description to 120 to 160 characters",
    "canonical": "name the canonical address", "h1_missing": "add one main heading", "h1_many": "keep one main heading", "img_alt": "describe the images", "og_missing": "add title, description and image for shares",
    "og_partial": "complete title, description and image for shares", "schema": "add structured data", "viewport": "set the viewport", "noindex": "allow indexing", "https": "serve over https", "mixed_content": "load all resources over https",
    "cta": "add a call to action", "forms": "add a form", "proof": "show reviews or customers", "trust": "show guarantees or certificates", "contact": "show how to get in touch",
}


def weak_points(df: DataFrame) -> DataFrame:
    """``weak_points`` and ``recommendations``, in pairs."""
    rules = (
        ("title_missing", _failed("title")), ("title_length", _is("title", "warning")), ("desc_missing", _failed("meta_desc")), ("desc_length", _is("meta_desc", "warning")), ("canonical", _failed("canonical")),
        ("h1_missing", _failed("h1_count")), ("h1_many", _is("h1_count", "warning")), ("img_alt", _is("img_alt", "fail", "warning")), ("og_missing", _failed("og_tags")), ("og_partial", _is("og_tags", "warning")),
        ("schema", _failed("schema")), ("viewport", _failed("viewport")), ("noindex", _failed("robots")), ("https", _failed("https")), ("mixed_content", _is("mixed_content", "warning")), ("cta", ~F.col("ux.has_cta")),
        ("forms", ~F.col("ux.has_forms")), ("proof", ~F.col("ux.social_proof")), ("trust", ~F.col("ux.trust_signals")), ("contact", ~F.col("ux.contact_info")),
    )
    df = df.withColumn("weak_points", _listed(rules))
    advice = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    return df.withColumn("recommendations", F.transform("weak_points", lambda x: F.element_at(advice, x)))


def overall_scores(df: DataFrame) -> DataFrame:
    """``scores``: SEO, UX, performance (mobile, else desktop, else -1), conversion and overall, the mean of those there are. Expects ``performance`` (mobile and desktop scores, null without data)."""
    signals = ("has_cta", "has_forms", "social_proof", "trust_signals", "contact_info", "mobile_ready")
    n = sum((F.col(f"ux.{s}").cast("int") for s in signals), F.lit(0))
    ux = F.floor(n * 100 / len(signals) + 0.5).cast("int")
    perf = F.coalesce("performance.mobile", "performance.desktop", F.lit(-1)).cast("int")
    df = df.withColumns({"_ux": ux, "_perf": perf})
    rest = F.col("seo_score.score") + F.col("_ux") + F.col("conversion.overall")
    overall = F.when(F.col("_perf") >= 0, F.floor((rest + F.col("_perf")) / 4 + 0.5)).otherwise(F.floor(rest / 3 + 0.5)).cast("int")
    return df.withColumn("scores", F.struct(overall.alias("overall"), F.col("seo_score.score").alias("seo"), F.col("_ux").alias("ux"), F.col("_perf").alias("performance"), F.col("conversion.overall").alias("conversion"))).drop("_ux", "_perf")


#: Fixed values of the fix list, besides those made of search checks: id -> (impact, effort, urgency, category), in order.
FIXES = {
    "broken-links": ("high", "easy", 88, "seo"), "low-intent": ("high", "medium", 72, "seo"), "lcp-poor": ("high", "hard", 97, "performance"), "lcp-fair": ("high", "medium", 72, "performance"),
    "cls-poor": ("high", "medium", 78, "performance"), "tbt-poor": ("high", "hard", 82, "performance"), "perf-poor": ("high", "hard", 95, "performance"), "perf-fair": ("medium", "medium", 65, "performance"),
    "image-format": ("medium", "easy", 70, "performance"), "lazy-loading": ("medium", "easy", 60, "performance"), "render-blocking": ("medium", "easy", 68, "performance"), "no-cta": ("high", "easy", 98, "ux"),
    "weak-cta": ("high", "easy", 75, "ux"), "no-trust": ("high", "medium", 80, "ux"), "no-social-proof": ("medium", "easy", 68, "ux"), "not-mobile": ("high", "hard", 78, "ux"), "no-contact": ("medium", "easy", 62, "ux"),
    "no-privacy": ("medium", "easy", 62, "ux"), "low-clarity": ("high", "medium", 82, "conversion"), "low-trust-score": ("high", "medium", 78, "conversion"), "high-friction": ("high", "medium", 75, "conversion"),
    "generic-copy": ("high", "medium", 80, "conversion"), "vague-copy": ("medium", "easy", 65, "conversion"), "security-headers": ("medium", "easy", 72, "security"), "stale-content": ("medium", "easy", 58, "content"),
    "complex-content": ("medium", "easy", 52, "content"),
}


def _fix(id_: Column, impact: str, effort: str, urgency: int, category: str) -> Column:
    label = "fix-now" if urgency >= 90 or urgency >= 80 and effort != "hard" else "fix-soon" if urgency >= 60 else "optional"
    values = (("impact", impact), ("effort", effort), ("priority", label), ("category", category), ("urgency", urgency))
    return F.struct(id_.alias("id"), *[F.lit(v).alias(k) for k, v in values])


def fix_list(df: DataFrame) -> DataFrame:
    """``fixes``: issues by falling urgency, in the order of the rules on ties. Expects ``performance`` with scores and ratings, ``broken_links`` and ``security``."""
    c, ux = lambda x: F.col(f"conversion.{x}"), lambda x: F.col(f"ux.{x}")
    p = lambda x: F.col(f"performance.{x}")
    when = {
        "broken-links": F.col("broken_links") > 0, "low-intent": F.col("intent_match.score") < 50, "lcp-poor": p("lcp") == "poor", "lcp-fair": p("lcp") == "needs-improvement", "cls-poor": p("cls") == "poor",
        "tbt-poor": p("tbt") == "poor", "perf-poor": p("mobile") < 50, "perf-fair": p("mobile").between(50, 74), "image-format": F.col("images.modern_pct") < 50, "lazy-loading": F.col("images.missing_lazy") > 3,
        "render-blocking": F.col("stats.render_blocking") > 2, "no-cta": ~ux("has_cta"), "weak-cta": ux("has_cta") & (c("cta") < 50), "no-trust": ~ux("trust_signals"), "no-social-proof": ~ux("social_proof"),
        "not-mobile": ~ux("mobile_ready"), "no-contact": ~ux("contact_info"), "no-privacy": ~ux("privacy_policy"), "low-clarity": c("clarity") < 40, "low-trust-score": c("trust") < 40, "high-friction": c("friction") > 65,
        "generic-copy": F.col("copy.label") == "Generic", "vague-copy": (F.col("copy.label") != "Generic") & (F.size("copy.vague") > 2),
        "security-headers": F.size(F.filter("security", lambda x: x["status"] == "fail")) >= 3, "stale-content": F.col("fresh.rating") == "stale", "complex-content": F.col("reading.level") == "advanced",
    }
    of = lambda state: F.filter("seo", lambda x: x["status"] == state)
    failed = F.transform(of("fail"), lambda x: _fix(F.concat(F.lit("seo-fail-"), x["id"]), "high", "easy", 84, "seo"))
    warned = F.transform(of("warning"), lambda x: _fix(F.concat(F.lit("seo-warn-"), x["id"]), "medium", "easy", 55, "seo"))
    others = F.array_compact(F.array(*[F.when(when[k], _fix(F.lit(k), *v)) for k, v in FIXES.items()]))
    df = df.withColumn("_all", F.concat(failed, warned, others))
    order = F.array_sort(F.transform("_all", lambda x, i: F.struct((-x["urgency"]).alias("u"), i.alias("i"), x.alias("x"))))
    return df.withColumn("fixes", F.transform(order, lambda o: o["x"])).drop("_all")


def fix_first(k: int = 5) -> Column:
    return F.slice("fixes", 1, k)


def quick_wins(k: int = 3) -> Column:
    return F.slice(F.filter("fixes", lambda x: x["effort"] == "easy"), 1, k)


def high_impact() -> Column:
    return F.filter("fixes", lambda x: x["impact"] == "high")


def of_category(category: str) -> Column:
    return F.filter("fixes", lambda x: x["category"] == category)


def blockers(df: DataFrame) -> DataFrame:
    """``blockers``: what keeps visitors from acting, by severity (critical, warning, info), in order of the rules within."""
    c, ux = lambda x: F.col(f"conversion.{x}"), lambda x: F.col(f"ux.{x}")
    rules = (  # in order of severity already
        ("clarity", "critical", c("clarity") < 40), ("trust", "critical", c("trust") < 40), ("cta", "critical", ~ux("has_cta") | (c("cta") < 40)), ("friction", "warning", c("friction") > 65),
        ("social-proof", "warning", ~ux("social_proof")), ("privacy", "warning", ~ux("privacy_policy")), ("trust-signals", "info", ~ux("trust_signals") & (c("trust") >= 40)),
    )
    return df.withColumn("blockers", _listed([(F.struct(F.lit(k).alias("id"), F.lit(s).alias("severity")), w) for k, s, w in rules]))


def weakest_dimension(df: DataFrame) -> DataFrame:
    """``weakest``: of CTA, trust and clarity the lowest, the first on ties; ``score_blockers``: scores under 50 (friction: 40)."""
    c = lambda x: F.col(f"conversion.{x}")
    low = F.array_min(F.array(*[F.struct(c(k).alias("score"), F.lit(i).alias("i"), F.lit(k).alias("id")) for i, k in enumerate(("cta", "trust", "clarity"))]))
    under = [(k, c(k) < (40 if k == "friction" else 50)) for k in ("cta", "trust", "clarity", "friction")]
    return df.withColumn("weakest", F.struct(low["id"].alias("id"), low["score"].alias("score"))).withColumn("score_blockers", _listed(under))


def summary(df: DataFrame) -> DataFrame:
    """``summary``: a sentence of what is strong and what is weak."""
    s = lambda x: F.col(f"scores.{x}")
    strong = _listed([("search basics", s("seo") >= 75), ("speed", s("performance") >= 75), ("usability", s("ux") >= 75), ("conversion", s("conversion") >= 65)])
    broken = F.concat(F.col("broken_links").cast("string"), F.lit(" broken links"))
    weak = _listed([("search basics", s("seo") < 50), ("speed", s("performance").between(0, 49)), ("usability", s("ux") < 50), ("conversion", s("conversion") < 45), ("phones", ~F.col("ux.mobile_ready")), (broken, F.col("broken_links") > 0)])
    df = df.withColumns({"_s": strong, "_w": weak})
    good, bad = F.array_join("_s", " and "), F.array_join("_w", ", ")
    text = (
        F.when((F.size("_s") == 0) & (F.size("_w") == 0), "Fair in all areas.")
        .when(F.size("_s") == 0, F.concat(F.lit("Weak: "), bad, F.lit(".")))
        .when(F.size("_w") == 0, F.concat(F.lit("Strong: "), good, F.lit(".")))
        .otherwise(F.concat(F.lit("Strong: "), good, F.lit("; weak: "), bad, F.lit(".")))
    )
    return df.withColumn("summary", text).drop("_s", "_w")


def issue_prevalence(df: DataFrame) -> DataFrame:
    """Pages by category and priority of their issues, with all totals; an id comes once a page. Partial sums before the shuffle, few keys."""
    long = df.select("page_id", F.explode("fixes").alias("f")).select("page_id", "f.*")
    return long.cube("category", "priority").agg(F.grouping_id().alias("level"), F.count("*").alias("issues"), F.count_distinct("page_id").alias("pages"))
