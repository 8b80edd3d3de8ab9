"""Operators on pages and rows written for them, with expected values."""

import pytest
from pyspark.sql import functions as F

from siteaudit.sources.reports import format_report
from siteaudit.functions.addresses import address_key, is_private_ip
from siteaudit.operators import auditlog, extract, insights, seo, tech, ux
from siteaudit.operators.tokens import prepared, tokenize
from siteaudit.plans.audit import audit_pages
from siteaudit.sources import pages as pages_source
from siteaudit.sources import payloads
from siteaudit.sources.pages import load_pages
from siteaudit.streaming import jobs

URL = "https://www.example.org/"


def page(spark, html, url=URL):
    return prepared(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string"))


def stack(spark, *pages, url=URL):
    df = spark.createDataFrame([(i, url, h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    rows = tech.tech_stack(tech.tech_scores(tech.tech_matches(df, tech.core_rules(spark)))).orderBy("page_id", "shown").collect()
    return [{r.name: r.confidence for r in rows if r.page_id == i} for i in range(len(pages))]


def test_tokens_survive_odd_markup(spark):
    html = '<HTML><head><!-- <p> --><script>if (a < b) "</p>";</script><style>p>a{}</style></head><body><P ID=x hidden title="a > b" title=\'c\'>One &amp; <b>two</b><br/><a HREF=/q>three</a></body>'
    r = page(spark, html).first()
    assert [t.tag for t in r.tags] == ["html", "head", "script", "style", "body", "p", "b", "br", "a"]
    assert r.tags[5].attrs == {"id": "x", "hidden": "", "title": "a > b"} and r.tags[8].attrs == {"href": "/q"}
    assert [t.in_head for t in r.tags][2:5] == [True, True, False]
    assert r.text == "One & two three"


@pytest.mark.parametrize("html", [None, "", "<", "<p", "<p a='", "<!--", "<script>", "</", "&amp;", "a < b", "<a" + " x" * 5000 + ">t</a>", "<p>" * 2000])
def test_pages_that_are_no_pages(spark, html):
    df = insights.with_status(seo.seo_score(seo.seo_checks(ux.ux_signals(extract.freshness(extract.page_stats(extract.page_links(page(spark, html))), F.lit("2024-01-01").cast("timestamp"))))))
    r = df.select("seo_score", "ux", "stats", "fresh").first()
    assert 0 <= r.seo_score.score <= 100 and r.stats.words >= 0 and r.fresh.rating == "unknown"


def test_technologies(spark):
    got = stack(
        spark,
        '<script src="https://www.googletagmanager.com/gtm.js?id=1"></script><noscript><iframe src="https://www.googletagmanager.com/ns.html"></iframe></noscript>',
        "<script>addEventListener('vite:preloadError', f)</script>",
        "<p>We like typo3 a lot</p>",
        '<script type="application/ld+json">{"image": "/wp-content/x.png"}</script>',
        '<link rel="modulepreload" href="/assets/a.js">',
        '<div data-reactroot></div><script src="/js/react.production.min.js"></script>',
    )
    assert got[0] == {"Google Tag Manager": "high"}
    assert got[1] == {"Vite": "medium"}
    assert got[2] == {"Typo3": "low"}
    assert "WordPress" not in got[3] and "Vite" not in got[4]
    assert list(got[5]) == ["React"]


def test_all_rules_and_entities(spark):
    """The whole tables of the reference, and a page for each rule."""
    rules = tech.core_rules(spark).orderBy("rule").collect()
    assert (len(rules), len({r.name for r in rules}), sum(len(r.patterns) for r in rules)) == (133, 129, 340)
    names = [r.entity for r in tech.core_entities(spark).collect()]
    assert (len(names), len(set(names))) == (90, 90)
    pages = [(r.rule, URL, f"<html><body><div title='{' '.join(r.patterns).replace(chr(39), chr(34))}' data-x=1></div><script>{' '.join(r.patterns)}</script></body></html>") for r in rules]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = tech.tech_matches(df, tech.core_rules(spark)).where("page_id = rule").select("rule").distinct().count()
    assert found == 133


def test_rules_of_one_name_give_the_best_score(spark):
    m = "page_id long, rule int, name string, category string, confidence string, n_patterns int, require_all boolean, pattern string, match string, evidence_type string, strength int, source string"
    rows = [(1, 1, "A", "cms", "high", 2, False, "a.com", "", "explicit", 92, "third-party"), (1, 2, "A", "cms", "high", 1, False, "/b/", "", "indirect", 55, "first-party"), (1, 3, "B", "cdn", "low", 1, False, "x.net", "", "explicit", 92, "unknown")]
    scores = {r.rule: (r.score, r.confidence) for r in tech.tech_scores(spark.createDataFrame(rows, m)).collect()}
    # 69 + 12.5 + 3 - 18 is over the cap for one third-party hit; 41.25 + 25 + 3 + 8 over that for no explicit evidence.
    assert scores == {1: (39, "low"), 2: (69, "medium"), 3: (39, "low")}
    best = tech.tech_stack(tech.tech_scores(spark.createDataFrame(rows, m))).where("name = 'A'").first()
    assert (best.rule, best.score, best.found) == (2, 69, 1)


def test_colours_and_theme(spark):
    html = '<meta name="theme-color" content=" #36F "><style>a{color:#000000;b:#ffffff;c:#1A2b3c}d{e:#abc}#fff{}</style><p style="color: #abc">x</p>'
    df = page(spark, html)
    assert [(r.hex, r.frequency) for r in extract.color_palette(df).orderBy("rank").collect()] == [("#aabbcc", 2), ("#1a2b3c", 1)]
    assert extract.theme_color(df).first().theme_color == "#3366ff"


def test_fonts(spark):
    one = '<link rel="stylesheet" href="https://fonts.googleapis.com/css2?family=Inter:wght@400;600;700&amp;display=swap">'
    four = '<link rel="preload" href="https://fonts.googleapis.com/css?family=A:400,700|B+C|D|E">'
    got = [extract.font_audit(page(spark, h)).first().fonts for h in (one, four, "<p>")]
    assert (got[0].n_families, got[0].n_weights, got[0].too_many) == (1, 3, False)
    assert [f.family for f in got[1].families] == ["A", "B C", "D", "E"] and got[1].too_many and got[1].n_weights == 5
    assert got[2].n_families == 0
    face = "<style>@font-face{font-weight:250;font-family: 'Own Face';font-weight:900}</style><link rel=icon href='https://fonts.googleapis.com/css2?family=No'><script src='//use.typekit.net/ab.js'></script>"
    families = extract.font_audit(page(spark, face)).first().fonts.families
    assert [(f.family, f.weights, f.source) for f in families] == [("Adobe Fonts (Typekit)", [], "Adobe Fonts"), ("Own Face", ["250"], "Custom/Self-hosted")]


def test_freshness_rules(spark):
    of = lambda h: extract.freshness(page(spark, h), F.lit("2024-06-30").cast("timestamp")).first().fresh
    assert of('<p data-x="2024-05-01">2024-13-01 12024-01-02</p>').latest_date == "2024-05-01"
    ld = of('<script>{"datePublished": "2021-01-02", "datePublished": "2023-01-02", "dateModified": "' + " " * 60 + '2024-01-01"}</script><p>2024-02-02')
    assert (ld.latest_date, ld.latest_year, ld.rating, ld.signals) == ("2021-01-02", 2021, "stale", ["JSON-LD datePublished: 2021-01-02"])
    both = of('<meta property="og:title" name="date" content="2024-01-01"><meta name="Date" content="at 2023-12-31."><p>&copy; 1999 - 2022')
    assert (both.latest_date, both.latest_year, both.rating, both.signals) == ("2023-12-31", 2023, "aging", ["Copyright © 2022 found", "Date: 2023-12-31"])
    assert of("<p>Copyright 2023</p>").rating == "aging" and of("<p>none</p>").rating == "unknown"


def test_character_references(spark):
    got = prepared(spark.createDataFrame([(1, "u", "<title>Caf&eacute; &#233;&#x27;</title><p>&notit; &amp;lt; &rarr;</p><a title='&copy=1 &eacute;' href='?a&amp;copy=2'>x</a>")], "page_id long, url string, html string")).first()
    assert got.title == "Café é'" and got.text == "Café é' ¬it; &lt; → x"
    assert {k: v for t in got.tags if t.tag == "a" for k, v in t.attrs.items()} == {"title": "&copy=1 é", "href": "?a&copy=2"}


def test_body_is_cut_in_bytes(spark):
    rows = [(1, 200, "text/html", None, "aé€"), (2, 200, "text/html", None, "abcdef"), (3, 200, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, status int, content_type string, error string, html string")
    assert [r.html for r in pages_source.classify_fetch(df, 4).orderBy("page_id").collect()] == ["aé", "abcd", None]


def test_copy(spark):
    text = lambda t: extract.copy_specificity(page(spark, f"<p>{t}</p>")).first().copy
    vague = text("A seamless, robust, scalable and innovative world-class product.")
    assert vague.score == 25 and vague.label == "Generic" and vague.vague == ["world-class", "innovative", "seamless", "robust", "scalable"]
    sharp = text("Used by 1,200 teams; 40% faster, ready in 5 minutes, $30.")
    assert sharp.score == 100 and sharp.specific == ["percentages", "prices", "counts", "timeframes"]
    assert text("").score == 100


def test_external_links(spark):
    html = '<a href="https://a.org/x?1">1</a><a href="https://a.org/x?2">2</a><a href="https://b.org/">3</a><a href="#t">4</a><a href="mailto:a@b.c">5</a><a href="https://www.example.org/own">6</a><a href="/in">7</a><a href="page.html">8</a><a href="//c.org/">9</a>'
    df = extract.page_links(page(spark, html))
    assert [r.href for r in extract.external_links(df).orderBy("nth").collect()] == ["https://a.org/x?1", "https://b.org/"]
    assert [x.kind for x in df.first().links] == ["external", "external", "external", "ignored", "ignored", "internal", "internal", "ignored", "internal"]


def test_security_headers(spark):
    full = {"Strict-Transport-Security": "max-age=1", "CONTENT-security-policy": "x", "X-Frame-Options": "deny", "X-Content-Type-Options": "nosniff", "Referrer-Policy": "origin", "Permissions-Policy": "x"}
    df = spark.createDataFrame([(1, full), (2, {}), (3, full | {"Referrer-Policy": "unsafe-url"})], "page_id long, headers map<string,string>")
    got = {r.page_id: {c.id: c.status for c in r.security} for r in extract.security_headers(df).collect()}
    assert set(got[1].values()) == {"pass"} and list(got[2].values()).count("fail") == 3 and got[3]["referrer"] == "warning"


def test_rdap(spark):
    card = '["vcard",[["version",{},"text","4.0"],["fn",{},"text","Names Inc"]]]'
    full = '{"events":[{"eventAction":"registration","eventDate":"2010-03-04T00:00:00Z"},{"eventAction":"Expiration","eventDate":"2030-01-01T00:00:00Z"}],"entities":[{"roles":["registrar"],"vcardArray":%s}]}' % card
    rows = [(1, full), (2, '{"events":[{"eventAction":"registration","eventDate":"2010-03-04"}]}'), (3, "{oops"), (4, None), (5, '{"events":[]}')]
    got = {r.n: r.domain for r in payloads.parse_rdap(spark.createDataFrame(rows, "n int, j string"), "j", F.lit("2024-06-01").cast("timestamp")).collect()}
    assert tuple(got[1]) == ("2010-03-04", "2030-01-01", "Names Inc", 14)
    assert tuple(got[2]) == ("2010-03-04", "", "", 14) and got[3] is got[4] is got[5] is None


def test_addresses(spark):
    urls = [("example.com",), (" http://x.org/a ",), ("bad-url",), ("ftp://x.org",), ("https://u:p@x.org",), ("",), (None,), ("https://",)]
    got = [(r.url_norm, r.reject_reason) for r in load_pages(spark.createDataFrame(urls, "url string")).collect()]
    assert got[:3] == [("https://example.com", None), ("http://x.org/a", None), ("https://bad-url", None)]
    assert [r for _, r in got[3:]] == ["scheme", "credentials", "empty", "empty", "host"]
    ips = spark.createDataFrame([(x,) for x in ("10.1.2.3", "8.8.8.8", "172.31.0.1", "172.32.0.1", "::1", "FC00::1", "fe80::2", "2001:db8::1", "239.1.1.1", "300.1.1.1", None, "::ffff:127.0.0.1")], "ip string")
    assert [r[0] for r in ips.select(is_private_ip(F.col("ip"))).collect()] == [True, False, True, False, True, True, True, False, True, False, False, True]


def test_search_checks(spark):
    html = (
        "<title>Old</title><title>A title of fitting length</title><meta name=description content='" + "d" * 100 + "'><link rel=canonical href=/c><meta name=robots content=NoIndex>"
        "<h1>One</h1><h1 aria-hidden=true>Two</h1><h1 hidden>Three</h1><img src=a><img src=b alt=x><img src=c role=presentation><img src='http://x.org/i.png' alt=y>"
    )
    got = {c.id: (c.status, c.measure) for c in seo.seo_checks(page(spark, html)).first().seo}
    assert got["title"] == ("pass", 25) and got["meta_desc"] == ("pass", 100) and got["canonical"][0] == "pass" and got["robots"][0] == "fail"
    assert got["h1_count"] == ("warning", 2)  # a bare hidden attribute hides nothing
    assert got["img_alt"] == ("fail", 1) and got["mixed_content"] == ("warning", 1)
    assert "mixed_content" not in {c.id for c in seo.seo_checks(page(spark, html, "http://x.org")).first().seo}


def test_audit(spark):
    html = "<title>Acme pricing plans</title><h1>Acme</h1><p>Start your free trial, $10 per month, billed annually. Secure, with a money back guarantee.</p><a href='/p'>Sign up</a>" + "<script src=a.js></script>" * 4
    head = html.replace("<title>", "<head><title>").replace("<h1>", "</head><h1>")
    df = spark.createDataFrame([(1, URL, head), (2, "http://x.org", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in audit_pages(df, F.lit("2024-01-01").cast("timestamp"), tech.core_rules(spark)).collect()}
    a, b = got[1], got[2]
    assert a.intent.category == "saas" and a.positioning == "saas_without_signup" and a.customer.trust_level == "moderate"
    assert (a.conversion.clarity, a.conversion.trust, a.conversion.cta) == (28 + 20 + 18 + 10, 45, 50) and a.conversion.overall == (76 * 30 + 45 * 25 + 50 * 30 + a.conversion.friction * 15) // 100
    assert a.scores.performance == -1 and a.fixes[0].urgency == max(f.urgency for f in a.fixes) and [i.rank for i in a.issues] == list(range(1, len(a.issues) + 1))
    assert b.fixes[0].id == "no-cta" and b.intent.category == "general" and b.opportunity == "https" and len(b.findings) == 8
    assert len(a.weak_points) == len(a.recommendations) and all(a.recommendations)
    assert all(0 <= x <= 100 for r in got.values() for x in (*r.scores[:3], *r.conversion[:5]))
    text = format_report(audit_pages(df, F.lit("2024-01-01").cast("timestamp"), tech.core_rules(spark))).select("report").first()[0]
    assert all(s in text for s in ("OVERVIEW", "SEARCH CHECKS", "CONVERSION", "ISSUES", "WEAK POINTS"))


def test_reports_to_files(spark, tmp_path):
    users = spark.createDataFrame([(1, 'a"b@x.org', "pro")], "id long, email string, plan string")
    payloads.export_users_csv(users, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True, escape='"').collect()[0].email == 'a"b@x.org'


def test_appends_and_changes_are_idempotent(spark):
    a = spark.createDataFrame([(1, "x", 1)], "id long, url string, created_at int")
    new = spark.createDataFrame([(1, "no", 2), (2, "late", 5), (2, "early", 3), (2, "early", 3)], a.schema)
    once = payloads.append_audits(a, new)
    assert sorted(map(tuple, once.collect())) == [(1, "x", 1), (2, "early", 3)]
    assert sorted(map(tuple, payloads.append_audits(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_admission(spark):
    rows = [(i, i % 2, f"2024-01-0{1 + i // 8} 00:00:0{i % 8}") for i in range(16)]
    r = spark.createDataFrame(rows, "id long, key long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    limits = spark.createDataFrame([(0, 2)], "key long, daily_limit int")
    got = auditlog.admit_requests(r, limits).groupBy("key", "day").agg(F.count_if("admitted").alias("n")).collect()
    assert sorted((x.key, x.n) for x in got) == [(0, 2), (0, 2), (1, 4), (1, 4)]


def test_rate_limit(spark):
    at = [0, 10, 59, 60, 61, 200, 201, 202, 261, 262]
    r = spark.createDataFrame([(i, 1, 1_700_000_000 + s) for i, s in enumerate(at)] + [(100, 2, 1_700_000_000)], "id long, key long, s long").select("id", "key", F.timestamp_seconds("s").alias("ts"))
    got = {x.id: x.admitted for x in jobs.rate_limit_batch(r, 2).collect()}
    # The window of 0 holds up to 60; 61 starts the next; that of 200 ends with 260.
    assert [got[i] for i in range(10)] == [True, True, False, False, True, True, True, False, True, True] and got[100]
    assert {x.id: x.admitted for x in jobs.rate_limit_batch(r.repartition(3), 2).collect()} == got


def test_plans(spark, sf):
    """Filters and columns reach the scan; top-k runs without a full sort; no plan copies a page for each rule."""
    from siteaudit.queries import auditlog as q
    from siteaudit.queries import pages as p

    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    top = text(q.a9_slow_audits(spark, sf))
    assert "TakeOrderedAndProject" in top and "o_comment" not in top and "PushedFilters: [" in top
    assert "CartesianProduct" not in text(p.t1_tech_matches(spark, sf)) and "BroadcastNestedLoopJoin" not in text(p.t1_tech_matches(spark, sf))
    assert text(tokenize(spark.read.parquet(f"{sf}/pages.parquet"))).count("Exchange") == 0


def test_pages_are_held_in_slices():
    """Before, a task held a whole batch of pages as Python strings with all their matches."""
    import pyarrow as pa

    from siteaudit.operators import tech

    html = ["x" * 10, None, "", "y" * 25, "z" * 5, "z" * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(["u"] * 6), pa.array(html, pa.string())], ["page_id", "url", "html"])
    slices = list(tech._slices([batch.slice(0, 0), batch, batch.slice(4)], 12))
    assert [s.column(0).to_pylist() for s in slices] == [[0, 1, 2], [3], [4, 5], [4, 5]]
