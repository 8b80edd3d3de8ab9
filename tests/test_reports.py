"""A report, whole and to the letter, and a report of a page that has nothing."""

from pyspark.sql import functions as F

from siteaudit.operators import tech
from siteaudit.plans.audit import audit_pages
from siteaudit.sources.reports import CHECKS, ISSUES, format_report

HTML = """<html lang="en-GB"><head><title>Acme &amp; Sons builds fences</title><meta name="description" content="Fences of wood and steel for gardens, farms and yards, built in a week by people who know how.">
<meta name="viewport" content="width=device-width"><link rel="canonical" href="https://acme.example/"><link rel="stylesheet" href="/wp-content/themes/x.css"><link href="/wp-includes/y.css"></head>
<body><h1>Fences</h1><img src="a.png" alt="fence"><img src="b.jpg"><a href="mailto:a@acme.example">Contact us</a><button>Get quote</button><form></form><a href="/privacy">Privacy policy</a><p>Rated by customers.</p></body></html>"""

EXPECTED = """PAGE AUDIT
------------------------------------------------------------
  address:            https://acme.example/
  analysed:           2024-06-30 12:00:00
  impression:         8/10, {impression}
------------------------------------------------------------
OVERVIEW
  title:              Acme & Sons builds fences
  description:        Fences of wood and steel for gardens, farms and yards, built in a week by people who know how.
  language:           en
  weight:             lightweight
------------------------------------------------------------
KIND OF SITE
  intent:             {intent}
  opportunity:        {opportunity}
  positioning:        {positioning}
------------------------------------------------------------
VISITOR'S VIEW
  trust:              {trust}
  offer clear:        yes
  next step clear:    yes
    > I see at once what is offered.
    > I know what to do next.
    > {trusting}
    > I don't have to wait for the page.
    > I understand why I should choose this.
------------------------------------------------------------
TECHNOLOGIES
  - WordPress (cms, {confidence})
------------------------------------------------------------
SEARCH CHECKS
  [PASS   ] Secure address: page is served over https
  [PASS   ] Insecure resources: 0 on a secure page
  [PASS   ] Page title: 25 bytes; Acme & Sons builds fences
  [PASS   ] Description: 94 bytes; Fences of wood and steel for gardens, farms and yards, built in a week by people who know how.
  [PASS   ] Canonical link: present; https://acme.example/
  [PASS   ] Main headings: 1 visible
  [FAIL   ] Image texts: 1 images without one; b.jpg
  [FAIL   ] Social preview: incomplete
  [FAIL   ] Structured data: 0 types
  [PASS   ] Viewport: set for phones
  [PASS   ] Indexing: allowed
  [WARNING] Language versions: none linked
  [WARNING] Sitemap: not found
------------------------------------------------------------
CONVERSION
  overall:            {c.overall}/100
  clarity:            {c.clarity}/100 - {c.clarity_note}
  trust:              {c.trust}/100 - {c.trust_note}
  cta:                {c.cta}/100 - {c.cta_note}
  friction:           {c.friction}/100 - {c.friction_note}
------------------------------------------------------------
SIGNALS
  Call to action:     yes, 2 found
  Form:               yes, 1 found
  Social proof:       yes
  Trust signals:      no
  Contact:            yes
  Fit for phones:     yes
  Cookie banner:      no
  Live chat:          no
  Video:              no
  Newsletter:         no
  Privacy policy:     yes
------------------------------------------------------------
ISSUES
  #1 [Accessibility + SEO] Most images lack a text
      why: screen readers and image search skip them
  #2 [Reach] No social preview
      why: shared links show no picture and no text
------------------------------------------------------------
WEAK POINTS
{weak}
------------------------------------------------------------
RECOMMENDATIONS
{recommended}
------------------------------------------------------------
FINDINGS
{findings}
------------------------------------------------------------"""


def test_whole_report(spark):
    at = F.lit("2024-06-30 12:00:00").cast("timestamp")
    pages = spark.createDataFrame([(1, "https://acme.example/", HTML)], "page_id long, url string, html string")
    r = format_report(audit_pages(pages, at, tech.core_rules(spark)), at).first()
    numbered = lambda items: "\n".join(f"  {i}. {x}" for i, x in enumerate(items, 1))
    want = EXPECTED.format(
        impression=r.impression.label, intent=r.intent.label, opportunity=r.opportunity or "-", positioning=r.positioning or "-", trust=r.customer.trust_level, confidence=r.tech[0].confidence, c=r.conversion,
        trusting={"strong": "I have good reasons to trust this site.", "moderate": "I have some reasons to trust this site."}[r.customer.trust_level], weak=numbered(r.weak_points), recommended=numbered(r.recommendations), findings="\n".join(f"  - {x}" for x in r.findings),
    )
    assert r.report.split("\n") == want.replace("8/10", f"{r.impression.score}/10").split("\n")
    assert (r.customer.trust_level, len(r.weak_points) > 0, len(r.findings) > 0) == ("moderate", True, True)


def test_report_of_nothing(spark):
    pages = spark.createDataFrame([(1, "http://x.example", None)], "page_id long, url string, html string")
    text = format_report(audit_pages(pages, F.lit("2024-06-30").cast("timestamp"), tech.core_rules(spark))).first().report
    for part in ("  analysed:           -", "  title:              (none)", "  language:           unknown", "TECHNOLOGIES\n  none found", "[FAIL   ] Page title: 0 bytes", "  Call to action:     none found", "I have no reason to trust this site.", "#1 [SEO + Trust] Not on https"):
        assert part in text, part


def test_all_ids_have_words(spark):
    """Every check and issue of the given pages is named."""
    from siteaudit.queries import pages as p

    rows = p.audited(spark, "/root/testdata/sf0.001").select("seo.id", F.col("issues.id").alias("issue")).collect()
    assert {c for r in rows for c in r.id} <= set(CHECKS) and {c for r in rows for c in r.issue} <= set(ISSUES)
