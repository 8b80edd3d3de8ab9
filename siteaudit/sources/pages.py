"""Crawled pages: addresses, fetch outcomes, and the enriched pages that queries run over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a page at most.
MAX_BODY = 5 * 1024 * 1024


def normalized_url(raw: Column) -> Column:
    """Trimmed, with https:// if no scheme is given."""
    t = F.trim(raw)
    return F.when(t.rlike(r"^(?i)https?://") | t.contains("://"), t).otherwise(F.concat(F.lit("https://"), t))


def load_pages(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``url_norm`` and ``reject_reason`` (null: accepted; else empty, scheme, host or credentials)."""
    t = F.trim(F.coalesce(F.col(url), F.lit("")))
    norm = normalized_url(F.col(url))
    scheme = F.lower(F.regexp_extract(norm, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(norm, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    reason = (
        F.when(t == "", "empty")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(authority.contains("@"), "credentials")
        .when((host == "") | host.rlike(r"\s"), "host")
    )
    return df.withColumn("url_norm", F.when(t != "", norm)).withColumn("reject_reason", reason)


#: Outcomes of HTTP statuses, and of error texts by what they contain.
STATUS = {401: "login_required", 403: "denied", 404: "not_found", 429: "rate_limited", 999: "blocked"}
ERRORS = (
    ("timeout", ("timeout", "deadline exceeded")),
    ("dns", ("no such host",)),
    ("connect", ("connection refused", "connection reset")),
    ("redirects", ("redirect",)),
    ("tls", ("certificate", "tls")),
)


def classify_fetch(df: DataFrame, max_bytes: int = MAX_BODY) -> DataFrame:
    """``status, content_type, error, html``: adds ``outcome`` and cuts ``html`` to ``max_bytes`` bytes, without a character that this breaks."""
    s, error = F.col("status"), F.lower("error")
    failed = F.when(F.lit(False), "")
    for name, needles in ERRORS:
        failed = failed.when(_any(error, needles), name)
    by_status = F.when((s >= 300) & (s < 400), "redirect_loop")
    for code, name in STATUS.items():
        by_status = by_status.when(s == code, name)
    by_status = by_status.when(s >= 500, "server_error").when((s < 200) | (s >= 300), "unexpected")
    kind = F.lower("content_type")
    is_html = kind.isNull() | (kind == "") | kind.contains("text/html") | kind.contains("application/xhtml")
    outcome = F.when(F.col("error").isNotNull(), failed.otherwise("other")).otherwise(F.coalesce(by_status, F.when(~is_html, "not_html"), F.lit("ok")))
    return df.withColumn("outcome", outcome).withColumn("html", F.when(F.col("outcome") == "ok", _first_bytes(F.col("html"), max_bytes)))


def _first_bytes(text: Column, n: int) -> Column:
    whole = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.regexp_replace(whole, "\ufffd$", ""))


def _any(text: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


#: What pages get before </head> or </body>, when page_id % k = r, so that no check is constant.
SNIPPETS = (
    ("</head>", 3, 0, '<meta name="description" content="Short description of forty bytes, so.">'),
    ("</head>", 3, 1, '<meta name="description" content="' + "A guide to pricing plans, reviews and downloads. " * 2 + 'Read the free guide now.">'),
    ("</head>", 2, 0, '<meta name="viewport" content="width=device-width">'),
    ("</head>", 4, 1, '<link rel="canonical" href="https://example.com/c">'),
    ("</head>", 5, 0, '<meta property="og:title" content="T"><meta property="og:description" content="D"><meta property="og:image" content="/i.png">'),
    ("</head>", 5, 1, '<meta property="og:title" content="T">'),
    ("</head>", 7, 0, '<meta name="robots" content="noindex, follow">'),
    ("</head>", 6, 0, '<script type="application/ld+json">{"@type": "Article", "datePublished": "2024-03-05", "author": {"@type": "Person"}}</script>'),
    ("</head>", 4, 2, '<script src="/a.js"></script><script src="/b.js" defer="defer"></script><script src="https://www.googletagmanager.com/gtm.js?id=GTM-AB12"></script>'),
    ("</head>", 5, 2, '<link rel="stylesheet" href="https://fonts.googleapis.com/css2?family=Inter:wght@400;600;700&display=swap"><style>a{color:#1a2B3c}b{color: #fff}c{color:#abc;background:#abc}</style>'),
    ("</head>", 8, 3, '<link rel="alternate" hreflang="de" href="/de"><link rel="icon" href="/f.ico"><meta name="theme-color" content="#3366FF">'),
    ("</head>", 9, 4, '<link rel="sitemap" href="/sitemap.xml">'),
    ("</body>", 3, 2, '<h1>Second</h1><h1 style="display:none">Hidden</h1><h2>Step 1</h2>'),
    ("</body>", 2, 1, '<img src="/a.webp" alt="A" width="10" height="10" loading="lazy"><img src="/b.jpg?x=1"><img src="/c.png" alt="" role="presentation">'),
    ("</body>", 4, 0, '<form action="/s"><p>Join our newsletter</p><input type="email" name="e"><button>Subscribe</button></form>'),
    ("</body>", 5, 3, '<a href="https://partner.org/x?a=1">P</a><a href="https://partner.org/x?a=2">Q</a><a href="https://other.org/y">R</a><a href="mailto:a@b.org">Mail</a><img src="http://cdn.other.org/p.gif" alt="p">'),
    ("</body>", 3, 1, '<button>Get started</button><p>Secure checkout, money back guarantee, 40% off, only $25 per month. Rated 4.5 stars by customers.</p>'),
    ("</body>", 11, 5, '<p>&copy; 2019&ndash;2023 Example. A seamless, robust and innovative, world-class product.</p><a href="/privacy">Privacy policy</a>'),
    ("</body>", 19, 3, '<div data-reactroot="1"><p>Read of wp-json/wp/ and /sites/default/files/ in words.</p></div><script src="https://cdn11.bigcommerce.com/x.js"></script>'),
    ("</body>", 17, 8, '<p title="caf&eacute; &amp; &#8364;5">Caf&eacute; &#8364;5 it&#x27;s &rarr; AT&amp;T</p><a href="/caf&eacute;?a=1&amp;copy=2&copy=3">Caf&eacute;</a>'),
    ("</head>", 7, 3, '<link rel="preload" href="https://fonts.bunny.net/css?family=Lora:400,700|Open+Sans"><link rel="icon" href="https://fonts.googleapis.com/css2?family=No"><style>@font-face{font-weight:250;font-family: "Own Face";font-weight:900}</style>'),
    ("</head>", 6, 4, '<meta name="date" property="og:other" content="2030-01-01"><meta name="Last-Modified" content="on 2022-11-09."><script>{"datePublished":  "2021-05-06", "x": 1, "datePublished": "2029-01-01", "dateModified": 1, "y": "                                   2028-02-02"}</script>'),
    ("</body>", 10, 7, '<p data-seen="2019-08-07">&copy; 2018</p><time datetime="2023-02-03T10:00">Then</time><time data-datetime="2023-03-04">or</time>'),
    ("</body>", 9, 2, '<p id="p2020-10-11">No date in words</p><i data-at="x 2020-10-12 12020-10-13"></i>'),
    ("</body>", 13, 6, '<iframe src="https://www.youtube.com/embed/x"></iframe><div class="cookie-banner">We use cookies</div><script src="https://widget.intercom.io/w/a"></script>'),
)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its input has fewer splits than these: small tables only, as large ones have more."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with the snippets: ``page_id, url, html``."""
    html = F.col("html")
    for end in ("</head>", "</body>"):
        parts = [F.when(F.col("page_id") % k == r, snippet).otherwise("") for place, k, r, snippet in SNIPPETS if place == end]
        html = F.replace(html, F.lit(end), F.concat(*parts, F.lit(end)))
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", html.alias("html"))


def _sql_html() -> str:
    html = "html"
    for end in ("</head>", "</body>"):
        parts = [f"CASE WHEN page_id % {k} = {r} THEN '{s.replace(chr(39), chr(39) * 2)}' ELSE '' END" for place, k, r, s in SNIPPETS if place == end]
        html = f"replace({html}, '{end}', concat({', '.join(parts)}, '{end}'))"
    return html


#: The same in SQL; ``bare`` is without comments and the bodies of script, style and noscript.
SQL_CRAWL = (
    f"crawl AS (SELECT page_id, url, {_sql_html()} AS html FROM pages), "
    "plain AS (SELECT *, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS nocomment FROM crawl), "
    "stripped AS (SELECT *, regexp_replace(regexp_replace(nocomment, '(?s)(<script[^>]*>).*?</script>', '\\1', 'g'), '(?s)(<style[^>]*>).*?</style>', '\\1', 'g') AS bare FROM plain)"
)
