"""Queries of the page analyses, over enriched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit.functions.suffixes import common_rules, common_suffixes, with_sites
from siteaudit.operators import extract, insights, rollups, seo, tech, ux
from siteaudit.operators.tokens import attr, pick, prepared, tokenize, unnested, values, visible_text
from siteaudit.plans import audit
from siteaudit.sources import pages as crawl_source
from siteaudit.sources import payloads
from siteaudit.sources import tables as t
from siteaudit.sources.pages import SQL_CRAWL, classify_fetch, crawl, load_pages
from siteaudit.sources.reports import format_report
from siteaudit.sources.staging import shared_path, staged

from .registry import ORACLES, query

AS_OF = "2024-06-30 00:00:00"
TAG = """<[a-zA-Z][a-zA-Z0-9]*(?:[^"'>]|"[^"]*"|'[^']*')*>""".replace("'", "''")
ANY_TAG = """(?s)<[a-zA-Z/!?](?:[^"'>]|"[^"]*"|'[^']*')*>""".replace("'", "''")


#: References of the pages, for SQL, with what they stand for and whether HTML has them without a semicolon as well (``&quot`` at the end of a cut title); the ampersand last.
_REFERENCES = (
    ("&quot", '"', True), ("&copy", "©", True), ("&middot", "·", True), ("&ndash", "–", False), ("&eacute", "é", True), ("&#8364", "€", True), ("&#x27", "'", True), ("&rarr", "→", False),
    ("&(?:amp|AMP|#0*38|#[xX]0*26)", "&", True),
)


def _decoded(x: str) -> str:
    for a, b, bare in _REFERENCES:
        x = f"regexp_replace({x}, '{a};{'?' if bare else ''}', '{b.replace(chr(39), chr(39) * 2)}', 'g')"
    return x


def _decoded_attr(x: str) -> str:
    """In attributes a name without a semicolon counts only where neither = nor a letter or digit follows."""
    for a, b, bare in _REFERENCES:
        b = b.replace("'", "''")
        x = f"regexp_replace({x}, '{a};', '{b}', 'g')"
        if bare:
            x = f"regexp_replace({x}, '{a}([^;=A-Za-z0-9]|$)', '{b}\\1', 'g')"
    return x


SPACES = "[\\s\\x{00A0}\\x{0085}\\x0B]"
#: raw: the tags of a page; nodes: its text nodes, trimmed; text; title; description; low: the page in lower case.
SQL_TOKENS = f"""{SQL_CRAWL}, tok AS (SELECT *, regexp_extract_all(bare, '{TAG}') AS raw, lower(html) AS low,
  list_filter(list_transform(string_split_regex(bare, '{ANY_TAG}'), lambda x: regexp_replace({_decoded('x')}, '^{SPACES}+|{SPACES}+$', '', 'g')), lambda x: x <> '') AS nodes FROM stripped),
page AS (SELECT *, array_to_string(nodes, ' ') AS text, regexp_replace({_decoded("regexp_extract(bare, '(?is)<title[^>]*>([^<]*)', 1)")}, '^{SPACES}+|{SPACES}+$', '', 'g') AS title,
  coalesce({_decoded_attr("regexp_extract(list_filter(raw, lambda x: contains(x, 'name=\"description\"'))[-1], 'content=\"([^\"]*)\"', 1)")}, '') AS description FROM tok)"""


def _sql_attr(x: str, name: str) -> str:
    return f"regexp_extract({x}, '\\s{name}=\"([^\"]*)\"', 1)"


def _tags(name: str, where: str = "TRUE") -> str:
    return f"list_filter(raw, lambda x: regexp_matches(x, '(?i)^<{name}[\\s/>]') AND {where})"


def _n(name: str, where: str = "TRUE") -> str:
    return f"CAST(len({_tags(name, where)}) AS INTEGER)"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(crawl(spark, sf_dir))


def moment():
    return t.at(AS_OF)


@query(f"""WITH {SQL_TOKENS}, x AS (SELECT page_id, unnest(raw) AS r FROM page) SELECT page_id, lower(regexp_extract(r, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, count(*) AS n FROM x GROUP BY 1, 2""")
def e1_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unnested(tokenize(crawl(spark, sf_dir)), F.col("tags.tag"), "page_id").groupBy("page_id", F.col("item").alias("tag")).agg(F.count("*").alias("n"))


#: Values of attributes, and what they say.
_VALUES = (
    ("x &copy y", "x © y"), ("?a=1&notit;x", "?a=1&notit;x"), ("?a=1&copy=2", "?a=1&copy=2"), ("?a=1&amp;b=2&lt=3", "?a=1&b=2&lt=3"), ("&lt;b&gt &LT &ltx &lt;x", "<b> < &ltx <x"), ("&amp;lt; &amp;amp;", "&lt; &amp;"),
    ("&#169 &#xA9; &#xa9=1", "© © ©=1"), ("&hearts;&hearts&nbsp", "♥&hearts\u00a0"), ("&copy;=1 &copy1 &copy-1", "©=1 &copy1 ©-1"), ("a & b && &;", "a & b && &;"), ("&NotEqualTilde; &fjlig;", "≂̸ fj"), ("tom&#38jerry&AMP", "tom&jerry&"),
)
_SAID = " ".join(f"WHEN {k} THEN '{v}'" for k, (_, v) in enumerate(_VALUES))


@query(f"""SELECT page_id, kind, CASE (page_id + kind) % {len(_VALUES)} {_SAID} END AS value FROM pages, (SELECT unnest(range(3)) AS kind)""")
def e1_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes in three sorts of quotes, with references."""
    n = F.col("page_id")
    raw = F.array(*[F.lit(v) for v, _ in _VALUES])
    at = lambda k: F.get(raw, ((n + k) % len(_VALUES)).cast("int"))
    bare = F.replace(at(2), F.lit(" "), F.lit("\u2003"))  # an unquoted value ends at a space, but for this one
    more = F.concat(F.lit('<i title="'), at(0), F.lit('" lang=\''), at(1), F.lit("' dir="), bare, F.lit(">x</i>"))
    tags = tokenize(t.table(spark, sf_dir, "pages").withColumn("html", F.concat("html", more))).select("page_id", F.element_at("tags", -1).alias("tag"))
    attrs = lambda k: attr(F.col("tag"), k)
    found = tags.select("page_id", F.posexplode(F.array(attrs("title"), attrs("lang"), F.replace(attrs("dir"), F.lit("\u2003"), F.lit(" ")))).alias("kind", "value"))
    return found.select("page_id", F.col("kind").cast("long").alias("kind"), "value")


@query(f"WITH {SQL_TOKENS} SELECT page_id, CAST(len(nodes) AS INTEGER) AS n_nodes, text FROM page")
def e2_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible_text(tokenize(crawl(spark, sf_dir))).select("page_id", F.size("text_nodes").alias("n_nodes"), "text")


_FIRST = "regexp_extract(list_filter(raw, lambda x: contains(x, '\"description\"') OR contains(x, '\"og:description\"'))[1], 'content=\"([^\"]*)\"', 1)"


@query(f"""WITH {SQL_TOKENS} SELECT page_id, title, coalesce({_FIRST}, '') AS description, coalesce({_sql_attr(_tags('link', "contains(x, 'rel=\"icon\"')") + '[1]', 'href')}, '') AS favicon,
  split_part({_sql_attr(_tags('html') + '[1]', 'lang')}, '-', 1) AS language, CASE WHEN strlen(html) < 50000 THEN 'lightweight' WHEN strlen(html) < 200000 THEN 'medium' ELSE 'heavy' END AS load_hint FROM page""")
def e3_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.overview(base(spark, sf_dir)).select("page_id", "overview.*")


_HOST = "regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#:]*)', 1)"
_LINKS = f"""links AS (SELECT page_id, url, i - 1 AS i, {_decoded_attr(_sql_attr('a', 'href'))} AS href FROM (SELECT page_id, url, unnest({_tags('a')}) AS a, generate_subscripts({_tags('a')}, 1) AS i FROM page)),
kinds AS (SELECT page_id, i, href, regexp_replace(href, '[?#].*$', '') AS norm, CASE WHEN href = '' OR regexp_matches(href, '^(#|mailto:|tel:)') THEN 'ignored' WHEN regexp_matches(href, '^(/|\\./|\\.\\./)') THEN 'internal'
  WHEN {_HOST.format('href')} = '' THEN 'ignored' WHEN {_HOST.format('href')} = {_HOST.format('url')} THEN 'internal' ELSE 'external' END AS kind FROM links)"""
_BLOCKING = "CAST(len(regexp_extract_all(regexp_extract(nocomment, '(?s)^(.*?)</head>', 1), '<script src=\"[^\"]*\">')) + len(regexp_extract_all(regexp_extract(nocomment, '(?s)^(.*?)</head>', 1), '<script[^>]*>[^<]')) - len(regexp_extract_all(regexp_extract(nocomment, '(?s)^(.*?)</head>', 1), '<script src=\"[^\"]*\">[^<]')) AS INTEGER)"


_FONT_LINKS = _n("link", f"regexp_matches(x, '{'|'.join(extract.FONT_HOSTS)}')")


@query(f"""WITH {SQL_TOKENS}, {_LINKS}, lk AS (SELECT page_id, count(*) FILTER (WHERE kind = 'internal') AS a, count(*) FILTER (WHERE kind = 'external') AS b FROM kinds GROUP BY 1)
SELECT p.page_id, CAST(coalesce(list_sum(list_transform(nodes, lambda x: len(string_split_regex(x, '{SPACES}+')))), 0) AS INTEGER) AS words, {_n('img')} AS images, {_n('img', "contains(x, 'loading=\"lazy\"')")} AS lazy_images,
  {_BLOCKING} AS render_blocking, {_n('link', "contains(x, 'rel=\"stylesheet\"')")} AS stylesheets, CASE WHEN {_FONT_LINKS} > 0 THEN {_FONT_LINKS} ELSE CAST(least(10, len(regexp_extract_all(low, '@font-face'))) AS INTEGER) END AS fonts,
  CAST(contains(low, 'youtube.com/embed') AS INTEGER) AS videos, {_n('h1')} AS h1, {_n('h2')} AS h2, {_n('h3')} AS h3, CAST(coalesce(a, 0) AS INTEGER) AS internal_links, CAST(coalesce(b, 0) AS INTEGER) AS external_links,
  CAST(len(list_filter(raw, lambda x: {_sql_attr('x', 'style')} <> '')) AS INTEGER) AS inline_styles, CAST(least(100, floor(coalesce(list_sum(list_transform(nodes, lambda x: strlen(x))), 0) * 100 / strlen(html))) AS INTEGER) AS content_ratio
FROM page p LEFT JOIN lk ON lk.page_id = p.page_id""")
def e4_page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.page_stats(extract.page_links(base(spark, sf_dir))).select("page_id", "stats.*").drop("scripts")


@query(f"""WITH {SQL_TOKENS}, {_LINKS}, f AS (SELECT *, row_number() OVER (PARTITION BY page_id, norm ORDER BY i) AS rn FROM kinds WHERE kind = 'external')
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS nth, href, norm FROM f WHERE rn = 1""")
def e5_external_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.external_links(extract.page_links(base(spark, sf_dir)))


@query(f"WITH {SQL_TOKENS}, {_LINKS} SELECT page_id, href, norm, kind FROM kinds")
def e6_classify_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.classify_links(extract.page_links(base(spark, sf_dir))).drop("pos")


@query(f"""WITH {SQL_TOKENS}, {_LINKS}, f AS (SELECT *, row_number() OVER (PARTITION BY page_id, norm ORDER BY i) AS rn FROM kinds WHERE kind = 'external'),
s AS (SELECT page_id, CASE href WHEN 'https://partner.org/x?a=1' THEN 'broken' WHEN 'https://other.org/y' THEN 'redirect' ELSE 'broken' END AS state FROM f WHERE rn = 1)
SELECT page_id, count(*) AS checked, count(*) FILTER (WHERE state = 'broken') AS broken, count(*) FILTER (WHERE state = 'redirect') AS redirect, count(*) FILTER (WHERE state = 'ok') AS ok FROM s GROUP BY 1""")
def e7_link_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = extract.external_links(extract.page_links(base(spark, sf_dir)))
    status = F.when(F.col("href").contains("partner"), 404).otherwise(200)
    final = F.when(F.col("href").contains("other"), F.lit("https://other.org/z")).otherwise(F.col("href"))
    probes = links.where("href like '%.org%'").select("href").distinct().select("href", status.alias("status"), final.alias("final_url"))
    return extract.link_health(links, probes)


_IMG = "list_filter(raw, lambda x: starts_with(x, '<img'))"


@query(f"""WITH {SQL_TOKENS}, i AS (SELECT page_id, list_transform({_IMG}, lambda x: {{'ext': regexp_extract(split_part(lower({_sql_attr('x', 'src')}), '?', 1), '\\.([^./]*)$', 1), 'x': x}}) AS im FROM page)
SELECT page_id, CAST(len(im) AS INTEGER) AS total, {', '.join(f"CAST(len(list_filter(im, lambda x: x.ext = '{k}')) AS INTEGER) AS {k}" for k in ('webp', 'avif', 'jpg', 'png', 'gif', 'svg'))},
  CAST(len(list_filter(im, lambda x: NOT contains(x.x, 'width='))) AS INTEGER) AS missing_dims, CAST(len(list_filter(im, lambda x: NOT contains(x.x, 'lazy'))) AS INTEGER) AS missing_lazy,
  CASE WHEN len(im) = 0 THEN 0 ELSE CAST(floor(len(list_filter(im, lambda x: x.ext IN ('webp', 'avif'))) * 100 / len(im)) AS INTEGER) END AS modern_pct FROM i""")
def e8_image_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.image_audit(base(spark, sf_dir)).select("page_id", "images.*")


@query(f"""WITH {SQL_CRAWL}, m AS (SELECT page_id, lower(unnest(regexp_extract_all(array_to_string(regexp_extract_all(nocomment, '(?s)<style[^>]*>(.*?)</style>', 1), ' '), ':\\s*#([0-9a-fA-F]{{6}}|[0-9a-fA-F]{{3}})\\b', 1))) AS h FROM plain),
n AS (SELECT page_id, '#' || CASE WHEN length(h) = 3 THEN h[1] || h[1] || h[2] || h[2] || h[3] || h[3] ELSE h END AS hex, count(*) AS frequency FROM m GROUP BY 1, 2)
SELECT page_id, hex, frequency, CAST(row_number() OVER (PARTITION BY page_id ORDER BY frequency DESC, hex) AS INTEGER) AS rank FROM n WHERE hex NOT IN ('#ffffff', '#000000')""")
def e9_color_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.color_palette(base(spark, sf_dir)).select("page_id", "hex", "frequency", "rank")


_FACE = r"""(?i)@font-face\s*\{[^}]*font-family\s*:\s*['"]?([^'";}\n]+)['"]?""".replace("'", "''")
_LINKED = f"""l AS (SELECT page_id, i, lower({_sql_attr('r', 'rel')}) AS rel, {_decoded_attr(_sql_attr('r', 'href'))} AS href FROM (SELECT page_id, unnest(raw) AS r, generate_subscripts(raw, 1) AS i FROM page) WHERE starts_with(lower(r), '<link')),
q AS (SELECT page_id, i, list_transform(list_filter(string_split(split_part(split_part(href, '?', 2), '#', 1), '&'), lambda x: starts_with(x, 'family=')), lambda x: url_decode(replace(substr(x, 8), '+', ' '))) AS p FROM l
  WHERE rel IN ('stylesheet', 'preload') AND (contains(href, 'fonts.googleapis.com') OR contains(href, 'fonts.bunny.net'))),
g AS (SELECT page_id, i, CASE WHEN len(p) = 1 THEN string_split(p[1], '|') ELSE p END AS p FROM q), f AS (SELECT page_id, i, unnest(p) AS f, generate_subscripts(p, 1) AS j FROM g),
b AS (SELECT page_id, unnest(regexp_extract_all(html, '{_FACE}')) AS b, generate_subscripts(regexp_extract_all(html, '{_FACE}'), 1) AS j FROM page),
e AS (SELECT page_id, i, j, trim(split_part(f, ':', 1)) AS family, len(list_filter(string_split_regex(regexp_replace(CASE WHEN contains(f, ':') THEN substr(f, strpos(f, ':') + 1) ELSE '' END, '^[^@]*@', ''), '[;,]'), lambda w: trim(w) <> '')) AS w FROM f
  UNION ALL SELECT page_id, 1000000, j, trim(regexp_extract(b, '{_FACE}', 1)), len(regexp_extract_all(b, '(?i)font-weight\\s*:\\s*[0-9]+')) FROM b),
u AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(family) ORDER BY i, j) AS k FROM e WHERE family <> ''),
n AS (SELECT page_id, count(*) AS n, sum(greatest(1, w)) AS w, string_agg(family || ':' || w, ';' ORDER BY i, j) AS families FROM u WHERE k = 1 GROUP BY page_id)"""


@query(f"""WITH {SQL_TOKENS}, {_LINKED} SELECT page_id, CAST(coalesce(n, 0) AS INTEGER) AS n_families, CAST(coalesce(w, 0) AS INTEGER) AS n_weights, coalesce(n > 3 OR w > 6, FALSE) AS too_many, coalesce(families, '') AS families,
  CASE WHEN contains(html, '"theme-color"') THEN '#3366ff' ELSE '' END AS theme_color FROM page LEFT JOIN n USING (page_id)""")
def e10_font_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.theme_color(extract.font_audit(base(spark, sf_dir)))
    families = F.array_join(F.transform("fonts.families", lambda x: F.concat(x["family"], F.lit(":"), F.size(x["weights"]).cast("string"))), ";")
    return out.select("page_id", "fonts.n_families", "fonts.n_weights", "fonts.too_many", families.alias("families"), "theme_color")


_ISO = r"\b(20\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))\b"
_KEY = f"lower(CASE WHEN {_sql_attr('x', 'property')} <> '' THEN {_sql_attr('x', 'property')} ELSE {_sql_attr('x', 'name')} END)"
_NEAR = ", ".join(f"CASE WHEN strpos(html, '\"{k}\"') > 0 THEN regexp_extract(substr(html, strpos(html, '\"{k}\"'), 60), '{_ISO}', 1) ELSE '' END" for k in extract.LD_KEYS)
_PAST = f"list_max(list_filter(list_transform({{0}}, lambda y: CAST(substr(y, 1, 4) AS INTEGER)), lambda y: y <= {AS_OF[:4]}))"


@query(f"""WITH {SQL_TOKENS}, d AS (SELECT page_id, html, regexp_extract_all(html, '(?i)(?:©|&copy;|copyright)\\s*(?:\\d{{4}}\\s*[-–]\\s*)?(\\d{{4}})', 1) AS years,
  list_transform({_tags('time')}, lambda x: regexp_extract(CASE WHEN {_sql_attr('x', 'datetime')} <> '' THEN {_sql_attr('x', 'datetime')} ELSE {_sql_attr('x', 'data-datetime')} END, '{_ISO}', 1)) AS times,
  list_transform(list_filter({_tags('meta')}, lambda x: {_KEY} IN ({', '.join(f"'{k}'" for k in extract.DATE_KEYS)})), lambda x: regexp_extract({_sql_attr('x', 'content')}, '{_ISO}', 1)) AS metas, [{_NEAR}] AS ld FROM page),
m AS (SELECT *, list_filter(list_concat(times, metas, ld), lambda x: x <> '') AS named FROM d),
y AS (SELECT *, coalesce(list_max(named), list_max(regexp_extract_all(html, '{_ISO}', 1)[1:20])) AS latest, greatest({_PAST.format('years')}, {_PAST.format('named')}) AS year FROM m),
r AS (SELECT *, (epoch(TIMESTAMP '{AS_OF}') - epoch(CAST(latest AS TIMESTAMP))) / 86400 AS days, {AS_OF[:4]} - year AS back FROM y)
SELECT page_id, latest AS latest_date, coalesce(year, CAST(substr(latest, 1, 4) AS INTEGER)) AS latest_year, CASE WHEN days < 180 THEN 'fresh' WHEN days < 540 THEN 'aging' WHEN days IS NOT NULL THEN 'stale' WHEN back = 0 THEN 'fresh' WHEN back = 1 THEN 'aging' WHEN back IS NOT NULL THEN 'stale' ELSE 'unknown' END AS rating,
  CAST(len(list_filter(metas, lambda x: x <> '')) + len(list_filter(ld, lambda x: x <> '')) AS INTEGER) AS n_named FROM r""")
def e11_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.freshness(base(spark, sf_dir), moment())
    named = F.size(F.filter("fresh.signals", lambda s: s.rlike(r"^(?!Article|Copyright)")))
    return out.select("page_id", "fresh.latest_date", "fresh.latest_year", "fresh.rating", named.alias("n_named"))


_STOP = ", ".join(f"'{w}'" for w in extract.STOP_WORDS)


@query(f"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents), n AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) >= 5 AND word NOT IN ({_STOP}) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM n) SELECT doc_id, word, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def e12_top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.top_keywords(t.table(spark, sf_dir, "documents"), key="doc_id").select("doc_id", "word", "n", "rank")


@query(f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]+\\s+'), lambda x: len(list_filter(string_split_regex(x, '{SPACES}+'), lambda w: w <> ''))), lambda n: n >= 8) AS s,
  list_transform(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) >= 4 AND w NOT IN ({_STOP})), lambda w: length(w)) AS w FROM documents),
m AS (SELECT doc_id, CASE WHEN len(s) > 0 THEN CAST(floor(list_sum(s) / len(s)) AS INTEGER) ELSE 0 END AS sentence_words, CASE WHEN len(w) > 0 THEN CAST(floor(list_sum(w) / len(w)) AS INTEGER) ELSE 0 END AS word_letters FROM s)
SELECT *, CASE WHEN sentence_words = 0 THEN 'simple' WHEN sentence_words > 32 OR sentence_words > 22 AND word_letters >= 7 THEN 'advanced' WHEN sentence_words > 22 OR word_letters >= 7 THEN 'moderate' ELSE 'simple' END AS level FROM m""")
def e13_readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.readability(t.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "reading.*")


_VAGUE = " + ".join(f"CAST(regexp_matches(text, '(?i)\\b{p}\\b') AS INTEGER)" for p in extract.VAGUE)
_HINTS = " + ".join("CAST(regexp_matches(text, '" + p.replace("(?<![A-Za-z0-9_])", "\\b") + "') AS INTEGER)" for p in extract.SPECIFIC.values())
_COPY = f"copied AS (SELECT *, {_VAGUE} AS vague, {_HINTS} AS hints FROM page), scored AS (SELECT *, CASE WHEN text = '' THEN 100 ELSE greatest(0, least(100, 100 - 15 * vague + 8 * hints)) END AS copy_score FROM copied)"


@query(f"WITH {SQL_TOKENS}, {_COPY} SELECT page_id, CAST(copy_score AS INTEGER) AS score, CASE WHEN copy_score < 50 THEN 'Generic' WHEN copy_score < 80 THEN 'Mixed' ELSE 'Sharp' END AS label, vague AS n_vague, hints AS n_specific FROM scored")
def e14_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.copy_specificity(base(spark, sf_dir))
    return out.select("page_id", "copy.score", "copy.label", F.size("copy.vague").alias("n_vague"), F.size("copy.specific").alias("n_specific"))


def _says(words) -> str:
    return "(" + " OR ".join(f"contains(c, '{w}')" for w in words) + ")"


_BORNE = {
    "pricing": f"regexp_matches(text, '{extract._PRICE}')", "comparison": "(contains(low, '<table') OR contains(low, 'vs.') OR contains(low, ' vs ') OR contains(low, 'compared to') OR contains(low, 'alternative'))",
    "reviews": f"regexp_matches(text, '{extract._STARS}')", "guide": f"(regexp_matches(text, '{extract._STEPS}') OR contains(low, '<ol'))", "free": "contains(lower(text), 'free')", "action": "(contains(low, '<form') OR contains(low, '<button'))",
}


@query(f"""WITH {SQL_TOKENS}, c AS (SELECT *, lower(title || ' ' || description) AS c FROM page), n AS (SELECT page_id, {' + '.join(f'CAST({_says(w)} AS INTEGER)' for w in extract.CLAIMS.values())} AS claims,
  {' + '.join(f'CAST({_says(w)} AND {_BORNE[k]} AS INTEGER)' for k, w in extract.CLAIMS.items())} AS found FROM c)
SELECT page_id, claims AS n_claims, CASE WHEN claims = 0 THEN 100 ELSE CAST(floor(found * 100 / claims) AS INTEGER) END AS score FROM n""")
def e15_intent_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.intent_alignment(base(spark, sf_dir)).select("page_id", F.size("intent_match.checks").alias("n_claims"), "intent_match.score")


def page_headers(pages: DataFrame) -> DataFrame:
    """Response headers made from page_id."""
    n = F.col("page_id")
    entries = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))) for k, v, when in (
        ("strict-transport-security", "max-age=1", n % 2 == 0), ("CONTENT-SECURITY-POLICY", "default-src 'self'", n % 3 == 0), ("X-Frame-Options", "deny", n % 4 == 0), ("X-Frame-Options", "allow", n % 4 == 1),
        ("X-Content-Type-Options", "NoSniff", n % 5 < 2), ("Referrer-Policy", "unsafe-url", n % 6 == 0), ("Referrer-Policy", "origin", n % 6 == 1), ("Permissions-Policy", "geolocation=()", n % 7 == 0))]))
    return pages.select("page_id", F.map_from_entries(entries).alias("headers"))


@query("""SELECT page_id, c.id AS id, c.s AS status FROM (SELECT page_id, unnest([
  {'id': 'hsts', 's': CASE WHEN page_id % 2 = 0 THEN 'pass' ELSE 'fail' END}, {'id': 'csp', 's': CASE WHEN page_id % 3 = 0 THEN 'pass' ELSE 'fail' END}, {'id': 'xframe', 's': CASE WHEN page_id % 4 = 0 THEN 'pass' ELSE 'warning' END},
  {'id': 'xcontent', 's': CASE WHEN page_id % 5 < 2 THEN 'pass' ELSE 'warning' END}, {'id': 'referrer', 's': CASE WHEN page_id % 6 = 1 THEN 'pass' ELSE 'warning' END}, {'id': 'permissions', 's': CASE WHEN page_id % 7 = 0 THEN 'pass' ELSE 'fail' END}]) AS c FROM pages)""")
def e16_security_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.security_headers(page_headers(t.table(spark, sf_dir, "pages"))).select("page_id", F.explode("security").alias("c")).select("page_id", "c.*")


def _meta(key: str, name: str) -> str:
    return f"coalesce({_sql_attr(_tags('meta', f'contains(x, {chr(39)}{key}={chr(34)}{name}{chr(34)}{chr(39)})') + '[-1]', 'content')}, '')"


def _has(needle: str) -> str:
    return f"contains(bare, '{needle}')"


_HIDDEN = "contains(x, 'display:none')"
_SHOWN_IMG = f"list_filter({_IMG}, lambda x: NOT contains(x, 'role=\"presentation\"'))"
_NOALT = f"len(list_filter({_SHOWN_IMG}, lambda x: trim({_sql_attr('x', 'alt')}) = ''))"
_LEN = "CASE WHEN {0} = '' THEN 'fail' WHEN strlen({0}) < {1} OR strlen({0}) > {2} THEN 'warning' ELSE 'pass' END"
_OG = [_meta("property", f"og:{k}") for k in ("title", "description", "image")]
_OK = "CASE WHEN {0} THEN 'pass' ELSE '{1}' END"
_CHECKS = {
    "https": _OK.format("starts_with(lower(url), 'https://')", "fail"),
    "mixed_content": f"CASE WHEN starts_with(lower(url), 'https://') THEN {_OK.format('NOT ' + _has('src=' + chr(34) + 'http://'), 'warning')} END",
    "title": _LEN.format("title", 10, 60), "meta_desc": _LEN.format("description", 70, 160), "canonical": _OK.format(_has('rel="canonical"'), "fail"),
    "h1_count": f"CASE len({_tags('h1', 'NOT ' + _HIDDEN)}) WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' ELSE 'warning' END",
    "img_alt": f"CASE WHEN {_NOALT} = 0 THEN 'pass' WHEN floor({_NOALT} * 100 / len({_SHOWN_IMG})) > 30 THEN 'fail' ELSE 'warning' END",
    "og_tags": f"CASE WHEN {' AND '.join(x + chr(60) + chr(62) + chr(39) * 2 for x in _OG)} THEN 'pass' WHEN {_OG[0]} <> '' OR {_OG[1]} <> '' THEN 'warning' ELSE 'fail' END",
    "schema": _OK.format(_has("application/ld+json"), "fail"), "viewport": _OK.format(_has('name="viewport"'), "fail"), "robots": _OK.format("NOT contains(lower(" + _meta("name", "robots") + "), 'noindex')", "fail"),
    "hreflang": _OK.format(_has('hreflang="'), "warning"), "sitemap": _OK.format("contains(low, '/sitemap.xml') OR contains(low, 'rel=\"sitemap\"')", "warning"),
}
SQL_SEO = f"seo AS (SELECT *, {', '.join(f'{v} AS s_{k}' for k, v in _CHECKS.items())} FROM page)"
SQL_LONG = f"long AS (SELECT page_id, url, c.id AS id, c.s AS status FROM (SELECT page_id, url, unnest([{', '.join(f'''{{'id': '{k}', 's': s_{k}}}''' for k in _CHECKS)}]) AS c FROM seo) WHERE c.s IS NOT NULL)"


@query(f"WITH {SQL_TOKENS}, {SQL_SEO}, {SQL_LONG} SELECT page_id, id, status FROM long")
def c1_c13_seo_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seo.seo_checks_long(seo.seo_checks(base(spark, sf_dir))).select("page_id", "id", "status")


SQL_SCORE = "score AS (SELECT page_id, url, count(*) AS n, count(*) FILTER (WHERE status = 'pass') AS p, count(*) FILTER (WHERE status = 'warning') AS w, count(*) FILTER (WHERE status = 'fail') AS f FROM long GROUP BY 1, 2)"


@query(f"WITH {SQL_TOKENS}, {SQL_SEO}, {SQL_LONG}, {SQL_SCORE} SELECT page_id, CAST(floor(p * 100.0 / n + 0.5) AS INTEGER) AS score, CAST(p AS INTEGER) AS passed, CAST(w AS INTEGER) AS warnings, CAST(f AS INTEGER) AS failed FROM score")
def c14_seo_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seo.seo_score(seo.seo_checks(base(spark, sf_dir))).select("page_id", "seo_score.*")


@query(f"""WITH {SQL_TOKENS}, {SQL_SEO}, {SQL_LONG} SELECT id AS "check", count(*) FILTER (WHERE status = 'pass') AS pass, count(*) FILTER (WHERE status = 'warning') AS warning, count(*) FILTER (WHERE status = 'fail') AS fail FROM long GROUP BY 1""")
def c15_seo_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seo.seo_rollup(seo.seo_checks(base(spark, sf_dir)))


@query(f"""WITH {SQL_TOKENS}, {SQL_SEO}, {SQL_LONG}, {SQL_SCORE} SELECT {_HOST.format('url')} AS host, count(*) AS pages, round(avg(floor(p * 100.0 / n + 0.5)), 6) AS mean_score FROM score GROUP BY ROLLUP (host)""")
def c15_host_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seo.host_scores(seo.seo_score(seo.seo_checks(base(spark, sf_dir))), extract.host(F.col("url")))
    return out.withColumn("mean_score", F.round("mean_score", 6))


def _in(words, text: str = "low") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


_TEXTS = "list_transform(regexp_extract_all(bare, '(?is)<(?:a|button)(?:\\s[^>]*)?>([^<]*)', 1), lambda x: lower(trim(" + _decoded("x") + ")))"
_AT = "strpos(low, 'type=\"email\"')"
SQL_UX = f"""ux AS (SELECT *, {_TEXTS} AS texts, CAST(len(list_filter({_TEXTS}, lambda x: {_in(ux.CTA, 'x')})) AS INTEGER) AS cta_count, {_n('form')} AS form_count, {_in(ux.SOCIAL_PROOF)} AS social_proof,
  ({' + '.join(f"CAST(contains(low, '{w}') AS INTEGER)" for w in ux.TRUST)}) >= 2 AS trust_signals,
  contains(bare, 'href="mailto:') OR len(list_filter(regexp_extract_all(low, '\\+?\\d[\\d\\s\\x0B\\-()]{{8,19}}'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 7 AND 15)) > 0 AS contact_info,
  contains(bare, 'name="viewport"') AS mobile_ready, contains(low, 'src="https://www.youtube.com') AS video, contains(bare, 'href="/privacy"') AS privacy_policy, {_in(ux.COOKIE_BANNER)} AS cookie_banner, {_in(ux.LIVE_CHAT)} AS live_chat,
  {_AT} > 0 AND {_in(ux.NEWSLETTER, f'substring(low, CAST(greatest(1, {_AT} - 500) AS BIGINT), CAST(least({_AT} - 1, 500) + 500 AS BIGINT))')} AS newsletter FROM seo)"""
_UX = "cta_count > 0 AS has_cta, cta_count, form_count > 0 AS has_forms, form_count, social_proof, trust_signals, contact_info, mobile_ready, video, privacy_policy, cookie_banner, live_chat, newsletter"


@query(f"WITH {SQL_TOKENS}, {SQL_SEO}, {SQL_UX} SELECT page_id, {_UX} FROM ux")
def u1_u7_ux_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ux.ux_signals(base(spark, sf_dir)).select("page_id", "ux.*")


_READ = f"""read AS (SELECT ux.*, {_n('h1')} AS h1, {_BLOCKING} AS blocking, {_n('script')} AS scripts, coalesce({_FIRST}, '') AS od,
  list_filter(list_transform(string_split_regex(text, '[.!?]+\\s+'), lambda x: len(list_filter(string_split_regex(x, '{SPACES}+'), lambda w: w <> ''))), lambda n: n >= 8) AS sl,
  list_transform(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) >= 4 AND w NOT IN ({_STOP})), lambda w: length(w)) AS wl FROM ux),
lv AS (SELECT *, coalesce(floor(list_sum(sl) / nullif(len(sl), 0)), 0) AS sw, coalesce(floor(list_sum(wl) / nullif(len(wl), 0)), 0) AS wc FROM read),
conv AS (SELECT *, CASE WHEN sw > 32 OR sw > 22 AND wc >= 7 THEN 'advanced' ELSE 'other' END AS lev FROM lv),
cs AS (SELECT *, CASE WHEN h1 = 1 THEN 28 ELSE 0 END + CASE WHEN s_meta_desc = 'pass' THEN 24 ELSE 0 END + CASE WHEN s_title = 'pass' THEN 20 ELSE 0 END + CASE WHEN cta_count > 0 THEN 18 ELSE 0 END + CASE WHEN lev <> 'advanced' THEN 10 ELSE 0 END AS clarity,
  CASE WHEN s_https = 'pass' THEN 25 ELSE 0 END + CASE WHEN privacy_policy THEN 20 ELSE 0 END + CASE WHEN trust_signals THEN 20 ELSE 0 END + CASE WHEN contact_info THEN 20 ELSE 0 END + CASE WHEN social_proof THEN 15 ELSE 0 END AS trust,
  CASE WHEN cta_count > 0 THEN 50 ELSE 0 END + CASE WHEN cta_count >= 3 THEN 20 ELSE 0 END + CASE WHEN form_count > 0 THEN 20 ELSE 0 END + CASE WHEN newsletter THEN 10 ELSE 0 END AS cta,
  greatest(0, 100 - CASE WHEN blocking >= 3 THEN 25 WHEN blocking >= 1 THEN 10 ELSE 0 END - CASE WHEN scripts > 12 THEN 15 ELSE 0 END - CASE WHEN lev = 'advanced' THEN 15 ELSE 0 END - CASE WHEN cta_count = 0 THEN 15 ELSE 0 END - CASE WHEN NOT mobile_ready THEN 15 ELSE 0 END) AS friction FROM conv),
ov AS (SELECT *, CAST(floor((clarity * 30 + trust * 25 + cta * 30 + friction * 15) / 100) AS INTEGER) AS overall FROM cs)"""
SQL_OVER = f"{SQL_TOKENS}, {SQL_SEO}, {SQL_UX}, {_READ}"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with all that the insight layer reads, but for technologies. The analyses are staged without the tokens, as the audit's are, so that what asks for them more than once doesn't compute them again."""
    df = staged(base(spark, sf_dir), "page-tokens")
    for step in (extract.page_links, extract.page_stats, extract.overview, extract.readability, seo.seo_checks, seo.seo_score, ux.ux_signals):
        df = step(df)
    return insights.conversion_scores(insights.with_status(staged(df.drop(*audit.HEAVY, "links"), "page-analyses")))


@query(f"WITH {SQL_OVER} SELECT page_id, overall, clarity, trust, cta, friction FROM ov")
def i3_conversion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("page_id", *[f"conversion.{k}" for k in ("overall", "clarity", "trust", "cta", "friction")])


@query(f"""WITH {SQL_OVER} SELECT page_id, strlen(title) >= 15 AND (h1 = 1 OR strlen(od) >= 50) AS offer_clear, cta_count > 0 AS cta_clear,
  CASE WHEN s_https = 'pass' AND trust_signals AND privacy_policy OR trust_signals AND social_proof THEN 'strong' WHEN NOT trust_signals AND NOT social_proof AND NOT contact_info THEN 'weak' ELSE 'moderate' END AS trust_level,
  blocking >= 3 OR scripts > 12 AS heavy_page, strlen(od) >= 50 AS value_clear FROM ov""")
def i2_customer_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.customer_view(scored(spark, sf_dir)).select("page_id", "customer.*")


@query(f"""WITH {SQL_OVER}, f AS (SELECT page_id, CASE WHEN h1 = 1 THEN 2 ELSE 0 END + CASE WHEN cta_count > 0 THEN 2 ELSE 0 END + CAST(s_https = 'pass' AS INTEGER) + CAST(s_meta_desc = 'pass' AS INTEGER) + CAST(mobile_ready AS INTEGER)
  + CAST(trust_signals OR social_proof AS INTEGER) + CAST(strlen(od) >= 50 AS INTEGER) + CAST(blocking = 0 AND scripts <= 8 AS INTEGER) AS score FROM ov)
SELECT page_id, CAST(score AS INTEGER) AS score, CASE WHEN score <= 2 THEN 'Poor' WHEN score <= 4 THEN 'Weak' WHEN score <= 6 THEN 'Fair' WHEN score <= 8 THEN 'Good' ELSE 'Strong' END AS label FROM f""")
def i4_first_impression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.first_impression(scored(spark, sf_dir)).select("page_id", "impression.*")


_CREDIT = "NOT trust_signals AND NOT social_proof"


@query(f"""WITH {SQL_OVER} SELECT page_id, CASE WHEN s_robots = 'fail' THEN 'noindex' WHEN s_https = 'fail' THEN 'https' WHEN cta_count = 0 THEN 'cta' WHEN s_h1_count = 'fail' THEN 'h1' WHEN s_title = 'fail' THEN 'title'
  WHEN blocking >= 3 THEN 'render_blocking' WHEN {_CREDIT} THEN 'credibility' WHEN s_img_alt = 'fail' THEN 'img_alt' WHEN s_meta_desc = 'fail' THEN 'meta_desc' WHEN NOT contact_info THEN 'contact' ELSE 'structure' END AS opportunity FROM ov""")
def i5_opportunity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.opportunity(scored(spark, sf_dir)).select("page_id", "opportunity")


def _sql_list(rules: dict[str, str], most: int) -> str:
    return f"list_slice(list_filter([{', '.join(f'CASE WHEN {w} THEN {chr(39)}{k}{chr(39)} END' for k, w in rules.items())}], lambda x: x IS NOT NULL), 1, {most})"


_ISSUES = {
    "noindex": "s_robots = 'fail'", "https": "s_https = 'fail'", "cta": "cta_count = 0", "h1": "s_h1_count = 'fail'", "title": "s_title = 'fail'", "render_blocking": "blocking >= 3", "img_alt_most": "s_img_alt = 'fail'",
    "credibility": _CREDIT, "meta_desc": "s_meta_desc = 'fail'", "canonical": "s_canonical = 'fail'", "img_alt_some": "s_img_alt = 'warning'", "og_tags": "s_og_tags = 'fail'", "contact": "NOT contact_info",
}


@query(f"WITH {SQL_OVER}, x AS (SELECT page_id, {_sql_list(_ISSUES, 5)} AS l FROM ov) SELECT page_id, CAST(unnest(generate_series(1, len(l))) AS INTEGER) AS rank, unnest(l) AS id FROM x")
def i7_prioritized_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unnested(insights.prioritized_issues(scored(spark, sf_dir)), F.col("issues"), "page_id").select("page_id", "item.*")


_FINDINGS = {
    "https": "s_https = 'fail'", "noindex": "s_robots = 'fail'", "title_missing": "s_title = 'fail'", "title_length": "s_title = 'warning'", "desc_missing": "s_meta_desc = 'fail'", "desc_length": "s_meta_desc = 'warning'",
    "h1_missing": "s_h1_count = 'fail'", "h1_many": "s_h1_count = 'warning'", "img_alt": "s_img_alt <> 'pass'", "canonical": "s_canonical = 'fail'", "og_tags": "s_og_tags = 'fail'", "schema": "s_schema = 'fail'",
    "viewport": "s_viewport = 'fail'", "cta": "cta_count = 0", "credibility": _CREDIT, "contact": "NOT contact_info", "privacy": "NOT privacy_policy",
}


@query(f"WITH {SQL_OVER} SELECT page_id, unnest({_sql_list(_FINDINGS, 8)}) AS id FROM ov")
def i8_plain_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unnested(insights.plain_findings(scored(spark, sf_dir)), F.col("findings"), "page_id").select("page_id", F.col("item").alias("id"))


_WEAK = {
    "title_missing": "s_title = 'fail'", "title_length": "s_title = 'warning'", "desc_missing": "s_meta_desc = 'fail'", "desc_length": "s_meta_desc = 'warning'", "canonical": "s_canonical = 'fail'", "h1_missing": "s_h1_count = 'fail'",
    "h1_many": "s_h1_count = 'warning'", "img_alt": "s_img_alt <> 'pass'", "og_missing": "s_og_tags = 'fail'", "og_partial": "s_og_tags = 'warning'", "schema": "s_schema = 'fail'", "viewport": "s_viewport = 'fail'", "noindex": "s_robots = 'fail'",
    "https": "s_https = 'fail'", "mixed_content": "coalesce(s_mixed_content = 'warning', FALSE)", "cta": "cta_count = 0", "forms": "form_count = 0", "proof": "NOT social_proof", "trust": "NOT trust_signals", "contact": "NOT contact_info",
}


@query(f"WITH {SQL_OVER} SELECT page_id, unnest({_sql_list(_WEAK, 99)}) AS id FROM ov")
def i9_weak_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unnested(insights.weak_points(scored(spark, sf_dir)), F.col("weak_points"), "page_id").select("page_id", F.col("item").alias("id"))


def _performance(df: DataFrame) -> DataFrame:
    n = F.col("page_id")
    rating = lambda k: F.when(n % k == 0, "poor").when(n % k == 1, "needs-improvement").otherwise("good")
    mobile, desktop = F.when(n % 3 > 0, (n * 7 % 101).cast("int")), F.when(n % 3 == 1, 50)
    return df.withColumn("performance", F.struct(mobile.alias("mobile"), desktop.alias("desktop"), rating(4).alias("lcp"), rating(5).alias("cls"), rating(6).alias("tbt"))).withColumn("broken_links", F.col("page_id") % 2)


_SIX = " + ".join(f"CAST({x} AS INTEGER)" for x in ("cta_count > 0", "form_count > 0", "social_proof", "trust_signals", "contact_info", "mobile_ready"))
SQL_ALL = f"""{SQL_OVER}, {SQL_LONG}, {SQL_SCORE}, al AS (SELECT ov.*, CAST(floor(p * 100.0 / n + 0.5) AS INTEGER) AS sscore, CAST(floor(({_SIX}) * 100 / 6 + 0.5) AS INTEGER) AS uscore,
  CASE WHEN ov.page_id % 3 > 0 THEN CAST(ov.page_id * 7 % 101 AS INTEGER) ELSE -1 END AS pscore FROM ov JOIN score ON score.page_id = ov.page_id),
sc AS (SELECT *, CAST(CASE WHEN pscore >= 0 THEN floor((sscore + uscore + pscore + overall) / 4 + 0.5) ELSE floor((sscore + uscore + overall) / 3 + 0.5) END AS INTEGER) AS total FROM al)"""


@query(f"WITH {SQL_ALL} SELECT page_id, total AS overall, sscore AS seo, uscore AS ux, pscore AS performance, overall AS conversion FROM sc")
def i10_overall_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.overall_scores(_performance(scored(spark, sf_dir))).select("page_id", "scores.*")


def _sentence(rules) -> str:
    return f"list_filter([{', '.join(f'CASE WHEN {w} THEN {k} END' for k, w in rules)}], lambda x: x IS NOT NULL)"


@query(f"""WITH {SQL_ALL}, y AS (SELECT page_id, {_sentence([("'search basics'", 'sscore >= 75'), ("'speed'", 'pscore >= 75'), ("'usability'", 'uscore >= 75'), ("'conversion'", 'overall >= 65')])} AS s,
  {_sentence([("'search basics'", 'sscore < 50'), ("'speed'", 'pscore BETWEEN 0 AND 49'), ("'usability'", 'uscore < 50'), ("'conversion'", 'overall < 45'), ("'phones'", 'NOT mobile_ready'), ("page_id % 2 || ' broken links'", 'page_id % 2 > 0')])} AS w FROM sc)
SELECT page_id, CASE WHEN len(s) = 0 AND len(w) = 0 THEN 'Fair in all areas.' WHEN len(s) = 0 THEN 'Weak: ' || array_to_string(w, ', ') || '.' WHEN len(w) = 0 THEN 'Strong: ' || array_to_string(s, ' and ') || '.'
  ELSE 'Strong: ' || array_to_string(s, ' and ') || '; weak: ' || array_to_string(w, ', ') || '.' END AS summary FROM y""")
def i15_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.summary(insights.overall_scores(_performance(scored(spark, sf_dir)))).select("page_id", "summary")


@query(f"""WITH {SQL_OVER}, b AS (SELECT page_id, list_filter([CASE WHEN clarity < 40 THEN {{'id': 'clarity', 'severity': 'critical'}} END, CASE WHEN trust < 40 THEN {{'id': 'trust', 'severity': 'critical'}} END,
  CASE WHEN cta_count = 0 OR cta < 40 THEN {{'id': 'cta', 'severity': 'critical'}} END, CASE WHEN friction > 65 THEN {{'id': 'friction', 'severity': 'warning'}} END, CASE WHEN NOT social_proof THEN {{'id': 'social-proof', 'severity': 'warning'}} END,
  CASE WHEN NOT privacy_policy THEN {{'id': 'privacy', 'severity': 'warning'}} END, CASE WHEN NOT trust_signals AND trust >= 40 THEN {{'id': 'trust-signals', 'severity': 'info'}} END], lambda x: x IS NOT NULL) AS l FROM ov),
u AS (SELECT page_id, CAST(unnest(generate_series(1, len(l))) - 1 AS INTEGER) AS nth, unnest(l) AS x FROM b) SELECT page_id, nth, x.id AS id, x.severity AS severity FROM u""")
def i13_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unnested(insights.blockers(scored(spark, sf_dir)), F.col("blockers"), "page_id").select("page_id", "nth", "item.*")


@query(f"""WITH {SQL_OVER} SELECT page_id, CASE WHEN cta <= trust AND cta <= clarity THEN 'cta' WHEN trust <= clarity THEN 'trust' ELSE 'clarity' END AS id, CAST(least(cta, trust, clarity) AS INTEGER) AS score,
  CAST(cta < 50 AS INTEGER) + CAST(trust < 50 AS INTEGER) + CAST(clarity < 50 AS INTEGER) + CAST(friction < 40 AS INTEGER) AS n_blockers FROM ov""")
def i14_weakest_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.weakest_dimension(scored(spark, sf_dir)).select("page_id", "weakest.*", F.size("score_blockers").alias("n_blockers"))


def stack_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tech.tech_stack(tech.tech_scores(tech.tech_matches(crawl(spark, sf_dir), tech.core_rules(spark))))


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = crawl(spark, sf_dir)
    n = F.col("page_id")
    speed = F.to_json(F.struct(F.struct(F.create_map(F.lit("performance"), F.struct(((n * 7 % 101) / 100).alias("score"))).alias("categories"), F.create_map(F.lit("largest-contentful-paint"), F.struct((n % 5 * 1000.0).alias("numericValue"))).alias("audits")).alias("lighthouseResult")))
    speeds = pages.select("page_id", F.when(n % 3 > 0, speed).alias("mobile"), speed.alias("desktop"))
    return audit.audit_pages(pages, moment(), tech.core_rules(spark), page_headers(pages), speeds)


def _p(group: str) -> str:
    return _in(insights.PHRASES[group])


def _t(group: str) -> str:
    return _in(insights.NAMES[group], "td")


def _pts(*parts: tuple[str, int]) -> str:
    return " + ".join(f"CASE WHEN {w} THEN {n} ELSE 0 END" for w, n in parts)


# The pages hold technologies of media and analytics only, so that rules on shops and frameworks don't fire.
SQL_INTENT = f"""{SQL_OVER}, {_LINKS}, lk AS (SELECT page_id, count(*) FILTER (WHERE kind = 'internal') AS ins, count(*) FILTER (WHERE kind = 'external') AS ext FROM kinds GROUP BY 1),
q AS (SELECT ov.*, lower(title || od) AS td, coalesce(ins, 0) AS ins, coalesce(ext, 0) AS ext, {_n('h2')} AS h2, coalesce(list_sum(list_transform(nodes, lambda x: len(string_split_regex(x, '{SPACES}+')))), 0) AS words FROM ov LEFT JOIN lk ON lk.page_id = ov.page_id),
pt AS (SELECT *, CASE WHEN {_p('cart')} AND {_p('checkout')} THEN 5 WHEN {_p('cart')} THEN 4 ELSE 0 END AS ecommerce, {_pts((_p('trial'), 4), (_p('subscription'), 4), (_p('signup') + ' AND ' + _t('software'), 3))} AS saas,
  {_pts((_t('portfolio'), 4), (_p('person') + ' AND ' + _p('creative'), 4), (_p('work'), 2))} AS portfolio, {_pts((_p('published'), 4), (_p('dated'), 3), (_p('replies') + ' AND words > 800', 3), (_p('posts'), 3))} AS blog,
  {_pts((_p('urgency') + ' AND (ins <= 4 OR cta_count >= 4)', 4), (_p('assurance') + ' AND cta_count >= 4', 3))} + CASE WHEN ins <= 4 AND words < 500 AND cta_count >= 4 THEN 4 WHEN ins <= 4 AND words < 500 THEN 2 ELSE 0 END AS landing,
  {_pts((_p('services'), 3), (_t('service'), 3), ('form_count > 0 AND contact_info', 2), (_p('clients'), 2))} AS service, {_pts(*[(_p(g), 1) for g in ('about', 'careers', 'press', 'investors')])} AS parts FROM q),
it AS (SELECT *, CASE WHEN ecommerce >= 5 THEN 'ecommerce/store' WHEN saas >= 5 THEN 'saas/web app' WHEN portfolio >= 4 THEN 'portfolio/portfolio' WHEN blog >= 4 THEN 'blog/blog' WHEN landing >= 4 THEN 'landing/landing page'
  WHEN service >= 5 THEN 'service/service business' WHEN CASE WHEN parts >= 2 THEN parts * 2 ELSE 0 END + {_pts((_t('company'), 2), ('ins > 25 AND words > 1000', 1))} >= 5 THEN 'corporate/corporate site'
  WHEN contains(low, 'youtube.com/embed') AND ext > 10 AND h2 > 5 THEN 'media/news site' WHEN cta_count > 0 AND form_count > 0 AND contact_info THEN 'service/business site' WHEN words > 1500 AND h2 > 4 THEN 'blog/informational site'
  WHEN cta_count >= 2 THEN 'landing/promotional site' ELSE 'general/general site' END AS it FROM pt)"""


@query(f"""WITH {SQL_INTENT} SELECT page_id, split_part(it, '/', 1) AS category, split_part(it, '/', 2) AS label, CASE split_part(it, '/', 1) WHEN 'ecommerce' THEN CASE WHEN {_CREDIT} THEN 'store_without_proof' ELSE 'store' END
  WHEN 'saas' THEN CASE WHEN form_count = 0 THEN 'saas_without_signup' ELSE 'saas' END WHEN 'portfolio' THEN CASE WHEN NOT contact_info THEN 'portfolio_without_contact' ELSE 'portfolio' END
  WHEN 'service' THEN CASE WHEN NOT contact_info THEN 'service_without_contact' ELSE 'service' END WHEN 'blog' THEN 'blog' WHEN 'landing' THEN 'landing' WHEN 'corporate' THEN 'corporate' ELSE 'unclear' END AS positioning FROM it""")
def i1_i6_page_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).select("page_id", "intent.*", "positioning")


def _claims(found: bool) -> str:
    return " + ".join(f"CAST({_says(w)}{' AND ' + _BORNE[k] if found else ''} AS INTEGER)" for k, w in extract.CLAIMS.items())


_FIX = {
    "low-intent": "floor(found * 100 / nullif(claims, 0)) < 50", "lcp-poor": "page_id % 3 > 0 AND page_id % 5 = 4", "lcp-fair": "page_id % 3 > 0 AND page_id % 5 = 3", "perf-poor": "pscore BETWEEN 0 AND 49", "perf-fair": "pscore BETWEEN 50 AND 74",
    "image-format": f"coalesce(floor(len(list_filter({_IMG}, lambda x: contains(x, '.webp'))) * 100 / nullif(len({_IMG}), 0)), 0) < 50", "lazy-loading": f"len(list_filter({_IMG}, lambda x: NOT contains(x, 'lazy'))) > 3",
    "render-blocking": "blocking > 2", "no-cta": "cta_count = 0", "no-trust": "NOT trust_signals", "no-social-proof": "NOT social_proof", "not-mobile": "NOT mobile_ready", "no-contact": "NOT contact_info", "no-privacy": "NOT privacy_policy",
    "low-clarity": "clarity < 40", "low-trust-score": "trust < 40", "high-friction": "friction > 65", "generic-copy": "text <> '' AND 100 - 15 * vague + 8 * hints < 50", "vague-copy": "NOT (text <> '' AND 100 - 15 * vague + 8 * hints < 50) AND vague > 2",
    "security-headers": "page_id % 2 <> 0 AND page_id % 3 <> 0 AND page_id % 7 <> 0", "complex-content": "lev = 'advanced'",
    "stale-content": "page_id IN (SELECT page_id FROM stale)",
}
_ORDER = list(insights.FIXES)


def _fix_struct(when: str, id_: str, impact: str, effort: str, urgency: int, category: str, place: int) -> str:
    label = "fix-now" if urgency >= 90 or urgency >= 80 and effort != "hard" else "fix-soon" if urgency >= 60 else "optional"
    return f"CASE WHEN {when} THEN {{'id': '{id_}', 'impact': '{impact}', 'effort': '{effort}', 'priority': '{label}', 'category': '{category}', 'urgency': {urgency}, 'place': {place}}} END"


_FIX_ROWS = ", ".join(
    [_fix_struct(f"s_{k} = 'fail'", f"seo-fail-{k}", "high", "easy", 84, "seo", i) for i, k in enumerate(_CHECKS)]
    + [_fix_struct(f"s_{k} = 'warning'", f"seo-warn-{k}", "medium", "easy", 55, "seo", 100 + i) for i, k in enumerate(_CHECKS)]
    + [_fix_struct(w, k, *insights.FIXES[k], 200 + _ORDER.index(k)) for k, w in _FIX.items()]
)
SQL_FIXES = f"""{SQL_ALL}, stale AS (SELECT page_id FROM ({ORACLES['e11_freshness']}) WHERE rating = 'stale'), fc AS (SELECT *, lower(title || ' ' || description) AS c, {_VAGUE} AS vague, {_HINTS} AS hints FROM sc), fd AS (SELECT *, {_claims(False)} AS claims, {_claims(True)} AS found FROM fc),
fx AS (SELECT page_id, unnest([{_FIX_ROWS}]) AS f FROM fd), fixes AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY f.urgency DESC, f.place) - 1 AS INTEGER) AS nth, f FROM fx WHERE f IS NOT NULL)"""


@query(f"WITH {SQL_FIXES} SELECT page_id, nth, f.id AS id, f.impact AS impact, f.effort AS effort, f.priority AS priority, f.category AS category, CAST(f.urgency AS INTEGER) AS urgency FROM fixes")
def i11_fix_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unnested(audited(spark, sf_dir), F.col("fixes"), "page_id").select("page_id", "nth", "item.*")


@query(f"""WITH {SQL_FIXES} SELECT page_id, list_slice(list(f.id ORDER BY nth), 1, 5) AS fix_first, list_slice(list(f.id ORDER BY nth) FILTER (WHERE f.effort = 'easy'), 1, 3) AS quick_wins,
  CAST(count(*) FILTER (WHERE f.impact = 'high') AS INTEGER) AS high_impact, CAST(count(*) FILTER (WHERE f.category = 'seo') AS INTEGER) AS seo FROM fixes GROUP BY page_id""")
def i12_fix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda c: F.transform(c, lambda x: x["id"])
    return audited(spark, sf_dir).select("page_id", ids(insights.fix_first()).alias("fix_first"), ids(insights.quick_wins()).alias("quick_wins"), F.size(insights.high_impact()).alias("high_impact"), F.size(insights.of_category("seo")).alias("seo"))


@query(f"""WITH {SQL_FIXES} SELECT f.category AS category, f.priority AS priority, CAST(grouping(f.category, f.priority) AS BIGINT) AS level, count(*) AS issues, count(DISTINCT page_id) AS pages FROM fixes GROUP BY CUBE (f.category, f.priority)""")
def i16_issue_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.issue_prevalence(audited(spark, sf_dir)).withColumn("level", F.col("level").cast("long"))


@query()
def i17_audit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir)


@query(f"SELECT page_id, overall, score FROM ({ORACLES['i3_conversion_scores']}) JOIN ({ORACLES['c14_seo_score']}) USING (page_id)")
def s4_audit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payloads.to_audit_rows(scored(spark, sf_dir), ["page_id", "conversion", "seo_score"])
    return payloads.from_audit_json(rows.select("page_id", "result"), "page_id long, conversion struct<overall:int>, seo_score struct<score:int>").select("page_id", "audit.conversion.overall", "audit.seo_score.score")


@query()
def s7_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_report(audited(spark, sf_dir), moment()).select("page_id", "report")


def _sql_rules() -> str:
    """The table of rules as SQL: one row for each pattern."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = (f"({n}, {quoted(name)}, {quoted(category)}, {quoted(p.lower())}, {len(patterns)}, {every}, {tag_only})" for n, name, category, _, patterns, every, tag_only in tech.rule_rows() for p in patterns)
    return f"rules(rule, name, category, pattern, n, every, tag_only) AS (VALUES {', '.join(rows)})"


#: Technologies of a page: rules of which one pattern is in the page, or in its tags, or all are.
_TECH = f"""{SQL_CRAWL}, {_sql_rules()}, low AS (SELECT page_id, lower(html) AS h, regexp_replace('>' || lower(html), '>[^<]*(<|$)', '  ', 'g') AS tags FROM crawl),
held AS (SELECT page_id, rule, name, category, count(*) AS found, any_value(n) AS n, any_value(every) AS every FROM low JOIN rules ON contains(CASE WHEN tag_only THEN tags ELSE h END, pattern) GROUP BY ALL),
x AS (SELECT DISTINCT page_id, name, category FROM held WHERE NOT every OR found = n)"""


@query(f"WITH {_TECH} SELECT DISTINCT page_id, name FROM x")
def t1_tech_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tech.tech_matches(crawl(spark, sf_dir), tech.core_rules(spark)).select("page_id", "name").distinct()


#: Hosts under suffixes of one to four labels, wildcards and exceptions among them, and suffixes themselves.
_HOSTS = (
    "example.com", "a{n}.com.pl", "www.b{n}.com.pl", "c{n}.vercel.app", "x.c{n}.vercel.app", "www.ck", "shop.www.ck", "d{n}.co.ck", "co.ck", "www.e{n}.f.kobe.jp", "city.kobe.jp", "info.city.kobe.jp", "g{n}.co.uk", "co.uk", "uk", "www.h{n}.de", "localhost",
    "a.b.i{n}.s3.amazonaws.com", "j{n}.eu.compute.amazonaws.com", "eu.compute.amazonaws.com", "k{n}.unknown", "..com", "127.0.0.{n}",
)


def _host(concat) -> str:
    cases = " ".join(f"WHEN {k} THEN {concat(h.split('{n}'))}" for k, h in enumerate(_HOSTS))
    return f"CASE page_id % {len(_HOSTS) + 1} {cases} ELSE regexp_extract(url, '://([^/:?#]*)', 1) END"


_SITE_HOST = _host(lambda parts: " || (page_id % 3) || ".join(f"'{x}'" for x in parts))


def _sql_suffixes() -> str:
    return "suffixes(key, kind) AS (VALUES " + ", ".join(f"('{key}', '{kind}')" for key, kind in common_rules()) + ")"


@query(f"""WITH {_sql_suffixes()}, x AS (SELECT page_id, {_SITE_HOST} AS host FROM pages), h AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM x),
c AS (SELECT host, l, k, array_to_string(l[len(l) - k + 1:], '.') AS key FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS k FROM h)),
f AS (SELECT host, any_value(l) AS l, max(CASE WHEN kind = 'exception' THEN k - 1 END) AS excepted, max(CASE WHEN kind = 'name' THEN k WHEN kind = 'wildcard' AND k < len(l) THEN k + 1 END) AS n FROM c LEFT JOIN suffixes USING (key) GROUP BY host)
SELECT page_id, host, CASE WHEN list_contains(l, '') OR len(l) <= coalesce(excepted, n, 1) THEN host ELSE array_to_string(l[len(l) - coalesce(excepted, n, 1):], '.') END AS site FROM x JOIN f USING (host)""")
def t1_site_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = t.table(spark, sf_dir, "pages").select("page_id", F.expr(_SITE_HOST).alias("host"))
    return with_sites(hosts, "host", common_suffixes(spark))


@query()
def t2_tech_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tech.tech_scores(tech.tech_matches(crawl(spark, sf_dir), tech.core_rules(spark))).drop("signals")


@query()
def t3_tech_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack_of(spark, sf_dir).select("page_id", "name", "category", "score", "confidence", "found", "shown")


#: Matches of 23 rules with 17 names, four patterns each, by user: every mix of evidence, origin and prior.
_MATCHES = """SELECT DISTINCT user_id AS page_id, CAST(1 + event_id % 23 AS INT) AS rule, concat('T', CAST((1 + event_id % 23) % 17 AS STRING)) AS name,
  CASE event_id % 23 % 4 WHEN 0 THEN 'cms' WHEN 1 THEN 'framework' WHEN 2 THEN 'analytics' ELSE 'cdn' END AS category, CASE event_id % 23 % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, 4 AS n_patterns,
  event_id % 23 % 5 = 0 AS require_all, concat('p', CAST(event_id % 4 AS STRING)) AS pattern, 'x' AS match, CASE event_id % 4 WHEN 0 THEN 'explicit' WHEN 1 THEN 'weak' ELSE 'indirect' END AS evidence_type,
  CAST(CASE event_id % 4 WHEN 0 THEN 92 WHEN 1 THEN 24 ELSE 55 END AS INT) AS strength, CASE (user_id + event_id % 23 + event_id % 4) % 3 WHEN 0 THEN 'first-party' WHEN 1 THEN 'third-party' ELSE 'unknown' END AS source FROM events"""
_SCORES = f"""m AS ({_MATCHES.replace("AS STRING", "AS VARCHAR").replace("AS INT)", "AS INTEGER)")}),
g AS (SELECT page_id, rule, name, category, confidence AS prior, n_patterns, require_all, count(*) AS n, max(strength) AS top, sum(strength) AS total, count(*) FILTER (WHERE evidence_type = 'explicit') AS strong,
  count(*) FILTER (WHERE source = 'first-party') AS own, count(*) FILTER (WHERE source = 'third-party') AS other FROM m GROUP BY ALL),
a AS (SELECT *, category IN ('cms', 'framework') AS built, CAST(floor((0.7::DOUBLE * top + 0.3::DOUBLE * (total // n)) * 0.75::DOUBLE + n / n_patterns::DOUBLE * 25.0::DOUBLE) AS BIGINT) + CASE WHEN require_all THEN 4 ELSE 0 END + CASE WHEN n > 1 THEN 3 ELSE 0 END
  + CASE prior WHEN 'high' THEN 3 WHEN 'low' THEN -3 ELSE 0 END AS s0 FROM g),
b AS (SELECT *, s0 + CASE WHEN built AND own > 0 THEN 8 ELSE 0 END - CASE WHEN built AND other = n THEN 18 ELSE 0 END AS s1 FROM a),
c AS (SELECT *, greatest(0, least(100, s1, CASE WHEN built AND strong = 0 OR prior = 'medium' THEN 69 ELSE 1000 END, CASE WHEN category = 'cms' AND n = 1 AND other = 1 OR prior = 'low' THEN 39 ELSE 1000 END)) AS score FROM b),
d AS (SELECT *, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS label FROM c)"""


def matches_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_MATCHES.replace("FROM events", "FROM {events}"), events=t.table(spark, sf_dir, "events"))


@query(f"WITH {_SCORES} SELECT page_id, rule, name, category, CAST(score AS INTEGER) AS score, label AS confidence FROM d")
def t2_scores_of_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tech.tech_scores(matches_of(spark, sf_dir)).drop("signals")


@query(f"""WITH {_SCORES}, e AS (SELECT *, min(rule) OVER (PARTITION BY page_id, name) AS first_rule, row_number() OVER (PARTITION BY page_id, name ORDER BY score DESC, rule) AS rn FROM d)
SELECT page_id, name, category, CAST(score AS INTEGER) AS score, label AS confidence, CAST(row_number() OVER (PARTITION BY page_id ORDER BY first_rule) AS INTEGER) AS found,
  CAST(row_number() OVER (PARTITION BY page_id ORDER BY CASE category WHEN 'cms' THEN 1 WHEN 'framework' THEN 4 WHEN 'analytics' THEN 5 ELSE 6 END, CASE label WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, first_rule) AS INTEGER) AS shown FROM e WHERE rn = 1""")
def t3_stack_of_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tech.tech_stack(tech.tech_scores(matches_of(spark, sf_dir))).select("page_id", "name", "category", "score", "confidence", "found", "shown")


@query("""SELECT page_id, page_id % 5 < 3 AS is_ai_built, CASE page_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE '' END AS confidence, CASE page_id % 5 WHEN 0 THEN 'Framer' WHEN 1 THEN 'Lovable' ELSE '' END AS builder,
  CASE page_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS n_signals FROM pages""")
def t4_ai_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    more = F.when(n % 5 == 0, '<script src="https://framerusercontent.com/a"></script> ai-generated').when(n % 5 == 1, '<meta name="generator" content="Lovable">').when(n % 5 == 2, "Powered by AI, AI-generated").otherwise("")
    out = tech.ai_builder(t.table(spark, sf_dir, "pages").withColumn("lower", F.lower(F.concat("html", more))))
    return out.select("page_id", "ai.is_ai_built", "ai.confidence", "ai.builder", F.size("ai.signals").alias("n_signals"))


@query(f"""WITH {_TECH}, tp AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Google Tag Manager' WHEN 1 THEN 'Hotjar' WHEN 2 THEN 'imgix' END AS name FROM pages)
SELECT page_id, name FROM x UNION SELECT page_id, name FROM tp WHERE name IS NOT NULL""")
def t5_merge_third_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    named = F.when(n % 4 == 0, "Google Tag Manager").when(n % 4 == 1, "Hotjar").when(n % 4 == 2, "Imgix").otherwise("Nobody")
    pages = t.table(spark, sf_dir, "pages")
    parties = pages.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("pos"), named.alias("entity"))
    return tech.merge_third_parties(stack_of(spark, sf_dir), parties, tech.core_entities(spark)).select("page_id", "name")


@query(f"WITH {_TECH} SELECT category, name, CAST(grouping(category, name) AS BIGINT) AS level, count(DISTINCT page_id) AS pages FROM x GROUP BY ROLLUP (category, name)")
def t6_tech_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tech.tech_adoption(stack_of(spark, sf_dir)).select("category", "name", F.col("level").cast("long").alias("level"), "pages")


#: Two crawls that overlap.
_CRAWLS = {"first": "page_id % 3 <> 0", "second": "page_id % 2 = 0"}
_BOTH = "(SELECT 1 AS crawl UNION ALL SELECT 2) c WHERE (crawl = 1 AND page_id % 3 <> 0 OR crawl = 2 AND page_id % 2 = 0)"


def of_crawls(rows: DataFrame, dims: list[str], cube: bool = False, sums: tuple = ()) -> DataFrame:
    """Partial results of two crawls, published one after the other and the first once more, rolled up together."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "rollups")
    for name in (*_CRAWLS, "first"):
        rollups.publish(rollups.partials(rows.where(_CRAWLS[name]), dims, sums=sums), path, name)
    return rollups.rolled(rollups.published(spark, path), dims, cube).withColumn("level", F.col("level").cast("long"))


@query(f"""WITH {SQL_TOKENS}, {SQL_SEO}, {SQL_LONG}, {SQL_SCORE}, h AS (SELECT page_id, {_HOST.format('url')} AS host, floor(p * 100.0 / n + 0.5) AS score FROM score)
SELECT host, CAST(grouping(host) AS BIGINT) AS level, count(*) AS n, count(DISTINCT page_id) AS pages, round(avg(score), 6) AS mean_score FROM h, {_BOTH} GROUP BY ROLLUP (host)""")
def c15_rollup_of_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = seo.seo_score(seo.seo_checks(base(spark, sf_dir))).select("page_id", extract.host(F.col("url")).alias("host"), F.col("seo_score.score").alias("score"))
    out = of_crawls(scored, ["host"], sums=("score",))
    return out.select("host", "level", "n", "pages", F.round(F.col("sum_score") / F.col("n"), 6).alias("mean_score"))


@query(f"WITH {_TECH} SELECT category, name, CAST(grouping(category, name) AS BIGINT) AS level, count(*) AS n, count(DISTINCT page_id) AS pages FROM x, {_BOTH} GROUP BY ROLLUP (category, name)")
def t6_rollup_of_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_crawls(stack_of(spark, sf_dir), ["category", "name"])


@query(f"""WITH {SQL_FIXES} SELECT f.category AS category, f.priority AS priority, CAST(grouping(f.category, f.priority) AS BIGINT) AS level, count(*) AS n, count(DISTINCT page_id) AS pages FROM fixes, {_BOTH} GROUP BY CUBE (f.category, f.priority)""")
def i16_rollup_of_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixes = staged(audited(spark, sf_dir).select("page_id", F.explode("fixes").alias("f")).select("page_id", "f.category", "f.priority"), "fixes")
    return of_crawls(fixes, ["category", "priority"], cube=True)


def _rate(metric: str, x: str) -> str:
    good, fair = tech.VITALS[metric]
    return f"CASE WHEN {x} < {good} THEN 'good' WHEN {x} < {fair} THEN 'needs-improvement' ELSE 'poor' END AS {metric}"


_VITAL = {"lcp": "value * 50", "fcp": "value * 40", "tbt": "value * 10", "cls": "value / 300", "si": "value * 60", "inp": "value * 8"}


@query(f"SELECT event_id, {', '.join(_rate(m, x) for m, x in _VITAL.items())} FROM events WHERE value IS NOT NULL")
def v1_vital_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.table(spark, sf_dir, "events").where("value is not null")
    return e.select("event_id", *[tech.vital_rating(m, F.expr(x)).alias(m) for m, x in _VITAL.items()])


def rdap_records(pages: DataFrame) -> DataFrame:
    """Domain records as JSON for all but .net hosts, made from the names of domains."""
    names = pages.select(payloads.rdap_domain(F.col("url")).alias("domain_name")).distinct()
    year = (2000 + F.length("domain_name") % 20).cast("string")
    record = F.concat(F.lit('{"events":[{"eventAction":"Registration","eventDate":"'), year, F.lit('-05-01T00:00:00Z"},{"eventAction":"expiration","eventDate":"2030-01-02T00:00:00Z"}],"entities":[{"roles":["Registrar"],"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text","Names of '), F.col("domain_name"), F.lit('"]]]}]}'))
    return names.select("domain_name", F.when(F.col("domain_name").endswith(".net"), "{not json").otherwise(record).alias("record"))


_DOMAIN = "regexp_extract(url, '([^./]+\\.[^./]+)(?:/.*)?$', 1)"
_DOMAINS = "d AS (SELECT page_id, url, regexp_extract(regexp_extract(url, '^https?://([^/?#]*)', 1), '([^.]+[.][^.]+)$', 1) AS domain_name FROM pages)"


@query(f"""WITH {_DOMAINS} SELECT DISTINCT domain_name, CASE WHEN domain_name NOT LIKE '%.net' THEN (2000 + length(domain_name) % 20) || '-05-01' END AS registered_at, CASE WHEN domain_name NOT LIKE '%.net' THEN '2030-01-02' END AS expires_at,
  CASE WHEN domain_name NOT LIKE '%.net' THEN 'Names of ' || domain_name END AS registrar, CASE WHEN domain_name NOT LIKE '%.net' THEN CAST(2024 - (2000 + length(domain_name) % 20) AS INTEGER) END AS age_years FROM d""")
def s9_parse_rdap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.parse_rdap(rdap_records(t.table(spark, sf_dir, "pages")), "record", moment()).select("domain_name", "domain.*")


@query(f"WITH {_DOMAINS} SELECT page_id, domain_name, CASE WHEN domain_name NOT LIKE '%.net' THEN 'Names of ' || domain_name END AS registrar FROM d")
def v2_enrich_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = t.table(spark, sf_dir, "pages")
    records = payloads.parse_rdap(rdap_records(pages), "record", moment()).select("domain_name", "domain")
    return payloads.enrich_domain(pages, records).select("page_id", "domain_name", "domain.registrar")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?', 'https') WHEN 2 THEN 'ftp://' || page_id || '.org' END AS url_norm,
  CASE page_id % 4 WHEN 2 THEN 'scheme' WHEN 3 THEN 'empty' END AS reject_reason FROM pages WHERE page_id % 5 < 4
UNION ALL SELECT page_id, 'https://u:p@x.org/', 'credentials' FROM pages WHERE page_id % 5 = 4""")
def s1_load_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    raw = F.when(n % 5 == 4, " u:p@x.org/").when(n % 4 == 0, F.col("url")).when(n % 4 == 1, F.concat(F.lit("  "), F.regexp_replace("url", "^https?://", ""))).when(n % 4 == 2, F.concat(F.lit("ftp://"), n.cast("string"), F.lit(".org"))).otherwise(" ")
    return load_pages(t.table(spark, sf_dir, "pages").select("page_id", raw.alias("url"))).select("page_id", "url_norm", "reject_reason")


_CODES = (200, 204, 301, 401, 403, 404, 418, 429, 503, 999)
_OUTCOMES = ("ok", "ok", "redirect_loop", "login_required", "denied", "not_found", "unexpected", "rate_limited", "server_error", "blocked")
_TEXT = ("context deadline exceeded", "lookup x: no such host", "connection refused", "stopped after 10 redirects", "x509: certificate expired", "what")
_KINDS = ("timeout", "dns", "connect", "redirects", "tls", "other")


@query(f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN [{', '.join(f"'{k}'" for k in _KINDS)}][page_id % 6 + 1] WHEN page_id % 7 = 1 AND [{', '.join(map(str, _CODES))}][page_id % 10 + 1] IN (200, 204) THEN 'not_html'
  ELSE [{', '.join(f"'{k}'" for k in _OUTCOMES)}][page_id % 10 + 1] END AS outcome FROM pages""")
def s2_classify_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    at = lambda items, k: F.element_at(F.array(*map(F.lit, items)), (n % k + 1).cast("int"))
    df = t.table(spark, sf_dir, "pages").select("page_id", "html", F.when(n % 3 == 0, at(_TEXT, 6)).alias("error"), at(_CODES, 10).alias("status"), F.when(n % 7 == 1, "image/png").otherwise("text/html; charset=utf-8").alias("content_type"))
    return classify_fetch(df).select("page_id", "outcome")


def speed_payloads(pages: DataFrame) -> DataFrame:
    n = F.col("page_id")
    text = F.concat(
        F.lit('{"lighthouseResult":{"categories":{"performance":{"score":0.'), F.lpad((n % 100).cast("string"), 2, "0"), F.lit('},"best-practices":{"score":0.875},"seo":{"score":null}},"audits":{"largest-contentful-paint":{"numericValue":'),
        (n % 50 * 100).cast("string"), F.lit(',"displayValue":"x"},"cumulative-layout-shift":{"numericValue":0.'), F.lpad((n % 40).cast("string"), 2, "0"),
        F.lit('},"third-parties-insight":{"details":{"items":[{"entity":"Hotjar","transferSize":12.0},{"entity":""}]}}}},"loadingExperience":{"initial_url":"x","metrics":{"CUMULATIVE_LAYOUT_SHIFT_SCORE":{"percentile":'), (n % 30).cast("string"), F.lit(',"category":"FAST"}}}}'),
    )
    return pages.select("page_id", F.when(n % 9 == 0, "<html>").otherwise(text).alias("payload"))


@query(f"""SELECT page_id, CAST(page_id % 100 AS INTEGER) AS performance, 88 AS best_practices, 0 AS seo, CAST(page_id % 50 * 100 AS DOUBLE) AS lcp, {_rate('lcp', 'page_id % 50 * 100').replace('AS lcp', 'AS lcp_rating')},
  {_rate('cls', 'page_id % 40 / 100.0').replace('AS cls', 'AS cls_rating')}, {_rate('cls', 'page_id % 30 / 100.0').replace('AS cls', 'AS field_cls')}, 1 AS n_parties FROM pages WHERE page_id % 9 <> 0
UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM pages WHERE page_id % 9 = 0""")
def s8_parse_pagespeed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = payloads.parse_pagespeed(speed_payloads(t.table(spark, sf_dir, "pages")), "payload")
    return out.select(
        "page_id", "speed.performance", "speed.best_practices", "speed.seo", F.col("speed.lcp.value").alias("lcp"), F.col("speed.lcp.rating").alias("lcp_rating"), F.col("speed.cls.rating").alias("cls_rating"), F.col("speed.field_cls.rating").alias("field_cls"),
        F.when(F.col("speed").isNotNull(), F.size("speed.third_parties")).alias("n_parties"),
    )


@query(f"""WITH {t.SQL_AUDITS} SELECT id, url, coalesce(duration_ms, 0) AS duration_ms FROM audits WHERE id % 2 = 0 UNION ALL SELECT id, url || 'new', coalesce(duration_ms, 0) FROM audits WHERE id % 2 = 1 AND id % 3 = 0""")
def s5_append_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits = t.audits(spark, sf_dir).withColumn("duration_ms", F.coalesce("duration_ms", F.lit(0)))
    new = audits.where("id % 3 = 0").withColumn("url", F.concat("url", F.lit("new")))
    return payloads.append_audits(audits.where("id % 2 = 0"), new.unionByName(new)).select("id", "url", "duration_ms")
