"""What a page holds: overview, counters, links, images, colours, fonts, dates, copy and headers.

All functions read the columns of ``tokens.prepared`` and add columns; nothing is shuffled
unless a function says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .page_marks import ACTION, COMPARISON, STEP_LIST, VIDEO_MARKS, holds, with_marks
from .tokens import SPACE, attr, contains_any, first_filled, last, pick, unnested, values


def count(tags: Column) -> Column:
    return F.size(tags)


def host(url: Column) -> Column:
    """Host without port, in lower case; "" if there is none."""
    authority = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))


def overview(df: DataFrame) -> DataFrame:
    """``overview``: title, description (the first filled of description and og:description), favicon, language and weight class."""
    described = pick("meta", lambda t: (F.lower(attr(t, "name")) == "description") | (F.lower(attr(t, "property")) == "og:description"))
    icons = pick("link", lambda t: F.lower(attr(t, "rel")).isin("icon", "shortcut icon"))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    weight = F.when(size < 50_000, "lightweight").when(size < 200_000, "medium").otherwise("heavy")
    language = F.get(F.split(last(F.filter(values(pick("html"), "lang"), lambda x: x != "")), "-"), 0)
    return df.withColumn("overview", F.struct("title", first_filled(values(described, "content")).alias("description"), first_filled(values(icons, "href")).alias("favicon"), language.alias("language"), weight.alias("load_hint")))


#: Where fonts come from.
FONT_HOSTS = ("fonts.googleapis.com", "fonts.bunny.net", "use.typekit.net", "use.fontawesome.com", "fonts.apple.com")
FONT_SCRIPTS = ("kit.fontawesome.com", "use.fontawesome.com")


def _script_bodies() -> Column:
    """For each script tag in order, whether anything stands in it."""
    found = F.regexp_extract_all(F.regexp_replace("html", r"(?s)<!--.*?(?:-->|$)", ""), F.lit(r"(?is)<script\b(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>(.*?)(?:</script\s*>|$)"), F.lit(1))
    return F.transform(found, lambda x: F.length(x) > 0)


def page_stats(df: DataFrame) -> DataFrame:
    """``stats``: 15 counters. A script counts if it has a src or a body; one in the head blocks rendering unless defer or async has a value."""
    df = with_marks(df).withColumn("_bodies", _script_bodies()).withColumn("_scripts", pick("script"))
    filled = F.filter("_scripts", lambda t, i: (attr(t, "src") != "") | F.coalesce(F.get("_bodies", i), F.lit(False)))
    df = df.withColumn("_scripts", filled)
    links = F.col("links")
    fonts = F.size(pick("link", lambda t: (F.lower(attr(t, "rel")) == "preload") & (F.lower(attr(t, "as")) == "font") | contains_any(F.lower(attr(t, "href")), FONT_HOSTS))) + F.size(
        F.filter("_scripts", lambda t: contains_any(F.lower(attr(t, "src")), FONT_SCRIPTS))
    )
    faces = F.regexp_count("lower", F.lit("@font-face"))
    videos = F.size(pick("video"))
    words = F.aggregate("text_nodes", F.lit(0), lambda n, x: n + F.size(F.split(x, rf"{SPACE}+")))
    length = F.aggregate("text_nodes", F.lit(0), lambda n, x: n + F.octet_length(x))
    size = F.octet_length("html")
    ratio = F.when((size > 0) & (length > 0), F.least(F.lit(100), F.floor(length * 100 / size))).otherwise(0)
    kind = lambda k: F.size(F.filter(links, lambda x: x["kind"] == k))
    stats = {
        "words": words, "images": F.size(pick("img")), "lazy_images": F.size(pick("img", lambda t: F.lower(attr(t, "loading")) == "lazy")), "scripts": F.size("_scripts"),
        "render_blocking": F.size(F.filter("_scripts", lambda t: t["in_head"] & (attr(t, "defer") == "") & (attr(t, "async") == ""))),
        "stylesheets": F.size(pick("link", lambda t: F.lower(attr(t, "rel")) == "stylesheet")), "fonts": F.when(fonts == 0, F.least(F.lit(10), faces)).otherwise(fonts),
        "videos": F.when(videos > 0, videos).otherwise(holds(*VIDEO_MARKS).cast("int")), "h1": F.size(pick("h1")), "h2": F.size(pick("h2")), "h3": F.size(pick("h3")),
        "internal_links": kind("internal"), "external_links": kind("external"), "inline_styles": F.size(F.filter("tags", lambda t: attr(t, "style") != "")), "content_ratio": ratio,
    }
    return df.withColumn("stats", F.struct(*[v.cast("int").alias(k) for k, v in stats.items()])).drop("_bodies", "_scripts")


def page_links(df: DataFrame) -> DataFrame:
    """``links``: an anchor each, ``href, norm, kind``; kind is internal, external or ignored. Relative paths without a leading slash or dot are ignored; //host is internal."""
    own = host(F.col("url"))

    def one(t):
        href = attr(t, "href")
        ignored = (href == "") | href.rlike("^(#|mailto:|tel:)")
        inside = href.rlike(r"^(/|\./|\.\./)")
        kind = F.when(ignored, "ignored").when(inside, "internal").when(host(href) == "", "ignored").when(host(href) == own, "internal").otherwise("external")
        return F.struct(t["pos"].alias("pos"), href.alias("href"), F.regexp_replace(href, r"[?#].*$", "").alias("norm"), kind.alias("kind"))

    return df.withColumn("links", F.transform(pick("a"), one))


def classify_links(df: DataFrame) -> DataFrame:
    """Long form: a row for each anchor."""
    return unnested(df, F.col("links"), "page_id").select("page_id", "item.*")


def external_links(df: DataFrame) -> DataFrame:
    """Long form: a page's external links, of those with one scheme, host and path only the first; an array fold, no shuffle."""
    out = F.filter("links", lambda x: (x["kind"] == "external"))
    df = df.select("page_id", F.transform(F.array(out), lambda o: F.filter(o, lambda x, i: F.array_position(F.transform(o, lambda y: y["norm"]), x["norm"]) == i + 1))[0].alias("o"))
    return unnested(df, F.col("o"), "page_id").select("page_id", "nth", "item.href", "item.norm")


def link_health(links: DataFrame, probes: DataFrame) -> DataFrame:
    """``links(page_id, href)`` against ``probes(href, status, final_url)``: per page the links checked, broken, redirected and ok.

    All links of a page count. Broken: no status, or 400 and over; redirect: host or path changed.
    """
    probes = probes.dropDuplicates(["href"])
    joined = links.join(probes, "href", "left")
    path = lambda c: F.regexp_extract(c, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    moved = F.col("final_url").isNotNull() & ((host(F.col("final_url")) != host(F.col("href"))) | (path(F.col("final_url")) != path(F.col("href"))))
    status = F.coalesce("status", F.lit(0))
    state = F.when((status == 0) | (status >= 400), "broken").when(moved, "redirect").otherwise("ok")
    return joined.withColumn("state", state).groupBy("page_id").agg(F.count("*").alias("checked"), *[F.count_if(F.col("state") == s).alias(s) for s in ("broken", "redirect", "ok")])


def image_audit(df: DataFrame) -> DataFrame:
    """``images``: total with a source, by format, without dimensions, without lazy loading, share of modern formats."""
    source = lambda t: F.when(attr(t, "src") != "", attr(t, "src")).otherwise(attr(t, "srcset"))
    shown = pick("img", lambda t: source(t) != "")
    path = lambda t: F.get(F.split(F.get(F.split(F.lower(source(t)), r"\?"), 0), " "), 0)
    df = df.withColumn("_images", F.transform(shown, lambda t: F.struct(F.regexp_extract(path(t), r"\.([^./]*)$", 1).alias("ext"), ((attr(t, "width") == "") | (attr(t, "height") == "")).alias("dims"), (F.lower(attr(t, "loading")) != "lazy").alias("lazy"))))
    n = lambda test: F.size(F.filter("_images", test))
    of = lambda *ext: n(lambda x: x["ext"].isin(*ext))
    kinds = {"webp": of("webp"), "avif": of("avif"), "jpg": of("jpg", "jpeg"), "png": of("png"), "gif": of("gif"), "svg": of("svg")}
    modern = F.when(F.size("_images") > 0, F.floor((kinds["webp"] + kinds["avif"]) * 100 / F.size("_images"))).otherwise(0)
    parts = {"total": F.size("_images"), **kinds, "missing_dims": n(lambda x: x["dims"]), "missing_lazy": n(lambda x: x["lazy"]), "modern_pct": modern}
    return df.withColumn("images", F.struct(*[v.cast("int").alias(k) for k, v in parts.items()])).drop("_images")


def _long_hex(h: Column) -> Column:
    six = F.regexp_replace(h, "^(.)(.)(.)$", "$1$1$2$2$3$3")
    return F.concat(F.lit("#"), F.lower(six))


def color_palette(df: DataFrame, k: int = 8) -> DataFrame:
    """Long form: ``page_id, rank, hex, frequency`` of the ``k`` most frequent colours of styles that are neither near black nor near white.

    The colours are counted by page and ranked: one shuffle on page_id, of a few rows a page.
    """
    blocks = F.regexp_extract_all(F.regexp_replace("html", r"(?s)<!--.*?(?:-->|$)", ""), F.lit(r"(?is)<style\b[^>]*+>(.*?)(?:</style\s*>|$)"), F.lit(1))
    css = F.concat(blocks, F.filter(values(F.col("tags"), "style"), lambda x: x != ""))
    found = F.flatten(F.transform(css, lambda x: F.regexp_extract_all(x, F.lit(r"(?i):\s*#([0-9a-f]{6}|[0-9a-f]{3})(?![0-9A-Za-z_])"), F.lit(1))))
    long = unnested(df, F.transform(found, _long_hex), "page_id").select("page_id", F.col("item").alias("hex"))
    part = lambda a: F.conv(F.substring("hex", a, 2), 16, 10).cast("int")
    dark = (part(2) < 30) & (part(4) < 30) & (part(6) < 30)
    light = (part(2) > 225) & (part(4) > 225) & (part(6) > 225)
    counted = long.groupBy("page_id", "hex").agg(F.count("*").alias("frequency")).where(~dark & ~light)
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("frequency"), "hex"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k)


def theme_color(df: DataFrame) -> DataFrame:
    """``theme_color``: the last valid one of the page's meta tags."""
    named = values(pick("meta", lambda t: F.lower(attr(t, "name")) == "theme-color"), "content")
    valid = F.filter(F.transform(named, lambda x: F.lower(F.trim(x))), lambda x: x.rlike("^#([0-9a-f]{6}|[0-9a-f]{3})$"))
    return df.withColumn("theme_color", F.when(F.size(valid) > 0, _long_hex(F.substring(last(valid), 2, 6))).otherwise(""))


#: Where fonts are served, and the names of the sources.
FONT_SERVICES = (("fonts.googleapis.com", "Google Fonts"), ("fonts.bunny.net", "Bunny Fonts"))
TYPEKIT = ("Adobe Fonts (Typekit)", "Adobe Fonts")
_FACE = r"(?i)@font-face\s*\{[^}]*font-family\s*:\s*['\"]?([^'\";}\n]+)['\"]?"


def _family(name: Column, weights: Column, source) -> Column:
    source = F.lit(source) if isinstance(source, str) else source
    return F.struct(name.alias("family"), weights.alias("weights"), source.alias("source"))


def _service_families(href: Column, source: str) -> Column:
    """Families that a font service's address asks for: ``family=Name:axes@weights``, or one with several names between bars."""
    asked = F.filter(F.split(F.regexp_extract(href, r"^[^?#]*\?([^#]*)", 1), "&"), lambda q: q.startswith("family="))
    plain = F.transform(asked, lambda q: F.coalesce(F.try_url_decode(F.substr(q, F.lit(8))), F.substr(q, F.lit(8))))
    plain = F.when(F.size(plain) == 1, F.split(F.get(plain, F.lit(0)), r"\|")).otherwise(plain)
    name = lambda f: F.replace(F.trim(F.regexp_extract(f, "^[^:]*", 0)), F.lit("+"), F.lit(" "))
    axes = lambda f: F.regexp_replace(F.regexp_extract(f, "^[^:]*:(.*)$", 1), "^[^@]*@", "")
    weights = lambda f: F.filter(F.transform(F.split(axes(f), "[;,]"), lambda w: F.trim(w)), lambda w: w != "")
    return F.filter(F.transform(plain, lambda f: _family(name(f), weights(f), source)), lambda x: x["family"] != "")


def font_audit(df: DataFrame, max_families: int = 3, max_weights: int = 6) -> DataFrame:
    """``fonts``: families ``(family, weights, source)`` of stylesheet and preload links, scripts and @font-face rules, one for each lower-case name, the first; their number, the
    weights of all (unknown: 1) and whether there are too many. Weights are as written; those of a @font-face rule are the ones before its family."""
    none = F.array().cast("array<string>")
    href = lambda t: attr(t, "href")
    typekit = F.array(_family(F.lit(TYPEKIT[0]), none, TYPEKIT[1]))
    linked = lambda t: (t["tag"] == "link") & F.lower(attr(t, "rel")).isin("stylesheet", "preload")

    def served(t):
        out = F.when((t["tag"] == "script") & attr(t, "src").contains("use.typekit.net"), typekit)
        for at, source in FONT_SERVICES:
            out = out.when(linked(t) & href(t).contains(at), _service_families(href(t), source))
        return out.when(linked(t) & contains_any(href(t), ("use.typekit.net", "use.typekit.com")), typekit).otherwise(F.slice(typekit, 1, 0))

    blocks = F.regexp_extract_all("html", F.lit(_FACE), F.lit(0))
    weights = lambda block: F.regexp_extract_all(block, F.lit(r"(?i)font-weight\s*:\s*([0-9]+)"), F.lit(1))
    faces = F.transform(blocks, lambda block: _family(F.trim(F.regexp_replace(F.trim(F.regexp_extract(block, _FACE, 1)), r"^['\"]+|['\"]+$", "")), weights(block), "Custom/Self-hosted"))
    df = df.withColumn("_all", F.concat(F.flatten(F.transform(pick(("link", "script")), served)), faces))
    df = df.withColumn("_names", F.transform("_all", lambda x: F.lower(x["family"])))
    df = df.withColumn("_own", F.filter("_all", lambda x, i: F.array_position("_names", F.lower(x["family"])) == i + 1))
    total = F.aggregate("_own", F.lit(0), lambda n, x: n + F.greatest(F.lit(1), F.size(x["weights"])))
    n = F.size("_own")
    return df.withColumn("fonts", F.struct(F.col("_own").alias("families"), n.alias("n_families"), total.alias("n_weights"), ((n > max_families) | (total > max_weights)).alias("too_many"))).drop("_all", "_names", "_own")


#: Meta keys that date a page with the names shown for them, and JSON-LD keys.
DATE_KEYS = {"article:published_time": "Published", "article:modified_time": "Modified", "og:updated_time": "Modified", "date": "Date", "last-modified": "Last-Modified"}
LD_KEYS = ("datePublished", "dateModified")
_YEAR = r"(?i)(?:©|&copy;|copyright)[\t\n\f\r ]*(?:\d{4}[\t\n\f\r ]*[-–][\t\n\f\r ]*)?(\d{4})"
_DATE = r"(?<![0-9A-Za-z_])(20\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))(?![0-9A-Za-z_])"


def freshness(df: DataFrame, as_of: Column) -> DataFrame:
    """``fresh``: ``latest_date``, the latest that the page names (time elements, meta keys, 60 bytes from the first of each JSON-LD key; else the first 20 ISO dates of
    the raw page); ``latest_year``, the latest up to ``as_of``'s of copyright notes and those dates, else that of ``latest_date``; rating and signals.

    Under 180 days fresh, under 540 aging, else stale; without a date by the year: 0, 1, 2 or more years back. A future date is fresh.
    """
    now, year = as_of.cast("timestamp"), F.year(as_of)
    iso = lambda c: F.regexp_extract(c, _DATE, 1)
    filled = lambda found: F.filter(found, lambda x: x != "")
    latest_year = lambda found: F.array_max(F.filter(F.transform(found, lambda y: F.substring(y, 1, 4).cast("int")), lambda y: y <= year))
    notes = latest_year(F.regexp_extract_all("html", F.lit(_YEAR), F.lit(1)))
    times = filled(F.transform(pick("time"), lambda t: iso(F.coalesce(F.nullif(attr(t, "datetime"), F.lit("")), attr(t, "data-datetime")))))
    key = lambda t: F.lower(F.coalesce(F.nullif(attr(t, "property"), F.lit("")), attr(t, "name")))
    shown = F.create_map(*[F.lit(x) for pair in DATE_KEYS.items() for x in pair])
    metas = F.filter(F.transform(pick("meta", lambda t: key(t).isin(*DATE_KEYS)), lambda t: F.struct(shown[key(t)].alias("name"), iso(attr(t, "content")).alias("date"))), lambda x: x["date"] != "")

    def window(name: str) -> Column:
        at = F.coalesce(*[F.nullif(F.locate(f"{q}{name}{q}", F.col("html")), F.lit(0)) for q in "\"'"])
        return F.coalesce(F.substring(F.encode(F.substring(F.col("html"), at, F.lit(60)), "UTF-8"), 1, 60).cast("string"), F.lit(""))

    ld = F.filter(F.array(*[F.struct(F.lit(f"JSON-LD {k}").alias("name"), iso(window(k)).alias("date")) for k in LD_KEYS]), lambda x: x["date"] != "")
    df = df.withColumns({"_notes": notes, "_times": times, "_named": F.concat(metas, ld)})
    named = F.concat("_times", F.transform("_named", lambda x: x["date"]))
    loose = F.array_max(F.slice(F.regexp_extract_all("html", F.lit(_DATE), F.lit(1)), 1, 20))
    df = df.withColumn("_latest", F.coalesce(F.array_max(named), loose)).withColumn("_year", F.greatest("_notes", latest_year(named)))
    days, back = (F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp("_latest", F.lit("yyyy-MM-dd")))) / 86400, year - F.col("_year")
    rating = F.when(days < 180, "fresh").when(days < 540, "aging").when(days.isNotNull(), "stale").when(back == 0, "fresh").when(back == 1, "aging").when(back.isNotNull(), "stale").otherwise("unknown")
    signals = F.concat(
        F.when(F.col("_notes").isNotNull(), F.array(F.concat(F.lit("Copyright © "), F.col("_notes").cast("string"), F.lit(" found")))).otherwise(F.array().cast("array<string>")),
        F.when(F.size("_times") > 0, F.array(F.concat(F.lit("Article/post dated "), F.array_max("_times")))).otherwise(F.array().cast("array<string>")),
        F.transform("_named", lambda x: F.concat(x["name"], F.lit(": "), x["date"])),
    )
    shown_year = F.coalesce("_year", F.substring("_latest", 1, 4).cast("int"))
    return df.withColumn("fresh", F.struct(F.col("_latest").alias("latest_date"), shown_year.alias("latest_year"), rating.alias("rating"), F.array_distinct(signals).alias("signals"))).drop("_notes", "_times", "_named", "_latest", "_year")


#: Words without content.
STOP_WORDS = tuple(
    """a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from get got had has have
    having he her here him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out own s same she so some such t than that the their them then
    there these they this those through to too under until up us very was we were what when where which while who why will with would you your also may might shall could should must let use new one
    two three way make like time know take see come think look want give find tell ask seem feel try leave call keep need""".split()
)


def letters(text: Column) -> Column:
    return F.split(F.lower(text), "[^a-z]+")


def top_keywords(df: DataFrame, k: int = 8, key: str = "page_id") -> DataFrame:
    """Long form: ``key, rank, word, n``: the most frequent words of five letters or more that are no stop words.

    Counting is by (key, word) with partial sums; the stop words are a predicate on the exploded word, a fixed set.
    """
    words = df.select(key, F.explode(letters(F.col("text"))).alias("word")).where((F.length("word") >= 5) & ~F.col("word").isin(*STOP_WORDS))
    counted = words.groupBy(key, "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "word"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k)


def readability(df: DataFrame) -> DataFrame:
    """``reading``: mean words of sentences with eight or more, mean letters of content words with four or more, and the level these give."""
    count_words = lambda s: F.size(F.filter(F.split(s, rf"{SPACE}+"), lambda w: w != ""))
    df = df.withColumn("_s", F.filter(F.transform(F.split("text", r"[.!?]+\s+"), count_words), lambda n: n >= 8))
    df = df.withColumn("_w", F.transform(F.filter(letters(F.col("text")), lambda w: (F.length(w) >= 4) & ~w.isin(*STOP_WORDS)), lambda w: F.length(w)))
    mean = lambda c: F.when(F.size(c) > 0, F.floor(F.aggregate(c, F.lit(0), lambda a, x: a + x) / F.size(c))).otherwise(0)
    s, w = mean("_s"), mean("_w")
    level = F.when(s == 0, "simple").when((s > 32) | (s > 22) & (w >= 7), "advanced").when((s > 22) | (w >= 7), "moderate").otherwise("simple")
    return df.withColumn("reading", F.struct(s.cast("int").alias("sentence_words"), w.cast("int").alias("word_letters"), level.alias("level"))).drop("_s", "_w")


#: Phrases that say little, and patterns of what is specific.
VAGUE = (
    "best-in-class", "world-class", "industry-leading", "cutting-edge", "state-of-the-art", "innovative", "revolutionary", "groundbreaking", "seamless", "robust", "scalable", "comprehensive",
    "holistic", "synergy", "leverage", "empower", "transformative", "game-changing", "next-generation", "next-gen", "turnkey", "end-to-end", "best practices", "thought leader", "disruptive",
    "paradigm shift", "move the needle", "low-hanging fruit", "deep dive", "mission-critical",
)
SPECIFIC = {
    "percentages": r"\d+\s*%", "multipliers": r"\d+[xX]\s", "prices": r"\$[\d,]+", "counts": r"\d+[,\d]*\s*(users?|customers?|teams?|companies)",
    "comparisons": r"(vs\.?|versus|compared to|beats?|outperforms?)", "timeframes": r"(?<![A-Za-z0-9_])(in|within)\s+\d+\s*(seconds?|minutes?|hours?|days?)",
}


def copy_specificity(df: DataFrame) -> DataFrame:
    """``copy``: vague phrases, kinds of specific figures, score and label. Empty text scores 100."""
    t = F.col("text")
    vague = F.array_compact(F.array(*[F.when(F.lower(t).contains(p) & t.rlike(rf"(?i)(?<![A-Za-z0-9_]){p}(?![A-Za-z0-9_])"), p) for p in VAGUE]))
    hints = F.array_compact(F.array(*[F.when(t.rlike(p), k) for k, p in SPECIFIC.items()]))
    df = df.withColumn("_vague", vague).withColumn("_hints", hints)
    score = F.when(t == "", 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.size("_vague") * 15 + F.size("_hints") * 8)))
    label = F.when(score < 50, "Generic").when(score < 80, "Mixed").otherwise("Sharp")
    return df.withColumn("copy", F.struct(score.cast("int").alias("score"), label.alias("label"), F.col("_vague").alias("vague"), F.col("_hints").alias("specific"))).drop("_vague", "_hints")


_PRICE = r"(?i)(\$[\d,]+|£[\d,]+|€[\d,]+|\d+\s*(USD|EUR|GBP)|per\s+month|/month|/year|per\s+year)"
_STARS = r"(?i)(\d(\.\d)?\s*stars?|★|☆|\d/5|\d/10|out of \d|rated \d)"
_STEPS = r"(?i)(step\s+\d|^\d+\.\s|\n\d+\.\s)"
#: What title and description may claim, by the words that claim it.
CLAIMS = {
    "pricing": ("pricing", "price", "plans", "cost"),
    "comparison": ("best", "top", "vs", "versus", "compare", "comparison", "alternatives"),
    "reviews": ("review", "reviews", "rating", "rated"),
    "guide": ("tutorial", "guide", "how to", "how-to", "step by step", "steps"),
    "free": ("free",),
    "action": ("download", "get started", "sign up", "signup"),
}


def intent_alignment(df: DataFrame) -> DataFrame:
    """``intent_match``: the claims of title and description, whether the page bears each out, and the share that it does (100 without claims)."""
    claim, text = F.lower(F.concat("title", F.lit(" "), "description")), F.col("text")
    borne = {
        "pricing": text.rlike(_PRICE), "comparison": holds(*COMPARISON), "reviews": text.rlike(_STARS),
        "guide": text.rlike(_STEPS) | holds(*STEP_LIST), "free": F.lower(text).contains("free"), "action": holds(*ACTION),
    }
    checks = F.array_compact(F.array(*[F.when(contains_any(claim, words), F.struct(F.lit(k).alias("claim"), borne[k].alias("found"))) for k, words in CLAIMS.items()]))
    df = with_marks(df).withColumn("_checks", checks)
    score = F.when(F.size("_checks") == 0, 100).otherwise(F.floor(F.size(F.filter("_checks", lambda c: c["found"])) * 100 / F.size("_checks")))
    return df.withColumn("intent_match", F.struct(score.cast("int").alias("score"), F.col("_checks").alias("checks"))).drop("_checks")


def security_headers(df: DataFrame, headers: str = "headers") -> DataFrame:
    """``security``: six checks over a map of response headers, names in any case."""
    lowered = F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    df = df.withColumn("_h", lowered)
    v = lambda name: F.coalesce(F.element_at("_h", name), F.lit(""))
    there = lambda name, missing: F.when(v(name) == "", missing).otherwise("pass")
    referrer = F.lower(v("referrer-policy"))
    status = {
        "hsts": there("strict-transport-security", "fail"), "csp": there("content-security-policy", "fail"),
        "xframe": F.when(F.upper(v("x-frame-options")).isin("DENY", "SAMEORIGIN"), "pass").otherwise("warning"),
        "xcontent": F.when(F.lower(v("x-content-type-options")) == "nosniff", "pass").otherwise("warning"),
        "referrer": F.when((referrer == "") | referrer.isin("unsafe-url", "no-referrer-when-downgrade"), "warning").otherwise("pass"),
        "permissions": there("permissions-policy", "fail"),
    }
    return df.withColumn("security", F.array(*[F.struct(F.lit(k).alias("id"), s.alias("status")) for k, s in status.items()])).drop("_h")
