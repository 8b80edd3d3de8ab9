"""Technologies behind a page: fingerprints, evidence scores, and roll-ups.

Rules are a table ``rule, name, category, confidence, patterns, require_all, tag_only``.
``core_rules`` holds the reference's 133; give ``load_rules`` a file for another set. The rules are a
bounded table, sent to the tasks once; a page is scanned against all of them in one Arrow pass that
returns only matches, so no page is copied for a rule.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteaudit.functions.suffixes import Sites, common_rules, sites_in_tasks

from .page_marks import AI_MARKERS, holds, with_marks
from .tech_rules import AI_BUILDERS, ENTITIES, TECHNOLOGIES

RULES = "rule int, name string, category string, confidence string, patterns array<string>, require_all boolean, tag_only boolean"
#: Most rules that are sent to tasks; more raise.
MOST_RULES = 5_000


def rule_rows() -> list[tuple]:
    """The built-in rules in the order of ``RULES``."""
    return [(n, t.name, t.category, t.confidence, list(t.patterns), t.require_all, t.tag_only) for n, t in enumerate(TECHNOLOGIES, 1)]


def core_rules(spark: SparkSession) -> DataFrame:
    """The built-in rules."""
    return spark.createDataFrame(rule_rows(), RULES)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON lines with the columns of ``RULES``."""
    return spark.read.schema(RULES).json(path)


#: What makes a pattern explicit evidence, or strong indirect evidence.
EXPLICIT_PARTS = ("generator", "@vite/client", ".init", ".min.js", ".min.css", ".bundle.js", ".com", ".net", ".io", ".app", ".dev", ".co", ".org")
INDIRECT_PARTS = (
    "data-", "modulepreload", "__vite__mapdeps", "vite:preloaderror", "wp-json/wp/", "/_next/", "/_nuxt/", "chunk", "bundle", "webpack", "ng-version", "/static/js/", "/wp-content/", "/wp-includes/", "astro-",
)


def evidence(pattern: str) -> tuple[str, int]:
    """Type and strength of a match of a pattern."""
    p = pattern.lower().strip()
    if p and (p.startswith(("window.", "__")) or ".js" in p and "/" in p or any(x in p for x in EXPLICIT_PARTS)):
        return "explicit", 92
    return ("indirect", 55) if any(x in p for x in INDIRECT_PARTS) else ("weak", 24)


_URL = re.compile(r"https?://[^\s\"'<>]+")
_OUTSIDE = re.compile(r">[^<]*(?:<|$)")
SPAN = 120


def _host(url: str) -> str:
    m = re.match(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url, re.I)
    return m[1].lower() if m else ""


def _origin(around: str, pattern: str, root: str, sites: Sites) -> str:
    """Whether the address around a match is the page's own site."""
    if not root:
        return "unknown"
    for token in _URL.findall(around):
        token = token.rstrip(".,;)]}\"'")
        if pattern in token and (host := _host(token)):
            return "first-party" if sites.of(host) == root else "third-party"
    return "first-party" if pattern.startswith("/") else "unknown"


_BEST = {"first-party": 3, "unknown": 2, "third-party": 1}


def _look(source: str, pattern: str, root: str, sites: Sites) -> tuple[str, str] | None:
    """The best of the first five matches: own site over unknown over others; a piece of the text around it, and its origin."""
    at, best = source.find(pattern), None
    for _ in range(5):
        if at < 0:
            break
        around = source[max(0, at - SPAN // 2) : at + len(pattern) + SPAN // 2].strip()[:SPAN]
        origin = _origin(around, pattern, root, sites)
        if best is None or _BEST[origin] > _BEST[best[1]]:
            best = around, origin
        at = source.find(pattern, at + len(pattern))
    return best


MATCHES = "page_id long, rule int, name string, category string, confidence string, n_patterns int, require_all boolean, pattern string, match string, evidence_type string, strength int, source string"
_NAMES = [x.split()[0] for x in MATCHES.split(", ")]


#: Bytes of pages that a task holds as Python strings, with their matches, at once.
SLICE = 2 << 20


def _slices(batches, limit: int):
    """The same pages in record batches of about ``limit`` bytes of html, one page at least."""
    for batch in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(2)), 0).cast(pa.int64())).to_numpy()
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(ends.searchsorted((ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def tech_matches(pages: DataFrame, rules: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Long form: a row for each pattern of each rule that holds on a page, with evidence and origin: the page's own site or another, sites being told apart by ``suffixes`` (``functions.suffixes``; else the common ones)."""
    sites = sites_in_tasks(suffixes) if suffixes is not None else Sites(common_rules())
    table = rules.orderBy("rule").limit(MOST_RULES + 1).collect()
    if len(table) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: split the table and union the matches")
    wanted = [(r.rule, r.name, r.category, r.confidence, [(p, p.lower(), *evidence(p)) for p in r.patterns], bool(r.require_all), bool(r.tag_only)) for r in table]

    every_pattern = sorted({low for *_, patterns, _, _ in wanted for _, low, _, _ in patterns})

    def run(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for low in every_pattern:
            machine.add_word(low, low)
        if every_pattern:
            machine.make_automaton()
        for batch in _slices(batches, SLICE):
            out = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                lower = (html or "").lower()
                # One scan of the page finds all patterns that it holds; only rules with one of them are looked at.
                held = {low for _, low in machine.iter(lower)} if every_pattern else ()
                tags = None
                root = sites.of(_host(url or ""))
                for rule, name, category, confidence, patterns, every, tag_only in wanted if held else ():
                    if held.isdisjoint(x[1] for x in patterns):
                        continue
                    if tag_only and tags is None:
                        tags = _OUTSIDE.sub("  ", ">" + lower)
                    source = tags if tag_only else lower
                    found = [(p, *hit, kind, strength) for p, low, kind, strength in patterns if low in held and low in source and (hit := _look(source, low, root, sites))]
                    if found and (not every or len(found) == len(patterns)):
                        out += [(page, rule, name, category, confidence, len(patterns), every, p, around, kind, strength, origin) for p, around, origin, kind, strength in found]
            columns = list(zip(*out)) if out else [[] for _ in _NAMES]
            kinds = [pa.int64(), pa.int32(), *[pa.string()] * 3, pa.int32(), pa.bool_(), *[pa.string()] * 3, pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _NAMES)

    return pages.select("page_id", "url", "html").mapInArrow(run, MATCHES)


def tech_scores(matches: DataFrame) -> DataFrame:
    """``page_id, rule, name, category, score, confidence, signals``: one row for each page and rule."""
    g = matches.groupBy("page_id", "rule", "name", "category", F.col("confidence").alias("prior"), "n_patterns", "require_all").agg(
        F.count("*").alias("n"), F.max("strength").alias("top"), F.sum("strength").alias("sum"), F.count_if(F.col("evidence_type") == "explicit").alias("strong"),
        F.count_if(F.col("source") == "first-party").alias("own"), F.count_if(F.col("source") == "third-party").alias("other"), F.sort_array(F.collect_list(F.struct("pattern", "match", "evidence_type", "source"))).alias("signals"),
    )
    core = (F.lit(0.7) * F.col("top") + F.lit(0.3) * F.floor(F.col("sum") / F.col("n"))) * F.lit(0.75) + F.col("n") / F.col("n_patterns") * F.lit(25.0)
    score = core.cast("int") + F.when(F.col("require_all") & (F.col("n_patterns") > 1), 4).otherwise(0) + F.when(F.col("n") > 1, 3).otherwise(0)
    score = score + F.when(F.col("prior") == "high", 3).when(F.col("prior") == "low", -3).otherwise(0)
    built = F.col("category").isin("cms", "framework")
    score = score + F.when(built & (F.col("own") > 0), 8).otherwise(0) - F.when(built & (F.col("other") == F.col("n")), 18).otherwise(0)
    g = g.withColumn("score", score)
    cap = lambda when, most: F.when(when, F.least(F.col("score"), F.lit(most))).otherwise(F.col("score"))
    for when, most in ((built & (F.col("strong") == 0), 69), ((F.col("category") == "cms") & (F.col("n") == 1) & (F.col("other") == 1), 39), (F.col("prior") == "medium", 69), (F.col("prior") == "low", 39)):
        g = g.withColumn("score", cap(when, most))
    g = g.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), "score")).cast("int"))
    label = F.when(F.col("score") >= 70, "high").when(F.col("score") >= 40, "medium").otherwise("low")
    return g.select("page_id", "rule", "name", "category", "score", label.alias("confidence"), "signals")


#: Order in which categories are shown.
SHOWN = ("cms", "builder", "ecommerce", "framework", "analytics", "cdn", "media")


def tech_stack(scores: DataFrame) -> DataFrame:
    """One row for each page and name: of rules with one name the best score, the first on ties; ``found`` keeps the order of first matches, ``shown`` that by category and confidence."""
    by_name = Window.partitionBy("page_id", "name")
    best = scores.withColumn("first_rule", F.min("rule").over(by_name)).withColumn("_rn", F.row_number().over(by_name.orderBy(F.desc("score"), "rule"))).where("_rn = 1").drop("_rn")
    page = Window.partitionBy("page_id")
    place = lambda c, names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(c)), F.lit(0)), F.lit(99))
    best = best.withColumn("found", F.row_number().over(page.orderBy("first_rule")))
    return best.withColumn("shown", F.row_number().over(page.orderBy(place("category", SHOWN), place("confidence", ("high", "medium", "low")), "first_rule"))).drop("first_rule")




def ai_builder(df: DataFrame) -> DataFrame:
    """``ai``: the first builder whose pattern the page holds (high), else all general markers it holds (medium)."""
    named = [F.when(holds(p), F.struct(F.lit(name).alias("builder"), F.lit(p).alias("signal"))) for name, patterns in AI_BUILDERS for p in patterns]
    df = with_marks(df).withColumn("_builder", F.coalesce(*named)).withColumn("_marks", F.array_compact(F.array(*[F.when(holds(m), m) for m in AI_MARKERS])))
    some = F.col("_builder").isNotNull()
    level = F.when(some, "high").when(F.size("_marks") > 0, "medium").otherwise("")
    signals = F.when(some, F.array("_builder.signal")).otherwise(F.col("_marks"))
    return df.withColumn("ai", F.struct((level != "").alias("is_ai_built"), level.alias("confidence"), F.coalesce("_builder.builder", F.lit("")).alias("builder"), signals.alias("signals"))).drop("_builder", "_marks")


def core_entities(spark: SparkSession) -> DataFrame:
    """``entity, name, category``."""
    return spark.createDataFrame(list(ENTITIES), "entity string, name string, category string")


def merge_third_parties(stack: DataFrame, parties: DataFrame, entities: DataFrame) -> DataFrame:
    """``stack(page_id, name, category, confidence)`` and those of ``parties(page_id, pos, entity)`` that are known and not in it yet (names in any case), with high confidence."""
    few = entities.limit(MOST_RULES + 1).count() <= MOST_RULES
    known = parties.join(F.broadcast(entities) if few else entities, "entity").withColumn("key", F.lower("name"))
    first = known.groupBy("page_id", "key").agg(F.min_by(F.struct("name", "category"), "pos").alias("e"))
    have = stack.select("page_id", F.lower("name").alias("key"))
    new = first.join(have, ["page_id", "key"], "left_anti").select("page_id", "e.name", "e.category", F.lit("high").alias("confidence"))
    return stack.select("page_id", "name", "category", "confidence").unionByName(new)


def tech_adoption(stack: DataFrame) -> DataFrame:
    """Pages by category and technology, with totals by category and of all. A page has a name once, so counting rows counts pages; totals count pages apart."""
    per_page = stack.rollup("category", "name")
    return per_page.agg(F.grouping_id().alias("level"), F.count_distinct("page_id").alias("pages"), F.count_if(F.col("confidence") == "high").alias("high"), F.count_if(F.col("confidence") == "medium").alias("medium"), F.count_if(F.col("confidence") == "low").alias("low"))


#: Bounds of good and of fair values (milliseconds; CLS has no unit).
VITALS = {"lcp": (2500, 4000), "fcp": (1800, 3000), "tbt": (200, 600), "cls": (0.1, 0.25), "si": (3400, 5800), "inp": (200, 500)}


def vital_rating(metric: str, value: Column) -> Column:
    good, fair = VITALS[metric]
    return F.when(value < good, "good").when(value < fair, "needs-improvement").when(value.isNotNull(), "poor")
