"""Quality rules: text statistics and learned decision lists, all in DataFrame expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BREAKS, let, spare, stage, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a window of ``n_repeat_words``.
WINDOW = 5
#: Labelled documents that training uses at most, taken by the order of a hash of doc_id.
TRAIN_ROWS = 20_000
#: Thresholds tried for a statistic.
CUTS = 24
#: Conditions of a rule and rules of a list at most.
DEPTH, LENGTH = 3, 6
#: Share of the training rows that only prunes and judges rules.
HELD = 1 / 3
#: Share of low-quality rows that a rule must reach among the held rows it covers, and how many it must cover.
PURITY, COVER = 0.95, 5

#: Statistics that rules may use.
FEATURES = {
    "mean_word": lambda: F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    "symbol_share": lambda: F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
    "dup_line_share": lambda: F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    "repeat_share": lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
    "capital_share": lambda: F.col("n_capitals") / F.greatest("word_chars", F.lit(1)),
    "mark_share": lambda: F.col("n_marks") / F.greatest("word_chars", F.lit(1)),
    "words": lambda: F.col("n_words").cast("double"),
}


def repeat_words(ws: Column) -> Column:
    """Words of an array that stand in a window of five found twice or more.

    Windows are told apart by a 64-bit hash. Texts without a repeated window, most of them, end at the
    comparison of two sizes; the others sort (hash, place) and add up the stretch that
    each repeated window has to itself. Linear but for that sort.
    """

    def hashes(w):
        at = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def repeated(s):
        twin = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

    def stretches(p):
        own = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    def covered(h):
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(let(placed, repeated), stretches)

    def counted(w):
        some = let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
        return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(some)

    return let(ws, counted)


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds to ``docs`` the counts of each text: ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_capitals, n_marks`` (long). A null text counts as empty; columns of these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    less = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    wordy = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own, lined = spare(docs.columns, "own_words"), spare(docs.columns, "own_lines")
    counts = {
        "n_words": F.size(own), "word_chars": F.length(F.regexp_replace(t, BREAKS, "")), "n_symbols": less(f"[{SYMBOLS}]+"),
        "n_lines": F.size(lined), "n_dup_lines": F.size(lined) - F.size(F.array_distinct(lined)), "n_repeat_words": repeat_words(F.col(own)),
        "n_capitals": less("[A-Z]+"), "n_marks": less("[!?]+"),
    }
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in counts]
    out = docs.withColumns({own: words(t), lined: wordy})
    return out.select(*kept, *[v.cast("long").alias(k) for k, v in counts.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass
class Rule:
    """A conjunction of ``(feature, above, threshold)``; ``above``: the feature is over the threshold, else at most."""

    conditions: list[tuple[str, bool, float]]
    held_low: int = 0
    held_all: int = 0

    def matches(self) -> Column:
        out = F.lit(True)
        for name, above, cut in self.conditions:
            x = FEATURES[name]()
            out = out & ((x > cut) if above else (x <= cut))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if a else '<='} {c:.6g}" for n, a, c in self.conditions) + f" -> reject ({self.held_low} of {self.held_all} held rows)"


@dataclass
class DecisionList:
    """Ordered rules for rejection; a row that none matches is kept."""

    rules: list[Rule] = field(default_factory=list)

    def keep(self) -> Column:
        """The list as one conditional expression over ``text_stats`` columns."""
        out = None
        for r in self.rules:
            out = F.when(r.matches(), F.lit(False)) if out is None else out.when(r.matches(), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _binned(stats: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Each feature as the number of thresholds under it, so that every condition is a comparison of small integers."""
    at = lambda n: F.size(F.filter(F.array(*[F.lit(c) for c in cuts[n]]), lambda c: c < FEATURES[n]()))
    return stats.select(F.col("low").cast("int").alias("low"), "held", *[at(n).alias(n) for n in cuts], *[FEATURES[n]().alias(f"{n}_value") for n in cuts])


def _covers(conditions: list[tuple[str, bool, int]]) -> Column:
    out = F.lit(True)
    for name, above, k in conditions:
        out = out & ((F.col(name) > k) if above else (F.col(name) <= k))
    return out


def _best(rows: DataFrame, names: list[str], low: int, total: int) -> tuple[str, bool, int] | None:
    """The condition with most information gained over the low-quality rows that it keeps: one histogram for each feature comes to the driver."""
    bins = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("k")) for n in names])).alias("b")
    hist = rows.select("low", bins).groupBy("b.f", "b.k").agg(F.sum("low").alias("low"), F.count("*").alias("n")).collect()
    best, most = None, 1e-9
    before = math.log2(low / total)
    for name in sorted(names):
        own = sorted((r.k, r.low, r.n) for r in hist if r.f == name)
        p = n = 0
        for k, dl, dn in own[:-1]:
            p, n = p + dl, n + dn
            for above, pp, nn in ((False, p, n), (True, low - p, total - n)):
                if pp and nn and (gain := pp * (math.log2(pp / nn) - before)) > most:
                    best, most = (name, above, k), gain
    return best


def _margins(rows: DataFrame, conditions: list[tuple[str, bool, int]]) -> list[tuple[str, bool, float]]:
    """The conditions with thresholds halfway between the values that they part."""
    ends = [x for n, _, k in conditions for x in (F.max(F.when(F.col(n) <= k, F.col(f"{n}_value"))), F.min(F.when(F.col(n) > k, F.col(f"{n}_value"))))]
    found = rows.agg(*ends).first()
    return [(n, above, (found[2 * i] + found[2 * i + 1]) / 2) for i, (n, above, _) in enumerate(conditions)]


def learn_rules(docs: DataFrame, labels: DataFrame) -> DecisionList:
    """Sequential covering over the labelled rows of ``docs`` (quality 0: low, 1: good).

    Each rule is grown on two thirds of the training rows, condition by condition, by information gained; then its
    last conditions are cut while the held third is no worse without them. A rule is taken if
    of at least ``COVER`` held rows that it covers ``PURITY`` are low; rows it covers leave, and the next rule is grown. Thresholds
    lie halfway between the training values that they part, so that values never seen go with the nearer side.
    Training takes ``TRAIN_ROWS`` labelled documents at most (the smallest hashes of doc_id); a doc_id with several labels
    counts as low if any is. Null labels are left out. Without low and good rows the list is empty: all are kept.
    """
    label = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("low"))
    sample = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).withColumnRenamed("doc_id", "_id")  # at most TRAIN_ROWS rows: small
    # Staged before its texts are counted, or else the filter on counts would go below the join and count the whole corpus.
    chosen = stage(docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).drop("_id"), "rules-sample")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(1000)) < int(1000 * HELD)
    stats = stage(text_stats(chosen).where(~base_failed()).withColumn("held", held).drop("text"), "rules-stats")
    names = list(FEATURES)
    marks = stats.agg(*[F.percentile_approx(FEATURES[n](), [k / CUTS for k in range(1, CUTS)], 10_000).alias(n) for n in names]).first()
    # Halfway between neighbouring quantiles, and zero: values at a quantile then lie on one side whatever their ties.
    cuts = {}
    for n in names:
        q = sorted({0.0, *(marks[n] or [])})
        cuts[n] = sorted({0.0, *((a + b) / 2 for a, b in zip(q, q[1:]))})
    rows = stage(_binned(stats, cuts), "rules-rows")
    out, left = DecisionList(), F.lit(True)
    while len(out.rules) < LENGTH:
        grow = rows.where(~F.col("held")).where(left)
        conditions: list[tuple[str, bool, int]] = []
        while len(conditions) < DEPTH:
            inside = grow.where(_covers(conditions))
            low, total = inside.agg(F.coalesce(F.sum("low"), F.lit(0)), F.count("*")).first()
            if not low or low == total or (found := _best(inside, names, low, total)) is None:
                break
            conditions.append(found)
        if not conditions:
            break
        tried = [conditions[:k] for k in range(1, len(conditions) + 1)]
        sums = rows.where("held").where(left).agg(*[x for c in tried for x in (F.coalesce(F.sum(F.when(_covers(c), F.col("low"))), F.lit(0)), F.count(F.when(_covers(c), 1)))]).first()
        scored = [((2 * sums[2 * i] - sums[2 * i + 1]) / max(1, sums[2 * i + 1]), -i) for i in range(len(tried))]
        i = -max(scored)[1]
        low, total = sums[2 * i], sums[2 * i + 1]
        if total < COVER or low < PURITY * total:
            break
        out.rules.append(Rule(_margins(rows.where(left), tried[i]), low, total))
        left = left & ~_covers(tried[i])
    return out


def quality_rules(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Adds the counts of ``text_stats``, ``base_failed`` and ``kept`` to every row of ``docs``.

    ``kept`` is false if ``base_failed`` (under 10 words, or over a fifth of the words in
    repeated windows), else what the ordered list says. Null and empty texts fail; repeated rows and null ids are judged as any;
    other columns stay, those of the names added are replaced.
    """
    out = text_stats(docs.drop("base_failed", "kept"))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.keep())
