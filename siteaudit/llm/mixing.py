"""Mixing sources to target weights by Efraimidis-Spirakis sampling, all in DataFrame expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stage, words

#: Weights of the sources in order, repeated.
WEIGHTS = (5, 2, 1)
#: Most times a document may be taken.
EPOCHS = 3
#: Parts of a source by the order of its keys; only one of them is ranked row by row.
PARTS = 4096


def sizes(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of a text's characters that are neither digits nor symbols, 0.1 at least; 1 for null and empty."""
    t = F.coalesce(text, F.lit(""))
    plain = F.length(F.regexp_replace(t, r"[0-9#*$%&|<>]+", ""))
    return F.greatest(F.lit(0.1), F.when(F.length(t) == 0, F.lit(1.0)).otherwise(plain / F.length(t)))


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the md5 of a key."""
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def _places(sources: DataFrame) -> DataFrame:
    """Adds ``place``: 0, 1, ... by source, null last. Ranges of the order are numbered on their own, so no task sees all sources."""
    key = F.struct(F.col("source").isNull(), F.col("source"))
    ranges = stage(sources.repartitionByRange(key).withColumn("range", F.spark_partition_id()), "mix-ranges")
    before = Window.partitionBy().orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    return ranges.withColumn("own", own).join(starts, "range").select(*sources.columns, (F.col("start") + F.col("own") - 1).alias("place"))


def targets(sources: DataFrame, share: float = 1.0, weights: tuple = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``sources(source, source_size)``, a row for each source: adds ``target``.

    The sources, by code point and null last, weigh ``weights`` in turn and share ``share`` of all sizes. A target stops at
    ``epochs`` times its source's size; what exceeds it is shared by the others by weight, until none is above: one sum over the sources for each
    time that some reach their cap. Sources of size 0 get target 0.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    ranked = stage(_places(sources).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(epochs))), "mix-sources")
    level, seen = 0.0, -1
    while True:
        full = F.col("cap") < F.col("weight") * F.lit(level)
        sums = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("cap"))).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("rest"), F.count(F.when(full, 1)).alias("n")).first()
        if sums["n"] == seen or not sums["rest"]:
            break
        seen, level = sums["n"], (sums["all"] * float(share) - (sums["capped"] or 0.0)) / sums["rest"]
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.lit(float("inf") if sums["all"] and not sums["rest"] else level) * F.col("weight")).alias("target"))


_ALIKE = ("doc_id", "source", "print")
_RANK = ("key", "doc_id", "print", "copy")


def _prints(docs: DataFrame) -> DataFrame:
    """Adds ``size, weight`` and ``print``, the md5 of the text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"size": sizes(F.col("text")), "weight": quality_weight(F.col("text")), "print": F.md5(t)})


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the sampling ``key`` and the ``part`` of its range."""
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "print", "copy")
    out = rows.withColumn("key", -F.log(uniform(name)) / F.col("weight"))
    return out.withColumn("part", F.least(F.floor((1 - F.exp(-F.col("key"))) * PARTS), F.lit(PARTS - 1)).cast("int"))


def mix_plan(docs: DataFrame, share: float = 1.0, weights: tuple = WEIGHTS, epochs: int = EPOCHS) -> tuple[DataFrame, DataFrame]:
    """The staged ``doc_id, source, print, size, n, copy, key, part`` of all rows, and a row for each source: ``s, source_size, target, epochs,
    edge`` and ``cut``: rows in ranges before ``edge``, and in it up to ``cut``, are picked besides the whole epochs.

    Rows alike are counted first and then are copies 0, 1, ... with keys of their own. No source is sorted as one: its keys fall into ``PARTS`` ranges, whose
    sums say in which range the rest of the target ends; only that range is ranked row by row.
    """
    counted = _prints(docs.select("doc_id", "text", "source")).groupBy(*_ALIKE).agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("weight").alias("weight"))
    many = 1 << 16  # a row that repeats without end becomes rows in two steps
    blocks = counted.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / many).cast("long"))))
    copies = blocks.withColumn("copy", F.explode(F.sequence(F.col("k") * many, F.least(F.col("n"), (F.col("k") + 1) * many) - 1))).drop("k")
    keyed = stage(_keyed(copies).drop("weight"), "mix-keys")
    parts = stage(keyed.groupBy("source", "part").agg(F.sum("size").alias("words")), "mix-parts")
    goal = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), share, weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = stage(goal.withColumnRenamed("source", "s"), "mix-goal")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows at most
    edge = parts.withColumn("ahead", F.coalesce(F.sum("words").over(before), F.lit(0))).join(goal, F.col("source").eqNullSafe(F.col("s")))
    edge = edge.where("ahead <= rest and ahead + words > rest").groupBy("s").agg(F.min("part").alias("edge"), F.min_by("ahead", "part").alias("ahead"), F.first("rest").alias("rest"))
    order = Window.partitionBy("s").orderBy("key", F.col("doc_id").asc_nulls_first(), "print", "copy").rowsBetween(Window.unboundedPreceding, 0)
    inside = keyed.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("edge")))
    middle = F.col("ahead") + F.sum("size").over(order) - F.col("size") / F.lit(2)
    cut = inside.withColumn("middle", middle).where("middle <= rest").groupBy("s").agg(F.max(F.struct(*_RANK)).alias("cut"))
    ends = edge.select(F.col("s").alias("e"), "edge").join(cut.withColumnRenamed("s", "c"), F.col("e").eqNullSafe(F.col("c")), "left").drop("c")
    return keyed, stage(goal.join(ends, F.col("s").eqNullSafe(F.col("e")), "left").drop("e", "rest"), "mix-plan")


def _picked(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """A row for each source is small enough to send to all tasks, or else the join shuffles."""
    out = keyed.join(small(plan, plan.count(), 300), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    at_edge = (F.col("part") == F.col("edge")) & F.col("cut").isNotNull() & (F.struct(*_RANK) <= F.col("cut"))
    return out.withColumn("picked", F.coalesce((F.col("target") > 0) & ((F.col("part") < F.col("edge")) | at_edge), F.lit(False)))


def mix(docs: DataFrame, share: float = 1.0, weights: tuple = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)``: ``doc_id, source, size, source_size, target, epochs, picked, taken``.

    Each source is taken whole ``epochs`` times, as often as fits its target; the rest of the target is filled with its documents in the
    order of Efraimidis-Spirakis keys, ``-ln(u) / w`` with u from doc_id, text and the number among rows alike in these, and w from ``quality_weight``. A document is
    picked while the middle of its words lies within the rest, so a source misses its target by half a document at most.

    The order depends on rows alone, so reruns agree, however the input is split. Repeated rows are sampled one by one; ties in keys go by doc_id, text and number.
    Null source: a source of its own, last. Null text: size 0, taken 0. Null doc_id: keyed by its text.
    Other columns are ignored. Empty in, empty out.
    """
    keyed, plan = mix_plan(docs, share, weights, epochs)
    taken = F.col("size") * (F.col("epochs") + F.col("picked").cast("long"))
    return _picked(keyed, plan).select("doc_id", "source", "size", "source_size", "target", "epochs", "picked", taken.alias("taken"))


def mixed_documents(docs: DataFrame, share: float = 1.0, weights: tuple = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it. Texts of rows that don't repeat aren't shuffled. Rows of a source without words don't appear; of
    rows alike in doc_id, text and source, those with the least other columns go first."""
    keyed, plan = mix_plan(docs, share, weights, epochs)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")  # clashing names of other columns stay inside
    rows = _prints(docs.select("doc_id", "text", "source", own)).drop("text", "size")
    again = stage(_picked(keyed.where("n > 1"), plan).groupBy(*_ALIKE).agg(F.first("epochs").alias("epochs"), F.sum(F.col("picked").cast("long")).alias("p")).select(*[F.col(c).alias(f"a_{c}") for c in _ALIKE], "epochs", "p"), "mix-again")
    n_again = again.count()
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"a_{c}")) for c in _ALIKE))
    once = _picked(_keyed((rows.join(small(again, n_again, 200), same, "left_anti") if n_again else rows).withColumn("copy", F.lit(0).cast("long"))), plan)
    out = once.select("own", (F.col("epochs") + F.col("picked").cast("long")).alias("times"))
    if n_again:
        each = rows.join(small(again, n_again, 200), same).groupBy(*_ALIKE, "epochs", "p", "own").agg(F.count("*").alias("m"))
        ahead = F.coalesce(F.sum("m").over(Window.partitionBy(*_ALIKE).orderBy(F.to_json("own")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.unionByName(each.select("own", (F.col("epochs") * F.col("m") + F.greatest(F.lit(0), F.least("m", F.col("p") - ahead))).alias("times")))
    return out.where("times > 0").select("own", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time")).select("own.*")
