"""Sharding by balanced label propagation, all in DataFrame expressions.

Documents with one text are linked. Labels are shards and start from a hash of doc_id; in each round the groups that don't
lie together yet move to the shard that most of their documents are in, as far as shards have room.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, stage, unstage

#: Rounds at most; they end once a round moves nothing.
ROUNDS = 16
#: Rows that are numbered in one window at most, but for what a hash deals unevenly.
NUMBERED = 50_000
#: Groups of a shard's quota by this, or more, are admitted to shards in order of size; smaller ones, too many to rank, by a hash.
RANKED = 1000


def _numbered(df: DataFrame, rows: int, by: str | None, key: Column) -> DataFrame:
    """Adds ``at``, where a row's ``n`` places begin among those of all rows, or of its value of ``by``.

    Rows are dealt to parts by ``key``; a part's offset comes from the sums of those before it, so no window sees more than one part.
    """
    parts = max(1, -(-rows // NUMBERED), min(32, rows // 256))
    own = [by] if by else []
    dealt = df.withColumn("_part", F.pmod(key, F.lit(parts)).cast("int"))
    sums = dealt.groupBy(*own, "_part").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*own, "_part").orderBy("group", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_rn", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, [*own, "_part"])
    return out.withColumn("at", F.col("_at") + F.col("_rn")).drop("_part", "_at", "_rn")


def _cut(df: DataFrame, segments: Column) -> DataFrame:
    """Rows that hold places ``at`` to ``at + n`` as pieces of the ``segments`` (first, last, shard, slot) that these lie in: ``shard``, ``slot`` and ``n`` of each."""
    met = F.filter(segments, lambda s: (s["first"] < F.col("at") + F.col("n")) & (s["last"] > F.col("at")))
    start, end = F.greatest("at", "s.first"), F.least(F.col("at") + F.col("n"), F.col("s.last"))
    out = df.withColumn("s", F.explode(met))
    return out.select("doc_id", "size", "text_crc32", "group", F.col("s.shard").alias("shard"), (F.col("s.slot") + start - F.col("s.first")).alias("slot"), (end - start).alias("n"))


def _segments(of: list[tuple[int, int, int, int]]) -> Column:
    kind = "array<struct<first:long,last:long,shard:int,slot:long>>"
    return F.array(*[F.struct(F.lit(a).cast("long").alias("first"), F.lit(b).cast("long").alias("last"), F.lit(s).alias("shard"), F.lit(t).cast("long").alias("slot")) for a, b, s, t in of]).cast(kind)


def _numbers(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _spread(groups: list, quota: list[int], room: list[int]) -> dict[str, list[tuple[int, int, int, int]]]:
    """Shards of the groups that fill one or more, largest first: whole free ones that hold most of it, then the fullest that has room for the rest. There
    are no more than twice as many such groups as shards; ``room`` is lessened by what they take."""
    out: dict[str, list[tuple[int, int, int, int]]] = {}
    for g in sorted(groups, key=lambda r: (-r.total, r.group)):
        order = [*g.ranked, *(s for s in range(len(quota)) if s not in g.ranked)]
        at, taken = 0, []
        while at < g.total:
            left = g.total - at
            whole = [s for s in order if 0 < room[s] == quota[s] <= left]
            fits = [s for s in order if room[s] >= left]
            s = whole[0] if whole else min(fits, key=lambda x: room[x]) if fits else max(order, key=lambda x: room[x])
            n = min(left, room[s])
            taken.append((at, at + n, s, 0))
            room[s] -= n
            at += n
        out[g.group] = taken
    return out


def propagate(groups: DataFrame, quota: list[int], room: list[int]) -> DataFrame:
    """Shards of ``groups(group, total, ranked)``, each of which fits into one: ``group, total, shard``, null where no shard has room for all of it. ``ranked``
    are the shards that its documents start in, those with most of them first; ``room`` is what each shard has left and is lessened.

    In a round each group without a shard asks for the first ``ranked`` with room for it, or else for any with room. A shard admits the large ones by
    falling size, of which there are a bounded number, and so many of the small ones as their sum allows, by a hash; the others ask again. Only sums by shard come to the driver.
    """
    least = max(1, max(quota) // RANKED)
    n, now, done = groups.count(), groups, []
    for k in range(ROUNDS if n else 0):
        open_ = _numbers(room)
        fits = lambda s: F.get(open_, s) >= F.col("total")
        near = F.get(F.filter("ranked", fits), F.lit(0))
        some = F.filter(_numbers(list(range(len(room)))), fits)
        asked = now.withColumn("to", F.coalesce(near, F.when(F.size(some) > 0, F.get(some, F.pmod(F.xxhash64("group", F.lit(k)), F.size(some)).cast("int")))))
        asked = stage(sized(asked, n), "shard-asked")
        large = asked.where((F.col("total") >= least) & F.col("to").isNotNull())
        order = Window.partitionBy("to").orderBy(F.desc("total"), "group").rowsBetween(Window.unboundedPreceding, 0)
        large = stage(sized(large.withColumn("enters", F.sum("total").over(order) <= F.get(open_, F.col("to"))), n), "shard-large")
        left = list(room)
        for r in large.where("enters").groupBy("to").agg(F.sum("total").alias("n")).collect():
            left[r.to] -= r.n
        little = asked.where((F.col("total") < least) & F.col("to").isNotNull())
        share = [0.0] * len(room)
        for r in little.groupBy("to").agg(F.sum("total").alias("n")).collect():
            share[r.to] = 1.0 if r.n <= left[r.to] else 0.98 * left[r.to] / r.n
        luck = F.pmod(F.xxhash64("group", F.lit(k), F.lit("luck")), F.lit(1 << 20)) / float(1 << 20)
        little = little.withColumn("enters", luck < F.get(_numbers(share), F.col("to")))
        after = large.unionByName(little).unionByName(asked.where("to is null").withColumn("enters", F.lit(False)))
        after = stage(sized(after, n), "shard-labels")
        unstage(asked)
        unstage(large)
        moved = after.where("enters").groupBy("to").agg(F.sum("total").alias("n")).collect()
        for r in moved:
            room[r.to] = max(0, room[r.to] - r.n)
        done.append(after.where("enters").select("group", "total", F.col("to").alias("shard")))
        now = after.where("not enters").drop("to", "enters")
        if not moved or now.isEmpty():
            break
    return reduce(DataFrame.unionByName, done, now.select("group", "total", F.lit(None).cast("int").alias("shard")))


def _placed(docs: DataFrame, shards: int) -> DataFrame:
    """``doc_id, size, text_crc32, group, shard, slot, n``: rows alike in all that counts as one, which holds ``n`` slots from ``slot`` on."""
    t = F.coalesce(F.col("text"), F.lit(""))
    group = F.when(F.col("text").isNotNull(), F.md5("text"))
    rows = docs.select("doc_id", (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), group.alias("group"))
    rows = stage(rows.groupBy("doc_id", "size", "text_crc32", "group").agg(F.count("*").alias("n")), "shard-rows")
    kinds, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    room, cap = list(quota), max(1, total // shards)

    cells = rows.where("group is not null").groupBy("group", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("s")).agg(F.sum("n").alias("n"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "s")))  # an entry a shard
    groups = cells.groupBy("group").agg(F.sum("n").alias("total"), F.transform(ranked, lambda x: x["s"]).alias("ranked")).where("total > 1")
    groups = stage(groups, "shard-groups")
    spread = _spread(groups.where(F.col("total") >= cap).collect(), quota, room)
    labels = propagate(groups.where(F.col("total") < cap), quota, room)

    in_spread = F.coalesce(F.col("group").isin(*spread), F.lit(False)) if spread else F.lit(False)
    own = F.xxhash64("doc_id", "group")
    placed = rows.where(~in_spread).join(labels, "group", "left")
    if spread:
        where = F.create_map(*[x for g, segments in spread.items() for x in (F.lit(g), _segments(segments))])
        large = _cut(_numbered(rows.where(in_spread), kinds, "group", own), where[F.col("group")])
        placed = placed.unionByName(large.drop("slot").withColumn("total", F.lit(None).cast("long")))
    placed = stage(placed, "shard-placed")
    linked = stage(_numbered(placed.where("shard is not null").drop("total"), kinds // shards + 1, "shard", own), "shard-linked")
    limit = F.get(_numbers(quota), F.col("shard"))
    inside = F.greatest(F.lit(0), F.least("n", limit - F.col("at")))
    stay = linked.withColumn("n", inside).where("n > 0").select("doc_id", "size", "text_crc32", "group", "shard", F.col("at").alias("slot"), "n")
    over = linked.withColumn("n", F.col("n") - inside).where("n > 0").select("doc_id", "size", "text_crc32", "group", "n", F.lit(None).cast("long").alias("total"))
    free = over.unionByName(placed.where("shard is null").select(*over.columns))
    taken = {r.shard: r.n for r in stay.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    holes, first = [], 0
    for s, q in enumerate(quota):
        here = q - taken.get(s, 0)
        if here:
            holes.append((first, first + here, s, taken.get(s, 0)))
        first += here
    # Groups that found no room are kept together in the order of the places left.
    together = F.when(F.col("total") <= NUMBERED, F.xxhash64("group")).otherwise(own)
    return stay.unionByName(_cut(_numbered(free, kinds, None, together), _segments(holes)))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, size, text_crc32, shard, slot``.

    The law is ``rows``: shards' counts are at most one apart, the first ones having one more; slots are gapless from 0. Documents of
    one text lie in as few shards as label propagation finds; those that found no room together and those without a twin fill the places left. The result
    depends on the rows alone, not on how the input is split.

    ``size`` is the text's UTF-8 bytes plus 16. Null text: size 16, crc of no bytes, no twin; empty texts are twins of one another. Null doc_ids and
    repeated rows get places of their own. Other columns are ignored. Empty in, empty out.
    """
    many = 1 << 16  # a row that repeats without end becomes rows in two steps
    blocks = _placed(docs, shards).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / many).cast("long"))))
    own = F.explode(F.sequence(F.col("k") * many, F.least(F.col("n"), (F.col("k") + 1) * many) - 1))
    return blocks.select("doc_id", "size", "text_crc32", F.col("shard").cast("int"), "slot", own.alias("i")).select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("i")).alias("slot"))


def cut_links(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row: ``links`` between documents of one text, and ``cut``, those of them whose ends ``shard_documents`` puts into different shards."""
    cells = _placed(docs, shards).where("group is not null").groupBy("group", "shard").agg(F.sum("n").cast("double").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    whole = cells.groupBy("group").agg(pairs(F.sum("n")).alias("links"), F.sum(pairs(F.col("n"))).alias("whole"))
    return whole.agg(F.coalesce(F.sum("links"), F.lit(0.0)).cast("long").alias("links"), F.coalesce(F.sum(F.col("links") - F.col("whole")), F.lit(0.0)).cast("long").alias("cut"))
