"""Exact top-k search by inner product, with MaxScore.

A dimension is a term: its posting list holds the vectors with a component other than 0 there, and a query's
weight times the largest component of the query's sign bounds what the list can add to a score. Vectors
are cut into shards. In each, a query's terms are split by the score that a candidate has to reach: terms whose bounds
together stay below it are non-essential. The others' lists are traversed; what is in none of them can't get in. The rest are
probed one after another for the candidates that may still get in. The best of all shards are merged.

Queries are a stated set, sent in groups of bounded size to all shards; a tile is one group with some shards, and the score to reach rises from shard to shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import groups, numbered, stage

#: Vectors of a shard and queries of a group at most, and bytes that the components of either may take.
SHARD, GROUP, BYTES = 4096, 65_536, 32 << 20
#: Queries times shards of a tile at most.
TILE = 1 << 16
#: Candidates that are scored first, for a score to reach.
FIRST = 64
#: Components are kept within this, either way, so that sums of 4,096 products stay exact.
MOST = 1 << 25


def whole(vector: Column, scale: float = 256.0) -> Column:
    """``floor(scale * x)`` of each component, as longs; null if the vector is null, or holds a null or a number that isn't finite."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(finite, F.transform(v, lambda x: F.greatest(F.least(F.floor(x * scale).cast("double"), F.lit(float(MOST))), F.lit(float(-MOST))).cast("long")))


def _packed(d: int):
    """Runs of one ``part`` as one row: places, ids and components, in the order of the columns."""

    def run(batches):
        for t in groups(batches, "part"):
            x = np.zeros((t.num_rows, d), np.int64)
            lists = t.column("x").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            x[np.repeat(np.arange(t.num_rows), sizes), at] = lists.flatten().to_numpy()
            ids = t.column("vec_id").to_numpy(zero_copy_only=False) if not t.column("vec_id").null_count else None
            known = np.ones(t.num_rows, bool) if ids is not None else np.asarray(t.column("vec_id").is_valid())
            ids = ids.astype(np.int64) if ids is not None else np.asarray(t.column("vec_id").fill_null(0), np.int64)
            place = t.column("index").to_numpy()
            yield pa.RecordBatch.from_arrays([t.column("part").combine_chunks()[:1], *[pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in (place, ids, known, x)]], ["part", "place", "ids", "known", "x"])

    return run


PACKED_COLUMNS = ("part", "place", "ids", "known", "x")


def packed(rows: DataFrame, part: Column, d: int) -> DataFrame:
    """``rows(index, vec_id, x)`` with a row for each ``part``."""
    cut = rows.select(part.alias("part"), "index", "vec_id", "x")
    return cut.repartition("part").sortWithinPartitions("part", "index").mapInArrow(_packed(d), "part long, place binary, ids binary, known binary, x binary")


class Shard:
    """Vectors by row and by term: for each dimension the rows with a component above and below 0."""

    def __init__(self, place: np.ndarray, ids: np.ndarray, known: np.ndarray, x: np.ndarray):
        self.place, self.ids, self.known, self.x = place, ids, known, x
        self.columns = np.ascontiguousarray(x.T)
        self.above = [np.flatnonzero(c > 0) for c in self.columns]
        self.below = [np.flatnonzero(c < 0) for c in self.columns]
        self.most, self.least = (np.maximum(x.max(axis=0), 0), np.minimum(x.min(axis=0), 0)) if len(x) else (np.zeros(x.shape[1], np.int64),) * 2
        # Of each list the rows with the largest components: where a first score to reach is looked for.
        n = max(1, FIRST // 8)
        self.top = [r[np.argsort(-c[r], kind="stable")[:n]] for r, c in zip(self.above, self.columns)], [r[np.argsort(c[r], kind="stable")[:n]] for r, c in zip(self.below, self.columns)]


def search(shard: Shard, q: np.ndarray, own: int, k: int, reach: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of a shard that may be among the best ``k`` of a query, with their scores, but for the row at place ``own``; and how many components were read. ``reach``: a score that k candidates elsewhere have already."""
    bound = np.where(q > 0, q * shard.most, q * shard.least)  # what a term can add at most
    order = np.argsort(-bound, kind="stable")
    order = order[(q != 0)[order]]
    # A first score to reach: that of the k-th of some rows that are high in the heaviest terms.
    lead = np.unique(np.concatenate([shard.top[int(q[t] < 0)][t] for t in order[:8]])) if len(order) else np.zeros(0, np.int64)
    lead = lead[shard.place[lead] != own]
    read = len(lead) * len(q)
    if len(lead) >= k:
        kth = int(np.partition(shard.x[lead] @ q, len(lead) - k)[len(lead) - k])
        reach = kth if reach is None else max(reach, kth)
    rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # what the terms from a place on can add
    # Non-essential: the longest tail of terms that stays below the score to reach. All are essential without one, or where it isn't above 0.
    split = len(order) if reach is None else int(np.searchsorted(-rest, -reach, "right"))
    split = min(split, len(order))
    score, seen = np.zeros(len(shard.place), np.int64), np.zeros(len(shard.place), bool)
    for t in order[:split]:
        for rows, adds in ((shard.above[t], q[t] > 0), (shard.below[t], q[t] < 0)):
            score[rows] += q[t] * shard.columns[t][rows]
            read += len(rows)
            if adds:
                seen[rows] = True
    if reach is None or reach <= 0:
        seen[:] = True  # a row in no list that adds to the score may get in
    seen[shard.place == own] = False
    rows = np.flatnonzero(seen)
    score = score[rows]
    for n, t in enumerate(order[split:], split):
        if reach is not None:
            fit = score + rest[n] >= reach
            rows, score = rows[fit], score[fit]
        score = score + q[t] * shard.columns[t][rows]
        read += len(rows)
    if len(rows) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        best = score >= kth if reach is None else score >= max(kth, reach)
    else:
        best = np.ones(len(rows), bool) if reach is None else score >= reach
    return rows[best], score[best], read


def _best(k: int, found: list) -> list:
    """The first k by falling score and rising id, null ids last, of tuples (-score, unknown, id)."""
    found.sort()
    return found[:k]


def _tiles(d: int, k: int):
    def run(batches):
        for tile in groups(batches, "tile"):
            queries, best = None, []
            for r in tile.select(["kind", "place", "ids", "known", "x"]).to_pylist():
                place, ids, known = np.frombuffer(r["place"], np.int64), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], bool)
                x = np.frombuffer(r["x"], np.int64).reshape(len(place), d)
                if r["kind"] == 0:  # the group, which comes first
                    queries, best = (place, ids, x), [[] for _ in place]
                    continue
                if queries is None:  # nothing is asked
                    break
                shard = Shard(place, ids, known, x)
                for n, (own, q) in enumerate(zip(queries[0].tolist(), queries[2])):
                    reach = -best[n][-1][0] if len(best[n]) == k else None
                    rows, scores, _ = search(shard, q, own, k, reach)
                    if len(rows):
                        best[n] = _best(k, best[n] + list(zip((-scores).tolist(), (~known[rows]).tolist(), ids[rows].tolist())))
            if queries is None:
                continue
            flat = [(int(p), int(i), -s, None if unknown else c) for p, i, b in zip(queries[0], queries[1], best) for s, unknown, c in b]
            places, query_ids, scores, found = zip(*flat) if flat else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (places, query_ids, found, scores)], ["place", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` rows of ``vectors(vec_id, embedding)`` with the highest inner products with each row that ``is_query`` holds for, but itself.

    Components become whole numbers first (``whole``), so scores are exact. Ties go to the smaller vec_id, null last.

    - Vectors that are null or hold a null or a number that isn't finite take no part. Shorter vectors count as if filled up with zeros, empty ones score 0. Components beyond +-2^25 count as that.
    - Rows, not ids, are searched: rows that share a vec_id are candidates each, and queries each (with equal query_id); a query's own row alone is left out. Null vec_ids are candidates.
    - Fewer than k other rows: all of them. Other columns are ignored. No queries or an empty table: no rows.
    - Work is queries times rows. A group of queries takes 32 MB at most, whatever their number; a shard 32 MB.
    """
    spark = vectors.sparkSession
    kept = vectors.select("vec_id", whole(F.col("embedding"), scale).alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("x is not null")
    rows, n = numbered(kept, "maxscore-rows")
    d, asked = rows.agg(F.max(F.size("x")), F.count_if("asks")).first()
    d = max(1, d or 1)
    size = max(1, min(SHARD, BYTES // (8 * d)))
    shards = stage(packed(rows, F.floor(F.col("index") / size), d), "maxscore-shards")
    asking, _ = numbered(rows.where("asks").select("vec_id", "x", F.col("index").alias("row")), "maxscore-queries")
    n_shards, cores = max(1, -(-n // size)), spark.sparkContext.defaultParallelism
    group = max(1, min(GROUP, BYTES // (8 * d), asked or 1))
    n_groups = max(1, -(-(asked or 0) // group))
    # Shards of a tile: as many as keep a task short and all cores busy. The group's queries keep their rows' places.
    across = max(1, min(TILE // group, -(-n_shards * n_groups // (2 * cores))))
    asking = packed(asking.select(F.col("row").alias("index"), "vec_id", "x", F.floor(F.col("index") / group).alias("of")), F.col("of"), d)
    columns = F.sequence(F.lit(0), F.lit((n_shards - 1) // across))
    sides = [
        asking.select(F.explode(columns).alias("to"), F.col("part").alias("group"), F.lit(0).alias("kind"), *PACKED_COLUMNS),
        shards.select(F.floor(F.col("part") / across).cast("int").alias("to"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))).alias("group"), F.lit(1).alias("kind"), *PACKED_COLUMNS),
    ]
    tile = (F.col("group") * F.lit(1 << 31) + F.col("to")).alias("tile")
    dealt = sides[0].unionByName(sides[1]).select(tile, "kind", *PACKED_COLUMNS)
    found = dealt.repartition("tile").sortWithinPartitions("tile", "kind", "part").mapInArrow(_tiles(d, k), "place long, query_id long, vec_id long, score long")
    # k rows a tile and query: what is merged is small, and cut before it is shuffled.
    place = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
