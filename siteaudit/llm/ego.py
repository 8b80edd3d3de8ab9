"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors with cosine >= c lie within eps = sqrt(2 - 2c). They are turned to their principal
axes, sorted by the grid cells (of width eps) of the leading ones and cut into
sequence intervals. Pairs of intervals are joined recursively: a pair whose bounding
boxes lie further apart than eps is skipped, with all that it holds; the pairs of
smallest intervals that remain are compared vector by vector. They are dealt to tasks in square tiles
of the pair matrix, so that an interval is sent once a tile, not once a pair.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, groups, stage, star, unstage

#: Vectors of a smallest interval, and of its parts in memory.
INTERVAL, PART = 4096, 512
#: Principal axes of the grid order and of the bounding boxes.
GRID_AXES, BOX_AXES = 8, 32
#: Children of an interval, in each step of the recursion.
FAN = 8
#: Intervals of a side of a tile at most, and the bytes that the vectors of a tile may take.
SIDE, TILE_BYTES = 8, 64 << 20


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows are neither zero nor hold a number that isn't finite."""
    x = x.astype(np.float64)
    with np.errstate(all="ignore"):
        top = np.abs(x).max(axis=1, initial=0)
        x = x / top[:, None]
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
    return x, np.isfinite(x).all(axis=1) & (top > 0)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def _moments(d: int):
    """Per task the sum of the outer products, a row of the matrix a record."""

    def run(batches):
        total, any_row = np.zeros((d, d)), False
        for batch in batches:
            x, ok = _unit(_matrix(batch.column(0), d))
            total += x[ok].T @ x[ok]
            any_row = any_row or ok.any()
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array([row.tobytes() for row in total], pa.binary())], ["k", "m"])

    return run


def _added(batches):
    """Sums of the rows of each k that a task got."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            row = np.frombuffer(m)
            total[k] = total[k] + row if k in total else row
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([row.tobytes() for row in total.values()], pa.binary())], ["k", "m"])


def principal_axes(vectors: DataFrame, d: int) -> np.ndarray:
    """Columns: axes by falling share of the second moment. Rows of the matrix are added up in tasks; the driver gets the d of the sum."""
    sums = vectors.select("v").mapInArrow(_moments(d), "k int, m binary").repartition("k").mapInArrow(_added, "k int, m binary")
    m = np.zeros((d, d))
    for k, row in sums.collect():
        m[k] = np.frombuffer(row)
    return np.linalg.eigh(m)[1][:, ::-1]


def _cells(d: int, axes: np.ndarray, width: float):
    """Adds the grid cell, as a key that sorts as the cells do."""

    def run(batches):
        for batch in batches:
            x, ok = _unit(_matrix(batch.column(2), d))
            cell = np.floor((x[ok] @ axes[:, :GRID_AXES]) / width).astype(np.int64)
            key = (cell + (1 << 15)).astype(">u2")
            kept = [c.filter(pa.array(ok)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([row.tobytes() for row in key], pa.binary())], ["id", "copies", "v", "cell"])

    return run


def _numbered(batches):
    """Adds the partition and the place in it."""
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        at = np.arange(n, n + batch.num_rows)
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part), pa.int32()), pa.array(at, pa.int64())], ["id", "copies", "v", "part", "at"])


def _intervals(d: int, axes: np.ndarray):
    """Runs of one ``seq`` as smallest intervals, each with its bounding box."""

    def run(batches):
        for t in groups(batches, "seq"):
            raw = _matrix(t.column("v").combine_chunks(), d)
            x = _unit(raw)[0] @ axes
            ids, copies = (np.ascontiguousarray(t.column(c).to_numpy()).tobytes() for c in ("id", "copies"))
            yield pa.RecordBatch.from_arrays([t.column("seq").combine_chunks()[:1], pa.array([ids], pa.binary()), pa.array([copies], pa.binary()), pa.array([np.ascontiguousarray(raw).tobytes()], pa.binary()), pa.array([x.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([x.max(axis=0).tolist()], pa.list_(pa.float64()))], ["seq", "ids", "copies", "vectors", "low", "high"])

    return run


def _close(a: str, b: str, eps: float):
    """Boxes no further apart than eps, with room for rounding."""
    gap = F.aggregate(
        F.zip_with(F.arrays_zip(f"{a}.low", f"{a}.high"), F.arrays_zip(f"{b}.low", f"{b}.high"), lambda x, y: F.greatest(F.lit(0.0), x["low"] - y["high"], y["low"] - x["high"])),
        F.lit(0.0), lambda s, g: s + g * g,
    )
    return gap <= eps * eps + 1e-9


def _hits(av: np.ndarray, bv: np.ndarray, ax: np.ndarray, bx: np.ndarray, least: float, eps: float):
    """Pairs of rows of two intervals that are linked: the recursion goes on in memory, over parts of ``PART`` rows."""
    single = av.astype(np.float32), bv.astype(np.float32)
    for i in range(0, len(av), PART):
        for j in range(0, len(bv), PART):
            p, q = ax[i : i + PART], bx[j : j + PART]
            gap = np.maximum(0, np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)))
            if gap @ gap > eps * eps + 1e-9:
                continue
            x, y = np.nonzero(single[0][i : i + PART] @ single[1][j : j + PART].T >= least - 1e-4)
            yield x + i, y + j


def _tiles(batches, d: int, kind: str, axes: np.ndarray):
    """Each wanted pair of intervals, with the intervals of its tile: ids, copies, unit vectors and their leading coordinates."""
    for t in groups(batches, "tile"):
        parts = {}
        for r in t.select(["seq", "ids", "copies", "vectors"]).to_pylist():
            v = _unit(np.frombuffer(r["vectors"], kind).reshape(-1, d))[0]
            parts[r["seq"]] = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["copies"], np.int64), v, v @ axes
        for p in t.column("wanted")[0].as_py():
            yield (p["a"], p["b"]), parts


def _link(d: int, kind: str, axes: np.ndarray, least: float, eps: float):
    """For each pair of intervals that a tile asks for: every vector's number of partners, and its links as a forest."""

    def run(batches):
        n_id, n_n, e_a, e_b = [], [], [], []
        for pair, parts in _tiles(batches, d, kind, axes):
            (ai, ac, av, ax), (bi, bc, bv, bx) = (parts[k] for k in pair)
            own = pair[0] == pair[1]
            counts = [np.zeros(len(ai), np.int64), np.zeros(len(bi), np.int64)]
            ids = ai if own else np.concatenate([ai, bi])
            root = np.arange(len(ids))
            for i, j in _hits(av, bv, ax, bx, least, eps):
                if own:
                    i, j = i[i < j], j[i < j]
                exact = np.einsum("kd,kd->k", av[i], bv[j]) >= least
                i, j = i[exact], j[exact]
                counts[0] += np.bincount(i, weights=bc[j], minlength=len(ai)).astype(np.int64)
                counts[1] += np.bincount(j, weights=ac[i], minlength=len(bi)).astype(np.int64)
                k = j if own else j + len(ai)
                apart = root[i] != root[k]
                if apart.any():
                    old = np.flatnonzero(root != np.arange(len(root)))
                    pairs = np.concatenate([np.stack([root[old], old], 1), np.stack([i[apart], k[apart]], 1)])
                    root = forest(len(ids), pairs.tolist())
            for name, n in ((ai, counts[0]), (bi, counts[1])):
                n_id += name[n > 0].tolist()
                n_n += n[n > 0].tolist()
            hubs, others = star(ids, root)
            e_a += hubs
            e_b += others
            if len(n_id) + len(e_a) > 20_000:
                yield _rows(n_id, n_n, e_a, e_b)
                n_id, n_n, e_a, e_b = [], [], [], []
        yield _rows(n_id, n_n, e_a, e_b)

    return run


def _rows(n_id, n_n, e_a, e_b):
    none = [None]
    return pa.RecordBatch.from_arrays([pa.array(n_id + e_a, pa.int64()), pa.array(n_n + none * len(e_a), pa.int64()), pa.array(none * len(n_id) + e_b, pa.int64())], ["a", "n", "b"])


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: ``vec_id, n_links, component_id, kept``.

    Two vectors are linked if their cosine, in double precision, is at least ``least`` (0 < least < 1); ``n_links`` counts a
    vector's links, ``component_id`` is the smallest vec_id reachable over links.

    - Equal arrays are joined as one vector that counts as often as it occurs, so copies aren't paired.
    - Vectors of each length are joined among themselves: a cosine of two lengths isn't defined. Each length is a pass of its own.
    - A vector that is null, empty, zero, or holds a null or a number that isn't finite links with nothing; its component is itself, and it is kept.
    - Null vec_id: ``n_links`` 0, ``component_id`` null, kept. Rows that share a vec_id are one node
      with the links of all. Other columns are ignored. Empty in, empty out.
    """
    kind = {"array<float>": "f4"}.get(vectors.select("embedding").dtypes[0][1], "f8")
    wide = "array<float>" if kind == "f4" else "array<double>"
    v = F.transform(F.col("embedding").cast(wide), lambda x: x + F.lit(0.0).cast(wide[6:-1]))  # -0.0 is 0.0
    vectors = vectors.select("vec_id", v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    classes = stage(valid.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "ego-classes")
    lengths = [r.d for r in classes.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]
    if not lengths:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    linked = reduce(DataFrame.unionByName, [_links(classes.where(F.size("v") == d), d, kind, wide, least) for d in lengths])

    degree = linked.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    found = components(linked.where("b is not null").select("a", "b"))
    per_class = classes.join(degree, "id", "left").join(found, "id", "left")
    per_class = per_class.select(F.col("v").alias("same"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    joined = vectors.join(per_class, (F.col("v") == F.col("same")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(alike: DataFrame, d: int, kind: str, wide: str, least: float) -> DataFrame:
    """Of vectors of ``d`` numbers, staged: partners of each, ``(a, n)``, and links as a forest, ``(a, b)``."""
    spark = alike.sparkSession
    eps = (2 - 2 * least) ** 0.5
    axes = principal_axes(alike, d)[:, :BOX_AXES]  # tasks get no more of them
    celled = alike.select("id", "copies", "v").mapInArrow(_cells(d, axes, eps), f"id long, copies long, v {wide}, cell binary")
    width = max(1, -(-celled.count() // (4 * INTERVAL)))
    ordered = celled.repartitionByRange(width, "cell", "id").sortWithinPartitions("cell", "id").select("id", "copies", "v")
    ordered = stage(ordered.mapInArrow(_numbered, f"id long, copies long, v {wide}, part int, at long"), "ego-order")
    starts, n = [], 0
    for part, rows in ordered.groupBy("part").count().orderBy("part").collect():  # one number for each range partition
        starts.append((part, n))
        n += rows
    first = spark.createDataFrame(starts, "part int, start long")
    seq = F.floor((F.col("start") + F.col("at")) / INTERVAL).alias("seq")
    cut = ordered.join(F.broadcast(first), "part").select(seq, "id", "copies", "v")
    leaves = cut.repartition("seq").sortWithinPartitions("seq", "id").mapInArrow(_intervals(d, axes), "seq long, ids binary, copies binary, vectors binary, low array<double>, high array<double>")
    leaves = stage(leaves, "ego-leaves")
    unstage(ordered)

    # A level up, FAN neighbours in the order make an interval; the top level is one.
    levels, n = [leaves.select("seq", "low", "high")], -(-n // INTERVAL)
    while n > 1:
        up = levels[-1].select(F.floor(F.col("seq") / FAN).alias("seq"), F.posexplode(F.arrays_zip("low", "high")).alias("k", "x"))
        up = up.groupBy("seq", "k").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
        up = up.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("k", "low", "high"))).alias("r"))  # BOX_AXES entries
        levels.append(stage(up.select("seq", F.col("r.low").alias("low"), F.col("r.high").alias("high")), "ego-level"))
        n = -(-n // FAN)
    pairs = spark.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"))
    for boxes in reversed(levels[:-1]):
        kids = F.sequence(F.lit(0), F.lit(FAN - 1))
        pairs = pairs.select((F.col("a") * FAN).alias("a"), "b", F.explode(kids).alias("k")).select((F.col("a") + F.col("k")).alias("a"), (F.col("b") * FAN).alias("b"))
        pairs = pairs.select("a", "b", F.explode(kids).alias("k")).select("a", (F.col("b") + F.col("k")).alias("b")).where("a <= b")
        sides = [boxes.select(F.col("seq").alias(x), F.struct("low", "high").alias(f"{x}x")) for x in "ab"]
        pairs = stage(pairs.join(sides[0], "a").join(sides[1], "b").where(_close("ax", "bx", eps)).select("a", "b"), "ego-pairs")
    # A tile holds 2 * side intervals at most, in double precision.
    side = max(1, min(SIDE, TILE_BYTES // (2 * INTERVAL * d * 8)))
    tile = F.floor(F.col("a") / side) * F.lit(1 << 31) + F.floor(F.col("b") / side)
    tiles = pairs.groupBy(tile.alias("tile")).agg(F.collect_list(F.struct("a", "b")).alias("wanted"))  # side * side pairs at most
    needed = F.array_distinct(F.flatten(F.transform("wanted", lambda p: F.array(p["a"], p["b"]))))
    joined = tiles.select("tile", "wanted", F.explode(needed).alias("seq")).join(leaves.select("seq", "ids", "copies", "vectors"), "seq")
    linked = joined.repartition("tile").sortWithinPartitions("tile", "seq").mapInArrow(_link(d, kind, axes, least, eps), "a long, n long, b long")
    return stage(linked, "ego-links")
