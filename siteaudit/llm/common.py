"""What several operators share: words, staged tables, sorted streams and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything else.
BREAKS = r"[\x20\x09-\x0D]+"

#: Bytes of rows that go to a Python worker at once.
SENT = 2 << 20

_own_folder: list[str] = []


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spare(taken: list[str], name: str) -> str:
    """``name``, with underscores behind it if a column of ``taken`` has it, in whatever case."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in local mode a folder of our own if unset."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-staged-"))
    return f"file://{_own_folder[0]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage: executors may be lost later without recomputing what came before, and
    several readers share one computation.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later step reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df``, staged, with an ``index`` from 0 without gaps, and the number of rows. Numbers are added to places in partitions; the driver gets one count a partition."""
    taken = stage(df.withColumn("_m", F.monotonically_increasing_id()), name)  # staged: places hold for good
    part = F.shiftright("_m", 33)
    starts, n = [], 0
    for p, rows in taken.groupBy(part.alias("p")).count().orderBy("p").collect():
        starts.append((p, n))
        n += rows
    first = taken.sparkSession.createDataFrame(starts, "_p long, _start long")
    out = taken.withColumn("_p", part).join(F.broadcast(first), "_p").withColumn("index", F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    out = out.select(*df.columns, "index")
    out.staged_at = taken.staged_at
    return out, n


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` short rows at most, in no more parts than they are worth, but one for each core."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // 100_000))


def small(df: DataFrame, rows: int, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """Mark ``df`` for broadcast if its counted size is under ``limit`` bytes; else leave the join to shuffle."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def with_text(docs: DataFrame, kept: list[str], text: str) -> tuple[DataFrame, int]:
    """``docs`` with the columns ``kept``, then ``text`` unless it is one of them, and the place of the text: it is sent to Python once."""
    at = next((i for i, c in enumerate(kept) if c.lower() == text.lower()), len(kept))
    more = [F.col(text).alias(spare(kept, "own_text"))] if at == len(kept) else []
    return docs.select(*[F.col(f"`{c}`") for c in kept], *more), at


def sent(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of about ``SENT`` bytes: Spark's 64 MB are held in the JVM, beside its heap, and again in the worker, by every task.

    Spark reads the size when a query runs, so it stays set for the session; a size that is set already is left.
    """
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(size, None) is None:
        df.sparkSession.conf.set(size, str(SENT))
    return df.mapInArrow(run, schema)


def pieces(batches: Iterable[pa.RecordBatch], column: str | int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about ``limit`` bytes of ``column`` (a name or a place), one row at least. Arrow's unused memory is given back after each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column) if isinstance(column, str) else column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0))
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
        del batch, col, sizes, ends
        pa.default_memory_pool().release_unused()


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` (not null) of a stream sorted by it, each as a table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(key))
        ends = pc.run_end_encode(col).run_ends.to_numpy()
        at = 0
        for end in ends:
            this = col[at].as_py()
            if held and this != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, int(end) - at))
            last, at = this, int(end)
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, pairs: Iterable[tuple[int, int]]) -> np.ndarray:
    """Smallest index that each of ``n`` nodes reaches over ``pairs``."""
    root = np.arange(n)
    for a, b in pairs:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
    for i in range(n):
        root[i] = root[root[i]]
    return root


def star(ids: np.ndarray, root: np.ndarray) -> tuple[list[int], list[int]]:
    """Links from the smallest id of each tree of ``forest`` to its other members: hubs are smallest ids, so that components settle in few rounds."""
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    hub = least[root]
    far = hub != ids
    return hub[far].tolist(), ids[far].tolist()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` of longs: one row ``(id, component)``
    for each node of an edge, ``component`` the smallest id reachable.

    Alternates large-star and small-star steps on the edge table, staged after each round, until all
    trees are stars; the rounds grow with the logarithm of the longest path. Minima
    are pre-aggregated before they are shuffled. Empty edges give an empty table.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stage(pairs, name)
    while True:
        n = pairs.count()
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Staged, so that the join reads two plain shuffles and a hub's can be split; not made distinct here, which would tie it to u.
        low = stage(sized(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), 2 * n), name)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = stage(sized(small_star.where("u <> v").distinct(), 2 * n), name)
        unstage(low)
        unstage(pairs)
        pairs = after
        # Done once all trees are stars: no node has two lower ones, or one and a higher one.
        ends = pairs.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(pairs.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty():
            break
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
