"""Roll-ups that are kept up from crawl to crawl.

A crawl leaves a small table of partial results: for each combination of the dimensions and each range of 32,768 page numbers the rows, sums,
and a bitmap of the pages. Partial results of crawls are merged by adding counts and uniting bitmaps, in any order; roll-ups and cubes are
made of them, so that no distinct count under a roll-up ever reads all pages again. Counts are exact. A bitmap takes 4 KB, most of it zeros
that compress where page numbers lie far apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit.sources.registers import exists


def partials(rows: DataFrame, dims: Sequence[str], page: str = "page_id", sums: Sequence[str] = ()) -> DataFrame:
    """``dims, range, n, pages`` and ``sum_x`` for each of ``sums``: one row for each combination of dimensions and range of pages that occurs, nulls included.
    ``page`` is a whole number. Null pages count in ``n`` but not as pages."""
    own = [F.sum(F.col(c).cast("double")).alias(f"sum_{c}") for c in sums]
    return rows.groupBy(*dims, F.bitmap_bucket_number(page).alias("range")).agg(F.count("*").alias("n"), F.bitmap_construct_agg(F.bitmap_bit_position(page)).alias("pages"), *own)


def merged(parts: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Partial results of several crawls as those of all of them."""
    own = [F.sum(c).alias(c) for c in parts.columns if c.startswith("sum_")]
    return parts.groupBy(*dims, "range").agg(F.sum("n").alias("n"), F.bitmap_or_agg("pages").alias("pages"), *own)


def publish(parts: DataFrame, path: str, crawl: str) -> None:
    """Partial results of a crawl in a folder of their own; a crawl that is published again replaces it and nothing else."""
    parts.coalesce(1).withColumn("crawl", F.lit(crawl)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("crawl").parquet(path)


def published(spark: SparkSession, path: str, crawls: Sequence[str] | None = None) -> DataFrame | None:
    """Partial results of all crawls, or of some: folders of others aren't read. None where nothing is published."""
    if not exists(spark, path):
        return None
    parts = spark.read.parquet(path)
    return parts if crawls is None else parts.where(F.col("crawl").cast("string").isin(*crawls))


def rolled(parts: DataFrame, dims: Sequence[str], cube: bool = False) -> DataFrame:
    """Totals by all prefixes of the dimensions, or by all subsets: ``dims, level, n, pages`` (how many) and ``sum_x``. ``level``: which dimensions are summed over, as ``grouping_id`` has it."""
    own = [c for c in parts.columns if c.startswith("sum_")]
    sets = [c for k in range(len(dims) + 1) for c in combinations(dims, k)] if cube else [dims[:k] for k in range(len(dims) + 1)]
    # Bitmaps are united range by range, so that no group holds more than one; the range is never summed over and is the last bit of the id.
    ranges = parts.groupingSets([[*map(F.col, s), F.col("range")] for s in sets], *dims, "range")
    united = ranges.agg(F.shiftright(F.grouping_id(), 1).alias("level"), F.sum("n").alias("n"), F.bitmap_count(F.bitmap_or_agg("pages")).alias("pages"), *[F.sum(c).alias(c) for c in own])
    return united.groupBy(*dims, "level").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"), *[F.sum(c).alias(c) for c in own])
