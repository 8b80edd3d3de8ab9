"""Distinct pages of roll-ups are counted exactly, however many there are."""

from pyspark.sql import functions as F

from siteaudit.operators import rollups


def test_large_counts_are_exact(spark):
    """Before, they were estimated beyond some 8,000 pages of a group."""
    pages = spark.range(-20_000, 80_000).select(F.col("id").alias("page_id"), (F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b"), F.lit(2).alias("score"))
    parts = [rollups.partials(pages.where(w), ["a", "b"], sums=["score"]) for w in ("page_id < 60000", "page_id >= 10000")]
    for cube in (False, True):
        got = rollups.rolled(parts[0].unionByName(parts[1]), ["a", "b"], cube)
        want = (pages.cube("a", "b") if cube else pages.rollup("a", "b")).agg(F.grouping_id().alias("level"), F.count("*").alias("pages"))
        assert sorted(map(repr, got.select("a", "b", "level", "pages").collect())) == sorted(map(repr, want.collect()))
        total = got.where("level = 3").first()
        assert (total.n, total.pages, total.sum_score) == (150_000, 100_000, 300_000.0)
