"""Roll-ups of crawls merged from partial results against roll-ups of all rows, and how far their estimates of distinct pages are off."""

from pyspark.sql import functions as F

from siteaudit.operators import rollups
from siteaudit.sources.staging import shared_path

DIMS = ["category", "name"]


def rows_of(spark, n):
    k = F.col("id")
    found = spark.range(n).select((k % (n // 2)).alias("page_id"), F.when(k % 7 > 0, F.concat(F.lit("c"), (k % 3).cast("string"))).alias("category"), F.concat(F.lit("n"), (k % 5).cast("string")).alias("name"), (k % 11).alias("score"))
    return found.withColumn("page_id", F.when(F.col("page_id") > 0, F.col("page_id")))  # null pages are rows, not pages


def exact(rows, cube=False):
    grouped = rows.cube(*DIMS) if cube else rows.rollup(*DIMS)
    return sorted(map(repr, grouped.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"), F.sum("score").cast("double").alias("sum_score")).collect()))


def test_union_of_crawls_in_any_order(spark):
    rows = rows_of(spark, 3_000)
    a, b, c = (rollups.partials(rows.where(w), DIMS, sums=["score"]) for w in ("page_id % 3 = 0", "page_id % 3 = 1", "page_id % 3 = 2 or page_id is null"))
    for cube in (False, True):
        assert sorted(map(repr, rollups.rolled(a.unionByName(b).unionByName(c), DIMS, cube).collect())) == exact(rows, cube)
    once = rollups.merged(c.unionByName(rollups.merged(b.unionByName(a), DIMS)), DIMS)
    assert sorted(map(repr, rollups.rolled(once, DIMS).collect())) == exact(rows)
    assert sorted(map(repr, rollups.rolled(once, DIMS, True).collect())) == exact(rows, True)
    # A page of two crawls counts once as a page.
    both = rollups.rolled(a.unionByName(a), DIMS).where("level = 3").first()
    assert both.pages == rows.where("page_id % 3 = 0").select("page_id").distinct().count() and both.n == 2 * rows.where("page_id % 3 = 0").count()


def test_published_again_and_in_part(spark):
    rows, path = rows_of(spark, 600), shared_path(spark, "test-rollups")
    assert rollups.published(spark, path) is None
    rollups.publish(rollups.partials(rows.where("page_id < 100"), DIMS), path, "1")
    rollups.publish(rollups.partials(rows.where("page_id >= 50 or page_id is null"), DIMS), path, "2")
    rollups.publish(rollups.partials(rows.where("page_id < 100"), DIMS), path, "1")
    total = rollups.rolled(rollups.published(spark, path), DIMS).where("level = 3").first()
    assert total.pages == 299 and total.n == rows.where("page_id < 100").count() + rows.where("page_id >= 50 or page_id is null").count()
    assert rollups.rolled(rollups.published(spark, path, ["1"]), DIMS).where("level = 3").first().pages == 99
    assert rollups.partials(rows.limit(0), DIMS).collect() == []


def test_error_of_large_counts(spark):
    """Beyond the size up to which a sketch is exact: within three standard errors of 0.4 %."""
    rows = rows_of(spark, 400_000)
    got = rollups.rolled(rollups.partials(rows, DIMS), DIMS).where("level = 3").first().pages
    assert abs(got - 199_999) < 3 * 0.0041 * 199_999
