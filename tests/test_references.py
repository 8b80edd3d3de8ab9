"""Pages with references cut off before their semicolon, against the SQL of the queries that read them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from siteaudit.operators.tokens import tokenize, unnested
from siteaudit.queries import pages  # noqa: F401
from siteaudit.queries.registry import ORACLES, QUERIES

TITLES = ("x" * 58 + "&amp", "Salt &amp pepper &ampamp; &am &a", "Ends in &quot", "&copy 2020 &copy=1 &middot&eacute", "Nine &#38", "&quot;Whole&quot; &amp;amp; &AMP", "x" * 56 + "&amp;amp")
HREFS = ("/a?b=1&amp=2", "/a?b=1&ampc=2", "https://x.org/&amp", "/a&copy-b&quot", "/a?b&amp;copy=2&copy")


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cut")
    rows = [(i, f"https://a{i}.example.com/", f'<html><head><title>{title}</title></head><body><h1>{title}</h1><p>{title} and more</p><a href="{HREFS[i % len(HREFS)]}">{title}</a></body></html>') for i, title in enumerate(TITLES * 5)]
    rows = [(i, url, html) for i, (_, url, html) in enumerate(rows)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["c14_seo_score", "c1_c13_seo_checks", "e2_visible_text", "e3_overview", "e4_page_stats", "e6_classify_links", "i3_conversion_scores"])
def test_same_as_sql(spark, cut, name):
    df = QUERIES[name](spark, cut)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{cut}/pages.parquet/*.parquet'")
    con.execute(ORACLES[name])
    columns = [d[0] for d in con.description]
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r) for r in df.select(*columns).collect()) == key(con.fetchall())


def test_unnesting_does_not_compute_the_array_again(spark, sf):
    """The patterns of tokens stand once in the plan; before, a filter on the array repeated them."""
    for name in ("e1_tags", "e6_classify_links", "e5_external_links"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("noscript") == 1, name
    rows = unnested(spark.range(3).withColumn("x", F.sequence(F.lit(1), F.col("id").cast("int"))).where("id > 0"), F.col("x"), "id")
    assert sorted(map(tuple, rows.collect())) == [(1, 0, 1), (2, 0, 1), (2, 1, 2)]
    empty = spark.range(2).select("id", F.array().cast("array<int>").alias("x"))
    assert unnested(empty, F.col("x"), "id").count() == 0


def test_tags_without_attributes(spark):
    html = "<p><br/><br /><B\n><a\thref=x><i x><u =y><s/a='1'/>"
    tags = tokenize(spark.createDataFrame([(1, html)], "page_id long, html string")).first()["tags"]
    assert [(t["tag"], t["attrs"]) for t in tags] == [("p", {}), ("br", {}), ("br", {}), ("b", {}), ("a", {"href": "x"}), ("i", {"x": ""}), ("u", {"y": ""}), ("s", {"a": "1"})]


def test_head_is_searched_once_a_page(spark):
    """Before, the optimizer moved the search for the head into the function of each tag: work grew with the square of a page."""
    html = "<html><head><title>t</title><meta a=b></head><body><p class='x'>" + "<i>y</i>" * 50
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>no head")], "page_id long, html string")
    tags = tokenize(pages).select("page_id", "tags")
    plan = tags._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</head") == 1 and "transform(array(size(regexp_extract_all(regexp_extract(" in plan
    got = {r.page_id: [t["in_head"] for t in r.tags] for r in tags.collect()}
    assert got == {1: [True] * 4 + [False] * 52, 2: [], 3: [False]}


def test_marks_within_attributes(spark):
    """Attributes are parsed in one pass behind two control characters; tags that hold these give the same."""
    html = "<a href=\"x\x01y\" B=\x02 c b='2'><i a=1 A=2 c='&amp;\x02'><u a=\"&lt;\" a=3 / d = 'e f'>"
    tags = tokenize(spark.createDataFrame([(1, html)], "page_id long, html string")).first()["tags"]
    assert [t["attrs"] for t in tags] == [{"href": "x\x01y", "b": "\x02", "c": ""}, {"a": "1", "c": "&\x02"}, {"a": "<", "d": "e f"}]
