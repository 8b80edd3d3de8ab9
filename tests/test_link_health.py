"""Link health of pages with more than a few links: every link counts."""

import duckdb
import pytest

from siteaudit.operators import extract
from siteaudit.queries import pages  # noqa: F401
from siteaudit.queries.registry import ORACLES, QUERIES

COUNTS = (0, 1, 29, 30, 31, 32, 75, 400)


def test_every_link_counts(spark):
    """Before, the links of a page beyond the first 30 were left out."""
    rows = [(n, k, f"https://s{k}.net/p") for n in COUNTS for k in range(n)]
    links = spark.createDataFrame(rows, "page_id int, nth int, href string")
    # Of ten links: 0 and 1 broken (status 500 and 0), 2 redirected, 3 not probed, 4 without an end address, the others fine.
    probes = [(f"https://s{k}.net/p", {0: 500, 1: 0}.get(k % 10, 200), {2: "https://t.net/p", 4: None}.get(k % 10, f"https://s{k}.net/p?x#y")) for k in range(400) if k % 10 != 3]
    got = {r.page_id: tuple(r)[1:] for r in extract.link_health(links, spark.createDataFrame(probes, "href string, status int, final_url string")).collect()}
    of = lambda n, *ks: sum(k % 10 in ks for k in range(n))
    assert got == {n: (n, of(n, 0, 1, 3), of(n, 2), of(n, 4, 5, 6, 7, 8, 9)) for n in COUNTS if n}


@pytest.fixture(scope="module")
def linked(spark, tmp_path_factory):
    """Pages with as many external links; beyond these a link that repeats one, and what the query adds by page_id: probed links at the very end."""
    folder = tmp_path_factory.mktemp("linked")
    anchors = lambda n: "".join(f'<a href="https://s{k}.example.net/p?x={k}">{k}</a><a href="/in{k}">in</a>' for k in range(n)) + ('<a href="https://s0.example.net/p?again">0</a>' if n else "")
    rows = [(i, f"https://a{i}.example.com/", f"<html><head><title>t</title></head><body>{anchors(n)}</body></html>") for i, n in enumerate(COUNTS * 5)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_same_as_sql(spark, linked):
    df = QUERIES["e7_link_health"](spark, linked)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{linked}/pages.parquet/*.parquet'")
    con.execute(ORACLES["e7_link_health"])
    columns = [d[0] for d in con.description]
    want = sorted(con.fetchall())
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == want
    checked = columns.index("checked")
    assert {r[checked] for r in want} == {n + more for n in COUNTS for more in (0, 2)} - {0}
