"""Sites under public suffixes: the test vectors that are published with the list, by join and in tasks."""

from pyspark.sql import functions as F

from siteaudit.functions.suffixes import Sites, common_rules, common_suffixes, load_suffixes, parsed, sites_in_tasks, with_sites
from siteaudit.operators import tech

#: The rules that the vectors are about, in the form of the published file.
LIST = """// comment
com
biz
uk.com
ac
jp
ac.jp
kyoto.jp
ide.kyoto.jp   trailing words are not part of it
*.kobe.jp
!city.kobe.jp
*.ck
!www.ck
*.mm

us
ak.us
k12.ak.us
cn
com.cn
公司.cn
中国
vercel.app
"""
#: Hosts and the sites that they belong to; None where the host is itself a suffix.
VECTORS = {
    "com": None, "example.com": "example.com", "b.example.com": "example.com", "a.b.example.com": "example.com", "example": None, "example.example": "example.example", "b.example.example": "example.example",
    "biz": None, "domain.biz": "domain.biz", "a.b.domain.biz": "domain.biz", "uk.com": None, "example.uk.com": "example.uk.com", "a.b.example.uk.com": "example.uk.com", "test.ac": "test.ac",
    "mm": None, "c.mm": None, "b.c.mm": "b.c.mm", "a.b.c.mm": "b.c.mm", "jp": None, "test.jp": "test.jp", "www.test.jp": "test.jp", "ac.jp": None, "test.ac.jp": "test.ac.jp", "www.test.ac.jp": "test.ac.jp", "kyoto.jp": None, "test.kyoto.jp": "test.kyoto.jp",
    "ide.kyoto.jp": None, "b.ide.kyoto.jp": "b.ide.kyoto.jp", "a.b.ide.kyoto.jp": "b.ide.kyoto.jp", "c.kobe.jp": None, "b.c.kobe.jp": "b.c.kobe.jp", "a.b.c.kobe.jp": "b.c.kobe.jp", "city.kobe.jp": "city.kobe.jp", "www.city.kobe.jp": "city.kobe.jp",
    "ck": None, "test.ck": None, "b.test.ck": "b.test.ck", "a.b.test.ck": "b.test.ck", "www.ck": "www.ck", "www.www.ck": "www.ck", "us": None, "test.us": "test.us", "www.test.us": "test.us", "ak.us": None, "test.ak.us": "test.ak.us",
    "k12.ak.us": None, "test.k12.ak.us": "test.k12.ak.us", "www.test.k12.ak.us": "test.k12.ak.us", "食狮.com.cn": "食狮.com.cn", "食狮.公司.cn": "食狮.公司.cn", "www.食狮.公司.cn": "食狮.公司.cn", "公司.cn": None,
    "xn--85x722f.com.cn": "xn--85x722f.com.cn", "xn--85x722f.xn--55qx5d.cn": "xn--85x722f.xn--55qx5d.cn", "www.xn--85x722f.xn--55qx5d.cn": "xn--85x722f.xn--55qx5d.cn", "xn--55qx5d.cn": None, "xn--85x722f.xn--fiqs8s": "xn--85x722f.xn--fiqs8s", "xn--fiqs8s": None,
    ".com": None, "a..com": None, "": None, "a.vercel.app": "a.vercel.app", "b.vercel.app": "b.vercel.app",
}


def test_published_vectors(spark, tmp_path):
    (tmp_path / "list.dat").write_text(LIST, encoding="utf-8")
    rules = load_suffixes(spark, str(tmp_path / "list.dat"))
    hosts = spark.createDataFrame([(h, 1) for h in [*VECTORS, *VECTORS, None]], "host string, key int")
    got = with_sites(hosts, "host", rules).collect()
    assert len(got) == 2 * len(VECTORS) + 1
    assert {r.host: r.site for r in got} == {h: s or h for h, s in VECTORS.items()} | {None: None}
    in_tasks = sites_in_tasks(rules)
    assert {h: in_tasks.of(h) for h in VECTORS} == {h: s or h for h, s in VECTORS.items()}
    assert with_sites(hosts.limit(0), "host", rules).collect() == []
    assert {r.site for r in with_sites(hosts.where("host = 'a.b.example.uk.com'"), "host", rules.limit(0)).collect()} == {"uk.com"}


def test_lines_of_the_list():
    assert [parsed(x) for x in ("", "  ", "// x", None, "Com.PL x", "*.ck", "!www.ck", ".", "!")] == [None, None, None, None, ("com.pl", "name"), ("ck", "wildcard"), ("www.ck", "exception"), None, None]
    sites = Sites(common_rules())
    assert sites.of("a.com.pl") != sites.of("b.com.pl") and sites.of("www.a.com.pl") == "a.com.pl" and sites.of("www.city.kobe.jp") == "city.kobe.jp"


def test_plan_is_an_equi_join(spark):
    hosts = spark.createDataFrame([("a.com.pl",)], "host string")
    plan = with_sites(hosts, "host", common_suffixes(spark))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_own_site_and_others(spark):
    """First party and third party under suffixes of two labels and under a host of many sites."""
    rules = tech.core_rules(spark).where("name = 'WordPress'")
    page = lambda host: f'<link href="https://{host}/wp-content/themes/x.css">'
    rows = [(1, "https://a.com.pl/", page("b.com.pl")), (2, "https://a.com.pl/", page("cdn.a.com.pl")), (3, "https://a.vercel.app/", page("b.vercel.app")), (4, "https://www.a.vercel.app/", page("a.vercel.app")), (5, "https://x.a.ck/", page("y.b.ck"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    origin = {r.page_id: r.source for r in tech.tech_matches(pages, rules).where("pattern = '/wp-content/'").collect()}
    assert origin == {1: "third-party", 2: "first-party", 3: "third-party", 4: "first-party", 5: "third-party"}
    with_more = tech.tech_matches(pages, rules, spark.createDataFrame([("ck", "wildcard")], "key string, kind string")).where(F.col("pattern") == "/wp-content/")
    assert {r.page_id: r.source for r in with_more.collect()} == {1: "first-party", 2: "first-party", 3: "first-party", 4: "first-party", 5: "third-party"}
