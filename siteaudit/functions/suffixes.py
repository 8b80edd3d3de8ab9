"""Public suffixes and the sites that are registered under them.

A rule is a name (``com.pl``), a wildcard (``*.ck``: any one label more) or an exception to one (``!www.ck``). Of the rules that a host ends in,
an exception counts before all, else the longest; a host that no rule fits has its last label as suffix. A site is
the suffix and one label more.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: ``key``: what a host has to end in; ``kind``: name, wildcard or exception.
RULES = "key string, kind string"
MOST_RULES = 100_000

#: Second-level names under which many countries register, and the countries.
_SECOND = {
    "com net org edu gov": "ar au bd bh bo br bz cn co do ec eg gh gt hk hn jm kh kw lb lk ly mx my ng ni np pa pe ph pk pl pr py qa ro ru sa sg sv tr tw ua uy ve vn",
    "co or ac go ne": "jp kr th id tz ug",
    "co org net ac": "nz za in il uk ke",
}
#: Countries that register at the third level only, but for some names.
_WILD = "*.ck !www.ck *.kawasaki.jp !city.kawasaki.jp *.kobe.jp !city.kobe.jp *.nagoya.jp !city.nagoya.jp *.yokohama.jp !city.yokohama.jp *.mm *.np *.bd *.er *.fk *.jm *.kh *.pg *.compute.amazonaws.com"
#: Other names under which sites of many owners stand.
_OTHER = """gov.uk ltd.uk me.uk plc.uk sch.uk id.au asn.au gob.mx gob.ar govt.nz school.nz gov.in nic.in firm.in gov.za web.za info.pl waw.pl biz.pl
github.io gitlab.io vercel.app netlify.app web.app firebaseapp.com herokuapp.com pages.dev workers.dev fly.dev onrender.com surge.sh glitch.me repl.co webflow.io wixsite.com
myshopify.com azurewebsites.net cloudfront.net blogspot.com appspot.com s3.amazonaws.com lovable.app framer.website uk.com us.com eu.com"""


def parsed(line: str) -> tuple[str, str] | None:
    """A line of the list as key and kind; null for comments and empty ones. Only what stands before white space counts."""
    rule = (line or "").split()[0].lower() if (line or "").split() else ""
    if not rule or rule.startswith("//"):
        return None
    kind, key = ("exception", rule[1:]) if rule[0] == "!" else ("wildcard", rule[2:]) if rule.startswith("*.") else ("name", rule)
    return (key.strip(".") or "", kind) if key.strip(".") else None


def common_rules() -> list[tuple[str, str]]:
    """The built-in rules: the most common ones only."""
    names = [f"{a}.{b}" for seconds, countries in _SECOND.items() for b in countries.split() for a in seconds.split()]
    return sorted({parsed(x) for x in (*names, *_WILD.split(), *_OTHER.split())})


def common_suffixes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(common_rules(), RULES)


@F.arrow_udf(ArrayType(StructType([StructField("key", StringType()), StructField("kind", StringType())])))
def _both_forms(lines: pa.Array) -> pa.Array:
    """A rule as it stands and, if it has letters beyond ASCII, in the form that hosts have them in."""
    out = []
    for line in lines.to_pylist():
        rule, forms = parsed(line), []
        if rule:
            forms.append({"key": rule[0], "kind": rule[1]})
            if not rule[0].isascii():
                try:
                    forms.append({"key": rule[0].encode("idna").decode(), "kind": rule[1]})
                except UnicodeError:
                    pass
        out.append(forms)
    return pa.array(out, pa.list_(pa.struct([("key", pa.string()), ("kind", pa.string())])))


def load_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a file in the form in which the list is published: one a line, comments behind //."""
    rules = spark.read.text(path).select(F.explode(_both_forms("value")).alias("r")).select("r.key", "r.kind")
    return rules.distinct()


def host_of(url: Column) -> Column:
    """The host of an address in lower case; "" if it has none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def with_sites(df: DataFrame, host: str, rules: DataFrame, name: str = "site") -> DataFrame:
    """Adds the site of each ``host``: the host itself if it is a suffix, or no name at all (null stays null, "" is "").

    An equi-join of all that a host ends in with the rules; only distinct hosts are looked up. Repeated rules count once.
    """
    hosts = df.select(F.col(f"`{host}`").alias("h")).where("h is not null").distinct().withColumn("labels", F.split("h", r"\."))
    n = F.size("labels")
    ends = hosts.select("h", "labels", F.explode(F.sequence(F.lit(1), n)).alias("k"))
    ends = ends.select("h", "labels", "k", F.array_join(F.slice("labels", F.size("labels") - F.col("k") + 1, F.col("k")), ".").alias("key"))
    found = ends.join(rules.select("key", "kind").distinct(), "key", "left")
    own = F.when(F.col("kind") == "exception", F.struct(F.lit(1).alias("first"), (F.col("k") - 1).alias("n")))
    own = own.when(F.col("kind") == "wildcard", F.struct(F.lit(0).alias("first"), (F.col("k") + 1).alias("n"))).when(F.col("kind") == "name", F.struct(F.lit(0).alias("first"), F.col("k").alias("n")))
    # A wildcard holds only where there is a label for it.
    fits = (F.col("kind") != "wildcard") | (F.col("k") < F.size("labels"))
    best = found.groupBy("h").agg(F.first("labels").alias("labels"), F.max(F.when(fits, own)).alias("best"))
    keep = F.coalesce("best.n", F.lit(1)) + 1
    proper = ~F.exists("labels", lambda x: x == "") & (F.size("labels") >= keep)
    site = F.when(proper, F.array_join(F.slice("labels", F.size("labels") - keep + 1, keep), ".")).otherwise(F.col("h"))
    sites = best.select(F.col("h").alias("_h"), site.alias(name))
    return df.join(sites, F.col(f"`{host}`") == F.col("_h"), "left").drop("_h")


class Sites:
    """The same for hosts that are met within a task; the rules are sent once."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.kinds: dict[str, set[str]] = {}
        for key, kind in rules:
            self.kinds.setdefault(key, set()).add(kind)

    def of(self, host: str) -> str:
        labels = host.split(".")
        if "" in labels:
            return host
        suffix, excepted = 1, 0
        for k in range(1, len(labels) + 1):
            kinds = self.kinds.get(".".join(labels[-k:]), ())
            if "exception" in kinds:
                excepted = k - 1
            if "wildcard" in kinds and k < len(labels):
                suffix = max(suffix, k + 1)
            if "name" in kinds:
                suffix = max(suffix, k)
        suffix = excepted or suffix
        return ".".join(labels[-suffix - 1 :]) if len(labels) > suffix else host


def sites_in_tasks(rules: DataFrame) -> Sites:
    """``Sites`` of a table of rules, which is sent to tasks: more than ``MOST_RULES`` raise."""
    found = rules.select("key", "kind").distinct().limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules of suffixes")
    return Sites([tuple(r) for r in found])
