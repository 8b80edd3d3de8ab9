"""Pages as arrays of tags and visible text, read once and shared by all analyses."""

from __future__ import annotations

from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_RAW = r"(?is)<!--.*?(?:-->|$)|(<(script|style|noscript|iframe)\b(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>).*?(?:</\2\s*>|$)"
_TAG = r"<([a-zA-Z][a-zA-Z0-9]*+)(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>"
_ATTRIBUTE = r"(?s)([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+"
_REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?"
#: White space of texts.
SPACE = r"[\s \u0085]"


def _in_attribute(ref: str) -> str | None:
    """What a reference stands for in an attribute: the whole name has to be one, a shorter name that it begins with doesn't count."""
    return unescape(ref) if ref.startswith("&#") else html5.get(ref[1:])


@F.arrow_udf(ArrayType(StructType([StructField("ref", StringType()), StructField("char", StringType()), StructField("attr", StringType())])))
def _meanings(found: pa.Array) -> pa.Array:
    """The references of each page that stand for something, in texts or in attributes, the longest first, so that none is replaced within another."""
    rows = []
    for refs in found.to_pylist():
        row = []
        for r in sorted(refs or (), key=len, reverse=True):
            char, attr = unescape(r), _in_attribute(r)
            char = None if char == r or char.startswith("&") else char
            if char is not None or attr is not None:
                row.append({"ref": r, "char": char, "attr": attr})
        rows.append(row)
    return pa.array(rows, pa.list_(pa.struct([("ref", pa.string()), ("char", pa.string()), ("attr", pa.string())])))


def references(page: Column) -> Column:
    """The distinct character references of a page with their characters; that of the ampersand in texts is left to ``decoded``. Only references leave the JVM, not pages."""
    return _meanings(F.array_distinct(F.regexp_extract_all(page, F.lit(_REFERENCE), F.lit(0))))


def decoded(text: Column, refs: Column) -> Column:
    """``text`` with character references decoded; ``refs``: ``references`` of its page."""
    out = F.aggregate(F.filter(refs, lambda r: r["char"].isNotNull()), text, lambda t, r: F.replace(t, r["ref"], r["char"]))
    return F.when(text.contains("&"), F.regexp_replace(out, "&(?:amp|AMP|#0*38|#[xX]0*26);?", "&")).otherwise(text)


def decoded_attribute(value: Column, refs: Column) -> Column:
    """The value of an attribute with character references decoded, from left to right.

    There a name without a semicolon counts only if neither = nor a letter or digit follows, and only as a whole: ``x &copy y`` is decoded, ``?a=1&copy=2`` and ``&notit;`` stay.
    """
    pattern = _REFERENCE + "=?"

    def meant(found: Column) -> Column:
        ref = F.regexp_replace(found, "=$", "")
        kept = found.endswith("=") & ~ref.endswith(";") & ~ref.startswith("&#")
        char = F.get(F.filter(refs, lambda r: r["ref"] == ref), 0)["attr"]
        return F.when(kept, found).otherwise(F.concat(F.coalesce(char, ref), F.when(found.endswith("="), "=").otherwise("")))

    pieces = F.zip_with(F.split(value, pattern, -1), F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), lambda part, found: F.concat(part, F.coalesce(meant(found), F.lit(""))))
    return F.when(value.contains("&"), F.array_join(pieces, "")).otherwise(value)


def _attributes(raw: Column) -> Column:
    """Lower-case name -> value; the first of equal names counts. Tags that hold nothing but their name are told first; ``body`` and the names are bound once, as each use of an expression within a function of arrays computes it anew."""
    one = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)

    def of(body: Column) -> Column:
        group = lambda k: F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(k))
        values_ = F.zip_with(F.zip_with(group(2), group(3), lambda a, b: F.concat(a, b)), group(4), lambda a, b: F.concat(a, b))
        pairs = F.struct(F.transform(group(1), F.lower).alias("n"), values_.alias("v"))
        return one(pairs, lambda p: F.map_from_entries(F.filter(F.transform(p["n"], lambda k, i: F.when(F.array_position(p["n"], k) == i + 1, F.struct(k, decoded_attribute(F.get(p["v"], i), F.col("refs"))))), lambda e: e.isNotNull())))

    none = F.create_map().cast("map<string,string>")
    return F.when(raw.rlike(r"^<[a-zA-Z0-9]++/?>$"), none).otherwise(one(F.regexp_replace(raw, r"^<[a-zA-Z][a-zA-Z0-9]*+|/?>$", ""), of))


def tokenize(pages: DataFrame) -> DataFrame:
    """Adds ``tags``, ``array<struct<pos,tag,attrs:map,in_head>>``, ``bare``, the page without comments and the bodies of scripts, styles, noscripts and iframes, and ``lower``."""
    html = F.coalesce(F.col("html"), F.lit(""))
    out = pages.withColumn("refs", references(html)).withColumn("lower", F.lower(html)).withColumn("bare", F.regexp_replace(html, _RAW, "$1"))
    out = out.withColumn("_raw", F.regexp_extract_all("bare", F.lit(_TAG), F.lit(0)))
    name = lambda x: F.lower(F.regexp_extract(x, r"^<([a-zA-Z][a-zA-Z0-9]*)", 1))
    head = F.size(F.regexp_extract_all(F.regexp_extract("bare", r"(?is)^(.*?)</head\s*>", 1), F.lit(_TAG), F.lit(0)))
    # Bound outside the tags: as a column, the optimizer would move its pattern into their function, where the head is searched again for each tag.
    tags = lambda n: F.transform("_raw", lambda x, i: F.struct(i.alias("pos"), name(x).alias("tag"), _attributes(x).alias("attrs"), (i < n).alias("in_head")))
    return out.withColumn("tags", F.element_at(F.transform(F.array(head), tags), 1)).drop("_raw")


def visible_text(df: DataFrame) -> DataFrame:
    """Adds ``text_nodes`` (trimmed, not empty) and ``text``, the nodes joined by a space, of a tokenized page."""
    nodes = F.split(F.col("bare"), r"(?s)<[a-zA-Z/!?](?:[^\"'>]|\"[^\"]*\"|'[^']*')*+>")
    trimmed = F.transform(nodes, lambda x: F.regexp_replace(decoded(x, F.col("refs")), rf"^{SPACE}+|{SPACE}+$", ""))
    out = df.withColumn("text_nodes", F.filter(trimmed, lambda x: x != ""))
    return out.withColumn("text", F.array_join("text_nodes", " "))


def pick(tag: str | tuple, where=None) -> Column:
    """The tags of a name (or names) that meet ``where``, in order."""
    names = (tag,) if isinstance(tag, str) else tag
    return F.filter("tags", lambda t: t["tag"].isin(*names) & (where(t) if where else F.lit(True)))


def attr(t: Column, name: str) -> Column:
    """An attribute; "" if absent."""
    return F.coalesce(F.element_at(t["attrs"], name), F.lit(""))


def values(tags: Column, name: str) -> Column:
    return F.transform(tags, lambda t: attr(t, name))


def last(values_: Column) -> Column:
    return F.coalesce(F.try_element_at(values_, F.lit(-1)), F.lit(""))


def first_filled(values_: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(values_, lambda x: x != ""), F.lit(1)), F.lit(""))


def contains_any(text: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


def hidden(t: Column) -> Column:
    style = F.lower(attr(t, "style"))
    return (attr(t, "aria-hidden") == "true") | (attr(t, "hidden") != "") | contains_any(style, ("display:none", "display: none", "visibility:hidden", "visibility: hidden"))


def unnested(df: DataFrame, items: Column, *keys: str) -> DataFrame:
    """Long form: ``keys``, ``nth`` (from 0) and ``item``, a row for each of ``items``, none of which is null.

    By an outer generator: for others the optimizer infers a filter on the whole array and pushes it down, and the array's expression
    with it, below the columns it was made of, so that those are computed again and again.
    """
    return df.select(*keys, F.posexplode_outer(items).alias("nth", "item")).where("item is not null")


def prepared(pages: DataFrame) -> DataFrame:
    """Tokens, text, title and description: what the analyses read."""
    out = visible_text(tokenize(pages))
    title = F.regexp_extract_all(F.col("bare"), F.lit(r"(?is)<title\b[^>]*+>([^<]*+)"), F.lit(1))
    trimmed = F.regexp_replace(decoded(last(title), F.col("refs")), rf"^{SPACE}+|{SPACE}+$", "")
    meta = values(pick("meta", lambda t: F.lower(attr(t, "name")) == "description"), "content")
    return out.withColumn("title", trimmed).withColumn("description", last(meta))
