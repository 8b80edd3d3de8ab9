"""Strings found in one pass are those that a search for each finds."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siteaudit.operators import extract, insights, seo, tech, ux
from siteaudit.operators.marks import Literals, prefix_tree
from siteaudit.operators.page_marks import _PAGE
from siteaudit.operators.tokens import prepared


def found(literals, text):
    """What ``Literals.found`` gives, in plain Python: the same pattern."""
    return {m[1] for m in re.finditer(literals._pattern, text)}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("ab-] ", min_size=1, max_size=5), min_size=1, max_size=25), st.text("ab-] ", max_size=40))
def test_prefixes_tell_all(words, text):
    literals = Literals(words)
    got = found(literals, text)
    for w in words:
        assert (w in text) == any(f.startswith(w) for f in got)


def test_columns_against_search(spark):
    words = ["book", "book a ", "book a demo", "ok", "a", "$x", "[y]", "^", "a|b", "-", "é", "x\\", "/5", "k a d"]
    literals = Literals(words[:7], words[5:])
    texts = [None, "", "book a demo", "book a dem", "bo ok", "$x[y]^", "a|b-é", "x\\/5", "n", "BOOK", "book a " * 20_000 + "[y]"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("f", literals.found(F.col("t")))
    several = [("book", "^"), ("é", "/5"), tuple(words)]
    row = df.select("id", "t", *[literals.holds(F.col("f"), w).alias(f"w{i}") for i, w in enumerate(words)], *[literals.holds_any(F.col("f"), g).alias(f"g{i}") for i, g in enumerate(several)])
    for r in row.collect():
        for i, w in enumerate(words):
            assert r[f"w{i}"] == (None if r.t is None else w in r.t), (w, r.t and r.t[:30])
        for i, g in enumerate(several):
            assert r[f"g{i}"] == (None if r.t is None else any(w in r.t for w in g))


def test_what_is_not_looked_for_raises():
    literals = Literals(["one"])
    with pytest.raises(KeyError):
        literals.holds_any(None, ("two",))
    with pytest.raises(ValueError):
        Literals([""])
    assert prefix_tree(["ab", "abc"]) == "ab(?:c)?"


def test_a_page_is_read_once(spark):
    """All analyses that look for fixed strings share one pass, though each may be called alone."""
    df = prepared(spark.createDataFrame([(1, "https://a.example/", "<p>Try our free trial: rated 5/5, SSL secure. <ol><li>yoast")], "page_id long, url string, html string"))
    alone = ux.ux_signals(df).select("ux.social_proof", "ux.trust_signals", "ux.live_chat").first()
    assert tuple(alone) == (True, True, False)
    every = df
    for step in (extract.page_links, extract.page_stats, extract.overview, extract.intent_alignment, seo.seo_checks, ux.ux_signals, tech.ai_builder):
        every = step(every)
    every = insights.page_intent(every.withColumn("tech_categories", F.array().cast("array<string>")))
    plan = every.select("stats", "seo", "ux", "ai", "intent", "intent_match")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(_PAGE._pattern[:60]) == 1
    assert every.select("ux").first().ux.social_proof is True
