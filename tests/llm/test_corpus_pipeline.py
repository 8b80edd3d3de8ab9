"""The pipeline's stages on given documents, each against its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from siteaudit.llm import minhash, quality


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("text", F.when(F.col("doc_id") == 7, None).otherwise(F.col("text")))
    seen = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, seen, sf).persist()
        assert after.columns == docs.columns, name
        if name.startswith("MinHash"):
            assert after.count() == minhash.near_duplicates(seen).where("kept").count()
            assert minhash.near_duplicates(after).where("not kept").count() == 0
        elif name.startswith("secret"):
            assert after.count() == seen.count() and not after.where("text rlike 'AKIA[A-Z0-9]{16}'").count()
        elif name.startswith("quality"):
            assert not quality.text_stats(after).where(quality.base_failed()).count()
        else:
            assert after.join(seen, "doc_id", "left_anti").count() == 0
        seen = after
    out = corpus_pipeline.STAGES[-1][1](spark, seen, sf)
    assert out.count() == seen.count() > 50


def test_stages_on_odd_rows(spark, sf):
    """Repeated rows, shared and null ids, null and empty texts, clashing names and empty tables, each stage against a brute-force version."""
    said = " ".join(f"word{i} of the text" for i in range(40)) + "."
    near = said.replace("word7 ", "other ")
    rows = [(7, said, "a", 1), (7, said, "a", 1), (8, near, "a", 1), (9, said, None, 1), (9, "unlike " + " ".join(f"z{i}" for i in range(60)), None, 1), (None, said, "b", 1), (None, None, "b", 1), (11, "", "b", 0)]
    rows += [(100 + k, f"key{k} " + " ".join(f"u{k}x{i}" for i in range(50)) + " password = hunter2hunter2", "c", 1) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    docs = docs.withColumns({n: F.lit(f"its {n}") for n in ("own_row", "n_words", "kept", "secrets", "hit", "own", "again", "count", "_text", "size", "copy", "n")})
    docs = docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    seen = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        none = step(spark, docs.limit(0), sf)
        assert none.columns == docs.columns and none.count() == 0, name
        out = step(spark, seen, sf)
        assert out.columns == docs.columns, name
        got = sorted((r.doc_id or -1, r.text or "") for r in out.collect())
        before = sorted((r.doc_id or -1, r.text or "") for r in seen.collect())
        if name.startswith("quality"):
            assert got == [x for x in before if len(x[1].split()) >= 10]
        elif name.startswith("MinHash"):
            unlike = [x for x in before if x[0] == 9 and x[1] != said]
            assert len(unlike) == 1 and got == sorted([(-1, said), (7, said), *unlike, *[x for x in before if x[0] >= 100]])
        elif name.startswith("secret"):
            assert [x for x, _ in got] == [x for x, _ in before] and all("hunter2" not in t for _, t in got)
            assert all(r.n_chars == len(r.text) for r in out.collect())
        else:
            sizes = {x: len(x[1].split()) for x in before}
            assert set(got) <= set(before) and all(got.count(x) <= 3 * before.count(x) for x in set(got))
            assert abs(sum(sizes[x] for x in got) - sum(sizes.values())) <= 3 * max(sizes.values())
        assert all(r["own_row"] == "its own_row" and r["n_words"] == "its n_words" for r in out.collect())
        seen = out
    assert corpus_pipeline.encoded_documents(spark, seen, sf).count() == len(got)


def test_no_text_of_a_shared_id_is_lost(spark, sf):
    said, other, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    near = said.replace("x7 ", "x ")
    rows = [(7, said), (9, said), (9, other), (9, other), (3, third), (3, near), (5, third), (2**63 - 2, other), (2**63 - 2, None), (2**63 - 2, ""), (-4, "")]
    out = corpus_pipeline.single_documents(spark, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, number int"), sf)
    assert out.columns == ["doc_id", "text", "number"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(3, near), (9, other), (3, third), (2**63 - 2, None), (2**63 - 2, ""), (-4, "")], key=repr)


def test_texts_go_to_python_once(spark, sf):
    """Before, the secret scan sent each text three times and took two back, the encoding sent two and took one back that no step read."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", F.col("text"))
    for step, back in ((corpus_pipeline.clean_documents, 1), (corpus_pipeline.encoded_documents, 0)):
        plan = step(spark, docs, sf)._jdf.queryExecution().optimizedPlan().toString()
        sent, returned = next(x for x in plan.splitlines() if "MapInArrow" in x).split(", [", 1)
        assert sent.count("text#") == 1 and sent.count("own#") == 0, sent
        assert returned.count("text#") == back and returned.count("own#") == 0, returned
