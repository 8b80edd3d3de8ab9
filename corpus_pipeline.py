"""A training corpus from raw documents: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit.llm import minhash, mixing, pieces, quality, secrets
from siteaudit.llm.common import numbered, small, spare, stage
from siteaudit.llm.queries import digests, split_pattern, table, vocabulary


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts go; repeated rows, ties and null ids are judged as any; other columns stay; empty in, empty out."""
    rules = quality.learn_rules(docs, table(spark, sf_dir, "labels"))
    names = {c: f"own_{k}" for k, c in enumerate(docs.columns)}  # no name of a count can clash with one of these
    own = docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).alias("own_row"))
    judged = quality.quality_rules(own, rules)
    return judged.where("kept").select(*[F.col(f"own_row.{n}").alias(c) for c, n in names.items()])


def single_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id, and one of the rows that repeat it.

    Null and empty texts and null ids have no duplicates and stay; rows that share a doc_id but not the text are documents of their own, none of which goes for what
    another resembles; other columns stay, of rows that repeat those of any one; empty in, empty out. Only texts of doc_ids that repeat are shuffled beside those of near duplicates.
    """
    again = stage(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "pipeline-again")
    n = again.count()
    if n == 0:
        gone = stage(minhash.near_duplicates(docs, shingle_words=5, percent=80).where("not kept").select("doc_id"), "pipeline-gone")
        return docs.join(small(gone, gone.count(), 64), "doc_id", "left_anti").select(*docs.columns)
    again = small(again, n, 64)
    once = docs.join(again, "doc_id", "left_anti").select(*docs.columns)
    twice = docs.join(again, "doc_id", "left_semi").select(*docs.columns)
    # Each text of a doc_id that repeats is a document with a number that no doc_id has.
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    texts, n = numbered(twice.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("print"), F.col("text").isNull().alias("none")).distinct(), "pipeline-texts")
    number = F.lit(high + 1) + F.col("index") if high < (1 << 63) - 1 - n else F.lit(low - 1) - F.col("index")
    texts = stage(texts.select(F.col("doc_id").alias("own"), "print", "none", number.alias("number")), "pipeline-numbers")
    firsts = twice.dropDuplicates(["doc_id", "text"])
    same = (firsts["doc_id"] == texts["own"]) & (F.sha2(F.coalesce(firsts["text"], F.lit("")), 256) == texts["print"]) & (firsts["text"].isNull() == texts["none"])
    new = spare(docs.columns, "number")
    firsts = stage(firsts.join(texts, same).select(*[firsts[f"`{c}`"] for c in docs.columns], texts["number"].alias(new)), "pipeline-firsts")
    every = once.select("doc_id", "text").unionByName(firsts.select(F.col(new).alias("doc_id"), "text"))
    found = minhash.near_duplicates(every, shingle_words=5, percent=80).where("doc_id is not null").join(texts.select(F.col("number").alias("doc_id"), "own"), "doc_id", "left")
    found = stage(found.select("doc_id", "component_id", F.coalesce("own", "doc_id").alias("own")), "pipeline-found")
    stays = found.groupBy("component_id").agg(F.min(F.struct("own", "doc_id")).alias("first"))
    gone = stage(found.join(stays, "component_id").where(F.col("doc_id") != F.col("first.doc_id")).select("doc_id"), "pipeline-gone")
    gone = small(gone, gone.count(), 64)
    left = firsts.join(gone.select(F.col("doc_id").alias(new)), new, "left_anti")
    return once.join(gone, "doc_id", "left_anti").select(*docs.columns).unionByName(left.select(*docs.columns))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and ``n_chars``, if there is such a column, counted anew. Null and empty texts, repeated rows, null ids and other
    columns stay as they are; empty in, empty out."""
    names = {c: c if c == "text" else f"own_{k}" for k, c in enumerate(docs.columns)}  # a row goes to the scan and back with its text once
    found = secrets.find_secrets(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), vocabulary("byte_bpe_50k.tiktoken"), split_pattern())
    hit = F.size("secrets") > 0
    new = found.withColumns({"hit": hit, "text": F.when(hit, secrets.redacted(F.col("text"), F.col("secrets"))).otherwise(F.col("text"))})
    counted = F.when(F.col("hit"), F.length("text").cast("long")).otherwise(F.col(names["n_chars"])) if "n_chars" in docs.columns else None
    return new.select(*[counted.alias(c) if c == "n_chars" else F.col(n).alias(c) for c, n in names.items()])


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them. Repeated rows are sampled one by one; a null source is a source of its own, null ids are keyed by text; texts without
    words have size 0 and stay as often as their source is taken whole; other columns stay; empty in, empty out."""
    return mixing.mixed_documents(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with digests of ids and decoded text: begin and end ids alone for null and empty texts; repeated rows and null ids are encoded as any; other
    columns go; empty in, empty out."""
    ids = pieces.encode(docs.select("doc_id", "source", "text"), vocabulary("piece_bpe_32k.model"), keep_text=False)
    return ids.select("doc_id", "source", "ids", "decoded").transform(lambda d: digests(d))


STAGES = [
    ("quality rules", good_documents),
    ("MinHash near-dedup", single_documents),
    ("secret scans", clean_documents),
    ("mixing sources", mixed_documents),
    ("SentencePiece encoding", encoded_documents),
]

#: No stage but mixing can be said in SQL: rules are learned, links are transitive, tokens come from a library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's output is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
