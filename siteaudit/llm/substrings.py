"""Substring dedup by hashing lines or paragraphs, and the sentences of those that differ."""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, small, spare, stage

#: Fewest words of a run of repeated units, with nothing but white space between, that is removed; shorter ones recur by chance.
RUN = 20
_UNIT = {"line": re.compile(r"[^\n]+"), "paragraph": re.compile(r"[^\n]+(?:\n[^\n]+)*")}
_SENTENCE = re.compile(r"[^.!?]*[.!?]+|[^.!?]+")
_BREAKS = re.compile(r"[\x20\x09-\x0D]+")
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_ROW = (("doc_id", "long", pa.int64()), ("print", "long", pa.int64()), ("start", "int", pa.int32()), ("end", "int", pa.int32()), ("at", "int", pa.int32()), ("to", "int", pa.int32()), ("n_words", "int", pa.int32()), ("part", "boolean", pa.bool_()), ("digest", "binary", pa.binary()))


def _units(kind: str, sentences: bool):
    def run(batches):
        for batch in pieces(batches, "text"):
            rows: list[tuple] = []

            def add(doc, mark, start, text, words, at, to, part):
                begin = start + len(text) - len(text.lstrip(_SPACE))
                rows.append((doc, mark, begin, begin + len(text.strip(_SPACE)), at, to, len(words), part, xxhash.xxh3_128_digest(" ".join(words))))

            words_of = lambda text: [w for w in _BREAKS.split(text.lower()) if w]
            for doc, mark, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                at = 0
                for m in _UNIT[kind].finditer(text or ""):
                    if not (words := words_of(m[0])):
                        continue
                    inner = [(x.start(), x[0], w) for x in _SENTENCE.finditer(m[0]) if (w := words_of(x[0]))] if sentences else []
                    to = at + max(1, len(inner))
                    add(doc, mark, m.start(), m[0], words, at, to, False)
                    for k, (start, said, w) in enumerate(inner if len(inner) > 1 else ()):
                        add(doc, mark, m.start() + start, said, w, at + k, at + k + 1, True)
                    at = to
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, _, t) in enumerate(_ROW)], [name for name, _, _ in _ROW])

    return run


def hashed_units(docs: DataFrame, kind: str = "line", sentences: bool = True) -> DataFrame:
    """A row for each line, or paragraph (lines with no empty one between), that has a word, and with ``sentences`` for each of its sentences, if it has several:
    ``doc_id``, ``print`` of the text, ``start, end`` (code points without outer white space, end exclusive), ``at, to`` (its place among the document's smallest units, end
    exclusive), ``n_words``, ``part`` (it is a sentence of a line), and the 128-bit ``digest`` of its words in lower case, a space between them."""
    return _hashed(_rows(docs), kind, sentences)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("print"), "text")


def _hashed(rows: DataFrame, kind: str, sentences: bool) -> DataFrame:
    return rows.mapInArrow(_units(kind, sentences), ", ".join(f"{name} {kind}" for name, kind, _ in _ROW))


def _once(rows: DataFrame) -> DataFrame:
    """Each ``doc_id, print`` of ``rows`` once. Hashes are counted first, so only texts of rows that do repeat are shuffled; where such keys
    fit a broadcast, a task sends a document once, however often it has it.
    """
    own = ["doc_id", "print"]
    repeats = stage(rows.groupBy(*own).agg(F.count("*").alias("n")).where("n > 1").select(*own), "substring-repeats")
    n = repeats.count()
    if not n:
        return rows
    repeats = small(repeats, n, 16)
    once = rows.join(repeats, own, "left_semi").groupBy(*own).agg(F.first("text").alias("text"))
    return rows.join(repeats, own, "left_anti").unionByName(once)


def _repeated(docs: DataFrame, kind: str, run: int, sentences: bool) -> DataFrame:
    found = stage(_hashed(_once(_rows(docs)), kind, sentences), "substring-units")
    place = F.struct("doc_id", "print", "start")
    first = found.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("digest", "first")
    first = stage(first, "substring-first")  # so that the join reads plain shuffles, of which a hot digest's can be split
    later = found.join(first, "digest").where(place != F.col("first"))
    later = later.select("doc_id", "print", "start", "end", "at", "to", "n_words", "part", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"))
    # One shuffle by text: a line comes before its sentences, which it covers.
    text = Window.partitionBy("doc_id", "print")
    order = text.orderBy("at", "part")
    covered = F.coalesce(F.max(F.when(~F.col("part"), F.col("to"))).over(order.rowsBetween(Window.unboundedPreceding, 0)) > F.col("at"), F.lit(False))
    alone = later.withColumn("covered", covered).where("not part or not covered")
    order = text.orderBy("at")
    runs = alone.withColumn("fresh", F.coalesce((F.lag("to").over(order) != F.col("at")).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("fresh").over(order)).withColumn("words", F.sum("n_words").over(Window.partitionBy("doc_id", "print", "run")))
    return runs.where(F.col("words") >= run)


def repeated_units(docs: DataFrame, kind: str = "line", run: int = RUN, sentences: bool = True) -> DataFrame:
    """One row for each unit to remove: ``doc_id, start, end, first_doc_id, first_start``, the occurrence that is kept being
    the earliest by doc_id, then place. Sentences are named only where their line stays, and units only in runs of ``run`` words or more.

    Units are hashed once; their digests are counted and ranked before they meet their occurrences again, and only those found twice do. Rows
    that repeat a document are one occurrence of it, taken together before they are hashed, however many there are; rows that share a doc_id but not the text are documents of their own. Null or empty texts and rows with a null
    doc_id have no units; other columns are ignored; empty in, empty out. Not found: the two ends of a repeat that begin or end within a sentence.
    """
    return _repeated(docs, kind, run, sentences).select("doc_id", "start", "end", "first_doc_id", "first_start")


def kept_text(text: Column, removed: Column) -> tuple[Column, Column]:
    """What is left of a text without the ``removed`` spans (sorted, none overlapping), and the kept spans' original offsets. Null and empty texts stay, without spans."""
    n = F.length(text)
    starts = F.concat(F.array(F.lit(0)), F.transform(removed, lambda x: x["end"]))
    ends = F.concat(F.transform(removed, lambda x: x["start"]), F.array(n))
    spans = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"))), lambda s: s["start"] < s["end"])
    left = F.array_join(F.transform(spans, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])), "")
    return F.when(text.isNotNull(), left), spans


def deduplicated(docs: DataFrame, kind: str = "line", run: int = RUN, sentences: bool = True) -> DataFrame:
    """``docs`` with ``text`` without its repeated units, and ``kept_spans``: the original offsets of what is left. A row's spans are those of its doc_id and
    text, so rows that share a doc_id don't cut one another. Null texts and rows with a null doc_id stay as they are; other columns stay, one called kept_spans is replaced."""
    own = [c for c in docs.columns if c.lower() != "kept_spans"]
    name = {c: spare(own, c) for c in ("gone", "gone_id", "gone_print")}
    gone = _repeated(docs, kind, run, sentences).groupBy(F.col("doc_id").alias(name["gone_id"]), F.col("print").alias(name["gone_print"]))
    gone = gone.agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(name["gone"]))
    text, spans = kept_text(docs["text"], F.coalesce(gone[name["gone"]], F.array().cast("array<struct<start:int,end:int>>")))
    out = docs.join(gone, (docs["doc_id"] == gone[name["gone_id"]]) & (F.xxhash64(docs["text"]) == gone[name["gone_print"]]), "left")
    return out.select(*[text.alias(c) if c == "text" else docs[f"`{c}`"] for c in own], spans.alias("kept_spans"))
