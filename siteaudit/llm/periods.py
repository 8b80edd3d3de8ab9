"""Periodic runs of words by a dictionary of basic factors.

The factor of length 2^k at each position gets a name, made of those of its two halves. For each
length, occurrences of one name that follow each other within twice the length propose their distance as a period; where they
form arithmetic progressions, so do the distances from each position to the ends of other progressions. What is proposed is
extended as far as it holds, and kept once.

A document is one row and is worked on in one task, many of them at once in flat arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, spare, words

#: Words of a batch that are worked on at once, one document at least.
WORDS = 300_000
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _proposals(names: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions, and distances at which the factor of ``length`` there occurs again. ``names`` of the positions ``at``, by name and position."""
    reach = 2 * length
    step = np.where(names[1:] == names[:-1], at[1:] - at[:-1], reach + 1)  # to the next occurrence
    near = step <= reach
    out = [(at[:-1][near], step[near])]
    # A progression: neighbours at one distance that is no longer than the factor. Others are progressions of one.
    inner = np.zeros(len(at) + 1, bool)
    inner[1:-1] = step <= length
    same = np.zeros(len(at) + 1, bool)  # the step into a position is as long as that out of it
    same[1:-2] = step[1:] == step[:-1]
    first = ~inner[:-1] | (~same[:-1] & inner[1:])
    last = ~inner[1:] | (~same[:-1] & inner[:-1])
    # From each position to the first ones of the progressions behind its own, and to each from the last ones of those before: few rounds, as
    # occurrences within a factor's length are of one progression.
    every = np.arange(len(at))
    for ends, at_next, way in ((np.flatnonzero(first), "right", 1), (np.flatnonzero(last), "left", -1)):
        k, x = np.searchsorted(ends, every, at_next) - (way < 0), every
        while True:
            ok = (k >= 0) & (k < len(ends))
            k, x = k[ok], x[ok]
            y = ends[k]
            a, b = (x, y) if way > 0 else (y, x)
            ok = (names[a] == names[b]) & (at[b] - at[a] <= reach)
            if not ok.any():
                break
            out.append((at[a[ok]], at[b[ok]] - at[a[ok]]))
            k, x = k[ok] + way, x[ok]
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _extended(word: np.ndarray, i: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of the longest stretch around each i in which words p apart are the same, of those with two periods at least."""
    order = np.lexsort((i, p))
    i, p = i[order], p[order]
    found = []
    edges = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]]))
    for a, b in zip(edges[:-1], edges[1:]):
        q, starts = int(p[a]), i[a:b]
        if len(starts) < 8:  # look around each; a stretch that has been looked at isn't looked at again
            done = -1
            for s in starts.tolist():
                if s < done:
                    continue
                lo, hi = s, s
                while lo > 0 and word[lo - 1] == word[lo - 1 + q]:
                    lo -= 1
                while hi + q < len(word) and word[hi] == word[hi + q]:
                    hi += 1
                done = hi
                if hi - lo >= q:
                    found.append((lo, hi + q, q))
        else:
            breaks = np.concatenate([[-1], np.flatnonzero(word[:-q] != word[q:]), [len(word) - q]])
            k = np.unique(np.searchsorted(breaks, starts, "right"))
            lo, hi = breaks[k - 1] + 1, breaks[np.minimum(k, len(breaks) - 1)]
            ok = hi - lo >= q
            found += zip(lo[ok].tolist(), (hi[ok] + q).tolist(), [q] * int(ok.sum()))
    table = np.array(found, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def find_runs(word: np.ndarray, least: int = 2) -> np.ndarray:
    """Rows (start, length, period) of the runs of an array of whole numbers from 0, by start and period. A negative number is like no other, nor like itself.

    A run is a stretch with smallest period q, of ``least`` places or more and of 2 q or more, that no neighbour extends.
    """
    n = len(word)
    own = np.where(word < 0, -1 - np.arange(n), word.astype(np.int64))
    names = own
    at = np.flatnonzero(word >= 0)
    length, all_i, all_p = 1, [], []
    while len(at) > 1 and 2 * length <= n:
        order = np.argsort(names[at], kind="stable")  # positions rise within a name
        by, pos = names[at][order], at[order]
        twice = np.zeros(len(pos), bool)
        twice[1:] = by[1:] == by[:-1]
        twice[:-1] |= twice[1:]
        by, pos = by[twice], pos[twice]  # a factor that occurs once is in none that occurs again
        if not len(pos):
            break
        i, p = _proposals(by, pos, length)
        all_i.append(i)
        all_p.append(p)
        # Names of twice the length: pairs of names, those that occur once left out.
        held = np.full(n, -1, np.int64)
        fresh = np.concatenate([[0], np.cumsum(by[1:] != by[:-1])])
        held[pos] = fresh
        at = np.sort(pos[pos + length < n])
        at = at[held[at + length] >= 0]
        names = np.full(n, -1, np.int64)
        names[at] = held[at] * (fresh[-1] + 1) + held[at + length]
        length *= 2
    key = np.unique(np.concatenate([np.zeros(0, np.int64), *(p * n + i for i, p in zip(all_i, all_p))]))
    if not len(key):
        return np.zeros((0, 3), np.int64)
    lo, hi, q = _extended(own, key % n, key // n)
    # A stretch is kept with its smallest period; it has others only if they are multiples.
    order = np.lexsort((q, hi, lo))
    lo, hi, q = lo[order], hi[order], q[order]
    keep = np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])[: len(lo)] & (hi - lo >= least)
    found = np.stack([lo[keep], hi[keep] - lo[keep], q[keep]], 1)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _run(least: int):
    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64))
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + WORDS, "right")))
                yield _batch(batch.slice(at, to - at), least)
                at = to

    return run


def _batch(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    """Runs and remaining words of some documents: their words one after another, with a word between that is like no other."""
    lists = batch.column(0)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    flat = pc.list_flatten(lists)
    coded = pc.dictionary_encode(flat)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) + owner  # a gap behind each document
    word = np.full(len(flat) + len(sizes), -1, np.int64)
    word[place] = coded.indices.to_numpy(zero_copy_only=False)
    runs = find_runs(word, least)
    gap_begins = begins[:-1] + np.arange(len(sizes))
    doc = np.searchsorted(gap_begins, runs[:, 0], "right") - 1
    runs[:, 0] -= gap_begins[doc]
    # What a run holds after its first period goes.
    cover = np.zeros(len(flat) + 1, np.int64)
    np.add.at(cover, begins[doc] + runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, begins[doc] + runs[:, 0] + runs[:, 1], -1)
    stay = np.cumsum(cover)[:-1] == 0
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(sizes)))])
    listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], fields=list(_RUN)))
    kept = np.concatenate([[0], np.cumsum(stay)])[begins]
    rest = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), flat.filter(pa.array(stay)) if not stay.all() else flat)
    return pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes), listed, pc.binary_join(rest, " ")], ["own", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, found_in: Column | None = None, least: int = 12) -> DataFrame:
    """``docs`` with ``n_words`` long, ``runs array<struct<start,length,period>>`` by start and period, and ``collapsed``, the words that are left, joined by one space.

    A run is a stretch of consecutive words (``found_in``: an array of them; else the words of ``text``) with smallest period q, words q apart being identical, of
    ``least`` words or more and of 2 q or more, that no neighbouring word extends with that period. Words that a run holds after its first q go.

    - Null and empty texts and arrays: 0 words, no runs, "". Repeated rows and null ids are worked on as any; order of rows counts for nothing.
    - Long texts are worked on whole, some 200 bytes of memory a word. Overlapping runs are all listed.
    - Other columns stay; of names that are taken already the new column has underscores behind. Empty in, empty out.
    """
    given = words(F.col("text")) if found_in is None else found_in
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    own = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    flat = docs.select(F.coalesce(given, F.array().cast("array<string>")).alias("words"), own.alias("own"))
    kind = flat.schema["own"].dataType.simpleString()
    out = flat.mapInArrow(_run(least), f"own {kind}, n_words long, runs array<{RUN}>, collapsed string")
    new = []
    for c in ("n_words", "runs", "collapsed"):
        new.append(F.col(c).alias(spare(docs.columns, c)))
    return out.select(*[F.col(f"own.{n}").alias(c) for c, n in names.items()], *new)
