"""Near-duplicate documents by circulant MinHash.

One permutation spreads a text's shingles over ``UNIVERSE`` places; a second one, shifted
by one place per coordinate, gives every coordinate of the signature. Coordinates are
banded; texts that share a band are held together by their whole signatures, and the
groups this leaves are linked by exact Jaccard similarity of their full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, groups, pieces, sent, sized, small, stage, star, unstage

#: Coordinates of a band, and the chance at most that a pair at the threshold shares none.
ROWS, MISS = 5, 1e-6
UNIVERSE = 1 << 22
SEED = 20_240_817
#: Members of a block, and of a side of one: what one task compares at once.
BLOCK = 256
BLOCK_SHINGLES = 1_000_000
#: Representatives that the members of a larger group meet in its first round.
FIRST = 256
#: Standard errors of the estimate that a pair may fall short of the threshold.
SLACK = 6.0

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def bands_for(share: float) -> int:
    """Bands of ``ROWS`` coordinates, so that a pair of similarity ``share`` shares one but for a chance of ``MISS``."""
    return math.ceil(math.log(MISS) / math.log(1 - share**ROWS))


@lru_cache(2)
def shifted(n: int) -> np.ndarray:
    """Row p holds the ``n`` coordinates of place p: the second permutation at p, p+1, ..., taken in a circle."""
    order = np.random.default_rng(SEED).permutation(UNIVERSE).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: n - 1]]), n)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``size`` words, hashed to 64 bits, ascending.

    A-Z is lower-cased; words are runs of ``[^\\x20\\x09-\\x0D]``. Fewer words make one shingle; none
    make an empty set, as does null.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    filled = np.asarray(pc.binary_length(flat)) > 0
    before = np.concatenate([[0], np.cumsum(filled)])
    offsets = split.offsets.to_numpy()
    ends = before[offsets - offsets[0]]
    coded = flat.filter(pa.array(filled)).dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    words = own[coded.indices.to_numpy()] if len(coded) else own
    rolled = words.copy()
    for k in range(1, size):
        rolled = mix(rolled[:-1] * _M1 + words[k:]) if len(rolled) > 1 else rolled[:0]
    for i in range(len(texts)):
        a, b = ends[i], ends[i + 1]
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            x = words[a : a + 1]
            for k in range(a + 1, b):
                x = mix(x * _M1 + words[k : k + 1])
            yield mix(x + np.uint64(b - a))
        else:
            yield words[:0]


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` coordinates of a set that isn't empty."""
    places = (mix(shingles ^ np.uint64(SEED)) % np.uint64(UNIVERSE)).astype(np.int64)
    table = shifted(n)
    return np.min([table[places[k : k + 1024]].min(axis=0) for k in range(0, len(places), 1024)], axis=0)


def _sign(size: int, n_bands: int):
    def run(batches):
        salt = mix(np.arange(1, n_bands + 1, dtype=np.uint64))
        for batch in pieces(batches, "text"):
            n, one, two, sigs, bands = [], [], [], [], []
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                one.append(int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else None)
                two.append(int(mix(s ^ _M1).sum(dtype=np.uint64).astype(np.int64)) if len(s) else None)
                if not len(s):
                    sigs.append(None)
                    bands.append(None)
                    continue
                sig = signature(s, n_bands * ROWS)
                key = salt.copy()
                for c in sig.reshape(n_bands, ROWS).T.astype(np.uint64):
                    key = mix(key * _M1 + c)
                sigs.append((mix(sig.astype(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes())
                bands.append(key.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "print1", "print2", "sig", "bands"])

    return run


def signatures(docs: DataFrame, size: int, n_bands: int) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_shingles``, a 128-bit print of the set, one byte of each
    coordinate and the band keys; nulls from ``print1`` on for an empty set."""
    return sent(docs.select("doc_id", "text"), _sign(size, n_bands), "doc_id long, n_shingles long, print1 long, print2 long, sig binary, bands array<long>")


def _buckets(batches):
    """Runs of one band key as blocks of members."""
    rows: list[tuple[bytes, np.ndarray]] = []

    def out():
        r = pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.list_(pa.int64()))], ["block", "members"])
        rows.clear()
        return r

    def runs():
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                if held and keys[a] != last:
                    yield np.concatenate(held) if len(held) > 1 else held[0]
                    held = []
                held.append(ids[a:b])
                last = keys[a]
        if held:
            yield np.concatenate(held) if len(held) > 1 else held[0]

    for run in runs():
        run = np.unique(run)
        if len(run) < 2:
            continue
        rows.append((xxhash.xxh3_128_digest(run.tobytes()), run))
        if len(rows) >= 2000:
            yield out()
    if rows:
        yield out()


def _by_representatives(members: DataFrame, compare) -> DataFrame:
    """Links ``(a, b)`` found within the groups of ``members(grp, id, cuts)``, so that all that a comparison of all pairs would join is joined.

    In each round some members of a group, its representatives, are compared with all its members, which are dealt over ``cuts`` salted blocks. They
    are taken from those that links don't join to the group's largest component, ``FIRST`` at first and 32 times as many in each later round, until each of
    these has been one: every pair then has been compared or lies within that component. ``compare`` gives the links of ``(block, id, right)``.
    """
    links, tested, most, n = None, None, FIRST, members.count()
    while True:
        if links is None:
            outside = members
        else:
            joined = components(links, "minhash-joined")
            placed = stage(sized(members.join(joined, "id", "left").select("grp", "id", "cuts", F.coalesce("component", "id").alias("component")), n), "minhash-placed")
            largest = placed.groupBy("grp", "component").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max(F.struct("n", "component"))["component"].alias("largest"))
            outside = placed.join(largest, "grp").where("component <> largest").select("grp", "id", "cuts").join(tested, ["grp", "id"], "left_anti")
            outside = stage(sized(outside, n), "minhash-outside")
            unstage(placed)
        counts = stage(sized(outside.groupBy("grp").agg(F.count("*").alias("n")), n), "minhash-open")
        n_open, widest = counts.agg(F.count("*"), F.max("n")).first()
        if not n_open:
            return links
        few = small(counts, n_open, 64)
        share = F.greatest(F.lit(1), F.ceil(F.col("n") / most))
        chosen = outside.join(few, "grp").where(F.pmod(F.xxhash64("id", F.lit(most)), share) == 0).select("grp", "id", "cuts", F.ceil(F.least("n", F.lit(most)) / BLOCK).cast("int").alias("parts"))
        chosen = stage(sized(chosen, n), "minhash-representatives")
        own = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
        left = chosen.select("grp", "id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("salt"))
        dealt = few.select("grp", F.ceil(F.least("n", F.lit(most)) / BLOCK).cast("int").alias("parts"))
        right = members.join(dealt, "grp").select("grp", "id", own.alias("salt"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        name = lambda df, is_right: df.select(F.concat_ws(":", "grp", "salt", "part").alias("block"), "id", F.lit(is_right).alias("right"))
        found = compare(name(left, False).unionByName(name(right, True))).where("a <> b")
        links = stage((found if links is None else links.unionByName(found)).distinct(), "minhash-links")
        tested = chosen.select("grp", "id") if tested is None else tested.unionByName(chosen.select("grp", "id"))
        if widest <= most:
            return links
        most *= 32


def _batched(found: Iterator[tuple[list, list]]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for x, y in found:
        a += x
        b += y
        if len(a) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _resemble(floor: float, ratio: float):
    """Joins the members of each block whose signatures agree in ``floor`` of their bytes and whose sizes allow it."""

    def run(batches):
        def found():
            for t in groups(batches, "block"):
                ids, n = (t.column(c).to_numpy() for c in ("id", "n_shingles"))
                sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
                pairs = []
                for i in range(len(ids) - 1):
                    like = ((sig[i + 1 :] == sig[i]).mean(axis=1) >= floor) & (np.minimum(n[i + 1 :], n[i]) >= ratio * np.maximum(n[i + 1 :], n[i]))
                    pairs += [(i, int(j) + i + 1) for j in np.flatnonzero(like)]
                if pairs:
                    yield star(ids, forest(len(ids), pairs))

        yield from _batched(found())

    return run


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets of two lists, by products of incidence matrices over slices of the shared values."""
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    where = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    spots = []
    for v, w in zip((a, b), where):
        at = np.searchsorted(shared, v)
        ok = at < len(shared)
        ok[ok] = shared[at[ok]] == v[ok]
        o = np.argsort(at[ok], kind="stable")
        spots.append((at[ok][o], w[ok][o]))
    out = np.zeros((len(left), len(right)), np.float64)
    step = 4096
    for k in range(0, len(shared), step):
        m = []
        for (at, w), n in zip(spots, (len(left), len(right))):
            lo, hi = np.searchsorted(at, [k, k + step])
            x = np.zeros((n, min(step, len(shared) - k)), np.float32)
            x[w[lo:hi], at[lo:hi] - k] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def _agreeing(a: np.ndarray, b: np.ndarray, floor: float) -> np.ndarray:
    """Which rows of two matrices of signatures agree in ``floor`` of their bytes."""
    out = np.empty((len(a), len(b)), bool)
    for i, row in enumerate(a):
        out[i] = (b == row).mean(axis=1) >= floor
    return out


def _confirm(size: int, percent: int, floor: float):
    """Links of each block at ``100 * intersection >= percent * union``, as a forest; only pairs whose signatures agree in ``floor`` are looked at."""

    def run(batches):
        def found():
            for t in groups(batches, "block"):
                right = t.column("right").to_numpy()
                order = np.argsort(right, kind="stable")
                ids, cut = t.column("id").to_numpy()[order], int((~right).sum())
                sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
                own = cut == len(ids)
                like = _agreeing(sig[:cut], sig if own else sig[cut:], floor)
                if own:
                    like = np.triu(like, 1)
                i, j = np.nonzero(like)
                if not len(i):
                    continue
                sets = []
                for piece in pieces(t.to_batches(), "text"):
                    sets += shingle_sets(piece.column(piece.schema.get_field_index("text")), size)
                sets = [sets[k] for k in order]
                rows, columns = np.unique(i), np.unique(j)
                a, b = [sets[k] for k in rows], [sets[k if own else k + cut] for k in columns]
                i, j = np.searchsorted(rows, i), np.searchsorted(columns, j)
                both = _common(a, b)[i, j]
                n, m = (np.array([len(s) for s in x], float) for x in (a, b))
                hit = (100 * both >= percent * (n[i] + m[j] - both)) & (both > 0)
                pairs = list(zip(rows[i[hit]].tolist(), (columns[j[hit]] + (0 if own else cut)).tolist()))
                if pairs:
                    yield star(ids, forest(len(ids), pairs))

        yield from _batched(found())

    return run


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if ``100 * |A & B| >= percent * |A | B|`` for their full sets of distinct
    shingles; ``component_id`` is the smallest doc_id reachable over links, ``kept`` marks it.

    - Texts with one and the same set form a class first (grouped by a 128-bit print), so
      copies are never paired; repeated rows share a class.
    - A pair at the threshold shares no band with probability ``MISS`` at most (24 bands of 5 coordinates at 0.85, 35 at
      0.8), and falls under the signatures' floor (6 standard errors) with less. Every other link is found and confirmed.
    - A bucket of more than ``BLOCK`` members is one group as it stands. Groups of more than ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles are compared with
      representatives, in salted blocks, never all with all.
    - Null, empty or blank text: ``n_shingles`` 0, linked with nothing, kept. Null doc_id: linked
      with nothing, ``component_id`` null, kept. Other columns of ``docs`` are ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    share = percent / 100
    n_bands = bands_for(share)
    signed = stage(signatures(docs, shingle_words, n_bands), "minhash-signed")
    classes = stage(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("print1", "print2", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("bands").alias("bands")),
        "minhash-classes",
    )
    banded = classes.select(F.explode("bands").alias("band"), "id")
    hot = stage(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where(F.col("n") > BLOCK).select("band", "hub"), "minhash-hot")
    few = small(hot, hot.count(), 64)
    # The members of a large bucket are one group without a look at their signatures: they meet representatives below.
    pooled = banded.join(few, "band").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    cold = banded.join(few.select("band"), "band", "left_anti")
    blocks = cold.repartition("band").sortWithinPartitions("band", "id").mapInArrow(_buckets, "block binary, members array<long>")
    blocks = blocks.dropDuplicates(["block"])
    members = stage(blocks.select("block", F.explode("members").alias("id")), "minhash-members")
    floor = share - SLACK * (share * (1 - share) / (n_bands * ROWS)) ** 0.5
    known = classes.select("id", "n_shingles", "sig")
    alike = members.join(known, "id").repartition("block").sortWithinPartitions("block").mapInArrow(_resemble(floor, share), "a long, b long")
    alike = stage(alike.unionByName(pooled).distinct(), "minhash-alike")
    unstage(members)

    cluster = stage(components(alike).withColumnRenamed("component", "cluster"), "minhash-clusters")
    sizes = cluster.join(classes.groupBy("id").agg(F.max("n_shingles").alias("n_shingles")), "id").groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    sizes = sizes.select("cluster", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("cuts"))
    wanted = stage(cluster.join(sizes, "cluster").select("id", "cluster", "cuts"), "minhash-wanted")
    few = small(wanted.select("id", "cluster", "cuts"), wanted.count(), 64)
    sigs = classes.groupBy("id").agg(F.first("sig").alias("sig"))
    own = docs.withColumnRenamed("doc_id", "id").join(few, "id").join(sigs, "id")
    own = stage(own.select("cluster", "cuts", "id", "sig", "text"), "minhash-texts")

    def linked_in(blocks: DataFrame) -> DataFrame:
        return sent(blocks.repartition("block").sortWithinPartitions("block"), _confirm(shingle_words, percent, floor), "a long, b long")

    links = linked_in(own.where("cuts = 1").select(F.col("cluster").cast("string").alias("block"), "id", F.lit(False).alias("right"), "sig", "text"))
    links = stage(links.distinct(), "minhash-linked")
    large = stage(wanted.where("cuts > 1").select(F.col("cluster").alias("grp"), "id", "cuts"), "minhash-large")
    if not large.isEmpty():
        each = own.where("cuts > 1").select("id", "sig", "text")
        links = links.unionByName(_by_representatives(large, lambda blocks: linked_in(blocks.join(each, "id"))))
    found = stage(components(links), "minhash-found")
    prints = classes.join(found, "id", "left").select("print1", "print2", F.col("n_shingles"), F.coalesce("component", "id").alias("component"))
    prints = prints.withColumnRenamed("n_shingles", "n")
    same = (signed["print1"] == prints["print1"]) & (signed["print2"] == prints["print2"]) & (signed["n_shingles"] == prints["n"]) & signed["doc_id"].isNotNull()
    out = signed.select("doc_id", "n_shingles", "print1", "print2").join(prints, same, "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
