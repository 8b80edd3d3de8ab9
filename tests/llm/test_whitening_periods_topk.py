"""Whitening, periodic runs and exact top-k search against brute force, with nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteaudit.llm import maxscore, periods, queries, whitening

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
INF, NAN = float("inf"), float("nan")


def vectors(spark, rows):
    """Columns whose names the operators use inside come with the table."""
    return spark.createDataFrame([(i, v if v is None else [c if c is None else float(c) for c in v], 3, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, index int, x string, whitened double")


def finite(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def whitened_by_hand(rows, k=16):
    """``{length: (n, S, fit, axes, eigenvalues)}``."""
    out = {}
    for d in {len(v) for _, v in rows if finite(v)} - {0}:
        x = np.array(sorted({tuple(int(np.floor(64 * c)) + 1_000_000 for c in v) for _, v in rows if finite(v) and len(v) == d}))
        s, n = x.sum(axis=0), len(x)
        centred = (n * x - s) / n
        e, u = np.linalg.eigh(centred.T @ centred / n)
        out[d] = n, s, e[::-1][:k], u[:, ::-1][:, :k], e.sum()
    return out


def check_whitened(rows, got, k=16):
    fit = whitened_by_hand(rows, k)
    wanted = [(i, v) for i, v in rows if finite(v) and len(v)]
    key = lambda i, dev, w: (i is None, i or 0, dev, len(w))
    expected = []
    for i, v in wanted:
        n, s, e, u, total = fit[len(v)]
        y = [n * (int(np.floor(64 * c)) + 1_000_000) - int(t) for c, t in zip(v, s)]
        real = e > 1e-12 * max(total, 1e-300)
        w = np.array([c / n for c in y]) @ u / np.sqrt(np.where(real, e, 1))
        expected.append((i, n, sum(c * c for c in y), [abs(a) if r else None for a, r in zip(w, real)], [a / total if r else 0 for a, r in zip(e, real)]))
    assert len(got) == len(expected)
    for g, x in zip(sorted(got, key=lambda r: key(r.vec_id, r.deviation, r.whitened)), sorted(expected, key=lambda r: key(r[0], r[2], r[3]))):
        assert (g.vec_id, g.n, int(g.deviation)) == x[:3]
        assert [w is None for w in g.whitened] == [w is None for w in x[3]]
        np.testing.assert_allclose([abs(w) for w in g.whitened if w is not None], [w for w in x[3] if w is not None], atol=1e-7)
        np.testing.assert_allclose(g.explained, x[4], atol=1e-9)
        assert 0 <= g.identity_error <= 1e-4


def test_whitening(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * [3, 2, 1.5, 1, 0.7, 0.4] + 5).tolist()) for i in range(90)]
    rows += [(100 + i, rows[0][1]) for i in range(60)]  # one vector holds a third of the rows
    rows += [(200, None), (201, []), (202, [1.0, None, 1, 1, 1, 1]), (203, [NAN] * 6), (204, [INF, 0, 0, 0, 0, 0]), (None, rows[1][1]), (1, rows[2][1]), (1, rows[2][1])]
    rows += [(300, [1.0, 2.0, 3.0]), (301, [2.0, 2.0, 9.0]), (302, [5.0]), (303, [5.0])]  # other lengths: fewer vectors than dimensions, a single one
    got = whitening.whiten(vectors(spark, rows)).collect()
    check_whitened(rows, got)
    assert {len(r.whitened) for r in got} == {6, 3, 1}
    single = next(r for r in got if r.vec_id == 303)
    assert (single.n, single.whitened, single.explained, single.identity_error, int(single.deviation)) == (1, [None], [0.0], 0.0, 0)
    assert whitening.whiten(vectors(spark, rows).limit(0)).collect() == []
    # The same by more and smaller blocks, and by any order of rows.
    whitening.BLOCK_BYTES, old = 6 * 8 * 30, whitening.BLOCK_BYTES
    try:
        check_whitened(rows[:150], whitening.whiten(vectors(spark, rows[:150]).repartition(3)).collect())
    finally:
        whitening.BLOCK_BYTES = old


def test_whitening_of_given_vectors(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    out = queries.op11_whitening(spark, sf)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    assert len(got) == 16 * len(rows) and {r.component for r in got} == set(range(1, 17))
    n, s, e, u, total = whitened_by_hand(rows)[64]
    by_id = dict(rows)
    flat = {(r.vec_id, r.component): r for r in got}
    for i in list(by_id)[::7]:
        y = np.array([n * (int(np.floor(64 * c)) + 1_000_000) - int(t) for c, t in zip(by_id[i], s)], dtype=object)
        w = (y / n).astype(float) @ u / np.sqrt(e)
        for k in range(16):
            r = flat[i, k + 1]
            assert r.deviation == int((y * y).sum()) and r.n == n and abs(abs(r.whitened) - abs(w[k])) < 1e-7 and abs(r.explained - e[k] / total) < 1e-9


def runs_by_hand(w, least):
    out = []
    for q in range(1, len(w) // 2 + 1):
        t = 0
        while t < len(w) - q:
            s = t
            while t < len(w) - q and w[t] == w[t + q]:
                t += 1
            if t - s >= q and t - s + q >= least:
                part = w[s : t + q]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    out.append((s, t + q - s, q))
            t += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(w, least=2):
    return [tuple(map(int, r)) for r in periods.find_runs(np.array(w, np.int64), least)]


@pytest.mark.parametrize("letters,most", [(2, 11), (3, 7)])
def test_all_short_sequences(letters, most):
    for n in range(most + 1):
        for w in itertools.product(range(letters), repeat=n):
            assert found(w) == runs_by_hand(list(w), 2), w


def test_runs_of_runs():
    """Stretches that repeat what came before, where runs begin and end within progressions of others."""
    rng = random.Random(7)
    for _ in range(1500):
        w, n, letters = [], rng.randint(1, 90), rng.choice([1, 2, 2, 3, 4])
        while len(w) < n:
            if w and rng.random() < 0.5:
                q = rng.randint(1, min(len(w), 25))
                for _ in range(rng.randint(1, 3 * q)):
                    w.append(w[-q])
            else:
                w.append(rng.randrange(letters))
        assert found(w) == runs_by_hand(w, 2), w
    assert found([-1, -1, -1, -1]) == []
    assert found([0] * 50_000, 12) == [(0, 50_000, 1)]


def collapsed_by_hand(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_periodic_runs_of_texts(spark):
    texts = [None, "", " \n ", "one", "a b " * 6, "a b " * 5 + "a", "x " * 11, "x " * 12, "x" * 5 + " " + "日本 語 " * 8 + "tail", "p q r s t u v " * 3 + "p q", " ".join(f"w{i % 900}" for i in range(2_000)) + " end", "a\x0bb\ta\nb\x0ca b a b a b a b"]
    rows = [(i, t, 1, "w") for i, t in enumerate(texts)] + [(None, "a b " * 6, 1, "w"), (4, "a b " * 6, 1, "w")]
    out = periods.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int, own string"))
    assert out.columns == ["doc_id", "text", "runs", "own", "n_words", "runs_", "collapsed"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        w = WORDS.findall(r.text or "")
        want = runs_by_hand(w, 12) if len(w) < 500 else [(0, 2_000, 900)]
        assert (r.n_words, [tuple(x) for x in r.runs_], r.collapsed, r.runs, r.own) == (len(w), want, collapsed_by_hand(w, want), 1, "w")
    assert periods.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def planted_by_hand(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_periodic_runs_of_given_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, sf).collect()}
    assert set(got) == set(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in docs.items():
        w = planted_by_hand(i, WORDS.findall(text or ""))
        runs = runs_by_hand(w, 12)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
        expected = (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(collapsed_by_hand(w, runs)))
        assert tuple(got[i]) == expected
    assert sum(r.n_runs > 0 for r in got.values()) > len(docs) // 20


def best_by_hand(rows, k, asks):
    x = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if finite(v)]
    out = []
    for n, (i, q) in enumerate(x):
        if i is not None and asks(i):
            scored = sorted(((-sum(a * b for a, b in zip(q, c)), j is None, j) for m, (j, c) in enumerate(x) if m != n), key=lambda r: (r[0], r[1], r[2] or 0))
            out += [(i, rank, j, -s) for rank, (s, _, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["dense", "sparse", "negative"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(300, 10)).round(2)
    if kind == "sparse":
        x[rng.random(x.shape) < 0.8] = 0  # many equal scores
    if kind == "negative":
        x = np.abs(x)
        x[::5] *= -1  # queries that fit nothing
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(400, None), (401, [None] * 10), (402, [NAN] + [0.0] * 9), (403, [INF] * 10), (404, []), (405, [1.0, -1.0]), (None, rows[3][1]), (None, rows[3][1]), (5, rows[5][1]), (5, rows[5][1]), (410, [0.0] * 10)]
    rows += [(500 + i, rows[7][1]) for i in range(150)]  # one vector holds a third of the rows
    maxscore.SHARD, maxscore.GROUP, old = 64, 16, (maxscore.SHARD, maxscore.GROUP)  # many shards and groups
    try:
        got = maxscore.top_k(vectors(spark, rows), F.col("vec_id") % 5 == 0, k=5).collect()
    finally:
        maxscore.SHARD, maxscore.GROUP = old
    assert sorted(map(tuple, got), key=repr) == best_by_hand(rows, 5, lambda i: i % 5 == 0)


def test_top_k_of_few(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    assert sorted(map(tuple, maxscore.top_k(vectors(spark, rows), F.col("vec_id") == 0).collect())) == [(0, 1, 1, 128 * 256), (0, 2, 2, -(256**2))]
    assert maxscore.top_k(vectors(spark, rows), F.col("vec_id") > 5).collect() == []
    assert maxscore.top_k(vectors(spark, rows).limit(0), F.col("vec_id") == 0).collect() == []
    assert maxscore.top_k(vectors(spark, rows[:1]), F.col("vec_id") == 0).collect() == []


def test_terms_that_are_not_essential_are_left_out():
    """Fewer components are read than there are, and no row that belongs to the best is lost."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(3_000, 24)) * 100 * 0.7 ** np.arange(24)).astype(np.int64)
    shard = maxscore.Shard(np.arange(len(x)), np.arange(len(x)), np.ones(len(x), bool), x)
    for n in range(0, 3_000, 100):
        rows, scores, read = maxscore.search(shard, x[n], n, 5, None)
        s = x @ x[n]
        s[n] = -(10**9)
        assert sorted(scores)[-5:] == sorted(s)[-5:] and (s[rows] == scores).all() and read < 0.8 * x.size
