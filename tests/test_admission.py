"""Streams over many batches out of order, with a restart in the middle, against the batch operators one after another."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from siteaudit.operators import auditlog as log
from siteaudit.sources.staging import shared_path
from siteaudit.streaming import jobs

BASE = datetime.datetime(2024, 3, 1, 23, 0, tzinfo=datetime.timezone.utc)
DELAY_S = 600


@pytest.fixture(scope="module")
def arrivals():
    """Files of requests, each up to ten minutes late: a third of all are of one key; a day ends within them; times and ids tie."""
    rng = random.Random(8)
    rows = []
    for i in range(900):
        key = 7 if i % 3 == 0 else rng.randrange(12)
        at = rng.randrange(0, 7_200) + rng.choice([0, 0, 0.25])
        rows.append((i, key, BASE + datetime.timedelta(seconds=at), at + rng.randrange(DELAY_S)))
    rows.sort(key=lambda r: r[3])
    lots = [[r[:3] for r in rows[k : k + 180]] for k in range(0, 900, 180)]
    for lot in lots:
        rng.shuffle(lot)
    return lots + [[(None, -1, BASE + datetime.timedelta(days=9))]]


def written(spark, lots, path):
    for lot in lots:
        spark.createDataFrame(lot, "id long, key long, ts timestamp").coalesce(1).write.mode("append").parquet(path)


def test_rate_limit_across_batches(spark, arrivals):
    path = shared_path(spark, "test-arrivals")
    written(spark, arrivals, path)
    stream = jobs.stream(spark, path + "/", files=1).withWatermark("ts", f"{DELAY_S} seconds")
    got = {(r.id, r.key, r.admitted) for r in jobs.drain(jobs.rate_limit(stream, limit=3)).collect()}
    rows = spark.createDataFrame([r for lot in arrivals[:-1] for r in lot], "id long, key long, ts timestamp")
    want = {(r.id, r.key, r.admitted) for r in jobs.rate_limit_batch(rows, limit=3).collect()}
    assert got == want and len(got) == 900 and 20 < sum(not a for *_, a in got) < 800


def test_admission_goes_on_after_a_restart(spark, arrivals):
    rows = spark.createDataFrame([r for lot in arrivals[:-1] for r in lot], "id long, key long, ts timestamp")
    users = spark.createDataFrame([(3, BASE), (4, None)], "id long, suspended_at timestamp")
    limits = spark.createDataFrame([(7, 40), (1, 0), (2, None)], "key long, daily_limit int")
    usage = spark.createDataFrame([(5, BASE.date(), 3), (7, BASE.date() + datetime.timedelta(days=1), 30)], "key long, usage_date date, count long")
    path, at = shared_path(spark, "test-arrivals"), (shared_path(spark, "test-out"), shared_path(spark, "test-marks"))

    def run():
        stream = jobs.stream(spark, path + "/", files=2).withWatermark("ts", f"{DELAY_S} seconds")
        return jobs.drain(jobs.admission(stream, users, limits, usage, limit=3), at=at)

    written(spark, arrivals[:3], path)
    assert 0 < run().count() < 700
    written(spark, arrivals[3:], path)
    got = {(r.id, r.key, r.in_rate, r.admitted) for r in run().collect()}

    live = log.drop_suspended(rows.withColumn("user_id", F.col("key")), users)
    rated = jobs.rate_limit_batch(live, limit=3)
    inside = log.admit_requests(rated.where("admitted"), limits.where("daily_limit is not null"), usage)
    want = rated.select("id", "key", F.col("admitted").alias("in_rate")).join(inside.select("id", "admitted"), "id", "left").select("id", "key", "in_rate", F.coalesce("admitted", F.lit(False)))
    want = {tuple(r) for r in want.collect()}
    assert got == want
    assert {k for _, k, _, _ in got} == set(range(12)) - {3}
    assert not any(a for _, k, _, a in got if k == 1) and sum(a for _, k, _, a in got if k == 7) <= 40 + 10 and any(r and not a for _, _, r, a in got)


def test_reports_stand_and_go(spark, arrivals):
    """Visible up to the last moment, gone after it; stream and batch give the same over files out of order."""
    at = lambda s: BASE + datetime.timedelta(seconds=s)
    keep = 600
    rows = [(1, 5, at(0), 1), (2, 5, at(600), 0), (3, 5, at(600.25), 0), (4, 5, at(600.5), 1), (5, 5, at(700), 1), (6, 5, at(1201), 0), (7, 6, at(3), 0)]
    schema = "id long, key long, ts timestamp, kind int"
    batch = jobs.report_store_batch(spark.createDataFrame(rows, schema), keep).collect()
    assert {r.id: r.what for r in batch if r.id} == {1: "saved", 2: "found", 3: "missing", 4: "saved", 5: "duplicate", 6: "missing", 7: "missing"}
    assert sorted((r.key, r.ts.astimezone(datetime.timezone.utc)) for r in batch if r.id is None) == [(5, at(600)), (5, at(1200.5))]
    assert jobs.report_store_batch(spark.createDataFrame([], schema), keep).collect() == []

    lots = [[(i, k, t, (i or 0) * 7 % 5 // 4) for i, k, t in lot] for lot in arrivals]
    path = shared_path(spark, "test-reports")
    for lot in lots:
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.stream(spark, path + "/", files=2).withWatermark("ts", f"{DELAY_S} seconds")
    got = sorted(map(repr, jobs.drain(jobs.report_store(stream, keep)).collect()))
    want = sorted(map(repr, jobs.report_store_batch(spark.createDataFrame([r for lot in lots for r in lot], schema), keep).collect()))
    assert got == want and all(any(w in r for r in got) for w in ("saved", "duplicate", "found", "missing", "evicted"))
