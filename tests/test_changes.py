"""Tables kept up by changes: any order, late, repeated and cut-off merges; a sink that runs again."""

import datetime
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from siteaudit.operators import changes
from siteaudit.sources.audit_sink import append_batch, append_stream, read_audits
from siteaudit.sources.registers import FIRST, LAST, LOG, Registers
from siteaudit.sources.staging import shared_path

T = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def t(hours):
    return T + datetime.timedelta(hours=hours)


def files(path):
    path = path.removeprefix("file://")
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def replayed(rows, key):
    """Applied one by one in order of time: what a database would hold."""
    out = {}
    for id_, at, seq, plan, note, on in sorted(rows, key=lambda r: (r[1], r[2])):
        u = out.setdefault(id_, {"plan": None, "note": None, "suspended": None})
        if plan is not None:
            u["plan"] = plan
        if note is not None:
            u["note"] = note.strip() or None
        if on is not None:
            u["suspended"] = (u["suspended"] or at) if on else None
    return {k: (u["plan"], u["note"], u["suspended"]) for k, u in out.items() if k is not None}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_gives_one_table(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(9)]), t(rng.randrange(40)), i, rng.choice([None, "free", "pro"]), rng.choice([None, " ", f" n{i} "]), rng.choice([None, True, False])) for i in range(120)]
    lots = [rows[:50], rows[30:90], rows[70:], rows[10:20]]
    rng.shuffle(lots)
    path = shared_path(spark, "test-registers")
    table = Registers(spark, path, ["id"], changes.USERS, buckets=4)
    for lot in lots:
        rng.shuffle(lot)
        df = spark.createDataFrame(lot, "id long, at timestamp, patch_id int, plan string, admin_note string, suspended boolean")
        assert set(table.merge(changes.patch_changes(df))) <= set(range(4))
    users = spark.createDataFrame([(i, "x", None, None, None, None, None, None, None) for i in range(12)], "id long, plan string, subscription_status string, admin_note string, suspended_at timestamp, tap_customer_id string, tap_subscription_id string, subscription_interval string, subscription_current_period_end timestamp")
    got = {r.id: r for r in changes.current_users(users, table.read()).collect()}
    want = replayed(rows, "id")
    assert len(got) == 12
    for i in range(12):
        plan, note, held = want.get(i, ("x", None, None))
        r = got[i]
        assert (r.plan, r.admin_note) == (plan or "x", note)
        assert (r.suspended_at and r.suspended_at.replace(tzinfo=datetime.timezone.utc).timestamp()) == (held and held.timestamp()) or (r.suspended_at and held and r.suspended_at.astimezone(datetime.timezone.utc) == held)


def test_only_touched_buckets_are_written(spark):
    path = shared_path(spark, "test-registers")
    table = Registers(spark, path, ["id"], {"last": (LAST, "string"), "first": (FIRST, "bigint"), "all": (LOG, "int")}, buckets=8)
    assert table.read() is None
    rows = spark.range(64).select("id", F.lit(T).alias("at"), F.lit(1).alias("seq"), F.struct(F.lit("a").alias("value")).alias("last"), F.struct(F.col("id").alias("value")).alias("first"))
    assert table.merge(rows) == list(range(8))
    before = files(path)
    late = spark.createDataFrame([(5, t(-1), 9)], "id long, at timestamp, seq long")
    touched = table.merge(late.select("*", F.struct(F.lit("late").alias("value")).alias("last"), F.struct(F.lit(77).alias("value")).alias("first"), F.struct(F.lit(3).alias("value")).alias("all")))
    assert len(touched) == 1
    after = files(path)
    assert {f for f in before if f"bucket={touched[0]}" not in f} == {f for f in after if f"bucket={touched[0]}" not in f} and all(after[f] == m for f, m in before.items() if f in after)
    row = table.read().where("id = 5").first()
    assert (row["last"].value, row["first"].value, [x.value for x in row["all"]]) == ("a", 77, [3])
    assert table.read().count() == 64
    assert table.merge(rows.limit(0)) == [] and files(path) == after
    for _ in range(2):  # again, and a table that lost a bucket in the middle of a merge gets it back
        table.merge(rows)
    shutil.rmtree(f"{path.removeprefix('file://')}/bucket=3")
    table.merge(rows)
    assert {(r.id, r["last"].value) for r in table.read().collect()} == {(i, "a") for i in range(64)}
    assert "bucket IN" in table.read([1, 2])._jdf.queryExecution().executedPlan().toString() or "PartitionFilters" in table.read([1, 2])._jdf.queryExecution().executedPlan().toString()


def test_deletes_and_late_audits(spark):
    schema = "id long, user_id long, created_at timestamp, deleted_at timestamp"
    audits = spark.createDataFrame([(1, 1, t(0), None), (2, 1, t(5), None), (3, 1, t(20), None), (4, 2, t(0), t(1)), (5, 2, t(0), None), (6, None, t(0), None)], schema)
    wanted = spark.createDataFrame([(1, None, t(10)), (1, None, t(15)), (1, 2, t(7)), (1, 2, t(6)), (9, 5, t(3)), (2, 4, t(9)), (None, 6, t(3))], "user_id long, id long, at timestamp")
    one, every = Registers(spark, shared_path(spark, "one"), ["id", "user_id"], changes.AUDIT_DELETES, 4), Registers(spark, shared_path(spark, "every"), ["user_id"], changes.USER_DELETES, 4)
    assert changes.current_audits(audits, None, None).collect() == audits.collect()
    for _ in range(2):
        one.merge(changes.audit_delete_changes(wanted))
        every.merge(changes.user_delete_changes(wanted))
    got = {r.id: r.h for r in changes.current_audits(audits, one.read(), every.read()).select("id", ((F.unix_timestamp("deleted_at") - F.lit(int(T.timestamp()))) / 3600).cast("int").alias("h")).collect()}
    assert got == {1: 10, 2: 6, 3: None, 4: 1, 5: None, 6: None}


ROWS = "id long, created_at timestamp, url string"


def test_sink_runs_again(spark):
    path = shared_path(spark, "test-sink")
    day = lambda k, h=0: t(24 * k + h)
    a = spark.createDataFrame([(1, day(0), "a"), (2, day(1), "a"), (2, day(1, 5), "later"), (None, day(0), "no id")], ROWS)
    b = spark.createDataFrame([(2, day(3), "b"), (3, day(1), "b"), (4, None, "b")], ROWS)
    append_batch(a, path, 0, parts=4)
    append_batch(b, path, 1, parts=4)
    content = lambda: sorted((r.id, r.url) for r in read_audits(spark, path).collect())
    assert content() == [(1, "a"), (2, "a"), (3, "b"), (4, "b")]
    before = files(path)
    append_batch(b, path, 1, parts=4)  # again: only its own folders
    after = files(path)
    assert content() == [(1, "a"), (2, "a"), (3, "b"), (4, "b")]
    assert {f for f in before if "batch=1" not in f} == {f for f in after if "batch=1" not in f} and all(after[f] == m for f, m in before.items() if "batch=1" not in f)
    # Cut off between rows and ids, and then run again.
    append_batch(spark.createDataFrame([(5, day(0), "c"), (1, day(7), "c")], ROWS), path, 2, parts=4)
    for d, _, _ in list(os.walk(f"{path.removeprefix('file://')}/ids")):
        if d.endswith("batch=2"):
            shutil.rmtree(d)
    append_batch(spark.createDataFrame([(5, day(0), "c"), (1, day(7), "c")], ROWS), path, 2, parts=4)
    append_batch(spark.createDataFrame([(5, day(9), "d")], ROWS), path, 3, parts=4)
    assert content() == [(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")]
    append_batch(a.limit(0), path, 4, parts=4)
    one = read_audits(spark, path).where("day = date'2024-01-02'")
    assert sorted(r.id for r in one.collect()) == [2, 3] and "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().executedPlan().toString()


def test_sink_of_a_stream(spark):
    path, source = shared_path(spark, "test-sink"), shared_path(spark, "test-source")
    for k in range(3):
        spark.createDataFrame([(i, t(24 * i), f"lot{k}") for i in range(k, k + 3)], ROWS).coalesce(1).write.mode("append").parquet(source)
    rows = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
    append_stream(rows, path, shared_path(spark, "test-marks")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.id, r.url) for r in read_audits(spark, path).collect()) == [(0, "lot0"), (1, "lot0"), (2, "lot0"), (3, "lot1"), (4, "lot2")]
