"""Rate limits, quotas, report dedupe and running counts, as streams and as their batch twins.

State is one small row for each key and is evicted by watermark or timeout; each
function takes a streaming DataFrame and returns one. ``drain`` runs one to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siteaudit.functions.accounts import DAILY_LIMITS
from siteaudit.sources.staging import shared_path

#: Requests a minute for each address and for each signed-in user.
PER_ADDRESS, PER_USER, WINDOW_S = 10, 50, 60
DAY_US = 86_400_000_000


def _admit(times: np.ndarray, limit: int, start: float | None, n: int) -> tuple[np.ndarray, float | None, int]:
    """Whether each request of one key, in order of time, is admitted. A window starts with a key's first request after the one before has
    ended (strictly later); rejected requests count too."""
    out = np.empty(len(times), bool)
    for i, t in enumerate(times):
        if start is None or t > start + WINDOW_S:
            start, n = t, 0
        n += 1
        out[i] = n <= limit
    return out, start, n


def rate_limit_batch(requests: DataFrame, limit: int = PER_USER) -> DataFrame:
    """``requests(id, key, ts)``: adds ``admitted``. One pass over each sorted partition with one state, so a hot key is streamed, never gathered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, n = object(), None, 0
        for pdf in batches:
            if pdf.empty:
                continue
            seconds = pdf["ts"].astype("int64").to_numpy() / {"us": 1e6, "ns": 1e9, "ms": 1e3, "s": 1}[np.datetime_data(pdf["ts"].to_numpy().dtype)[0]]
            keys, out = pdf["key"].to_numpy(), np.empty(len(pdf), bool)
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            for a, b in zip(edges, [*edges[1:], len(keys)]):
                if keys[a] != key:
                    key, start, n = keys[a], None, 0
                out[a:b], start, n = _admit(seconds[a:b], limit, start, n)
            yield pdf.assign(admitted=out)

    sorted_ = requests.select("id", "key", "ts").repartition("key").sortWithinPartitions("key", "ts", "id")
    return sorted_.mapInPandas(run, "id long, key long, ts timestamp, admitted boolean")


#: Waiting rows of a key that are held as one state; beyond, they are held by slices.
FEW_ROWS = 4_096


class _InOrder(StatefulProcessor):
    """Rows of a key wait, by slices of time, until the watermark has passed their slice; then they are judged in order. ``extra``: a column of whole numbers that waits with them.

    A call of the state store costs about as much as many rows, so a key makes a few of them a batch, however many slices its rows are in: up to ``FEW_ROWS`` waiting rows
    are one state, with one timer for the first of them. Of a key with more, they are moved to a state for each slice, which is all that is held of it then.
    """

    STATE, EXTRA = "", ""

    def __init__(self, slice_s: int):
        self.slice_us = slice_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.STATE)
        # ``timer``: when the first waiting row's slice ends, in milliseconds (0: nothing waits); ``sliced``: whether some wait by slices.
        self.few = handle.getValueState("few", "ids array<long>, times array<long>, extras array<long>, timer long, sliced boolean")
        self.waiting = handle.getMapState("waiting", "slice long", "ids array<long>, times array<long>, extras array<long>")

    def judged(self, key, ids: np.ndarray, times: np.ndarray, extras: np.ndarray, state: tuple | None) -> tuple[dict, tuple | None]:
        """What comes of rows in order, as columns, and the state after them."""
        raise NotImplementedError

    def end(self, state: tuple) -> int:
        """The last microsecond for which the state counts."""
        raise NotImplementedError

    def left(self, key, state: tuple) -> dict | None:
        """What comes of a state when it goes."""

    def _ends(self, slice_: int) -> int:
        """When a slice ends, in milliseconds."""
        return (slice_ + 1) * self.slice_us // 1000

    def _held(self) -> tuple[tuple[np.ndarray, ...], int, bool]:
        row = self.few.get()
        ids, times, extras, timer, sliced = row if row is not None else ((), (), (), 0, False)
        return tuple(np.array(x, np.int64) for x in (ids, times, extras)), timer, sliced

    def _by_slices(self, columns: tuple[np.ndarray, ...]) -> None:
        slices = columns[1] // self.slice_us
        for s in np.unique(slices).tolist():
            held = [c[slices == s].tolist() for c in columns]
            if self.waiting.containsKey((s,)):
                held = [[*old, *new] for old, new in zip(self.waiting.getValue((s,)), held)]
            self.waiting.updateValue((s,), tuple(held))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, timer, sliced, first = None, 0, False, None
        for pdf in rows:
            pdf = pdf[pdf["id"].notna()]  # the others only move the time on
            if pdf.empty:
                continue
            us = _micros(pdf["ts"])
            new = pdf["id"].to_numpy(np.int64), us, pdf[self.EXTRA].to_numpy(np.int64) if self.EXTRA else us
            if held is None:
                held, timer, sliced = self._held()
            ends = self._ends(int(us.min()) // self.slice_us)
            first = ends if first is None else min(first, ends)
            held = tuple(np.concatenate([old, more]) for old, more in zip(held, new))
            if len(held[0]) > FEW_ROWS:
                self._by_slices(held)
                held, sliced = tuple(c[:0] for c in held), True
        if held is not None:
            if not timer or first < timer:
                self.handle.registerTimer(first)
                timer = first
            self.few.update((*(c.tolist() for c in held), timer, sliced))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = timerValues.getCurrentWatermarkInMs() * 1000  # all that it has passed, whichever timer comes first
        state = self.state.get()
        old, (held, timer, sliced) = state, self._held()
        fired = bool(timer) and timer * 1000 <= due
        if fired:
            passed = (held[1] // self.slice_us + 1) * self.slice_us <= due
            ready, held = tuple(c[passed] for c in held), tuple(c[~passed] for c in held)
            later = [self._ends(int(held[1].min()) // self.slice_us)] if len(held[0]) else []
            if sliced:
                keys = sorted(s for (s,) in self.waiting.keys())
                edges = ready[1] // self.slice_us
                for s in (s for s in keys if self._ends(s) * 1000 <= due):
                    # Rows of earlier slices that wait in the one state are judged before, those of this slice with it.
                    until = edges <= s
                    here = tuple(np.concatenate([np.array(x, np.int64), c[until]]) for x, c in zip(self.waiting.getValue((s,)), ready))
                    ready, edges = tuple(c[~until] for c in ready), edges[~until]
                    order = np.lexsort((here[0], here[1]))
                    out, state = self.judged(key, *(c[order] for c in here), state)
                    self.waiting.removeKey((s,))
                    yield pd.DataFrame(out)
                rest = [s for s in keys if self._ends(s) * 1000 > due]
                later += [self._ends(rest[0])] if rest else []
                sliced = bool(rest)
            if len(ready[0]):
                order = np.lexsort((ready[0], ready[1]))
                out, state = self.judged(key, *(c[order] for c in ready), state)
                yield pd.DataFrame(out)
            timer = min(later, default=0)
            if timer:
                self.handle.registerTimer(timer)
                self.few.update((*(c.tolist() for c in held), timer, sliced))
            else:
                self.few.clear()
        if state is None:
            return
        # No row that the state counts for waits once the slice has been judged in which it ends.
        over = self._ends(self.end(state) // self.slice_us)
        if over * 1000 > due:
            if fired:
                self.state.update(state)
                self.handle.registerTimer(over)
            return
        if old is not None:
            self.state.clear()
        if (out := self.left(key, state)) is not None:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


class _Limiter(_InOrder):
    """The window of a minute and, if there is a ``quota``, for those it admits the room of their day."""

    STATE = "start double, n long, day long, taken long"

    def __init__(self, limit: int, slice_s: int, quota: bool = False):
        super().__init__(slice_s)
        self.limit, self.quota, self.EXTRA = limit, quota, "room" if quota else ""

    def judged(self, key, ids, times, extras, state):
        start, n, day, taken = state or (None, 0, None, 0)
        admitted, start, n = _admit(times / 1e6, self.limit, start, n)
        out = {"id": ids, "key": key[0], "ts": pd.to_datetime(times, unit="us"), "admitted": admitted}
        if self.quota:
            within = np.zeros(len(ids), bool)
            for k in np.flatnonzero(admitted).tolist():
                if day != times[k] // DAY_US:
                    day, taken = int(times[k] // DAY_US), 0
                taken += 1
                within[k] = taken <= extras[k]
            out |= {"admitted": within, "in_rate": admitted}
        return out, (float(start), int(n), day, int(taken))

    def end(self, state):
        start, _, day, _ = state
        return max(int((start + WINDOW_S) * 1e6), (day + 1) * DAY_US if day is not None else 0)


SAVE, GET = 1, 0


def _answers(times: np.ndarray, kinds: np.ndarray, keep_us: int, saved: int | None) -> tuple[list[str], list[int], int | None]:
    """What saves and gets of one report come to, in order; when reports went that others took the place of; when the one that stands was saved."""
    out, gone = [], []
    for t, kind in zip(times.tolist(), kinds.tolist()):
        there = saved is not None and t <= saved + keep_us
        if kind == SAVE and not there:
            if saved is not None:
                gone.append(saved + keep_us)
            saved = t
        out.append(("duplicate" if there else "saved") if kind == SAVE else "found" if there else "missing")
    return out, gone, saved


class _Reports(_InOrder):
    STATE, EXTRA = "saved long", "kind"

    def __init__(self, keep_us: int, slice_s: int):
        super().__init__(slice_s)
        self.keep_us = keep_us

    def judged(self, key, ids, times, extras, state):
        what, gone, saved = _answers(times, extras, self.keep_us, state[0] if state else None)
        ids = pd.array([*ids.tolist(), *[None] * len(gone)], "Int64")
        return {"id": ids, "key": key[0], "ts": pd.to_datetime([*times.tolist(), *gone], unit="us"), "what": what + ["evicted"] * len(gone)}, (saved,) if saved is not None else None

    def end(self, state):
        return state[0] + self.keep_us

    def left(self, key, state):
        return {"id": pd.array([None], "Int64"), "key": key[0], "ts": pd.to_datetime([self.end(state)], unit="us"), "what": ["evicted"]}


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy().astype("datetime64[us]").astype(np.int64)


def rate_limit(requests: DataFrame, limit: int = PER_USER, slice_s: int = 60) -> DataFrame:
    """The same over a stream of ``requests(id, key, ts)`` with a watermark on ``ts``, whatever the order in which they come and the batches they come in.

    A request is judged once the watermark has passed its slice of ``slice_s`` seconds: all before it are known then, as later ones are late and dropped by Spark.
    State: a key's waiting requests, and the start and count of its window, which goes when it has ended. A slice of a key is held in a task,
    no more. A row with a null id only moves the time on; null keys are one key.
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # timers need it
    return requests.select("id", "key", "ts").groupBy("key").transformWithStateInPandas(_Limiter(limit, slice_s), "id long, key long, ts timestamp, admitted boolean", "Append", "EventTime")


def admission(requests: DataFrame, users: DataFrame, limits: DataFrame, usage: DataFrame | None = None, limit: int = PER_USER, slice_s: int = 60) -> DataFrame:
    """The gates of the service as one stream with one checkpoint: suspended users go, then each key's window of a minute, then its daily quota.

    ``requests(id, key, ts)``, a stream with a watermark on ``ts``, ``key`` being the user's id; tables: ``users(id, suspended_at)``, ``limits(key, daily_limit)`` (none: free),
    ``usage(key, usage_date, count)`` of before. Adds ``in_rate`` and ``admitted``. Both counts are kept by key, so that rows are shuffled once; requests that the window rejects count in it but not in the quota. Equal
    to ``drop_suspended``, ``rate_limit_batch`` and ``admit_requests`` one after another, over whatever batches and restarts.
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    gone = users.where("suspended_at is not null").select(F.col("id").alias("key"))
    out = requests.select("id", "key", "ts").join(gone, "key", "left_anti").join(limits.select("key", "daily_limit"), "key", "left")
    room = F.coalesce("daily_limit", F.lit(DAILY_LIMITS["free"])).cast("long")
    if usage is not None:
        used = usage.select("key", F.col("usage_date").alias("_day"), F.col("count").alias("_used"))
        out = out.withColumn("_day", F.to_date("ts")).join(used, ["key", "_day"], "left")
        room = room - F.coalesce("_used", F.lit(0))
    out = out.select("id", "key", "ts", room.alias("room"))
    return out.groupBy("key").transformWithStateInPandas(_Limiter(limit, slice_s, quota=True), "id long, key long, ts timestamp, admitted boolean, in_rate boolean", "Append", "EventTime")


def daily_quota(requests: DataFrame, limit: Column, late: str = "1 day") -> DataFrame:
    """Requests of each key and UTC day, and how many are admitted: a tumbling window; ``limit`` is a column of ``requests``."""
    days = requests.withColumn("limit", limit).withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "key", "limit")
    out = days.agg(F.count("*").alias("n"))
    return out.select("key", F.col("window.start").alias("day"), "n", F.least("n", F.greatest(F.lit(0), F.col("limit"))).alias("admitted"))


def dedupe_reports(reports: DataFrame, keep: str = "48 hours") -> DataFrame:
    """The first of the reports with one id; ids are forgotten ``keep`` after they were seen."""
    return reports.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["id"])


ANSWERS = "id long, key long, ts timestamp, what string"


def report_store(requests: DataFrame, keep_s: int = 48 * 3600, slice_s: int = 60) -> DataFrame:
    """Reports that stand for ``keep_s`` seconds, as a stream: ``requests(id, key, ts, kind)``, with a watermark on ``ts``, save (``SAVE``) or ask for (``GET``) the report ``key``.

    ``what``: a save is ``saved``, or ``duplicate`` if the report stands (the first stays, and its time isn't prolonged); a get is ``found`` or ``missing``; a report that goes is ``evicted``, a row
    with null id and the time at which it went. Rows are judged in order of time, once the watermark has passed their slice. State: when a report was saved, until it goes.
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return requests.select("id", "key", "ts", F.col("kind").cast("int").alias("kind")).groupBy("key").transformWithStateInPandas(_Reports(keep_s * 1_000_000, slice_s), ANSWERS, "Append", "EventTime")


def report_store_batch(requests: DataFrame, keep_s: int = 48 * 3600) -> DataFrame:
    """The same over a table; all reports go in the end. One pass over each sorted partition, so that a report asked for often is streamed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, saved, keep = None, None, keep_s * 1_000_000
        rows = lambda ids, key, times, what: pd.DataFrame({"id": pd.array(ids, "Int64"), "key": pd.array([key] * len(ids), "Int64"), "ts": pd.to_datetime(times, unit="us"), "what": what})
        for pdf in batches:
            if pdf.empty:
                continue
            us, keys, kinds = _micros(pdf["ts"]), pdf["key"].to_numpy(), pdf["kind"].to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            for a, b in zip(edges, [*edges[1:], len(keys)]):
                if keys[a] != key:
                    if saved is not None:
                        yield rows([None], key, [saved + keep], ["evicted"])
                    key, saved = keys[a], None
                what, gone, saved = _answers(us[a:b], kinds[a:b], keep, saved)
                yield rows([*pdf["id"].to_numpy()[a:b].tolist(), *[None] * len(gone)], key, [*us[a:b].tolist(), *gone], what + ["evicted"] * len(gone))
        if saved is not None:
            yield rows([None], key, [saved + keep], ["evicted"])

    sorted_ = requests.where("id is not null").select("id", "key", "ts", "kind").repartition("key").sortWithinPartitions("key", "ts", "id")
    return sorted_.mapInPandas(run, ANSWERS)


def running_counts(audits: DataFrame, late: str = "1 day") -> DataFrame:
    """Audits by day and how many had performance data, as they come in."""
    days = audits.withWatermark("ts", late).groupBy(F.window("ts", "1 day"))
    out = days.agg(F.count("*").alias("total"), F.count_if(F.coalesce("perf_available", F.lit(False))).alias("perf_ok"))
    return out.select(F.col("window.start").alias("day"), "total", "perf_ok", (F.col("total") - F.col("perf_ok")).alias("perf_fail"))


def failures_24h(failures: DataFrame, late: str = "1 hour") -> DataFrame:
    """Failures by host over 24 hours, each hour."""
    host = F.regexp_replace(F.lower(F.expr("try_parse_url(url, 'HOST')")), r"^www\.", "")
    hours = failures.withColumn("host", host).withWatermark("ts", late).groupBy(F.window("ts", "24 hours", "1 hour"), "host")
    return hours.agg(F.count("*").alias("n")).select("host", F.col("window.end").alias("until"), "n")


def stream(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """A table at ``path`` (a Parquet file or folder) as a stream of files, ``files`` of them a batch."""
    schema = spark.read.parquet(path).schema
    # As a pattern: the file source takes a plain path for a folder.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path + "*")


def drain(out: DataFrame, keys: list[str] | None = None, at: tuple[str, str] | None = None) -> DataFrame:
    """Run a stream until all there is has been read, and return what it wrote.

    Append mode without ``keys``; else update mode, of whose rows for one key the last batch's count. Output and
    checkpoint lie in the shared folder; given ``at``, the paths of both, a stream goes on where it was.
    """
    spark = out.sparkSession
    path, marks = at or (shared_path(spark, "stream-out"), shared_path(spark, "stream-marks"))

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/_batch={batch}")  # a batch that is run again replaces what it wrote

    writer = out.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).outputMode("update" if keys else "append")
    writer.foreachBatch(write).start().awaitTermination()
    written = spark.read.schema(out.schema.add("_batch", "integer")).option("basePath", path).parquet(f"{path}/_batch=*")
    if not keys:
        return written.drop("_batch")
    rest = [c for c in out.columns if c not in keys]
    return written.groupBy(*keys).agg(*[F.max_by(c, "_batch").alias(c) for c in rest])
