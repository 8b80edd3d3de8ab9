"""Rows that wait in the streams' state, with a state store that counts its calls."""

import numpy as np
import pandas as pd
import pytest

from siteaudit.streaming import jobs


class Store:
    """What a processor asks of its handle, for one key."""

    def __init__(self):
        self.calls, self.timers, self.watermark = 0, set(), 0

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def getValueState(self, name, schema):
        return Value(self)

    def getMapState(self, name, keys, values):
        return Map(self)

    def getCurrentWatermarkInMs(self):
        return self.watermark


class Value:
    def __init__(self, store):
        self.store, self.value = store, None

    def get(self):
        self.store.calls += 1
        return self.value

    def exists(self):
        self.store.calls += 1
        return self.value is not None

    def update(self, value):
        self.store.calls += 1
        self.value = value

    def clear(self):
        self.store.calls += 1
        self.value = None


class Map(dict):
    def __init__(self, store):
        self.store = store

    def keys(self):
        self.store.calls += 1
        return list(super().keys())

    def containsKey(self, k):
        self.store.calls += 1
        return k in self

    def getValue(self, k):
        self.store.calls += 1
        return self[k]

    def updateValue(self, k, v):
        self.store.calls += 1
        self[k] = v

    def removeKey(self, k):
        self.store.calls += 1
        del self[k]


def run(times, lots, delay_s=7_200, limit=2, slice_s=600):
    """All that a limiter says of one key's requests, which come in ``lots`` batches, each up to ``delay_s`` late; the calls it made."""
    store, limiter, said = Store(), jobs._Limiter(limit, slice_s), []
    limiter.init(store)
    arrival = times + np.random.default_rng(1).integers(0, delay_s, len(times))
    edges = np.linspace(arrival.min(), arrival.max() + 1, lots + 1)
    for a, b in zip(edges, edges[1:]):
        k = np.flatnonzero((arrival >= a) & (arrival < b))
        halves = [pd.DataFrame({"id": h, "ts": pd.to_datetime(times[h], unit="s")}) for h in np.array_split(k, 2)]
        list(limiter.handleInputRows((7,), iter(halves), store))
        store.watermark = int(b - delay_s) * 1000 if b < edges[-1] else 10**12 * 4
        while due := sorted(t for t in store.timers if t <= store.watermark):
            store.timers.discard(due[0])
            said += list(limiter.handleExpiredTimer((7,), store, None))
    assert limiter.state.value is None and not dict.keys(limiter.waiting) and not store.timers
    return pd.concat(said), store.calls


@pytest.mark.parametrize("few", [4_096, 50, 0])
def test_judged_in_order(monkeypatch, few):
    monkeypatch.setattr(jobs, "FEW_ROWS", few)
    times = np.sort(np.random.default_rng(2).integers(1_700_000_000, 1_700_090_000, 2_000))
    said, _ = run(times, 5)
    assert said["ts"].is_monotonic_increasing and said["id"].is_unique and len(said) == 2_000
    admitted = jobs._admit(times.astype(float), 2, None, 0)[0]
    assert said.sort_values("id")["admitted"].tolist() == admitted.tolist()


def test_few_calls_for_many_slices():
    """66 requests of a month, each in a slice of its own: calls go by batches, not by slices."""
    times = np.sort(np.random.default_rng(3).integers(1_704_067_200, 1_706_659_200, 66))
    assert run(times, 3)[1] < 50
