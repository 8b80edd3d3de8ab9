"""Addresses of both kinds against Python's own reader, and the networks that aren't public."""

import random
from ipaddress import ip_address, ip_network

from pyspark.sql import functions as F

from siteaudit.functions.addresses import MAPPED, PRIVATE, address_key, is_private_ip, ranges, within


def expected(text):
    try:
        a = ip_address(text.strip().split("%")[0])
    except (ValueError, AttributeError):
        return None
    return f"{int(a):032x}" if a.version == 6 else f"{MAPPED}{int(a):08x}"


def test_keys_of_any_form(spark):
    rng = random.Random(4)
    texts = [None, "", " ", ":", "::", ":::", "1:", ":1", "::1", "0::1", "::0001", "::00001", "::ffff:7f00:1", "::ffff:a00:1", "::FFFF:127.0.0.1", "fe80::1%eth0", "1::2::3", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8",
             "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "1:2:3:4:5::1.2.3.4", "::1.2.3", "::1.2.3.04", "1.2.3.4", "01.2.3.4", "1.2.3.4.", "1.2.3.256", "1.2.3", "x", "12345::", "::g", " 8.8.8.8 ", "::1.2.3.4:5"]
    for _ in range(600):
        groups = [rng.choice(["0", "0", "0", "ffff", "a", "10", "00F", "dead", "1.2.3.4", ""]) for _ in range(rng.choice([3, 7, 8, 8, 9]))]
        texts.append(":".join(groups))
        at = rng.randrange(len(groups))
        texts.append(":".join(groups[:at]) + "::" + ":".join(g for g in groups[at + rng.randint(0, 4) :]))
    got = {r.ip: r.key for r in spark.createDataFrame([(x,) for x in texts], "ip string").select("ip", address_key(F.col("ip")).alias("key")).collect()}
    assert got == {x: expected(x) for x in texts}
    assert sum(k is not None for k in got.values()) > 200


def test_networks_at_their_edges(spark):
    spans = ranges(PRIVATE)
    assert spans == sorted(spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    rows = []
    for n in map(ip_network, PRIVATE):
        first, last = int(n[0]), int(n[-1])
        for k in (first - 1, first, last, last + 1):
            if 0 <= k < 2**n.max_prefixlen:
                a = type(n[0])(k)
                rows.append((str(a), any(a in m for m in map(ip_network, PRIVATE) if m.version == a.version)))
    rows += [("0::1", True), ("::0001", True), ("::ffff:7f00:1", True), ("::ffff:a00:1", True), ("::10.0.0.1", False), ("::2", False), ("fe80::1%eth0", True), ("host", False), (None, False)]
    df = spark.createDataFrame(rows, "ip string, private boolean")
    assert df.where(is_private_ip(F.col("ip")) != F.col("private")).collect() == []
    assert ranges(["10.0.0.0/9", "10.128.0.0/9", "10.1.0.0/16"]) == ranges(["10.0.0.0/8"])
    assert df.where(within(address_key(F.col("ip")), ["::/0"])).count() == len(rows) - 2
