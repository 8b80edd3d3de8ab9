"""Internet addresses of both kinds as 128 bits, and the networks that hold them.

An address is written as 32 hexadecimal digits, an IPv4 address as the IPv6 address that it is mapped to, so that
networks are ranges of texts that sort as their addresses do.
"""

from __future__ import annotations

from ipaddress import ip_address, ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Networks that are not public.
PRIVATE = (
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/8", "100.64.0.0/10", "192.0.0.0/24", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8",
)
MAPPED = "0" * 20 + "ffff"


def _let(value: Column, body) -> Column:
    """``body(value)``, ``value`` being evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ipv4_number(ip: Column) -> Column:
    """A dotted address as a number; null if it isn't one, or has a part with a leading zero."""
    part = lambda k: F.try_element_at(F.split(ip, r"\."), F.lit(k)).cast("long")
    number = ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)
    return F.when(ip.rlike(r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(?!$)|$)){4}$"), number)


def _eight(ip: Column) -> Column:
    return F.lpad(F.lower(F.hex(ipv4_number(ip))), 8, "0")


def _groups(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))


def _expanded(text: Column) -> Column:
    """Groups of an IPv6 address without an IPv4 part, filled up where it has ``::``."""

    def filled(sides: Column) -> Column:
        left, right = _groups(F.get(sides, 0)), _groups(F.coalesce(F.get(sides, 1), F.lit("")))
        groups = F.concat(left, right)
        short = (F.size(sides) == 2) & (F.size(groups) <= 7)
        whole = (F.size(sides) == 1) & (F.size(groups) == 8)
        right_form = F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        padded = lambda side: F.array_join(F.transform(side, lambda g: F.lpad(g, 4, "0")), "")
        return F.when((short | whole) & right_form, F.concat(padded(left), F.repeat(F.lit("0000"), 8 - F.size(groups)), padded(right)))

    return _let(F.split(text, "::"), filled)


def address_key(ip: Column) -> Column:
    """An address as 32 hexadecimal digits; null for null and for what is no address.

    Any form of IPv6 is read: shortened once anywhere, in capitals, with leading zeros in groups of up to four digits, with an IPv4 address at its end; spaces around it and a zone behind % don't count.
    """

    def key(text: Column) -> Column:
        # An IPv4 part at the end takes the place of two groups.
        dotted = F.regexp_extract(text, r"^(?:.*:)?([^:]*)$", 1)
        head = F.substring_index(text, ":", -1)
        v4 = _eight(dotted)
        as_groups = F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(head)), F.substring(v4, 1, 4), F.lit(":"), F.substring(v4, 5, 4))
        v6 = F.when(text.contains("."), as_groups).otherwise(text)
        return F.when(text.contains(":"), _expanded(v6)).otherwise(F.concat(F.lit(MAPPED), _eight(text)))

    return _let(F.regexp_replace(F.lower(F.trim(ip)), "%.*$", ""), key)


def _digits(address) -> str:
    mapped = int(address) | (0xFFFF << 32 if address.version == 4 else 0)
    return f"{mapped:032x}"


def ranges(networks) -> list[tuple[str, str]]:
    """First and last key of networks in CIDR form: sorted, those that overlap or touch as one."""
    spans = sorted((_digits(n[0]), _digits(n[-1])) for n in map(ip_network, networks))
    out: list[tuple[str, str]] = []
    for first, last in spans:
        if out and int(first, 16) <= int(out[-1][1], 16) + 1:
            out[-1] = out[-1][0], max(last, out[-1][1])
        else:
            out.append((first, last))
    return out


def within(key: Column, networks) -> Column:
    """Whether a key lies in one of some networks: range predicates over few ranges, no join. False for null."""
    hit = F.lit(False)
    for first, last in ranges(networks):
        hit = hit | key.between(first, last)
    return F.coalesce(hit, F.lit(False))


def is_private_ip(ip: Column) -> Column:
    """Whether an address, of either kind, is in a network that isn't public. False for null and for what is no address."""
    return _let(address_key(ip), lambda key: within(key, PRIVATE))


def key_of(address: str) -> str:
    """``address_key`` of one address."""
    return _digits(ip_address(address))
