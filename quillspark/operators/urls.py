"""Which URLs a request may go to: https (or http if allowed) to hosts that are not local or private.

Hosts that are addresses are judged by their ranges; names are not resolved inside a query.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

from quillspark.functions.text import let

# Address ranges that are private, loopback, link-local, multicast, reserved or unspecified.
BLOCKED_V4 = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
              "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]
OPEN_V4 = ["192.0.0.9/32", "192.0.0.10/32"]  # of these


def _v4_number(host: Column) -> Column:
    """A dotted address as a number; null for other hosts."""
    part = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    shape = rf"^{part}\.{part}\.{part}\.{part}$"
    parts = [F.regexp_extract(host, shape, n).cast("long") for n in (1, 2, 3, 4)]
    return F.when(host.rlike(shape), parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3])


# Ranges of IPv6 that are unspecified, loopback, local, multicast, documentation or reserved (mapped addresses too).
BLOCKED_V6 = ["::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10", "fec0::/10",
              "ff00::/8", "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6"]
OPEN_V6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]  # of these
# Full-width forms of the signs of addresses, and the signs that they stand for.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "。｡"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + ".."


def _v6_digits(inside: Column) -> Column:
    """The 32 hex digits of an IPv6 address; null for texts that are none. A dotted end counts as its two groups."""
    def plain(dotted: Column) -> Column:
        tail = F.lower(F.lpad(F.hex(_v4_number(dotted)), 8, "0"))
        ended = F.concat(F.regexp_replace(inside, r"[0-9.]+$", ""), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4))
        return F.when(dotted.contains("."), ended).otherwise(inside)

    def groups(side: Column) -> Column:
        return F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))

    def digits(sides: Column) -> Column:
        missing = 8 - F.size(sides["left"]) - F.size(sides["right"])
        fits = F.when(sides["n"] == 1, missing == 0).otherwise((sides["n"] == 2) & (missing > 0))
        every = F.concat(sides["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)).cast("int")), sides["right"])
        return let(every, lambda e: F.when(fits & F.forall(e, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(e, lambda g: F.lpad(g, 4, "0")), "")))

    def halved(halves: Column) -> Column:
        return let(F.struct(groups(F.get(halves, 0)).alias("left"), groups(F.coalesce(F.get(halves, 1), F.lit(""))).alias("right"), F.size(halves).alias("n")), digits)

    return let(F.regexp_extract(inside, r":([0-9.]+)$", 1), lambda dotted: let(plain(dotted), lambda x: let(F.split(x, "::", -1), halved)))


def _in_any(value: Column, ranges: list[tuple]) -> Column:
    out = F.lit(False)
    for first, last in ranges:
        out = out | value.between(first, last)
    return F.coalesce(out, F.lit(False))


def _without(blocked: list, exceptions: list) -> list:
    """The networks ``blocked`` without ``exceptions`` inside them."""
    for e in exceptions:
        blocked = [part for n in blocked for part in (n.address_exclude(e) if e.subnet_of(n) else [n])]
    return blocked


def blocked_host(host: Column) -> Column:
    """Local names, blocked addresses, and hosts that only look like addresses: malformed ones and numeric shorthand."""
    nets4, nets6 = (_without(*([ipaddress.ip_network(n) for n in nets] for nets in both)) for both in ((BLOCKED_V4, OPEN_V4), (BLOCKED_V6, OPEN_V6)))
    ranges4 = [(int(n[0]), int(n[-1])) for n in nets4]
    ranges6 = [tuple(format(int(n[i]), "032x") for i in (0, -1)) for n in nets6]

    def judged(name: Column) -> Column:
        shaped = name.rlike(r"^(0x[0-9a-f]*|[0-9]+)(\.(0x[0-9a-f]*|[0-9]+))*$")
        inside = F.regexp_replace(F.regexp_extract(name, r"^\[(.*)\]$", 1), r"%.*$", "")
        bad_v4 = let(_v4_number(name), lambda n: n.isNull() | _in_any(n, ranges4))
        bad_v6 = let(inside, lambda x: let(_v6_digits(x), lambda d: d.isNull() | _in_any(d, ranges6)))
        return (F.when(shaped, bad_v4).when(name.startswith("["), bad_v6).otherwise((name == "localhost") | name.endswith(".localhost")))

    return let(F.regexp_replace(F.lower(host), r"\.+$", ""), judged)


def url_allowed(url: Column, allow_http: bool = False) -> Column:
    """False for null, other schemes, missing hosts and blocked hosts.

    Tabs and line ends are no part of a URL, nor are control characters and blanks before it; full-width signs count as plain ones.
    """
    url = F.regexp_replace(F.translate(F.regexp_replace(url, r"[\t\r\n]", ""), _WIDE, _NARROW), r"^[\x00-\x20]+", "")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    fine = scheme.isin("http", "https") if allow_http else scheme == "https"
    return F.coalesce(fine & (host != "") & ~blocked_host(host), F.lit(False))
