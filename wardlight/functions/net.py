"""Whether an address is public, by the ranges that are set aside."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
#: Networks that are not public; documentation networks count as public and are left out.
PRIVATE = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.168.0.0/16", "198.18.0.0/15", "240.0.0.0/4")
PUBLIC_WITHIN = ("192.0.0.9/32", "192.0.0.10/32")
#: The same of IPv6, private and reserved ones, by the registries of special addresses.
PRIVATE_6 = ("64:ff9b:1::/48", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10")
RESERVED_6 = ("::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9")
PUBLIC_WITHIN_6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
_GROUPS = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"
IPV6 = rf"^(?:{_GROUPS}|(?:{_GROUPS})?::(?:{_GROUPS})?)$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), 0)


def ipv4_number(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return sum((F.element_at(parts, i + 1).cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("long"))


def ranges(nets: tuple[str, ...], without: tuple[str, ...]) -> list[tuple[int, int]]:
    """First and last numbers of the stretches that networks cover together, less others."""
    ends: dict[int, list[int]] = {}
    for i, group in enumerate((nets, without)):
        for net in map(ipaddress.ip_network, group):
            ends.setdefault(int(net.network_address), [0, 0])[i] += 1
            ends.setdefault(int(net.broadcast_address) + 1, [0, 0])[i] -= 1
    out, inside, open_ = [], [0, 0], None
    for at in sorted(ends):
        inside = [x + y for x, y in zip(inside, ends[at], strict=True)]
        if open_ is None and inside[0] and not inside[1]:
            open_ = at
        elif open_ is not None and not (inside[0] and not inside[1]):
            out.append((open_, at - 1))
            open_ = None
    return out


def _within(n: Column, stretches: list[tuple[int, int]], show: Callable[[int], int | str] = int) -> Column:
    return reduce(lambda a, b: a | b, [n.between(show(first), show(last)) for first, last in stretches])


def ipv4_is_public(ip: Column) -> Column:
    n = F.when(ip.rlike(IPV4), ipv4_number(ip))
    return F.coalesce(let(n, lambda x: ~_within(x, ranges(PRIVATE, PUBLIC_WITHIN))), F.lit(False))


def ipv6_digits(ip: Column) -> Column:
    """The address as 32 hexadecimal digits, whose order is that of addresses; null for what is none.  A zone behind % is left out, and
    the last two groups may be written as an IPv4 address."""
    hexed = lambda n: F.lower(F.conv(n.cast("string"), 10, 16))
    groups = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")
    padded = lambda gs: F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), "")

    def plain(low: Column) -> Column:
        tail = F.substring_index(low, ":", -1)
        head = F.substring(low, F.lit(1), F.length(low) - F.length(tail))
        return F.when(tail.rlike(IPV4), let(ipv4_number(tail), lambda n: F.concat(head, hexed(F.floor(n / 65536)), F.lit(":"), hexed(n % 65536)))).otherwise(low)

    def digits(low: Column) -> Column:
        short = low.contains("::")
        after = F.when(short, F.substring_index(low, "::", -1)).otherwise("")
        whole = lambda p: F.when(F.when(short, F.size(p["b"]) + F.size(p["a"]) <= 7).otherwise(F.size(p["b"]) == 8), F.concat(padded(p["b"]), F.repeat(F.lit("0"), (8 - F.size(p["b"]) - F.size(p["a"])) * 4), padded(p["a"])))
        return F.when(low.rlike(IPV6), let(F.struct(groups(F.substring_index(low, "::", 1)).alias("b"), groups(after).alias("a")), whole))

    return let(let(F.lower(F.regexp_replace(ip, r"%[^%]+$", "")), plain), digits)


def ipv6_is_public(ip: Column) -> Column:
    return F.coalesce(let(ipv6_digits(ip), lambda h: ~_within(h, NOT_PUBLIC_6, "{:032x}".format)), F.lit(False))


#: Reserved networks (among them that of IPv4 addresses inside IPv6) and private ones, of which some parts are public.
NOT_PUBLIC_6 = ranges(RESERVED_6, ()) + ranges(PRIVATE_6, PUBLIC_WITHIN_6)


def is_public(ip: Column) -> Column:
    """False for what is no address."""
    return F.when(ip.contains(":"), ipv6_is_public(ip)).otherwise(ipv4_is_public(ip))
