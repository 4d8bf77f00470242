"""IP address rules as column expressions.

IPv4 text becomes a number and IPv6 text a 32-digit hexadecimal string, so every
network test is a plain range comparison that stays inside code generation.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from duskwatch.functions.columns import let, strip

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4_STRICT = rf"^{_OCTET}(\.{_OCTET}){{3}}$"

# --- fixed values: address registries --------------------------------------
PRIVATE_V4 = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")
PRIVATE_V6 = ("fc00::/7",)
NOT_GLOBAL_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "240.0.0.0/4",
)
GLOBAL_ANYWAY_V4 = ("192.0.0.9/32", "192.0.0.10/32")
NOT_GLOBAL_V6 = (
    "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32",
    "2002::/16", "fc00::/7", "fe80::/10",
)
GLOBAL_ANYWAY_V6 = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
)
PROTECTED_V4 = ("127.0.0.0/8", "0.0.0.0/32", "224.0.0.0/4")
PROTECTED_V6 = ("::1/128", "::/128", "ff00::/8")


def is_ipv4(c: Column) -> Column:
    return F.coalesce(c.rlike(IPV4_STRICT), F.lit(False))


def ipv4_number(c: Column) -> Column:
    """32-bit value of a valid IPv4 text, null otherwise."""
    part = F.split(c, r"\.")
    octet = [F.try_element_at(part, F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    value = octet[0] * 16777216 + octet[1] * 65536 + octet[2] * 256 + octet[3]
    return F.when(is_ipv4(c), value)


def _hex_from_v4(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(ipv4_number(c))), 8, "0")


def _groups(half: Column) -> Column:
    """Non-empty 16-bit groups of one side of a '::'."""
    return F.filter(F.split(F.coalesce(half, F.lit("")), ":", -1), lambda g: g != "")


def _fold_quad(text: Column) -> Column:
    """A dotted IPv4 tail rewritten as two 16-bit groups."""
    tail = F.regexp_extract(text, r"(\d+\.\d+\.\d+\.\d+)$", 1)
    head = F.regexp_replace(text, r"\d+\.\d+\.\d+\.\d+$", "")
    quad = let(_hex_from_v4(tail), lambda q: F.concat(head, F.substring(q, 1, 4), F.lit(":"), F.substring(q, 5, 4)))
    return F.when(tail == "", text).otherwise(quad)


def ipv6_hex(c: Column) -> Column:
    """32 hexadecimal digits of a valid IPv6 text, null otherwise."""

    def expand(halves: Column) -> Column:
        gap = F.size(halves) == 2
        sides = F.struct(
            _groups(F.try_element_at(halves, F.lit(1))).alias("left"),
            F.when(gap, _groups(F.try_element_at(halves, F.lit(2)))).otherwise(F.array().cast("array<string>")).alias("right"),
        )

        def fill(s: Column) -> Column:
            missing = 8 - F.size(s["left"]) - F.size(s["right"])
            zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
            fits = F.when(gap, missing >= 1).otherwise(missing == 0) & (F.size(halves) <= 2)
            padded = F.transform(F.concat(s["left"], zeros, s["right"]), lambda g: F.lpad(g, 4, "0"))
            return F.when(fits, F.concat_ws("", padded))

        return let(sides, fill)

    def digits(text: Column) -> Column:
        shaped = (
            text.rlike(r"^[0-9a-f:]+$")
            & text.contains(":")
            & ~text.rlike(r"(^:[^:])|([^:]:$)|:::|[0-9a-f]{5}")
        )
        return F.when(shaped, let(F.split(text, "::", -1), expand))

    return let(_fold_quad(F.lower(F.regexp_replace(c, r"%[^%]+$", ""))), digits)


def _in_v4(number: Column, nets: tuple[str, ...]) -> Column:
    cond = F.lit(False)
    for net in map(ipaddress.ip_network, nets):
        cond = cond | number.between(int(net.network_address), int(net.broadcast_address))
    return cond


def _in_v6(digits: Column, nets: tuple[str, ...]) -> Column:
    cond = F.lit(False)
    for net in map(ipaddress.ip_network, nets):
        cond = cond | digits.between(f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}")
    return cond


def _mapped_number(digits: Column) -> Column:
    """IPv4 value inside an IPv4-mapped IPv6 address, null for any other."""
    return F.when(digits.startswith("0" * 20 + "ffff"), F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint"))


def _global_v4(number: Column) -> Column:
    return ~_in_v4(number, NOT_GLOBAL_V4) | _in_v4(number, GLOBAL_ANYWAY_V4)


def ip_scope(c: Column) -> Column:
    """``invalid``, ``private``, ``non-public`` or ``public``."""

    def scope_v4(n: Column) -> Column:
        return F.when(_global_v4(n), "public").when(_in_v4(n, PRIVATE_V4), "private").otherwise("non-public")

    def scope_v6(d: Column) -> Column:
        plain = ~_in_v6(d, NOT_GLOBAL_V6) | _in_v6(d, GLOBAL_ANYWAY_V6)
        is_global = F.coalesce(let(_mapped_number(d), _global_v4), plain)
        return (
            F.when(d.isNull(), "invalid")
            .when(is_global, "public")
            .when(_in_v6(d, PRIVATE_V6), "private")
            .otherwise("non-public")
        )

    return F.when(is_ipv4(c), let(ipv4_number(c), scope_v4)).otherwise(let(ipv6_hex(c), scope_v6))


def is_blockable_ip(c: Column) -> Column:
    """Valid and neither loopback, unspecified nor multicast."""

    def safe_v6(d: Column) -> Column:
        mapped = let(_mapped_number(d), lambda n: ~_in_v4(n, PROTECTED_V4))
        return F.coalesce(mapped, ~_in_v6(d, PROTECTED_V6))

    def safe(text: Column) -> Column:
        v4 = let(ipv4_number(text), lambda n: ~_in_v4(n, PROTECTED_V4))
        return F.when(is_ipv4(text), v4).otherwise(let(ipv6_hex(text), safe_v6))

    return F.coalesce(let(strip(c), safe), F.lit(False))
