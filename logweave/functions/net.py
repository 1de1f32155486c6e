"""IP addresses and address ranges, IPv4 and IPv6, as 16-byte values."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_PLAIN4 = rf"^{_IPV4}\z"
# Eight colons at most, groups of up to four digits, one double colon at most.
_PLAIN6 = rf"^(?!.*::.*::)(?!.*:::)(?!:[^:])(?=.*:)(?:[0-9a-fA-F]{{0,4}}:){{2,8}}(?:[0-9a-fA-F]{{1,4}}|{_IPV4}|)(?<!(?<!:):)\z"
_MAPPED = bytes(10) + b"\xff\xff"


def _hex4(ip: Column) -> Column:
    """Eight hex digits of dotted text."""
    octet = lambda i: F.lpad(F.hex(F.split_part(ip, F.lit("."), F.lit(i)).try_cast("long")), 2, "0")
    return F.concat(octet(1), octet(2), octet(3), octet(4))


def _hex6(ip: Column) -> Column:
    """32 hex digits of colon text; NULL where the groups do not add up to eight."""
    tail = F.regexp_extract(ip, rf"({_IPV4})\z", 1)
    dotted = _hex4(tail)
    colons = F.when(tail == "", ip).otherwise(
        F.concat(F.regexp_replace(ip, rf"{_IPV4}\z", ""), F.substring(dotted, 1, 4), F.lit(":"), F.substring(dotted, 5, 4))
    )
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    digits = lambda part: F.array_join(F.transform(groups(part), lambda g: F.lpad(g, 4, "0")), "")
    head, rest = F.substring_index(colons, "::", 1), F.substring_index(colons, "::", -1)
    short = F.contains(colons, F.lit("::"))
    missing = 32 - F.length(digits(head)) - F.length(digits(rest))
    filled = F.concat(digits(head), F.repeat(F.lit("0"), F.greatest(missing, F.lit(0))), digits(rest))
    whole = F.when(short, F.when(missing >= 4, filled)).otherwise(digits(colons))
    return F.when(F.length(whole) == 32, whole)


def address_bytes(ip: Column) -> Column:
    """16 bytes of an address, NULL for anything else. IPv4 takes its place in IPv6, so both forms of one address are equal."""
    return F.coalesce(
        F.when(ip.rlike(_PLAIN4), F.unhex(F.concat(F.lit(_MAPPED.hex()), _hex4(ip)))), F.when(ip.rlike(_PLAIN6), F.unhex(_hex6(ip)))
    )


def in_ranges(address: Column, ranges: list[tuple[bytes, bytes]]) -> Column:
    """Whether the address lies in any range. Bound once, so it is computed once per row."""
    spans = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in ranges])
    return F.exists(F.array(address), lambda n: F.exists(spans, lambda s: n.between(s["lo"], s["hi"])))


def merged_ranges(entries: list[str]) -> list[tuple[bytes, bytes]]:
    """Disjoint, sorted ranges of an allow list; blank and malformed entries are skipped."""
    spans: list[tuple[int, int]] = []
    for entry in entries:
        entry = (entry or "").strip()
        try:
            net = ipaddress.ip_network(entry, strict=False) if "/" in entry else ipaddress.ip_network(entry)
        except ValueError:
            continue
        base = int.from_bytes(_MAPPED, "big") << 32 if net.version == 4 else 0
        spans.append((base + int(net.network_address), base + int(net.broadcast_address)))
    spans.sort()
    merged: list[tuple[int, int]] = []
    for lo, hi in spans:
        if merged and lo <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(merged[-1][1], hi))
        else:
            merged.append((lo, hi))
    return [(lo.to_bytes(16, "big"), hi.to_bytes(16, "big")) for lo, hi in merged]
