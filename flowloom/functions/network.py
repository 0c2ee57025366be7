"""Column functions over addresses, ports and directions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Private networks that count as internal unless told otherwise.
INTERNAL = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7", "fe80::/10")
#: UDP services that reflect.
REFLECTOR_PORTS = (53, 123, 1900, 11211, 389, 19, 161, 111)
#: IANA protocol numbers by name, and ICMP types with the type that answers them.
PROTOCOLS = {"ICMP": 1, "TCP": 6, "UDP": 17, "ICMPv6": 58, "SCTP": 132}
ICMP_PAIRS = {0: 8, 8: 0, 9: 10, 10: 9, 13: 14, 14: 13, 15: 16, 16: 15, 17: 18, 18: 17}
ICMP6_PAIRS = {128: 129, 129: 128, 130: 131, 131: 130, 133: 134, 134: 133, 135: 136, 136: 135, 139: 140, 140: 139, 144: 145, 145: 144}


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def port_class(port: str | Column) -> Column:
    """0: none or 0, 1: well known, 2: registered, 3: dynamic."""
    p = _c(port)
    return F.when(p.isNull() | (p <= 0), 0).when(p < 1024, 1).when(p < 49152, 2).otherwise(3)


def ipv4_number(ip: str | Column) -> Column:
    """A dotted address as a number; null for others."""
    part = F.split(_c(ip), r"\.")
    number = sum((F.try_element_at(part, F.lit(i + 1)).try_cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(_c(ip).rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), number)


def ip_hex(ip: str | Column) -> Column:
    """4 or 16 address bytes as hexadecimal digits."""
    c = _c(ip)
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
    digits = lambda a: F.array_join(F.transform(a, lambda g: F.lpad(g, 4, "0")), "")
    zeros = lambda two: F.repeat(F.lit("0"), F.greatest(F.lit(32) - 4 * (F.size(two["left"]) + F.size(two["right"])), F.lit(0)))
    halves = F.split(c, "::")
    sides = F.struct(groups(F.try_element_at(halves, F.lit(1))).alias("left"), groups(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit(""))).alias("right"))
    six = let(sides, lambda two: F.upper(F.concat(digits(two["left"]), zeros(two), digits(two["right"]))))
    return F.when(c.isNull(), F.lit(None).cast("string")).when(c.contains(":"), six).otherwise(F.lpad(F.hex(ipv4_number(c)), 8, "0"))


def in_networks(ip: str | Column, networks: tuple[str, ...] = INTERNAL) -> Column:
    """If an address lies in one of the networks (both families): prefixes of its digits are compared, in plain expressions."""

    def inside(digits: Column) -> Column:
        out = F.lit(False)
        for n in map(ipaddress.ip_network, networks):
            low, high = (f"{int(a):0{n.max_prefixlen // 4}X}" for a in (n.network_address, n.broadcast_address))
            out = out | ((F.length(digits) == len(low)) & (digits >= low) & (digits <= high))
        return out

    return let(ip_hex(ip), inside)


def direction(src_inside: Column, dst_inside: Column) -> Column:
    return F.when(src_inside & dst_inside, "internal").when(src_inside, "outbound").when(dst_inside, "inbound").otherwise("external")


def egress_bytes(way: Column, forward: Column, reverse: Column) -> Column:
    """Bytes from inside to outside, whichever half of the flow carried them."""
    return F.when(way == "outbound", forward).when(way == "inbound", reverse).otherwise(F.lit(0))


def byte_ratio(way: Column, forward: Column, reverse: Column) -> Column:
    """Out over in; null unless the flow crosses the boundary. Whether it is available at all: both halves were seen."""
    return F.when(way == "outbound", F.try_divide(forward, reverse)).when(way == "inbound", F.try_divide(reverse, forward))


def protocol_number(protocol: str | Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in PROTOCOLS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, _c(protocol)), F.regexp_extract(_c(protocol), r"^OTHER_(\d+)$", 1).try_cast("int"), F.lit(0))


def community_id(protocol: str, src_ip: str, dst_ip: str, src_port: str, dst_port: str, seed: int = 0) -> Column:
    """Community ID v1: the same for both directions. Of ICMP flows the ports are type and code."""
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    two = lambda v: F.lpad(F.hex(v.cast("long")), 4, "0")
    sport = F.coalesce(F.col(src_port), F.lit(0)).cast("int")
    base = F.struct(protocol_number(protocol).cast("int").alias("p"), ip_hex(src_ip).alias("a"), ip_hex(dst_ip).alias("b"), sport.alias("s"), F.coalesce(F.col(dst_port), F.lit(0)).cast("int").alias("d"))

    def turned(x: Column) -> Column:
        answer = F.when(x["p"] == 1, F.try_element_at(pairs(ICMP_PAIRS), x["s"])).when(x["p"] == 58, F.try_element_at(pairs(ICMP6_PAIRS), x["s"]))
        return F.struct(x["p"].alias("p"), x["a"].alias("a"), x["b"].alias("b"), x["s"].alias("s"), F.coalesce(answer, x["d"]).alias("d"), (x["p"].isin(1, 58) & answer.isNull()).alias("one_way"))

    def ordered(x: Column) -> Column:
        swap = ~x["one_way"] & ((x["a"] > x["b"]) | ((x["a"] == x["b"]) & (x["s"] > x["d"])))
        return F.struct(x["p"].alias("p"), F.when(swap, x["b"]).otherwise(x["a"]).alias("a"), F.when(swap, x["a"]).otherwise(x["b"]).alias("b"), F.when(swap, x["d"]).otherwise(x["s"]).alias("s"), F.when(swap, x["s"]).otherwise(x["d"]).alias("d"))

    def text(x: Column) -> Column:
        ports = F.when(x["p"].isin(1, 6, 17, 58, 132), F.concat(two(x["s"]), two(x["d"]))).otherwise("")
        return F.concat(F.lit(f"{seed:04X}"), x["a"], x["b"], F.lpad(F.hex(x["p"].cast("long")), 2, "0"), F.lit("00"), ports)

    return F.concat(F.lit("1:"), F.base64(F.unhex(F.sha1(F.unhex(let(let(let(base, turned), ordered), text))))))


def off_hours(ts: Column, offset_minutes: int = 330, opens: int = 9, closes: int = 18) -> Column:
    """If a time without zone (UTC) is outside Monday to Friday, opens to closes, in local time."""
    local = ts + F.expr(f"INTERVAL '{offset_minutes}' MINUTE")
    return (F.weekday(local) > 4) | (F.hour(local) < opens) | (F.hour(local) >= closes)
