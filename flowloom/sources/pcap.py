"""Capture files as a packet table: classic and next-generation formats, decoded in Arrow batches.

Decoding never fails on a packet: what cannot be read stays null.
"""

from __future__ import annotations

import hashlib
import ipaddress
import json
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.schemas import PACKETS

#: Magic numbers of classic captures, with byte order and time unit; block types; protocol numbers.
CLASSIC = {b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\x3c\x4d": (">", 1e9), b"\x4d\x3c\xb2\xa1": ("<", 1e9)}
SECTION, INTERFACE, OLD_PACKET, PACKET = 0x0A0D0D0A, 1, 2, 6
ETHERNET_IP = {0x0800: 4, 0x86DD: 6}
PROTOCOL_NAMES = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMPv6"}
TLS_VERSIONS = {0x0300: "SSLv3", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}


def start_state(head: bytes) -> dict | None:
    """How to read a file that begins with these bytes (24 at least), and where its first record or block is; None if it is unknown."""
    if head[:4] in CLASSIC and len(head) >= 24:
        order, unit = CLASSIC[head[:4]]
        return {"kind": "classic", "order": order, "unit": unit, "at": 24}
    if head[:4] == struct.pack("<I", SECTION):
        return {"kind": "blocks", "order": "<", "units": [], "at": 0}
    return None


def records(data: bytes, state: dict | None = None) -> Iterator[tuple[float, bytes, int]]:
    """time, bytes and wire length of each packet; ends silently at a cut record; nothing of an unknown file. state: of a part of a
    file, as split_points() gives it; data then begins at the part."""
    state = dict(state, at=0) if state else start_state(data[:24])
    if state is None:
        return
    if state["kind"] == "blocks":
        yield from _blocks(data, state)
        return
    at, head, unit = state["at"], struct.Struct(state["order"] + "IIII"), state["unit"]
    while at + 16 <= len(data):
        sec, frac, size, wire = head.unpack_from(data, at)
        if at + 16 + size > len(data):
            return
        yield sec + frac / unit, data[at + 16 : at + 16 + size], wire
        at += 16 + size


def _interface(body: bytes, order: str) -> tuple[float, int]:
    """Time unit and offset of an interface block."""
    unit, offset, o = 1e6, 0, 8
    while o + 4 <= len(body):
        code, n = struct.unpack_from(order + "HH", body, o)
        if code == 0:
            break
        if code == 9 and n:
            unit = float(2 ** (body[o + 4] & 0x7F)) if body[o + 4] & 0x80 else float(10 ** body[o + 4])
        if code == 14 and n == 8:
            offset = struct.unpack_from(order + "q", body, o + 4)[0]
        o += 4 + n + (-n % 4)
    return unit, offset


def _blocks(data: bytes, state: dict) -> Iterator[tuple[float, bytes, int]]:
    at, order, units = state["at"], state["order"], [tuple(u) for u in state["units"]]
    while at + 12 <= len(data):
        if data[at : at + 4] == struct.pack("<I", SECTION):
            order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            units = []
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12 or at + size > len(data):
            return
        body = data[at + 8 : at + size - 4]
        if kind == INTERFACE:
            units.append(_interface(body, order))
        elif kind in (PACKET, OLD_PACKET) and len(body) >= 20:
            if kind == PACKET:
                face, high, low, got, wire = struct.unpack_from(order + "IIIII", body)
            else:
                face, _, high, low, got, wire = struct.unpack_from(order + "HHIIII", body)
            unit, offset = units[face] if face < len(units) else (1e6, 0)
            if 20 + got <= len(body):
                yield offset + ((high << 32) | low) / unit, body[20 : 20 + got], wire
        at += size


def split_points(f: BinaryIO, size: int, every: int) -> Iterator[tuple[int, dict]]:
    """Offsets at which a file may be cut, about `every` bytes apart, with the state that reading from there on takes. Only the heads
    of records are read, and the bodies of blocks that tell how to read others."""
    state = start_state(f.read(24))
    if state is None:
        return
    at = last = state["at"]
    yield at, state
    small = 16 if state["kind"] == "classic" else 12
    while at + small <= size:
        f.seek(at)
        head = f.read(small)
        if state["kind"] == "classic":
            n = 16 + struct.unpack(state["order"] + "IIII", head)[2]
        else:
            if head[:4] == struct.pack("<I", SECTION):
                state = {"kind": "blocks", "order": "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">", "units": [], "at": 0}
            kind, n = struct.unpack(state["order"] + "II", head[:8])
            if n < 12:
                return
            if kind == INTERFACE:
                f.seek(at + 8)
                state = state | {"units": [*state["units"], _interface(f.read(n - 12), state["order"])]}
        at += n
        if at - last >= every and at < size:
            last = at
            yield at, state


def network_layer(data: bytes) -> bytes | None:
    """The IP packet within a frame: Ethernet (tagged or not), cooked Linux, or none around it."""
    at, kind = 12, None
    if len(data) >= 14:
        kind = int.from_bytes(data[12:14], "big")
        while kind in (0x8100, 0x88A8) and len(data) >= at + 6:
            at += 4
            kind = int.from_bytes(data[at : at + 2], "big")
        if kind in ETHERNET_IP and len(data) > at + 2 and data[at + 2] >> 4 == ETHERNET_IP[kind]:
            return data[at + 2 :]
    if len(data) >= 17 and (kind := int.from_bytes(data[14:16], "big")) in ETHERNET_IP and data[16] >> 4 == ETHERNET_IP[kind]:
        return data[16:]
    if len(data) >= 20 and data[0] >> 4 == 4 and data[0] & 15 >= 5 or len(data) >= 40 and data[0] >> 4 == 6:
        return data
    return None


def dns_question(data: bytes) -> dict:
    """Name and type of the first question, if it is an answer and with which code; a cut message gives what could be read."""
    out: dict = {}
    if len(data) < 12:
        return out
    flags, questions = struct.unpack_from(">HH", data, 2)
    out["dns_is_response"] = bool(flags & 0x8000)
    if flags & 0x8000:
        out["dns_rcode"] = flags & 15
    labels, at = [], 12
    while questions and at < len(data) and data[at]:
        n = data[at]
        if n & 0xC0 or at + 1 + n > len(data):
            return out
        labels.append(data[at + 1 : at + 1 + n].decode("ascii", "replace"))
        at += 1 + n
    if labels and at + 5 <= len(data):
        out["dns_query_name"], out["dns_query_type"] = ".".join(labels).lower(), int.from_bytes(data[at + 1 : at + 3], "big")
    return out


class _Cut(Exception):
    pass


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if self.left() < n:
            raise _Cut
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def upto(self, n: int) -> bytes:
        """n bytes, or what is there."""
        return self.take(min(n, self.left()))


def _numbers(part: bytes, each: int = 2) -> list[int]:
    return [int.from_bytes(part[i : i + each], "big") for i in range(0, len(part) - each + 1, each)]


def grease(v: int) -> bool:
    return v & 0x0F0F == 0x0A0A and v >> 8 == v & 0xFF


def _extension(h: dict, kind: int, body: _Reader) -> None:
    """What one extension says; lists that say to be longer than they are give what is there."""
    if kind == 0 and body.left() >= 5:
        body.take(2)
        if body.number(1) == 0:
            name = body.upto(body.number(2))
            h["sni"] = name.decode("ascii") if name.isascii() else h["sni"]
    elif kind == 10:
        h["groups"] = _numbers(body.upto(body.number(2)))
    elif kind == 11:
        h["formats"] = _numbers(body.upto(body.number(1)), 1)
    elif kind == 13:
        h["signatures"] = _numbers(body.upto(body.number(2)))
    elif kind == 16:
        names = _Reader(body.upto(body.number(2)))
        h["alpn"] = names.upto(names.number(1)).decode("latin-1")
    elif kind == 43:
        h["supported"] = _numbers(body.upto(body.number(1) if h["client"] else 2))


def hello(payload: bytes) -> dict | None:
    """What a client's or server's hello says, as far as it was captured; None for other payloads. The hello ends with its record,
    its extensions with their block, whatever follows in the segment. A list of ciphers that is cut is not taken, and nor is what
    would come after it; an extension with a body that makes no sense is listed, and the next ones are read."""
    if len(payload) < 9 or payload[0] != 22:
        return None
    message = payload[5 : 5 + int.from_bytes(payload[3:5], "big")]
    if len(message) < 6 or message[0] not in (1, 2):
        return None
    h: dict = {"client": message[0] == 1, "version": int.from_bytes(message[4:6], "big"), "ciphers": [], "extensions": [], "groups": [], "formats": [], "signatures": [], "alpn": None, "sni": None, "supported": []}
    r = _Reader(message[6:])
    try:
        r.take(32)
        r.take(r.number(1))
        h["ciphers"] = _numbers(r.take(r.number(2) if h["client"] else 2))
        r.take(r.number(1) if h["client"] else 1)
        block = _Reader(r.upto(r.number(2)))
        while block.left() >= 4:
            kind, size = block.number(2), block.number(2)
            h["extensions"].append(kind)
            body = _Reader(block.take(size))
            try:
                _extension(h, kind, body)
            except _Cut:
                pass
    except _Cut:
        pass
    return h


def _dashes(values: list[int]) -> str:
    return "-".join(str(v) for v in values if not grease(v))


def fingerprints(h: dict) -> dict:
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    best = max((v for v in h["supported"] if not grease(v)), default=h["version"])
    out = {"tls_version": TLS_VERSIONS.get(best, f"0x{best:04x}" if best is not None else None), "tls_sni": h["sni"]}
    if not h["client"]:
        return out | {"tls_ja3s": md5(f"{h['version']},{_dashes(h['ciphers'])},{_dashes(h['extensions'])}")}
    ja3 = ",".join([str(h["version"]), *(_dashes(h[k]) for k in ("ciphers", "extensions", "groups")), "-".join(map(str, h["formats"]))])
    own, ext = ([v for v in h[k] if not grease(v)] for k in ("ciphers", "extensions"))
    alpn = h["alpn"] or ""
    if alpn and not (alpn[0].isascii() and alpn[0].isalnum() and alpn[-1].isascii() and alpn[-1].isalnum()):
        alpn = alpn.encode("latin-1").hex()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()[:12] if s else "0" * 12
    listed = lambda v: ",".join(f"{x:04x}" for x in v)
    kept = listed(sorted(v for v in ext if v not in (0, 16)))
    signs = listed([v for v in h["signatures"] if not grease(v)])
    version = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3"}.get(best, "00")
    head = f"t{version}{'d' if 0 in ext else 'i'}{min(99, len(own)):02d}{min(99, len(ext)):02d}{alpn[0] + alpn[-1] if alpn else '00'}"
    return out | {"tls_ja3": md5(ja3), "tls_ja4": f"{head}_{sha(listed(sorted(own)))}_{sha(kept + ('_' + signs if signs else '')) if kept else '0' * 12}", "tls_cipher_suites": h["ciphers"]}


def decode(ts: float, data: bytes, wire: int) -> dict:
    """One packet as a row; an unreadable one has its time and lengths only."""
    row: dict = {"ts": ts, "captured_len": len(data), "packet_len": max(wire, len(data))}
    ip = network_layer(data)
    if ip is None:
        return row
    try:
        if ip[0] >> 4 == 4:
            number, body = ip[9], ip[(ip[0] & 15) * 4 : int.from_bytes(ip[2:4], "big") or None]
            row |= {"ip_version": 4, "ttl": ip[8], "src_ip": str(ipaddress.IPv4Address(ip[12:16])), "dst_ip": str(ipaddress.IPv4Address(ip[16:20]))}
            later = int.from_bytes(ip[6:8], "big") & 0x1FFF
        else:
            number, body, later = ip[6], ip[40:], 0
            row |= {"ip_version": 6, "ttl": ip[7], "src_ip": str(ipaddress.IPv6Address(ip[8:24])), "dst_ip": str(ipaddress.IPv6Address(ip[24:40]))}
            while number in (0, 43, 60) and len(body) >= 8:
                number, body = body[0], body[8 * (1 + body[1]) :]
        row["protocol"] = PROTOCOL_NAMES.get(number, f"OTHER_{number}")
        if later:
            return row
        if number == 6 and len(body) >= 20:
            sport, dport, seq, ack = struct.unpack_from(">HHII", body)
            row |= {"src_port": sport, "dst_port": dport, "tcp_seq": seq, "tcp_ack": ack, "tcp_flags": body[13]}
            if h := hello(body[(body[12] >> 4) * 4 :]):
                row |= fingerprints(h)
        elif number == 17 and len(body) >= 8:
            sport, dport = struct.unpack_from(">HH", body)
            row |= {"src_port": sport, "dst_port": dport}
            if 53 in (sport, dport):
                row |= dns_question(body[8:])
        elif number in (1, 58) and len(body) >= 2:
            row |= {"icmp_type": body[0], "icmp_code": body[1]}
    except (IndexError, struct.error, ValueError):
        pass
    return row


#: Files up to this size come whole through Spark, from any of its stores; larger ones are read in parts of about PART.
WHOLE, PART = 256 << 20, 64 << 20


def read_captures(spark: SparkSession, path: str, whole: int = WHOLE, part: int = PART) -> DataFrame:
    """The packets of all capture files under path, as schemas.PACKETS and file. seq goes on over files in order of their paths.

    A missing path is an error, an unknown format gives no rows. A file of up to `whole` bytes is one task's work. Of a larger one a
    task first looks for places where it can be cut, and each part is then decoded for itself; such files are opened by their
    address through pyarrow, which has to reach their store. Packets are decoded once, into a table in the shared folder.
    """
    from pyspark.sql.types import _parse_datatype_string

    from flowloom.staging import staged

    struct_ = _parse_datatype_string("file string, part long, place long, " + PACKETS.replace("seq long, ", ""))
    names = [f.name for f in struct_.fields]

    def made(rows: list[dict]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(struct_)
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], schema.field(n).type) for n in names], schema=schema)

    def decoded(file: str, at: int, found: Iterator[tuple[float, bytes, int]]) -> Iterator[pa.RecordBatch]:
        rows = []
        for i, (ts, data, wire) in enumerate(found):
            rows.append(decode(ts, data, wire) | {"file": file, "part": at, "place": i})
            if len(rows) == 10_000:
                yield made(rows)
                rows = []
        yield made(rows)

    def whole_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from decoded(file, 0, records(content.as_py() or b""))

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _opened(file) as f:
                    points = list(split_points(f, size, part))
                ends = [*[at for at, _ in points[1:]], size]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(points), pa.string()), pa.array([at for at, _ in points], pa.int64()), pa.array(ends[: len(points)], pa.int64()), pa.array([json.dumps(s) for _, s in points], pa.string())], names=["file", "begin", "end", "state"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, begin, end, state in zip(*(c.to_pylist() for c in batch.columns)):
                with _opened(file) as f:
                    f.seek(begin)
                    data = f.read(end - begin)
                yield from decoded(file, begin, records(data, json.loads(state)))

    listed = spark.read.format("binaryFile").load(path)
    small = listed.filter(F.col("length") <= whole).select("path", "content").mapInArrow(whole_files, struct_)
    large = listed.filter(F.col("length") > whole).select("path", "length")
    places = staged(large.mapInArrow(cuts, "file string, begin long, end long, state string"), "capture-parts")
    # a part is a row; each is dealt to a task of its own
    n = max(1, places.count())
    packets = staged(small.unionByName(places.repartition(n, "file", "begin").mapInArrow(parts, struct_)), "packets")
    # places within a part are counted; a part's first number is what the files and parts before it hold
    counts = packets.groupBy("file", "part").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql.window import Window

    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("file", "part", "before")
    return packets.join(before, ["file", "part"]).withColumn("seq", F.col("before") + F.col("place")).select("file", "seq", *[n for n in names if n not in ("file", "part", "place")])


def _opened(file: str) -> BinaryIO:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(file if "://" in file else "file://" + file.removeprefix("file:"))
    return store.open_input_file(name)


def frame(src: str, dst: str, protocol: str, sport: int, dport: int, flags: int, size: int) -> bytes:
    """An Ethernet frame of `size` bytes at least, with zeros behind the headers: TCP, UDP, or else ICMP (type and code as ports)."""
    a, b = ipaddress.ip_address(src), ipaddress.ip_address(dst)
    number = {"TCP": 6, "UDP": 17}.get(protocol, 1 if a.version == 4 else 58)
    network = 20 if a.version == 4 else 40
    head = {6: 20, 17: 8}.get(number, 4)
    more = bytes(max(0, size - 14 - network - head))
    if number == 6:
        body = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0) + more
    elif number == 17:
        body = struct.pack(">HHHH", sport, dport, 8 + len(more), 0) + more
    else:
        body = struct.pack(">BBH", sport & 255, dport & 255, 0) + more
    if a.version == 4:
        ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, number, 0, a.packed, b.packed)
    else:
        ip = struct.pack(">IHBB16s16s", 0x60000000, len(body), number, 64, a.packed, b.packed)
    return b"\x02" * 12 + (b"\x08\x00" if a.version == 4 else b"\x86\xdd") + ip + body


def write_captures(packets: DataFrame, path: str) -> int:
    """Write packets (seq, ts, src_ip, dst_ip, protocol, src_port, dst_port, tcp_flags, packet_len) as classic captures under path, in
    order of seq over the files, and return how many. Each task writes a file through pyarrow, which has to reach the store; a task
    that runs again writes the same file again. Rows without an address are left out; null ports and flags are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = 0
        with _created(f"{path}/part-{TaskContext.get().partitionId():06d}.pcap") as f:
            f.write(struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 18, 1))
            for batch in batches:
                for ts, src, dst, protocol, sport, dport, flags, size in zip(*(c.to_pylist() for c in batch.columns)):
                    data, micros = frame(src, dst, protocol, sport or 0, dport or 0, flags or 0, int(size or 0)), round(ts * 1e6)
                    f.write(struct.pack("<IIII", micros // 1_000_000, micros % 1_000_000, len(data), len(data)) + data)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = packets.filter("src_ip is not null and dst_ip is not null").repartitionByRange("seq").sortWithinPartitions("seq")
    return rows.select("ts", "src_ip", "dst_ip", "protocol", "src_port", "dst_port", "tcp_flags", "packet_len").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _created(file: str) -> BinaryIO:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(file if "://" in file else "file://" + file.removeprefix("file:"))
    store.create_dir(name.rsplit("/", 1)[0])
    return store.open_output_stream(name)


def capture_facts(packets: DataFrame) -> DataFrame:
    return packets.agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("packet_len").cast("long")).alias("wire_bytes"), F.count_if(F.col("captured_len") < F.col("packet_len")).alias("truncated"), (F.max("ts") - F.min("ts")).alias("span"))


def one_way(packets: DataFrame, way: str) -> DataFrame:
    """Packets of one direction over the boundary: IN from outside to inside, OUT from inside to outside."""
    from flowloom.functions.network import in_networks

    src, dst = in_networks("src_ip"), in_networks("dst_ip")
    if way not in ("IN", "OUT"):
        raise ValueError("way is IN or OUT")
    return packets.filter(~src & dst if way == "IN" else src & ~dst)


def shard(packets: DataFrame, n: int, by: str = "five") -> DataFrame:
    """With shard: both directions of a flow (or, by pair, of two hosts) fall into one."""
    ends = [F.concat_ws("|", F.col(f"{s}_ip"), *([F.coalesce(F.col(f"{s}_port"), F.lit(0)).cast("string")] if by == "five" else [])) for s in ("src", "dst")]
    return packets.withColumn("shard", F.pmod(F.xxhash64(F.least(*ends), F.greatest(*ends), *(["protocol"] if by == "five" else [])), F.lit(n)))
