import pytest
from pyspark.sql import functions as F

from flowloom.functions import network, text
from flowloom.operators import fastlane, flows
from flowloom.sources import pcap
from tests import captures as c


def packets(spark, tmp_path, content, name="x.pcap"):
    (tmp_path / name).write_bytes(content)
    return pcap.read_captures(spark, str(tmp_path))


def test_formats_agree(spark, tmp_path):
    rows = [(100.25, c.tcp("10.0.0.1", "8.8.8.8", 5000, 80, 2)), (101.5, c.udp("10.0.0.1", "10.0.0.2", 4000, 53, c.dns("a.b.example"))), (102.0, b"short")]
    for i, content in enumerate((c.classic(rows), c.classic(rows, nano=True), c.classic(rows, big=True), c.next_generation(rows))):
        d = tmp_path / str(i)
        d.mkdir()
        got = packets(spark, d, content).orderBy("seq").collect()
        assert [r.ts for r in got] == [100.25, 101.5, 102.0]
        assert (got[0].src_ip, got[0].dst_port, got[0].tcp_flags, got[0].protocol) == ("10.0.0.1", 80, 2, "TCP")
        assert (got[1].dns_query_name, got[1].dns_query_type, got[1].dns_is_response, got[1].dns_rcode) == ("a.b.example", 1, False, None)
        assert got[2].src_ip is None and got[2].captured_len == 5


def test_cut_and_unknown_files(spark, tmp_path):
    rows = [(1.0, c.icmp("10.0.0.1", "10.0.0.2", 8)), (2.0, c.icmp("10.0.0.1", "10.0.0.2", 8))]
    assert packets(spark, tmp_path, c.classic(rows, cut=3)).count() == 1
    (tmp_path / "y.pcap").write_bytes(b"not a capture")
    (tmp_path / "z.pcap").write_bytes(b"")
    assert pcap.read_captures(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception):
        pcap.read_captures(spark, str(tmp_path / "none")).count()


def test_hello_fingerprints(spark, tmp_path):
    payload = c.client_hello()
    got = packets(spark, tmp_path, c.classic([(1.0, c.tcp("10.0.0.1", "1.1.1.1", 5000, 443, 24, payload)), (2.0, c.tcp("10.0.0.1", "1.1.1.1", 5000, 443, 24, payload[:60]))])).orderBy("seq").collect()
    h = pcap.hello(payload)
    assert h["sni"] == got[0].tls_sni == "a.example" and got[0].tls_version == "TLS 1.3"
    assert got[0].tls_ja4.startswith("t13d0306h2_") and len(got[0].tls_ja3) == 32
    assert got[1].tls_sni is None and got[1].tls_ja3 is not None
    # the column functions give what the decoder gives
    row = spark.createDataFrame([(h["version"], h["ciphers"], h["extensions"], h["groups"], h["formats"], h["signatures"], h["sni"], h["alpn"], 0x0304)], "v int, c array<int>, e array<int>, g array<int>, f array<int>, s array<int>, sni string, alpn string, best int")
    made = row.select(text.ja3("v", "c", "e", "g", "f").alias("ja3"), text.ja4("best", "alpn", "c", "e", "s").alias("ja4")).first()
    assert (made.ja3, made.ja4) == (got[0].tls_ja3, got[0].tls_ja4)


def test_hello_ends_with_its_record():
    """What follows in the segment is no extension of it; cut lists and broken bodies do as the format says."""
    whole = c.client_hello()
    more = whole + b"\x14\x03\x03\x00\x01\x01" + b"\x17\x03\x03\x00\x20" + bytes(range(32))
    assert pcap.hello(more) == pcap.hello(whole) and pcap.fingerprints(pcap.hello(more)) == pcap.fingerprints(pcap.hello(whole))
    # bytes behind the block of extensions, within the record
    longer = whole[:3] + (len(whole) - 5 + 9).to_bytes(2, "big") + whole[5:] + b"\x00\x17\x00\x01\x00\x00\x17\x00\x00"
    assert pcap.hello(longer) == pcap.hello(whole)
    cut = pcap.hello(whole[:50])
    assert cut["ciphers"] == [] and cut["extensions"] == [] and cut["version"] == 0x0303
    assert pcap.hello(whole[:20])["ciphers"] == [] and pcap.hello(b"\x17" + whole[1:]) is None and pcap.hello(b"") is None
    server = b"\x02\x00\x00\x2e" + b"\x03\x03" + bytes(32) + b"\x00" + b"\x13\x01\x00" + b"\x00\x06" + b"\x00\x2b\x00\x02\x03\x04"
    record = b"\x16\x03\x03" + len(server).to_bytes(2, "big") + server
    h = pcap.hello(record + b"\x14\x03\x03\x00\x01\x01\x17\x03\x03\x00\x04abcd")
    assert (h["ciphers"], h["extensions"], h["supported"]) == ([0x1301], [43], [0x0304])
    assert pcap.fingerprints(h)["tls_ja3s"] == __import__("hashlib").md5(b"771,4865,43").hexdigest()


def test_published_ja4():
    """The worked example of the published JA4 description."""
    ciphers = [0x0A0A, 0x1301, 0x1302, 0x1303, 0xC02B, 0xC02F, 0xC02C, 0xC030, 0xCCA9, 0xCCA8, 0xC013, 0xC014, 0x009C, 0x009D, 0x002F, 0x0035]
    extensions = [0x1A1A, 0x001B, 0x0000, 0x0033, 0x0010, 0x4469, 0x0017, 0x002D, 0x000D, 0x0005, 0x0023, 0x0012, 0x002B, 0xFF01, 0x000B, 0x000A, 0x0015]
    h = {"client": True, "version": 0x0303, "ciphers": ciphers, "extensions": extensions, "groups": [], "formats": [], "signatures": [0x0403, 0x0804, 0x0401, 0x0503, 0x0805, 0x0501, 0x0806, 0x0601], "alpn": "h2", "sni": "x", "supported": [0x0A0A, 0x0304, 0x0303]}
    assert pcap.fingerprints(h)["tls_ja4"] == "t13d1516h2_8daaf6152771_e5627efa2ab1"
    assert pcap.fingerprints(h | {"alpn": "\xab\xcd", "extensions": extensions[:2]})["tls_ja4"].startswith("t13i1501ad_")


def test_large_files_are_read_in_parts(spark, tmp_path):
    rows = [(float(i), c.udp("10.0.0.1", f"10.0.{i // 200}.{i % 200}", 9, 53, c.dns(f"n{i}.example"))) for i in range(500)]
    (tmp_path / "a.pcap").write_bytes(c.classic(rows, cut=3))
    (tmp_path / "b.pcapng").write_bytes(c.next_generation(rows[:300]))
    (tmp_path / "c.pcap").write_bytes(c.classic(rows[:3]))
    (tmp_path / "d.pcap").write_bytes(b"not a capture" * 1000)
    columns = ["file", "seq", "ts", "src_ip", "dst_ip", "dns_query_name", "packet_len"]
    whole = pcap.read_captures(spark, str(tmp_path)).select(columns)
    parts = pcap.read_captures(spark, str(tmp_path), whole=2000, part=4000).select(columns)
    assert whole.count() == 499 + 300 + 3
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


#: Published Community ID vectors, seed 0.
VECTORS = [
    ("TCP", "128.232.110.120", "66.35.250.204", 34855, 80, "1:LQU9qZlK+B5F3KDmev6m5PMibrg="),
    ("TCP", "10.0.0.1", "10.0.0.2", 10, 11569, "1:SXBGMX1lBOwhhoDrZynfROxnhnM="),
    ("UDP", "192.168.1.52", "8.8.8.8", 54585, 53, "1:d/FP5EW3wiY1vCndhwleRRKHowQ="),
    ("ICMP", "192.168.0.89", "192.168.0.1", 8, 0, "1:X0snYXpgwiv9TZtqg64sgzUn6Dk="),
    ("ICMP", "192.168.0.89", "192.168.0.1", 20, 1, "1:tz/fHIDUHs19NkixVVoOZywde+I="),
    ("ICMPv6", "fe80::200:86ff:fe05:80da", "fe80::260:97ff:fe07:69ea", 135, 0, "1:dGHyGvjMfljg6Bppwm3bg0LO8TY="),
    ("ICMPv6", "3ffe:507:0:1:200:86ff:fe05:80da", "3ffe:507:0:1:260:97ff:fe07:69ea", 3, 0, "1:/OGBt9BN1ofenrmSPWYicpij2Vc="),
]


def test_community_id(spark):
    df = spark.createDataFrame([v[:5] for v in VECTORS], "p string, s string, d string, sp int, dp int")
    assert [r[0] for r in df.select(network.community_id("p", "s", "d", "sp", "dp")).collect()] == [v[5] for v in VECTORS]
    back = df.filter("p in ('TCP', 'UDP')").select(network.community_id("p", "d", "s", "dp", "sp"))
    assert [r[0] for r in back.collect()] == [v[5] for v in VECTORS[:3]]


def test_community_id_seed_1(spark):
    df = spark.createDataFrame([("TCP", "128.232.110.120", "66.35.250.204", 34855, 80)], "p string, s string, d string, sp int, dp int")
    import base64
    import hashlib
    import ipaddress
    import struct

    ends = [ipaddress.ip_address(x).packed for x in ("66.35.250.204", "128.232.110.120")]  # the smaller end first
    plain = struct.pack("!H4s4sBBHH", 1, *ends, 6, 0, 80, 34855)
    assert df.select(network.community_id("p", "s", "d", "sp", "dp", seed=1)).first()[0] == "1:" + base64.b64encode(hashlib.sha1(plain).digest()).decode()


def test_networks(spark):
    df = spark.createDataFrame([("10.1.2.3",), ("172.32.0.1",), ("172.31.0.1",), ("fd00::1",), ("2001:db8::1",), (None,), ("junk",)], "ip string")
    assert [r[0] for r in df.select(F.coalesce(network.in_networks("ip"), F.lit(False))).collect()] == [True, False, True, True, False, False, False]


def capture(spark, tmp_path, rows):
    return packets(spark, tmp_path, c.classic(sorted(rows, key=lambda r: r[0])))


def test_flow_assembly(spark, tmp_path):
    a, b = "10.0.0.1", "10.0.0.2"
    rows = [(0.0, c.tcp(a, b, 1000, 80, 2)), (1.0, c.tcp(b, a, 80, 1000, 18)), (10.0, c.tcp(a, b, 1000, 80, 16)), (25.0, c.tcp(b, a, 80, 1000, 17)), (30.0, c.tcp(a, b, 1000, 80, 16)), (40.0, c.tcp(a, b, 1000, 80, 16)), (50.0, c.tcp(a, b, 1000, 80, 16)), (60.0, c.tcp(a, b, 1000, 80, 16)), (71.0, c.tcp(a, b, 1000, 80, 16)), (84.0, c.tcp(a, b, 1000, 80, 16)), (86.0, c.tcp(a, b, 1000, 80, 16))]
    got = flows.assemble_capture(capture(spark, tmp_path, rows)).orderBy("start_time").collect()
    assert [(f.start_time, f.last_time, f.packet_count) for f in got] == [(0.0, 10.0, 3), (25.0, 84.0, 7), (86.0, 86.0, 1)]
    first, second, third = got
    assert (first.src_ip, first.observability_state, first.rev_packets, first.fwd_is_responder, first.reverse_seen) == (a, "bidirectional", 1, False, True)
    assert (first.syn_ts, first.synack_ts, first.synack_rev, first.iats) == (0.0, 1.0, True, [1.0, 9.0])
    # a gap of exactly the idle time ends a flow, the next one is oriented by its own first packet; age keeps the orientation
    assert second.src_ip == b and third.src_ip == b and third.rev_packets == 1


def test_four_part_key_and_late_packets(spark, tmp_path):
    rows = [(100.0, c.udp("10.0.0.1", "10.0.0.2", 1001, 99)), (101.0, c.udp("10.0.0.1", "10.0.0.2", 1002, 99))]
    p = packets(spark, tmp_path, c.classic(rows))
    assert flows.assemble_capture(p).count() == 2
    assert flows.assemble_capture(p, with_source_port=False).count() == 1
    d = tmp_path / "late"
    d.mkdir()
    late = packets(spark, d, c.classic([(ts, c.udp("10.0.0.1", "10.0.0.2", 1, 2)) for ts in (100.0, 95.0, 105.0)]))
    f = flows.assemble_capture(late).first()
    assert (f.start_time, f.last_time, f.iats) == (95.0, 105.0, [0.0, 5.0])


def test_one_way_shards_facts(spark, tmp_path):
    p = packets(spark, tmp_path, c.classic([(1.0, c.udp("10.0.0.1", "8.8.8.8", 9, 9)), (2.0, c.udp("8.8.8.8", "10.0.0.1", 9, 9)), (4.0, c.udp("10.0.0.1", "10.0.0.3", 9, 9))]))
    assert (pcap.one_way(p, "IN").count(), pcap.one_way(p, "OUT").count()) == (1, 1)
    shards = {r.seq: r.shard for r in pcap.shard(p, 16).collect()}
    assert shards[0] == shards[1]
    f = pcap.capture_facts(p).first()
    assert (f.packets, f.span, f.truncated) == (3, 3.0, 0)


def test_fast_lane_attacks(spark, tmp_path):
    flood = [(10.0 + i / 1000, c.tcp(f"20.0.{i // 200}.{i % 200}", "10.50.0.10", 1000 + i, 80, 2)) for i in range(100)]
    crowd = [(20.0 + i / 1000 + k / 2, c.tcp(f"30.0.0.{i}", "10.50.0.10", 1000, 80, 2 if k == 0 else 16)) for i in range(100) for k in (0, 1)]
    p = capture(spark, tmp_path, flood + crowd).withColumns({"src": F.col("src_ip"), "dst": F.col("dst_ip")})
    got = fastlane.per_destination(p, 1.0, "tcp_flags & 18 = 2", "tcp_flags & 16 <> 0", "tcp_flags & 18 = 2")
    assert [(r.w, r.syn_srcs, r.syn_only_share) for r in got.orderBy("w").collect()] == [(10, 100, 1.0), (20, 100, 0.0)]
    assert [r.w for r in fastlane.fast_rules(got).collect()] == [10]
