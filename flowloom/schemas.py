"""Canonical schemas of packets and flows."""

PACKETS = """seq long, ts double, captured_len int, packet_len int, ip_version int, src_ip string, dst_ip string, protocol string, ttl int,
src_port int, dst_port int, tcp_flags int, tcp_seq long, tcp_ack long, icmp_type int, icmp_code int, dns_query_name string,
dns_query_type int, dns_is_response boolean, dns_rcode int, tls_version string, tls_sni string, tls_cipher_suites array<int>,
tls_ja3 string, tls_ja4 string, tls_ja3s string""".replace("\n", " ")

#: Columns that a packet table must have for flow assembly; others may be absent.
FLOW_INPUT = ("seq", "ts", "src_ip", "dst_ip", "protocol", "src_port", "dst_port", "packet_len")
