"""Small capture files made from scratch: frames, sessions, names and hellos."""

import ipaddress
import struct


def ip_packet(src, dst, number, payload, ttl=64):
    s, d = ipaddress.ip_address(src), ipaddress.ip_address(dst)
    if s.version == 4:
        return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(payload), 0, 0, ttl, number, 0, s.packed, d.packed) + payload
    return struct.pack(">IHBB16s16s", 0x60000000, len(payload), number, ttl, s.packed, d.packed) + payload


def frame(packet):
    return b"\x02" * 12 + (b"\x08\x00" if packet[0] >> 4 == 4 else b"\x86\xdd") + packet


def tcp(src, dst, sport, dport, flags, data=b"", seq=0, ack=0):
    return frame(ip_packet(src, dst, 6, struct.pack(">HHIIBBHHH", sport, dport, seq, ack, 0x50, flags, 1000, 0, 0) + data))


def udp(src, dst, sport, dport, data=b""):
    return frame(ip_packet(src, dst, 17, struct.pack(">HHHH", sport, dport, 8 + len(data), 0) + data))


def icmp(src, dst, kind, code=0):
    return frame(ip_packet(src, dst, 1, struct.pack(">BBHI", kind, code, 0, 0)))


def dns(name, answer=False, rcode=0):
    labels = b"".join(bytes([len(p)]) + p.encode() for p in name.split("."))
    return struct.pack(">HHHHHH", 7, (0x8180 | rcode) if answer else 0x0100, 1, 0, 0, 0) + labels + b"\0" + struct.pack(">HH", 1, 1)


def _ext(kind, body):
    return struct.pack(">HH", kind, len(body)) + body


def client_hello(sni="a.example", ciphers=(0x1A1A, 0x1301, 0x1302, 0xC02F), alpn="h2"):
    words = lambda v: b"".join(struct.pack(">H", x) for x in v)
    ext = _ext(0, struct.pack(">HBH", len(sni) + 3, 0, len(sni)) + sni.encode()) if sni else b""
    ext += _ext(0x2A2A, b"") + _ext(10, struct.pack(">H", 4) + words((29, 23))) + _ext(11, b"\x01\x00")
    ext += _ext(13, struct.pack(">H", 4) + words((0x0403, 0x0804))) + (_ext(16, struct.pack(">HB", len(alpn) + 1, len(alpn)) + alpn.encode()) if alpn else b"")
    ext += _ext(43, bytes([4]) + words((0x0304, 0x0303)))
    body = struct.pack(">H", 0x0303) + b"\0" * 32 + b"\0" + struct.pack(">H", 2 * len(ciphers)) + words(ciphers) + b"\x01\0" + struct.pack(">H", len(ext)) + ext
    message = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(message)) + message


def classic(packets, nano=False, big=False, cut=0):
    o = ">" if big else "<"
    out = struct.pack(o + "IHHIIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for ts, data in packets:
        unit = 1e9 if nano else 1e6
        frac = min(int(round((ts - int(ts)) * unit)), int(unit) - 1)
        out += struct.pack(o + "IIII", int(ts), frac, len(data), len(data)) + data
    return out[: len(out) - cut]


def next_generation(packets):
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body) + -len(body) % 4) + body + b"\0" * (-len(body) % 4) + struct.pack("<I", 12 + len(body) + -len(body) % 4)
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535))
    for ts, data in packets:
        t = int(round(ts * 1e6))
        out += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(data), len(data)) + data)
    return out
