"""Column functions over names, sizes and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(col: str | Column) -> Column:
    """Shannon entropy of a string's characters in bits; empty: 0."""
    c = F.col(col) if isinstance(col, str) else col
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars)
    each = lambda ch: F.size(F.filter(chars, lambda y: y == ch)) / n
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, ch: s - each(ch) * F.log2(each(ch)))
    return F.when(n > 0, bits + 0.0).otherwise(F.lit(0.0))


def label_depth(col: str) -> Column:
    return F.length(col) - F.length(F.replace(F.col(col), F.lit("."), F.lit("")))


def first_label(col: str) -> Column:
    return F.substring_index(col, ".", 1)


def is_grease(value: Column) -> Column:
    """Reserved values of RFC 8701: 0x0A0A, 0x1A1A, ... 0xFAFA."""
    return (value.bitwiseAND(0x0F0F) == 0x0A0A) & (F.shiftright(value, 8) == value.bitwiseAND(0xFF))


def without_grease(values: str | Column) -> Column:
    return F.filter(values, lambda v: ~is_grease(v))


def _dashed(values: Column) -> Column:
    return F.array_join(F.transform(without_grease(values), lambda v: v.cast("string")), "-")


def ja3(version: str, ciphers: str, extensions: str, groups: str, formats: str) -> Column:
    """MD5 of version, ciphers, extensions, groups and point formats in wire order, reserved values left out."""
    return F.md5(F.concat_ws(",", F.col(version).cast("string"), *[_dashed(F.col(c)) for c in (ciphers, extensions, groups)], F.array_join(F.transform(formats, lambda v: v.cast("string")), "-")))


def ja3s(version: str, cipher: str, extensions: str) -> Column:
    return F.md5(F.concat_ws(",", F.col(version).cast("string"), F.col(cipher).cast("string"), _dashed(F.col(extensions))))


def _hex_list(values: Column, sort: bool = True) -> Column:
    hexes = F.transform(values, lambda v: F.lower(F.lpad(F.hex(v), 4, "0")))
    return F.array_join(F.array_sort(hexes) if sort else hexes, ",")


def _sha12(text: Column) -> Column:
    return F.when(text == "", F.lit("0" * 12)).otherwise(F.substring(F.sha2(text, 256), 1, 12))


def ja4(version: str, alpn: str, ciphers: str, extensions: str, signatures: str, transport: str = "t") -> Column:
    """JA4 of a client hello: version is the highest supported one, alpn (the first protocol, a character per byte) may be null, lists
    are as on the wire."""
    names = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3"}
    v = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(version)), F.lit("00"))
    two = lambda n: F.lpad(F.least(n, F.lit(99)).cast("string"), 2, "0")
    own, ext = without_grease(ciphers), without_grease(extensions)
    hexed = F.lower(F.hex(F.encode(F.col(alpn), "ISO-8859-1")))
    shown = F.when(F.col(alpn).rlike(r"(?s)^[0-9A-Za-z](.*[0-9A-Za-z])?$"), F.col(alpn)).otherwise(hexed)
    ends = F.when(F.coalesce(F.length(alpn), F.lit(0)) > 0, F.concat(F.substring(shown, 1, 1), F.substring(shown, -1, 1))).otherwise("00")
    a = F.concat(F.lit(transport), v, F.when(F.array_contains(ext, 0), "d").otherwise("i"), two(F.size(own)), two(F.size(ext)), ends)
    kept = F.filter(ext, lambda e: ~e.isin(0x0000, 0x0010))
    signs = _hex_list(without_grease(signatures), sort=False)
    c = F.when(signs == "", _hex_list(kept)).otherwise(F.concat(_hex_list(kept), F.lit("_"), signs))
    return F.concat_ws("_", a, _sha12(_hex_list(own)), F.when(F.size(kept) == 0, F.lit("0" * 12)).otherwise(_sha12(c)))
