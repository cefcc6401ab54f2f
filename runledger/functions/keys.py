"""Column functions on keys, values and time-series keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_key(text: Column | str) -> Column:
    return F.encode(_col(text), "UTF-8")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash8(c: Column | str) -> Column:
    """8 bytes that spread evenly over the key space: the head of the MD5 of the value's text."""
    return F.unhex(F.substring(F.md5(_col(c).cast("string").cast("binary")), 1, 16))


def key_prefix(key: Column | str) -> Column:
    """The first two bytes as a big-endian number; a missing second byte counts as 0."""
    return F.conv(F.rpad(F.hex(F.substring(_col(key), 1, 2)), 4, "0"), 16, 10).cast("int")


def partition_id(key: Column | str, exponent: int = 4) -> Column:
    """The largest prefix of the key's range: the key space has 2^exponent ranges of equal width."""
    width = 65536 >> exponent
    return ((F.floor(key_prefix(key) / width) + 1) * width - 1).cast("int")


def partition_of(key: bytes, exponent: int = 4) -> int:
    """partition_id of one key, on the driver."""
    width = 65536 >> exponent
    prefix = int.from_bytes((key + b"\0\0")[:2], "big")
    return (prefix // width + 1) * width - 1


def partition_path(pid: Column | str) -> Column:
    """Folder of a range: high byte, then both bytes, in small hexadecimal digits."""
    h = F.lower(F.lpad(F.hex(_col(pid).cast("long")), 4, "0"))
    return F.concat(F.substring(h, 1, 2), F.lit("/"), h)


def hex_dump(key: Column | str) -> Column:
    """Small hexadecimal digits with a dash after every two bytes, none at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.hex(_col(key))), "(.{4})", "$1-"), "-$", "")


def big_endian(ts: Column | str) -> Column:
    """8 bytes, big-endian, of a number of 0 or more; they sort as the numbers do."""
    return F.unhex(F.lpad(F.hex(_col(ts).cast("long")), 16, "0"))


def from_big_endian(b: Column | str) -> Column:
    return F.conv(F.hex(_col(b)), 16, 10).cast("long")


def series_key(device: Column | str, ts: Column | str) -> Column:
    """24 bytes: hashed device, eight zero bytes, big-endian time stamp."""
    return F.concat(hash8(device), F.unhex(F.lit("00" * 8)), big_endian(ts))


def tag_value(value: Column | str, value_type: Column | str) -> Column:
    """The stored form of a value: one byte with its type, then its bytes; a tombstone is the byte alone."""
    t = _col(value_type)
    return F.concat(F.unhex(F.lpad(F.hex(t.cast("long")), 2, "0")), F.when(t == 2, F.unhex(F.lit(""))).otherwise(F.coalesce(_col(value), F.unhex(F.lit("")))))


def tag_of(stored: Column | str) -> Column:
    return F.conv(F.hex(F.substring(_col(stored), 1, 1)), 16, 10).cast("tinyint")


def untag_value(stored: Column | str) -> Column:
    return F.substring(_col(stored), F.lit(2), F.length(_col(stored)))


def pack_offset(offset: Column | str, deleted: Column | str) -> Column:
    """A pointer's offset with the deleted flag in its highest bit."""
    offset = _col(offset).cast("long")
    return F.when(_col(deleted), offset.bitwiseOR(F.lit(-(1 << 63)))).otherwise(offset)


def is_deleted_pointer(packed: Column | str) -> Column:
    return F.shiftrightunsigned(_col(packed), 63) == 1


def pointer_offset(packed: Column | str) -> Column:
    return _col(packed).bitwiseAND(F.lit((1 << 63) - 1))


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("long")


def align_up(a: Column, size: int = 4096) -> Column:
    return ceil_div(a, size) * size


def varint_length(v: Column | str) -> Column:
    """Bytes of a number of 0 or more in base-128 form."""
    return F.floor((F.length(F.bin(_col(v).cast("long"))) + 6) / 7).cast("int")


def shared_prefix_length(a: Column | str, b: Column | str) -> Column:
    """Bytes that two keys share at their start."""
    a, b = F.hex(_col(a)), F.hex(_col(b))
    n = F.floor(F.least(F.length(a), F.length(b)) / 2).cast("int")
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i * 2 - 1, F.lit(2)) != F.substring(b, i * 2 - 1, F.lit(2)))
    shared = F.when(n == 0, 0).otherwise(F.coalesce(F.array_min(differ) - 1, n))
    return F.when(a.isNotNull() & b.isNotNull(), shared).cast("int")


def xorshift64(x: Column | str) -> Column:
    x = _col(x).cast("long")
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def is_read_op(op: Column | str) -> Column:
    """Even chance, fixed by the operation's number."""
    return F.pmod(F.conv(F.substring(F.md5(_col(op).cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(2)) == 1
