"""Column functions against plain Python."""

import hashlib
import os

from pyspark.sql import functions as F

from runledger.functions import keys as K

KEYS = [b"", b"\0", b"a", b"ab", b"ab\0", b"\xff\xff\xff", bytes(range(32)), os.urandom(24)]


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def binary(b):
    return F.unhex(F.lit(b.hex()))


def test_keys(spark):
    for b in KEYS:
        r = one(spark, dump=K.hex_dump(binary(b)), prefix=K.key_prefix(binary(b)), path=K.partition_path(F.lit(K.partition_of(b, 8))))
        h = b.hex()
        assert r["dump"] == "-".join(h[i : i + 4] for i in range(0, len(h), 4))
        assert b == b"" or r["prefix"] == int.from_bytes((b + b"\0")[:2], "big")
        pid = f"{K.partition_of(b, 8):04x}"
        assert r["path"] == f"{pid[:2]}/{pid}"


def test_order_of_keys_is_bytewise(spark):
    df = spark.createDataFrame([(bytearray(b),) for b in KEYS], "k binary")
    assert [bytes(r[0]) for r in df.orderBy("k").collect()] == sorted(KEYS)


def test_series_keys(spark):
    stamps = [0, 1, 255, 256, 1 << 40, (1 << 63) - 1]
    rows = spark.createDataFrame([(7, t) for t in stamps], "d long, t long").select(K.series_key("d", "t").alias("k"), "t", K.from_big_endian(K.big_endian("t")).alias("back"))
    head = hashlib.md5(b"7").digest()[:8]
    for r in rows.collect():
        assert bytes(r["k"]) == head + bytes(8) + r["t"].to_bytes(8, "big") and r["back"] == r["t"]
    assert [r["t"] for r in rows.orderBy("k").collect()] == stamps


def test_values(spark):
    for value, kind, stored in ((b"xy", 1, b"\x01xy"), (b"", 1, b"\x01"), (None, 1, b"\x01"), (b"gone", 2, b"\x02"), (b"p", 0, b"\x00p")):
        v = binary(value) if value is not None else F.lit(None).cast("binary")
        r = one(spark, s=K.tag_value(v, F.lit(kind)), t=K.tag_of(K.tag_value(v, F.lit(kind))), u=K.untag_value(K.tag_value(v, F.lit(kind))))
        assert bytes(r["s"]) == stored and r["t"] == kind and bytes(r["u"]) == stored[1:]
    for offset in (0, 5, (1 << 62) + 3):
        for deleted in (True, False):
            p = K.pack_offset(F.lit(offset), F.lit(deleted))
            r = one(spark, d=K.is_deleted_pointer(p), o=K.pointer_offset(p))
            assert (r["d"], r["o"]) == (deleted, offset)


def test_numbers(spark):
    values = [0, 1, 127, 128, 16383, 16384, (1 << 63) - 1]
    for v in values:
        r = one(spark, n=K.varint_length(F.lit(v)), a=K.align_up(F.lit(v % 100_000)), x=K.xorshift64(F.lit(v)))
        assert r["n"] == max(1, -(-v.bit_length() // 7))
        assert r["a"] == -(-(v % 100_000) // 4096) * 4096
        x = v
        for shift, left in ((13, True), (7, False), (17, True)):
            x ^= (x << shift if left else x >> shift) & ((1 << 64) - 1)
        assert r["x"] % (1 << 64) == x


def test_shared_prefix(spark):
    for a in KEYS:
        for b in KEYS:
            want = len(os.path.commonprefix([a, b]))
            assert one(spark, n=K.shared_prefix_length(binary(a), binary(b)))["n"] == want
