"""The benchmark workloads: loads, reads, mixed operations, ranges, time series, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import hash8, is_read_op, series_key
from ..operators import versions
from ..sources.table import VersionedTable
from .compaction import compact

VALUES = 1024
#: Entries of a range scan in each tier, least and most.
RANGE_TIERS = ((1, 100), (512, 1024), (114_688, 131_072))


def numbered_key(i: Column) -> Column:
    """24 bytes: 8 hashed from the number, then zeros."""
    return F.concat(hash8(i), F.unhex(F.lit("00" * 16)))


def numbered_value(i: Column, size: int = 100, salt: int = 0) -> Column:
    """One of VALUES distinct values."""
    slot = F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(VALUES))
    return F.encode(F.substring(F.repeat(F.md5(slot.cast("string").cast("binary")), -(-size // 32)), 1, size), "UTF-8")


def records(spark: SparkSession, start: int, end: int, salt: int = 0) -> DataFrame:
    ids = spark.range(start, end)
    return ids.select(numbered_key(F.col("id")).alias("key"), numbered_value(F.col("id"), salt=salt).alias("value"))


def load(table: VersionedTable, n: int, batches: int = 1) -> None:
    for i in range(batches):
        table.put(records(table.spark, n * i // batches, n * (i + 1) // batches))


def load_series(table: VersionedTable, devices: int, points: int) -> None:
    ids = table.spark.range(devices * points).select((F.col("id") / points).cast("long").alias("device"), (F.col("id") % points).alias("ts"))
    table.put(ids.select(series_key("device", "ts").alias("key"), numbered_value(F.col("ts")).alias("value")))


def read_all(table: VersionedTable, n: int) -> DataFrame:
    """One row: probes and those not found."""
    found = table.get_many(records(table.spark, 0, n).select("key"))
    return found.agg(F.count("*").alias("probes"), F.count_if(F.col("status") != "OK").alias("errors"))


def mixed(table: VersionedTable, n: int, operations: int) -> DataFrame:
    """Half of the operations read loaded keys, the others write new ones; returns the reads' counts."""
    ops = table.spark.range(operations)
    writes = ops.where(~is_read_op("id")).select((F.col("id") + n).alias("id"))
    table.put(writes.select(numbered_key(F.col("id")).alias("key"), numbered_value(F.col("id")).alias("value")))
    reads = ops.where(is_read_op("id")).select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("id"))
    found = table.get_many(reads.select(numbered_key(F.col("id")).alias("key")))
    return found.agg(F.count("*").alias("reads"), F.count_if(F.col("status") != "OK").alias("errors"))


def range_scan(table: VersionedTable, start: bytes, tier: int) -> DataFrame:
    return table.seek(start, RANGE_TIERS[tier][1])


def scan_series(table: VersionedTable, devices: DataFrame) -> DataFrame:
    """Points of each device in devices (device), counted in one pass instead of a scan for each."""
    heads = devices.select("device", hash8("device").alias("_head"))
    points = versions.live(table.log()).select(F.substring("key", 1, 8).alias("_head"))
    return points.join(heads, "_head").groupBy("device").agg(F.count("*").alias("points"))


def compaction(table: VersionedTable, n: int, batches: int) -> list[dict]:
    load(table, n, batches)
    return compact(table)


def delete_all(table: VersionedTable, n: int) -> None:
    table.remove(records(table.spark, 0, n).select("key"))
