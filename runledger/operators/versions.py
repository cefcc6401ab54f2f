"""Reading a change log: newest versions, snapshots, ranges, lookups. DataFrame in, DataFrame out.

A log has the columns key, seq, value_type, value, and others that ride along. The order of steps is fixed:
range and snapshot filters, then the newest version of each key, then tombstones out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import partition_id, partition_of
from ..schema import TOMBSTONE


#: Rows of a log that a task reads and sorts, at most on average; some 200 MB where keys and values are short.
TASK_ROWS = 2_000_000


def spread(log: DataFrame, rows: int) -> DataFrame:
    """A stored log of so many rows, dealt anew if its files hold more than TASK_ROWS a task.

    Spark cuts files by their bytes, and sorted keys can take a byte or two each, so a task's rows would grow with the table.
    """
    if rows <= TASK_ROWS * max(1, log.rdd.getNumPartitions()):
        return log
    return log.repartition(-(-rows // TASK_ROWS), "key", "seq")


def in_range(log: DataFrame, lower: bytes | str | None = None, upper: bytes | str | None = None, key: str = "key") -> DataFrame:
    """Keys from lower to upper, both included; None leaves a side open."""
    if lower is not None:
        log = log.where(F.col(key) >= F.lit(lower))
    return log if upper is None else log.where(F.col(key) <= F.lit(upper))


def visible(log: DataFrame, snapshot: int | None, seq: str = "seq") -> DataFrame:
    """Versions written before the snapshot was taken."""
    return log if snapshot is None else log.where(F.col(seq) < snapshot)


def newest(log: DataFrame, key: list[str] | str = "key", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The newest version of each key, all columns.

    row_number() = 1 lets Spark keep one row a key and task before the shuffle, so a hot key costs one row a task.
    """
    w = W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*[F.col(c).desc() for c in order])
    return log.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def newest_narrow(log: DataFrame, columns: list[str], key: str = "key", seq: str = "seq") -> DataFrame:
    """The same for a few fixed-width columns, as one hash aggregate with partial sums."""
    return log.groupBy(key).agg(F.max(seq).alias(seq), *[F.max_by(c, seq).alias(c) for c in columns])


def not_deleted(log: DataFrame) -> DataFrame:
    return log.where(F.col("value_type") != TOMBSTONE)


def live(log: DataFrame, snapshot: int | None = None, lower=None, upper=None, partition: int | None = None, exponent: int = 4) -> DataFrame:
    """What a reader sees: one row for each key that is not deleted.

    partition: only keys of that range of the key space, as partition_id gives it.
    """
    rows = visible(in_range(log, lower, upper), snapshot)
    if partition is not None:
        pid = F.col("partition_id") if "partition_id" in log.columns else partition_id("key", exponent)
        rows = rows.where(pid == partition)
    return not_deleted(newest(rows))


def scan(log: DataFrame, lower=None, upper=None, snapshot: int | None = None, scope: str = "global", exponent: int = 4) -> DataFrame:
    """(key, value) of the live keys in a range, in byte order.

    scope="partition" reads only the range of the key space that holds lower, or else upper.
    """
    if scope not in ("global", "partition"):
        raise ValueError(f"unknown scope {scope}")
    bound = lower if lower is not None else upper
    partition = None
    if scope == "partition" and bound is not None:
        partition = partition_of(bound if isinstance(bound, bytes) else bound.encode(), exponent)
    return live(log, snapshot, lower, upper, partition, exponent).select("key", "value").orderBy("key")


def seek(log: DataFrame, lower, n: int, snapshot: int | None = None) -> DataFrame:
    """The first n live entries from lower on."""
    return live(log, snapshot, lower).select("key", "value").orderBy("key").limit(n)


def get_many(log: DataFrame, probes: DataFrame, key: str = "key", snapshot: int | None = None, few: int = 100_000) -> DataFrame:
    """For each row of probes its value and status: OK, DELETED or KEY_NOT_FOUND.

    Up to ``few`` probes are broadcast to cut the log before its newest versions are found. With more, the newest
    versions come first, one row a key and task, so that a key with many versions doesn't crowd one task of a join.
    """
    log = visible(log, snapshot)
    wanted = probes.select(F.col(key).alias("key")).distinct()
    if wanted.limit(few + 1).count() <= few:
        log = log.join(F.broadcast(wanted), "key", "left_semi")
    found = newest(log).select(F.col("key").alias("_key"), "value_type", "value")
    status = F.when(F.col("_key").isNull(), "KEY_NOT_FOUND").when(F.col("value_type") == TOMBSTONE, "DELETED").otherwise("OK")
    out = probes.join(found, probes[key] == found["_key"], "left")
    return out.select(*[probes[c] for c in probes.columns], status.alias("status"), F.when(status == "OK", F.col("value")).alias("value"))


def get(log: DataFrame, key: bytes | str, snapshot: int | None = None) -> tuple[str, object]:
    """(status, value) of one key; a job for each call, so prefer get_many."""
    row = newest(visible(log.where(F.col("key") == F.lit(key)), snapshot)).select("value_type", "value").first()
    return ("KEY_NOT_FOUND", None) if row is None else ("DELETED", None) if row[0] == TOMBSTONE else ("OK", row[1])


def replayable(log: DataFrame, high_water: int | None) -> DataFrame:
    """Entries that no run holds yet. Without a run nothing is held, not even seq 0."""
    return log if high_water is None else log.where(F.col("seq") > high_water)


def tombstones(log: DataFrame) -> DataFrame:
    """Keys whose newest version is a delete."""
    return newest(log).where(F.col("value_type") == TOMBSTONE)


def version_counts(log: DataFrame) -> DataFrame:
    deletes = F.count_if(F.col("value_type") == TOMBSTONE)
    return log.groupBy("key").agg(F.count("*").alias("versions"), deletes.alias("deletes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def superseded(log: DataFrame) -> DataFrame:
    """One row: versions, keys, and versions that a newer one hides."""
    per_key = log.groupBy("key").agg(F.count("*").alias("n"))
    return per_key.agg(F.sum("n").alias("versions"), F.count("*").alias("keys"), (F.sum("n") - F.count("*")).alias("superseded"))


def numbered_parts(df: DataFrame) -> DataFrame:
    """df with the task's number (_part) and each row's place in it (_row), to be written before dense_numbers()."""
    return df.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def dense_numbers(df: DataFrame, start: int, name: str = "seq") -> DataFrame:
    """Number the rows of a table that numbered_parts() marked, from start on without gaps, in the order of tasks and of rows in them.

    Only the rows counted for each task, a number each, come to the driver.
    """
    offsets, at = {}, start
    for part, n in sorted(map(tuple, df.groupBy("_part").count().collect())):
        offsets[part] = at
        at += n
    firsts = df.sparkSession.createDataFrame(list(offsets.items()), "_part int, _first long")
    # Twelve bytes for each task: small however many rows there are.
    return df.join(F.broadcast(firsts), "_part").withColumn(name, F.col("_first") + F.col("_row")).drop("_part", "_row", "_first")
