"""Statistics of storage layout, compactions and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


def tree_stats(files: DataFrame, size: str = "size") -> DataFrame:
    """Per partition and level: number, mean, population deviation and sum of file sizes."""
    s = F.col(size)
    return files.groupBy("partition_id", "level").agg(F.count("*").alias("n_files"), F.avg(s).alias("avg_size"), F.stddev_pop(s).alias("stddev_size"), F.sum(s).alias("total_size"))


def read_amplification(runs: DataFrame) -> DataFrame:
    """One row: mean number of runs in a partition."""
    return runs.groupBy("partition_id").agg(F.count("*").alias("n")).agg(F.avg("n").alias("read_amplification"))


def _rate(bytes_: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, bytes_ / seconds)


def level_stats(jobs: DataFrame) -> DataFrame:
    """Compactions (level, bytes, items, start, end in seconds) per level: sums, span, mean and time-weighted throughput.

    The weighted throughput is each job's rate by its share of the level's busy time; jobs without duration have no rate.
    """
    took = F.col("end") - F.col("start")
    j = jobs.withColumn("_took", took).withColumn("_rate", _rate(F.col("bytes"), took))
    return j.groupBy("level").agg(
        F.sum("bytes").alias("bytes"), F.sum("items").alias("items"), F.count("*").alias("compactions"), F.min("start").alias("first_start"), F.max("end").alias("last_end"),
        F.avg("_rate").alias("mean_rate"), _rate(F.sum(F.col("_rate") * F.col("_took")), F.sum("_took")).alias("weighted_rate"),
    )


def idle_time(spans: DataFrame, start: str = "start", end: str = "end", buckets: int = 1024) -> DataFrame:
    """One row: span, idle and busy time of overlapping intervals.

    Sorted by start, an interval leaves a gap if it starts after all before it have ended. The running maximum
    of the ends is carried from one bucket of start times to the next, so that no window holds more
    than one bucket's intervals, or the buckets themselves.
    """
    low, high = spans.agg(F.min(start), F.max(start)).first()
    width = max(1e-9, (float(high) - float(low)) / buckets) if low is not None else 1.0
    rows = spans.select(F.col(start).alias("s"), F.col(end).alias("e"))
    rows = rows.withColumn("b", F.floor((F.col("s") - F.lit(low if low is not None else 0)) / F.lit(width)).cast("int"))
    every = W.partitionBy(F.lit(0)).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy("b").agg(F.max("e").alias("_e")).select("b", F.max("_e").over(every).alias("carry"))
    inside = W.partitionBy("b").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)
    gaps = rows.join(carried, "b").withColumn("before", F.greatest(F.max("e").over(inside), F.col("carry")))
    out = gaps.agg((F.max("e") - F.min("s")).alias("span"), F.coalesce(F.sum(F.greatest(F.col("s") - F.col("before"), F.lit(0))), F.lit(0)).alias("idle"), F.count("*").alias("intervals"))
    return out.withColumn("busy", F.col("span") - F.col("idle"))


def latency_stats(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, least, most, mean and nearest-rank percentiles. The mean is rounded down, as whole ticks are.

    The percentiles are exact: a group's state is its distinct values with their counts, so give values in ticks.
    """
    v = F.col(value)
    names = {p: "p" + f"{p * 100:g}".replace(".", "_") for p in PERCENTILES}
    ranks = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(n) for p, n in names.items()]
    return df.groupBy(*(by or [])).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.floor(F.sum(v) / F.count(v)).alias("mean"), *ranks)


def histogram(df: DataFrame, value: str, width: float, buckets: int) -> DataFrame:
    """Per bucket of the given width (the last one takes all beyond): count, and count up to it."""
    b = F.least(F.floor(F.col(value) / width), F.lit(buckets - 1)).cast("int")
    counts = df.where(F.col(value) >= 0).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
    upto = W.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)  # at most ``buckets`` rows
    return counts.withColumn("upto", F.sum("n").over(upto))


def throughput(ops: Column, value_bytes: Column, seconds: Column, key_bytes: int = 24) -> tuple[Column, Column]:
    """Operations and MB per second."""
    return _rate(ops, seconds), _rate(ops * (value_bytes + key_bytes) / F.lit(1e6), seconds)


def flush_shares(batches: DataFrame) -> DataFrame:
    """A flush's bytes, items and duration split evenly over its files, in whole units."""
    files = F.greatest(F.col("files"), F.lit(1))
    return batches.withColumns({c: F.floor(F.col(c) / files).cast("long") for c in ("bytes", "items", "micros")})
