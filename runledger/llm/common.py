"""What the corpus operators share: word rules, scratch tables, size-checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir

#: The white space of all word rules: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that broadcast_if_small lets through; at about 100 bytes a row in the join's hash table that is 50 MB.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage.

    A lost executor then costs no more than the tasks that ran on it. The files
    stay until drop_scratch() or until the folder is cleaned.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; results not yet written are lost with them."""
    jvm, path = spark._jvm, scratch_dir(spark)
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it is a table of narrow rows and has few enough.

    df must be cheap to count (a scratch table). Past the bound Spark joins by
    shuffle, with the same result.
    """
    return F.broadcast(df) if df.count() <= rows else df


def hash60(*cols: Column) -> Column:
    """The first 60 bits of an MD5 as a long; other engines can compute it too."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Leading bits of the key by which running_sum() parts a group.
SUM_BITS = 14


def running_sum(df: DataFrame, group: list[str], key: str, order: list[str], value: Column, out: str, bits: int = 60) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the group, by (key, order).

    key is a non-negative long of ``bits`` evenly spread bits. A window over the
    whole group would put a hot group into one task, so the sum is made in
    two steps, over the leading 14 bits and over the rest: a window holds
    16,384 sums, or a 16,384th part of the group's rows.
    """
    rows = df.withColumn("_v", value).withColumn("_b", F.shiftright(key, max(0, bits - SUM_BITS)))
    sums = rows.groupBy(*group, "_b").agg(F.sum("_v").alias("_s"))
    before = F.sum("_s").over(W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select(*group, "_b", F.coalesce(before, F.lit(0)).alias("_o"))
    inside = F.sum("_v").over(W.partitionBy(*group, "_b").orderBy(key, *order).rowsBetween(W.unboundedPreceding, -1))
    rows = rows.join(offsets, [*group, "_b"]).withColumn(out, F.col("_o") + F.coalesce(inside, F.lit(0)))
    return rows.drop("_v", "_b", "_o")
