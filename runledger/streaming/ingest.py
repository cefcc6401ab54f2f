"""Structured Streaming: ingest into a versioned table, and the running newest version of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.versions import newest
from ..plans.compaction import compact
from ..schema import LOG
from ..sources.table import VersionedTable


def ingest(table: VersionedTable, stream: DataFrame, checkpoint: str, compact_every: int = 0) -> DataStreamWriter:
    """A stream writer that appends each micro-batch (key, seq, value_type, value) as a run.

    The table remembers the last batch of each stream by the id that Spark keeps in the stream's checkpoint, so a batch that is
    run again after a failure changes nothing, while other writers, other streams and a new checkpoint are never taken for
    it. compact_every: merge runs after that many batches, which bounds the number of runs
    a reader meets; tombstones are kept, since entries may arrive after newer ones.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        source = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        table.refresh().append(batch, source, batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact(table, keep_tombstones=True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def newest_stream(stream: DataFrame) -> DataFrame:
    """The newest version of each key as a streaming aggregate, for complete or update mode.

    Its state has a row for each key ever seen and never expires: order is by seq, not by event time, so no
    watermark applies. For large key spaces use ingest().
    """
    return stream.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("value_type", "seq").alias("value_type"), F.max_by("value", "seq").alias("value"))


def write_newest(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream writer that puts the keys which a micro-batch changes into a folder of their own under path.

    Executors write; nothing passes through the driver. A batch that is run again overwrites its folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    empty = stream.sparkSession.createDataFrame([], stream.schema)
    newest_stream(empty).write.mode("overwrite").parquet(f"{path}/batch=-1")
    return newest_stream(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of each key that write_newest has written."""
    return newest(spark.read.schema(LOG).parquet(path).drop("batch"))
