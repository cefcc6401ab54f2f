"""Streams end with what a batch over the same rows gives; a batch run twice changes nothing."""

from pyspark.sql import functions as F

from runledger.functions import keys as K
from runledger.operators import versions
from runledger.queries import QUERIES, log
from runledger.schema import LOG, Config
from runledger.sources.table import VersionedTable
from runledger.streaming.ingest import ingest, newest_stream, read_newest, write_newest


def source(spark, sf_dir, path):
    rows = log(spark, sf_dir).select(K.text_key("key").alias("key"), "seq", F.col("value_type").cast("tinyint").alias("value_type"), K.text_key(F.col("value").cast("string")).alias("value"))
    for i in range(4):
        rows.where(F.pmod("seq", F.lit(4)) == 3 - i).coalesce(1).write.mode("append").parquet(path)
    return rows


def pairs(df):
    return sorted((bytes(r["key"]), bytes(r["value"])) for r in df.collect())


def test_ingest(spark, sf_dir, tmp_path):
    path = f"file://{tmp_path}/in"
    rows = source(spark, sf_dir, path)
    table = VersionedTable.create(spark, f"file://{tmp_path}/t", Config(min_merge_width=2))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path)
    query = ingest(table, stream, f"file://{tmp_path}/c", compact_every=3).trigger(availableNow=True).start()
    query.awaitTermination()
    table.refresh()
    assert pairs(table.scan()) == pairs(versions.live(rows).select("key", "value"))
    before = table.manifest
    (stream_id,) = before["sources"]
    assert table.append(rows, stream_id, 1) is None and table.manifest == before


def run_stream(spark, table, path, checkpoint):
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path)
    ingest(table, stream, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table.refresh()


def test_no_batch_is_taken_for_another_writers_commit(spark, sf_dir, tmp_path):
    """Writes before and between, a second stream, a new checkpoint: every batch arrives."""
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    part = lambda k, s: spark.createDataFrame([(bytearray(k), s, 1, bytearray(k))], LOG).coalesce(1)
    table = VersionedTable.create(spark, f"file://{tmp_path}/t", Config(min_merge_width=2))
    table.append(part(b"before", 0))
    for i, k in enumerate((b"a", b"b")):
        part(k, 1 + i).write.mode("append").parquet(one)
    run_stream(spark, table, one, f"file://{tmp_path}/c1")
    table.put(spark.createDataFrame([(bytearray(b"between"), bytearray(b"between"))], "key binary, value binary"))
    part(b"c", 10).write.parquet(two)
    run_stream(spark, table, two, f"file://{tmp_path}/c2")
    assert pairs(table.scan()) == [(k, k) for k in (b"a", b"b", b"before", b"between", b"c")]
    part(b"d", 11).write.mode("append").parquet(one)
    run_stream(spark, table, one, f"file://{tmp_path}/c1")
    runs = len(run_stream(spark, table, one, f"file://{tmp_path}/c3").runs)
    assert runs == 2 + 1 + 1 + 1 + 1 + 3 and len(table.manifest["sources"]) == 3
    assert run_stream(spark, table, one, f"file://{tmp_path}/c3").runs == table.runs and len(table.runs) == runs
    assert pairs(table.scan()) == [(k, k) for k in (b"a", b"b", b"before", b"between", b"c", b"d")]


def test_newest_stream(spark, sf_dir, tmp_path):
    path = f"file://{tmp_path}/in"
    rows = source(spark, sf_dir, path)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 2).parquet(path)
    query = newest_stream(stream).writeStream.outputMode("complete").format("memory").queryName("newest").trigger(availableNow=True).start()
    query.awaitTermination()
    assert pairs(versions.not_deleted(spark.table("newest"))) == pairs(versions.live(rows).select("key", "value"))


def test_newest_is_written_by_executors(spark, sf_dir, tmp_path):
    path = f"file://{tmp_path}/in"
    rows = source(spark, sf_dir, path)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 2).parquet(path)
    write_newest(stream, f"file://{tmp_path}/n", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert pairs(versions.not_deleted(read_newest(spark, f"file://{tmp_path}/n"))) == pairs(versions.live(rows).select("key", "value"))
    before = {t.name for t in spark.catalog.listTables()}
    assert QUERIES["stream_newest"](spark, sf_dir).count() == rows.select("key").distinct().count()
    assert {t.name for t in spark.catalog.listTables()} == before  # no table in the driver's memory
