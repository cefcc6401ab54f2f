"""Queries over the test tables, with SQL that gives the same rows.

The change log is made of events: key = 16 hexadecimal digits of the user's MD5, seq = event_id, a delete where
event_type is 'error', and epoch = event_id div 2500 for runs. Keys are shown as small hexadecimal digits, which
sort as the bytes do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys as K
from .operators import merge, stats, versions
from .plans import workloads
from .plans.compaction import compact, pick_buckets
from .schema import LOG, Config
from .sources.scratch import scratch_dir
from .sources.table import VersionedTable
from .streaming.ingest import ingest, read_newest, write_newest


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    key = F.substring(F.md5(F.col("user_id").cast("string").cast("binary")), 1, 16)
    kind = F.when(F.col("event_type") == "error", 2).otherwise(1)
    return e.select(key.alias("key"), F.col("event_id").alias("seq"), kind.alias("value_type"), "value", F.floor(F.col("event_id") / 2500).cast("long").alias("epoch"))


def binary_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).withColumn("key", F.unhex("key"))


def micros(ts: str = "ts"):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction-like jobs: level, bytes, items, start and end in whole seconds."""
    e = events(spark, sf_dir)
    start = F.floor(micros() / 1_000_000)
    took = F.pmod(F.col("event_id") * 7, F.lit(1800))
    return e.select(F.pmod("user_id", F.lit(4)).cast("int").alias("level"), F.floor(F.abs("value") * 1000).cast("long").alias("bytes"), F.pmod("event_id", F.lit(97)).alias("items"), start.alias("start"), (start + took).alias("end"), F.col("event_id").alias("id"))


LOG_SQL = """SELECT substr(md5(CAST(user_id AS VARCHAR)), 1, 16) AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS value_type, value, event_id // 2500 AS epoch FROM events"""
JOBS_SQL = """SELECT CAST(user_id % 4 AS INTEGER) AS level, CAST(floor(abs(value) * 1000) AS BIGINT) AS bytes, event_id % 97 AS items, epoch_us(ts) // 1000000 AS start, epoch_us(ts) // 1000000 + (event_id * 7) % 1800 AS stop, event_id AS id FROM events"""
NEWEST_SQL = "SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"
PREFIX_SQL = "CAST('0x' || substr({k}, 1, 4) AS BIGINT)"
PID_SQL = f"({PREFIX_SQL.format(k='key')} // 4096 + 1) * 4096 - 1"


def _with(sql: str, newest: bool = False) -> str:
    return f"WITH log AS ({LOG_SQL})" + (f", newest AS ({NEWEST_SQL}) " if newest else " ") + sql


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@_query(_with("SELECT key, seq, value FROM newest WHERE value_type <> 2", True))
def live_latest_window(spark, sf_dir):
    return versions.live(log(spark, sf_dir)).select("key", "seq", "value")


@_query(_with("SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM log GROUP BY key HAVING arg_max(value_type, seq) <> 2"))
def live_latest_maxby(spark, sf_dir):
    return versions.not_deleted(versions.newest_narrow(log(spark, sf_dir), ["value_type", "value"])).select("key", "seq", "value")


HALF_SQL = "(SELECT (max(event_id) + 1) // 2 FROM events)"


def half(spark: SparkSession, sf_dir: str) -> int:
    """A snapshot that sees the older half of the log."""
    return ((events(spark, sf_dir).agg(F.max("event_id")).first()[0] or 0) + 1) // 2


@_query(f"WITH log AS (SELECT * FROM ({LOG_SQL}) WHERE seq < {HALF_SQL}), newest AS ({NEWEST_SQL}) SELECT key, seq, value FROM newest WHERE value_type <> 2")
def snapshot_as_of(spark, sf_dir):
    return versions.live(log(spark, sf_dir), snapshot=half(spark, sf_dir)).select("key", "seq", "value")


@_query(_with("SELECT key, value FROM newest WHERE value_type <> 2 AND key >= '4000000000000000' AND key <= 'bfffffffffffffff'", True))
def range_scan_inclusive(spark, sf_dir):
    return versions.scan(log(spark, sf_dir), "4000000000000000", "bfffffffffffffff")


@_query(_with("SELECT key, value FROM newest WHERE value_type <> 2 AND key >= '4000000000000000'", True))
def ts_range_upper_open(spark, sf_dir):
    return versions.scan(log(spark, sf_dir), "4000000000000000", None)


@_query(_with(f"SELECT key, value FROM newest WHERE value_type <> 2 AND key >= '4000000000000000' AND {PID_SQL} = 20479", True))
def range_scan_partition_scoped(spark, sf_dir):
    out = versions.scan(binary_log(spark, sf_dir), bytes.fromhex("4000000000000000"), None, scope="partition")
    return out.select(F.lower(F.hex("key")).alias("key"), "value")


@_query(_with("SELECT key, value FROM newest WHERE value_type <> 2 AND key >= '8' ORDER BY key LIMIT 10", True))
def seek_limit(spark, sf_dir):
    return versions.seek(log(spark, sf_dir), "8", 10)


PROBES_SQL = "SELECT event_id AS probe, substr(md5(CAST(event_id AS VARCHAR)), 1, 16) AS key FROM events"


@_query(_with(f", p AS ({PROBES_SQL}) SELECT p.probe, p.key, CASE WHEN n.key IS NULL THEN 'KEY_NOT_FOUND' WHEN n.value_type = 2 THEN 'DELETED' ELSE 'OK' END AS status, CASE WHEN n.value_type <> 2 THEN n.value END AS value FROM p LEFT JOIN newest n USING (key)", True))
def multi_get_status(spark, sf_dir):
    probes = events(spark, sf_dir).select(F.col("event_id").alias("probe"), F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 16).alias("key"))
    return versions.get_many(log(spark, sf_dir), probes)


@_query(_with("SELECT key, seq FROM newest WHERE value_type = 2", True))
def tombstones(spark, sf_dir):
    return versions.tombstones(log(spark, sf_dir)).select("key", "seq")


@_query(_with("SELECT key, count(*) AS versions, count(*) FILTER (value_type = 2) AS deletes, min(seq) AS first_seq, max(seq) AS last_seq FROM log GROUP BY key"))
def version_counts(spark, sf_dir):
    return versions.version_counts(log(spark, sf_dir))


@_query(_with("SELECT count(*) AS versions, count(DISTINCT key) AS keys, count(*) - count(DISTINCT key) AS superseded FROM log"))
def dup_counter(spark, sf_dir):
    return versions.superseded(log(spark, sf_dir))


@_query(_with(f"SELECT key, seq, value_type FROM log WHERE seq > {HALF_SQL}"))
def wal_replay_above_highwater(spark, sf_dir):
    return versions.replayable(log(spark, sf_dir), half(spark, sf_dir)).select("key", "seq", "value_type")


@_query(_with("SELECT key, seq FROM log"))
def wal_replay_first_write(spark, sf_dir):
    """Nothing is held yet, so all is replayed, seq 0 too."""
    return versions.replayable(log(spark, sf_dir), None).select("key", "seq")


@_query(_with(f"SELECT seq, key, {PID_SQL} AS partition_id FROM log"))
def partition_assignment(spark, sf_dir):
    b = binary_log(spark, sf_dir)
    return b.select("seq", F.lower(F.hex("key")).alias("key"), K.partition_id("key").cast("long").alias("partition_id"))


@_query(_with(f"SELECT DISTINCT partition_id, substr(lpad(lower(hex(partition_id)), 4, '0'), 1, 2) || '/' || lpad(lower(hex(partition_id)), 4, '0') AS path FROM (SELECT {PID_SQL} AS partition_id FROM log)"))
def partition_paths(spark, sf_dir):
    return binary_log(spark, sf_dir).select(K.partition_id("key").cast("long").alias("partition_id")).distinct().withColumn("path", K.partition_path("partition_id"))


@_query(_with("SELECT DISTINCT key, substr(key, 1, 4) || '-' || substr(key, 5, 4) || '-' || substr(key, 9, 4) || '-' || substr(key, 13, 4) AS dump FROM log"))
def key_hex_dump(spark, sf_dir):
    return binary_log(spark, sf_dir).select(F.lower(F.hex("key")).alias("key"), K.hex_dump("key").alias("dump")).distinct()


@_query(_with("SELECT key, arg_max(seq, epoch * 100000000 + seq) AS seq, arg_max(value_type, epoch * 100000000 + seq) AS value_type, arg_max(value, epoch * 100000000 + seq) AS value FROM log GROUP BY key"))
def kway_merge_runs(spark, sf_dir):
    return merge.merge_runs(log(spark, sf_dir)).select("key", "seq", "value_type", "value")


@_query(_with("SELECT key, seq, value FROM newest WHERE value_type <> 2", True))
def gc_merge(spark, sf_dir):
    return merge.merge_runs(log(spark, sf_dir), discard_deleted=True).select("key", "seq", "value")


@_query(f"WITH log AS (SELECT * FROM ({LOG_SQL}) WHERE epoch >= 2), newest AS ({NEWEST_SQL}) SELECT key, seq, value_type FROM newest")
def non_gc_merge(spark, sf_dir):
    """Runs 2 and up merged while older ones stay outside: tombstones are kept."""
    every = log(spark, sf_dir)
    newer, older = every.where("epoch >= 2"), every.where("epoch < 2")
    first = [r[0] for r in older.groupBy("epoch").agg(F.min("seq")).select("min(seq)").collect()]  # a number for each run outside
    last = newer.agg(F.max("seq")).first()[0] or 0
    return merge.merge_runs(newer, bool(first) and merge.can_discard(first, last)).select("key", "seq", "value_type")


@_query(_with("SELECT min(epoch) AS epoch, max(seq) AS max_seq FROM log"))
def merged_epoch(spark, sf_dir):
    return merge.merged_epoch(log(spark, sf_dir))


@_query(_with(", c AS (SELECT count(*) AS n, count(DISTINCT key) AS k FROM log), t AS (SELECT count(*) AS d FROM newest WHERE value_type = 2) SELECT n AS rows_in, k - d AS rows_out, n - k AS superseded, d AS filtered FROM c, t", True))
def merge_conservation(spark, sf_dir):
    return merge.merge_counts(log(spark, sf_dir), discard_deleted=True)


@_query(_with(", m AS (SELECT key, seq, value_type, value FROM log WHERE epoch < 2), u AS (SELECT key, seq, value_type, value, 0 AS live FROM m UNION ALL SELECT key, seq, value_type, value, 1 FROM log WHERE epoch >= 2), r AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY live DESC, seq DESC) = 1) SELECT key, seq, value FROM r WHERE value_type <> 2"))
def run_and_live_overlap(spark, sf_dir):
    """Two runs and entries that are in no run yet; the latter win."""
    every = log(spark, sf_dir)
    both = merge.with_live(every.where("epoch < 2"), every.where("epoch >= 2").drop("epoch"))
    return merge.merge_runs(both, discard_deleted=True).select("key", "seq", "value")


#: Rows of each run and range of the key space in loaded_table(): one a key in each quarter of the log.
RUNS_SQL = f"SELECT {PID_SQL} AS partition_id, 0 AS level, seq * 4 // (SELECT max(event_id) + 1 FROM events) AS epoch, count(DISTINCT key) AS rows FROM log GROUP BY ALL"


@_query(_with(f", files AS ({RUNS_SQL}) SELECT partition_id, level, count(*) AS n_files, avg(rows) AS avg_size, stddev_pop(rows) AS stddev_size, CAST(sum(rows) AS BIGINT) AS total_size FROM files GROUP BY partition_id, level"))
def tree_stats(spark, sf_dir):
    """Layout of a table with four runs, in rows."""
    return stats.tree_stats(loaded_table(spark, sf_dir).run_table(), "rows")


@_query(_with(f", files AS ({RUNS_SQL}) SELECT avg(n) AS read_amplification FROM (SELECT count(*) AS n FROM files GROUP BY partition_id)"))
def read_amplification(spark, sf_dir):
    return stats.read_amplification(loaded_table(spark, sf_dir).run_table())


@_query(f"""WITH j AS ({JOBS_SQL}), r AS (SELECT *, stop - start AS took, CASE WHEN stop > start THEN bytes / (stop - start) END AS rate FROM j)
SELECT level, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(items) AS BIGINT) AS items, count(*) AS compactions, min(start) AS first_start, max(stop) AS last_end, avg(rate) AS mean_rate, sum(rate * took) / sum(took) AS weighted_rate FROM r GROUP BY level""")
def compaction_throughput(spark, sf_dir):
    return stats.level_stats(jobs(spark, sf_dir))


@_query(f"""WITH j AS ({JOBS_SQL}), g AS (SELECT start, stop, max(stop) OVER (ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM j)
SELECT max(stop) - min(start) AS span, CAST(coalesce(sum(greatest(start - before, 0)), 0) AS BIGINT) AS idle, count(*) AS intervals, CAST(max(stop) - min(start) - coalesce(sum(greatest(start - before, 0)), 0) AS BIGINT) AS busy FROM g""")
def idle_gaps(spark, sf_dir):
    return stats.idle_time(jobs(spark, sf_dir))


_PCT = ", ".join(f"quantile_disc(v, {p}) AS p{f'{p * 100:g}'.replace('.', '_')}" for p in stats.PERCENTILES)


@_query(f"WITH e AS (SELECT event_type, CAST(floor(abs(value) * 1000) AS BIGINT) AS v FROM events) SELECT event_type, count(v) AS n, min(v) AS least, max(v) AS most, CAST(floor(sum(v) / count(v)) AS BIGINT) AS mean, {_PCT} FROM e GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    e = events(spark, sf_dir).select("event_type", F.floor(F.abs("value") * 1000).cast("long").alias("v"))
    return stats.latency_stats(e, "v", ["event_type"])


@_query("WITH e AS (SELECT CAST(least(floor(floor(abs(value) * 1000) / 500), 99) AS INTEGER) AS bucket FROM events), c AS (SELECT bucket, count(*) AS n FROM e GROUP BY bucket) SELECT bucket, n, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS upto FROM c")
def latency_histogram_bucket(spark, sf_dir):
    return stats.histogram(events(spark, sf_dir).select(F.floor(F.abs("value") * 1000).alias("v")), "v", 500, 100)


@_query(f"WITH j AS ({JOBS_SQL}) SELECT id, items + 1 AS ops, (items + 1) / 2.5 AS ops_per_s, (items + 1) * 124 / 1e6 / 2.5 AS mb_per_s FROM j")
def throughput_rates(spark, sf_dir):
    ops = F.col("items") + 1
    per_s, mb = stats.throughput(ops, F.lit(100), F.lit(2.5))
    return jobs(spark, sf_dir).select("id", ops.alias("ops"), per_s.alias("ops_per_s"), mb.alias("mb_per_s"))


@_query(f"WITH j AS ({JOBS_SQL}) SELECT id, bytes // greatest(files, 1) AS bytes, items // greatest(files, 1) AS items, micros // greatest(files, 1) AS micros, files FROM (SELECT id, bytes, items, stop - start AS micros, id % 5 AS files FROM j)")
def flush_split(spark, sf_dir):
    j = jobs(spark, sf_dir).select("id", "bytes", "items", (F.col("end") - F.col("start")).alias("micros"), F.pmod("id", F.lit(5)).alias("files"))
    return stats.flush_shares(j)


@_query("SELECT event_id, user_id AS device, epoch_us(ts) AS ts, substr(md5(CAST(user_id AS VARCHAR)), 1, 16) || '0000000000000000' || lpad(lower(hex(epoch_us(ts))), 16, '0') AS key FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def timeseries_device_scan(spark, sf_dir):
    """One device's points by a key range; its series lies in one stretch of the key space."""
    e = events(spark, sf_dir)
    device = e.agg(F.min("user_id")).first()[0]
    rows = e.select("event_id", F.col("user_id").alias("device"), micros().alias("ts"))
    bounds = spark.range(1).select(*[K.series_key(F.lit(device), F.lit(t)).alias(n) for n, t in (("low", 0), ("high", (1 << 63) - 1))]).first()
    found = versions.in_range(rows.withColumn("key", K.series_key("device", "ts")), bytes(bounds["low"]), bytes(bounds["high"]))
    return found.withColumn("key", F.lower(F.hex("key"))).orderBy("key")


@_query("SELECT user_id AS device, count(*) AS points, min(epoch_us(ts)) AS first_ts, max(epoch_us(ts)) AS last_ts FROM events GROUP BY user_id")
def timeseries_point_counts(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("user_id").alias("device"), K.from_big_endian(K.big_endian(micros())).alias("ts"))
    return rows.groupBy("device").agg(F.count("*").alias("points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@_query("SELECT event_id, CASE WHEN CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 2 = 1 THEN 'read' ELSE 'write' END AS op FROM events")
def mixed_rw_split(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.when(K.is_read_op("event_id"), "read").otherwise("write").alias("op"))


@_query("SELECT CAST(i AS BIGINT) AS epoch FROM range(4) t(i)")
def orphan_files(spark, sf_dir):
    """The epochs of the runs that a merge of all four runs leaves on disk, in no manifest's list."""
    table = loaded_table(spark, sf_dir)
    compact(table, compact_all=True)
    return spark.createDataFrame([(int(i.split("-")[0]),) for i in table.orphans()], "epoch long")


@_query("SELECT level, bucket, count(*) AS width, min(epoch) AS first_epoch, max(epoch) AS last_epoch FROM (SELECT level, epoch, (row_number() OVER (PARTITION BY level ORDER BY epoch) - 1) // 4 AS bucket FROM (SELECT DISTINCT event_id // 100 AS epoch, (event_id // 100) % 3 AS level FROM events)) GROUP BY level, bucket HAVING count(*) >= 2")
def bucket_pick(spark, sf_dir):
    """Neighbouring runs of a level in buckets of up to four, at least two. Picking works on a manifest's list of runs."""
    runs = events(spark, sf_dir).select(F.floor(F.col("event_id") / 100).alias("epoch")).distinct().withColumn("level", F.col("epoch") % 3)
    buckets = pick_buckets([r.asDict() for r in runs.collect()], 2, 4)
    count, rows = {}, []
    for b in buckets:
        level = b[0]["level"]
        rows.append((level, count.get(level, 0), len(b), b[0]["epoch"], b[-1]["epoch"]))
        count[level] = count.get(level, 0) + 1
    return spark.createDataFrame(rows, "level long, bucket long, width long, first_epoch long, last_epoch long")


@_query("SELECT o_orderkey, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 16) || repeat('0', 32) AS key, CAST(o_totalprice AS VARCHAR) IS NOT NULL AS has_value FROM orders")
def unique_key_load(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select("o_orderkey", workloads.numbered_key(F.col("o_orderkey")).alias("key"), F.lit(1).alias("value_type"), F.lit(0).alias("seq"), F.col("o_totalprice").isNotNull().alias("has_value"))
    return versions.live(rows).select("o_orderkey", F.lower(F.hex("key")).alias("key"), "has_value")


@_query("SELECT event_id, CAST(greatest(1, ceil(length(bin(event_id)) / 7.0)) AS INTEGER) AS varint_bytes, CAST(ceil(event_id / 4096.0) * 4096 AS BIGINT) AS aligned FROM events")
def varint_and_alignment(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", K.varint_length("event_id").alias("varint_bytes"), K.align_up(F.col("event_id")).alias("aligned"))


@_query(_with(", k AS (SELECT DISTINCT key FROM log), p AS (SELECT key, lag(key) OVER (ORDER BY key) AS before FROM k) SELECT key, CAST(CASE WHEN before IS NULL THEN 0 ELSE (SELECT count(*) FROM range(1, 9) t(i) WHERE substr(key, 1, 2 * CAST(i AS INTEGER)) = substr(before, 1, 2 * CAST(i AS INTEGER))) END AS INTEGER) AS shared FROM p"))
def shared_prefixes(spark, sf_dir):
    """Bytes that each key shares with the one before it: what prefix compression would save."""
    from pyspark.sql import Window as W

    k = binary_log(spark, sf_dir).select("key").distinct()
    # Keys with different first bytes share nothing, so the window can be cut by the first byte.
    first = F.substring(F.hex("key"), 1, 2)
    before = F.lag("key").over(W.partitionBy(first).orderBy("key"))
    k = k.withColumn("before", before).withColumn("shared", F.coalesce(K.shared_prefix_length("key", "before"), F.lit(0)))
    return k.select(F.lower(F.hex("key")).alias("key"), "shared")


@_query(_with("SELECT seq, '0' || value_type || CASE WHEN value_type = 2 THEN '' ELSE lower(hex(key)) END AS stored, value_type AS tag FROM log"))
def tagged_values(spark, sf_dir):
    rows = log(spark, sf_dir).select("seq", K.tag_value(K.text_key("key"), "value_type").alias("b"))
    return rows.select("seq", F.lower(F.hex("b")).alias("stored"), K.tag_of("b").cast("int").alias("tag"))


def stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log in the columns of a table; the value is the number's text."""
    rows = binary_log(spark, sf_dir)
    return rows.select("key", "seq", F.col("value_type").cast("tinyint").alias("value_type"), K.text_key(F.col("seq").cast("string")).alias("value"))


def loaded_table(spark: SparkSession, sf_dir: str, runs: int = 4, **config) -> VersionedTable:
    """A scratch table with the change log in some runs, oldest first."""
    rows = stored_log(spark, sf_dir)
    n = (rows.agg(F.max("seq")).first()[0] or 0) + 1
    table = empty_table(spark, **config)
    for i in range(runs):
        table.append(rows.where(F.col("seq").between(n * i // runs, n * (i + 1) // runs - 1)))
    return table


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(F.lower(F.hex("key")).alias("key"), F.decode("value", "UTF-8").alias("value"))


LIVE_SQL = _with("SELECT key, CAST(seq AS VARCHAR) AS value FROM newest WHERE value_type <> 2", True)


@_query(LIVE_SQL)
def table_scan(spark, sf_dir):
    """Four runs, read together."""
    return _shown(loaded_table(spark, sf_dir).scan())


@_query(LIVE_SQL)
def table_scan_after_compaction(spark, sf_dir):
    """The runs merged into one without tombstones, the old ones vacuumed, the table opened anew."""
    table = loaded_table(spark, sf_dir, bloom_filter_keys=100_000)
    compact(table)
    compact(table, compact_all=True)
    table.vacuum()
    return _shown(VersionedTable.open(spark, table.path).scan())


@_query(_with("SELECT key, CAST(seq AS VARCHAR) AS value FROM newest WHERE value_type <> 2 AND key >= '2000000000000000' AND key <= '9fffffffffffffff'", True))
def table_range_scan(spark, sf_dir):
    return _shown(loaded_table(spark, sf_dir).scan(bytes.fromhex("2000000000000000"), bytes.fromhex("9fffffffffffffff")))


@_query(f"WITH log AS (SELECT * FROM ({LOG_SQL}) WHERE seq < {HALF_SQL}), newest AS ({NEWEST_SQL}) SELECT key, CAST(seq AS VARCHAR) AS value FROM newest WHERE value_type <> 2")
def table_snapshot(spark, sf_dir):
    """A snapshot read of runs that hold one version a key, each run ending at the snapshot or before."""
    at = half(spark, sf_dir)
    rows, table = stored_log(spark, sf_dir), empty_table(spark)
    table.append(rows.where(F.col("seq") < at))
    table.append(rows.where(F.col("seq") >= at))
    return _shown(table.scan(snapshot=at))


@_query(_with(f", p AS ({PROBES_SQL}) SELECT p.probe, CASE WHEN n.key IS NULL THEN 'KEY_NOT_FOUND' WHEN n.value_type = 2 THEN 'DELETED' ELSE 'OK' END AS status, CASE WHEN n.value_type <> 2 THEN CAST(n.seq AS VARCHAR) END AS value FROM p LEFT JOIN newest n USING (key)", True))
def table_get_many(spark, sf_dir):
    probes = events(spark, sf_dir).select(F.col("event_id").alias("probe"), K.hash8("event_id").alias("key"))
    return loaded_table(spark, sf_dir).get_many(probes).select("probe", "status", F.decode("value", "UTF-8").alias("value"))


@_query(_with("SELECT key, CASE WHEN value_type = 2 THEN 'DELETED' ELSE 'OK' END AS status, CASE WHEN value_type <> 2 THEN CAST(seq AS VARCHAR) END AS value FROM newest WHERE key = (SELECT min(key) FROM log)", True))
def table_point_get(spark, sf_dir):
    """One key's status and value; the least key of the log."""
    key = stored_log(spark, sf_dir).agg(F.min("key")).first()[0]
    status, value = loaded_table(spark, sf_dir).get(bytes(key))
    return spark.createDataFrame([(bytes(key).hex(), status, value and bytes(value).decode())], "key string, status string, value string")


@_query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'new' END AS value FROM orders WHERE o_orderstatus <> 'O'")
def table_put_remove(spark, sf_dir):
    """Orders put without numbers, finished ones put again, open ones removed; the writes' order decides."""
    o, table = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", K.big_endian("o_orderkey").alias("key")), empty_table(spark)
    table.put(o.withColumn("value", K.text_key(F.lit("new"))))
    table.put(o.where("o_orderstatus = 'F'").withColumn("value", K.text_key(F.lit("done"))))
    table.remove(o.where("o_orderstatus = 'O'").select("key"))
    return table.scan().select(K.from_big_endian("key").alias("o_orderkey"), F.decode("value", "UTF-8").alias("value"))


@_query(LIVE_SQL)
def table_replay(spark, sf_dir):
    """The older half is in a run; replaying the whole log adds the rest, once."""
    rows, table = stored_log(spark, sf_dir), empty_table(spark)
    table.append(rows.where(F.col("seq") < half(spark, sf_dir)))
    table.replay(rows)
    table.replay(rows)
    return _shown(table.scan())


def empty_table(spark: SparkSession, **config) -> VersionedTable:
    return VersionedTable.create(spark, f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}", Config(min_merge_width=2, **config))


def _n_orders(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def filled_table(spark: SparkSession, sf_dir: str) -> tuple[VersionedTable, int]:
    """The workloads' table with as many numbered records as there are orders, loaded in four batches."""
    table, n = empty_table(spark), _n_orders(spark, sf_dir)
    workloads.load(table, n, batches=4)
    return table, n


@_query("SELECT substr(md5(CAST(i AS VARCHAR)), 1, 16) || repeat('0', 32) AS key, 100 AS value_bytes FROM range((SELECT count(*) FROM orders)) t(i)")
def workload_load(spark, sf_dir):
    return filled_table(spark, sf_dir)[0].scan().select(F.lower(F.hex("key")).alias("key"), F.length("value").alias("value_bytes"))


@_query("SELECT count(*) AS probes, 0 AS errors FROM orders")
def workload_read(spark, sf_dir):
    return workloads.read_all(*filled_table(spark, sf_dir))


@_query("SELECT count(*) AS reads, 0 AS errors FROM range((SELECT count(*) FROM orders)) t(i) WHERE CAST('0x' || substr(md5(CAST(i AS VARCHAR)), 1, 8) AS BIGINT) % 2 = 1")
def workload_mixed(spark, sf_dir):
    table, n = filled_table(spark, sf_dir)
    return workloads.mixed(table, n, n)


@_query("SELECT * FROM (SELECT substr(md5(CAST(i AS VARCHAR)), 1, 16) || repeat('0', 32) AS key FROM range((SELECT count(*) FROM orders)) t(i)) WHERE key >= '80' ORDER BY key LIMIT 1024")
def workload_range(spark, sf_dir):
    """The middle tier of range scans from the middle of the key space."""
    return workloads.range_scan(filled_table(spark, sf_dir)[0], b"\x80", 1).select(F.lower(F.hex("key")).alias("key"))


@_query("SELECT CAST(i AS BIGINT) AS device, (SELECT count(*) FROM orders) // 100 AS points FROM range(100) t(i)")
def workload_series(spark, sf_dir):
    """A hundred devices' series loaded, then scanned device by device."""
    table = empty_table(spark)
    workloads.load_series(table, 100, _n_orders(spark, sf_dir) // 100)
    return workloads.scan_series(table, spark.range(100).select(F.col("id").alias("device")))


@_query("SELECT 1 AS runs, count(*) AS rows, 1 AS merges FROM orders")
def workload_compaction(spark, sf_dir):
    table, n = empty_table(spark), _n_orders(spark, sf_dir)
    merges = workloads.compaction(table, n, 4)
    return table.run_table().agg(F.countDistinct("run_id").alias("runs"), F.sum("rows").alias("rows")).withColumn("merges", F.lit(len(merges)))


@_query("SELECT count(*) AS probes, count(*) AS deleted FROM orders")
def workload_delete(spark, sf_dir):
    table, n = filled_table(spark, sf_dir)
    workloads.delete_all(table, n)
    found = table.get_many(workloads.records(spark, 0, n).select("key"))
    return found.agg(F.count("*").alias("probes"), F.count_if(F.col("status") == "DELETED").alias("deleted"))


@_query(LIVE_SQL)
def stream_ingest(spark, sf_dir):
    """The log as a stream of four files, ingested batch by batch with compactions on the way."""
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    stored_log(spark, sf_dir).repartition(4).write.parquet(f"{base}/in")
    table = VersionedTable.create(spark, f"{base}/table", Config(min_merge_width=2))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    ingest(table, stream, f"{base}/checkpoint", compact_every=3).trigger(availableNow=True).start().awaitTermination()
    return _shown(table.refresh().scan())


@_query(_with("SELECT key, seq, value_type FROM newest", True))
def stream_newest(spark, sf_dir):
    """The newest version of each key as a streaming aggregate, its changes written batch by batch."""
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    stored_log(spark, sf_dir).repartition(4).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    write_newest(stream, f"{base}/newest", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return read_newest(spark, f"{base}/newest").select(F.lower(F.hex("key")).alias("key"), "seq", F.col("value_type").cast("int").alias("value_type"))
