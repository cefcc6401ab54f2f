"""Tables: round trips, versions, deletes, snapshots, compaction, recovery. Expected values are kept in plain dictionaries."""

import random

import pytest
from pyspark.sql import functions as F

from runledger.functions import keys as K
from runledger.operators import stats, versions
from runledger.operators.merge import merge_counts, merge_runs
from runledger.plans import cli, workloads
from runledger.plans.compaction import compact, pick_buckets
from runledger.schema import LOG, Config
from runledger.sources.table import VersionedTable


def entries(spark, rows):
    """rows: (key, seq, value or None for a delete)."""
    return spark.createDataFrame([(bytearray(k), s, 2 if v is None else 1, None if v is None else bytearray(v)) for k, s, v in rows], LOG)


def content(df):
    return {bytes(r["key"]): bytes(r["value"]) for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable.create(spark, f"file://{tmp_path}/t", Config(min_merge_width=2, max_merge_width=4))


def test_put_get_delete(spark, table):
    table.append(entries(spark, [(b"a", 0, b"1"), (b"b", 1, b"2"), (b"b", 2, b"3"), (b"c", 3, b"")]))
    table.append(entries(spark, [(b"a", 4, None), (b"d", 5, b"4")]))
    assert content(table.scan()) == {b"b": b"3", b"c": b"", b"d": b"4"}
    assert table.get(b"a") == ("DELETED", None) and table.get(b"zz") == ("KEY_NOT_FOUND", None)
    status, value = table.get(b"c")
    assert status == "OK" and bytes(value) == b""
    probes = spark.createDataFrame([(bytearray(k),) for k in (b"a", b"b", b"x", b"b")], "key binary")
    assert sorted((bytes(r["key"]), r["status"]) for r in table.get_many(probes).collect()) == [(b"a", "DELETED"), (b"b", "OK"), (b"b", "OK"), (b"x", "KEY_NOT_FOUND")]
    few = versions.get_many(table.log(), probes, few=0)
    assert sorted((bytes(r["key"]), r["status"]) for r in few.collect()) == [(b"a", "DELETED"), (b"b", "OK"), (b"b", "OK"), (b"x", "KEY_NOT_FOUND")]
    assert content(table.scan(snapshot=4)) == {b"a": b"1", b"b": b"3", b"c": b""}


def test_bounds_are_inclusive_and_any_side_may_be_open(spark, table):
    table.append(entries(spark, [(bytes([i]), i, b"v") for i in range(1, 250)]))
    table.append(entries(spark, [(b"\x10", 300, None)]))
    keys = lambda df: [bytes(r["key"]) for r in df.collect()]
    assert keys(table.scan(b"\x0f", b"\x11")) == [b"\x0f", b"\x11"]
    assert keys(table.scan(b"\x10", b"\x12")) == [b"\x11", b"\x12"]
    assert len(keys(table.scan())) == 248 and len(keys(table.scan(b"\xf0"))) == 10 and len(keys(table.scan(upper=b"\x05"))) == 5
    assert keys(table.scan(b"\x20", b"\x1f")) == []
    assert keys(table.scan(b"\x05", scope="partition")) == [bytes([i]) for i in range(5, 16)]
    assert keys(table.seek(b"\x0e", 3)) == [b"\x0e", b"\x0f", b"\x11"]


def test_empty_table(spark, table):
    assert table.scan().count() == 0 and table.get(b"k") == ("KEY_NOT_FOUND", None)
    assert table.append(entries(spark, [])) is None and compact(table, True) == []
    assert table.high_water is None


def test_snapshot_hides_later_versions_of_neighbours(spark):
    log = entries(spark, [(b"a", 1, b"1"), (b"a", 2, b"2"), (b"b", 1, b"old"), (b"b", 9, b"new")])
    assert content(versions.live(log, snapshot=5)) == {b"a": b"2", b"b": b"old"}
    assert content(versions.live(log, snapshot=9)) == {b"a": b"2", b"b": b"old"}
    assert content(versions.live(log, snapshot=10))[b"b"] == b"new"


def test_history_of_random_updates_survives_compactions(spark, table):
    rng, want, seq = random.Random(42), {}, 0
    for round_ in range(5):
        rows = []
        for i in range(300):
            if round_ == 0 or rng.random() < 0.6:
                key, value = f"key{i:04d}".encode(), None if rng.random() < 0.2 else f"{round_}-{i}".encode()
                rows.append((key, seq, value))
                want[key] = value
                seq += 1
        table.append(entries(spark, rows))
    live = {k: v for k, v in want.items() if v is not None}
    assert content(table.scan()) == live
    before = table.runs
    assert compact(table) and content(table.scan()) == live
    compact(table, compact_all=True)
    assert content(VersionedTable.open(spark, table.path).scan()) == live
    assert len(table.runs) == 1 and table.run_table().agg(F.sum("rows")).first()[0] == len(live)
    assert set(table.orphans()) >= {r["run_id"] for r in before}
    table.vacuum()
    assert table.orphans() == [] and content(table.scan()) == live


def test_tombstone_stays_while_an_older_run_is_outside(spark, table):
    for rows in ([(b"k", 0, b"v")], [(b"k", 1, None)], [(b"x", 2, b"y")]):
        table.append(entries(spark, rows))
    table.commit(runs=[{**r, "level": 1 if i == 0 else 0} for i, r in enumerate(table.runs)])
    (report,) = compact(table)
    assert not report["discarded_tombstones"] and content(table.scan()) == {b"x": b"y"}
    (report,) = compact(table, compact_all=True)
    assert report["discarded_tombstones"] and content(table.scan()) == {b"x": b"y"} and table.get(b"k")[0] == "KEY_NOT_FOUND"


def test_old_manifests_stay_readable_while_they_are_kept(spark, table):
    table.append(entries(spark, [(b"a", 0, b"1"), (b"b", 1, b"2")]))
    table.append(entries(spark, [(b"a", 2, b"3"), (b"b", 3, None)]))
    before = table.manifest["version"]
    compact(table, compact_all=True)
    assert table.vacuum(keep=2) == [] and content(VersionedTable.open(spark, table.path, before).scan(snapshot=2)) == {b"a": b"1", b"b": b"2"}
    assert len(table.vacuum()) == 2 and content(table.scan()) == {b"a": b"3"}
    with pytest.raises(FileNotFoundError):
        VersionedTable.open(spark, table.path, before)


def test_a_run_between_cuts_a_bucket(spark, table):
    for i in range(5):
        table.append(entries(spark, [(b"k%d" % i, i, b"v")]))
    table.commit(runs=[{**r, "level": int(i == 2)} for i, r in enumerate(table.runs)])
    reports = compact(table)
    assert [len(r["inputs"]) for r in reports] == [2, 2] and len(table.runs) == 3 and table.scan().count() == 5
    table.commit(runs=[{**r, "level": i % 2} for i, r in enumerate(table.runs)])
    assert all("skipped" in r for r in compact(table)) and table.scan().count() == 5


def test_merges_are_recorded(spark, table):
    for i in range(3):
        table.append(entries(spark, [(b"k", 2 * i, b"v"), (b"x%d" % i, 2 * i + 1, b"w")]))
    compact(table)
    (job,) = table.jobs().collect()
    assert (job["level"], job["items"]) == (1, 6) and job["bytes"] > 0 and job["end"] > job["start"]
    (row,) = stats.level_stats(table.jobs()).collect()
    assert row["items"] == 6 and row["compactions"] == 1 and row["mean_rate"] > 0
    assert stats.idle_time(table.jobs()).first()["idle"] == 0
    assert stats.tree_stats(table.run_table()).first()["total_size"] > 0


@pytest.mark.parametrize(("exponent", "share"), [(0, 0.5), (1, 0.01), (4, 1.0), (10, 0.5)])
def test_partition_exponents_and_delete_shares(spark, tmp_path, exponent, share):
    rng = random.Random(exponent)
    table = VersionedTable.create(spark, f"file://{tmp_path}/{exponent}-{share}", Config(partition_exponent=exponent, min_merge_width=2))
    keys = sorted(rng.randbytes(16) for _ in range(100))
    table.append(entries(spark, [(k, i, k) for i, k in enumerate(keys)]))
    gone = set(keys[: int(100 * share)])
    table.append(entries(spark, [(k, 100 + i, None) for i, k in enumerate(sorted(gone))]))
    want = {k: k for k in keys if k not in gone}
    assert content(table.scan()) == want
    low, high = keys[20], keys[80]
    assert content(table.scan(low, high)) == {k: k for k in want if low <= k <= high}
    assert content(table.scan(low, scope="partition")) == {k: k for k in want if k >= low and K.partition_of(k, exponent) == K.partition_of(low, exponent)}
    compact(table, compact_all=True)
    assert content(table.scan()) == want and (table.runs == []) == (share == 1.0)


def test_few_probes_read_few_ranges(spark, table):
    table.append(entries(spark, [(bytes([i, 1]), i, b"v") for i in range(200)]))
    found = table.get_many(spark.createDataFrame([(bytearray(b"\x21\x01"),), (bytearray(b"\x25"),), (None,)], "key binary"))
    assert sorted((r["key"] and bytes(r["key"]), r["status"]) for r in found.collect() if r["key"]) == [(b"\x21\x01", "OK"), (b"\x25", "KEY_NOT_FOUND")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partition_id" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_run_order_where_runs_number_their_own_entries(spark):
    rows = [(b"k", 7, 10, b"old"), (b"k", 7, 20, b"new"), (b"m", 9, 10, b"old"), (b"m", 1, 20, b"new")]
    runs = spark.createDataFrame([(bytearray(k), s, e, 1, bytearray(v)) for k, s, e, v in rows], "key binary, seq long, epoch long, value_type int, value binary")
    assert content(merge_runs(runs)) == {b"k": b"new", b"m": b"old"}
    assert content(merge_runs(runs, order=("epoch", "seq"))) == {b"k": b"new", b"m": b"new"}
    assert tuple(merge_counts(runs).first()) == (4, 2, 2, 0)


def test_merge_of_deletes_only_leaves_no_run(spark, table):
    table.append(entries(spark, [(b"a", 0, None)]))
    table.append(entries(spark, [(b"b", 1, None)]))
    (report,) = compact(table, compact_all=True)
    assert report["output"] is None and table.runs == [] and table.scan().count() == 0


def test_pick_buckets():
    runs = [{"epoch": e, "level": 0 if e > 4 else 1} for e in range(12)]
    assert [[r["epoch"] for r in b] for b in pick_buckets(runs, 2, 4)] == [[5, 6, 7, 8], [9, 10, 11], [0, 1, 2, 3]]
    assert pick_buckets(runs[:1], 2, 4) == []


def test_replay_takes_only_what_no_run_holds(spark, table):
    log = entries(spark, [(f"k{i}".encode(), i, b"v") for i in range(10)])
    assert content(table.scan()) == {}
    table.replay(log.where("seq = 0"))
    assert content(table.scan()) == {b"k0": b"v"}
    table.replay(log)
    assert len(content(table.scan())) == 10 and table.replay(log) is None
    assert table.next_seq == 10


def test_numbers_are_dense_and_writes_without_seq_win_in_order(spark, table):
    table.put(workloads.records(spark, 0, 1000))
    table.put(workloads.records(spark, 0, 1000, salt=1))
    assert table.next_seq == 2000
    want = content(workloads.records(spark, 0, 1000, salt=1))
    assert content(table.scan()) == want
    assert [bytes(r["key"]) for r in table.scan().collect()] == sorted(want)


def test_workloads(spark, table):
    workloads.load(table, 500, batches=2)
    assert tuple(workloads.read_all(table, 500).first()) == (500, 0)
    assert workloads.read_all(table, 520).first()["errors"] == 20
    reads, errors = workloads.mixed(table, 500, 200).first()
    assert errors == 0 and 60 < reads < 140 and table.scan().count() == 500 + 200 - reads
    workloads.delete_all(table, 500)
    assert table.scan().count() == 200 - reads


def test_series(spark, table):
    workloads.load_series(table, 7, 30)
    devices = spark.createDataFrame([(i,) for i in range(9)], "device long")
    assert {tuple(r) for r in workloads.scan_series(table, devices).collect()} == {(i, 30) for i in range(7)}
    low, high = spark.range(1).select(K.series_key(F.lit(3), F.lit(10)), K.series_key(F.lit(3), F.lit(19))).first()
    keys = [bytes(r["key"])[16:] for r in table.scan(bytes(low), bytes(high)).collect()]
    assert keys == [i.to_bytes(8, "big") for i in range(10, 20)]


def test_bad_input(spark, table, tmp_path):
    with pytest.raises(Exception, match="keys have 1 to 256 bytes"):
        table.append(entries(spark, [(b"", 0, b"v")]))
    with pytest.raises(FileExistsError):
        VersionedTable.create(spark, table.path)
    with pytest.raises(FileNotFoundError):
        VersionedTable.open(spark, f"file://{tmp_path}/none")
    with pytest.raises(ValueError):
        Config(partition_exponent=17)
    with pytest.raises(ValueError):
        Config(min_merge_width=1)


def test_short_keys_and_partitions(spark):
    df = spark.createDataFrame([(bytearray(k),) for k in (b"\0", b"a", b"\xff", b"\x0f\xff", b"\x10\0", b"\xff\xff\xff")], "key binary")
    got = [r[0] for r in df.select(K.partition_id("key")).collect()]
    assert got == [4095, 28671, 65535, 4095, 8191, 65535]
    assert got == [K.partition_of(k) for k in (b"\0", b"a", b"\xff", b"\x0f\xff", b"\x10\0", b"\xff\xff\xff")]
    assert {r[0] for r in df.select(K.partition_id("key", 0)).collect()} == {65535}


def test_pruning_reaches_the_scan(spark, table):
    table.append(entries(spark, [(bytes([i, 1]), i, b"v") for i in range(200)]))
    plan = table.log(b"\x20", b"\x21").where(F.col("key") >= F.lit(bytearray(b"\x20")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition_id" in plan and "GreaterThanOrEqual(key" in plan


@pytest.mark.parametrize("mode", cli.MODES)
def test_workload_modes(spark, tmp_path, mode):
    got = cli.run(spark, mode, f"file://{tmp_path}/w", records=400, devices=10, batches=2, starts=2)
    assert got["ops_per_s"] > 0
    table = VersionedTable.open(spark, f"file://{tmp_path}/w")
    left = {"load": 400, "read": 400, "range": 400, "timeseries": 400, "range_timeseries": 400, "compaction": 400, "delete": 0}
    if mode == "rw":
        assert got["errors"] == 0 and table.scan().count() == 800 - got["reads"]
    else:
        assert table.scan().count() == left[mode]
    if mode == "range_timeseries":
        assert (got["scans"], got["points"]) == (10, 400)
    if mode == "compaction":
        assert got["merges"] == 1 and len(table.runs) == 1
    if mode == "range":
        assert got["tier_0"] == 200 and got["tier_1"] == got["tier_2"] > 400


def test_tasks_read_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    """Files are cut by bytes, and sorted keys take few: a run's rows must not all meet in one task's sort."""
    monkeypatch.setattr(versions, "TASK_ROWS", 100, raising=False)
    t = VersionedTable.create(spark, str(tmp_path / "t"))
    rows = spark.range(2000).select(F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("key"), F.lit("v").cast("binary").alias("value"))
    run = t.put(rows.coalesce(1))
    log = t.log()
    assert log.rdd.getNumPartitions() >= 20 and max(map(len, log.select("seq").rdd.glom().collect())) < 400
    assert [bytes(r["key"]) for r in t.scan().collect()] == [i.to_bytes(8, "big") for i in range(2000)]
    (part,) = run["parts"].values()
    assert (part["rows"], part["min_key"], part["max_key"], run["min_seq"], run["max_seq"]) == (2000, "%016X" % 0, "%016X" % 1999, 0, 1999)
