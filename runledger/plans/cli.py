"""python -m runledger.plans.cli MODE --path PATH [--records N]: run one workload on a table and print its rates as JSON."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..schema import Config
from ..sources.scratch import scratch_dir
from ..sources.table import VersionedTable
from . import workloads

MODES = ("load", "read", "rw", "range", "timeseries", "range_timeseries", "compaction", "delete")
VALUE_BYTES, KEY_BYTES = 100, 24


def run(spark: SparkSession, mode: str, path: str | None = None, records: int = 100_000, devices: int = 100, batches: int = 4, starts: int = 3) -> dict:
    """Fill a table as the mode needs it, time the mode itself, and report operations and MB per second."""
    path = path or f"{scratch_dir(spark)}/workload-{mode}-{time.time_ns()}"
    try:
        table = VersionedTable.open(spark, path)
    except FileNotFoundError:
        table = VersionedTable.create(spark, path, Config(min_merge_width=2))
    fresh = table.high_water is None
    if fresh and mode in ("read", "rw", "range", "delete"):
        workloads.load(table, records, batches)
    if fresh and mode == "range_timeseries":
        workloads.load_series(table, devices, records // devices)
    ids = spark.range(devices).select(F.col("id").alias("device"))
    began, more, ops = time.perf_counter(), {}, records
    if mode == "load":
        workloads.load(table, records, batches)
    elif mode == "timeseries":
        workloads.load_series(table, devices, records // devices)
    elif mode == "compaction":
        more["merges"] = len(workloads.compaction(table, records, batches))
    elif mode == "read":
        more = workloads.read_all(table, records).first().asDict()
    elif mode == "rw":
        more = workloads.mixed(table, records, records).first().asDict()
    elif mode == "delete":
        workloads.delete_all(table, records)
    elif mode == "range":
        # Entries read in each tier from evenly spread starts.
        tiers = range(len(workloads.RANGE_TIERS))
        more = {f"tier_{t}": sum(workloads.range_scan(table, bytes([256 * i // starts]) + bytes(7), t).count() for i in range(starts)) for t in tiers}
        ops = sum(more.values())
    elif mode == "range_timeseries":
        more = workloads.scan_series(table, ids).agg(F.count("*").alias("scans"), F.sum("points").alias("points")).first().asDict()
        ops = more["points"] or 0
    else:
        raise ValueError(f"unknown mode {mode}")
    seconds = time.perf_counter() - began
    return {"mode": mode, "seconds": round(seconds, 3), "ops_per_s": round(ops / seconds), "mb_per_s": round(ops * (VALUE_BYTES + KEY_BYTES) / 1e6 / seconds, 3), **more}


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("mode", choices=MODES)
    p.add_argument("--path")
    p.add_argument("--records", type=int, default=100_000)
    p.add_argument("--devices", type=int, default=100)
    a = p.parse_args()
    spark = SparkSession.builder.appName("workload").getOrCreate()
    print(json.dumps(run(spark, a.mode, a.path, a.records, a.devices)))


if __name__ == "__main__":
    main()
