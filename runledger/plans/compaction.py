"""Compaction: which runs to merge, merging them in one job a bucket, and swapping them in the manifest."""

from __future__ import annotations

import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..operators.merge import can_discard, merge_runs
from ..sources.table import VersionedTable


def pick_buckets(runs: list[dict], least: int, most: int) -> list[list[dict]]:
    """Groups of neighbouring runs, by epoch, of one level; each has from least to most runs."""
    out: list[list[dict]] = []
    by_level: dict[int, list[dict]] = {}
    for r in sorted(runs, key=lambda r: r["epoch"]):
        by_level.setdefault(r["level"], []).append(r)
    for level in sorted(by_level):
        row = by_level[level]
        for a in range(0, len(row), most):
            if len(row[a : a + most]) >= least:
                out.append(row[a : a + most])
    return out


def cut_at_strangers(runs: list[dict], bucket: list[dict]) -> list[list[dict]]:
    """The bucket's parts between which no run outside it lies."""
    parts: list[list[dict]] = []
    for r in sorted(bucket, key=lambda r: r["epoch"]):
        if parts and not between(runs, [parts[-1][-1], r]):
            parts[-1].append(r)
        else:
            parts.append([r])
    return parts


def between(runs: list[dict], bucket: list[dict]) -> bool:
    """Does a run outside the bucket lie between its epochs? Then merging would break the order of runs."""
    low, high = min(r["epoch"] for r in bucket), max(r["epoch"] for r in bucket)
    inside = {r["run_id"] for r in bucket}
    return any(low < r["epoch"] < high and r["run_id"] not in inside for r in runs)


def compact(table: VersionedTable, compact_all: bool = False, keep_tombstones: bool = False) -> list[dict]:
    """Merge runs and commit. compact_all merges all runs into one; else buckets of the configured widths.

    Tombstones go where no older entry stays outside; keep_tombstones keeps all, for sources whose entries may
    still arrive after newer ones. The merged run has its inputs' least epoch and
    their level plus one. Returns a report for each bucket; a bucket with a foreign run between its own is cut there, and what is left
    over alone is reported as skipped. The manifest keeps each merge's level, bytes, items, start and end (table.jobs()).
    Replaced files stay till vacuum().
    """
    c = table.config
    buckets = [table.runs] if compact_all and len(table.runs) > 1 else [] if compact_all else pick_buckets(table.runs, c.min_merge_width, c.max_merge_width)
    reports = []
    for bucket in [part for b in buckets for part in cut_at_strangers(table.runs, b)]:
        ids = {r["run_id"] for r in bucket}
        if len(bucket) < 2:
            reports.append({"inputs": sorted(ids), "skipped": "a run of another level lies between"})
            continue
        outside = [r for r in table.runs if r["run_id"] not in ids]
        discard = not keep_tombstones and can_discard([r["min_seq"] for r in outside], max(r["max_seq"] for r in bucket))
        level = min(max(r["level"] for r in bucket) + 1, c.max_levels - 1)
        began = time.time()
        rows, seen = merge_runs(table.log(runs=bucket), discard).select("key", "seq", "value_type", "value"), Observation()
        merged = table.write_run(rows.observe(seen, F.count("*").alias("n")), level, min(r["epoch"] for r in bucket))
        count = lambda r: sum(p["rows"] for p in r["parts"].values())
        report = {"inputs": sorted(ids), "output": merged["run_id"] if merged else None, "level": level, "discarded_tombstones": discard, "rows_in": sum(map(count, bucket)), "rows_out": count(merged) if merged else 0}
        if merged and not report["rows_out"] == seen.get["n"] <= report["rows_in"]:  # of an empty result nothing is observed
            raise RuntimeError(f"merge wrote {report['rows_out']} of {seen.get['n']} rows, from {report['rows_in']}")
        size = sum(p["bytes"] for r in bucket for p in r["parts"].values())
        job = {"level": level, "bytes": size, "items": report["rows_in"], "start": began, "end": time.time()}
        table.commit(runs=sorted([*outside, *([merged] if merged else [])], key=lambda r: r["epoch"]), jobs=[*table.manifest.get("jobs", []), job])
        reports.append(report)
    return reports
