"""Merging runs: one row for each key, the newest by seq; of equal ones that of the newest run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LIVE_EPOCH, TOMBSTONE
from .versions import newest


def union_runs(runs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), runs)


def with_live(runs: DataFrame, memory: DataFrame) -> DataFrame:
    """Runs with entries that are in none yet; those are newer than all runs."""
    return runs.unionByName(memory.withColumn("epoch", F.lit(LIVE_EPOCH)), allowMissingColumns=True)


def merge_runs(runs: DataFrame, discard_deleted: bool = False, order: tuple[str, ...] = ("seq", "epoch")) -> DataFrame:
    """Merge rows of several runs (key, seq, epoch, value_type, ...) into one run.

    discard_deleted drops tombstones; that is right only if no older entry of the range stays outside. Where runs number
    their entries each for itself, order=("epoch", "seq") lets the newer run win.
    """
    out = newest(runs, order=order)
    return out.where(F.col("value_type") != TOMBSTONE) if discard_deleted else out


def merged_epoch(runs: DataFrame) -> DataFrame:
    """One row: the epoch that a merged run gets, which is the oldest of its inputs', and its highest seq."""
    return runs.agg(F.min("epoch").alias("epoch"), F.max("seq").alias("max_seq"))


def merge_counts(runs: DataFrame, discard_deleted: bool = False) -> DataFrame:
    """One row: rows read, rows written, rows hidden by newer ones, rows filtered; read is the sum of the others."""
    newest_type = F.max_by("value_type", F.struct("seq", "epoch"))
    per_key = runs.groupBy("key").agg(F.count("*").alias("n"), newest_type.alias("value_type"))
    gone = F.count_if((F.col("value_type") == TOMBSTONE) & F.lit(discard_deleted))
    return per_key.agg(F.sum("n").alias("rows_in"), (F.count("*") - gone).alias("rows_out"), (F.sum("n") - F.count("*")).alias("superseded"), gone.alias("filtered"))


def can_discard(first_seq_outside: list[int], last_seq_inside: int) -> bool:
    """Tombstones of a merge may go only if every run outside it begins after all of it."""
    return all(s > last_seq_inside for s in first_seq_outside)
