"""Exact dedup: counting quotient filters find repeated fingerprints, bytes decide.

1. One pass over the texts keeps fingerprint and SHA-256 of the normalised text per row.
2. Each partition builds a counting quotient filter per range of fingerprints; filters of
   a range merge losslessly by their sorted remainders.
3. Only rows whose fingerprint counts more than once are grouped by their whole text, with
   partial sums in each task, so a group of copies reaches the shuffle as one row a task.
4. Each row looks up its group by (fingerprint, SHA-256) in a join that Spark can split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, broadcast_if_small, materialize
from .cqf import CountingQuotientFilter

#: Fingerprints that one merged filter holds, about.
FILTER_SIZE = 1 << 17
LEAST_RANGES = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once in the column fp."""
    bits = max(LEAST_RANGES, -(-rows // FILTER_SIZE)).bit_length()

    def build(batches):
        parts = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches if b.num_rows]
        if not parts:
            return
        all_prints, counts = np.unique(np.concatenate(parts), return_counts=True)
        heads = (all_prints >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(heads)], strict=True):
            one = CountingQuotientFilter.build(all_prints[a:b], bits, counts[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([heads[a]], pa.int64()), pa.array([one.to_bytes()], pa.binary())], ["head", "filter"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x) for x in pdf["filter"]])
        more = whole.counts > 1
        return pd.DataFrame({"fp": whole.fingerprints()[more].view(np.int64), "n": whole.counts[more]})

    filters = prints.select("fp").mapInArrow(build, "head long, filter binary")
    return filters.groupBy("head").applyInPandas(merge, "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space;
    null counts as empty. Of equal texts the row with the smallest id stays; null ids come last. Of rows
    repeated with the same id and text one stays. An empty table gives an empty result; other columns are not read.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("norm")).withColumn("fp", F.xxhash64("norm"))
    slim = materialize(rows.select("doc_id", "fp", F.unhex(F.sha2("norm", 256)).alias("sha")), "dedup-prints")
    repeated = materialize(repeated_fingerprints(slim, slim.count()).select("fp"), "dedup-repeated")
    groups = rows.join(broadcast_if_small(repeated), "fp", "left_semi").groupBy("fp", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size", F.lit(True).alias("found"))
    # The same row twice: counted here, and dealt out again below with one of them kept.
    each = slim.groupBy("doc_id", "fp", "sha").agg(F.count("*").alias("_n"))
    out = each.join(groups, ["fp", "sha"], "left")
    alone = F.col("found").isNull()
    out = out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(alone, F.lit(1)).otherwise(F.col("group_size")).cast("long").alias("group_size"), "sha", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_i"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
