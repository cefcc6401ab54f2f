"""The data model: a multi-version change log of byte-string keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Codes of value_type.
POINTER, INLINE, TOMBSTONE = 0, 1, 2
#: Epoch of rows that are in no run yet.
LIVE_EPOCH = (1 << 63) - 1
MAX_KEY_BYTES = 256

LOG = T.StructType([
    T.StructField("key", T.BinaryType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("value_type", T.ByteType(), False),
    T.StructField("value", T.BinaryType(), True),
])

#: A log as it lies in runs, and with what a run's place adds.
RUN = T.StructType([*LOG.fields, T.StructField("partition_id", T.IntegerType(), True)])
STORED = T.StructType([*RUN.fields, T.StructField("run", T.StringType(), True)])
PLACED = T.StructType([*RUN.fields, T.StructField("epoch", T.LongType(), True), T.StructField("level", T.IntegerType(), True)])

#: A pointer to a value kept elsewhere, for key-value separation.
POINTER_TYPE = T.StructType([T.StructField(n, t, False) for n, t in (("offset", T.LongType()), ("size", T.LongType()), ("table_id", T.LongType()), ("deleted", T.BooleanType()))])


@dataclass(frozen=True)
class Config:
    """Settings of a table.

    partition_exponent: the key space is cut into 2^exponent ranges by the first two key bytes.
    min_merge_width, max_merge_width: how many neighbouring runs a compaction takes.
    max_levels: the level from which merged runs stay where they are.
    """

    partition_exponent: int = 4
    min_merge_width: int = 8
    max_merge_width: int = 32
    max_levels: int = 40
    bloom_filter_keys: int = 0

    def __post_init__(self) -> None:
        if not 0 <= self.partition_exponent <= 16:
            raise ValueError("partition_exponent must be 0 to 16")
        if not 2 <= self.min_merge_width <= self.max_merge_width:
            raise ValueError("merge widths must be 2 or more, the least not above the most")
        if self.max_levels < 1:
            raise ValueError("max_levels must be 1 or more")
