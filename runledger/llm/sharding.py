"""Sharding by histogram sort.

Rows have a 62-bit sort key: 31 bits of the text's hash, then 31 bits of the id's, so equal
texts lie together and a hot group of copies can still be cut. Splitters are found by
rounds: each round counts exact bytes in the 64 cells of every splitter's interval, in one
pass over the slim (key, size) table, and narrows the interval to the cell that holds
the wanted byte position, till a cell border is near enough. Then rows move once: to (shard, run), a run being a
stretch of the shard's id hashes, in which they are numbered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, hash60, materialize

KEY_BITS = 62
#: Bits of the key that the rounds resolve in turn; the first five end at the text's hash.
ROUNDS = (6, 6, 6, 6, 7, 6, 6, 6, 6, 7)


@dataclass
class Splitter:
    want: float  # bytes that should lie below
    low: int = 0  # the interval [low, low + 2^(bits not yet resolved))
    below: int = 0  # exact bytes below low
    inside: int = 0  # exact bytes in the interval
    at: int | None = None  # the splitter, once found


def find_splitters(rows: DataFrame, shards: int, tolerance: float) -> list[int]:
    """Keys that cut rows (key, size) into shards of nearly equal bytes; rows is read once a round.

    The driver gets at most 128 sums for each of the shards - 1 splitters in a round.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    near = tolerance * total / shards
    splitters = [Splitter(total * i / shards, inside=total) for i in range(1, shards)]
    left = KEY_BITS
    for bits in ROUNDS:
        todo = [s for s in splitters if s.at is None]
        if not todo:
            break
        width, left = left, left - bits
        lows = sorted({s.low for s in todo})
        here = F.col("key").bitwiseAND(F.lit(-1 << width))  # start of the interval of this width with the key
        cells = rows.where(here.isin(lows)) if width < KEY_BITS else rows
        cells = cells.groupBy(F.shiftright("key", left).alias("cell")).agg(F.sum("size").alias("b")).collect()
        by_low: dict[int, list[tuple[int, int]]] = {}
        for cell, b in sorted(map(tuple, cells)):
            by_low.setdefault((cell << left) >> width << width, []).append((cell << left, b))
        for s in todo:
            low, below, inside = s.low, s.below, 0
            for start, b in by_low.get(s.low, []):
                if below + b >= s.want:
                    low, inside = start, b
                    break
                below += b
            s.low, s.below, s.inside = low, below, inside
            down, up = s.want - s.below, s.below + s.inside - s.want
            if min(down, up) <= near or left == 0 or not inside:
                s.at = s.low if down <= up else s.low + (1 << left)
    return sorted(s.at for s in splitters)


#: Bits of the id's hash that make a shard's runs: so many tasks can share a shard.
RUN_BITS = 12


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with _size, _crc and _key."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    key = F.shiftleft(F.shiftright(hash60(F.md5(text)), 29), 31).bitwiseOR(F.shiftright(hash60(F.col(id_col)), 29))
    return docs.select("*", (F.octet_length(text) + 8).cast("long").alias("_size"), F.crc32(text).alias("_crc"), key.alias("_key"))


def place(key: Column, cuts: list[int]) -> Column:
    """The key's shard: its place among the splitters, by halving."""
    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(cuts[mid]), half(lo, mid)).otherwise(half(mid + 1, hi))

    return half(0, len(cuts)).cast("int")


def exchange(rows: DataFrame, keys: DataFrame, cuts: list[int], order: list[str]) -> DataFrame:
    """rows (with _key) with shard and slot, in the one exchange of whole rows: by shard and run.

    keys: the slim table (key) of the same rows, from which each run's first slot is counted. A slot follows the id's hash
    in its shard; the key itself would lay a hot group's rows side by side.
    """
    run = lambda key: F.shiftright(key.bitwiseAND(F.lit((1 << 31) - 1)), 31 - RUN_BITS).cast("int")
    sizes = keys.groupBy(place(F.col("key"), cuts).alias("shard"), run(F.col("key")).alias("_run")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("shard").orderBy("_run").rowsBetween(W.unboundedPreceding, -1))
    firsts = sizes.select("shard", "_run", F.coalesce(before, F.lit(0)).alias("_first"))  # 4,096 rows a shard at most
    dealt = rows.withColumn("shard", place(F.col("_key"), cuts)).withColumn("_run", run(F.col("_key"))).join(F.broadcast(firsts) if (len(cuts) + 1) << RUN_BITS <= BROADCAST_ROWS else firsts, ["shard", "_run"])
    inside = W.partitionBy("shard", "_run").orderBy(F.col("_key").bitwiseAND(F.lit((1 << 31) - 1)), "_key", *order)
    return dealt.withColumn("slot", F.col("_first") + F.row_number().over(inside) - 1).drop("_run", "_first")


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, key.

    size is the text's UTF-8 bytes plus 8, null having none. Shards are ranges of the key with
    nearly equal bytes; slot numbers a shard's rows from 0 without gaps, by the id's hash.
    Repeated rows each get a slot; a null id is hashed as empty; an empty table gives an empty
    result; other columns are not read.
    """
    rows = with_keys(docs.select(id_col, text_col), id_col, text_col).select(F.col(id_col).alias("doc_id"), "_size", "_crc", "_key")
    rows = materialize(rows, "shard-keys")
    keys = rows.select(F.col("_key").alias("key"), F.col("_size").alias("size"))
    placed = exchange(rows, keys, find_splitters(keys, shards, tolerance), ["doc_id", "_size"])
    return placed.select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", "slot", F.col("_key").alias("key"))


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001) -> None:
    """Write the documents, all columns and rows as they are, as folders shard=0.., each file sorted by slot.

    Null and repeated ids are rows like others. Columns of docs named shard, slot, _key, _size, _crc, _run or _first are replaced or dropped.
    """
    whole = docs.drop("shard", "slot", "_key", "_size", "_crc", "_run", "_first")
    keys = with_keys(whole.select(id_col, text_col), id_col, text_col).select(F.col("_key").alias("key"), F.col("_size").alias("size"))
    keys = materialize(keys, "shard-keys")
    placed = exchange(with_keys(whole, id_col, text_col), keys, find_splitters(keys, shards, tolerance), ["_size"])
    placed.drop("_key", "_size", "_crc").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
