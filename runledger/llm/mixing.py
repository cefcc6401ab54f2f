"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Each source's documents are shuffled by hash and laid end to end; the line of
words, repeated as often as needed, is cut into blocks of equal length. Slot i of the
schedule takes the golden-ratio point frac((i + 1) * phi), finds the source whose stretch
of the cumulative target weights holds it, and is given the next block of that
source. A source gets as many blocks as points fall into its stretch, which is its target but for the
points' discrepancy of a few blocks; a document's share is what the scheduled blocks cover of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hash60, materialize, n_words, running_sum

#: Words of a block at most, and slots that a schedule has at least, so that a few blocks are little of a small corpus too.
BLOCK_WORDS, LEAST_SLOTS = 8192, 1 << 14
MAX_REPEATS = 3
#: The golden ratio's fraction, and that of 2^20 times it: the slot's number is split so that no bits are lost.
PHI, PHI_20 = 0.6180339887498949, 0.607787409740351
#: Stretches of the line of weights that slots and sources meet in, at least; with more slots a cell has so many of them.
CELLS, CELL_SLOTS = 4096, 1 << 18


def source_key(source: Column) -> Column:
    """A key that sorts by code point with null last, and joins null with null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """sizes with rank, from 0, by skey. The sort spreads over tasks; the one window has a row for each of its tasks."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    t = materialize(sizes.orderBy("skey").withColumn("_part", F.spark_partition_id()).withColumn("_row", place), "mix-order")
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = t.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_first"))
    return t.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_first") + F.col("_row")).drop("_part", "_row", "_first")


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """skey, source_size, rank, target from one row (skey, source_size) per source.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of
    all sizes; no target exceeds max_repeats times its source's size, what is over being
    shared again by weight. Each round sums caps and weights anew, till no more sources are capped.
    """
    t = ranked_sources(sizes).withColumn("_w", F.pmod("rank", F.lit(3)) + 1).withColumn("_cap", F.col("source_size") * max_repeats)
    t = materialize(t, "mix-weights")
    total, weights = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    level, capped = float(total) / max(1, weights), -1
    while True:
        over = F.col("_cap") <= F.col("_w") * F.lit(level)
        n, caps, left = t.agg(F.count_if(over), F.sum(F.when(over, F.col("_cap")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("_w")))).first()
        if n == capped or not left:
            break
        level, capped = float(total - caps) / left, n
    return t.select("skey", "source_size", "rank", F.least(F.col("_cap").cast("double"), F.col("_w") * F.lit(level)).alias("target"))


def points(slot: Column) -> Column:
    """frac((slot + 1) * phi)."""
    i = slot + 1
    return F.pmod(F.shiftright(i, 20) * F.lit(PHI_20) + i.bitwiseAND((1 << 20) - 1) * F.lit(PHI), F.lit(1.0))


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """(skey, block, slot): which block of which source each slot takes. Both tables are read in cells of the line of weights."""
    spark = targets.sparkSession
    t = targets.select("skey", "rank", F.floor("target").cast("long").alias("_t")).where("_t > 0")
    total, most = t.agg(F.sum("_t"), F.max("rank")).first()
    total, most = total or 0, most or 0
    n = -(-total // block_words)
    cells = max(CELLS, n // CELL_SLOTS)
    width = -(-total // cells) or 1
    t = running_sum(t.withColumn("_all", F.lit(0)), ["_all"], "rank", [], F.col("_t"), "_lo", max(20, int(most).bit_length()))
    cell = lambda c: F.floor(c / F.lit(width)).cast("long")
    begin = F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_lo") + F.col("_t") - 1)))
    begin = t.select("skey", "_lo", begin.alias("_cell")).select("_cell", F.greatest("_lo", F.col("_cell") * width).alias("_p"), F.lit(-1).cast("long").alias("slot"), "skey")
    slots = spark.range(n).select(F.col("id").alias("slot"), F.floor(points(F.col("id")) * F.lit(float(total))).cast("long").alias("_p"))
    slots = slots.select(cell(F.col("_p")).alias("_cell"), "_p", "slot", F.lit(None).cast("string").alias("skey"))
    # A slot belongs to the last source that begins in its cell at its point or before.
    found = F.last("skey", ignorenulls=True).over(W.partitionBy("_cell").orderBy("_p", "slot").rowsBetween(W.unboundedPreceding, 0))
    slots = begin.unionByName(slots).withColumn("skey", found).where("slot >= 0").select("skey", "slot")
    return running_sum(slots, ["skey"], "slot", [], F.lit(1), "block", max(20, int(n).bit_length()))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per document: doc_id, size, skey, source_size, target, taken, slot.

    taken counts the words that the mix takes of the document, repeats included; slot is the first slot that takes any, or
    null. Each source's sum is near its target (a few blocks off); no document exceeds max_repeats times its size.
    Null or empty texts have size 0 and are taken 0; a null source is a source; of repeated
    rows each counts; an empty table gives an empty result. Other columns are not read.
    block_words: words of a block; BLOCK_WORDS, or less where that would leave fewer than LEAST_SLOTS slots.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), source_key(F.col(source_col)).alias("skey"), n_words(F.col(text_col)).alias("size"))
    d = materialize(d.withColumn("_h", hash60(F.col("doc_id"))), "mix-sizes")
    targets = materialize(source_targets(d.groupBy("skey").agg(F.sum("size").alias("source_size")), max_repeats), "mix-sources")
    if block_words is None:
        block_words = max(1, min(BLOCK_WORDS, (targets.agg(F.sum(F.floor("target"))).first()[0] or 0) // LEAST_SLOTS))
    plan = materialize(schedule(targets, block_words), "mix-plan")
    known = targets.join(plan.groupBy("skey").agg(F.count("*").alias("_blocks")), "skey", "left")
    upto = F.least(F.coalesce("_blocks", F.lit(0)) * block_words, F.col("source_size") * max_repeats)
    known = materialize(known.select("skey", "source_size", "target", upto.alias("_upto")), "mix-known")
    laid = running_sum(d, ["skey"], "_h", ["doc_id", "size"], F.col("size"), "start").join(known, "skey").drop("_h")
    # A document shows up once in each pass over its source; each time it spans one or more blocks.
    passes = F.filter(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda i: (F.col("size") > 0) & (F.col("start") + i * F.col("source_size") < F.col("_upto")))
    seen = laid.select("*", F.explode_outer(passes).alias("_pass")).withColumn("_from", F.col("start") + F.col("_pass") * F.col("source_size"))
    seen = seen.withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("_upto")))
    blocks = F.sequence(F.floor(F.col("_from") / block_words), F.floor((F.col("_to") - 1) / block_words))
    seen = seen.select("doc_id", "skey", "size", "source_size", "target", "start", "_from", "_to", F.explode_outer(blocks).alias("block"))
    begin = F.col("block") * block_words
    words = F.least(F.col("_to"), begin + block_words) - F.greatest(F.col("_from"), begin)
    got = seen.join(plan, ["skey", "block"], "left").groupBy("doc_id", "skey", "size", "source_size", "target", "start", F.when(F.col("size") == 0, F.lit(0)).alias("_none"))
    out = got.agg(F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), words)), F.lit(0)).alias("taken"), F.min("slot").alias("slot"), F.count_if(F.col("block").isNull()).alias("_rows"))
    # Rows without words share their place in the line: each comes back as often as it was there.
    times = F.when(F.col("size") == 0, F.col("_rows")).otherwise(F.lit(1))
    return out.select("doc_id", "size", "skey", "source_size", "target", "taken", "slot", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long"))).alias("_i")).drop("_i")
