"""A corpus pipeline: documents in, encoded documents out. Each stage reads what the one before it wrote.

quality classifier (rejected documents go) -> exact dedup (one of equal texts stays) -> MinHash near-dedup (one
document of each group stays) -> mixing sources to target weights (documents are left out or repeated) ->
BPE encoding and decoding (digests of the codes).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.bpe import bpe_digests
from runledger.llm.classifier import accepted
from runledger.llm.common import broadcast_if_small, materialize, scratch_dir, table
from runledger.llm.exact_dedup import exact_dedup, normalised
from runledger.llm.mixing import mix
from runledger.llm.near_dedup import near_dedup
from runledger.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _drop(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """docs without those that decisions (doc_id, kept) drop. Rows that share a doc_id stay if one of them does."""
    gone = decisions.groupBy(F.col("doc_id").alias("_id")).agg(F.max("kept").alias("kept")).where("NOT kept").select("_id")
    gone = broadcast_if_small(materialize(gone, "pipeline-dropped"))
    return docs.select(*COLUMNS).join(gone, docs["doc_id"].eqNullSafe(gone["_id"]), "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier predicts 1 for."""
    return accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of equal texts; of the same row twice, one."""
    decisions = materialize(exact_dedup(docs), "pipeline-exact")
    out = _drop(docs, decisions)
    twice = decisions.groupBy(F.col("doc_id").alias("_id"), "text_sha256").agg(F.count("*").alias("n")).where("n > 1").select("_id").distinct()
    twice = materialize(twice, "pipeline-twice")
    if twice.isEmpty():
        return out
    same = out["doc_id"].eqNullSafe(twice["_id"])
    one = out.join(twice, same, "left_semi").withColumn("_text", normalised(F.col("text"))).dropDuplicates(["doc_id", "_text"])
    return out.join(twice, same, "left_anti").unionByName(one.drop("_text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each near-duplicate class."""
    return _drop(docs, near_dedup(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each document as often as the mix takes it: its words taken over its size, rounded; of what is taken at all, once at least."""
    times = F.when(F.col("taken") > 0, F.greatest(F.lit(1), F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")))
    taken = mix(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.max(times).alias("_times")).where("_times IS NOT NULL")
    taken = broadcast_if_small(materialize(taken, "pipeline-times"))
    out = docs.select(*COLUMNS).join(taken, docs["doc_id"].eqNullSafe(taken["_id"]))
    return out.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_i")).drop("_i")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of codes and decoded text for each document."""
    return bpe_digests(docs, vocabulary())


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The trained classifier can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the documents are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
