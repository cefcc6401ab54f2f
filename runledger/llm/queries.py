"""The queries of the corpus operators, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_digests
from .classifier import classify
from .common import table
from .exact_dedup import exact_dedup
from .html_text import extract_main_text
from .mixing import mix
from .near_dedup import near_dedup
from .quality_rules import quality_rules
from .sharding import shard_by_bytes
from .substring_dedup import dedup_substrings
from .warc import archive_pages


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "slot")


def op2_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_pages(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """The public vocabulary file that the queries encode with; it lies at one path on all machines."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary())


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_shard_documents": op2_shard_documents,
    "op3_html_text": op3_html_text,
    "op4_warc": op4_warc,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_bpe": op10_bpe,
}

ORACLE_SQL = {
    "op1_mix_sources": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size / w AS ratio, sum(source_size) OVER ()::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, w * max(lev) OVER ()) AS target FROM l),
c AS (SELECT source, floor(target)::BIGINT AS words, (sum(floor(target)::BIGINT) OVER (ORDER BY source NULLS LAST) - floor(target))::BIGINT AS lo FROM t),
n AS (SELECT sum(words)::BIGINT AS total, greatest(1, least(8192, sum(words)::BIGINT // 16384))::BIGINT AS block FROM c),
i AS (SELECT i AS slot, floor(fmod(((i + 1) >> 20) * 0.607787409740351::DOUBLE + ((i + 1) & 1048575) * 0.6180339887498949::DOUBLE, 1) * total)::BIGINT AS p
      FROM n, range((n.total + n.block - 1) // n.block) x(i)),
a AS (SELECT c.source, i.slot, row_number() OVER (PARTITION BY c.source ORDER BY i.slot) - 1 AS k FROM i JOIN c ON i.p >= c.lo AND i.p < c.lo + c.words),
u AS (SELECT t.source, t.source_size, t.target, least(coalesce(b.n, 0) * n.block, 3 * t.source_size) AS upto, n.block
      FROM n, t LEFT JOIN (SELECT source, count(*) AS n FROM a GROUP BY source) b ON t.source IS NOT DISTINCT FROM b.source),
p AS (SELECT row_number() OVER () AS id, d.doc_id, d.size, d.source, u.source_size, u.target, u.upto, u.block,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
q AS (SELECT id, source, block, start + j * source_size AS f, least(start + j * source_size + size, upto) AS e FROM p, range(3) y(j) WHERE start + j * source_size < upto AND size > 0),
g AS (SELECT q.id, sum(least(e, (a.k + 1) * block) - greatest(f, a.k * block))::BIGINT AS taken, min(a.slot) AS slot
      FROM q JOIN a ON q.source IS NOT DISTINCT FROM a.source AND a.k BETWEEN f // block AND (e - 1) // block GROUP BY q.id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, slot FROM p LEFT JOIN g USING (id)""",
    "op4_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) % 32 + 1, 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM d""",
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, r, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM d, range(1, len(ws) - 18) t(i)),
e AS (SELECT r, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS again FROM w),
c AS (SELECT DISTINCT r, i + j AS i FROM e, range(20) t(j) WHERE again),
p AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
k AS (SELECT r, count(*) AS kept, string_agg(word, ' ' ORDER BY i) AS text FROM p ANTI JOIN c USING (r, i) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)""",
    "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)""",
}
