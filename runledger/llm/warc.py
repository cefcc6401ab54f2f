"""WARC archives of pages: writing with revisit records, reading with boundary-chain verification.

Records are written as text rows, so any file system that Spark writes to will do; an archive holds ARCHIVE_BYTES at most,
or one record that is larger. To read, every place where the magic stands is a candidate, whose Content-Length
gives the offset of its successor; tasks emit both. Starting at offset 0, pointer jumping (the jumps double each
round) keeps the candidates that the chain reaches; magic inside a payload is never reached.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, scratch_dir

MAGIC = b"WARC/1.1\r\n"
CRLF = "\r\n"
ARCHIVE_BYTES = 32 << 20
#: Bytes of offsets that are broadcast at most.
BROADCAST_BYTES = 32 << 20
ID = "urn:runledger:page:"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits make four characters."""
    h, letters = F.sha1(payload), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for i in range(0, 40, 5):
        v = F.conv(F.substring(h, i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(letters), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _header(name: str, value: Column) -> Column:
    """A header line; control characters in the value would end it early and become spaces."""
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x00-\x1F\x7F]", " "), F.lit(CRLF))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of pages (page_id, url, html).

    Of rows with equal payloads of at least min_bytes the one with the largest page_id is a response,
    the others revisit it and carry no payload. A null html is empty; a null page_id is never the largest,
    unless all are null; rows repeated with the largest page_id are all responses.
    """
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), F.sha2(html, 256).alias("sha"), F.octet_length(html).cast("long").alias("n"))
    slim = materialize(rows.select("page_id", "sha", "n"), "warc-digests")
    same = slim.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("copies"))
    same = materialize(same.where("copies > 1").select("sha", "last", F.lit(True).alias("shared")), "warc-shared")
    r = rows.join(broadcast_if_small(same), "sha", "left")
    revisit = F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("last"))
    ident = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF), _header("Content-Length", F.col("n")), F.lit(CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    record = F.concat(
        F.lit(MAGIC.decode()), _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", ident(F.col("page_id"))), _header("WARC-Target-URI", F.col("url")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z" + CRLF), _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(html))),
        F.when(revisit, F.concat(_header("WARC-Refers-To", ident(F.col("last"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF), _header("Content-Length", F.octet_length(block)), F.lit(CRLF), block,
    )
    # Each task fills one archive after another up to archive_bytes; a record ends with two line ends, which is what the text writer puts after each row.
    cut = r.select(record.alias("value")).mapInArrow(_by_bytes(archive_bytes), "value string, archive int")
    cut.write.partitionBy("archive").option("lineSep", CRLF * 2).option("compression", "none").text(path)


def _by_bytes(archive_bytes: int):
    """Numbers a task's records by archive: a new one begins where the next record would not fit."""
    def run(batches):
        used, archive = 0, 0
        for b in batches:
            numbers = []
            for n in pc.binary_length(b.column(0)).to_pylist():
                if used and used + n + 4 > archive_bytes:
                    used, archive = 0, archive + 1
                used += n + 4
                numbers.append(archive)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers, pa.int32())], ["value", "archive"])

    return run


_HEADERS = re.compile(rb"([^\r\n:]+):[ \t]*([^\r\n]*)\r\n")


def _headers(data: memoryview, at: int) -> tuple[dict[bytes, bytes], int] | None:
    """Headers of the candidate at this offset and where its block starts; None if it isn't a record's head."""
    at += len(MAGIC)
    out: dict[bytes, bytes] = {}
    while m := _HEADERS.match(data, at):
        out.setdefault(m[1].strip().lower(), m[2].strip())
        at = m.end()
    return (out, at + 2) if bytes(data[at : at + 2]) == b"\r\n" else None


def candidates(data: memoryview) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all places where the magic stands, and the offset of each one's successor (-1: no record)."""
    starts, after = [], []
    for m in re.finditer(re.escape(MAGIC), data):
        head = _headers(data, m.start())
        length = head[0].get(b"content-length", b"") if head else b""
        end = head[1] + int(length) + 4 if length.isdigit() and len(length) < 19 else -1
        starts.append(m.start())
        after.append(end if 0 <= end <= len(data) and bytes(data[end - 4 : end]) == b"\r\n\r\n" else -1)
    return np.array(starts, dtype=np.int64), np.array(after, dtype=np.int64)


def reachable(starts: np.ndarray, after: np.ndarray, size: int) -> np.ndarray:
    """Marks the candidates on the chain from offset 0. Raises if the chain ends before the archive does."""
    n = len(starts)
    at = np.searchsorted(starts, after)
    jump = np.where((at < n) & (starts[np.minimum(at, n - 1)] == after), at, np.where(after == size, n, n + 1)) if n else np.empty(0, np.int64)
    jump = np.r_[jump, n, n + 1]  # n: the archive's end; n + 1: no record there
    on = np.zeros(n + 2, dtype=bool)
    on[0 if n and starts[0] == 0 else n if size == 0 else n + 1] = True
    for _ in range(max(1, int(n).bit_length() + 1)):
        on[jump[on]] = True
        jump = jump[jump]
    if on[n + 1]:
        raise ValueError("archive is damaged: the chain of records breaks off")
    return on[:n]


def read_records(name: str, data: memoryview, offsets: list[int]) -> list[tuple]:
    """Rows of SCHEMA for the records at these offsets. Raises if a payload doesn't have its digest."""
    rows = []
    number = lambda b: int(x) if (x := b.decode().strip("<>").removeprefix(ID)).lstrip("-").isdigit() else None
    for at in offsets:
        h, body = _headers(data, at)
        end = body + int(h[b"content-length"])
        kind = h.get(b"warc-type", b"").decode()
        if kind not in ("response", "revisit"):
            continue
        split = re.compile(rb"\r\n\r\n").search(data, body, end).end()
        if kind == "response":
            size = end - split
            digest = base64.b32encode(hashlib.sha1(memoryview(data)[split:end]).digest()).decode()
            if h.get(b"warc-payload-digest", b"sha1:" + digest.encode()) != b"sha1:" + digest.encode():
                raise ValueError(f"archive is damaged: payload at {at} doesn't have its digest")
        else:
            size = int(re.search(rb"(?i)content-length:[ \t]*(\d+)", data[body:split])[1])
            digest = h[b"warc-payload-digest"].decode().removeprefix("sha1:")
        rows.append((number(h[b"warc-record-id"]), size, digest, kind, number(h.get(b"warc-refers-to", b"")) if kind == "revisit" else None, h.get(b"warc-target-uri", b"").decode(), name, at))
    return rows


def candidate_table(files: DataFrame) -> DataFrame:
    """(archive, size, offset, successor): a row for each place where the magic stands; one with offset -1 for each archive besides."""
    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = data.as_buffer()
                starts, after = candidates(memoryview(data))
                n = len(starts) + 1
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([data.size] * n, pa.int64()), pa.array(np.r_[-1, starts]), pa.array(np.r_[-1, after])], ["archive", "size", "offset", "successor"])

    return files.select("path", "content").mapInArrow(run, "archive string, size long, offset long, successor long")


def chains(found: DataFrame) -> DataFrame:
    """(archive, offsets): the candidates that the chain from the archive's start reaches. A group has an archive's offsets, no payloads."""
    def run(t: pa.Table) -> pa.Table:
        name, size = t.column("archive")[0].as_py(), t.column("size")[0].as_py()
        starts, after = t.column("offset").to_numpy(), t.column("successor").to_numpy()
        order = np.argsort(starts)[1:]
        starts, after = starts[order], after[order]
        try:
            offsets = starts[reachable(starts, after, size)]
        except ValueError as e:
            raise ValueError(f"{name}: {e}") from e
        return pa.table({"archive": pa.array([name]), "offsets": pa.array([offsets], pa.list_(pa.int64()))})

    return found.groupBy("archive").applyInArrow(run, "archive string, offsets array<long>")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under path.

    1. Tasks emit each archive's candidates with their successors' offsets.
    2. Pointer jumping over an archive's offsets keeps those that its start reaches.
    3. Tasks read the archives again and parse the records at the offsets that are left.
    A task holds one archive at once; Spark's binary reader takes files of up to 2 GB.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in SCHEMA.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    kept = materialize(chains(candidate_table(files)), "warc-chains")

    def run(batches):
        for b in batches:
            for name, data, offsets in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                data = memoryview(data.as_buffer())
                for a in range(0, len(offsets), 4096):
                    rows = read_records(name, data, offsets[a : a + 4096])
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # Offsets are a thousandth of the archives' bytes or less: broadcast if that is small, else both sides are shuffled.
    size = kept.agg(F.sum(8 * F.size("offsets") + F.octet_length("archive") + 64)).first()[0] or 0
    both = files.select(F.col("path").alias("archive"), "content").join(F.broadcast(kept) if size <= BROADCAST_BYTES else kept, "archive")
    return both.select("archive", "content", "offsets").mapInArrow(run, SCHEMA)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder and read them back: a row per page.

    Columns as in SCHEMA. An empty table gives an empty result; other columns are not read.
    """
    path = f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)
