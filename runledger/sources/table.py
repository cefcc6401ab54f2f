"""A versioned table: Parquet runs listed in a manifest.

    path/manifest/<version>.json     one file a commit; the highest version counts
    path/runs/run=<run id>/partition_id=<n>/*.parquet

A run holds one version for each key, sorted by key in its files, under ranges of the key space. All runs are read by one scan. Commits write a
new manifest under a temporary name and rename it, so a reader sees all of a commit or nothing. One
writer at a time is assumed. All paths go through Spark's file systems.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import partition_id, partition_of
from ..operators import versions
from ..schema import INLINE, MAX_KEY_BYTES, PLACED, RUN, STORED, TOMBSTONE, Config


class Files:
    """The few file operations that manifests need, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """All or nothing; fails if the file is there."""
        fs, p = self._at(path)
        temporary = self.jvm.org.apache.hadoop.fs.Path(f"{p.getParent()}/.{uuid.uuid4().hex}")
        out = fs.create(temporary, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if fs.exists(p) or not fs.rename(temporary, p):
            fs.delete(temporary, False)
            raise FileExistsError(path)

    def size(self, path: str) -> int:
        """Bytes of the files below path."""
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


KEY_RANGES = "partition_id int, rows long, min_key binary, max_key binary, min_seq long, max_seq long"


def _key_ranges(batches):
    """Counts and bounds of batches (partition_id, key, seq). Spark would sort a task's rows by partition_id to find a binary column's bounds."""
    for b in batches:
        t = pa.Table.from_batches([b])
        for pid in pc.unique(b.column(0)).to_pylist():
            part = t.filter(pc.equal(t.column(0), pid))
            key, seq = pc.min_max(part.column(1)), pc.min_max(part.column(2))
            row = [pid, part.num_rows, key["min"].as_py(), key["max"].as_py(), seq["min"].as_py(), seq["max"].as_py()]
            types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, types, strict=True)], ["partition_id", "rows", "min_key", "max_key", "min_seq", "max_seq"])


class VersionedTable:
    """Open or create with VersionedTable.open / create; every change is a commit."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest, self.files = spark, path.rstrip("/"), manifest, Files(spark)

    # --- lifecycle ---------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: Config | None = None) -> VersionedTable:
        """A new, empty table; the path must not exist."""
        files = Files(spark)
        if files.exists(path):
            raise FileExistsError(path)
        table = cls(spark, path, {"version": 0, "config": asdict(config or Config()), "next_seq": 0, "next_epoch": 0, "high_water": None, "sources": {}, "runs": []})
        files.make(f"{table.path}/manifest")
        files.make(f"{table.path}/runs")
        files.write(table._manifest_path(0), json.dumps(table.manifest))
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> VersionedTable:
        """The table as its newest manifest has it, or, for reading, as an older one had it that vacuum() has kept."""
        files = Files(spark)
        names = [n for n in files.names(f"{path.rstrip('/')}/manifest") if n.endswith(".json") and not n.startswith(".")]
        if version is not None:
            names = [n for n in names if n == f"{version:012d}.json"]
        if not names:
            raise FileNotFoundError(f"no manifest in {path}")
        return cls(spark, path, json.loads(files.read(f"{path.rstrip('/')}/manifest/{names[-1]}")))

    def refresh(self) -> VersionedTable:
        self.manifest = type(self).open(self.spark, self.path).manifest
        return self

    @property
    def config(self) -> Config:
        return Config(**self.manifest["config"])

    @property
    def runs(self) -> list[dict]:
        return self.manifest["runs"]

    @property
    def next_seq(self) -> int:
        """The next write's seq; as a snapshot it makes all visible that was written so far."""
        return self.manifest["next_seq"]

    @property
    def high_water(self) -> int | None:
        """The highest seq in any run; None without runs."""
        return self.manifest["high_water"]

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifest/{version:012d}.json"

    def _run_path(self, run_id: str) -> str:
        return f"{self.path}/runs/run={run_id}"

    def commit(self, **changes) -> None:
        new = {**self.manifest, **changes, "version": self.manifest["version"] + 1}
        self.files.write(self._manifest_path(new["version"]), json.dumps(new))
        self.manifest = new

    # --- writing -----------------------------------------------------------------------------

    def put(self, rows: DataFrame) -> dict | None:
        """Upsert (key, value), and seq if the source has one; rows without seq are numbered in their order."""
        value_type = F.col("value_type") if "value_type" in rows.columns else F.lit(INLINE)
        return self.append(rows.withColumn("value_type", value_type.cast("tinyint")))

    def remove(self, keys: DataFrame) -> dict | None:
        """Write a tombstone for each key, whether it is there or not."""
        return self.append(keys.withColumn("value_type", F.lit(TOMBSTONE).cast("tinyint")).withColumn("value", F.lit(None).cast("binary")))

    def append(self, log: DataFrame, source: str | None = None, batch: int | None = None) -> dict | None:
        """Write log entries (key, value_type, value, seq if known) as a run of level 0.

        The newest version of each key is kept. A source that numbers its batches upwards names itself and the batch; a
        batch that was written before is not written again, whatever others wrote in between.
        Returns the run, or None if there was nothing to write.
        """
        done = self.manifest.get("sources", {})
        if source is not None and batch <= done.get(source, -1):
            return None
        staged = None
        if "seq" not in log.columns:
            staged = f"{self.path}/staging/{uuid.uuid4().hex}"
            versions.numbered_parts(log.select("key", "value_type", "value")).write.parquet(staged)
            stored = self.spark.read.parquet(staged)
            log = versions.spread(versions.dense_numbers(stored, self.next_seq), stored.count())
        ok = F.col("key").isNotNull() & F.length("key").between(1, MAX_KEY_BYTES)
        log = log.withColumn("key", F.when(ok, F.col("key")).otherwise(F.raise_error(F.lit(f"keys have 1 to {MAX_KEY_BYTES} bytes"))))
        number = self.manifest.get("next_epoch", 0)
        run = self.write_run(versions.newest(log.select("key", "seq", "value_type", "value")), level=0, epoch=number)
        if staged:
            self.files.delete(staged)
        changes = {"next_epoch": number + 1} | ({"sources": {**done, source: batch}} if source is not None else {})
        if run is None:
            if source is not None:
                self.commit(**changes)
            return None
        self.commit(runs=[*self.runs, run], next_seq=max(self.next_seq, run["max_seq"] + 1), high_water=max(run["max_seq"], -1 if self.high_water is None else self.high_water), **changes)
        return run

    flush = append

    def write_run(self, rows: DataFrame, level: int, epoch: int) -> dict | None:
        """Write rows with one version a key as sorted files; their statistics, not their rows, come back."""
        run_id = f"{epoch:012d}-{uuid.uuid4().hex[:12]}"
        path = self._run_path(run_id)
        began = time.time()
        # Dealt by range of the key space; adaptive execution splits crowded ranges and joins small ones, without a pass over the rows to sample them.
        dealt = rows.withColumn("partition_id", partition_id("key", self.config.partition_exponent)).hint("rebalance", "partition_id")
        writer = dealt.sortWithinPartitions("partition_id", "key").write.partitionBy("partition_id")
        if n := self.config.bloom_filter_keys:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(n))
        writer.parquet(path)
        stats = (
            self.spark.read.schema(RUN).parquet(path).select("partition_id", "key", "seq").mapInArrow(_key_ranges, KEY_RANGES).groupBy("partition_id")
            .agg(F.sum("rows").alias("rows"), F.hex(F.min("min_key")).alias("min_key"), F.hex(F.max("max_key")).alias("max_key"), F.min("min_seq").alias("min_seq"), F.max("max_seq").alias("max_seq"))
            .collect()  # at most 2^partition_exponent rows; reads keys and seqs only
        )
        if not stats:
            self.files.delete(path)
            return None
        parts = {str(s["partition_id"]): {k: s[k] for k in ("rows", "min_key", "max_key", "max_seq")} | {"bytes": self.files.size(f"{path}/partition_id={s['partition_id']}")} for s in stats}
        return {"run_id": run_id, "level": level, "epoch": epoch, "min_seq": min(s["min_seq"] for s in stats), "max_seq": max(s["max_seq"] for s in stats), "start": began, "end": time.time(), "parts": parts}

    # --- reading -----------------------------------------------------------------------------

    def log(self, lower: bytes | None = None, upper: bytes | None = None, runs: list[dict] | None = None, partitions: set[int] | None = None) -> DataFrame:
        """All versions in the runs, with epoch, level and partition_id: one scan, whatever the number of runs.

        Bounds become partition predicates too, and runs without keys in them are left out. partitions: only these ranges of the key space.
        """
        low, high = 0, 65535
        if lower is not None or upper is not None:
            e = self.config.partition_exponent
            low, high = partition_of(lower, e) if lower is not None else low, partition_of(upper, e) if upper is not None else high

        def may_hold(pid: int, part: dict) -> bool:
            inside = (lower is None or bytes.fromhex(part["max_key"]) >= lower) and (upper is None or bytes.fromhex(part["min_key"]) <= upper)
            return low <= pid <= high and inside and (partitions is None or pid in partitions)

        found = {r["run_id"]: r for r in (self.runs if runs is None else runs) if any(may_hold(int(p), s) for p, s in r["parts"].items())}
        if not found:
            return self.spark.createDataFrame([], PLACED)
        out = self.spark.read.schema(STORED).option("basePath", f"{self.path}/runs").parquet(*map(self._run_path, found))
        if lower is not None or upper is not None:
            out = out.where(F.col("partition_id").between(low, high))
        if partitions is not None:
            out = out.where(F.col("partition_id").isin(sorted(partitions)))
        out = versions.spread(out, sum(s["rows"] for r in found.values() for p, s in r["parts"].items() if may_hold(int(p), s)))
        place = F.create_map(*[F.lit(x) for i, r in found.items() for x in (i, f"{r['epoch']},{r['level']}")])  # an entry for each run
        place = F.split(place[F.col("run")], ",")
        return out.select(*RUN.names, place[0].cast("long").alias("epoch"), place[1].cast("int").alias("level"))

    def scan(self, lower: bytes | None = None, upper: bytes | None = None, snapshot: int | None = None, scope: str = "global") -> DataFrame:
        """(key, value) of live keys, both bounds included, in byte order."""
        partitions = None
        bound = lower if lower is not None else upper
        if scope == "partition" and bound is not None:
            partitions = {partition_of(bound, self.config.partition_exponent)}
        return versions.scan(self.log(lower, upper, partitions=partitions), lower, upper, snapshot)

    def seek(self, lower: bytes, n: int, snapshot: int | None = None) -> DataFrame:
        return versions.seek(self.log(lower), lower, n, snapshot)

    def get_many(self, probes: DataFrame, snapshot: int | None = None) -> DataFrame:
        """Status and value of each probe (key). Only ranges of the key space, and runs, that may hold a probe are read."""
        asked = probes.where("key IS NOT NULL").groupBy(partition_id("key", self.config.partition_exponent).alias("p")).agg(F.min("key").alias("low"), F.max("key").alias("high"))
        parts = asked.collect()  # at most 2^partition_exponent rows
        if not parts:
            return versions.get_many(self.spark.createDataFrame([], PLACED), probes, snapshot=snapshot)
        low, high = min(bytes(r["low"]) for r in parts), max(bytes(r["high"]) for r in parts)
        found = versions.in_range(self.log(low, high, partitions={r["p"] for r in parts}), low, high)
        return versions.get_many(found, probes, snapshot=snapshot)

    def get(self, key: bytes, snapshot: int | None = None) -> tuple[str, object]:
        return versions.get(self.log(key, key), key, snapshot)

    # --- layout and recovery -------------------------------------------------------------------

    def run_table(self) -> DataFrame:
        """A row for each run and range of the key space."""
        rows = [(int(p), r["level"], r["epoch"], r["run_id"], s["rows"], s["bytes"], s["max_seq"]) for r in self.runs for p, s in r["parts"].items()]
        return self.spark.createDataFrame(rows, "partition_id int, level int, epoch long, run_id string, rows long, size long, max_seq long")

    def jobs(self) -> DataFrame:
        """A row for each merge of runs so far: level, bytes and items read, start and end in seconds."""
        rows = [(j["level"], j["bytes"], j["items"], j["start"], j["end"]) for j in self.manifest.get("jobs", [])]
        return self.spark.createDataFrame(rows, "level int, bytes long, items long, start double, end double")

    def orphans(self, keep: int = 1) -> list[str]:
        """Runs on disk that the newest ``keep`` manifests don't list: left by a writer that failed, or replaced by a compaction."""
        listed = {r["run_id"] for r in self.runs}
        for name in self._old_manifests()[-(keep - 1) :] if keep > 1 else []:
            listed |= {r["run_id"] for r in json.loads(self.files.read(f"{self.path}/manifest/{name}"))["runs"]}
        return sorted({n.removeprefix("run=") for n in self.files.names(f"{self.path}/runs")} - listed)

    def _old_manifests(self) -> list[str]:
        return [n for n in self.files.names(f"{self.path}/manifest") if n < f"{self.manifest['version']:012d}.json" and not n.startswith(".")]

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all manifests but the newest ``keep``, and runs that none of these lists; their snapshots stay readable."""
        gone = self.orphans(keep)
        for run_id in gone:
            self.files.delete(self._run_path(run_id))
        self.files.delete(f"{self.path}/staging")
        old = self._old_manifests()
        for name in old[: len(old) - (keep - 1)]:
            self.files.delete(f"{self.path}/manifest/{name}")
        return gone

    def replay(self, log: DataFrame) -> dict | None:
        """Append the entries of a log (with seq) that no run holds yet."""
        return self.append(versions.replayable(log, self.high_water))

    def with_config(self, **changes) -> VersionedTable:
        self.commit(config=asdict(replace(self.config, **changes)))
        return self
