"""Sharding by size-tiered compaction: small immutable shards, merged by size class, under a versioned manifest.

A table is a folder. ``append`` writes arrivals as small Parquet shards, each task its own, without a shuffle.
``compact`` puts shards into size classes (each ``FAN_IN`` times the one before), cuts each class into groups of up to
the target size, and merges the groups that are worth it, a task a group, streaming batch by batch. Readers see only what
a manifest lists. A manifest is a Parquet table of shards; it takes effect by the atomic creation of one small file that
carries the next version number, so of two writers one fails and nothing is half seen. ``vacuum`` drops old versions and
the shards that only they list; a shard that no version has listed yet may belong to an arrival that is about to commit,
so ``sweep``, for what failed tasks left, asks for a grace period.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import Saved, fresh_path, map_batches, remove

SMALL_BYTES, TARGET_BYTES, FAN_IN = 4 << 20, 64 << 20, 4
#: Versions that stay readable after a merge, and seconds for which an unlisted file may still be committed.
LIVE, GRACE = 2, 24 * 3600
_ROWS = "uri string, arrival string, seq long, n_rows long, n_bytes long"
_KINDS = pa.schema([("uri", pa.string()), ("arrival", pa.string()), ("seq", pa.int64()), ("n_rows", pa.int64()), ("n_bytes", pa.int64())])


class _Shard:
    """An open Parquet shard; the row that describes it comes from ``close``."""

    def __init__(self, folder: str, schema: pa.Schema):
        self.uri = f"{folder}/{uuid.uuid4().hex}.parquet"
        files, path = fs.FileSystem.from_uri(self.uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.sink = files.open_output_stream(path)
        self.writer, self.rows, self.raw = pq.ParquetWriter(self.sink, schema, compression="zstd", compression_level=1), 0, 0

    def write(self, batch: pa.RecordBatch) -> None:
        self.writer.write_batch(batch)
        self.rows += batch.num_rows
        self.raw += batch.nbytes

    def close(self, arrival: str, seq: int) -> pa.RecordBatch:
        self.writer.close()
        size = self.sink.tell()
        self.sink.close()
        return pa.RecordBatch.from_pylist([{"uri": self.uri, "arrival": arrival, "seq": seq, "n_rows": self.rows, "n_bytes": size}], schema=_KINDS)


def _appending(folder: str, arrival: str, small: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, shard = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            step = max(1, batch.num_rows * small // max(1, 2 * batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                shard = shard or _Shard(folder, part.schema)
                shard.write(part)
                if shard.raw >= 2 * small:
                    yield shard.close(arrival, (task << 24) + made)
                    shard, made = None, made + 1
        if shard:
            yield shard.close(arrival, (task << 24) + made)

    return run


def _merging(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in (g for batch in batches for g in batch.to_pylist()):
            shard = None
            for uri in group["uris"]:
                files, path = fs.FileSystem.from_uri(uri)
                with files.open_input_file(path) as source:
                    for batch in pq.ParquetFile(source).iter_batches(4096):
                        shard = shard or _Shard(folder, batch.schema)
                        shard.write(batch)
            if shard:
                yield shard.close(group["arrival"], group["seq"])

    return run


class ShardTable:
    """A compacted table in ``folder``, a URI that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm

    def _fs(self, path: str):
        target = self.jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def versions(self) -> list[int]:
        files, target = self._fs(f"{self.folder}/versions")
        return sorted(int(s.getPath().getName()[1:]) for s in files.listStatus(target) if s.getPath().getName()[0] == "v") if files.exists(target) else []

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version, the last one unless told: uri, arrival, seq, n_rows, n_bytes. None yet: no rows."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], _ROWS)
        name = f"v{known[-1] if version is None else version:08d}"
        return self.spark.read.schema(_ROWS).parquet(f"{self.folder}/{self._body(name)['manifest']}")

    def _body(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/versions/{name}").first()[0])

    def commit(self, shards: DataFrame, base: int | None, schema: StructType | None = None) -> int:
        """Make ``shards`` the version after ``base`` (None: the first); raises if someone else has made it.

        ``schema`` is that of the rows, by default that of the version before.
        """
        version, name = 0 if base is None else base + 1, f"manifests/{uuid.uuid4().hex}"
        shards.select("uri", "arrival", "seq", "n_rows", "n_bytes").write.parquet(f"{self.folder}/{name}")
        rows = schema.jsonValue() if schema else self._body(f"v{base:08d}")["schema"]
        body = json.dumps({"version": version, "manifest": name, "schema": rows}).encode()
        files, draft = self._fs(f"{self.folder}/drafts/{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(body)
        out.close()
        final = self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions/v{version:08d}")
        files.mkdirs(final.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        option = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(option, 0)
        context.rename(files.makeQualified(draft), files.makeQualified(final), none)  # without an overwrite option it fails if the name is taken
        return version

    def _last(self) -> int | None:
        known = self.versions()
        return known[-1] if known else None

    def append(self, rows: DataFrame, small: int = SMALL_BYTES) -> int:
        """Add an arrival as shards of about ``small`` bytes and commit; returns the version.

        Where another writer was first, the shards are listed in the version after it.
        """
        base, arrival = self._last(), uuid.uuid4().hex
        fresh = fresh_path(self.spark, "appended")
        map_batches(rows, _appending(f"{self.folder}/data", f"{(-1 if base is None else base) + 1:08d}-{arrival}", small), _ROWS).write.parquet(fresh)
        while True:
            try:
                version = self.commit(self.manifest(base).unionByName(self.spark.read.schema(_ROWS).parquet(fresh)), base, rows.schema)
                break
            except Py4JJavaError:
                if self._last() == base:  # it was not another writer
                    raise
                base = self._last()
        remove(self.spark, fresh)
        return version

    def compact(self, target: int = TARGET_BYTES, small: int = SMALL_BYTES, fan_in: int = FAN_IN, live: int = LIVE) -> int | None:
        """Merge until no size class has a group worth merging; each round is one job and one commit.

        The last ``live`` versions stay readable, and all from the one that was the last when this began, which readers may have open.
        """
        rounds = 0
        while True:
            base = self._last()
            if base is None:
                return None
            shards = self.manifest(base)
            size_class = F.greatest(F.floor(F.log(F.col("n_bytes") / F.lit(small)) / F.log(F.lit(float(fan_in)))), F.lit(0))
            tiered = shards.where(F.col("n_bytes") < target // 2).withColumn("tier", size_class.cast("int"))
            before = Window.partitionBy("tier").orderBy("arrival", "seq", "uri").rowsBetween(Window.unboundedPreceding, -1)
            cut = tiered.withColumn("group", F.floor(F.coalesce(F.sum("n_bytes").over(before), F.lit(0)) / F.lit(target)))
            members = F.array_sort(F.collect_list(F.struct("arrival", "seq", "uri")))  # at most target / smallest shard of them
            groups = cut.groupBy("tier", "group").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size"), members.alias("m"))
            groups = groups.where((F.col("n") >= fan_in) | (F.col("n") > 1) & (F.col("size") >= target // 2))
            plan_path, merged_path = fresh_path(self.spark, "plan"), fresh_path(self.spark, "merged")
            groups.select(F.col("m.uri").alias("uris"), F.element_at("m.arrival", 1).alias("arrival"), F.element_at("m.seq", 1).alias("seq")).write.parquet(plan_path)
            plan = self.spark.read.parquet(plan_path)
            n = plan.count()
            if not n:
                remove(self.spark, plan_path)
                if rounds:
                    self.vacuum(max(live, rounds + 1))
                return base
            map_batches(plan.coalesce(1).repartition(n), _merging(f"{self.folder}/data"), _ROWS).write.parquet(merged_path)
            gone = plan.select(F.explode("uris").alias("uri"))
            self.commit(shards.join(gone, "uri", "left_anti").unionByName(self.spark.read.schema(_ROWS).parquet(merged_path)), base)
            for path in (plan_path, merged_path):
                remove(self.spark, path)
            rounds += 1

    def vacuum(self, live: int = LIVE) -> int:
        """Forget all but the last ``live`` versions and delete, on the executors, the shards that only forgotten ones list; returns how many.

        A shard that no version lists is left alone: it may belong to an arrival that has not committed yet.
        """
        known = self.versions()
        old, left = known[: -max(1, live)], known[-max(1, live) :]
        if not old:
            return 0
        listed = lambda versions: reduce(DataFrame.unionByName, [self.manifest(v).select("uri") for v in versions]).distinct()
        gone = Saved(listed(old).join(listed(left), "uri", "left_anti"), "gone")
        for version in old:  # first no reader finds the version, then its shards go
            remove(self.spark, f"{self.folder}/versions/v{version:08d}")
        return self._delete(gone)

    def sweep(self, grace: float = GRACE) -> int:
        """Delete shards that no version lists and that are older than ``grace`` seconds, longer than any append takes; returns how many."""
        files, target = self._fs(f"{self.folder}/data")
        if not files.exists(target) or not self.versions():
            return 0
        name = lambda c: F.regexp_extract(c, "[^/]+$", 0)
        old = F.col("modificationTime") < F.timestamp_seconds(F.lit(time.time() - grace))
        found = self.spark.read.format("binaryFile").load(f"{self.folder}/data").where(old).select(name("path").alias("name"))
        known = reduce(DataFrame.unionByName, [self.manifest(v).select(name("uri").alias("name")) for v in self.versions()])
        return self._delete(Saved(found.join(known, "name", "left_anti").select(F.concat(F.lit(f"{self.folder}/data/"), "name").alias("uri")), "orphans"))

    @staticmethod
    def _delete(gone: Saved) -> int:
        def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for uri in batch.column("uri").to_pylist():
                    where, path = fs.FileSystem.from_uri(uri)
                    if where.get_file_info(path).type != fs.FileType.NotFound:
                        where.delete_file(path)
                yield batch

        n = map_batches(gone.df, delete, "uri string").count()
        gone.drop()
        return n

    def located(self) -> DataFrame:
        """(doc_id, shard, row, text_crc32) of every row of the last version, read from its shards, which are numbered in order."""
        numbered = self.manifest().select("uri", (F.row_number().over(Window.orderBy("arrival", "seq", "uri")) - 1).cast("long").alias("shard"))
        return map_batches(numbered.repartition(max(1, self.manifest().count())), _locating, "doc_id long, shard long, row long, text_crc32 long")

    def schema(self, version: int | None = None) -> StructType:
        known = self.versions()
        return StructType.fromJson(self._body(f"v{known[-1] if version is None else version:08d}")["schema"]) if known else StructType()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one unless told, read by a task a shard; the driver lists no shard."""
        shards = self.manifest(version)
        return map_batches(shards.select("uri").repartition(max(1, shards.count())), _reading, self.schema(version))


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for uri in (u for batch in batches for u in batch.column("uri").to_pylist()):
        files, path = fs.FileSystem.from_uri(uri)
        with files.open_input_file(path) as source:
            yield from pq.ParquetFile(source).iter_batches(1024)


def _locating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for one in (r for batch in batches for r in batch.to_pylist()):
        files, path = fs.FileSystem.from_uri(one["uri"])
        at = 0
        with files.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(2048, columns=["doc_id", "text"]):
                n = batch.num_rows
                sums = [None if t is None else zlib.crc32(t.encode()) for t in batch.column("text").to_pylist()]
                yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array([one["shard"]] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "shard", "row", "text_crc32"])
                at += n


def compacted(rows: DataFrame, arrivals: int = 1) -> ShardTable:
    """A new table in the shared folder to which ``rows`` (doc_id and more) come in so many arrivals, dealt by a hash of doc_id, compacted after each.

    Every row and column is kept as it is: nulls, repeated rows, empty and long texts. Of an empty table there is a
    version without shards. A single row larger than the target makes a shard of its own.
    """
    table = ShardTable(rows.sparkSession, fresh_path(rows.sparkSession, "compacted"))
    for k in range(arrivals):
        table.append(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == k) if arrivals > 1 else rows)
        table.compact()
    return table
