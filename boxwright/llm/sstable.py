"""Token ids in sorted-string-table shards: written in key order by Spark tasks, read back or searched by key.

A shard is one immutable file of documents in ascending order of doc_id:

    block*        zstd of entries: varint shared, varint unshared, varint value length, key suffix, value
    block index   zstd of: varint count, then per block last key (9 bytes), u64 offset, u32 stored, u32 raw bytes
    Bloom filter  bit array, ten bits a key, seven probes
    footer        96 bytes: offsets, sizes, counts, end id, id width, crc32 of index and filter, magic

A key is a zero byte for a null doc_id, or a one byte and the identifier as big-endian unsigned with its sign bit
turned, so that bytes sort as identifiers do. Keys are prefix-compressed within a block. A value holds the ids,
little-endian, two bytes each where the vocabulary allows and else four. Readers need the footer, then at most one block.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Saved, fresh_path, map_batches, text_steps
from .tokens import IDS_MODEL, id_cache, public_path
from .words import mixed

END_ID = 1
BLOCK_BYTES = 128 << 10
#: Bytes of ids after which a task begins another shard, so that shards, and the keys that a writer holds, have a size that no table changes.
SHARD_BYTES = 256 << 20
BITS_PER_KEY, PROBES = 10, 7
MAGIC = b"TOKSST01"
_FOOTER = struct.Struct("<QQQQQQQQIIII8s8x")
_CODEC = pa.Codec("zstd", compression_level=1)
_SIGN = 1 << 63


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" * 9 if doc_id is None else b"\x01" + ((doc_id + _SIGN) & (2 * _SIGN - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - _SIGN


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return n, at


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    """The filter bits of each key, one row a key."""
    first = mixed(np.array([int.from_bytes(k[1:], "big") ^ (0 if k[0] else 0x5BD1E995) for k in keys], np.uint64))
    second = mixed(first + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return (first[:, None] + np.arange(PROBES, dtype=np.uint64) * second[:, None]) % np.uint64(bits)


class Writer:
    """Writes one shard; entries must come in ascending order of key, equal keys allowed."""

    def __init__(self, sink, width: int, end_id: int):
        self.sink, self.width, self.end_id = sink, width, end_id
        self.block, self.last, self.index, self.keys = bytearray(), b"", [], []
        self.offset = self.tokens = self.raw = 0

    def add(self, key: bytes, value: bytes) -> None:
        if len(self.block) >= BLOCK_BYTES:
            self.flush()
        shared = 0
        if self.block:
            while shared < 9 and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(9 - shared) + _varint(len(value)) + key[shared:]
        self.block += value
        self.last = key
        self.keys.append(key)
        self.tokens += len(value) // self.width
        self.raw += len(value) + 24

    def flush(self) -> None:
        if self.block:
            stored = _CODEC.compress(bytes(self.block), asbytes=True)
            self.index.append(self.last + struct.pack("<QII", self.offset, len(stored), len(self.block)))
            self.sink.write(stored)
            self.offset += len(stored)
            self.block = bytearray()

    def close(self) -> None:
        self.flush()
        bits = max(64, -(-len(self.keys) * BITS_PER_KEY // 64) * 64)
        table = np.zeros(bits, bool)
        if self.keys:
            table[_probes(self.keys, bits).ravel().astype(np.int64)] = True
        raw = _varint(len(self.index)) + b"".join(self.index)
        index, bloom = _CODEC.compress(raw, asbytes=True), np.packbits(table, bitorder="little").tobytes()
        at = self.offset
        self.sink.write(index + bloom + _FOOTER.pack(at, len(index), len(raw), at + len(index), bits, len(self.keys), self.tokens, len(self.index), self.end_id, self.width, zlib.crc32(index + bloom), 0, MAGIC))
        self.sink.close()


class Shard:
    """Opens a shard by its footer; ``get`` searches one key, ``entries`` streams them all, a block in memory at a time."""

    def __init__(self, uri: str):
        files, path = fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        at, stored, raw, bloom_at, self.bits, self.n_docs, self.n_tokens, blocks, self.end_id, self.width, crc, _, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        tail = self.file.read_at(bloom_at + self.bits // 8 - at, at)
        if magic != MAGIC or zlib.crc32(tail) != crc:
            raise ValueError(f"not a whole shard: {uri}")
        self.bloom = np.frombuffer(tail, np.uint8, self.bits // 8, stored)
        index = _CODEC.decompress(tail[:stored], raw, asbytes=True)
        _, first = _read_varint(index, 0)
        self.last_keys = [index[p : p + 9] for p in range(first, len(index), 25)]
        self.blocks = [struct.unpack_from("<QII", index, p + 9) for p in range(first, len(index), 25)]

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        offset, stored, raw = self.blocks[k]
        data, at, key = _CODEC.decompress(self.file.read_at(stored, offset), raw, asbytes=True), 0, b""
        while at < raw:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def entries(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, value in self._block(k):
                yield id_of(key), np.frombuffer(value, f"<u{self.width}")

    def may_have(self, doc_id: int | None) -> bool:
        at = _probes([key_of(doc_id)], self.bits)[0]
        return bool((self.bloom[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document under this identifier, by filter, then binary search of the index, then one block (more if rows repeat it)."""
        from bisect import bisect_left

        key, found = key_of(doc_id), []
        if self.may_have(doc_id):
            for k in range(bisect_left(self.last_keys, key), len(self.blocks)):
                found += [np.frombuffer(v, f"<u{self.width}") for other, v in self._block(k) if other == key]
                if self.last_keys[k] > key:
                    break
        return found

    def close(self) -> None:
        self.file.close()


_ROWS = "uri string, first_id long, last_id long, n_docs long, n_tokens long"
_KINDS = pa.schema([("uri", pa.string()), *((c, pa.int64()) for c in ("first_id", "last_id", "n_docs", "n_tokens"))])


def _writing(folder: str, model: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, writer, uri, first, last = id_cache(public_path(model)), None, "", None, None
        width = 2 if len(cache.closes) <= 1 << 16 and end_id < 1 << 16 else 4
        end = np.array([end_id], f"<u{width}").tobytes()

        def closed() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pylist([{"uri": uri, "first_id": first, "last_id": last, "n_docs": len(writer.keys), "n_tokens": writer.tokens}], schema=_KINDS)

        for batch in batches:
            for step in text_steps(batch):
                ids = step.column("doc_id").to_pylist()
                for doc_id, value in zip(ids, cache.encode(pc.fill_null(step.column("text"), "").to_pylist()), strict=True):
                    if writer is not None and writer.raw >= most:
                        yield closed()
                        writer = None
                    if writer is None:
                        uri = f"{folder}/{uuid.uuid4().hex}.sst"  # a task that runs again writes another file; the manifest names one
                        files, path = fs.FileSystem.from_uri(uri)
                        files.create_dir(path.rpartition("/")[0], recursive=True)
                        writer, first = Writer(files.open_output_stream(path), width, end_id), doc_id
                    if width == 2:
                        value = np.frombuffer(value, "<u4").astype("<u2").tobytes()
                    writer.add(key_of(doc_id), value + end)
                    last = doc_id
        if writer is not None:
            yield closed()

    return run


def write_shards(docs: DataFrame, model: str = IDS_MODEL, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> Saved:
    """Write ``docs`` (doc_id, text; further columns are ignored) as shards in the shared folder; returns the manifest.

    The manifest has a row a shard: uri, first_id, last_id, n_docs, n_tokens, shard (its place in key order). Null
    texts count as empty and hold the end id only. Rows that repeat a doc_id are all kept, in order of their texts;
    rows without one come first. An empty table gives no shard. A shard ends after ``shard_bytes``, so a task may write many.
    """
    folder = fresh_path(docs.sparkSession, "sst")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = keyed.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    written = Saved(map_batches(ordered, _writing(folder, model, end_id, shard_bytes), _ROWS), "shards")
    # one row a shard: a key range of neighbours may repeat a doc_id over its edge, so the file name settles ties
    by_key = Window.orderBy(F.col("first_id").asc_nulls_first(), F.col("last_id").asc_nulls_first(), "uri")
    manifest = Saved(written.df.withColumn("shard", F.row_number().over(by_key) - 1).withColumn("start", F.coalesce(F.sum("n_tokens").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "manifest")
    written.drop()
    return manifest


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["doc_id", "start", "n_tokens", "ids_crc32"], pa.int64()
    for batch in batches:
        for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
            shard, rows = Shard(uri), []
            for doc_id, ids in shard.entries():
                rows.append((doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                if len(rows) == 20_000:
                    yield _part(rows, start, names, kinds)
                    start, rows = start + sum(n for _, n, _ in rows), []
            if rows:
                yield _part(rows, start, names, kinds)
            shard.close()


def _part(rows: list[tuple], start: int, names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    ids, sizes, sums = zip(*rows, strict=True)
    starts = [*accumulate(sizes, initial=start)][:-1]
    return pa.record_batch([pa.array(c, kind) for c in (ids, starts, sizes, sums)], names=names)


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of the shards; start counts all ids before it."""
    files = manifest.select("uri", "start").repartition(max(1, manifest.count()), "uri")
    return map_batches(files, _reading, "doc_id long, start long, n_tokens long, ids_crc32 long")


def look_up(spark: SparkSession, manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, tokens) of each wanted doc_id: ids meet the shards whose key range holds them, then each shard is searched.

    Key ranges are cut into as many equal strips as there are shards, so a shard and an id meet by the number of a strip.
    Ranges follow one another, so all of them together touch at most twice as many strips as there are shards.
    """
    low, high = F.coalesce("first_id", F.lit(-_SIGN)), F.coalesce("last_id", F.lit(-_SIGN))
    known = manifest.agg(F.min("first_id"), F.max("last_id"), F.count("*")).first()
    strip = max(1, ((known[1] or 0) - (known[0] or 0)) // max(1, known[2]) + 1)
    at = lambda c: F.greatest(F.floor((c - F.lit(known[0] or 0)) / F.lit(strip)), F.lit(-1)).cast("long")
    number = lambda c: at(F.greatest(c, F.lit((known[0] or 0) - 1)))
    shards = manifest.select("uri", low.alias("low"), high.alias("high"), F.explode(F.sequence(number(low), number(high))).alias("strip"))
    wanted = ids.select("doc_id").where("doc_id IS NOT NULL").withColumn("strip", number(F.least(F.col("doc_id"), F.lit((known[1] or 0) + 1))))
    ranged = wanted.join(shards, "strip").where(F.col("doc_id").between(F.col("low"), F.col("high"))).select("doc_id", "uri")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, Shard] | None = None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for doc_id, uri in zip(batch.column("doc_id").to_pylist(), batch.column("uri").to_pylist(), strict=True):
                if opened is None or opened[0] != uri:
                    opened = (uri, Shard(uri))
                for tokens in opened[1].get(doc_id):
                    out[0].append(doc_id)
                    out[1].append(tokens.astype(np.int64))
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64()))], names=["doc_id", "tokens"])

    return map_batches(ranged.repartition("uri").sortWithinPartitions("uri", "doc_id"), search, "doc_id long, tokens array<long>")
