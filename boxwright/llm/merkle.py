"""A Merkle manifest of a data set: a store of hash nodes in Parquet, a folder a level, and proofs read from it by coordinate.

A node is known by its tree (a source) and place; sixteen neighbours make one node of the next level. Leaves are sorted
once into runs, whose sizes give each its place. From then on work goes by blocks of 256 neighbours, whole subtrees of two
levels: a task streams through its blocks in order and writes both levels above them. Proofs go the same way downwards:
blocks, the nodes of the level between and the path above each block are merged in order of coordinates, so a task holds
one block at a time whatever the size of a source. The roots of the trees are the leaves of one more tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Saved, fresh_path, map_batches, small_side

WIDTH = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree string, pos long, n long, digest binary"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(text: Column | str = "text") -> Column:
    """sha256 of a document: each field as its bytes in UTF-8, their number and a colon before them, or a dash if null."""
    values = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in (*FIELDS[:-1], text)]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256))


def lowered_every_fifth() -> Column:
    """The leaf that a document has once A-Z of its text are lower-cased; null unless five divides the crc32 of its doc_id."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_digest(F.translate("text", _UPPER, _LOWER)))


def hashed(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def placed(rows: DataFrame, order: list[str], tag: str) -> DataFrame:
    """``rows`` with pos, the place among the rows of their tree in ``order``, and n, how many those are.

    Sorted runs are written once; the rows before a run in its trees come from a row a run and tree.
    """
    runs = Saved(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id()), tag).df
    runs = runs.withColumn("run", F.shiftright("at", 33))
    each = runs.groupBy("tree", "run").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("tree").orderBy("run")
    offsets = each.select(F.col("tree").alias("t"), F.col("run").alias("r"), "first", (F.sum("rows").over(before) - F.col("rows")).alias("before"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    joined = runs.join(small_side(offsets), F.col("tree").eqNullSafe(F.col("t")) & (F.col("run") == F.col("r")))
    return joined.select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n")


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each block; the rows arrive in order of tree and block."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True))
    for key, found in groupby(rows, key=lambda r: r[:2]):
        yield key, list(found)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_ABOVE = pa.schema([("level", pa.int32()), ("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])


def _folding(level: int):
    """The nodes of both levels above each block of nodes of ``level``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes() -> Iterator[tuple]:
            for (tree, block), rows in _blocks(batches, ["tree", "block", "n", "digest"]):
                digests, parents = [r[3].hex() for r in rows], -(-rows[0][2] // WIDTH)
                above = [hashed(digests[k : k + WIDTH]) for k in range(0, len(digests), WIDTH)]
                yield from ((level + 1, tree, block * WIDTH + k, parents, bytes.fromhex(d)) for k, d in enumerate(above))
                if parents > 1:
                    yield level + 2, tree, block, -(-parents // WIDTH), bytes.fromhex(hashed(above))

        yield from _batches(nodes(), _ABOVE, 10_000)

    return run


@dataclass
class Manifest:
    """A node store: ``folder``/level=<k> for k up to ``top``."""

    spark: object
    folder: str
    top: int

    def level(self, k: int, more: str = "") -> DataFrame:
        return self.spark.read.schema(_NODE + more).parquet(f"{self.folder}/level={k}")

    def roots(self) -> DataFrame:
        """(tree, level, digest) of each tree."""
        out = None
        for k in range(self.top + 1):
            part = self.level(k).where("n = 1").select("tree", F.lit(k).alias("level"), "digest")
            out = part if out is None else out.unionByName(part)
        return out


def stored(leaves: DataFrame, tag: str) -> Manifest:
    """Builds the store over ``leaves`` (tree, pos, n, digest; further columns stay at level 0), two levels a pass."""
    spark = leaves.sparkSession
    store = Manifest(spark, fresh_path(spark, tag), 0)
    leaves.write.parquet(f"{store.folder}/level=0")
    largest = store.level(0).agg(F.max("n")).first()[0] or 0
    while largest > 1:
        nodes = store.level(store.top).where("n > 1").withColumn("block", F.floor(F.col("pos") / WIDTH**2))
        ordered = nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        map_batches(ordered, _folding(store.top), f"level int, {_NODE}").write.partitionBy("level").mode("append").parquet(store.folder)
        store.top += 1 if largest <= WIDTH else 2
        largest = -(-largest // WIDTH**2)
    return store


def _steps(path: bytes) -> list[tuple[str, str]]:
    """The siblings left and right of a node, level by level upwards, from their stored form: two counts, then the digests."""
    out, at = [], 0
    while at < len(path):
        left, right = at + 2, at + 2 + 32 * path[at]
        end = right + 32 * path[at + 1]
        out.append((path[left:right].hex(), path[right:end].hex()))
        at = end
    return out


def _beside(digests: list[bytes], at: int) -> bytes:
    """The step from a node among its siblings, in stored form."""
    return bytes((at, len(digests) - at - 1)) + b"".join(digests[:at]) + b"".join(digests[at + 1 :])


def _scanned(batches: Iterator[pa.RecordBatch], more: list[str]) -> Iterator[tuple]:
    """(tree, pos, digest, path from the node to its block's end, path above the block, root of the tree, *more) of each node."""
    for (tree, _), rows in _blocks(batches, ["tree", "block", "kind", "pos", "n", "digest", "path", *more]):
        above, between = rows[0], [r[5] for r in rows[1:] if r[2] == 1]
        nodes = [r for r in rows[1:] if r[2] == 0]
        digests = [r[5] for r in nodes]
        for first in range(0, len(nodes), WIDTH):
            family = digests[first : first + WIDTH]
            second = _beside(between, first // WIDTH) if len(between) > 1 else b""
            for k, node in enumerate(nodes[first : first + WIDTH]):
                yield tree, node[3], node[5], (_beside(family, k) if node[4] > 1 else b"") + second, above[6], above[5], *node[7:]


def _descending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", pa.binary()), ("digest", pa.binary())])
    yield from _batches(((tree, pos, own + above, root) for tree, pos, _, own, above, root in _scanned(batches, [])), schema, 2_000)


def _merged(store: Manifest, stride: int, paths: DataFrame, more: str = "") -> DataFrame:
    """Nodes of level 2 ``stride``, those of the level between and the path of each block, block by block."""
    names = [part.split()[0] for part in more.split(", ")[1:]]
    blank = [F.lit(None).cast(part.split()[1]).alias(part.split()[0]) for part in more.split(", ")[1:]]
    block = lambda width: F.floor(F.col("pos") / width).alias("block")
    nothing = F.lit(None).cast("binary").alias("path")
    nodes = store.level(2 * stride, more).where("n > 1" if stride else "true")
    rows = nodes.select("tree", block(WIDTH**2), F.lit(0).alias("kind"), "pos", "n", "digest", nothing, *names)
    if 2 * stride < store.top:
        rows = rows.unionByName(store.level(2 * stride + 1).select("tree", block(WIDTH), F.lit(1).alias("kind"), "pos", "n", "digest", nothing, *blank))
    rows = rows.unionByName(paths.select("tree", F.col("pos").alias("block"), F.lit(2).alias("kind"), "pos", F.lit(0).cast("long").alias("n"), "digest", "path", *blank))
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", F.desc("kind"), "pos")


def block_paths(store: Manifest, ends: DataFrame) -> DataFrame:
    """(tree, pos, path, digest) of each block of leaves: the siblings above it and its tree's root, from the top down.

    ``ends`` (tree, level, path, digest) has the root of each tree, the level where it stands, and the path that goes on there.
    """
    top = max(0, (store.top - 1) // 2)
    paths = None
    for stride in range(top, -1, -1):
        entering = ends.where(F.greatest(F.lit(0), F.floor((F.col("level") - 1) / 2)) == stride).select("tree", F.lit(0).cast("long").alias("pos"), "path", "digest")
        paths = entering if paths is None else entering.unionByName(paths)
        if stride:
            paths = Saved(map_batches(_merged(store, stride, paths), _descending, "tree string, pos long, path binary, digest binary"), "paths").df
    return paths


def _proving(root: str):
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            known, upper = None, []
            for _, _, digest, own, above, subroot, doc_id, claimed in _scanned(batches, ["doc_id", "claimed"]):
                if known is not above:
                    known, upper = above, _steps(above)
                steps = _steps(own) + upper
                folded = (claimed or digest).hex()
                for left, right in steps:
                    folded = hashed([left, folded, right])
                yield doc_id, digest.hex(), subroot.hex(), root, hashed([x for step in steps for x in step]), folded, folded == root

        yield from _batches(rows(), schema, 5_000)

    return run


def merkle_proofs(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of ``docs``.

    ``docs`` has doc_id, source, lang, n_chars and text; further columns are ignored. ``claimed`` is the digest that is
    tried against the stored proof in place of the leaf, where it isn't null. Null fields have their own mark; a null
    source is a tree of its own and comes first, a null doc_id comes first in its tree. Rows that repeat a doc_id are
    leaves of their own in order of their digests. An empty table gives no rows. The store stays in the shared folder.
    """
    spark = docs.sparkSession
    claim = claimed if claimed is not None else F.lit(None).cast("binary")
    narrow = Saved(docs.select(F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("digest"), claim.alias("claimed")), "leaves")
    leaves = placed(narrow.df, ["doc_id", "digest"], "runs")
    store = stored(leaves, "merkle")
    narrow.drop()
    trees = placed(store.roots().select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("source"), "level", "digest"), ["source"], "trees")
    summit = stored(trees, "summit")
    tops = summit.level(0, ", source string, level int")
    root = summit.level(summit.top).where("n = 1").select(F.lower(F.hex("digest"))).first()  # one row
    start = summit.roots().select("tree", "level", F.lit(b"").alias("path"), "digest")
    across = map_batches(_merged(summit, 0, block_paths(summit, start)), _descending, "tree string, pos long, path binary, digest binary").select("pos", "path")
    ends = Saved(across.join(tops, "pos").select(F.col("source").alias("tree"), "level", "path", "digest"), "ends").df
    more = ", doc_id long, claimed binary"
    return map_batches(_merged(store, 0, block_paths(store, ends), more), _proving(root[0] if root else ""), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
