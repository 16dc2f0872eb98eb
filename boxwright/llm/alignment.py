"""Alignment of two tokenizers over the same bytes: groups, links, and how often each pair of ids is linked.

Both tokenizations spell a text's bytes, so their token ends are two ascending lists; where both have the same end a group
ends. Every token of one side is linked with every token of the other in its group. A task merges the two lists of
many texts at once and stores each document's distinct pairs with their multiplicity. Spark counts the documents of each
pair, partial sums first, takes the highest count of each id on either side, and joins both back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoders import ByteLevel, Spaced, encoder
from .shared import Saved, map_batches, small_side, text_steps

#: A pair is its A id times this and its B id; rows of the table of pairs up to which it is broadcast (32 bytes each).
SHIFT, BROADCAST_PAIRS = 1 << 16, 2_000_000
#: Links and distinct pairs that are laid out at once.
LINKS = 1 << 21
STEP = 256 << 10
_ROWS = "doc_id long, row long, part int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("part", pa.int32()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])


class Merger:
    """Both encoders with what their ids stand for."""

    def __init__(self):
        self.a, self.b = ByteLevel(True), Spaced()
        tables = [self.a.token_bytes, self.b.token_bytes]
        self.sizes = [np.array([len(t) for t in table], np.int64) for table in tables]
        self.spelled = [pa.array(table, pa.binary()) for table in tables]
        #: Texts of an id before each separator: A then "," or "|", B then "," or ";".
        most = max(map(len, tables))
        self.most = most
        self.written = pa.array([f"{i}{mark}".encode() for mark in ",|,;" for i in range(most)], pa.binary())

    def _spells(self, side: int, ids: np.ndarray, wanted: bytes) -> bool:
        return self.sizes[side][ids].sum() == len(wanted) and _joined(self.spelled[side], ids) == wanted

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text on either side; none where a side doesn't spell a space and the text."""
        left, right = [], []
        for text, b in zip(texts, self.b.ids(texts), strict=True):
            a, b, wanted = self.a.ids(" " + text) if text else np.zeros(0, np.uint32), np.asarray(b, np.int64), b" " + text.encode()
            a = a.astype(np.int64)
            same = bool(text) and self._spells(0, a, wanted) and self._spells(1, b, wanted)
            left.append(a if same else a[:0])
            right.append(b if same else b[:0])
        return left, right


def _joined(table: pa.Array, at: np.ndarray) -> bytes:
    taken = table.take(pa.array(at))
    bounds = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, 4 * taken.offset) if len(taken) else [0, 0]
    return bytes(memoryview(taken.buffers()[2])[bounds[0] : bounds[-1]]) if len(taken) else b""


def merged_ends(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token of either side, and how many groups there are; texts may follow one another."""
    ends_a, ends_b = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return np.searchsorted(common, ends_a), np.searchsorted(common, ends_b), len(common)


def _products(a: np.ndarray, b: np.ndarray, counts_a: np.ndarray, counts_b: np.ndarray) -> np.ndarray:
    """The pairs of all tokens of each group; counts by group, tokens in order of groups."""
    first = np.cumsum(counts_b) - counts_b  # of the group's B tokens
    wide = np.repeat(counts_b, counts_a)  # partners of each A token
    step = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
    return np.repeat(a, wide) * SHIFT + b[np.repeat(np.repeat(first, counts_a), wide) + step]


def _summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(pairs, return_inverse=True)
    return found, np.bincount(at, times, len(found)).astype(np.int64)


def document_pairs(a: np.ndarray, b: np.ndarray, groups_a: np.ndarray, groups_b: np.ndarray, n: int, most: int = LINKS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs of one text with their links, in parts that share no pair and cost about ``most`` links each.

    A part takes a range of A ids. In it a group counts its equal ids once with their number, so a group costs the
    product of its distinct ids.
    """
    wide = np.bincount(groups_b, minlength=n)[groups_a]
    order = np.argsort(a, kind="stable")
    cost = np.cumsum(wide[order])
    low = 0
    while low < len(order):
        high = max(low + 1, int(np.searchsorted(cost, (cost[low - 1] if low else 0) + most, "right")))
        high = int(np.searchsorted(a[order], a[order[high - 1]], "right"))  # an id stays together
        chosen = np.sort(order[low:high])
        inside = np.unique(groups_a[chosen])
        pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(inside), 20_000):
            some = inside[at : at + 20_000]
            ga = chosen[np.searchsorted(groups_a[chosen], some[0]) : np.searchsorted(groups_a[chosen], some[-1], "right")]
            gb = np.flatnonzero(np.isin(groups_b, some))
            ka, na = np.unique(np.searchsorted(some, groups_a[ga]) * SHIFT + a[ga], return_counts=True)
            kb, nb = np.unique(np.searchsorted(some, groups_b[gb]) * SHIFT + b[gb], return_counts=True)
            ca, cb = (np.bincount(k // SHIFT, minlength=len(some)) for k in (ka, kb))
            made = _products(ka % SHIFT, kb % SHIFT, ca, cb)
            weight = _products(na, nb, ca, cb)
            pairs, times = _summed(np.concatenate((pairs, made)), np.concatenate((times, (weight // SHIFT) * (weight % SHIFT))))
        yield pairs, times
        low = high


def _linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    both: Merger = encoder(Merger)
    row = TaskContext.get().partitionId() << 40  # rows that repeat a doc_id stay apart
    for batch in batches:
        for step in text_steps(batch, most=STEP):
            ids, texts = step.column("doc_id").to_pylist(), pc.fill_null(step.column("text"), "").to_pylist()
            left, right = both.tokens(texts)
            sizes = np.array([[len(x), len(y)] for x, y in zip(left, right, strict=True)], np.int64)
            a, b = np.concatenate(left), np.concatenate(right)
            groups_a, groups_b, n = merged_ends(a, b, *both.sizes)
            counts_a, counts_b = np.bincount(groups_a, minlength=n), np.bincount(groups_b, minlength=n)
            text_of_a = np.repeat(np.arange(len(ids)), sizes[:, 0])
            text_of_group = text_of_a[np.cumsum(counts_a) - counts_a] if n else np.zeros(0, np.int64)
            links = np.bincount(text_of_group, counts_a * counts_b, len(ids)).astype(np.int64)
            hashes = _written(both, a, b, groups_a, groups_b, sizes)
            if links.sum() <= 8 * LINKS:
                keyed = _products(a, b, counts_a, counts_b) + (np.repeat(text_of_group, counts_a * counts_b) << 32)
                found, times = np.unique(keyed, return_counts=True)
                bounds = np.searchsorted(found, np.arange(len(ids) + 1) << 32)
                parts = [[(found[x:y] & 0xFFFFFFFF, times[x:y])] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            else:
                parts, at_a, at_b = [], 0, 0
                for (x, y), k in zip(sizes.tolist(), np.bincount(text_of_group, minlength=len(ids)).tolist(), strict=True):
                    ga, gb = groups_a[at_a : at_a + x], groups_b[at_b : at_b + y]
                    parts.append(document_pairs(a[at_a : at_a + x], b[at_b : at_b + y], ga - ga[:1], gb - gb[:1], k) if x else [])
                    at_a, at_b = at_a + x, at_b + y
            n_groups = np.bincount(text_of_group, minlength=len(ids))
            out, held = [], 0
            for k, doc_id in enumerate(ids):
                first = True
                for pairs, times in parts[k]:
                    figures = (*sizes[k].tolist(), int(n_groups[k]), int(links[k]), hashes[k]) if first else (0, 0, 0, 0, None)
                    out.append((doc_id, row, 0 if first else 1, *figures, (pairs - (1 << 31)).astype(np.int32), times.astype(np.int32)))
                    first, held = False, held + len(pairs)
                    if held > LINKS:
                        yield _rows(out)
                        out, held = [], 0
                if first:
                    out.append((doc_id, row, 0, 0, 0, 0, 0, hashes[k], np.zeros(0, np.int32), np.zeros(0, np.int32)))
                row += 1
            if out:
                yield _rows(out)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(c, f.type) for c, f in zip(columns[:8], _SCHEMA, strict=False)]
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in columns[8]]))).astype(np.int32)
    return pa.record_batch([*arrays, *(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(c))) for c in columns[8:])], schema=_SCHEMA)


def _written(both: Merger, a: np.ndarray, b: np.ndarray, groups_a: np.ndarray, groups_b: np.ndarray, sizes: np.ndarray) -> list[str]:
    """sha256 of each text's groups written out; empty without tokens."""
    last = lambda groups: np.append(groups[1:] != groups[:-1], True) if len(groups) else np.zeros(0, bool)
    entries = np.concatenate((a + both.most * last(groups_a), b + both.most * (2 + last(groups_b))))
    order = np.argsort(np.concatenate((2 * groups_a, 2 * groups_b + 1)), kind="stable")
    taken = both.written.take(pa.array(entries[order]))
    if not len(taken):
        return [""] * len(sizes)
    data, offsets = memoryview(taken.buffers()[2]), np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, 4 * taken.offset)
    bounds = offsets[np.concatenate(([0], np.cumsum(sizes.sum(1))))]
    return [sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def linked(docs: DataFrame) -> Saved:
    """The links table: doc_id, row, part, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times; a row a document, and one more for each further part of a long one.

    Pairs are less 2^31, as they are stored in 32 bits. Texts without tokens have empty lists.
    """
    return Saved(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _linking, _ROWS), "links")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, a, b, n, best_a, best_b): in how many documents each pair is linked, and whether no pair of its A id, or of its B id, is in more."""
    counts = Saved(links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs").df
    whole = F.col("pair").cast("long") + (1 << 31)
    counts = counts.select("pair", F.floor(whole / SHIFT).cast("int").alias("a"), (whole % SHIFT).cast("int").alias("b"), "n")
    # at most a row an id
    most_a = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("most_a")))
    most_b = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("most_b")))
    return counts.join(most_a, "a").join(most_b, "b").select("pair", "a", "b", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b"))


def aligned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum, groups_sha256) of each row of ``docs`` (doc_id, text; more is ignored).

    Null and empty texts, and texts that a side doesn't spell byte by byte, have no tokens: zeros and an empty hash. Each
    row, repeated or without a doc_id, is a document of its own. An empty table gives no rows.
    """
    links = linked(docs).df
    counts = small_side(Saved(pair_counts(links), "counted").df.select("pair", "n", "best_a", "best_b"), BROADCAST_PAIRS)
    each = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
    best = lambda flag: F.sum(F.when(F.col(flag), F.col("times")).otherwise(0))
    sums = each.join(counts, "pair").groupBy("row").agg(best("best_a").alias("n_best"), best("best_b").alias("n_best_b"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = links.where("part = 0").drop("pairs", "times", "part").join(sums, "row", "left")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("n_best_b"), zero("count_sum"), "groups_sha256")
