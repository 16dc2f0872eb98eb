"""Best-two-fit packing of token sequences, planned over how many pieces of each length there are.

Pieces of one length are alike, so a plan needs their number only: at most as many figures as a sequence has tokens,
whatever the corpus. The plan fills a sequence greedily, longest piece first, then replaces its smallest piece with the
two unpacked ones that fill the wider gap best, and repeats the sequence while its pieces last. Tasks then give each
piece its place: the pieces of a length are numbered across the tasks, and a number is a sequence and an offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoders import ByteLevel, encoder
from .shared import Saved, map_batches, small_side, text_steps

LENGTH, END_ID = 1024, 2


@dataclass
class Plan:
    """For each length, where in the numbering of its pieces a row begins: its first sequence, how many of the pieces a sequence takes, and their first offset."""

    rows: dict[int, np.ndarray]  # columns: first number, first sequence, pieces a sequence, offset
    sequences: int

    def places(self, length: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self.rows[length][np.searchsorted(self.rows[length][:, 0], numbers, "right") - 1]
        inside = numbers - row[:, 0]
        return row[:, 1] + inside // row[:, 2], row[:, 3] + inside % row[:, 2] * length


def _two_for_one(left: np.ndarray, used: dict[int, int], gap: int) -> int:
    """Replace the smallest piece of ``used`` with the two unpacked pieces that fill most of its place and the gap; the new gap."""
    small = min(used)
    room = gap + small
    at = np.flatnonzero(left[: room + 1])  # lengths that are there, ascending
    if not gap or not len(at):
        return gap
    partner = np.searchsorted(at, np.minimum(room - at, at), "right") - 1  # the largest that fits beside, no larger than itself
    alone = (partner >= 0) & (at[partner] == at) & (left[at] < 2)
    partner = np.where(alone, partner - 1, partner)
    both = np.where(partner >= 0, at + at[partner], 0)
    best = int(len(both) - 1 - both[::-1].argmax())
    if both[best] <= small:
        return gap
    used[small] -= 1
    if not used[small]:
        del used[small]
    left[small] += 1
    for n in (int(at[best]), int(at[partner[best]])):
        used[n] = used.get(n, 0) + 1
        left[n] -= 1
    return room - int(both[best])


def plan_sequences(counts: np.ndarray, capacity: int) -> Plan:
    """``counts[n]`` pieces of n tokens into sequences of ``capacity``; without replacements where those need more sequences."""
    return min((_planned(counts, capacity, two) for two in (True, False)), key=lambda plan: plan.sequences)


def _planned(counts: np.ndarray, capacity: int, two: bool) -> Plan:
    left, taken = counts.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64)
    rows: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in np.flatnonzero(left).tolist()}
    sequences, longest = 0, capacity
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            break
        used, gap = {}, capacity
        while gap:
            fits = np.flatnonzero(left[: gap + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            used[n] = int(min(left[n], gap // n))
            left[n] -= used[n]
            gap -= used[n] * n
        while two and (narrower := _two_for_one(left, used, gap)) < gap:
            gap = narrower
        # as the pieces last, the same choices would be made again
        times = 1 + min(int(left[n]) // k for n, k in used.items())
        offset = 0
        for n in sorted(used, reverse=True):
            rows[n].append((int(taken[n]), sequences, used[n], offset))
            taken[n] += used[n] * times
            left[n] -= used[n] * (times - 1)
            offset += n * used[n]
        sequences += times
    return Plan({n: np.array(r, np.int64) for n, r in rows.items()}, sequences)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"
_NUMBERED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32")), ("task", pa.int32()), ("number", pa.int64())])


def _cutting(capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, task, seen = encoder(ByteLevel), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for step in text_steps(batch):
                rows = []
                for doc_id, text in zip(step.column("doc_id").to_pylist(), pc.fill_null(step.column("text"), "").to_pylist(), strict=True):
                    data = memoryview(np.concatenate((model.ids(text).astype("<u4"), end))).cast("B")
                    n = len(data) // 4
                    start = 0
                    for piece in range(-(-n // capacity)):
                        length = (n - 1) % capacity + 1 if not piece else capacity
                        rows.append((doc_id, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), task, seen[length]))
                        seen[length] += 1
                        start += length
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NUMBERED, strict=True)], schema=_NUMBERED)

    return run


def _placing(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                sequence[part], offset[part] = plan.places(int(length[part[0]]), number[part])
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, capacity: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of ``docs`` (doc_id, text; more is ignored).

    A document is its ids and ``end_id``; null texts count as empty and are the end id alone. Longer ones than
    ``capacity`` are cut into pieces of that size, of which the first has what is left over. Each row is packed, so rows
    that repeat a doc_id each have their pieces. An empty table gives no rows. Sequences are numbered from 0.
    """
    pieces = Saved(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _cutting(capacity, end_id), _PIECES), "pieces").df
    each = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))  # at most a row a length and task
    before = Window.partitionBy("length").orderBy("task")
    first = Saved(each.select(F.col("length").alias("l"), F.col("task").alias("t"), "n", (F.sum("n").over(before) - F.col("n")).alias("first")), "firsts").df
    counts = np.zeros(capacity + 1, np.int64)
    for row in first.groupBy("l").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row.l] = row.n
    numbered = pieces.join(small_side(first.drop("n")), (F.col("length") == F.col("l")) & (F.col("task") == F.col("t")))
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("first")).alias("number"))
    return map_batches(numbered, _placing(plan_sequences(counts, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
