"""Large JSON documents in parts: the members of top-level arrays as rows, read by many tasks, and one document written by many.

A document is cut into byte ranges without knowing its structure. One pass summarises each range for both cases, that it
begins inside a string and that it doesn't: how the depth of brackets changes, and which key opened the last array at each
depth. The summaries, a row a range, are joined in order, so each range knows how it begins. A second pass cuts out the members
that begin in a range. Nothing but the members that one range holds is in memory at once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.saved import checkpointed

RANGE = 32 << 20
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')
#: How far before an array its key is looked for; a longer key is none that is read.
_REACH = 256


def _marks(data: bytes, inside: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """Places of brackets outside strings with their change of depth; whether the text ends inside a string, and after a backslash there."""
    text = np.frombuffer(data, np.uint8)
    slashes = np.flatnonzero(text == 0x5C)
    quoted = np.flatnonzero(text == 0x22)
    if len(slashes) or escaped:
        # a character is escaped if the run of backslashes before it is odd; one open at the start counts as a backslash before it
        at = np.concatenate(([-1], slashes)) if escaped else slashes
        run_start = np.concatenate(([True], at[1:] != at[:-1] + 1))
        head = np.maximum.accumulate(np.where(run_start, at, -2))
        odd = at[(at - head) % 2 == 0]  # backslashes that escape what follows
        ends = np.isin(odd + 1, at, invert=True)
        quoted = np.setdiff1d(quoted, odd[ends] + 1, assume_unique=True)
        last = bool(len(at) and at[-1] == len(text) - 1 and (at[-1] - head[-1]) % 2 == 0)
    else:
        last = False
    place = np.flatnonzero(((text | 0x20) == 0x7B) | ((text | 0x20) == 0x7D))
    outside = (np.searchsorted(quoted, place) + inside) % 2 == 0
    place = place[outside]
    return place, np.where((text[place] | 0x20) == 0x7B, 1, -1).astype(np.int64), bool((len(quoted) + inside) % 2), last


def _key_before(data: bytes, at: int) -> str | None:
    found = _KEY.search(data, max(0, at - _REACH), at)
    return found[1].decode("utf-8", "replace") if found else None


def _read(path: str, start: int, size: int) -> bytes:
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path)
    with files.open_input_file(name) as file:
        return file.read_at(min(size, max(0, file.size() - start)), start)


_SUMMARY = "path string, start long, inside boolean, escaped boolean, change long, ends_inside boolean, ends_escaped boolean, keys map<long,string>"


def _summarising(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("start", pa.int64()), ("inside", pa.bool_()), ("escaped", pa.bool_()), ("change", pa.int64()), ("ends_inside", pa.bool_()), ("ends_escaped", pa.bool_()), ("keys", pa.map_(pa.int64(), pa.string()))])
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                before = min(start, _REACH)
                data = _read(path, start - before, size + before)
                rows = []
                for inside, escaped in ((False, False), (True, False), (True, True)):
                    place, step, ends_inside, ends_escaped = _marks(data[before:], inside, escaped)
                    level = (np.cumsum(step) - 1)[step > 0]
                    # np.unique gives the first of the reversed ones: the last bracket opened at each depth
                    depths, last = np.unique(level[::-1], return_index=True)
                    keys = {k: _key_before(data, before + int(place[step > 0][::-1][j])) for k, j in zip(depths.tolist(), last.tolist(), strict=True)}
                    rows.append({"path": path, "start": start, "inside": inside, "escaped": escaped, "change": int(step.sum()), "ends_inside": ends_inside, "ends_escaped": ends_inside and ends_escaped, "keys": list(keys.items())})
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return run


_RECORDS = "path string, section string, place long, value string"


def _cutting(size: int, wanted: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("section", pa.string()), ("place", pa.int64()), ("value", pa.string())])
        for batch in batches:
            for path, start, inside, escaped, depth, section in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "inside", "escaped", "depth", "section")), strict=True):
                before = min(start, _REACH)
                data, reach = _read(path, start - before, size + before), size
                while True:
                    place, step, *_ = _marks(data[before:], inside, escaped)
                    after = depth + np.cumsum(step)
                    begins = place[(step > 0) & (after == 3) & (place < size)]
                    ends = place[(step < 0) & (after == 2)]
                    if not len(begins) or (len(ends) and ends[-1] > begins[-1]):
                        break
                    more = _read(path, start + reach, size)  # the last member goes on
                    if not more:
                        begins = begins[:-1]
                        break
                    data, reach = data + more, reach + size
                arrays = place[(step > 0) & (after == 2)]
                names = [section, *(_key_before(data, before + int(at)) for at in arrays)]
                own = np.searchsorted(arrays, begins, "right")
                stop = ends[np.searchsorted(ends, begins)] if len(begins) else begins
                rows = [(path, names[k], start + a, data[before + a : before + b + 1].decode("utf-8", "replace")) for k, a, b in zip(own.tolist(), begins.tolist(), stop.tolist(), strict=True) if names[k] in wanted]
                for k in range(0, len(rows), 20_000):
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 20_000], strict=True), schema, strict=True)], schema=schema)

    return run


def members(spark: SparkSession, files: DataFrame, sections: tuple[str, ...], size: int = RANGE) -> DataFrame:
    """(path, section, place, value): the objects in the top-level arrays of JSON documents, each as its own text.

    ``files`` has path and length (bytes), as ``list_files`` gives them. place is the byte where a member begins, so it
    orders them. A document's ranges of ``size`` bytes are read by different tasks.
    """
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("start"))
    # a task a range: a range has few bytes in this table, but many to read
    ranges = ranges.repartition(max(1, ranges.count()))
    known: dict[tuple, object] = {(r.path, r.start, r.inside, r.escaped): r for r in ranges.mapInArrow(_summarising(size), _SUMMARY).collect()}  # three rows a range
    begins, state = [], (None, False, False, 0, None)
    for path, start in sorted({key[:2] for key in known}):
        if path != state[0]:
            state = (path, False, False, 0, None)
        _, inside, escaped, depth, section = state
        begins.append((path, start, inside, escaped, depth, section))
        row = known[path, start, inside, inside and escaped]
        section = row["keys"].get(1 - depth, section)
        state = (path, row.ends_inside, row.ends_escaped, depth + row.change, section)
    table = spark.createDataFrame(begins, "path string, start long, inside boolean, escaped boolean, depth long, section string")
    return table.repartition(max(1, len(begins))).mapInArrow(_cutting(size, sections), _RECORDS)


def _placing(target: str, offsets: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written, out = 0, None
        for batch in batches:
            if batch.num_rows:
                if out is None:
                    out = os.open(target, os.O_WRONLY)
                    os.lseek(out, offsets[batch.column("at")[0].as_py() >> 33], os.SEEK_SET)
                data = memoryview("".join(batch.column("text").to_pylist()).encode())
                while len(data):
                    n = os.write(out, data)
                    written, data = written + n, data[n:]
        if out is not None:
            os.fsync(out)
            os.close(out)
        yield pa.record_batch([pa.array([written], pa.int64())], names=["n"])

    return run


def write_joined(texts: DataFrame, path: str, *order: str) -> None:
    """The texts of all rows, one after the other in ``order``, as one file that appears once it is whole.

    ``texts`` has text. Rows are sorted in ranges; the bytes of the ranges, a row each, give every task its place in the file,
    so tasks write side by side and one that runs again writes the same bytes. The folder of ``path`` must be mounted on all machines.
    """
    rows = checkpointed(texts.repartitionByRange(*order).sortWithinPartitions(*order).select("text", F.monotonically_increasing_id().alias("at")))
    sizes = sorted((r.run, r.n) for r in rows.groupBy(F.shiftright("at", 33).alias("run")).agg(F.sum(F.octet_length("text")).alias("n")).collect())
    offsets, total = {}, 0
    for run, n in sizes:
        offsets[run], total = total, total + n
    target = path.removeprefix("file://")
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    part = f"{target}.part"
    with open(part, "wb") as out:
        out.truncate(total)
    written = rows.mapInArrow(_placing(part, offsets), "n long").agg(F.sum("n")).first()[0] or 0
    if written != total:
        raise OSError(f"{written} of {total} bytes written to {part}")
    os.replace(part, target)
