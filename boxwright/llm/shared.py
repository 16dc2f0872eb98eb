"""Shared-folder tables and Arrow batch helpers used by the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at; a single longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Bytes of an Arrow batch on its way to a Python worker, at most (and one row). Spark's own bound is 64 MB, and its
#: buffers double as they grow, so a task could hold several times that outside the heap.
ARROW_BYTES = 4 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Tables of identifiers up to this many rows are broadcast (16 bytes each); longer ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000


@lru_cache(maxsize=1)
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="boxwright-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset and all tasks run in the driver's process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (folder or _local_folder()).rstrip("/")


#: Paths made within each open ``scratch``.
_SCRATCH: list[list[str]] = []


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_folder(spark)}/boxwright-{tag}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, what was written to fresh paths within it, but for what ``kept`` takes out."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove(spark, path)


def kept(saved: Saved) -> Saved:
    """A table that outlives the innermost ``scratch`` that it was written in; an outer one still has it."""
    if _SCRATCH and saved.path in _SCRATCH[-1]:
        _SCRATCH[-1].remove(saved.path)
        for outer in _SCRATCH[-2:-1]:
            outer.append(saved.path)
    return saved


class Saved:
    """A DataFrame written once to the shared folder and read back, which cuts its lineage and survives lost executors."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = fresh_path(self.spark, tag)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


#: What this worker keeps for further tasks of a stage, and the number of that stage.
_HELD: dict[tuple, object] = {}
_STAGE = [-1]


def held[T](key: tuple, make: Callable[[], T]) -> T:
    """A large table of a worker, made once for all its tasks of a stage. Workers outlive stages: the next one lets it go."""
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Clears what the worker keeps from another stage than its task's."""
    task = TaskContext.get()
    if task is not None and task.stageId() != _STAGE[0]:
        _STAGE[0] = task.stageId()
        _HELD.clear()


def _letting_go(function):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()  # by name: this function is sent to the workers with copies of its globals
        yield from function(batches)

    return run


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches of ARROW_BYTES at most.

    A plan takes the bound from the session when it runs, which may be after this call, so the session keeps it.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_ARROW, None) or 1 << 40) > ARROW_BYTES:
        conf.set(_ARROW, str(ARROW_BYTES))
    return df.mapInArrow(_letting_go(function), schema)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path by Spark's own file system client, so any store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text has about ``most`` bytes, each of one row at least."""
    import numpy as np

    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    total = np.cumsum(sizes)
    row = 0
    while row < batch.num_rows:
        before = total[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(row, stop - row)
        row = stop
    pa.default_memory_pool().release_unused()


def small_side(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``ids``, marked for a broadcast only if a count shows that it has few rows."""
    return F.broadcast(ids) if ids.count() <= most else ids
