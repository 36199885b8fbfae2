"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
_OWN_DIR: list[str] = []
_KEPT: dict[tuple[str, str], object] = {}
#: Bytes of an Arrow batch (Spark: 64 MB), and the setting's name. A batch is held by the JVM and twice by its Python worker.
BATCH, BATCH_SETTING = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"


def kept(owner: str, key: str, make: Callable[[], T]) -> T:
    """What the tasks of one operator in a worker share, made once; a task of another operator there drops it."""
    if (owner, key) not in _KEPT:
        forget()
        _KEPT[owner, key] = make()
    return _KEPT[owner, key]  # type: ignore[return-value]


def forget() -> None:
    """Drop what another operator's tasks left in this worker, which Spark uses again, and give free memory back."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH`` for the jobs within, where the session does not name another size."""
    if spark.conf.get(BATCH_SETTING, None) is not None:
        yield
        return
    spark.conf.set(BATCH_SETTING, BATCH)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer parts than there are cores (a small file of one row group, say) dealt to all cores; others as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; one of our own only where none is set and all run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _OWN_DIR[0]


def write_out(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and gives the planner true sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def bounded_batches(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array of at most ``limit`` bytes each (a longer single text stands alone)."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held + n > limit and i > start:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array laid end to end and the n + 1 offsets of its rows (null: empty)."""
    arr = texts.fill_null("").cast(pa.large_binary())
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
