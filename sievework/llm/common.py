"""Shared helpers: reading a table, cutting lineage, Arrow record assembly."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that may be broadcast; its rows are counted first.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, named in ``spark.checkpoint.dir``.

    Only where neither that nor a checkpoint directory is set, and one
    machine is all there is, is a temporary one made.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not shared and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sievework-checkpoint-"))
        current = context._jsc.sc().getCheckpointDir()
    return shared or current.get()


def cut(df: DataFrame) -> DataFrame:
    """Materialises a small intermediate in the shared folder, which cuts its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle and checkpoint files of what is no longer referred to; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, which is materialised and has rows of this width, marked for broadcast where it is no larger than ``limit``."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives freed memory back.

    Workers outlive their tasks, and several wait in each executor; the C
    library would keep for them what the largest arrays took.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ragged(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List array of ``kind`` elements."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def planes(values: np.ndarray) -> bytes:
    """Fixed-width integers as byte planes, so that equal high bytes compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(data: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def tokenizer_dir(path: str | None = None) -> str:
    """Folder of the public vocabulary files; ``SIEVEWORK_TOKENIZERS`` overrides the default."""
    return path or os.environ.get("SIEVEWORK_TOKENIZERS", "/opt/tokenizers")
