"""Shared folders, intermediate tables and file access for the operators of this subpackage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        base = "file://" + tempfile.mkdtemp(prefix="lumispan-")
        spark.sparkContext.setCheckpointDir(base)
        return spark.sparkContext.getCheckpointDir() or base
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def short_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Hold Arrow batches of this session at ``rows`` and ``size``, and those of the Parquet reader at ``rows``.

    Texts can be long, and a batch is in memory several times over: in the reader, as Arrow beside the heap, and in the worker.
    """
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(key)) <= rows:
            spark.conf.set(key, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again, which cuts its lineage."""
    spark = df.sparkSession
    short_batches(spark)
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI or plain path; works on executors."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri)


def make_dir(uri: str) -> str:
    f, path = filesystem(uri)
    f.create_dir(path, recursive=True)
    return uri


_caches: dict[str, dict] = {}


def worker_cache(owner: str, key, make):
    """``make()`` of this worker process and key, made once.

    Workers are used again by other stages. What other owners hold is let go first, with the memory that the allocators keep.
    """
    if owner not in _caches:
        _caches.clear()
        _frugal()
        release()
        _caches[owner] = {}
    held = _caches[owner]
    if key not in held:
        while len(held) >= 2:
            held.pop(next(iter(held)))
        held[key] = make()
    return held[key]


def _frugal() -> None:
    """Let this process give large blocks back when they are free: executors share their memory with the JVM."""
    import ctypes

    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which also holds it there
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD


def release() -> None:
    """Give free memory of this process back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch, rows: int) -> Iterator:
    """Parts of an Arrow batch, of so many rows at most."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def small_slices(batch, column: int, most_bytes: int = 1 << 20, rows: int = 2048) -> Iterator:
    """Parts of an Arrow batch whose strings in ``column`` have about ``most_bytes`` at most (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and (total + n > most_bytes or i - at >= rows):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)


def with_columns(docs: DataFrame, fields: str, columns) -> DataFrame:
    """``docs`` with new columns (``fields``, a schema string) from ``columns(batches)``.

    ``columns`` takes an iterator of Arrow batches and gives, for each slice that it makes of them, the slice and the list of
    its new arrays. Columns of ``docs`` with the names of new ones are replaced.
    """
    import pyarrow as pa

    short_batches(docs.sparkSession)
    names = [f.split()[0] for f in fields.split(", ")]
    kept = docs.drop(*names)
    added = docs.sparkSession.createDataFrame([], fields).schema
    schema = type(added)([*kept.schema.fields, *added.fields])
    old = kept.columns

    def run(batches):
        for some, new in columns(batches):
            yield pa.RecordBatch.from_arrays([*some.columns, *new], names=[*old, *names])

    return kept.mapInArrow(run, schema)
