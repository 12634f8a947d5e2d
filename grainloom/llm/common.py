"""What the operators share: reading tables, the shared folder, and small helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where neither the setting nor a checkpoint folder exists and all
    runs on one machine (as in tests) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = sc._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="grainloom-")
        sc.setCheckpointDir(folder)
    return folder


#: What stored() wrote since the innermost settled() began.
_WRITTEN: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("written", default=None)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: a cut in the lineage that outlives executors.

    The table goes when discard() or settled() removes it, or else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    if (written := _WRITTEN.get()) is not None:
        written.append((spark, path))
    out = spark.read.parquet(path)
    out.stored_at = path
    return out


def folder(spark: SparkSession, label: str) -> str:
    """The path of a new folder in the shared one, for files of other formats; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    fs, p = _file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)
    fs.cancelDeleteOnExit(p)


def discard(*tables: DataFrame | None) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            _remove(df.sparkSession, path)


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """stored(make()), after which all else that was stored on the way is deleted."""
    outer = _WRITTEN.set([])
    out = None
    try:
        out = stored(make(), label)
        return out
    finally:
        written = _WRITTEN.get()
        _WRITTEN.reset(outer)
        for spark, path in written:
            if out is None or path != out.stored_at:
                _remove(spark, path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: int = 1, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts (of column) are about size bytes together, or one row: so memory does not grow with a batch."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < len(batch):
        done = lengths[at - 1] if at else 0
        end = max(at + 1, int(lengths.searchsorted(done + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


#: Rows of an Arrow batch: the JVM's buffers and a worker's are as large as a batch of texts or lists.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside gets Arrow batches of BATCH_ROWS rows at most."""
    before = spark.conf.get(_BATCH)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


#: The number of this option in glibc's malloc.h.
_M_MMAP_THRESHOLD = -3


def slim() -> None:
    """Gives memory that this worker no longer uses back to the machine: workers are reused, and hold on to it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(_M_MMAP_THRESHOLD, 1 << 20)  # fixed: it grows with what is freed otherwise, and freed arrays stay in the heap
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def span_digest(spans: Column) -> Column:
    """kind:start:end of each span in the order given, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
