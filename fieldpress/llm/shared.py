"""Session helpers of the corpus operators: the shared scratch folder, table access, Arrow slicing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step works on; the temporaries of a step are some forty times as large.
SLICE_BYTES = 1 << 20
#: Largest serialised object that is broadcast; what may be larger takes its operator's other way.
BROADCAST_BYTES = 48 << 20
#: Most rows of a small table that a join broadcasts, after counting them.
BROADCAST_ROWS = 1 << 17


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one only where that is unset, on one machine."""
    sc = spark.sparkContext
    if not (base := sc.getCheckpointDir()):
        if base := sc.getConf().get("spark.checkpoint.dir", None):
            sc.setCheckpointDir(base)
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            own = tempfile.mkdtemp(prefix="fieldpress-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            sc.setCheckpointDir(f"file://{own}")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = sc.getCheckpointDir()
    return base


#: Scratch folders that are there.
_MADE: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by `discard` or when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not _MADE:
        atexit.register(_remove_all)
    _MADE[path] = spark
    return path


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all() -> None:
    while _MADE:
        path, spark = _MADE.popitem()
        with contextlib.suppress(Exception):  # the session may be gone
            _remove(spark, path)


def discard(*frames: DataFrame) -> None:
    """Remove the tables behind frames of `materialise` that nothing reads any more."""
    for df in frames:
        if (path := getattr(df, "_scratch", None)) and _MADE.pop(path, None):
            _remove(df.sparkSession, path)


def released(spark: SparkSession) -> None:
    """Shuffle files and checkpoints stay on disk while the driver's heap holds the frames that made them: let go of the dead ones."""
    gc.collect()
    spark._jvm.System.gc()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, so a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    released(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for small tables (links, labels); with spark.cleaner.referenceTracking.cleanCheckpoints Spark removes it with its last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hinted(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A table for the small side of a join: broadcast if it has at most `BROADCAST_ROWS` rows, else left to a shuffle."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def longs(df: DataFrame) -> list[np.ndarray]:
    """The columns of a frame of longs whose size is known to be bounded."""
    table = df.toArrow()
    return [np.concatenate([np.zeros(0, np.int64), *(c.to_numpy() for c in column.chunks)]) for column in table.columns]


def fresh(taken: list[str], name: str) -> str:
    """A column name that no column has, whatever its case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that a batch of very long texts still fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def texts_of(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, null text as empty: extra columns, whatever their names, never get in the way."""
    return docs.select(*[docs[c] for c in columns], F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches between rows so that each part has about `most` bytes of text; a longer row stands alone. At the end the worker gives its free memory back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
    trim()


def trim() -> None:
    """Workers are kept for later tasks: what a task has freed must not stay with an idle one."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU library
        ctypes.CDLL(None).malloc_trim(0)


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ids(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    return col(batch, name).to_numpy(zero_copy_only=False)
