"""Shared helpers: durable intermediate tables and per-worker caches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space separates words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Whether Spark deletes a job's shuffle files when the job ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and all runs on one machine (tests) a
    temporary folder is made and set; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    This cuts the lineage at a table that outlives any executor, so the shuffle
    files of the job that wrote it go with the job.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._palimpsest_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a table made by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_palimpsest_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def word_count(text: Column) -> Column:
    """Number of words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that few texts are Python objects at a time."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def worker_cache(owner: str) -> dict:
    """A dictionary that lives as long as the Python worker process, for one owner at a time.

    Workers serve one operator after another; what the last one kept is given
    back to the system before the next begins.
    """
    module = sys.modules.setdefault("palimpsest_worker_cache", types.ModuleType("palimpsest_worker_cache"))
    state = module.__dict__
    if state.get("owner") != owner:
        state["owner"], state["entries"] = owner, {}
        gc.collect()
        give_back()
    return state["entries"]


def give_back() -> None:
    """Return freed memory to the system, which else stays with an idle worker beside those that run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)
