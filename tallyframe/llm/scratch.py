"""Where intermediate results live: the folder in spark.checkpoint.dir, which every executor can read."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders written, with their session and the names of the scopes that they were written in.
_written: dict[str, tuple[SparkSession, tuple[str, ...]]] = {}
_scopes: list[str] = []
SWEEP, _swept = 2.0, 0.0


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only where none is set and all runs on one machine (tests), a new temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can read")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyframe-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame, rows_per_file: int | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage is cut, and a lost
    executor costs its own tasks only. Columns stay prunable. Removed when the process ends, or by ``release``.

    Shuffle files of what was written before are of no more use; the driver's collector lets go of them. (Those of
    ``df`` stay while the caller has it.)"""
    spark = df.sparkSession
    sweep(spark, SWEEP)
    path = f"{shared_dir(spark)}/tallyframe-stage-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    _written[path] = (spark, tuple(_scopes))
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, least: float = 0.0) -> None:
    """Shuffle files that nothing refers to any more are deleted as soon as the driver's collector finds that out.

    Events of the job that has just ended refer to its plan, so they are waited for. Does nothing if the last time was less than ``least`` seconds ago:
    jobs that follow each other fast leave little."""
    global _swept
    if time.monotonic() - _swept < least:
        return
    _swept = time.monotonic()
    gc.collect()
    with contextlib.suppress(Exception):  # it only comes later
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(5_000)
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Marks what is written inside, for ``release``."""
    _scopes.append(name)
    try:
        yield
    finally:
        _scopes.pop()


def release(name: str, keep: DataFrame | None = None) -> None:
    """Remove what was written in the scope of that name and ``keep`` does not read."""
    used = keep.inputFiles() if keep is not None else []
    for path, (spark, scopes) in list(_written.items()):
        if name in scopes and not any(path.rpartition("/")[2] in f for f in used):
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    del _written[path]
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


@atexit.register
def _tidy() -> None:
    for path, (spark, _) in list(_written.items()):
        _remove(spark, path)


def small_batches(spark: SparkSession) -> None:
    """Whole texts can be long: bound the Arrow batches handed to Python by bytes, not only by rows.

    Sets two settings of the session, which only say how rows are handed over; never above what the session has."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20), ("spark.sql.execution.arrow.maxRecordsPerBatch", 4000)):
        now = spark.conf.get(key, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def int_conf(spark: SparkSession, key: str, default: int) -> int:
    value = spark.conf.get(key, None)
    return int(value) if value else default
