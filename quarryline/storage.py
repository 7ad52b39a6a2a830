"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
#: Paths of the steps that go when the innermost ``passing`` ends; none outside of any.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def shared_path(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Where nothing names a folder, a local session gets one of this machine; on a cluster
    executors would not see it, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarryline-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    if not _made:
        atexit.register(_clear_quietly, spark)
    _made.append(f"{base.rstrip('/')}/step-{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session with these settings, and afterwards with those it had."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Shuffle files of a query go when it ends; nothing reads them once its result is written.
CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


#: Writer options for rows of megabytes.  Parquet otherwise first looks at the size of what it holds after 100 rows,
#: and readers take a row group's rows, up to 4096, at once.
WIDE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def keep(df: DataFrame, *, wide: bool = False) -> DataFrame:
    """Writes a step's result and reads it again: later steps neither repeat it nor carry its plan.

    ``wide`` rows, of megabytes each, are written and read a few at a time.
    """
    path = shared_path(df.sparkSession)
    if (held := _passing.get()) is not None:
        held.append(path)
    with settings(df.sparkSession, CLEAN):
        df.write.options(**(WIDE_ROWS if wide else {})).parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession):
    """Steps that are kept inside go when this ends; what outlasts it is written by the function it gives.

    Nothing else that reads such steps may be used afterwards.
    """
    outer, own = _passing.get(), []
    mark = _passing.set(own)

    def stay(df: DataFrame) -> DataFrame:
        inner = _passing.set(outer)
        try:
            return keep(df)
        finally:
            _passing.reset(inner)

    try:
        yield stay
    finally:
        _passing.reset(mark)
        for path in own:
            if path in _made:
                _made.remove(path)
            remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the library's own."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Deletes what the steps of this process have written; nothing that reads it may be used afterwards."""
    while _made:
        remove_folder(spark, _made.pop())


def _clear_quietly(spark: SparkSession) -> None:
    try:
        clear(spark)
    except Exception:  # the session is gone, and its folder is the cluster's to clear
        _made.clear()
