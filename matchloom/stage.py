"""Cut a plan: write an intermediate table to the shared folder and read it back; remove it when it is done with.

Tables lie in one folder of the session, which goes when the driver ends. Within ``with
stages(spark):`` they lie in a folder of their own, which goes at the end of the block, so a
job or a micro-batch that has written its result leaves nothing behind.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a new local folder on one machine; on several, where each would write
    to its own disk and read nothing back, it raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="matchloom-stage-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def session_dir(spark: SparkSession) -> str:
    """The session's folder; it is removed when the driver's JVM ends."""
    folder = f"{shared_dir(spark)}/matchloom-{spark.sparkContext.applicationId}"
    files, path = _path(spark, folder)
    if files.mkdirs(path):
        files.deleteOnExit(path)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses, in the folder of the running block or of the session."""
    return f"{_FOLDER.get() or session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    files, path = _path(spark, folder)
    files.delete(path, True)


def replace(spark: SparkSession, old: str, new: str) -> None:
    """Put the folder ``new`` in the place of ``old``, which is moved aside first and removed last."""
    files, target = _path(spark, old)
    source, aside = _path(spark, new)[1], _path(spark, f"{old}-replaced")[1]
    if not files.exists(source):
        raise FileNotFoundError(new)
    files.delete(aside, True)
    if files.exists(target) and not files.rename(target, aside):
        raise OSError(f"{old} can't be moved aside")
    try:
        if not files.rename(source, target):
            raise OSError(f"{new} can't be moved to {old}")
    except Exception:
        files.rename(aside, target)
        raise
    files.delete(aside, True)


def restore(spark: SparkSession, folder: str) -> None:
    """Put back the folder that a replacement cut short between its two renames has left aside."""
    files, target = _path(spark, folder)
    aside = _path(spark, f"{folder}-replaced")[1]
    if not files.exists(target) and files.exists(aside):
        files.rename(aside, target)


@contextmanager
def stages(spark: SparkSession) -> Iterator[str]:
    """A folder for what is staged within the block; results must be written before its end."""
    folder = new_folder(spark, "run")
    token = _FOLDER.set(folder)
    try:
        yield folder
    finally:
        _FOLDER.reset(token)
        remove(spark, folder)


def staged_alone(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns as a written table; what it staged on the way is removed once the table is written."""
    path = new_folder(spark, name)
    with stages(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: joined by sorting, so it never goes whole through the driver.

    Spark guesses sizes from compressed files and doesn't count what an explode adds; a table that it takes for
    some megabytes and broadcasts may be a thousand times that.
    """
    return df.hint("merge")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: later joins read it instead of planning it again, and lost executors cost nothing of it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
