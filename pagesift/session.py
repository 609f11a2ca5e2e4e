"""Session-side helpers: shared work folder, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Most that a table may have, as text, to be sent to every executor.
MAX_BROADCAST_BYTES = 32 << 20

# Folder of the work that is going on, below the session's; see ``own_work``.
_OWN_FOLDER: ContextVar[str] = ContextVar("own_folder", default="")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written intermediates, on the cluster's shared storage.

    The place is the session's ``spark.checkpoint.dir``. Only a local session, as
    in tests, may do without: it gets a temporary one. On a cluster a folder of
    one machine would lose rows, so there a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pagesift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{session_folder(spark, base)}{_OWN_FOLDER.get()}/{name}-{uuid.uuid4().hex}"


def session_folder(spark: SparkSession, base: str) -> str:
    return f"{base.rstrip('/')}/pagesift-{spark.sparkContext.applicationId}"


def clear_work(spark: SparkSession) -> None:
    """Remove what this session's steps have written; call it once results are written.

    Frames returned by earlier calls can't be read any more.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        delete_matching(spark, session_folder(spark, base))


def delete_matching(spark: SparkSession, pattern: str) -> None:
    """Remove the folders that fit a path pattern; none need be there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in system.globStatus(path) or []:
        system.delete(found.getPath(), True)


@contextmanager
def own_work(spark: SparkSession) -> Iterator[None]:
    """Work whose written steps go when it ends; its results must be stored by then."""
    inner = f"{_OWN_FOLDER.get()}/own-{uuid.uuid4().hex}"
    token = _OWN_FOLDER.set(inner)
    try:
        yield
    finally:
        _OWN_FOLDER.reset(token)
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base:
            delete_matching(spark, f"{session_folder(spark, base)}{inner}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a step once and read it back: cuts lineage, survives lost executors."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether the rows, written as JSON, stay within the limit: an aggregate of one row."""
    length = F.octet_length(F.to_json(F.struct("*")))
    return (df.agg(F.sum(length.cast("bigint")).alias("n")).first().n or 0) <= max_bytes


def checked_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast hint for a settings table or a short list, only after measuring it.

    A larger table is returned without the hint: the join then shuffles and AQE
    splits its skewed keys.
    """
    return F.broadcast(df) if is_small(df) else df
