"""JSON run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.times import coerce_ts
from pagesift.schemas import LOG


def read_logs(spark: SparkSession, path: str | list[str], schema: str = LOG) -> DataFrame:
    return spark.read.schema(schema).json(path)


def log_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files of a log folder or pattern with their time of change in milliseconds, newest first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(place) and system.getFileStatus(place).isDirectory():
        place = spark._jvm.org.apache.hadoop.fs.Path(place, "*")
    found = [s for s in system.globStatus(place) or [] if s.isFile() and s.getPath().getName()[0] not in "._"]
    return sorted(((s.getPath().toString(), s.getModificationTime()) for s in found), key=lambda f: (-f[1], f[0]))


def newest_lines(
    spark: SparkSession, path: str, n: int = 100, source: str | None = None, schema: str = LOG,
    ts: str = "timestamp", source_col: str = "source",
) -> DataFrame:
    """``recent_log`` over rotated files, of which no more are read than needed.

    A line is not newer than the last change of its file. So once ``n`` lines are
    later than the change of the next older file, no older file can have one of
    the newest ``n``. Files are taken newest first, twice as many each time. Lines
    without a readable time count as the oldest.
    """
    files = log_files(spark, path)
    taken = 1
    while taken < len(files):
        logs = read_logs(spark, [name for name, _ in files[:taken]], schema)
        if source is not None:
            logs = logs.filter(F.col(source_col) == source)
        # File systems keep times to the second at worst.
        sure = coerce_ts(f"`{ts}`") > F.timestamp_millis(F.lit(files[taken][1] + 1000))
        if logs.filter(sure).limit(n).count() >= n:
            break
        taken *= 2
    if not files:
        return recent_log(spark.createDataFrame([], schema), source, n, ts, source_col)
    return recent_log(read_logs(spark, [name for name, _ in files[:taken]], schema), source, n, ts, source_col)


def recent_log(
    logs: DataFrame, source: str | None = None, n: int = 100, ts: str = "timestamp", source_col: str = "source"
) -> DataFrame:
    """Newest n lines of all sources or of one: a distributed top-n, no full sort."""
    if source is not None:
        logs = logs.filter(F.col(source_col) == source)
    return logs.orderBy(F.desc(ts), *[c for c in logs.columns if c != ts]).limit(n)
