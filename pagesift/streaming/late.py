"""Late rows: kept in a table of their own, with a reason, and counted while the stream runs.

The watermark of a source is its newest time in earlier micro-batches less a
delay. A row behind it is late: what it belongs to may have been reported
already. It does not vanish, as it would behind a stream's own watermark, but is
stored with how far it was behind. Other rows are judged by the run's window.

Everything a micro-batch stores, its times included, is under its own number,
and it looks at earlier ones only, so a repeated batch gives the same rows. Times
and counts are pre-aggregated: a source with most of the rows is no hot key.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagesift.operators import filters, report
from pagesift.plans.run import status_of
from pagesift.session import checked_broadcast, materialize, own_work
from pagesift.streaming.ingest import _finish, table_sink

TABLES = ("times", "records", "late", "counts")
TIMES = "source_name STRING, newest TIMESTAMP, batch BIGINT"


def watermarks(spark: SparkSession, home: str, before: int, delay: str) -> DataFrame:
    """``source_name, watermark`` from the micro-batches before this one."""
    try:
        times = spark.read.schema(TIMES).parquet(f"{home}/times").filter(F.col("batch") < before)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        times = spark.createDataFrame([], TIMES)
    newest = times.groupBy("source_name").agg(F.max("newest").alias("newest"))
    return newest.select("source_name", (F.col("newest") - F.expr(f"INTERVAL {delay}")).alias("watermark"))


def judged_by_time(
    rows: DataFrame, marks: DataFrame, window: tuple[datetime, datetime] | None, ts: str = "ts"
) -> DataFrame:
    """Add ``status, reason, behind_seconds``: late, outside the window, or good.

    A row without a time is never late, and the window keeps it.
    """
    known = rows.join(checked_broadcast(marks), "source_name", "left")
    behind = F.unix_micros(F.col("watermark")) - F.unix_micros(F.col(ts))
    late = F.coalesce(behind > 0, F.lit(False))
    inside = F.lit(True)
    if window is not None:
        inside = filters.within_window(ts, F.lit(window[0]), F.lit(window[1]))
    reason = F.when(late, "late").when(~inside, "window_filtered")
    judged = known.withColumns({"reason": reason, "behind_seconds": F.when(late, behind / 1e6)})
    status = F.when(F.col("reason") == "late", "skipped").otherwise(status_of(F.col("reason")))
    return judged.withColumn("status", status).drop("watermark")


def route_micro_batch(
    rows: DataFrame,
    batch_id: int,
    home: str,
    delay: str,
    window: tuple[datetime, datetime] | None = None,
    every: str = "1 minute",
    ts: str = "ts",
) -> None:
    """One micro-batch of ``route_stream``; may be repeated."""
    spark = rows.sparkSession
    with own_work(spark):
        marks = watermarks(spark, home, batch_id, delay)
        judged = materialize(judged_by_time(rows, marks, window, ts), "judged")
        table_sink(f"{home}/records")(judged.filter("reason IS NULL").drop("reason", "status", "behind_seconds"), batch_id)
        table_sink(f"{home}/late")(judged.filter("reason = 'late'").drop("status"), batch_id)
        slots = judged.groupBy("source_name", F.window(ts, every).alias("_slot")).agg(
            *report.counters(), F.count_if(F.col("reason") == "late").alias("late")
        )
        table_sink(f"{home}/counts")(slots.select("source_name", F.col("_slot.start").alias("slot_start"), *report.COUNTERS, "late"), batch_id)
        # Last, so that a batch has its times only once the rest is stored.
        table_sink(f"{home}/times")(judged.groupBy("source_name").agg(F.max(ts).alias("newest")), batch_id)


def route_stream(
    rows: DataFrame,
    home: str,
    delay: str,
    window: tuple[datetime, datetime] | None = None,
    every: str = "1 minute",
    ts: str = "ts",
    trigger: str | None = None,
) -> StreamingQuery:
    """Route a stream into ``home``: records, late rows, and counts per source and slot.

    ``rows`` has source_name and ``ts``. Rows without a time are in no slot.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        route_micro_batch(batch, batch_id, home, delay, window, every, ts)

    return _finish(rows, work, f"{home}/checkpoint", trigger)


def live_counts(spark: SparkSession, home: str) -> DataFrame:
    """Counts so far: one small row per batch, source and slot is summed up, no record is read."""
    counts = spark.read.parquet(f"{home}/counts")
    names = [*report.COUNTERS, "late"]
    return counts.groupBy("source_name", "slot_start").agg(*[F.sum(c).alias(c) for c in names])
