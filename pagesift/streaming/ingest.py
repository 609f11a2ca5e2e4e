"""Structured Streaming: the batch run per micro-batch, exactly once.

Order inside a micro-batch: records first, then history, both written under the
batch's id. A repeated batch first removes what its earlier try stored under
that id, so nothing of it stays if the second try gives other rows or none.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagesift.operators import dedup, report
from pagesift.plans.run import RunOptions, run_batch
from pagesift.session import delete_matching, materialize, own_work, work_folder
from pagesift.sources.history import append_bits, append_history, is_stored, read_history, read_membership
from pagesift.sources.history_merge import merge_batches

Sink = Callable[[DataFrame, int], None]


def page_stream(
    spark: SparkSession,
    path: str,
    schema: str,
    fmt: str = "parquet",
    glob: str | None = None,
    files_per_batch: int = 1000,
    table: str | None = None,
) -> DataFrame:
    """Files that arrive in a folder; the schema is given, never inferred.

    With ``table``, the stream is that table of the folder, ``<table>.parquet``,
    be it one file or a folder of part files.
    """
    if table is not None:
        # A pattern that only fits this name: a single file is then listed too.
        path = f"{path}/{table}.parquet*"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(fmt).load(path)


def table_sink(path: str) -> Sink:
    """Parquet partitioned by batch; a repeated batch replaces its own part."""

    def write(records: DataFrame, batch_id: int) -> None:
        (
            records.withColumn("batch", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(path)
        )

    return write


def _finish(stream: DataFrame, work: Sink, checkpoint: str, every: str | None) -> StreamingQuery:
    """Start the work: until what is there is done, or every so often, to be stopped by the caller."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    if every is not None:
        return writer.trigger(processingTime=every).start()
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()
    return running


def run_micro_batch(
    pages: DataFrame,
    batch_id: int,
    sources: DataFrame,
    rules: DataFrame,
    home: str,
    options: RunOptions,
    sink: Sink | None = None,
) -> None:
    """One micro-batch of ``run_stream``; may be repeated.

    What an earlier try of the batch stored goes first: rules may have changed
    in between. Stores of many batches are merged then. What the batch wrote on its way goes when its results are stored.
    """
    spark = pages.sparkSession
    batch = f"b{batch_id:012d}"
    replaces = not sources.filter("NOT by_url").isEmpty()
    with own_work(spark):
        forget_batch(spark, home, batch_id)
        merge_batches(spark, f"{home}/history")
        history = read_history(spark, f"{home}/history", latest=replaces)
        # The first batch finds nothing that it could ask.
        bits = read_membership(spark, f"{home}/history") if is_stored(spark, f"{home}/history") else None
        result = run_batch(pages, sources, rules, history, options, bits)
        (sink or table_sink(f"{home}/records"))(result.records, batch_id)
        table_sink(f"{home}/outcomes")(result.outcomes, batch_id)
        stored = materialize(result.history, "history")
        append_bits(stored, f"{home}/history", batch)
        append_history(stored, f"{home}/history", batch)


def forget_batch(spark: SparkSession, home: str, batch_id: int) -> None:
    """Remove what a batch has stored: its history first, so its records count as new."""
    delete_matching(spark, f"{home}/history/store_key=*/batch=b{batch_id:012d}")
    for table in ("records", "outcomes"):
        delete_matching(spark, f"{home}/{table}/batch={batch_id}")


def run_stream(
    pages: DataFrame,
    sources: DataFrame,
    rules: DataFrame,
    home: str,
    options: RunOptions,
    sink: Sink | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Run over a stream of pages into ``home``: records, outcomes, history.

    Without ``every`` it works off what is there and returns; with it the query
    that goes on is returned.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        run_micro_batch(batch, batch_id, sources, rules, home, options, sink)

    return _finish(pages, work, f"{home}/checkpoint", every)


def schema_text(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def dedup_micro_batch(records: DataFrame, batch_id: int, home: str, run_ts: datetime) -> None:
    spark = records.sparkSession
    batch = f"b{batch_id:012d}"
    with own_work(spark):
        forget_batch(spark, home, batch_id)
        merge_batches(spark, f"{home}/history")
        history = read_history(spark, f"{home}/history")
        table_sink(f"{home}/records")(dedup.dedup(records, history), batch_id)
        stored = spark.read.schema(f"{schema_text(records)}, batch bigint").parquet(f"{home}/records")
        stored = stored.filter(F.col("batch") == batch_id)
        append_history(dedup.history_rows(stored, F.lit(run_ts)), f"{home}/history", batch)


def dedup_stream(
    records: DataFrame, home: str, run_ts: datetime, every: str | None = None
) -> StreamingQuery:
    """Keep the records of a stream that no earlier batch stored."""

    def work(batch: DataFrame, batch_id: int) -> None:
        dedup_micro_batch(batch, batch_id, home, run_ts)

    return _finish(records, work, f"{home}/checkpoint", every)


def bounded_dedup(records: DataFrame, keep: str, ts: str = "ts") -> DataFrame:
    """First record per (store, URL), with state dropped after ``keep``.

    Weaker than ``dedup_stream``: a URL that returns later than that passes.
    """
    return records.withWatermark(ts, keep).dropDuplicatesWithinWatermark(["store_key", "url"])


def live_counters(outcomes: DataFrame, keep: str, every: str = "1 minute", ts: str = "ts") -> DataFrame:
    """Outcome counts per source and time slot, updated while the stream runs."""
    slotted = outcomes.withWatermark(ts, keep).groupBy(
        F.window(ts, every).alias("_slot"), "source_name"
    )
    return slotted.agg(*report.counters()).select(
        F.col("_slot.start").alias("slot_start"), "source_name", *report.COUNTERS
    )


def to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what a stream gives to parquet files, exactly once, until what is there is worked off."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def collect_stream(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream to its end into a table and read it back.

    In update mode the last version of each row counts; for counters, which
    only grow, that is the one from the highest batch.
    """
    home = work_folder(stream.sparkSession, name)
    sink = table_sink(f"{home}/rows")
    stream.writeStream.outputMode(mode).foreachBatch(sink).option(
        "checkpointLocation", f"{home}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{home}/rows")
    if mode == "update":
        keys = ["slot_start", "source_name"]
        return dedup.last_per_key(rows, keys, "batch").drop("batch")
    return rows.drop("batch")
