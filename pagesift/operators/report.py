"""Counts of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ["success", "failed", "skipped", "window_filtered"]


def counters() -> list[Column]:
    return [
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(
            (F.col("status") == "skipped") & (F.col("reason") == "window_filtered")
        ).alias("window_filtered"),
    ]


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Counts per source; window-filtered records count as skipped as well."""
    return outcomes.groupBy("source_name").agg(*counters())


def with_prefilter_skips(outcomes: DataFrame, known: DataFrame) -> DataFrame:
    """Add the URLs the history pre-filter dropped, as skipped."""
    skipped = known.select(
        "source_name", "url", F.lit("skipped").alias("status"), F.lit("known_url").alias("reason")
    )
    return outcomes.select("source_name", "url", "status", "reason").unionByName(skipped)


def run_summary_total(summary: DataFrame, sources: DataFrame) -> DataFrame:
    """A row per source of the catalogue, zeros where nothing ran, and a total.

    The total row has no source name. ``any_failed`` tells that records failed,
    ``no_result`` that a source gave nothing. Rolled up from the counts, so the
    records themselves are aggregated once.
    """
    ran = summary.withColumn("_ran", F.lit(True))
    filled = sources.select("source_name").join(ran, "source_name", "left").select(
        "source_name",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS],
        F.col("_ran").isNull().alias("no_result"),
    )
    return (
        filled.rollup("source_name")
        .agg(
            *[F.sum(c).alias(c) for c in COUNTERS],
            F.bool_or(F.col("failed") > 0).alias("any_failed"),
            F.bool_or("no_result").alias("no_result"),
        )
        .orderBy(F.asc_nulls_last("source_name"))
    )


def rate_label(per_second: Column) -> Column:
    """Rate as text, with a suffix from a thousand on."""
    label = F.format_string("%.1f url/s", per_second)
    for power, suffix in enumerate("KMGT", start=1):
        unit = 1000.0**power
        label = F.when(
            per_second >= unit, F.format_string(f"%.1f{suffix} url/s", per_second / unit)
        ).otherwise(label)
    return label


def throughput(outcomes: DataFrame, ts: str = "ts", every: str = "1 minute", seconds: int = 60) -> DataFrame:
    """Outcomes per time slot and per second."""
    per_second = F.col("urls") / F.lit(seconds)
    return (
        outcomes.groupBy(F.window(ts, every).alias("_slot"))
        .agg(F.count(F.lit(1)).alias("urls"))
        .select(
            F.col("_slot.start").alias("slot_start"),
            "urls",
            per_second.alias("per_second"),
            rate_label(per_second).alias("rate"),
        )
    )


def totals(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
