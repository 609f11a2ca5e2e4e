"""Captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.operators.dedup import first_per_key
from pagesift.schemas import PAGES


def read_pages(
    spark: SparkSession,
    path: str,
    source: str | None = None,
    fmt: str = "parquet",
    schema: str | None = None,
) -> DataFrame:
    """Pages from parquet, JSON lines or whole files (``fmt='text'``).

    A ``source`` filter stands right on the scan, so it reaches the files.
    Whole files have their path as URL and in ``input_file``.
    """
    if fmt == "text":
        pages = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("url"),
            F.lit(200).alias("status"),
            F.col("value").alias("html"),
            F.lit(source).cast("string").alias("source_name"),
            F.col("_metadata.file_path").alias("input_file"),
        )
        return pages
    reader = spark.read
    if schema or fmt == "json":
        reader = reader.schema(schema or PAGES)
    pages = reader.format(fmt).load(path)
    if source is not None:
        pages = pages.filter(F.col("source_name") == source)
    return pages


def spread(pages: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on a small input that came in too few pieces.

    Large inputs already have more partitions than cores and stay as they are:
    no shuffle of page text.
    """
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if pages.rdd.getNumPartitions() >= cores:
        return pages
    return pages.repartition(cores, *[F.col(k) for k in keys])


def merge_snapshots(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First capture of each list item over several captures of one page.

    ``row_number() = 1`` is planned with a group limit before the shuffle: each
    task sends one row per key at most, however many captures a key has.
    """
    return first_per_key(items, keys, order)


def append_items(
    pages: DataFrame, items: DataFrame, key: str, order: list[str], html_col: str = "html"
) -> DataFrame:
    """Add the HTML of kept items, in order, behind their page's own HTML.

    ``items`` has key, the order columns and html. A page with its items is one
    row by definition.
    """
    parts = items.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(*order, "html"))).alias("_parts")
    )
    added = F.array_join(F.transform("_parts", lambda p: p["html"]), "\n")
    whole = F.when(F.col("_parts").isNull(), F.col(html_col)).otherwise(
        F.concat(F.col(html_col), F.lit("\n"), added)
    )
    return pages.join(parts, key, "left").withColumn(html_col, whole).drop("_parts")
