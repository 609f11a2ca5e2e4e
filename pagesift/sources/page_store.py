"""The page store: captures laid out by what a run looks them up with.

A table in ``path``, partitioned by the batch that stored it and bucketed by
source, asked URL and hash of the source text. The hash is taken once, when a
capture is stored, and every capture has a number. Choosing captures therefore
reads no text, and joining the chosen ones with their text moves only the
chosen list: each bucket's text is read where it lies. Captures of one URL
differ in their hash, so a URL captured over and over is no hot bucket.

The layout is kept beside the table, so any session can open it.
"""

from __future__ import annotations

import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.columns import text_sql

BUCKETS = 64
KEY = ["source_name", "requested_url", "capture_hash"]
COLUMNS = {
    "source_name": "STRING",
    "requested_url": "STRING",
    "capture_hash": "BIGINT",
    "capture_no": "BIGINT",
    "url": "STRING",
    "status": "INT",
    "attempt": "INT",
    "fetched_at": "TIMESTAMP",
    "html": "STRING",
}


class PageStore:
    """Captures in ``path``; ``buckets`` counts for a new store only.

    Take about as many buckets as the pages have gigabytes divided by four, so
    that a bucket's text fits the memory of a task.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = self._layout(buckets)
        self.table = f"pages_{zlib.crc32(self.path.encode()):08x}_{self.buckets}"
        columns = ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items())
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({columns}, batch STRING) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY ({', '.join(KEY)}) SORTED BY (source_name, requested_url) INTO {self.buckets} BUCKETS "
            f"LOCATION {text_sql(self.path + '/pages')}"
        )

    def _layout(self, buckets: int) -> int:
        place = f"{self.path}/layout"
        try:
            return self.spark.read.schema("buckets INT").json(place).first()["buckets"]
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
        self.spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.json(place)
        return buckets

    def append(self, pages: DataFrame, batch: str) -> None:
        """Store captures under a batch; storing it again replaces what it stored before.

        ``requested_url`` is the URL that was asked for, by default ``url``; a
        page without ``attempt`` is a first one.
        """
        given = set(pages.columns)
        values = {
            "requested_url": F.col("requested_url" if "requested_url" in given else "url"),
            "capture_hash": F.xxhash64("html"),
            "attempt": F.coalesce(F.col("attempt").cast("int"), F.lit(1)) if "attempt" in given else F.lit(1),
            "fetched_at": F.col("fetched_at") if "fetched_at" in given else F.lit(None).cast("timestamp"),
        }
        rows = pages.withColumns(values).repartition(self.buckets, *KEY).sortWithinPartitions(*KEY)
        rows = rows.withColumn("capture_no", F.monotonically_increasing_id())
        # The only shuffle that page text ever goes through.
        rows.select(*COLUMNS).createOrReplaceTempView(f"{self.table}_new")
        self.spark.sql(
            f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = {text_sql(batch)}) SELECT * FROM {self.table}_new"
        )
        self.spark.catalog.dropTempView(f"{self.table}_new")

    def read(self, source: str | None = None, batch: str | None = None) -> DataFrame:
        """All captures, or those of a source or batch; ``capture_no`` is unique within a batch."""
        self.spark.catalog.recoverPartitions(self.table)
        pages = self.spark.table(self.table)
        if source is not None:
            pages = pages.filter(F.col("source_name") == source)
        if batch is not None:
            pages = pages.filter(F.col("batch") == batch)
        return pages
