"""The history table: parquet, partitioned by store and by the batch that wrote it.

New rows are appended under their batch, so a repeated batch overwrites only
itself and a run never rewrites what older runs stored.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.operators import membership
from pagesift.operators.dedup import history_upsert
from pagesift.schemas import HISTORY
from pagesift.session import materialize

# Share of bits set beyond which the bitmap is built anew.
MOST_FILLED = 0.3


def read_history(
    spark: SparkSession,
    path: str,
    store_key: str | None = None,
    latest: bool = False,
    without_batch: str | None = None,
) -> DataFrame:
    """History rows; an empty table with the schema if there is none yet.

    ``store_key`` prunes partitions. ``latest`` gives one row per URL, which
    matters only for stores written with the URL check off. ``without_batch``
    leaves out what that batch itself stored, for a repeated batch.
    """
    try:
        stored = spark.read.schema(f"{HISTORY}, batch STRING").parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], HISTORY)
    if store_key is not None:
        stored = stored.filter(F.col("store_key") == store_key)
    if without_batch is not None:
        stored = stored.filter(F.col("batch") != without_batch)
    columns = [c.split()[0] for c in HISTORY.split(", ")]
    history = stored.select(*columns)
    if latest:
        history = history_upsert(history, history.limit(0))
    return history


def is_stored(spark: SparkSession, path: str) -> bool:
    """Whether anything is stored yet; looks at file names only."""
    stores = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/store_key=*")
    return bool(stores.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(stores))


def append_history(rows: DataFrame, path: str, batch: str) -> None:
    """Store new history rows under their batch; writing it again changes nothing.

    Files are sorted by URL, so a lookup skips the parts that it does not meet.
    """
    (
        rows.withColumn("batch", F.lit(batch))
        .hint("rebalance", "store_key")
        .sortWithinPartitions("store_key", "batch", "url")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("store_key", "batch")
        .parquet(path)
    )


def compact_history(spark: SparkSession, path: str, new_path: str) -> None:
    """Write the latest row per URL of all stores to a new place, in few files."""
    append_history(read_history(spark, path, latest=True), new_path, "compacted")


def history_reset(spark: SparkSession, path: str, store_key: str | None = None) -> None:
    """Delete one store, or all of them."""
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    target = path if store_key is None else f"{path}/store_key={escaped(store_key)}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(target)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(hadoop_path, True)
    if store_key is None:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(bits_folder(path)), True)


# --- bitmap beside the history -----------------------------------------------------


def bits_folder(path: str) -> str:
    return f"{path.rstrip('/')}-bits"


def _sizes(spark: SparkSession, path: str) -> list[int]:
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{bits_folder(path)}/size=*")
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName().partition("=")[2]) for s in system.globStatus(found) or [])


def _stored_batches(spark: SparkSession, path: str) -> DataFrame:
    """History rows with their batch, empty if there is none yet."""
    try:
        return spark.read.schema(f"{HISTORY}, batch STRING").parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], f"{HISTORY}, batch STRING")


def append_bits(rows: DataFrame, path: str, batch: str) -> None:
    """Add the bits of new history rows; to be called before the rows are stored.

    Nothing is ever taken away, so whatever fails in between, no stored key
    lacks its bit. Bits of rows that were not stored after all only make a key
    look known, which the exact join then settles.
    """
    spark = rows.sparkSession
    sizes = _sizes(spark, path)
    size = sizes[-1] if sizes else membership.enough_bits(rows.count())
    pieces = membership.bitmap(rows, size).withColumn("batch", F.lit(batch))
    pieces.write.mode("append").partitionBy("batch").parquet(f"{bits_folder(path)}/size={size}")


def rebuild_bits(spark: SparkSession, path: str, size: int) -> None:
    """The bitmap of the whole history in another size; it counts once it is complete."""
    stored = _stored_batches(spark, path)
    folder = bits_folder(path)
    new = f"{folder}/_new-{uuid.uuid4().hex}"
    membership.bitmap(stored, size, "batch").write.partitionBy("batch").parquet(new)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    system.rename(hadoop(new), hadoop(f"{folder}/size={size}"))


def read_membership(spark: SparkSession, path: str) -> membership.Membership:
    """The bitmap of a history, complete and not too full.

    Batches that were stored without bits are read for them; a bitmap that got
    too full is built anew for twice the keys.
    """
    stored = _stored_batches(spark, path)
    sizes = _sizes(spark, path)
    if not sizes:
        rebuild_bits(spark, path, membership.enough_bits(2 * stored.count()))
        sizes = _sizes(spark, path)
    found = _of_size(spark, path, stored, sizes[-1])
    if found.filled() > MOST_FILLED:
        size = max(2 * sizes[-1], membership.enough_bits(2 * stored.count()))
        rebuild_bits(spark, path, size)
        found = _of_size(spark, path, stored, size)
    return found


def _of_size(spark: SparkSession, path: str, stored: DataFrame, size: int) -> membership.Membership:
    pieces = spark.read.schema(f"{membership.PIECES}, batch STRING").parquet(f"{bits_folder(path)}/size={size}")
    # Batches are partitions: both lists come from the files' names.
    lacking = stored.select("batch").distinct().join(pieces.select("batch").distinct(), "batch", "left_anti")
    names = [row["batch"] for row in lacking.collect()]
    if names:
        more = membership.bitmap(stored.filter(F.col("batch").isin(names)), size)
        pieces = pieces.drop("batch").unionByName(more)
    united = materialize(membership.united(pieces.select("kind", "piece", "bits")), "bits")
    return membership.Membership(united, size)
