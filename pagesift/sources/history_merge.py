"""History as merged base and later batches, read and rewritten by touched keys.

A store's folder holds at most one merged base, in files that each cover a range
of URLs, and the batches that came after it. A lookup opens only the stores it
asks for, and of their files those whose range it meets. Merging rewrites only
stores with too many batches. Other stores' files are not touched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.operators.dedup import RECORD_KEY, history_upsert
from pagesift.schemas import HISTORY
from pagesift.session import delete_matching
from pagesift.sources.history import append_bits, is_stored, read_history

MERGED = "merged-"
# Batches of a store beyond which it is merged.
MOST_BATCHES = 16
# Rows of a base's file. Small enough that a lookup's range skips most files.
FILE_ROWS = 2_000_000
# Stores whose ranges of URLs go into a filter; with more, the join alone decides.
MAX_RANGES = 200


def latest_for(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """The latest stored row of each (store, URL) in ``rows``: what a batch replaces.

    Equal to ``read_history(latest=True)`` joined to the keys. Rows without a key
    ask for nothing. The stores and the ends of their URLs come to the driver,
    one small row for each store, at most ``MAX_RANGES`` of them.
    """
    history = read_history(spark, path)
    keys = rows.select(*RECORD_KEY).dropna().distinct()
    ends = keys.groupBy("store_key").agg(F.min("url").alias("low"), F.max("url").alias("high"))
    asked = ends.limit(MAX_RANGES + 1).collect()
    if len(asked) <= MAX_RANGES:
        inside = F.lit(False)
        for store in asked:
            inside |= (F.col("store_key") == store["store_key"]) & F.col("url").between(store["low"], store["high"])
        history = history.filter(F.col("store_key").isin([s["store_key"] for s in asked])).filter(inside)
    touched = history.join(keys, RECORD_KEY, "left_semi")
    return history_upsert(touched, touched.limit(0))


def stored_batches(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """Store -> batch -> folder, from the names of folders alone."""
    jvm = spark._jvm
    unescaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/store_key=*/batch=*")
    system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, dict[str, str]] = {}
    for status in system.globStatus(pattern) or []:
        folder = status.getPath()
        store, batch = (unescaped(p.getName().partition("=")[2]) for p in (folder.getParent(), folder))
        if store != "__HIVE_DEFAULT_PARTITION__":
            found.setdefault(store, {})[batch] = folder.toString()
    return found


def merge_batches(
    spark: SparkSession,
    path: str,
    most_batches: int = MOST_BATCHES,
    repeatable: int = 1,
    file_rows: int = FILE_ROWS,
) -> list[str]:
    """Merge the stores with more than ``most_batches`` batches; gives their names.

    Batch names rise with time. The ``repeatable`` newest ones stay as they are,
    so a batch that is repeated can still forget what its earlier try stored.
    The base appears before what it replaces goes: a merge that was cut off
    leaves rows twice, which ``latest`` reads, lookups and dedup don't mind and
    the next merge mends. To be run between batches, as files of running reads go.
    """
    stored = stored_batches(spark, path)
    newest = sorted({b for batches in stored.values() for b in batches if not b.startswith(MERGED)})
    spared = set(newest[-repeatable:]) if repeatable else set()
    due = {
        store: {batch: folder for batch, folder in batches.items() if batch not in spared}
        for store, batches in stored.items()
    }
    due = {store: batches for store, batches in due.items() if len(batches) > most_batches}
    if not due:
        return []
    # Folders are named one by one: a batch that appears meanwhile is not merged.
    folders = [folder for batches in due.values() for folder in batches.values()]
    rows = spark.read.schema(f"{HISTORY}, batch STRING").option("basePath", path).parquet(*folders).drop("batch")
    columns = [c.split()[0] for c in HISTORY.split(", ")]
    base = history_upsert(rows.select(*columns), rows.select(*columns).limit(0))
    name = f"{MERGED}{uuid.uuid4().hex}"
    staged = f"{path.rstrip('/')}-{name}"
    files = max(len(due), -(-rows.count() // file_rows))
    (
        base.repartitionByRange(files, "store_key", "url")
        .sortWithinPartitions("store_key", "url")
        .write.partitionBy("store_key")
        .parquet(staged)
    )
    if is_stored(spark, staged):
        if is_stored_bits(spark, path):
            append_bits(spark.read.schema(HISTORY).parquet(staged), path, name)
        _publish(spark, staged, path, name)
    for folder in folders:
        system_of(spark, folder).delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)
    delete_matching(spark, staged)
    return sorted(due)


def system_of(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def is_stored_bits(spark: SparkSession, path: str) -> bool:
    """Whether the history has a bitmap; one that has none is not given any."""
    pattern = f"{path.rstrip('/')}-bits/size=*"
    return bool(system_of(spark, pattern).globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern)))


def _publish(spark: SparkSession, staged: str, path: str, name: str) -> None:
    """Move each store's base, a folder as a whole, to its place."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    system = system_of(spark, staged)
    for status in system.globStatus(to_path(f"{staged}/store_key=*")):
        folder = status.getPath()
        if not system.rename(folder, to_path(f"{path}/{folder.getName()}/batch={name}")):
            raise OSError(f"could not move {folder}")
