"""Centroid clustering of integer vectors through scalar lookup tables.

In a round the squared difference is tabulated for each dimension, each integer
that occurs there and each centroid. The distance of a vector is then a gather
of one table row per dimension and a sum; no product of matrices is formed. All
arithmetic is on integers, so neither the layout nor the order of rows changes
a result.

A round is one pass over the vectors. A task keeps counts and sums of its
clusters, which are summed up by Spark as decimals; the driver only ever holds
the sums of the centroids.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import materialize, pick

CENTROIDS = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SALT = "3:"
# Within this magnitude a distance and a batch's sums fit into 64 bits.
NARROW = 1 << 27
# Sums are handed over in digits of this base, so decimals hold them at any size.
BASE = 10**24
COUNT = -1
MOST_LONG = (1 << 63) - 1


def complete(vector: Column, dimensions: int) -> Column:
    """As many components as wanted, none null or non-finite."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    return F.coalesce((F.size(vector) == dimensions) & F.forall(vector, finite), F.lit(False))


def as_integers(batch: pa.Array, dimensions: int, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` of each component; Python integers where 64 bits may not do."""
    rows = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    if not rows.size or np.abs(rows).max() < NARROW // scale:
        return np.floor(scale * rows).astype(np.int64)
    # From 2^53 on a double is an integer; its product is taken exactly.
    exact = [int(x) * scale if abs(x) >= 1 << 53 else math.floor(scale * x) for x in rows.ravel().tolist()]
    return np.array(exact, object).reshape(rows.shape)


def tabulated(column: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared differences of the values that occur in a dimension, and each row's place there."""
    values, place = np.unique(column, return_inverse=True)
    apart = values[:, None] - centroids[None, :]
    return apart * apart, place.ravel()


def distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each centroid, by gathers from the tables."""
    wide = object if rows.dtype == object or centroids.dtype == object else np.int64
    total = np.zeros((len(rows), len(centroids)), wide)
    for d in range(rows.shape[1]):
        table, place = tabulated(rows[:, d].astype(wide), centroids[:, d].astype(wide))
        total += table[place]
    return total


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid; ties to the smaller number."""
    apart = distances(rows, centroids)
    found = apart.argmin(1)
    return found, apart[np.arange(len(rows)), found]


def digits(value: int) -> Iterator[tuple[int, int]]:
    """An integer as digits of the base with their places; all have its sign."""
    sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        rest, digit = divmod(rest, BASE)
        yield place, sign * digit
        place += 1


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster, dim, place, total`` of one round; dimension -1 holds the counts."""
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            rows = as_integers(batch.column("vector"), dimensions)
            if not len(rows):
                continue
            found, _ = nearest(rows, centroids)
            for cluster in np.unique(found).tolist():
                members = rows[found == cluster]
                counts[cluster] = counts.get(cluster, 0) + len(members)
                sums[cluster] = sums.get(cluster, 0) + members.sum(0).astype(object)
        out = [
            (cluster, dim, place, digit)
            for cluster in counts
            for dim, value in [(COUNT, counts[cluster]), *enumerate(sums[cluster].tolist())]
            for place, digit in digits(int(value))
        ]
        if out:
            columns = list(zip(*out))
            ints = [pa.array(c, pa.int32()) for c in columns[:3]]
            yield pa.RecordBatch.from_arrays(
                [*ints, pa.array([str(d) for d in columns[3]])], names=["cluster", "dim", "place", "digit"]
            )

    parts = vectors.select("vector").mapInArrow(run, "cluster int, dim int, place int, digit string")
    return parts.groupBy("cluster", "dim", "place").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("total"))


def moved(centroids: np.ndarray, sums: list) -> np.ndarray:
    """The centroids after a round: exact floors of the means; empty clusters stay."""
    totals: dict[tuple[int, int], int] = {}
    for row in sums:
        key = (row["cluster"], row["dim"])
        totals[key] = totals.get(key, 0) + int(row["total"]) * BASE ** row["place"]
    out = centroids.astype(object)
    for cluster in range(len(out)):
        count = totals.get((cluster, COUNT), 0)
        if count:
            out[cluster] = [totals.get((cluster, d), 0) // count for d in range(out.shape[1])]
    return narrowed(out)


def narrowed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64) if all(abs(v) < NARROW for v in values.ravel()) else values


def as_long(value: int) -> int | None:
    return value if value <= MOST_LONG else None


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def started(vectors: DataFrame, count: int, salt: str, dimensions: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids; ties, of one id, go by the vector."""
    draw = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(draw.asc_nulls_last(), "vector").limit(count).collect()
    flat = pa.array([list(r["vector"]) for r in rows], pa.list_(pa.float64()))
    return narrowed(as_integers(flat, dimensions).astype(object)) if rows else np.zeros((0, dimensions), np.int64)


def clustered(
    vectors: DataFrame,
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    salt: str = SALT,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector.

    Rows count that have exactly ``dimensions`` components, none null or
    non-finite; others are not returned. A component is ``floor(1024 * x)`` of
    the double. The centroids start as the vectors with the smallest SHA-256 of
    ``3:<vec_id>``; fewer vectors make fewer centroids. Rows with a null id take
    part and start a centroid only if there are too few others. Repeated rows
    are vectors of their own. Equal distances go to the smaller number; an empty
    cluster keeps its centroid. Distances and inertias beyond 64 bits are null;
    clusters are exact at any magnitude. An empty table gives no rows, other
    columns may have any name.
    """
    rows = pick(vectors, id_col, vector_col).toDF("vec_id", "vector")
    rows = rows.filter(complete(F.col("vector"), dimensions))
    rows = materialize(rows.withColumn("vector", F.col("vector").cast("array<double>")), "vectors")
    centres = started(rows, centroids, salt, dimensions)
    for _ in range(rounds if len(centres) else 0):
        centres = moved(centres, cluster_sums(rows, centres).collect())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, apart = nearest(as_integers(batch.column("vector"), dimensions), centres)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(found.astype(np.int32)), pa.array([str(a) for a in apart.tolist()], pa.string())],
                names=["vec_id", "cluster", "apart"],
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    if not len(centres):
        shape = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], shape)
    placed = materialize(rows.mapInArrow(assign, f"vec_id {kind}, cluster int, apart string"), "placed")
    # Every part of a distance's decimal digits is summed alone, so no sum is cut off.
    low, high = F.right("apart", F.lit(24)), F.expr("left(apart, greatest(length(apart) - 24, 0))")
    sums = placed.groupBy("cluster").agg(
        F.sum(low.cast("decimal(38,0)")).alias("low"),
        F.max(F.length("apart")).alias("digits"),
        F.sum(F.when(high != "", F.right(high, F.lit(24)).cast("decimal(38,0)")).otherwise(0)).alias("high"),
    ).collect()
    # One row per centroid; more than 48 digits are far beyond 64 bits.
    inertia = {r["cluster"]: int(r["low"]) + int(r["high"]) * BASE + (r["digits"] > 48) * BASE**3 for r in sums}
    total = sum(inertia.values())
    facts = vectors.sparkSession.createDataFrame(
        [(c, as_long(v), digest(centres[c])) for c, v in inertia.items()],
        "cluster int, cluster_inertia long, centroid_sha256 string",
    )
    return placed.join(F.broadcast(facts), "cluster").select(
        "vec_id",
        "cluster",
        F.expr("try_cast(apart AS bigint)").alias("distance"),
        "cluster_inertia",
        F.lit(as_long(total)).cast("long").alias("inertia"),
        "centroid_sha256",
    )
