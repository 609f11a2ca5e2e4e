"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Each shard of the
vectors holds an inverted file: under a pivot, the vectors that have it among
their nearest ones, with its place. A query adds up, over the lists of its own
nearest pivots, how far the places are from its own (footrule distance; a pivot
that a vector lacks counts as the place after its last). The nearest part of a
shard by footrule is ranked anew by the cosine of the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.llm.common import pick

K = 5
# The index is fitted on this many vectors, drawn by a hash of their ids.
PIVOTS = 256
# Rows drawn for each pivot; a copy of an earlier one is none.
DRAWN = 8
# Part of the pivots that represents a vector.
PREFIX = 0.5
# Part of a shard that is ranked by cosine, and the fewest vectors for that.
RERANKED, FEWEST = 1 / 8, 256
SHARD_ROWS = 8192
BLOCK_QUERIES = 16384


def usable(vector: Column) -> Column:
    """Neither null nor zero nor with null or non-finite components."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    return vector.isNotNull() & F.forall(vector, lambda x: finite(x)) & F.exists(vector, lambda x: x != 0)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors])


def unit(rows: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def places(rows: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first."""
    return np.argsort(-(rows @ pivots.T), axis=1, kind="stable")[:, :prefix]


class InvertedFile:
    """A list for each pivot with the place it has in each vector's order.

    Half of all vectors are in each list, so a list has a slot for every vector;
    one that lacks the pivot holds the place after the last.
    """

    def __init__(self, rows: np.ndarray, pivots: np.ndarray, prefix: int) -> None:
        order = places(rows, pivots, prefix)
        vectors = np.arange(len(rows))[:, None]
        self.lists = np.full((len(pivots), len(rows)), prefix, np.int16)
        self.lists[order, vectors] = np.arange(prefix, dtype=np.int16)

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Distance of all vectors to a query given by its nearest pivots."""
        apart = self.lists[query]
        apart -= np.arange(len(query), dtype=np.int16)[:, None]
        return np.abs(apart, out=apart).sum(0, dtype=np.int32)


def fitted_pivots(vectors: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """Pivots by the smallest hashes of ids; equal vectors count once.

    More rows than needed are drawn, so that a group of copies among them does
    not shrink the index.
    """
    draw = F.xxhash64(F.col("vec_id"), F.lit("pivot"))
    rows = vectors.orderBy(draw, "vec_id").limit(DRAWN * count).collect()
    if not rows:
        return np.zeros((0, 0))
    drawn = unit(np.array([r["vector"] for r in rows], np.float64))
    _, first = np.unique(drawn, axis=0, return_index=True)
    return drawn[np.sort(first)[:count]]


def nearest(
    vectors: DataFrame,
    queries: Column | None = None,
    k: int = K,
    pivots: int = PIVOTS,
    reranked: float = RERANKED,
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest vectors found for each query: ``query_id, rank, vec_id, score``.

    Queries are the rows whose id is divisible by 50, or those of the condition
    ``queries`` on ``vec_id``. The score is the cosine in double precision; ties go to
    the smaller id. Rows with a null id, and vectors that are null, empty, zero
    or hold null or non-finite components, take no part. Of repeated rows with
    one id the best score counts, and none of them is found for a query of that
    id. All vectors must have one length. An empty table gives no rows.

    Shards hold about ``shard_rows`` vectors, dealt by a hash of the row's place,
    so no id, label or group of copies can crowd one. Queries meet the shards in
    blocks of about ``block_queries``; a shard gives at most ``k`` rows for a query.
    """
    rows = pick(vectors, id_col, vector_col).toDF("vec_id", "vector")
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    fit = fitted_pivots(rows, pivots)
    n = rows.count()
    prefix = max(1, int(len(fit) * PREFIX))
    shards, wanted = max(1, -(-n // shard_rows)), F.col("vec_id") % 50 == 0 if queries is None else queries
    asked = rows.filter(wanted)
    blocks = max(1, -(-asked.count() // block_queries)) if n else 1

    rows = rows.withColumn("row", F.monotonically_increasing_id())
    shard = F.pmod(F.xxhash64("row"), F.lit(shards))
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks))
    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<long>"))
    right = rows.select("vec_id", "vector", shard.alias("shard"), numbers(blocks).alias("block"))
    left = asked.select("vec_id", "vector", block.alias("block"), numbers(shards).alias("shard"))

    def search(key: tuple, asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(asked) and len(shard):
            shard = shard.sort_values("vec_id", kind="stable")
            ids, raw = shard["vec_id"].to_numpy(), matrix(shard["vector"])
            inside = unit(raw)
            index = InvertedFile(inside, fit, prefix)
            take = min(len(ids), max(FEWEST, k + 1, int(np.ceil(len(ids) * reranked))))
            outside = unit(matrix(asked["vector"]))
            for query_id, vector, order in zip(asked["vec_id"], outside, places(outside, fit, prefix)):
                # Equal vectors are equally far: of those the smaller ids come first.
                distance = index.footrule(order).astype(np.int64) * len(ids) + np.arange(len(ids))
                others = np.flatnonzero(ids != query_id)
                if take < len(others):
                    others = others[np.argpartition(distance[others], take - 1)[:take]]
                some = np.sort(others)
                scores = (inside[some] * vector).sum(1)
                best = some_best(ids[some], scores, k)
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[some][best], "score": scores[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    kind = rows.schema["vec_id"].dataType.simpleString()
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    found = found.applyInPandas(search, f"query_id {kind}, vec_id {kind}, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def some_best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` best of different ids, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]
