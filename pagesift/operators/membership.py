"""A bitmap of what a history holds, asked before the history itself.

A key (store and URL, or store and content hash) sets one bit, chosen by its
hash. A key whose bit is not set is certainly new. Only keys that may be known
go on to the exact join, and if they are few they are sent to the history,
which is then filtered where it lies instead of being shuffled.

Bits are kept in pieces of 4 KB, one row each, so tasks combine them before a
shuffle and no row is large. They grow by batches: what a batch adds is a row for
each piece it touches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.session import checked_broadcast, is_small

KINDS = ("url", "content_hash")
PIECES = "kind STRING, piece BIGINT, bits BINARY"
PIECE_BITS = 8 * 4096
# Bits for each key: one key in sixteen that is new looks known.
BITS_PER_KEY = 16
LEAST_BITS = 1 << 20


def enough_bits(keys: int) -> int:
    """Size of a bitmap for so many keys: a power of two."""
    return max(LEAST_BITS, 1 << (keys * BITS_PER_KEY - 1).bit_length() if keys else 0)


def place(key: str, size: int) -> Column:
    """Number of a key's bit; keys are compared with what their column shows, so nulls have none."""
    whole = F.col("store_key").isNotNull() & F.col(key).isNotNull()
    return F.when(whole, F.pmod(F.xxhash64("store_key", key), F.lit(size)))


def bitmap(history: DataFrame, size: int, *by: str) -> DataFrame:
    """``kind, piece, bits`` of the history's keys, for each value of ``by``: a pre-aggregated union of bits."""
    both = F.array(*[F.struct(F.lit(kind).alias("kind"), place(kind, size).alias("at")) for kind in KINDS])
    keys = history.select(*by, F.inline(both)).filter("at IS NOT NULL")
    return keys.groupBy(*by, "kind", F.expr(f"at DIV {PIECE_BITS}").alias("piece")).agg(
        F.bitmap_construct_agg(F.col("at") % PIECE_BITS).alias("bits")
    )


def united(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("kind", "piece").agg(F.bitmap_or_agg("bits").alias("bits"))


@dataclass(frozen=True)
class Membership:
    """Pieces of a bitmap of ``size`` bits for each kind of key."""

    pieces: DataFrame
    size: int

    def marked(self, rows: DataFrame, kind: str, name: str) -> DataFrame:
        """``rows`` with a flag: false for a key that the history certainly lacks.

        Pieces go to the rows if they are small, else both are brought together
        by piece; a piece has as many keys as it has bits set, so none is hot
        unless a key is, and then AQE splits it.
        """
        pieces = self.pieces.filter(F.col("kind") == kind).select(F.col("piece").alias("_piece"), "bits")
        pieces = checked_broadcast(pieces)
        placed = rows.withColumn("_at", place(kind, self.size)).withColumn("_piece", F.expr(f"_at DIV {PIECE_BITS}"))
        byte = F.expr(f"substring(bits, CAST((_at % {PIECE_BITS}) DIV 8 AS INT) + 1, 1)")
        number = F.conv(F.hex(byte), 16, 10).cast("int")
        is_set = F.expr("(_number >> CAST(_at % 8 AS INT)) & 1 = 1")
        found = placed.join(pieces, "_piece", "left").withColumn("_number", number)
        found = found.withColumn(name, F.coalesce(is_set, F.lit(False)))
        return found.select(*rows.columns, name)

    def filled(self) -> float:
        """Share of bits that are set, of the fuller kind."""
        counts = self.pieces.groupBy("kind").agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()
        return max((row["n"] for row in counts), default=0) / self.size


def of_history(history: DataFrame, size: int | None = None) -> Membership:
    """The bitmap of a history, sized by its rows."""
    size = enough_bits(history.count()) if size is None else size
    return Membership(bitmap(history, size), size)


def relevant(history: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The history's (store, key) rows that can meet ``rows``.

    Few rows are sent to the history, which is filtered where it lies; otherwise
    it is left for the join to shuffle.
    """
    wanted = rows.select("store_key", key).distinct()
    held = history.select("store_key", key)
    return held.join(F.broadcast(wanted), ["store_key", key], "left_semi") if is_small(wanted) else held


def without_known(
    rows: DataFrame, history: DataFrame, key: str, flag: Column, membership: Membership
) -> DataFrame:
    """``rows`` except those that ``flag`` checks and whose key the history has.

    The same rows as an anti join with the whole history.
    """
    marked = membership.marked(rows.withColumn("_flag", flag), key, "_maybe")
    maybe = F.coalesce(F.col("_flag"), F.lit(False)) & F.col("_maybe")
    asked = marked.filter(maybe)
    left = asked.join(relevant(history, asked, key), ["store_key", key], "left_anti")
    return marked.filter(~maybe).unionByName(left).select(rows.columns)


def known(rows: DataFrame, history: DataFrame, key: str, membership: Membership) -> DataFrame:
    """``rows`` whose key the history has."""
    asked = membership.marked(rows, key, "_maybe").filter("_maybe").drop("_maybe")
    return asked.join(relevant(history, asked, key), ["store_key", key], "left_semi").select(rows.columns)
