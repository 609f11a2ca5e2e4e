"""Running sums and row numbers that survive a hot key.

A window over one key puts all its rows into one task. Here a key is cut into
ranges of its position: totals per range are pre-aggregated, only these few
rows are summed up along the key, and inside a range an ordinary window adds
the rest. Exact, and no task holds more than ``width`` positions of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.session import materialize

RANGE_WIDTH = 1_000_000


def running_sum(
    df: DataFrame,
    keys: list[str],
    pos: str,
    value: Column,
    name: str,
    width: int = RANGE_WIDTH,
) -> DataFrame:
    """Add the sum of ``value`` over a key's rows up to and with this one.

    ``pos`` is an integer that orders the rows of a key without ties.
    """
    ranged = df.withColumn("_value", value).withColumn(
        "_range", F.expr(f"`{pos}` div {width}")
    )
    place = [*keys, "_range"]
    along = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        ranged.groupBy(*place)
        .agg(F.sum("_value").alias("_total"))
        .select(*place, F.coalesce(F.sum("_total").over(along), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy(*place).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("_inside", F.sum("_value").over(within))
    return (
        summed.join(before, place)
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .select(*df.columns, name)
    )


def numbered(
    df: DataFrame, keys: list[str], pos: str, name: str = "row_no", width: int = RANGE_WIDTH
) -> DataFrame:
    """Number the rows of each key 1, 2, ... by position."""
    return running_sum(df, keys, pos, F.lit(1), name, width)


def numbered_in_order(df: DataFrame, keys: list[str], order: list[str], name: str = "row_no") -> DataFrame:
    """Number the rows of each key 1, 2, ... in an order that tells its rows apart.

    Keys and order columns alone are dealt out in ranges and written, so a key
    is cut wherever its rows need it and however many share the first order
    column. A number is a place in the whole order: no layout changes it.
    """
    slim = df.select(*keys, *order).repartitionByRange(*keys, *order)
    dealt = materialize(slim.withColumn("_part", F.spark_partition_id()), "numbered")
    along = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy(*keys, "_part")
        .agg(F.count(F.lit(1)).alias("_total"))
        .select(*keys, "_part", F.coalesce(F.sum("_total").over(along), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    numbers = (
        dealt.withColumn("_inside", F.row_number().over(inside))
        .join(before, [*keys, "_part"])
        .select(*keys, *order, (F.col("_before") + F.col("_inside")).alias(name))
    )
    return df.join(numbers, [*keys, *order]).select(*df.columns, name)


def islands(
    df: DataFrame,
    keys: list[str],
    pos: str,
    opens: Column,
    name: str = "island",
    width: int = RANGE_WIDTH,
) -> DataFrame:
    """Add the island each row belongs to; 0 is what stands before the first one."""
    return running_sum(df, keys, pos, F.when(opens, 1).otherwise(0), name, width)


def island_texts(
    lines: DataFrame, keys: list[str], pos: str, text: str, opens: Column, width: int = RANGE_WIDTH
) -> DataFrame:
    """Lines as rows to one text per island: keys, item, first_pos, n_lines, text.

    Islands without a start are left out. An island is one record's text.
    """
    marked = islands(lines, keys, pos, opens, "_island", width).filter("_island > 0")
    grouped = marked.groupBy(*keys, "_island").agg(
        F.min(pos).alias("first_pos"),
        F.count(F.lit(1)).alias("n_lines"),
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))).alias("_parts"),
    )
    return grouped.select(
        *keys,
        (F.col("_island") - 1).alias("item"),
        "first_pos",
        "n_lines",
        F.array_join(F.transform("_parts", lambda x: x["t"]), " ").alias("text"),
    )
