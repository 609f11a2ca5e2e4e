"""A left join that splits hot keys of the left side by salt.

Only keys that are really hot get salted, so the other side grows by a few
rows instead of being repeated as a whole. It does not rely on what the
adaptive planner can see: that skips joins whose inputs are joins themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.session import checked_broadcast

ROWS_PER_SALT = 1_000_000


def salted_left_join(
    rows: DataFrame,
    facts: DataFrame,
    keys: list[str],
    spread_by: list[str],
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """``rows`` left join ``facts``, which has one row per key.

    Hot keys are found by a pre-aggregated count; there are at most
    (all rows / rows_per_salt) of them, and their number is checked before they
    are sent out. ``spread_by`` tells the rows of a key apart.
    """
    hot = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_salt)
        .select(*keys, F.ceil(F.col("_n") / rows_per_salt).cast("int").alias("_salts"))
    )
    hot = checked_broadcast(hot)
    salts = F.coalesce("_salts", F.lit(1))
    salted = rows.join(hot, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int")
    )
    copies = facts.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    joined = salted.drop("_salts").join(copies.drop("_salts"), [*keys, "_salt"], "left")
    return joined.drop("_salt")
