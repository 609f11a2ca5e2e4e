"""Completing records: defaults, embedded details, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.columns import let
from pagesift.functions.text import summary
from pagesift.operators.extract import json_detail
from pagesift.schemas import CORE_FIELDS


def set_default(fields: Column, defaults: Column) -> Column:
    """Add the entries of ``defaults`` whose key the record does not have at all."""
    return let(
        fields,
        lambda f: F.map_concat(f, F.map_filter(defaults, lambda k, _: ~F.map_contains_key(f, k))),
    )


def fill_blank(fields: Column, defaults: Column) -> Column:
    """Like ``set_default``, but a null value counts as missing as well."""
    present = F.map_filter(fields, lambda _, v: v.isNotNull())
    return set_default(present, defaults)


def enrich(
    records: DataFrame,
    run_ts: Column,
    fill_nulls: bool = False,
    cut: str = "words",
) -> DataFrame:
    """Fill in what a record lacks.

    ``fetched_at`` is set to the run's time where absent, so a retried task
    gives the same row. A record without content takes what its page embeds as
    JSON, for keys it does not have (``fill_nulls``: or that are null). The
    summary is added unless a rule already gave one.
    """
    fields = F.col("fields")
    content = fields["content"]
    details = F.when(
        F.coalesce(content, F.lit("")) == "", json_detail(F.col("raw_html"))
    )
    merge = fill_blank if fill_nulls else set_default
    completed = let(
        details, lambda d: F.when(d.isNotNull(), merge(fields, d)).otherwise(fields)
    )
    with_details = records.withColumn("fields", completed)
    text = F.col("fields")["content"]
    summarised = with_details.withColumn(
        "fields",
        F.when(
            text.isNotNull(),
            set_default(F.col("fields"), F.create_map(F.lit("summary"), summary(text, cut=cut))),
        ).otherwise(F.col("fields")),
    )
    fetched = (
        F.coalesce(F.col("fetched_at"), run_ts) if "fetched_at" in records.columns else run_ts
    )
    return summarised.withColumn("fetched_at", fetched)


def core_columns(records: DataFrame) -> DataFrame:
    """Usual fields as columns, the others in ``extra``."""
    kept = [c for c in records.columns if c not in ("fields", *CORE_FIELDS)]
    return records.select(
        *kept,
        *[F.col("fields")[name].alias(name) for name in CORE_FIELDS],
        F.map_filter("fields", lambda k, _: ~k.isin(CORE_FIELDS)).alias("extra"),
    )
