"""Helpers of the operators: columns by exact name, written steps, Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.session import materialize

__all__ = ["bind", "materialize", "pick", "slices", "table", "vocabulary"]

# Text handled at once by a Python task; a longer text is one slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """These columns alone, by exact spelling and position.

    Other columns may have any name, even the same one in other case, a dot in
    it, or the name of a column that an operator adds.
    """
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {', '.join(df.columns)}")
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{df.columns.index(n)}").alias(n) for n in names])


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row, however often it is used."""
    return F.transform(F.array(value), body)[0]


def vocabulary(name: str, folder: str | None = None) -> str:
    """The place of a tokenizer's file; ``folder`` overrides the installed ones."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each take about ``most`` bytes at most."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(text)).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + (size or 0) > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if start < len(sizes):
            yield batch.slice(start)
