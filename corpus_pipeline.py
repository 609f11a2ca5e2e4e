"""Documents to packed training sequences: four stages, each on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm import packing, pii, quality, simhash
from pagesift.session import materialize

KEY = "corpus"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets stand-ins; ``n_chars`` follows the new text."""
    # Columns go by place, as other ones may have any name.
    names = docs.columns
    text, count = (f"_{names.index(name)}" for name in ("text", "n_chars"))
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    clean = pii.with_surrogates(plain, KEY, text_col=text).drop("n_entities")
    return clean.withColumn(count, F.length(text).cast("long")).toDF(*names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", packed),
]

# The stages hash, retrieve and tokenize, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        plain = done.toDF(*[f"_{i}" for i in range(len(done.columns))])
        docs = materialize(plain, name.replace(" ", "-")).toDF(*done.columns)
    return docs
