"""The operators as queries over the test tables; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm import centroids, chat, language_model, neighbours, packing, pii, quality, repair, sentencepiece_codec, simhash
from pagesift.llm import style_tree, token_counts, url_templates
from pagesift.llm.common import table
from pagesift.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
__all__ = ["ORACLES", "QUERIES"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"))


@query
def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii.with_surrogates(table(spark, sf_dir, "documents"), "corpus")
    return replaced.select("doc_id", "text", "n_entities")


@query
def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.main_text(table(spark, sf_dir, "pages"))


@query
def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query
def op6_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents"))
    return judged.drop("class_distance", "common_distance")


@query
def op7_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"))


@query
def op8_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat.rotated(table(spark, sf_dir, "conversations"))
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"], m["end"])), " ")
    return views.withColumn("masks", masks)


@query
def op11_scalar_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


@query
def op12_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judged(table(spark, sf_dir, "pages"))


@query
def op13_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(table(spark, sf_dir, "conversations"), damage=True)
