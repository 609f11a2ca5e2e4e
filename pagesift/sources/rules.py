"""Source settings and extraction rules from JSON or YAML files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.operators.selectors import selector_steps, split_mode

# The settings a source file may have.
KNOWN_KEYS = [
    "source_name", "site_type", "target_url", "requires_login", "login_credentials",
    "crawl_depth", "entry_pattern", "detail_pattern", "keywords_filter", "output_format",
    "schedule", "time_range", "anti_scraping_strategies", "enable_incremental",
    "use_entry_content", "deduplication", "entry_interactions",
]
KNOWN_DEDUP_KEYS = ["by_url", "by_content", "store_path"]
DEFAULT_STORE = "data/history/default_history.db"

_SETTINGS = (
    "source_name STRING, site_type STRING, target_url STRING, entry_pattern STRING, "
    "detail_pattern MAP<STRING,STRING>, keywords_filter ARRAY<STRING>, output_format STRING, "
    "enable_incremental BOOLEAN, use_entry_content BOOLEAN, "
    "deduplication STRUCT<by_url: BOOLEAN, by_content: BOOLEAN, store_path: STRING>"
)


def _yaml_to_json(text: str) -> str:
    try:
        import yaml
    except ImportError as exc:  # optional package
        raise RuntimeError("reading YAML settings needs PyYAML; JSON needs nothing") from exc
    return json.dumps(yaml.safe_load(text), ensure_ascii=False, default=str)


def _settings_text(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True, pathGlobFilter=f"*.{fmt}").select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")
    )
    if fmt in ("yaml", "yml"):
        # Settings files: one small text per source.
        files = files.withColumn("text", F.udf(lambda text: _yaml_to_json(text), T.StringType())("text"))
    return files


def read_rules(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """Two settings tables: sources, and rules with fallbacks ranked in order."""
    settings = _settings_text(spark, path, fmt).select(
        F.from_json("text", _SETTINGS).alias("s")
    ).select("s.*")
    sources = settings.select(
        "source_name",
        F.coalesce("site_type", F.lit("news")).alias("site_type"),
        "target_url",
        "entry_pattern",
        F.coalesce("keywords_filter", F.array().cast("array<string>")).alias("keywords"),
        F.coalesce("enable_incremental", F.lit(True)).alias("incremental"),
        F.coalesce("use_entry_content", F.lit(False)).alias("use_entry_content"),
        F.coalesce("deduplication.by_url", F.lit(True)).alias("by_url"),
        F.coalesce("deduplication.by_content", F.lit(True)).alias("by_content"),
        F.coalesce("deduplication.store_path", F.lit(DEFAULT_STORE)).alias("store_key"),
        F.coalesce("output_format", F.lit("json")).alias("output_format"),
    ).orderBy("source_name")
    # A list of selectors arrives as the JSON text of an array.
    one_or_many = F.coalesce(
        F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")),
        F.array("value"),
    )
    rules = (
        settings.select("source_name", F.posexplode("detail_pattern").alias("field_pos", "field", "value"))
        .select("source_name", "field", "field_pos", F.posexplode(one_or_many).alias("rank", "selector"))
    )
    return sources, rules


def settings_problems(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Settings that would silently have no effect: file, problem, what.

    Unknown keys, value modes that act as text, selectors that are not understood.
    """
    texts = _settings_text(spark, path, fmt)

    def unknown(json_path: str, known: list[str], problem: str) -> DataFrame:
        part = F.col("text") if json_path == "$" else F.get_json_object("text", json_path)
        keys = F.array_except(F.json_object_keys(part), F.array(*[F.lit(k) for k in known]))
        return texts.select("file", F.lit(problem).alias("problem"), F.explode(keys).alias("what"))

    _, rules = read_rules(spark, path, fmt)
    modes = rules.withColumn("_m", split_mode("selector")).filter(F.col("_m.css") != "")
    odd_mode = modes.filter(
        ~(F.col("_m.mode").isin("text", "html") | F.col("_m.mode").startswith("attr:"))
    )
    odd_css = modes.filter(selector_steps(F.col("_m.css")).isNull())
    return (
        unknown("$", KNOWN_KEYS, "unknown key")
        .unionByName(unknown("$.deduplication", KNOWN_DEDUP_KEYS, "unknown dedup key"))
        .unionByName(_rule_problem(odd_mode, "mode acts as text"))
        .unionByName(_rule_problem(odd_css, "selector not supported"))
    )


def _rule_problem(rules: DataFrame, problem: str) -> DataFrame:
    return rules.select(
        F.col("source_name").alias("file"), F.lit(problem).alias("problem"), F.col("selector").alias("what")
    )


def rules_table(spark: SparkSession, patterns: dict[str, dict[str, str | list[str]]]) -> DataFrame:
    """Rules table from settings at hand: source -> field -> selector(s)."""
    rows = [
        (source, field, field_pos, rank, selector)
        for source, fields in patterns.items()
        for field_pos, (field, selectors) in enumerate(fields.items())
        for rank, selector in enumerate([selectors] if isinstance(selectors, str) else selectors)
    ]
    return spark.createDataFrame(
        rows, "source_name string, field string, field_pos int, rank int, selector string"
    )
