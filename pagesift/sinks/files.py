"""Record outputs: JSON lines, CSV, text digest, payload rows.

Outputs are laid out as ``source=<slug>/run=<tag>``. Before a write rows are
rebalanced by these columns: a source with a third of all records is split over
several tasks and files, small sources share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.text import slug_file, u_strip
from pagesift.functions.times import iso_utc
from pagesift.operators.running import numbered_in_order
from pagesift.session import materialize
from pagesift.sinks.commit import Commit

TARGET = ["source", "run"]
KEEP_NULLS = {"ignoreNullFields": "false"}
FORMATS = ["json", "csv", "txt", "sqlite", "mongodb"]


def with_target(records: DataFrame, run_tag: str) -> DataFrame:
    return records.withColumn("source", slug_file("source_name")).withColumn("run", F.lit(run_tag))


def run_tag(run_ts: Column | str) -> Column:
    """Name of a run: its UTC time as yyyyMMdd-HHmmss."""
    ts = F.col(run_ts) if isinstance(run_ts, str) else run_ts
    local = F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))
    return F.date_format(local, "yyyyMMdd-HHmmss")


def fetched_text(ts: Column | str) -> Column:
    """UTC time to the second, with a Z."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.regexp_replace(iso_utc(F.date_trunc("SECOND", ts)), r"\+00:00$", "Z")


def open_record(records: DataFrame) -> Column:
    """The record as one map of all its keys, as its source defines them."""
    head = F.map_from_arrays(
        F.array(F.lit("url"), F.lit("source_name"), F.lit("site_type"), F.lit("raw_html"), F.lit("fetched_at")),
        F.array("url", "source_name", "site_type", "raw_html", fetched_text("fetched_at")),
    )
    own = F.map_filter(
        "fields", lambda k, _: ~k.isin("url", "source_name", "site_type", "raw_html", "fetched_at")
    )
    return F.map_concat(head, own)


def payload(records: DataFrame) -> Column:
    """JSON text of a record; nulls and non-ASCII text are kept."""
    return F.to_json(open_record(records), KEEP_NULLS)


def payload_rows(records: DataFrame) -> DataFrame:
    """Numbered JSON rows per source: source_name, id, payload."""
    rows = numbered_in_order(records, ["source_name"], ["pos", "url"], "id")
    return rows.select("source_name", "id", payload(rows).alias("payload"))


def document_rows(records: DataFrame) -> DataFrame:
    """One JSON document per record; the collection is named after the source."""
    return records.select(F.col("source_name").alias("collection"), payload(records).alias("document"))


def _filled(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def digest_text(number: Column, value: dict[str, Column]) -> Column:
    """Text block of a record: title line, times, summary, link, blank line."""
    none = F.lit(None).cast("string")

    def first(*names: str) -> Column:
        return F.coalesce(*[_filled(value.get(n, none)) for n in names])

    title = F.coalesce(first("title", "headline"), F.lit("(未提供标题)"))
    block = F.concat_ws(
        "\n",
        F.concat(
            number.cast("string"),
            F.lit(". "),
            title,
            F.coalesce(F.concat(F.lit("｜"), first("source_name")), F.lit("")),
        ),
        F.concat(F.lit("发布时间："), first("published_at", "time", "timestamp")),
        F.concat(F.lit("抓取时间："), first("fetched_at")),
        _filled(u_strip(first("summary", "content"))),
        F.concat(F.lit("链接："), first("original_url", "source_url", "url")),
    )
    return F.concat(u_strip(block), F.lit("\n\n"))


def text_digest(records: DataFrame) -> DataFrame:
    """Numbered digest blocks per source: source_name, row_no, block."""
    rows = numbered_in_order(records, ["source_name"], ["pos", "url"])
    names = [
        "title", "headline", "published_at", "time", "timestamp", "summary", "content",
        "original_url", "source_url",
    ]
    value = {name: F.col("fields")[name] for name in names}
    value |= {
        "source_name": F.col("source_name"),
        "url": F.col("url"),
        "fetched_at": fetched_text("fetched_at"),
    }
    return rows.select("source_name", "row_no", digest_text(F.col("row_no"), value).alias("block"))


def flat_records(records: DataFrame, names: list[str]) -> DataFrame:
    """Records with the named fields as columns, sorted by name as a CSV header is."""
    fixed = {
        "url": F.col("url"),
        "source_name": F.col("source_name"),
        "site_type": F.col("site_type"),
        "raw_html": F.col("raw_html"),
        "fetched_at": fetched_text("fetched_at"),
    }
    columns = {**{n: F.col("fields")[n] for n in names}, **fixed}
    return records.select(*[columns[n].alias(n) for n in sorted(columns)])


def _write(rows: DataFrame, fmt: str, path: str, options: dict[str, str]) -> None:
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**options)
        .partitionBy(*TARGET)
        .format(fmt)
        .save(path)
    )


def write_json(records: DataFrame, path: str, run_tag: str) -> None:
    rows = with_target(records.select("source_name", payload(records).alias("value")), run_tag)
    _write(rows.drop("source_name").hint("rebalance", *TARGET), "text", path, {})


def write_csv(records: DataFrame, path: str, run_tag: str, names: list[str]) -> None:
    rows = with_target(flat_records(records, names), run_tag).hint("rebalance", *TARGET)
    # Values are written as they are, with their leading and trailing blanks.
    spaces = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    _write(rows, "csv", path, {"header": "true", "quote": '"', "escape": '"', **spaces})


def write_text(records: DataFrame, path: str, run_tag: str) -> None:
    """Digest blocks in order, a blank line after each."""
    rows = with_target(text_digest(records), run_tag)
    ordered = rows.hint("rebalance", *TARGET).sortWithinPartitions(*TARGET, "row_no")
    # The writer ends each row with a line end of its own.
    block = F.regexp_replace("block", r"\n\z", "")
    _write(ordered.select(*TARGET, block.alias("value")), "text", path, {})


def write_payload(records: DataFrame, path: str, run_tag: str) -> None:
    rows = with_target(payload_rows(records), run_tag).drop("source_name")
    _write(rows.hint("rebalance", *TARGET), "parquet", path, {})


def write_documents(records: DataFrame, path: str, run_tag: str) -> None:
    rows = document_rows(records).withColumn("source_name", F.col("collection"))
    _write(with_target(rows, run_tag).drop("source_name").hint("rebalance", *TARGET), "parquet", path, {})


def write_records(records: DataFrame, path: str, run_tag: str, csv_fields: list[str]) -> None:
    """Write every record in the format of its source (``output_format``).

    The records are materialized once, then each format takes its share. All
    formats appear together: if one fails, the run leaves nothing behind.
    """
    ready = materialize(records, "export")
    writers = {
        "json": lambda df, to: write_json(df, to, run_tag),
        "csv": lambda df, to: write_csv(df, to, run_tag, csv_fields),
        "txt": lambda df, to: write_text(df, to, run_tag),
        "sqlite": lambda df, to: write_payload(df, to, run_tag),
        "mongodb": lambda df, to: write_documents(df, to, run_tag),
    }
    outputs = {
        fmt: (lambda to, fmt=fmt: writers[fmt](ready.filter(F.col("output_format") == fmt), to)) for fmt in FORMATS
    }
    Commit(records.sparkSession, path, len(TARGET)).write(outputs)
