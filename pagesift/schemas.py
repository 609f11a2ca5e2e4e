"""Table schemas. Timestamps are instants; ``fields`` keeps what rules name."""

from __future__ import annotations

PAGES = "url STRING, status INT, html STRING, headers MAP<STRING,STRING>, fetched_at TIMESTAMP, source_name STRING"

SOURCES = (
    "source_name STRING, site_type STRING, target_url STRING, entry_pattern STRING, "
    "keywords ARRAY<STRING>, incremental BOOLEAN, use_entry_content BOOLEAN, "
    "by_url BOOLEAN, by_content BOOLEAN, store_key STRING, output_format STRING"
)

RULES = "source_name STRING, field STRING, rank INT, selector STRING"

HISTORY = "store_key STRING, url STRING, content_hash STRING, ts TIMESTAMP, source_name STRING"

OUTCOMES = "source_name STRING, url STRING, status STRING, reason STRING, ts TIMESTAMP"

LOG = "timestamp STRING, level STRING, event STRING, source STRING"

JSON_LIST = (
    "pageResult STRUCT<list: ARRAY<STRUCT<id: STRING, title: STRING, description: STRING, "
    "publishTimestamp: DOUBLE>>>"
)

JSON_DETAIL = (
    "initData STRUCT<detail: STRUCT<title: STRING, description: STRING, newsUrl: STRING, "
    "publishTimestamp: DOUBLE>>"
)

# Record fields with a column of their own at the sinks; the rest stays in ``extra``.
CORE_FIELDS = ["title", "content", "published_at", "summary", "original_url"]
