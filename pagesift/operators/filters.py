"""Keyword, time and validity filters; outcomes of fetch attempts."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.columns import as_col, let
from pagesift.functions.text import u_strip

MIN_CONTENT_CHARS = 40

# Answers below 500 that count as a failed fetch.
FAILED_STATUS = [401, 403, 429]


def haystack(*values: Column | str) -> Column:
    """All non-empty values joined by blanks, in lower case."""
    return F.lower(F.concat_ws(" ", *[F.nullif(as_col(v), F.lit("")) for v in values]))


def keyword_match(text: Column, keywords: Column | list[str]) -> Column:
    """Does any keyword stand in ``text`` (a ``haystack``)? None at all is a match.

    The text is put together once per row, however many keywords there are.
    """
    if isinstance(keywords, list):
        if not keywords:
            return F.lit(True)
        keywords = F.array(*[F.lit(k) for k in keywords])
    hit = let(text, lambda h: F.exists(keywords, lambda k: F.contains(h, F.lower(k))))
    return F.coalesce(F.size(keywords) <= 0, F.lit(True)) | hit


def within_window(ts: Column | str, start: datetime | Column, end: datetime | Column) -> Column:
    """Both ends count; a record without a time is kept.

    Written so that on a stored column it reaches the scan.
    """
    ts = as_col(ts)
    return ts.isNull() | ts.between(start, end)


def date_range(day: Column | str, start: date, end: date) -> Column:
    return F.to_date(as_col(day)).between(F.lit(start), F.lit(end))


def validity(title: Column | str, content: Column | str, strict: Column | bool) -> Column:
    """Reason why a record is not valid, null if it is."""
    strict = strict if isinstance(strict, Column) else F.lit(strict)
    empty = F.lit("")
    return F.when(
        u_strip(F.coalesce(as_col(title), empty)) == "", F.lit("missing_title")
    ).when(
        strict & (F.length(u_strip(F.coalesce(as_col(content), empty))) < MIN_CONTENT_CHARS),
        F.lit("content_too_short"),
    )


def fetch_failed(status: Column | str) -> Column:
    status = as_col(status)
    return (status >= 500) | status.isin(FAILED_STATUS)


def resolve_attempts(
    fetch_log: DataFrame, retries: int, request: str = "request_id", attempt: str = "attempt"
) -> DataFrame:
    """One row per request: its first good attempt, or the fact that all failed.

    ``fetch_log`` has a row per attempt with ``status`` (null: no answer).
    Gives request, attempts, failed, and the good attempt's other columns.
    """
    rest = [c for c in fetch_log.columns if c not in (request, attempt)]
    good = ~F.coalesce(fetch_failed("status"), F.lit(True))
    tried = fetch_log.filter(F.col(attempt) <= retries + 1)
    best = tried.groupBy(request).agg(
        F.min(F.when(good, F.col(attempt))).alias("_good_attempt"),
        F.max(attempt).alias("_last_attempt"),
        F.min_by(F.struct(*rest), F.when(good, F.col(attempt))).alias("_answer"),
    )
    return best.select(
        request,
        F.coalesce("_good_attempt", "_last_attempt").alias("attempts"),
        F.col("_good_attempt").isNull().alias("failed"),
        "_answer.*",
    )
