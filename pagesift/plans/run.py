"""One run over all sources: pages in, records, outcomes and history rows out."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.operators import dedup, extract, filters, report
from pagesift.operators.keywords import keyword_matcher
from pagesift.operators.membership import Membership
from pagesift.operators.nodes import page_nodes
from pagesift.operators.records import enrich
from pagesift.operators.selectors import selector_steps
from pagesift.functions.times import record_ts
from pagesift.session import checked_broadcast, materialize

WORK = ["source_name", "pos", "url"]
# Target URLs that are put into a filter on a page store.
MAX_TARGETS = 1000
SETTINGS = [
    "source_name", "site_type", "keywords", "incremental", "by_url", "by_content",
    "store_key", "output_format",
]


@dataclass
class RunResult:
    """Tables of a finished run; ``records`` are the ones to export."""

    records: DataFrame
    outcomes: DataFrame
    history: DataFrame
    summary: DataFrame


@dataclass
class RunOptions:
    run_ts: datetime
    window: tuple[datetime, datetime] | None = None
    tz: str = "UTC"
    # Off: every page that is no entry page is worked on, linked or not.
    follow_links: bool = True
    # Attempts after the first that count, for pages with an ``attempt`` column.
    retries: int | None = None
    keywords_on_lists: bool = False
    fill_nulls: bool = False
    summary_cut: str = "words"
    # ``source_name, keyword`` in place of the sources' own lists, for many keywords.
    keywords: DataFrame | None = None


def asked_url(pages: DataFrame) -> Column:
    """The URL a page was asked for; its own is the one after redirects."""
    return F.col("requested_url") if "requested_url" in pages.columns else F.col("url")


def good_captures(pages: DataFrame, retries: int | None) -> DataFrame:
    """Captures that count, with ``_capture``: the first one of a page is the smallest.

    The order is attempt, capture time, then a hash of the source. A page store
    has the hash as a column, and a number that tells equal captures apart.
    """
    good = pages.filter(~filters.fetch_failed("status"))
    if "attempt" in pages.columns and retries is not None:
        good = good.filter(F.col("attempt") <= retries + 1)
    order = [F.col(c) for c in ("attempt", "fetched_at") if c in pages.columns]
    if is_stored(pages):
        order += [F.col("capture_hash").alias("_hash"), F.col("batch"), F.col("capture_no")]
    else:
        order.append(F.xxhash64("html").alias("_hash"))
    return good.withColumn("_capture", F.struct(*order))


def is_stored(pages: DataFrame) -> bool:
    """Whether the pages come from a page store."""
    return {"capture_hash", "capture_no", "batch"} <= set(pages.columns)


def at_targets(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Stored captures of the sources' target URLs, as a filter that reaches the files.

    Files of a store are sorted by URL, so most of their text is skipped. With
    more targets than that the join alone decides.
    """
    rows = sources.select("target_url").distinct().limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        return pages
    return pages.filter(F.col("requested_url").isin([r["target_url"] for r in rows]))


def entry_pages(pages: DataFrame, sources: DataFrame, retries: int | None = None) -> DataFrame:
    """Captured entry pages, one per source and target, with their source's settings, selectors parsed.

    Written out once, so the pages table is not read again for each use.
    """
    times = [c for c in ("fetched_at",) if c in pages.columns]
    if is_stored(pages):
        pages = at_targets(pages, sources)
    wanted = good_captures(pages, retries).withColumn("target_url", asked_url(pages)).select(
        "source_name", "target_url", "url", "html", *times, "_capture"
    )
    parsed = sources.withColumn("entry_steps", selector_steps("entry_pattern"))
    wanted = wanted.join(checked_broadcast(parsed), ["source_name", "target_url"])
    first = dedup.first_per_key(wanted, ["source_name", "target_url"], ["_capture"])
    return materialize(first.drop("_capture"), "entries")


def entry_trees(entries: DataFrame) -> DataFrame:
    return page_nodes(entries)


def list_work(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """List records of the sources that use their entry page's content."""
    wanted = entries.filter("use_entry_content").withColumn(
        "family", extract.host_family("url")
    )
    trees = entry_trees(extract.attach_rules(wanted, rules, fallbacks=False))
    times = [c for c in ("fetched_at",) if c in entries.columns]
    return extract.family_records(trees, "source_name", *times)


def detail_records(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Detail pages (source_name, pos, url, html, settings) to records with ``fields``."""
    filled = extract.detail_fields(pages, rules)
    own_html = F.when(
        F.map_contains_key("fields", F.lit("raw_html")), F.col("fields")["raw_html"]
    ).otherwise(F.col("html"))
    return filled.withColumn("raw_html", own_html).drop("tree", "html")


def keyword_hit(many: DataFrame | None = None) -> Column:
    values = F.array_join(F.filter(F.map_values("fields"), lambda v: v != ""), " ")
    text = filters.haystack("url", "source_name", "site_type", values, "raw_html")
    if many is not None:
        return keyword_matcher(many)(text, F.col("source_name"))
    return filters.keyword_match(text, F.col("keywords"))


def judge(records: DataFrame, options: RunOptions) -> DataFrame:
    """Enrich records and add ``reason``: null if the record may be stored.

    Needs ``origin`` ('list' or 'detail'): keywords and the length rule are for
    detail records. Order: keywords, validity, window.
    """
    detail = F.col("origin") == "detail"
    keyword_applies = F.lit(True) if options.keywords_on_lists else detail
    run_ts = F.lit(options.run_ts)
    kept = records.withColumn("_keyword", ~keyword_applies | keyword_hit(options.keywords))
    full = enrich(kept, run_ts, options.fill_nulls, options.summary_cut)
    reason = F.when(~F.col("_keyword"), F.lit("keyword")).otherwise(
        filters.validity(F.col("fields")["title"], F.col("fields")["content"], strict=detail)
    )
    if options.window:
        start, end = options.window
        time = record_ts(full, options.tz, start.year)
        inside = filters.within_window(time, F.lit(start), F.lit(end))
        reason = F.coalesce(reason, F.when(~inside, F.lit("window_filtered")))
    return full.withColumn("reason", reason).drop("_keyword")


def status_of(reason: Column) -> Column:
    return (
        F.when(reason.isNull(), F.lit("success"))
        .when(reason.isin("keyword", "window_filtered", "duplicate", "known_url"), F.lit("skipped"))
        .otherwise(F.lit("failed"))
    )


def chosen_captures(visit: DataFrame, pages: DataFrame, retries: int | None) -> DataFrame:
    """The work list with, per URL, its first good capture and the number of them.

    Works on keys and hashes only; page text is joined afterwards.
    """
    first = good_captures(pages, retries).groupBy("source_name", asked_url(pages).alias("url")).agg(
        F.min("_capture").alias("_first"), F.count(F.lit(1)).alias("_captures")
    )
    return visit.join(first, ["source_name", "url"])


def fetched_pages(visit: DataFrame, pages: DataFrame, options: RunOptions) -> DataFrame:
    """Captured pages of the work list, one for each URL. Only keys are shuffled early.

    Of a page store the chosen captures' text is read once, where it lies: the
    list goes to the buckets. Elsewhere captures that are equal in everything,
    their source included, are brought together, and a list too long to be sent
    out is joined by a shuffle.
    """
    times = [c for c in ("fetched_at",) if c in pages.columns]
    captured = good_captures(pages, options.retries).select(
        "source_name", asked_url(pages).alias("url"), "html", *times, "_capture",
        *(["capture_hash"] if is_stored(pages) else []),
    )
    chosen = materialize(chosen_captures(visit, pages, options.retries), "chosen")
    wanted = checked_broadcast(chosen)
    if is_stored(pages):
        wanted = wanted.withColumn("capture_hash", F.col("_first._hash")).hint("shuffle_hash")
        found = captured.join(wanted, ["source_name", "url", "capture_hash"])
        # No capture is before the first; an equation would be taken as a key and undo the buckets.
        return found.filter("_capture <= _first").drop("_capture", "_first", "_captures", "capture_hash")
    found = captured.join(wanted, ["source_name", "url"]).filter(F.col("_capture").eqNullSafe(F.col("_first")))
    several = found.filter("_captures > 1").dropDuplicates(["source_name", "url"])
    both = found.filter("_captures = 1").unionByName(several)
    return both.drop("_capture", "_first", "_captures")


def outcome_rows(records: DataFrame, reason: str | Column | None) -> DataFrame:
    reason = reason if isinstance(reason, Column) else F.lit(reason).cast("string")
    return records.select("source_name", "url", reason.alias("reason"))


def run_batch(
    pages: DataFrame,
    sources: DataFrame,
    rules: DataFrame,
    history: DataFrame,
    options: RunOptions,
    bits: Membership | None = None,
) -> RunResult:
    """All sources in one job. ``bits`` is the history's bitmap, if it has one.

    Page text is read once for the few entry pages, and once for the detail
    pages that are really needed: known URLs are dropped before any page is
    parsed. Judged records are written once; dedup and outputs start there.
    """
    settings = checked_broadcast(sources.select(SETTINGS))
    entries = entry_pages(pages, sources, options.retries)
    listed = None
    if not entries.filter("use_entry_content").isEmpty():
        found = materialize(list_work(entries, rules), "listed")
        listed = found.join(settings, "source_name").withColumn("origin", F.lit("list"))

    if options.follow_links:
        links = extract.entry_links(entry_trees(entries), "entry_steps", "source_name")
        work = extract.links_or_target(links, sources).withColumnRenamed("link", "url")
        if listed is not None:
            work = extract.prefer_records(listed, work)
    else:
        entry_keys = entries.select("source_name", F.col("target_url").alias("url"))
        work = pages.select("source_name", F.lit(0).alias("pos"), asked_url(pages).alias("url"))
        work = work.distinct().join(checked_broadcast(entry_keys), ["source_name", "url"], "left_anti")
    work = work.select(*WORK).join(settings, "source_name")
    if bits is not None:
        # Read for what is known, for what is not, and for what may be.
        work = materialize(work, "work")

    checked = [*WORK, "store_key", "incremental", "by_url"]
    known = dedup.known_urls(work.select(*checked), history, bits)
    visit = dedup.unknown_urls(work, history, bits).select(*WORK)
    if listed is not None:
        known = known.unionByName(dedup.known_urls(listed.select(*checked), history, bits))
        judged_lists = materialize(judge(dedup.unknown_urls(listed, history, bits), options), "lists")
        # A list record without a title gets a second chance as a detail page.
        retry = judged_lists.filter("reason = 'missing_title'").select(*WORK)
        visit = visit.unionByName(retry)
    visit = materialize(visit, "visit")

    details = fetched_pages(visit, pages, options).join(settings, "source_name")
    judged = judge(
        detail_records(details, rules).withColumn("origin", F.lit("detail")), options
    )
    if listed is not None:
        captured = pages.filter(~filters.fetch_failed("status")).select(
            "source_name", asked_url(pages).alias("url"), F.lit("missing_title").alias("reason")
        )
        retried = ["source_name", "url", "reason"]
        judged = judged.unionByName(
            judged_lists.join(captured, retried, "left_anti"), allowMissingColumns=True
        )
    judged = materialize(
        dedup.fingerprint_fields(judged.withColumn("source_ord", F.col("source_name"))), "judged"
    )

    valid = judged.filter(F.col("reason").isNull())
    stored = dedup.stored_rows(valid, history, bits=bits).select(*dedup.IDENTITY)
    fresh = valid.join(stored, dedup.IDENTITY, "left_semi")
    exported = fresh.filter("incremental").unionByName(valid.filter("NOT incremental"))
    duplicates = valid.filter("incremental").join(stored, dedup.IDENTITY, "left_anti")
    unfetched = visit.join(judged.select("source_name", "url"), ["source_name", "url"], "left_anti")
    outcomes = (
        outcome_rows(exported, None)
        .unionByName(outcome_rows(duplicates, "duplicate"))
        .unionByName(outcome_rows(judged.filter(F.col("reason").isNotNull()), F.col("reason")))
        .unionByName(outcome_rows(unfetched, "not_fetched"))
        .withColumn("status", status_of(F.col("reason")))
    )
    outcomes = materialize(report.with_prefilter_skips(outcomes, known), "outcomes")
    return RunResult(
        records=exported,
        outcomes=outcomes,
        history=dedup.history_rows(fresh, F.lit(options.run_ts)),
        summary=report.run_summary_total(report.run_summary(outcomes), sources),
    )
