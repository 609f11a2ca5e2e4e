"""Dedup within a batch and against the history.

The rule, record by record in order: a record whose URL or content hash is
already stored is a duplicate; anything else is stored. Here it is worked out
in sets, with the same result.

Scale notes. Text and page source never take part: the work runs on slim rows
(store, URL, hash, order). A hot key - a store, one hash shared by a third of
all rows - is reduced to one row by each task before anything is shuffled, and
what survives is matched by record identity, which no two rows share. Where
all rows must be kept, hot keys are salted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.functions.text import content_hash, hash_seed
from pagesift.operators import chains, membership
from pagesift.operators.membership import Membership
from pagesift.operators.skew import ROWS_PER_SALT, salted_left_join
from pagesift.session import checked_broadcast, materialize

RECORD_KEY = ["store_key", "url"]
# Arrival order: source, position in it; the URL makes it total.
ORDER = ["source_ord", "pos", "url"]


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row of each key: a pre-aggregated maximum, no sort of groups."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
    return last.select(*keys, "_last.*").select(df.columns)


def known_urls(work: DataFrame, history: DataFrame, bits: Membership | None = None) -> DataFrame:
    """Rows of a work list whose URL the history has: the pre-filter's skips.

    With ``bits``, the history's bitmap, only rows that may be known meet the
    history.
    """
    checked = work.filter("incremental AND by_url")
    if bits is not None:
        return membership.known(checked, history, "url", bits)
    return checked.join(history.select(*RECORD_KEY), RECORD_KEY, "left_semi")


def unknown_urls(work: DataFrame, history: DataFrame, bits: Membership | None = None) -> DataFrame:
    """Work list without the URLs the history has, where that check is on."""
    checked = F.col("incremental") & F.col("by_url")
    if bits is not None:
        return membership.without_known(work, history, "url", checked, bits)
    wanted = history.select(*RECORD_KEY, F.lit(True).alias("_check"))
    marked = work.withColumn("_check", F.when(checked, F.lit(True)))
    return marked.join(wanted, [*RECORD_KEY, "_check"], "left_anti").drop("_check")


def fingerprint(records: DataFrame) -> DataFrame:
    """Add ``content_hash``, taken of the content or else of the page source."""
    return records.withColumn("content_hash", content_hash(hash_seed("content", "raw_html")))


def fingerprint_fields(records: DataFrame) -> DataFrame:
    """``fingerprint`` for records that keep their content in ``fields``."""
    seed = hash_seed(F.col("fields")["content"], F.col("raw_html"))
    return records.withColumn("content_hash", content_hash(seed))


IDENTITY = ["store_key", *ORDER]
# Rows whose content may make them duplicates; a null hash is like no other.
COMPARED = "by_content AND content_hash IS NOT NULL"


def slim_rows(records: DataFrame) -> DataFrame:
    """What dedup needs of records; checks not given as columns are on."""
    flags = [
        (F.col(c) if c in records.columns else F.lit(True)).alias(c)
        for c in ("by_url", "by_content")
    ]
    return records.select(*IDENTITY, "content_hash", *flags)


def _earliest(rows: DataFrame, key: str) -> DataFrame:
    """The earliest row of each (store, key): a pre-aggregated minimum."""
    row = F.struct(*ORDER, *[c for c in rows.columns if c not in ("store_key", *ORDER)])
    first = rows.groupBy("store_key", key).agg(F.min(row).alias("_row"))
    return first.select("store_key", "_row.*").select(rows.columns)


def _drop_known(
    rows: DataFrame, history: DataFrame, key: str, flag: str, bits: Membership | None = None
) -> DataFrame:
    if bits is not None:
        return membership.without_known(rows, history, key, F.col(flag), bits)
    known = history.select("store_key", key, F.lit(True).alias(flag))
    return rows.join(known, ["store_key", key, flag], "left_anti").select(rows.columns)


def stored_rows(
    records: DataFrame, history: DataFrame, unique_urls: bool = False, bits: Membership | None = None
) -> DataFrame:
    """The slim rows that get stored.

    With ``unique_urls`` the caller vouches that a URL occurs once per store in
    the batch and that the URL check is on; one lazy plan then does it.
    Otherwise that is looked up first, and if URLs do repeat, conflicts are
    decided along their chains by pointer jumping; see ``chains``.

    Where the URL check is off, a stored row replaces the one its URL had, and
    the replaced content may be stored again; see ``_stored_in_turn``. There
    the latest row of a URL is all that counts of the history. Elsewhere a URL
    has one row anyway; a store whose check was off once is read with ``latest``.

    With ``bits``, the history's bitmap, rows that are certainly new don't meet
    the history.
    """
    slim = slim_rows(records)
    if bits is not None:
        # Read once for the rows that may be known and once for the others.
        slim = materialize(slim, "dedup-slim")
    replacing = None if unique_urls else replacing_stores(slim)
    if replacing is not None:
        slim = materialize(slim, "dedup-slim")
        in_turn = slim.join(replacing, "store_key", "left_semi").select(slim.columns)
        slim = slim.join(replacing, "store_key", "left_anti").select(slim.columns)
        return _stored_in_turn(in_turn, history).unionByName(_stored_at_once(slim, history, False, bits))
    return _stored_at_once(slim, history, unique_urls, bits)


def _stored_at_once(
    slim: DataFrame, history: DataFrame, unique_urls: bool, bits: Membership | None = None
) -> DataFrame:
    """Stored rows where what is stored stays: stores that replace nothing."""
    rows = _drop_known(slim, history, "url", "by_url", bits)
    if unique_urls:
        earliest = _earliest(rows.filter("content_hash IS NOT NULL"), "content_hash").filter("by_content")
        if bits is not None:
            earliest = materialize(earliest, "dedup-first")
        first = _drop_known(earliest, history, "content_hash", "by_content", bits)
        return first.unionByName(rows.filter(f"NOT ({COMPARED})"))

    if bits is not None:
        rows = materialize(rows, "dedup-rows")
    still_open = materialize(
        _drop_known(rows, history, "content_hash", "by_content", bits), "dedup-open"
    )
    repeated = still_open.groupBy("store_key", "url").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("by_url").alias("checked")
    )
    if repeated.filter("n > 1 AND checked").isEmpty():
        first = _earliest(still_open.filter("content_hash IS NOT NULL"), "content_hash").filter("by_content")
        return first.unionByName(still_open.filter(f"NOT ({COMPARED})"))
    return chains.decided(still_open, ORDER)


def replacing_stores(slim: DataFrame) -> DataFrame | None:
    """Stores in which a row may replace another and contents are compared, or none."""
    switches = slim.groupBy("store_key").agg(
        F.bool_or(~F.col("by_url")).alias("_replaces"), F.bool_or("by_content").alias("_compares")
    )
    stores = switches.filter("_replaces AND _compares").select("store_key")
    if stores.isEmpty():
        return None
    return checked_broadcast(materialize(stores, "dedup-stores"))


def held_rows(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Latest history rows that share a URL or a hash with the batch."""
    latest = history_upsert(history, history.limit(0)).select(*RECORD_KEY, "content_hash")
    parts = [
        latest.join(rows.select("store_key", key).distinct(), ["store_key", key], "left_semi")
        for key in ("url", "content_hash")
    ]
    return reduce(DataFrame.unionByName, [p.select(latest.columns) for p in parts]).distinct()


def _stored_in_turn(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Stored rows where a stored row replaces the one its URL had.

    ``held`` is what the stores hold: one row per URL. A round drops the rows
    that are duplicates whatever is decided later, then stores those that no
    open row can influence, so the earliest open row is always decided. A URL
    whose content keeps changing to and fro takes a round for each change.
    Facts are joined one row per key, so AQE can split a hot key's open rows.
    """
    held = materialize(held_rows(rows, history), "dedup-held")
    still_open, stored = rows, []
    while True:
        left = _drop_known(still_open, held, "url", "by_url")
        still_open = materialize(_drop_held(left, held), "dedup-open")
        if still_open.isEmpty():
            break
        winners = materialize(_next_in_turn(still_open, held), "dedup-stored")
        stored.append(winners)
        kept = held.join(winners.select(*RECORD_KEY), RECORD_KEY, "left_anti")
        held = materialize(kept.unionByName(winners.select(held.columns)), "dedup-held")
        still_open = still_open.join(winners.select(*IDENTITY), IDENTITY, "left_anti").select(rows.columns)
    return reduce(DataFrame.unionByName, stored) if stored else rows.limit(0)


def _drop_held(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Open rows without those whose hash is held until after them.

    A hash is held at least until an open row of its URL brings another one.
    """
    changes = (
        rows.join(held.withColumnRenamed("content_hash", "_hash"), RECORD_KEY)
        .filter(F.col("content_hash") != F.col("_hash"))
        .groupBy(*RECORD_KEY)
        .agg(F.min(F.struct(*ORDER)).alias("_until"))
    )
    lasts = (
        held.join(changes, RECORD_KEY, "left")
        .groupBy("store_key", "content_hash")
        .agg(F.bool_or(F.col("_until").isNull()).alias("_stays"), F.max("_until").alias("_until"))
    )
    order = F.struct(*ORDER)
    known = F.col("by_content") & (F.col("_stays") | (order < F.col("_until")))
    marked = rows.join(lasts, ["store_key", "content_hash"], "left")
    return marked.filter(~F.coalesce(known, F.lit(False))).select(rows.columns)


def _next_in_turn(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Open rows that get stored whatever becomes of the others.

    Such a row is the first open one of its URL, its hash is neither held nor
    in an earlier open row, and no earlier open row asks for the hash that it
    replaces or, being unchecked itself, for the one it brings.
    """
    order = F.struct(*ORDER)
    hash_key = ["store_key", "content_hash"]
    openings = rows.groupBy(*hash_key).agg(
        F.min(order).alias("_first"), F.min(F.when(F.col("by_content"), order)).alias("_asked")
    )
    facts = openings.join(held.select(*hash_key, F.lit(True).alias("_held")).distinct(), hash_key, "left")
    replaced = held.join(openings, hash_key).select(*RECORD_KEY, F.col("_asked").alias("_asked_old"))
    heads = _earliest(rows, "url").join(facts, hash_key, "left").join(replaced, RECORD_KEY, "left")
    checked = (order == F.col("_first")) & F.col("_held").isNull()
    unchecked = F.col("_asked").isNull() | (order <= F.col("_asked"))
    free = F.col("_asked_old").isNull() | (order <= F.col("_asked_old"))
    return heads.filter(F.when(F.col("by_content"), checked).otherwise(unchecked) & free).select(rows.columns)


def _present(flagged: DataFrame, stored: DataFrame, history: DataFrame) -> DataFrame:
    """Identities of rows whose hash the store holds when their turn comes."""
    begin = F.struct(*ORDER)
    points = stored.select(*RECORD_KEY, "content_hash", begin.alias("_from"))
    old = held_rows(flagged, history)
    points = points.unionByName(old.withColumn("_from", F.lit(None).cast(points.schema["_from"].dataType)))
    along = Window.partitionBy(*RECORD_KEY).orderBy(F.asc_nulls_first("_from"))
    spans = points.select(
        F.col("store_key").alias("_s"), F.col("content_hash").alias("_k"), "_from",
        F.lead("_from").over(along).alias("_until"),
    )
    inside = (
        (F.col("store_key") == F.col("_s"))
        & (F.col("content_hash") == F.col("_k"))
        & (F.col("_from").isNull() | (begin > F.col("_from")))
        & (F.col("_until").isNull() | (begin <= F.col("_until")))
    )
    return flagged.join(spans, inside, "left_semi").select(*IDENTITY)


def _first_order(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy("store_key", key).agg(F.min(F.struct(*ORDER)).alias("_first"))


def dedup(
    records: DataFrame, history: DataFrame, unique_urls: bool = False, bits: Membership | None = None
) -> DataFrame:
    """Records that are not duplicates; see ``stored_rows``."""
    stored = stored_rows(records, history, unique_urls, bits)
    return records.join(stored.select(*IDENTITY), IDENTITY, "left_semi").select(records.columns)


def duplicate_flags(
    records: DataFrame,
    history: DataFrame,
    unique_urls: bool = False,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Slim rows with url_duplicate, content_duplicate and is_duplicate.

    Every row is kept, so a hot hash cannot be reduced here; its rows are
    joined with what is known about the hash in salted parts. The slim rows are
    written once, so text is read and hashed once.
    """
    slim = flagged = materialize(slim_rows(records), "dedup-slim")
    replacing = None if unique_urls else replacing_stores(slim)
    stored = stored_rows(flagged, history, unique_urls)
    order = F.struct(*ORDER)
    for key, flag, result in (
        ("url", "by_url", "url_duplicate"),
        ("content_hash", "by_content", "content_duplicate"),
    ):
        keys = ["store_key", key]
        seen = history.groupBy(*keys).agg(F.lit(True).alias("_seen"))
        facts = _first_order(stored, key).join(seen, keys, "full")
        flagged = (
            salted_left_join(flagged, facts, keys, ORDER, rows_per_salt)
            .withColumn(
                result,
                F.col(flag)
                & (
                    F.col("_seen").isNotNull()
                    | F.coalesce(order > F.col("_first"), F.lit(False))
                ),
            )
            .drop("_first", "_seen")
        )
    if replacing is not None:
        checked = slim.join(replacing, "store_key", "left_semi")
        present = _present(checked, stored, history).withColumn("_present", F.lit(True))
        stores = replacing.withColumn("_replaces", F.lit(True))
        flagged = flagged.join(stores, "store_key", "left").join(present, IDENTITY, "left")
        here = F.col("by_content") & F.col("_present").isNotNull()
        flagged = flagged.withColumn(
            "content_duplicate", F.when(F.col("_replaces"), here).otherwise(F.col("content_duplicate"))
        ).drop("_present", "_replaces")
    return flagged.withColumn("is_duplicate", F.col("url_duplicate") | F.col("content_duplicate"))


# --- history -------------------------------------------------------------------


def history_rows(stored: DataFrame, run_ts: Column) -> DataFrame:
    """Stored records as history rows, stamped to the second with the run's time.

    One row per (store, URL): the last one, where a record replaced another.
    """
    last = stored.groupBy(*RECORD_KEY).agg(
        F.max_by(F.struct("content_hash", "source_name"), F.struct(*ORDER)).alias("_last")
    )
    return last.select(
        *RECORD_KEY,
        "_last.content_hash",
        F.date_trunc("SECOND", run_ts).alias("ts"),
        "_last.source_name",
    )


def history_upsert(history: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (store, URL): the latest. New rows win over old ones."""
    both = history.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in history.columns if c not in RECORD_KEY]
    latest = both.groupBy(*RECORD_KEY).agg(
        F.max_by(F.struct(*rest), F.struct("ts", "_new")).alias("_last")
    )
    return latest.select(*RECORD_KEY, "_last.*").select(history.columns)


def history_without(history: DataFrame, store_key: str) -> DataFrame:
    """History after a reset of one store, whichever sources share it."""
    return history.filter(F.col("store_key") != store_key)


def recent_history(history: DataFrame, source: str, n: int = 20) -> DataFrame:
    """URL and time of a source's newest entries (a distributed top-n)."""
    return (
        history.filter(F.col("source_name") == source)
        .select("url", "ts")
        .orderBy(F.desc("ts"), "url")
        .limit(n)
    )


def recent_history_all(history: DataFrame, n: int = 20) -> DataFrame:
    """The newest entries of every source; tasks send n rows per source at most."""
    window = Window.partitionBy("source_name").orderBy(F.desc("ts"), "url")
    return (
        history.select("source_name", "url", "ts", F.row_number().over(window).alias("rank"))
        .filter(F.col("rank") <= n)
    )
