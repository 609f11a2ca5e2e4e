"""Set-wise dedup against the record-by-record rule; history; running sums."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from pagesift.operators import chains, dedup, filters, membership, report, running
from pagesift.schemas import HISTORY
from pagesift.sources import history as store
from pagesift.sources.logs import read_logs, recent_log
from pagesift.sources.pages import append_items, merge_snapshots, read_pages

BATCH = (
    "store_key string, url string, source_ord string, pos int, content_hash string, "
    "by_url boolean, by_content boolean, source_name string"
)


def one_by_one(batch, history):
    held = {(h[0], h[1]): h[2] for h in history}
    stored, flags = [], {}
    for r in sorted(batch, key=lambda r: (r[0], r[2], r[3], r[1])):
        url_dup = r[5] and (r[0], r[1]) in held
        content_dup = r[6] and any(store == r[0] and h == r[4] for (store, _), h in held.items())
        flags[(r[0], r[2], r[3])] = (url_dup, content_dup)
        if not (url_dup or content_dup):
            stored.append((r[0], r[2], r[3]))
            held[(r[0], r[1])] = r[4]
    return sorted(stored), flags


def random_batch(rng, size, urls, hashes, switches):
    batch = []
    for i in range(size):
        source = rng.choice("ab")
        by_url, by_content = switches[source]
        batch.append(
            (rng.choice("st"), f"u{rng.randint(0, urls)}", source, i, f"h{rng.randint(0, hashes)}", by_url, by_content, source)
        )
    return batch


@pytest.mark.parametrize(
    "seed, switches",
    [
        (1, {"a": (True, True), "b": (True, True)}),
        (2, {"a": (True, True), "b": (True, True)}),
        (3, {"a": (False, True), "b": (True, True)}),
        (4, {"a": (True, False), "b": (False, True)}),
        (5, {"a": (False, False), "b": (True, True)}),
    ],
)
def test_dedup_equals_the_sequential_rule(spark, seed, switches):
    """Repeated URLs, repeated content, chains of both."""
    rng = random.Random(seed)
    batch = random_batch(rng, 150, 60, 60, switches)
    day = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    history = [("s", f"u{rng.randint(0, 60)}", f"h{rng.randint(0, 60)}", day(d + 1), "a") for d in range(15)]
    stored, flags = one_by_one(batch, history)
    df = spark.createDataFrame(batch, BATCH)
    known = spark.createDataFrame(history, HISTORY)
    known = dedup.history_upsert(known, known.limit(0))
    kept = dedup.dedup(df, known)
    assert sorted((r.store_key, r.source_ord, r.pos) for r in kept.collect()) == stored
    got = {
        (r.store_key, r.source_ord, r.pos): (r.url_duplicate, r.content_duplicate)
        for r in dedup.duplicate_flags(df, known, rows_per_salt=4).collect()
    }
    assert got == flags


def test_a_replaced_row_frees_its_content(spark):
    """The URL check is off: the second page of u1 replaces the first, so its content may come again."""
    rows = [("s", "u1", "x", 0, "h1"), ("s", "u1", "x", 1, "h2"), ("s", "u3", "x", 2, "h1"), ("s", "u4", "x", 3, "h2"), ("s", "u5", "x", 4, "old")]
    df = spark.createDataFrame(rows, "store_key string, url string, source_ord string, pos int, content_hash string")
    df = df.withColumn("by_url", F.lit(False)).withColumn("source_name", F.lit("x"))
    day = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    known = spark.createDataFrame([("s", "u9", "old", day(1), "x"), ("s", "u9", "new", day(2), "x")], HISTORY)
    kept = dedup.dedup(df, known)
    assert sorted(r.pos for r in kept.collect()) == [0, 1, 2, 4]
    rows = dedup.history_rows(kept, F.lit(day(3))).collect()
    assert sorted((r.url, r.content_hash) for r in rows) == [("u1", "h2"), ("u3", "h1"), ("u5", "old")]


def test_unique_urls_in_one_plan(spark):
    rng = random.Random(9)
    switches = {"a": (True, True), "b": (True, False)}
    batch = [(*r[:1], f"u{i}", *r[2:]) for i, r in enumerate(random_batch(rng, 200, 1, 40, switches))]
    history = [("s", f"u{u}", f"h{rng.randint(0, 60)}", None, "a") for u in rng.sample(range(200), 15)]
    stored, _ = one_by_one(batch, history)
    kept = dedup.dedup(spark.createDataFrame(batch, BATCH), spark.createDataFrame(history, HISTORY), unique_urls=True)
    assert sorted((r.store_key, r.source_ord, r.pos) for r in kept.collect()) == stored


def test_new_then_url_then_content_duplicate(spark):
    rows = [("s", "a", "x", 0, "h"), ("s", "a", "x", 1, "h"), ("s", "b", "x", 2, "h")]
    df = spark.createDataFrame(rows, "store_key string, url string, source_ord string, pos int, content_hash string")
    flags = dedup.duplicate_flags(df, spark.createDataFrame([], HISTORY)).orderBy("pos").collect()
    assert [(r.url_duplicate, r.content_duplicate, r.is_duplicate) for r in flags] == [
        (False, False, False), (True, True, True), (False, True, True),
    ]


def test_hot_key_is_reduced_before_the_shuffle(spark):
    """Half of all rows share one hash: the plan pre-aggregates or limits per task."""
    df = spark.range(20000).select(
        F.lit("s").alias("store_key"), F.col("id").cast("string").alias("url"), F.lit("x").alias("source_ord"),
        F.col("id").alias("pos"), F.when(F.col("id") < 10000, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("content_hash"),
    )
    kept = dedup.stored_rows(df, spark.createDataFrame([], HISTORY), unique_urls=True)
    assert kept.count() == 10001
    plan = dedup.first_per_key(df, ["content_hash"], ["pos"])._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in below and "Partial" in below


def row(ts, url="u", h="h", source="a", key="s"):
    return (key, url, h, datetime(2024, 1, ts, tzinfo=timezone.utc), source)


def test_history_table(spark, tmp_path):
    path = str(tmp_path / "history")
    assert store.read_history(spark, path).count() == 0
    first = spark.createDataFrame([row(1), row(2, "v"), row(3, "w", key="t/x=1")], HISTORY)
    store.append_history(first, path, "b1")
    store.append_history(first, path, "b1")
    assert store.read_history(spark, path).count() == 3
    store.append_history(spark.createDataFrame([row(5, "u", "new")], HISTORY), path, "b2")
    assert store.read_history(spark, path).count() == 4
    assert store.read_history(spark, path, without_batch="b2").count() == 3
    latest = store.read_history(spark, path, "s", latest=True)
    assert sorted((r.url, r.content_hash) for r in latest.collect()) == [("u", "new"), ("v", "h")]
    plan = store.read_history(spark, path, "s")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(store_key" in plan
    store.compact_history(spark, path, f"{path}-new")
    assert store.read_history(spark, f"{path}-new").count() == 3
    store.history_reset(spark, path, "t/x=1")
    spark.catalog.clearCache()
    assert {r.store_key for r in store.read_history(spark, path).collect()} == {"s"}
    store.history_reset(spark, path)
    assert store.read_history(spark, path).count() == 0


def test_upsert_keeps_the_latest(spark):
    old = spark.createDataFrame([row(5, h="old"), row(1, "v")], HISTORY)
    new = spark.createDataFrame([row(5, h="same second"), row(3, "w")], HISTORY)
    got = dedup.history_upsert(old, new)
    assert sorted((r.url, r.content_hash) for r in got.collect()) == [("u", "same second"), ("v", "h"), ("w", "h")]
    assert got.columns == old.columns


def test_recent_history(spark):
    rows = [row(d, f"u{d}", source="a" if d % 2 else "b") for d in range(1, 29)]
    h = spark.createDataFrame(rows, HISTORY)
    assert [r.url for r in dedup.recent_history(h, "a", 3).collect()] == ["u27", "u25", "u23"]
    every = dedup.recent_history_all(h, 2).collect()
    assert sorted((r.source_name, r.rank, r.url) for r in every) == [
        ("a", 1, "u27"), ("a", 2, "u25"), ("b", 1, "u28"), ("b", 2, "u26"),
    ]


@pytest.mark.parametrize("seed", [1, 3])
def test_bitmap_drops_and_adds_no_row(spark, seed, monkeypatch):
    """Dedup and pre-filter with the bitmap equal those without, sent out or shuffled, however full it is."""
    rng = random.Random(seed)
    batch = random_batch(rng, 200, 90, 90, {"a": (True, True), "b": (True, seed > 2)})
    batch += [(None, None, "a", 900, None, True, True, "a"), ("s", None, "a", 901, "h1", True, True, "a")]
    day = lambda d: datetime(2024, 1, d + 1, tzinfo=timezone.utc)
    history = [(rng.choice("st"), f"u{rng.randint(0, 90)}", f"h{rng.randint(0, 90)}", day(d), "a") for d in range(25)]
    known = dedup.history_upsert(spark.createDataFrame(history, HISTORY), spark.createDataFrame([], HISTORY))
    df = spark.createDataFrame(batch, BATCH)
    work = df.withColumn("incremental", F.col("pos") % 5 != 0)
    key = lambda rows: sorted((repr(r.store_key), r.source_ord, r.pos) for r in rows.collect())
    want = key(dedup.dedup(df, known)), key(dedup.unknown_urls(work, known)), key(dedup.known_urls(work, known))
    for size, small in ((1 << 20, True), (40, False)):
        bits = membership.of_history(known, size)
        monkeypatch.setattr(membership, "is_small", lambda df, small=small: small)
        monkeypatch.setattr(membership, "checked_broadcast", lambda df, small=small: F.broadcast(df) if small else df)
        got = key(dedup.dedup(df, known, bits=bits)), key(dedup.unknown_urls(work, known, bits)), key(dedup.known_urls(work, known, bits))
        assert got == want


def test_few_rows_meet_the_history(spark):
    """Of 20,000 rows, 100 of them known, only those and a few that share a bit enter the join."""
    known = spark.range(50_000).select(
        F.lit("s").alias("store_key"), F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("h"), "id").alias("content_hash")
    )
    rows = spark.range(49_900, 69_900).select(F.lit("s").alias("store_key"), F.concat(F.lit("u"), "id").alias("url"))
    bits = membership.of_history(known)
    maybe = bits.marked(rows, "url", "maybe").filter("maybe")
    assert 100 <= maybe.count() < 100 + 19_900 / 10
    assert bits.filled() < 1 / 8
    assert membership.known(rows, known, "url", bits).count() == 100
    plan = membership.known(rows, known, "url", bits)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(store_key" not in plan


def test_bits_are_kept_beside_the_history(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "history")
    monkeypatch.setattr(membership, "LEAST_BITS", 256)
    make = lambda lo, hi: spark.createDataFrame([row(1, f"u{i}", f"h{i}") for i in range(lo, hi)], HISTORY)
    asked = spark.createDataFrame([("s", f"u{i}") for i in range(400)], "store_key string, url string")
    found = lambda: {r.url for r in store.read_membership(spark, path).marked(asked, "url", "m").filter("m").collect()}
    assert found() == set()
    store.append_bits(make(0, 10), path, "b1")
    store.append_history(make(0, 10), path, "b1")
    store.append_history(make(10, 20), path, "b2")  # stored without bits
    assert {f"u{i}" for i in range(20)} <= found()
    store.append_bits(make(20, 30), path, "b3")  # never stored: may look known
    store.append_bits(make(30, 200), path, "b3")
    store.append_history(make(30, 200), path, "b3")
    assert {f"u{i}" for i in [*range(20), *range(30, 200)]} <= found()
    last = store.read_membership(spark, path)
    assert last.size > 256 and last.filled() <= store.MOST_FILLED
    store.history_reset(spark, path)
    assert found() == set()


def test_running_sum_over_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xxxxy"), p, rng.randint(-3, 9)) for p in rng.sample(range(-50, 5000), 800)]
    df = spark.createDataFrame(rows, "k string, p long, v int")
    total, want = {}, {}
    for k, p, v in sorted(rows, key=lambda r: r[1]):
        n, s = total.get(k, (0, 0))
        total[k] = (n + 1, s + v)
        want[(k, p)] = total[k]
    summed = running.running_sum(running.numbered(df, ["k"], "p", width=37), ["k"], "p", F.col("v"), "s", width=53)
    assert {(r.k, r.p): (r.row_no, r.s) for r in summed.collect()} == want


def test_numbers_with_equal_positions_do_not_depend_on_the_layout(spark):
    rows = [("x" if i % 3 else "y", 0 if i % 2 else i, f"u{i * 7919 % 1000:03}") for i in range(600)]
    df = spark.createDataFrame(rows, "k string, pos int, url string")
    want, total = {}, {}
    for k, pos, url in sorted(rows):
        want[(k, pos, url)] = total[k] = total.get(k, 0) + 1
    for laid_out in (df.repartition(7), df.coalesce(1).orderBy(F.desc("url"))):
        got = running.numbered_in_order(laid_out, ["k"], ["pos", "url"])
        assert {(r.k, r.pos, r.url): r.row_no for r in got.collect()} == want


def test_island_texts_across_ranges(spark):
    lines = [("c", i, "open" if i % 4 == 1 else "more", f"t{i}") for i in range(12)]
    df = spark.createDataFrame(lines, "c string, p int, role string, t string")
    got = running.island_texts(df, ["c"], "p", "t", F.col("role") == "open", width=3).orderBy("item").collect()
    assert [(r.item, r.first_pos, r.n_lines, r.text) for r in got] == [
        (0, 1, 4, "t1 t2 t3 t4"), (1, 5, 4, "t5 t6 t7 t8"), (2, 9, 3, "t9 t10 t11"),
    ]


def test_validity_window_and_fetch_rules(spark):
    df = spark.createDataFrame([("T", "C" * 50), ("", "C" * 50), ("T", "short"), ("　", None)], "t string, c string")
    assert [r[0] for r in df.select(filters.validity("t", "c", True)).collect()] == [None, "missing_title", "content_too_short", "missing_title"]
    assert [r[0] for r in df.select(filters.validity("t", "c", False)).collect()] == [None, "missing_title", None, "missing_title"]
    codes = spark.createDataFrame([(500,), (401,), (403,), (429,), (404,), (200,)], "s int")
    assert [r[0] for r in codes.select(filters.fetch_failed("s")).collect()] == [True, True, True, True, False, False]
    day = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    times = spark.createDataFrame([(day(1),), (day(2),), (day(3),), (day(4),), (None,)], "ts timestamp")
    assert [r[0] for r in times.select(filters.within_window("ts", F.lit(day(2)), F.lit(day(3)))).collect()] == [False, True, True, False, True]


def test_attempts(spark):
    rows = [("r1", 1, 500, "a"), ("r1", 2, 200, "b"), ("r1", 3, 200, "c"), ("r2", 1, None, None), ("r2", 2, 403, "d"),
            ("r2", 3, 503, "e"), ("r2", 4, 200, "late"), ("r3", 1, 404, "page")]
    log = spark.createDataFrame(rows, "request_id string, attempt int, status int, html string")
    got = filters.resolve_attempts(log, retries=2).orderBy("request_id").collect()
    assert [(r.request_id, r.attempts, r.failed, r.html) for r in got] == [("r1", 2, False, "b"), ("r2", 3, True, None), ("r3", 1, False, "page")]


def test_reports(spark):
    rows = [("a", "u1", "success", None), ("a", "u2", "failed", "x"), ("a", "u3", "skipped", "window_filtered"), ("b", "u4", "skipped", "duplicate")]
    outcomes = spark.createDataFrame(rows, "source_name string, url string, status string, reason string")
    known = spark.createDataFrame([("b", "u9")], "source_name string, url string")
    summary = report.run_summary(report.with_prefilter_skips(outcomes, known))
    sources = spark.createDataFrame([("b",), ("a",), ("c",)], "source_name string")
    got = [tuple(r) for r in report.run_summary_total(summary, sources).collect()]
    assert got == [
        ("a", 1, 1, 1, 1, True, False), ("b", 0, 0, 2, 0, False, False), ("c", 0, 0, 0, 0, False, True), (None, 1, 1, 3, 1, True, True),
    ]
    rates = spark.createDataFrame([(0.5,), (999.0,), (1500.0,), (2.5e6,), (3e9,)], "n double")
    assert [r[0] for r in rates.select(report.rate_label(F.col("n"))).collect()] == ["0.5 url/s", "999.0 url/s", "1.5K url/s", "2.5M url/s", "3.0G url/s"]


def test_snapshots(spark):
    items = spark.createDataFrame(
        [("p", "k1", 1, 0, "<i>1</i>"), ("p", "k1", 2, 5, "<i>1b</i>"), ("p", "k2", 2, 1, "<i>2</i>")], "page string, key string, round int, pos int, html string"
    )
    kept = merge_snapshots(items, ["page", "key"], ["round", "pos"])
    pages = spark.createDataFrame([("p", "<b>"), ("q", "<q>")], "page string, html string")
    got = append_items(pages, kept, "page", ["round", "pos"]).orderBy("page").collect()
    assert [r.html for r in got] == ["<b>\n<i>1</i>\n<i>2</i>", "<q>"]


def test_readers(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.log").write_text("\n".join(f'{{"timestamp": "2024-01-0{i}", "level": "info", "event": "e{i}", "source": "{"ab"[i % 2]}"}}' for i in range(1, 7)))
    logs = read_logs(spark, str(tmp_path / "log"))
    assert [r.event for r in recent_log(logs, n=2).collect()] == ["e6", "e5"]
    assert [r.event for r in recent_log(logs, "b", 2).collect()] == ["e5", "e3"]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "x.html").write_text("<p>one\n<p>two")
    page = read_pages(spark, str(tmp_path / "raw"), "s", fmt="text").first()
    assert page.html == "<p>one\n<p>two" and page.url.endswith("x.html") and page.source_name == "s"
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "p.json").write_text('{"url": "u", "status": 200, "html": "h", "source_name": "s"}\n{"url": "v", "status": 200, "html": "h", "source_name": "t"}')
    assert [r.url for r in read_pages(spark, str(tmp_path / "json"), "t", fmt="json").collect()] == ["v"]


def chain_rows(n, step):
    """Rows of which each shares its URL or its content with the one before."""
    return [("s", f"u{(i + 1) // 2}", "a", i * step % 100_003, f"h{i // 2}", True, True, "a") for i in range(n)]


@pytest.mark.parametrize("step", [1, 100_002, 7919])
def test_a_chain_of_a_thousand_conflicts_takes_few_rounds(spark, monkeypatch, step):
    rounds = []
    real = chains.materialize
    monkeypatch.setattr(chains, "materialize", lambda df, name: rounds.append(name) or real(df, name))
    batch = chain_rows(1000, step)
    stored, _ = one_by_one(batch, [])
    kept = dedup.dedup(spark.createDataFrame(batch, BATCH), spark.createDataFrame([], HISTORY))
    assert sorted((r.store_key, r.source_ord, r.pos) for r in kept.collect()) == stored
    assert rounds.count("chain") <= 12


def test_chains_meet_fork_and_hold_nulls(spark):
    """A hot hash behind undecided URLs, rows that wait for two chains, rows without keys."""
    rng = random.Random(4)
    batch = chain_rows(60, 1)
    batch += [("s", f"u{i % 31}", "b", i, "hot" if i % 3 else f"h{i % 40}", True, i % 7 > 0, "b") for i in range(200)]
    batch += random_batch(rng, 100, 12, 12, {"a": (True, True), "b": (True, True)})
    batch = [(*r[:2], f"{r[2]}{i}", *r[3:]) for i, r in enumerate(batch)]
    nulls = [("s", None, "n", 1, "only", True, True, "n"), ("s", None, "n", 2, "only", True, True, "n"),
             ("s", "v", "n", 3, None, True, True, "n"), ("s", "w", "n", 4, None, True, True, "n"), (None, "v", "n", 5, "only", True, True, "n")]
    stored, _ = one_by_one(batch, [])
    kept = chains.decided(spark.createDataFrame(batch + nulls, BATCH), dedup.ORDER).collect()
    assert sorted((r.store_key, r.source_ord, r.pos) for r in kept if r.source_ord != "n") == stored
    assert sorted(r.pos for r in kept if r.source_ord == "n") == [1, 3, 4, 5]


def test_a_chain_in_order_is_followed_within_tasks(spark, monkeypatch):
    """Neighbours of a chain that lie in one task's range of rows need no round."""
    rounds = []
    real = chains.materialize
    monkeypatch.setattr(chains, "materialize", lambda df, name: rounds.append(name) or real(df, name))
    batch = chain_rows(3000, 1)
    stored, _ = one_by_one(batch, [])
    kept = chains.decided(spark.createDataFrame(batch, BATCH), dedup.ORDER)
    assert sorted((r.store_key, r.source_ord, r.pos) for r in kept.collect()) == stored
    assert rounds.count("chain") <= 5


@pytest.mark.parametrize("ends, seed", [(1, 1), (3, 2), (40, 3)])
def test_chains_cut_anywhere_give_the_same(spark, monkeypatch, ends, seed):
    """Ranges of any size: rows that wait for two chains lie before, in and behind them."""
    monkeypatch.setattr(chains, "MOST_ENDS", ends)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(seed)
        batch = chain_rows(80, 1) + random_batch(rng, 250, 25, 25, {"a": (True, True), "b": (True, True), "c": (True, False)})
        batch = [(*r[:2], "a", i, *r[4:]) for i, r in enumerate(batch)]
        stored, _ = one_by_one(batch, [])
        kept = chains.decided(spark.createDataFrame(batch, BATCH), dedup.ORDER).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.store_key, r.source_ord, r.pos) for r in kept) == stored
