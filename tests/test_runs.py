"""Settings, sinks, whole runs, and streams against batch."""

import json
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagesift.operators import records
from pagesift.plans import run
from pagesift.schemas import HISTORY, PAGES, SOURCES
from pagesift.sinks import files
from pagesift.sources.history import read_history
from pagesift.sources.page_store import PageStore
from pagesift.sources.rules import read_rules, rules_table, settings_problems
from pagesift.streaming import ingest

RUN_TS = datetime(2024, 5, 20, 12, tzinfo=timezone.utc)
BODY = "Long enough content to pass the strict length rule. "


def article(title, body, extra=""):
    return f"<html><body><h1>{title}</h1><article>{body}</article>{extra}</body></html>"


NEWS = {"source_name": "News", "site_type": "news", "target_url": "https://news.example/", "entry_pattern": "ul.list li a",
        "detail_pattern": {"title": ["h1", "h2"], "content": "article", "published_at": "time"}, "keywords_filter": ["content"]}
FEED = {"source_name": "Feed", "target_url": "https://feed.example/", "entry_pattern": "div.item", "use_entry_content": True,
        "detail_pattern": {"title": "h2", "content": "p", "published_at": "time"}, "output_format": "txt",
        "deduplication": {"store_path": "shared.db"}}
CARDS = {"source_name": "Cards", "target_url": "https://foresightnews.pro/", "entry_pattern": "div", "use_entry_content": True,
         "detail_pattern": {"title": "h1"}, "enable_incremental": False, "deduplication": {"store_path": "shared.db", "by_content": True}}
QUIET = {"source_name": "Quiet", "target_url": "https://quiet.example/", "entry_pattern": "a", "detail_pattern": {"title": "h1"}}

NEWS_ENTRY = '<ul class="list"><li><a href="/1">1</a><li><a href="/2">2</a><li><a href="/3">3</a><li><a href="/4">4</a><li><a href="/5">5</a><li><a href="/6">6</a><li><a href="/7">7</a><li><a href="/8">8</a></ul>'
FEED_ENTRY = (
    '<div class="item"><h2>F1</h2><p>short</p><a href="/f1">x</a><time>2024-05-20 10:00</time></div>'
    '<div class="item"><p>no title</p><a href="/f2">x</a></div>'
    '<div class="item"><p>no title, no page</p><a href="/f3">x</a></div>'
    '<div class="item"><h2>F4</h2><p>short</p><a href="/f4">x</a></div>'
    '<div class="item"><h2>F5</h2><p>old</p><a href="/f5">x</a><time>2024-05-01 10:00</time></div>'
)
CARDS_ENTRY = (
    '<div class="list_body"><a class="news_body_title" href="/c1">C1</a><div class="detail-body">short</div></div>'
    '<div class="list_body"><a class="news_body_title" href="/c2">C2</a><div class="detail-body">own</div></div>'
)
CAPTURED = [
    ("https://news.example/", 200, NEWS_ENTRY, "News"),
    ("https://news.example/1", 200, article("One", BODY, "<time>2024-05-20 09:00</time>"), "News"),
    ("https://news.example/2", 200, article("Two", BODY), "News"),  # same content as 1
    ("https://news.example/3", 200, article("Three", "short content"), "News"),
    ("https://news.example/4", 503, "", "News"),
    ("https://news.example/5", 200, article("Five", "Nothing of interest is written on this page, at some length."), "News"),
    ("https://news.example/6", 200, article("Six", BODY + "6", "<time>2024-05-01 10:00</time>"), "News"),  # too old
    ("https://news.example/8", 200, article("Eight", BODY + "8"), "News"),  # 7 was never captured, 8 is known
    ("https://news.example/unlinked", 200, article("U", BODY + "u"), "News"),
    ("https://feed.example/", 200, FEED_ENTRY, "Feed"),
    ("https://feed.example/f2", 200, "<h2>F2 page</h2><p>" + BODY + "f2</p>", "Feed"),
    ("https://foresightnews.pro/", 200, CARDS_ENTRY, "Cards"),
    ("https://quiet.example/", 500, "", "Quiet"),
]
KNOWN = [("data/history/default_history.db", "https://news.example/8", "x", RUN_TS, "News")]

WANT = {
    ("News", "https://news.example/1"): None,
    ("News", "https://news.example/2"): "duplicate",
    ("News", "https://news.example/3"): "content_too_short",
    ("News", "https://news.example/4"): "not_fetched",
    ("News", "https://news.example/5"): "keyword",
    ("News", "https://news.example/6"): "window_filtered",
    ("News", "https://news.example/7"): "not_fetched",
    ("News", "https://news.example/8"): "known_url",
    ("Feed", "https://feed.example/f1"): "duplicate",  # same content as a card; Cards comes first
    ("Feed", "https://feed.example/f2"): None,  # second chance as a detail page
    ("Feed", "https://feed.example/f3"): "missing_title",
    ("Feed", "https://feed.example/f4"): "duplicate",
    ("Feed", "https://feed.example/f5"): "window_filtered",
    ("Cards", "https://foresightnews.pro/c1"): None,
    ("Cards", "https://foresightnews.pro/c2"): None,
    ("Quiet", "https://quiet.example/"): "not_fetched",  # no links: the target itself
}


@pytest.fixture(scope="module")
def settings(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sources")
    for s in (NEWS, FEED, CARDS, QUIET):
        (folder / f"{s['source_name']}.json").write_text(json.dumps(s))
    return read_rules(spark, str(folder))


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(CAPTURED, "url string, status int, html string, source_name string")


@pytest.fixture(scope="module")
def result(spark, settings, pages):
    sources, rules = settings
    window = (datetime(2024, 5, 19, tzinfo=timezone.utc), datetime(2024, 5, 21, tzinfo=timezone.utc))
    return run.run_batch(pages, sources, rules, spark.createDataFrame(KNOWN, HISTORY), run.RunOptions(RUN_TS, window))


def test_run_outcomes(result):
    got = {(r.source_name, r.url): r.reason for r in result.outcomes.collect()}
    # Cards is not incremental: its records are exported, and stored before Feed's.
    assert got == WANT
    assert result.outcomes.count() == len(WANT)


def test_run_summary_and_history(result):
    rows = {r.source_name: tuple(r)[1:] for r in result.summary.collect()}
    assert rows["News"] == (1, 3, 4, 1, True, False)
    assert rows["Feed"] == (1, 1, 3, 1, True, False)
    assert rows["Cards"] == (2, 0, 0, 0, False, False)
    assert rows["Quiet"] == (0, 1, 0, 0, True, False)
    assert rows[None] == (4, 5, 7, 2, True, False)
    stored = {r.url.rsplit("/", 1)[1] for r in result.history.collect()}
    assert stored == {"1", "f2", "c1", "c2"}


def test_run_records(result):
    one = result.records.filter("url = 'https://news.example/1'").first()
    assert one.fields == {"title": "One", "content": BODY.strip(), "published_at": "2024-05-20 09:00", "summary": BODY.strip()}
    assert one.raw_html.startswith("<html>") and one.fetched_at.astimezone(timezone.utc) == RUN_TS
    core = records.core_columns(result.records)
    assert {"title", "content", "published_at", "summary", "original_url", "extra"} <= set(core.columns)


def test_second_run_adds_nothing(spark, result, settings, pages):
    sources, rules = settings
    history = result.history.unionByName(spark.createDataFrame(KNOWN, HISTORY))
    again = run.run_batch(pages, sources.filter("incremental"), rules, history, run.RunOptions(RUN_TS))
    left = {(r.url, r.reason) for r in again.outcomes.filter("status = 'success'").collect()}
    # Without a window the old ones pass now; what was stored is not exported again.
    assert {u.rsplit("/", 1)[1] for u, _ in left} == {"6", "f5"}


def test_first_good_attempt_is_used(spark, settings):
    sources, rules = settings
    captures = [
        ("https://news.example/", 200, NEWS_ENTRY, "News", 1),
        ("https://news.example/1", 500, "", "News", 1),
        ("https://news.example/1", 200, article("One", BODY), "News", 2),
        ("https://news.example/1", 200, article("Late", BODY), "News", 3),
        ("https://news.example/2", 200, article("Too late", BODY + "2"), "News", 4),
    ]
    pages = spark.createDataFrame(captures, "url string, status int, html string, source_name string, attempt int")
    got = run.run_batch(
        pages, sources.filter("source_name = 'News'"), rules, spark.createDataFrame([], HISTORY), run.RunOptions(RUN_TS, retries=2)
    )
    assert [r.fields["title"] for r in got.records.collect()] == ["One"]


def test_settings(spark, settings, tmp_path):
    sources, rules = settings
    rows = {r.source_name: r for r in sources.collect()}
    assert rows["Cards"].incremental is False and rows["Cards"].store_key == "shared.db" and rows["News"].by_url is True
    assert [r.selector for r in rules.filter("source_name = 'News' AND field = 'title'").orderBy("rank").collect()] == ["h1", "h2"]
    odd = {"source_name": "Odd", "target_url": "u", "entry_pattern": "a", "detail_pattern": {"x": ["a::attr(href)", "[data-k]", "a, b"]},
           "deduplication": {"by_url": True, "use_entry_content": True}, "colour": 1}
    (tmp_path / "odd.json").write_text(json.dumps(odd))
    found = {(r.problem, r.what) for r in settings_problems(spark, str(tmp_path)).collect()}
    assert found == {
        ("unknown key", "colour"), ("unknown dedup key", "use_entry_content"),
        ("mode acts as text", "a::attr(href)"), ("selector not supported", "a, b"),
    }
    _, odd_rules = read_rules(spark, str(tmp_path))
    assert [r.selector for r in odd_rules.orderBy("rank").collect()] == ["a::attr(href)", "[data-k]", "a, b"]


def test_yaml_settings(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("source_name: A\ntarget_url: u\nentry_pattern: a\ndetail_pattern:\n  title:\n  - h1\n  - h2\n  content: p\n")
    sources, rules = read_rules(spark, str(tmp_path), "yaml")
    assert sources.first().source_name == "A"
    assert [(r.field, r.rank, r.selector) for r in rules.orderBy("field_pos", "rank").collect()] == [("title", 0, "h1"), ("title", 1, "h2"), ("content", 0, "p")]


def test_enrich(spark):
    detail = json.dumps({"initData": {"detail": {"title": "J", "description": "from json", "newsUrl": "https://j/x"}}})
    rows = [
        ({"title": "Moss", "content": "grows on the north side " * 4}, ""),
        ({"title": "T"}, f"<p>{detail}</p>"),
        ({"title": None, "content": None}, f"<p>{detail}</p>"),
    ]
    df = spark.createDataFrame(rows, "fields map<string,string>, raw_html string")
    got = [r.fields for r in records.enrich(df, F.lit(RUN_TS)).collect()]
    assert got[0]["summary"] == ("grows on the north side " * 4).strip()
    assert got[1] == {"title": "T", "content": "from json", "original_url": "https://j/x", "summary": "from json"}
    assert got[2] == {"title": None, "content": None, "original_url": "https://j/x"}
    filled = [r.fields for r in records.enrich(df, F.lit(RUN_TS), fill_nulls=True).collect()]
    assert filled[2] == {"title": "J", "content": "from json", "original_url": "https://j/x", "summary": "from json"}
    assert df.select(files.fetched_text(F.lit(RUN_TS))).first()[0] == "2024-05-20T12:00:00Z"


def sink_rows(spark):
    rows = [
        ("https://x/1", "My Source!", 5, "news", "", RUN_TS, {"title": "第一", "content": " body, \"q\"\nline", "published_at": None}, "json"),
        ("https://x/2", "My Source!", 9, "news", "", RUN_TS, {"title": None, "content": "second", "published_at": "2024-05-20"}, "json"),
        ("https://y/1", "Other", 1, "social", "<p>", RUN_TS, {"title": "T", "own": "kept"}, "txt"),
    ]
    return spark.createDataFrame(
        rows, "url string, source_name string, pos int, site_type string, raw_html string, fetched_at timestamp, fields map<string,string>, output_format string"
    )


def part_text(folder):
    return "".join(p.read_text() for p in sorted(Path(folder).glob("part-*")))


def test_sinks(spark, tmp_path):
    df = sink_rows(spark)
    home = str(tmp_path)
    files.write_json(df, f"{home}/json", "20240520-120000")
    lines = part_text(f"{home}/json/source=My_Source_/run=20240520-120000").splitlines()
    got = sorted((json.loads(x) for x in lines), key=lambda r: r["url"])
    assert got[0]["title"] == "第一" and "第一" in "".join(lines) and got[0]["published_at"] is None and got[1]["title"] is None
    assert json.loads(part_text(f"{home}/json/source=Other/run=20240520-120000"))["own"] == "kept"

    files.write_csv(df.filter("source_name != 'Other'"), f"{home}/csv", "r1", ["title", "content"])
    csv_path = f"{home}/csv/source=My_Source_/run=r1"
    assert part_text(csv_path).splitlines()[0] == "content,fetched_at,raw_html,site_type,source_name,title,url"
    back = spark.read.csv(csv_path, header=True, multiLine=True, escape='"').orderBy("url").collect()
    assert back[0].content.strip() == 'body, "q"\nline' and back[1].title is None

    files.write_text(df, f"{home}/txt", "r1")
    assert part_text(f"{home}/txt/source=My_Source_/run=r1") == (
        "1. 第一｜My Source!\n抓取时间：2024-05-20T12:00:00Z\nbody, \"q\"\nline\n链接：https://x/1\n\n"
        "2. (未提供标题)｜My Source!\n发布时间：2024-05-20\n抓取时间：2024-05-20T12:00:00Z\nsecond\n链接：https://x/2\n\n"
    )

    files.write_payload(df, f"{home}/rows", "r1")
    rows = spark.read.parquet(f"{home}/rows").filter("source = 'My_Source_'").orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2] and json.loads(rows[1].payload)["content"] == "second"

    files.write_documents(df, f"{home}/docs", "r1")
    assert {r.collection for r in spark.read.parquet(f"{home}/docs").collect()} == {"My Source!", "Other"}
    assert df.select(files.run_tag("fetched_at")).first()[0] == "20240520-120000"


def test_each_source_in_its_format(spark, tmp_path):
    files.write_records(sink_rows(spark), str(tmp_path), "r1", ["title"])
    assert len(part_text(tmp_path / "json/source=My_Source_/run=r1").splitlines()) == 2
    assert part_text(tmp_path / "txt/source=Other/run=r1").startswith("1. T｜Other\n")


# --- streams -------------------------------------------------------------------


def one_source(spark):
    return spark.createDataFrame(
        [("s", "news", "https://s/", "a", [], True, False, True, True, "s", "json")], SOURCES
    )


def page_files(spark, folder, names, start=0):
    rows = [(f"https://s/{n}", 200, article(n, BODY + n.strip("'")), None, None, "s") for n in names]
    df = spark.createDataFrame(rows, PAGES).coalesce(1)
    df.write.mode("append").json(str(folder), ignoreNullFields=True)


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    source, home = tmp_path / "in", str(tmp_path / "home")
    rules = rules_table(spark, {"s": {"title": "h1", "content": "article"}})
    options = run.RunOptions(RUN_TS, follow_links=False)
    source.mkdir()
    page_files(spark, source, ["a", "b", "b'"])
    stream = ingest.page_stream(spark, str(source), PAGES, fmt="json")
    ingest.run_stream(stream, one_source(spark), rules, home, options)
    page_files(spark, source, ["c", "a'", "d"])
    stream = ingest.page_stream(spark, str(source), PAGES, fmt="json")
    ingest.run_stream(stream, one_source(spark), rules, home, options)

    def stored():
        return sorted(r.url for r in spark.read.parquet(f"{home}/records").collect())

    assert stored() == [f"https://s/{n}" for n in "abcd"]
    batch = run.run_batch(
        spark.read.schema(PAGES).json(str(source)), one_source(spark), rules, spark.createDataFrame([], HISTORY), options
    )
    assert batch.records.count() == 4
    outcome = {(r.url, r.reason) for r in spark.read.parquet(f"{home}/outcomes").collect()}
    assert ("https://s/a'", "duplicate") in outcome and ("https://s/b'", "duplicate") in outcome

    # The second batch once more, as after a crash before its commit.
    second = spark.createDataFrame(
        [(f"https://s/{n}", 200, article(n, BODY + n.strip("'")), None, None, "s") for n in ("c", "a'", "d")], PAGES
    )
    ingest.run_micro_batch(second, 1, one_source(spark), rules, home, options)
    assert stored() == [f"https://s/{n}" for n in "abcd"]
    assert read_history(spark, f"{home}/history").count() == 4

    # Once more with pages that give nothing: what the earlier try stored is gone.
    before = work_folders(spark)
    ingest.run_micro_batch(second.filter("url = ''"), 1, one_source(spark), rules, home, options)
    spark.catalog.clearCache()
    assert stored() == ["https://s/a", "https://s/b"]
    assert read_history(spark, f"{home}/history").count() == 2
    assert work_folders(spark) == before


def work_folders(spark):
    from pagesift import session

    folder = Path(session.work_folder(spark, "x").removeprefix("file:")).parent
    return {p.name for p in folder.glob("*/*")} | {p.name for p in folder.glob("*")}


def test_dedup_stream_repeats(spark, tmp_path):
    home = str(tmp_path)
    columns = "store_key string, url string, source_ord string, pos int, content_hash string, source_name string"
    first = spark.createDataFrame([("s", "u1", "a", 0, "h1", "a"), ("s", "u2", "a", 1, "h1", "a")], columns)
    second = spark.createDataFrame([("s", "u1", "a", 0, "h9", "a"), ("s", "u3", "a", 1, "h3", "a")], columns)
    for batch_id, batch in ((0, first), (1, second), (1, second)):
        ingest.dedup_micro_batch(batch, batch_id, home, RUN_TS)
    assert sorted(r.url for r in spark.read.parquet(f"{home}/records").collect()) == ["u1", "u3"]


def test_stream_reads_a_table_of_part_files(spark, tmp_path):
    from pagesift.streaming import ingest

    spark.range(40).selectExpr("id AS event_id").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    spark.range(5).selectExpr("id AS event_id").write.parquet(str(tmp_path / "other.parquet"))
    stream = ingest.page_stream(spark, str(tmp_path), "event_id BIGINT", table="events")
    assert ingest.collect_stream(stream, "append", "parts").count() == 40


def test_work_folder_is_cleared(spark):
    from pathlib import Path

    from pagesift import session

    kept = session.materialize(spark.range(3), "step")
    assert kept.count() == 3
    folder = Path(session.work_folder(spark, "x").removeprefix("file:")).parent
    assert folder.exists()
    session.clear_work(spark)
    assert not folder.exists()


def test_long_durations_and_dashes(spark):
    import textwrap

    from pyspark.sql import functions as F

    from pagesift.functions import text, times

    rows = spark.createDataFrame([("1000000000000000h",), ("99999999999999999999",), ("0d",), ("2d",)], "s string")
    assert [r[0] for r in rows.select(times.duration_spec("s")).collect()] == [3_600_000_000_000_000_000, None, None, 172800]
    for n in (3, 9, 10, 40):
        line = "word " * 45 + "left" + "-" * n + "right " * 9
        got = spark.range(1).select(text.summary(F.lit(line))).first()[0]
        assert got == textwrap.shorten(line, 240, placeholder="…")


def test_page_store_gives_the_same_run(spark, settings, pages, tmp_path):
    """Captures of a store, some of them stored again later, give the run of the plain pages."""
    sources, rules = settings
    store = PageStore(spark, str(tmp_path / "store"), buckets=4)
    store.append(pages.withColumn("fetched_at", F.lit(RUN_TS)), "b1")
    later = pages.withColumn("html", F.concat("html", F.lit("<p>later</p>")))
    store.append(later.withColumn("fetched_at", F.lit(RUN_TS) + F.expr("INTERVAL 1 DAY")), "b2")
    store.append(pages.withColumn("fetched_at", F.lit(RUN_TS)), "b3")
    opened = PageStore(spark, str(tmp_path / "store"), buckets=9)
    assert opened.buckets == 4
    window = (datetime(2024, 5, 19, tzinfo=timezone.utc), datetime(2024, 5, 21, tzinfo=timezone.utc))
    again = run.run_batch(opened.read(), sources, rules, spark.createDataFrame(KNOWN, HISTORY), run.RunOptions(RUN_TS, window))
    assert {(r.source_name, r.url): r.reason for r in again.outcomes.collect()} == WANT
    assert again.outcomes.count() == len(WANT)
    kept = {r.url: (r.fields["content"], r.raw_html) for r in again.records.collect()}
    assert set(kept) == {url for (_, url), reason in WANT.items() if reason is None}
    assert kept["https://news.example/1"][0] == BODY.strip()
    assert not any("later" in html for _, html in kept.values())


def test_page_store_replaces_a_batch_and_takes_odd_rows(spark, tmp_path):
    store = PageStore(spark, str(tmp_path / "odd it's"), buckets=3)
    schema = "url string, requested_url string, status int, html string, source_name string, attempt long"
    rows = [("u", "asked", 200, None, "s", None), (None, None, None, "x", None, 2), ("u", "asked", 200, "a", "s", 1)]
    for _ in range(2):
        store.append(spark.createDataFrame(rows, schema), "it's 1")
    store.append(spark.createDataFrame([], schema), "none")
    got = [(r.url, r.requested_url, r.html, r.attempt) for r in store.read().collect()]
    assert sorted(got, key=repr) == sorted([("u", "asked", None, 1), (None, None, "x", 2), ("u", "asked", "a", 1)], key=repr)
    assert store.read(batch="none").count() == 0


def test_stored_text_is_not_shuffled(spark, tmp_path, monkeypatch):
    """The chosen list goes to the buckets; choosing reads no text, joining reads it once."""
    monkeypatch.setattr(run, "checked_broadcast", lambda df: df)
    store = PageStore(spark, str(tmp_path / "store"), buckets=6)
    rows = [(f"https://a.example/{i % 40}", 200, f"<p>{i % 90}</p>", "s") for i in range(200)]
    store.append(spark.createDataFrame(rows, "url string, status int, html string, source_name string"), "b1")
    visit = store.read().select("source_name", F.lit(0).alias("pos"), "url").distinct()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = run.fetched_pages(visit, store.read(), run.RunOptions(RUN_TS))
        plan = found._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        exchanged = [line for line in lines if "Exchange" in line]
        assert len(exchanged) == 1 and "capture_hash" in exchanged[0]
        assert sum("FileScan" in line and "html" in line for line in lines) == 1 and "Bucketed: true" in plan
        below = lines[lines.index(exchanged[0]) :]
        assert not any("html" in line for line in below)
        chosen = run.chosen_captures(visit, store.read(), None)._jdf.queryExecution().executedPlan().toString()
        assert "html" not in chosen
        first = {(r.url, r.html) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(first) == 40 == found.count()
