"""Column functions against the standard library, on random input."""

import random
import textwrap
from datetime import date, datetime, timedelta, timezone
from urllib.parse import urljoin
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from pagesift.functions import text, times, urls
from pagesift.functions.embedded import json_text, read_embedded_json

UTC = timezone.utc


def differing(df, got):
    return df.filter(~F.col("want").eqNullSafe(got)).count()


def test_url_join(spark):
    rng = random.Random(1)
    bases = [
        "http://a/b/c/d;p?q", "https://example.com", "https://example.com/", "http://ex.com/x/y/",
        "https://ex.com/a//b/c", "http://h/a?x=1#f", "file:///x/y", "mailto:a@b", "http://h/..//a/./b", "",
    ]
    bits = ["..", ".", "", "a", "b;c", "...", "/", "?q=1", "#f", "a:b", "https://e.x/z", "g?y", "HTTP://UP/Per", "é"]
    rows = []
    while len(rows) < 3000:
        href = rng.choice(["/", "", "//h2/"]) + "/".join(rng.choice(bits) for _ in range(rng.randint(0, 5)))
        base = rng.choice(bases)
        try:
            rows.append((base, href, urljoin(base, href)))
        except ValueError:
            continue
    df = spark.createDataFrame(rows, "base string, href string, want string")
    assert differing(df, urls.url_join("base", "href")) == 0


def test_summary_and_strip(spark):
    rng = random.Random(2)
    words = ["foo", "bar-baz", "a", "—dash", "x--y", "漢字漢字", "it's", "re-do-it", "1-2", "end.", "\n", "\t　", "long" * 20]
    rows = []
    for _ in range(2000):
        line = "".join(rng.choice(words) + rng.choice([" ", "  ", "", "-"]) for _ in range(rng.randint(0, 120)))
        rows.append((line, textwrap.shorten(line.strip(), width=240, placeholder="…"), line.strip()))
    df = spark.createDataFrame(rows, "line string, want string, stripped string")
    assert differing(df, text.summary("line")) == 0
    assert df.filter(F.col("stripped") != text.u_strip("line")).count() == 0


def test_summary_cut_by_chars(spark):
    row = spark.createDataFrame([("字" * 300,)], "t string").select(
        text.summary("t").alias("words"), text.summary("t", cut="chars").alias("chars")
    ).first()
    assert row.words == "…" and row.chars == "字" * 239 + "…"


def test_coerce_ts(spark):
    """Texts written from known instants: clock in Shanghai unless the text has a zone."""
    rng = random.Random(3)
    china = ZoneInfo("Asia/Shanghai")
    rows = []
    for _ in range(400):
        at = datetime(2024, rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59), tzinfo=china)
        day, minute, utc = at.replace(hour=0, minute=0, second=0), at.replace(second=0), at.astimezone(UTC)
        dash, slash = f"{at.year}-{at:%m-%d}", f"{at.year}/{at.month}/{at.day}"
        rows += [
            (dash, day), (slash, day), (f"{dash} {at:%H:%M}", minute), (f" {slash} {at.hour}:{at.minute} ", minute),
            (f"{dash} {at:%H:%M:%S}", at), (f"{slash} {at:%H:%M:%S}", at), (f"{at:%m-%d %H:%M}", minute),
            (f"{at.month}/{at.day} {at:%H:%M}", minute), (utc.strftime("%Y-%m-%dT%H:%M:%SZ"), at), (f"{dash}T{at:%H:%M}+08:00", minute),
            (f"{at:%Y%m%d}", day), (f"{at:%Y%m%dT%H%M%S}", at), (f"{at:%G-W%V-%u}", day), (f"{dash}x{at:%H:%M}", minute),
            ((utc - timedelta(hours=3, minutes=30)).strftime("%Y-%m-%d %H:%M:%S-0330"), at),
        ]
    rows += [(bad, None) for bad in ("", "soon", "2024-13-01", "2024-02-30 10:00", "24:00", "2024-01-01 25:00", "02-30 10:00", "2024", "2024-05", "2024-W54-1", "3 minutes ago")]
    epoch = datetime(1970, 1, 1, tzinfo=UTC)
    rows = [(v, None if at is None else int((at - epoch).total_seconds()) * 1_000_000) for v, at in rows]
    df = spark.createDataFrame(rows, "v string, want bigint")
    assert differing(df, F.unix_micros(times.coerce_ts("v", "Asia/Shanghai", 2024))) == 0


def test_epochs(spark):
    df = spark.createDataFrame([(1716206400000.0,), (1716206400.5,), (float("nan"),), (1e30,)], "n double")
    got = [r[0] for r in df.select(F.unix_micros(times.epoch_ts("n"))).collect()]
    assert got == [1716206400000000, 1716206400500000, None, None]
    iso = df.limit(1).select(times.epoch_ms_iso("n")).first()[0]
    assert iso == "2024-05-20T12:00:00+00:00"


def test_record_ts_takes_the_first_usable_field(spark):
    df = spark.createDataFrame(
        [("12:30", "2024-05-20 10:00", 5), (None, None, 1716206400), ("soon", "later", None)],
        "published_at string, time string, fetched_at bigint",
    )
    got = [r[0] for r in df.select(F.unix_seconds(times.record_ts(df, "UTC", 2024))).collect()]
    assert got == [1716199200, 1716206400, None]


def test_durations(spark):
    rows = [("1d6h", 108000), ("5", 18000), ("90m", 5400), ("0", None), ("1x", None), ("", None), ("1h0m", None), (" 2H ", 7200)]
    df = spark.createDataFrame(rows, "spec string, want bigint")
    assert differing(df, times.duration_spec("spec")) == 0
    for spec, want in rows:
        if want is None:
            with pytest.raises(ValueError):
                times.parse_duration(spec)
        else:
            assert times.parse_duration(spec).total_seconds() == want
    assert times.parse_duration(None) == timedelta(hours=24)


def test_window_bounds():
    now = datetime(2024, 5, 20, 12, tzinfo=UTC)
    assert times.window_bounds(until="2024-05-20T12:00Z") == (now - timedelta(days=1), now)
    assert times.window_bounds(since="2024-05-20T10:00", now=now) == (now - timedelta(hours=2), now)
    assert times.window_bounds(since="2024-05-20T18:00+08:00", duration="2h") == (now - timedelta(hours=2), now)
    with pytest.raises(ValueError):
        times.window_bounds(since="2024-05-20", until="2024-05-20")
    with pytest.raises(ValueError):
        times.window_bounds(duration="2h")


def test_daily_window():
    now = datetime(2024, 5, 20, 1, tzinfo=UTC)  # 09:00 in Shanghai
    start, end = times.daily_window("08:30", "2h", now, "Asia/Shanghai")
    assert start == datetime(2024, 5, 20, 0, 30, tzinfo=UTC) and end - start == timedelta(hours=2)
    start, _ = times.daily_window("09:30:30", None, now, "Asia/Shanghai")
    assert start == datetime(2024, 5, 19, 1, 30, 30, tzinfo=UTC)
    with pytest.raises(ValueError):
        times.daily_window("half past", None, now)


def test_date_bounds():
    assert times.date_bounds(relative="last_30_days", reference=date(2024, 1, 31)) == (date(2024, 1, 1), date(2024, 1, 31))
    with pytest.raises(ValueError):
        times.date_bounds(date(2024, 1, 2), date(2024, 1, 1))
    with pytest.raises(ValueError):
        times.date_bounds(date(2024, 1, 1), date(2024, 1, 2), "last_7_days")
    with pytest.raises(ValueError):
        times.date_bounds(relative="last_year")


def test_slugs_and_titles(spark):
    names = spark.createDataFrame([("Harbour Post",), ("low-Tide",), ("R&D/ Notes",), ("新闻 源",)], "n string")
    got = names.select(text.slug_key("n"), text.slug_file("n")).collect()
    assert [tuple(r) for r in got] == [
        ("harbour-post", "Harbour_Post"), ("low-tide", "low-Tide"), ("r-d--notes", "R_D_Notes"), ("新闻-源", "_"),
    ]
    blank = spark.createDataFrame([("  ",), ("x" * 101,)], "n string")
    assert [r[0] for r in blank.select(text.slug_file("n")).collect()][0] == "source"
    assert blank.select(text.title_cut("n")).collect()[1][0] == "x" * 100 + "..."


def test_hosts_and_links(spark):
    df = spark.createDataFrame([("https://WWW.Ex.com:80/a",), ("nothing",), ("http://[bad",), (None,)], "u string")
    assert [r[0] for r in df.select(urls.url_host("u")).collect()] == ["www.ex.com", "", "", ""]
    links = spark.createDataFrame([("/a",), (" javascript:x",), ("#top",), (" 　",), (None,)], "u string")
    assert [r[0] for r in links.select(urls.usable_link("u")).collect()] == [True, False, False, False, False]


def test_embedded_json(spark):
    pages = spark.createDataFrame(
        [('x {} var a={"initData":{"k": {"z": 1}}, "t": "}"} trailing }',), ("no marker {}",), ('"initData": {broken',)], "h string"
    )
    after = read_embedded_json("h", 'initData":', "k STRUCT<z: INT>")
    around = read_embedded_json("h", '"initData"', "t STRING", where="around")
    got = pages.select(after["k"]["z"], around["t"]).collect()
    assert [tuple(r) for r in got] == [(1, "}"), (None, None), (None, None)]
    assert pages.limit(1).select(json_text(F.lit('{"a": [1, 2]}'), "a ARRAY<INT>")["a"][1]).first()[0] == 2


def test_zoneless_bounds_reach_the_scan(spark, tmp_path):
    from pagesift.operators.filters import within_window

    path = str(tmp_path / "t")
    rows = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0,0,0,0,id) AS ts FROM range(48)")
    rows.write.parquet(path)
    start, end = times.window_bounds(since="2024-01-01T06:00", duration="2h")
    kept = spark.read.parquet(path).filter(within_window("ts", times.ntz_literal(start), times.ntz_literal(end)))
    assert [r.ts.hour for r in kept.orderBy("ts").collect()] == [6, 7, 8]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-01T06:00)" in plan
    # Read in a zone of their own, they are instants whatever the session's zone.
    first = spark.read.parquet(path).agg(F.min(F.unix_seconds(times.ntz_instant("ts", "Asia/Shanghai")))).first()[0]
    assert first == 1704067200 - 8 * 3600
