"""Many keywords, many log files, many output formats."""

import json
import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from pagesift.operators import filters, keywords
from pagesift.sinks import commit, files
from pagesift.sources import logs


@pytest.mark.parametrize("max_bytes", [1 << 20, 40_000])
def test_ten_thousand_keywords_equal_the_plain_rule(spark, max_bytes):
    rng = random.Random(6)
    letters = "abcdeÄßİ "
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    table = [(f"s{i % 7}", word(rng.randint(4, 9))) for i in range(10_000)]
    table += [("s7", None), ("s8", ""), ("s8", "zzz"), (None, "a"), ("s9", "aÄ"), ("s9", "AÄ")]
    rows = [(i, f"s{i % 12}", word(rng.randint(0, 60))) for i in range(400)] + [(400, None, "ab"), (401, "s1", None)]
    df = spark.createDataFrame(rows, "id int, source_name string, text string")
    words = spark.createDataFrame(table, "source_name string, keyword string")
    match = keywords.keyword_matcher(words, max_bytes)
    got = {r.id: r.hit for r in df.select("id", match(filters.haystack("text"), F.col("source_name")).alias("hit")).collect()}
    lists = words.filter("keyword IS NOT NULL").groupBy("source_name").agg(F.collect_set("keyword").alias("keywords"))
    plain = df.join(lists, "source_name", "left").select(
        "id", filters.keyword_match(filters.haystack("text"), F.coalesce("keywords", F.array().cast("array<string>"))).alias("hit")
    )
    assert got == {r.id: r.hit for r in plain.collect()}
    assert len(set(got.values())) == 2
    none = keywords.keyword_matcher(words.limit(0))
    assert df.filter(none(F.col("text"), F.col("source_name"))).count() == len(rows)


def test_newest_lines_read_few_files(spark, tmp_path, monkeypatch):
    for day in range(1, 21):
        name = tmp_path / f"app.log.{day}"
        rows = [{"timestamp": f"2024-03-{day:02d}T10:00:{i:02d}Z", "level": "info", "event": f"{day}-{i}", "source": "ab"[i % 2]} for i in range(30)]
        name.write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
        end = datetime(2024, 3, day, 23, tzinfo=timezone.utc).timestamp()
        os.utime(name, (end, end))
    read = []
    real = logs.read_logs
    monkeypatch.setattr(logs, "read_logs", lambda spark, path, schema=logs.LOG: read.append(path) or real(spark, path, schema))
    got = [r.event for r in logs.newest_lines(spark, str(tmp_path), 20).collect()]
    assert got == [f"20-{i}" for i in range(29, 9, -1)] and len(read[-1]) == 1
    got = [r.event for r in logs.newest_lines(spark, str(tmp_path), 50, "a").collect()]
    everything = real(spark, str(tmp_path))
    assert got == [r.event for r in logs.recent_log(everything, "a", 50).collect()] and len(read[-1]) == 4
    # Copied later, a file may hold any time: all are read.
    for name in tmp_path.iterdir():
        os.utime(name)
    assert [r.event for r in logs.newest_lines(spark, str(tmp_path), 5).collect()] == [f"20-{i}" for i in range(29, 24, -1)]
    assert len(read[-1]) >= 20
    assert logs.newest_lines(spark, str(tmp_path / "none"), 5).count() == 0


def outputs(spark, path, broken=False):
    def write(name, n):
        def run(to):
            rows = spark.range(n).select(F.lit("s").alias("source"), F.lit("r1").alias("run"), F.concat(F.lit(name), "id").alias("value"))
            if broken and name == "b":
                rows = rows.withColumn("value", F.raise_error(F.lit("no")).cast("string"))
            files._write(rows, "text", to, {})

        return run

    return {"a": write("a", 3), "b": write("b", 2), "c": write("c", 1)}


def seen(spark, path):
    spark.catalog.clearCache()
    found = {}
    for name in "abc":
        if os.path.isdir(f"{path}/{name}/source=s"):
            found[name] = sorted(r.value for r in spark.read.text(f"{path}/{name}").collect())
    return found


WHOLE = {"a": ["a0", "a1", "a2"], "b": ["b0", "b1"], "c": ["c0"]}


def test_a_failing_format_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="no"):
        commit.Commit(spark, path, 2).write(outputs(spark, path, broken=True))
    assert seen(spark, path) == {} and not os.listdir(f"{path}/{commit.STAGED}")
    commit.Commit(spark, path, 2).write(outputs(spark, path))
    assert seen(spark, path) == WHOLE
    with pytest.raises(Exception, match="no"):
        commit.Commit(spark, path, 2).write(outputs(spark, path, broken=True))
    assert seen(spark, path) == WHOLE
    commit.Commit(spark, path, 2).write(outputs(spark, path))
    assert seen(spark, path) == WHOLE


def test_a_commit_that_was_cut_off_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    real = commit._move

    def cut(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(commit, "_move", cut)
    with pytest.raises(KeyboardInterrupt):
        commit.Commit(spark, path, 2).write(outputs(spark, path))
    monkeypatch.setattr(commit, "_move", real)
    assert seen(spark, path) == {}
    commit.finish_commits(spark, path)
    assert seen(spark, path) == WHOLE and not os.listdir(f"{path}/{commit.JOURNALS}")
    commit.finish_commits(spark, path)


def test_records_of_a_failing_format_are_not_seen(spark, tmp_path, monkeypatch):
    schema = "source_name string, url string, pos int, site_type string, raw_html string, fetched_at timestamp, fields map<string,string>, output_format string"
    rows = [(f"S{i}", f"u{i}", i, "news", "<p>", None, {"title": f"t{i}"}, fmt) for i, fmt in enumerate(files.FORMATS)]
    records = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "out")

    def fail(*args):
        raise ValueError("no")

    with monkeypatch.context() as patch:
        patch.setattr(files, "write_payload", fail)
        with pytest.raises(ValueError, match="no"):
            files.write_records(records, path, "r1", ["title"])
    assert not any(os.path.isdir(f"{path}/{fmt}") for fmt in files.FORMATS)
    files.write_records(records, path, "r1", ["title"])
    for fmt, source in zip(files.FORMATS, range(5)):
        assert os.path.isdir(f"{path}/{fmt}/source=S{source}/run=r1"), fmt
