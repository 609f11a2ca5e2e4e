"""Streams that keep state: dedup over restarts, attempts in any order, late rows."""

import random
import uuid
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from pagesift.operators import dedup, filters
from pagesift.schemas import HISTORY
from pagesift.streaming import ingest, late, state

RECORD = "store_key string, url string, source_ord string, pos int, content_hash string, `_odd name` string"


def feed(spark, home, rows, schema, number):
    spark.createDataFrame(rows, schema).write.parquet(f"{home}/in/part-{number}")
    return ingest.page_stream(spark, f"{home}/in/*", schema)


def test_state_dedup_equals_batch_dedup_over_restarts(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("st"), f"u{i}", "a", i, rng.choice([f"h{rng.randint(0, 30)}", "hot", None]), "x") for i in range(200)]
    rng.shuffle(rows)
    for number in range(4):
        # The second run finds nothing new; files of the first are not read again.
        part = rows[number * 50 : number * 50 + 50] if number != 1 else []
        stream = feed(spark, tmp_path, part, RECORD, number)
        ingest.to_files(state.keyed_dedup(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.columns == ["store_key", "url", "source_ord", "pos", "content_hash", "_odd name"]
    arrived = [(*r[:2], f"{k // 50}", *r[3:]) for k, r in enumerate(rows) if k // 50 != 1]
    want = dedup.dedup(spark.createDataFrame(arrived, RECORD), spark.createDataFrame([], HISTORY))
    assert sorted(r.pos for r in got.collect()) == sorted(r.pos for r in want.collect())


def test_attempts_are_resolved_when_certain_or_when_time_is_up(spark, tmp_path):
    schema = "request_id long, attempt long, status int, ts timestamp, answer string"
    at = lambda minute: datetime(2024, 1, 1, 0, minute, tzinfo=timezone.utc)
    parts = [
        [(1, 1, 200, at(0), "a"), (2, 1, 500, at(0), "b"), (3, 2, 200, at(0), "c"), (None, 1, 200, at(0), "n"), (6, 1, 503, None, "t")],
        [(2, 2, None, at(1), "d"), (3, 1, 200, at(1), "e"), (4, 1, 500, at(1), "f"), (1, 2, 200, at(2), "g"), (5, 2, 404, at(2), "h")],
        [(2, 3, 429, at(3), "i"), (4, 7, 200, at(3), "too late a try")],
        [(9, 99, 200, datetime(2024, 1, 2, tzinfo=timezone.utc), "clock")],
    ]
    seen = []
    for number, part in enumerate(parts):
        stream = feed(spark, tmp_path, part, schema, number)
        ingest.to_files(state.resolve_stream(stream, 2, "1 hour"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        rows = spark.read.parquet(f"{tmp_path}/out").collect()
        seen.append({r.request_id for r in rows})
    assert seen == [{1}, {1, 3}, {1, 2, 3}, {1, 2, 3, 4, 5}]
    log = spark.createDataFrame([r for part in parts[:3] for r in part if r[0] is not None and r[3] is not None], schema)
    want = {tuple(r) for r in filters.resolve_attempts(log, 2).select("request_id", "attempts", "failed", "status", "answer").collect()}
    assert {(r.request_id, r.attempts, r.failed, r.status, r.answer) for r in rows} == want


def test_late_rows_have_a_table_and_a_repeat_changes_nothing(spark, tmp_path):
    schema = "source_name string, ts timestamp, n int"
    at = lambda day, hour=0: datetime(2024, 1, day, hour, tzinfo=timezone.utc)
    home, window = str(tmp_path), (at(5), at(25))
    parts = [
        [("a", at(10), 1), ("a", at(2), 2), ("b", at(3), 3), ("c", None, 4)],
        [("a", at(9, 1), 5), ("a", at(8), 6), ("b", at(6), 7), (None, at(7), 8), ("a", at(20), 9)],
        [("a", at(18), 10), ("b", at(1), 11), ("c", at(6), 12), ("a", at(28), 13)],
    ]
    for number, part in enumerate(parts):
        late.route_stream(feed(spark, home, part, schema, number), home, "1 DAY", window, "1 day")

    def stored():
        spark.catalog.clearCache()
        good = {r.n for r in spark.read.parquet(f"{home}/records").collect()}
        behind = {(r.n, r.reason, r.behind_seconds) for r in spark.read.parquet(f"{home}/late").collect()}
        return good, behind, sorted(map(tuple, late.live_counts(spark, home).collect()), key=repr)

    good, behind, counts = stored()
    # 2 and 3 came before any watermark; 6 and 11 are behind that of their source, 10 behind the newer one.
    assert good == {1, 4, 5, 7, 8, 9, 12}
    assert behind == {(6, "late", 86400.0), (10, "late", 86400.0), (11, "late", 4 * 86400.0)}
    assert sum(r[-1] for r in counts) == 3 and sum(r[2] for r in counts) == 6 and sum(r[5] for r in counts) == 3
    late.route_micro_batch(spark.createDataFrame(parts[1], schema), 1, home, "1 DAY", window, "1 day")
    assert stored() == (good, behind, counts)


def test_a_running_stream_is_handed_to_the_caller(spark, tmp_path):
    schema = "source_name string, ts timestamp, n int"
    stream = feed(spark, tmp_path, [("a", datetime(2024, 1, 1, tzinfo=timezone.utc), 1)], schema, 0)
    query = late.route_stream(stream, str(tmp_path), "1 DAY", trigger="1 second")
    try:
        assert query.isActive
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.read.parquet(f"{tmp_path}/records").count() == 1


@pytest.fixture(autouse=True)
def plain_provider(spark):
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_state_dedup_calls_python_per_group_of_keys_not_per_key(spark, tmp_path, monkeypatch):
    """Many keys share a call; ties and null stores go as before, and a key seen in an earlier run stays out."""
    log = tmp_path / "calls"
    log.mkdir()
    real = state.FirstOfKey.handleInputRows

    class Logged(state.FirstOfKey):
        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            (log / uuid.uuid4().hex).touch()
            yield from real(self, key, rows, timerValues)

    monkeypatch.setattr(state, "FirstOfKey", Logged)
    monkeypatch.setattr(state, "KEY_GROUPS", 16)
    rows = [(s, f"u{i}", "a", i, f"h{i % 300}", "x") for s in ("s", None, "") for i in range(600)]
    for number, part in enumerate([rows[::-1], [("s", "v", "a", 0, "h5", "x"), ("s", "w", "a", 1, "new", "x")]]):
        stream = feed(spark, tmp_path, part, RECORD, number)
        ingest.to_files(state.keyed_dedup(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        if number == 0:
            assert 0 < len(list(log.iterdir())) <= 16 * 2
    got = {(r.store_key, r.url) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(s, f"u{i}") for s in ("s", None, "") for i in range(300)} | {("s", "w")}
