"""History as base and later batches: merged stores, lookups by touched keys."""

import random
from datetime import datetime, timezone
from pathlib import Path

from pagesift.schemas import HISTORY
from pagesift.sources import history as store
from pagesift.sources import history_merge as merge


def rows_of(spark, rows):
    full = [(s, u, h, datetime(2024, 1, day, tzinfo=timezone.utc), "src") for s, u, h, day in rows]
    return spark.createDataFrame(full, HISTORY)


def as_set(df):
    return sorted((r.store_key, r.url, r.content_hash) for r in df.collect())


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_merged_history_reads_like_the_batches(spark, tmp_path):
    rng = random.Random(3)
    path, plain = str(tmp_path / "h"), {}
    for day in range(1, 8):
        batch = {(rng.choice(["s", "t/x=1", "ü"]), f"u{rng.randint(0, 30)}"): f"h{day}-{rng.randint(0, 9)}" for _ in range(25)}
        plain.update(batch)
        store.append_history(rows_of(spark, [(*key, h, day) for key, h in batch.items()]), path, f"b{day}")
        if day in (4, 6):
            assert merge.merge_batches(spark, path, most_batches=2) == ["s", "t/x=1", "ü"]
            held = merge.stored_batches(spark, path)["s"]
            assert f"b{day}" in held and len(held) == 2  # the base and the batch that may be repeated
        want = sorted((*key, h) for key, h in plain.items())
        assert as_set(store.read_history(spark, path, latest=True)) == want
        asked = rng.sample(sorted(plain), 9)
        keys = rows_of(spark, [(*key, None, 1) for key in asked] + [("s", None, None, 1), ("none", "u1", None, 1)])
        assert as_set(merge.latest_for(spark, path, keys.union(keys))) == sorted((*key, plain[key]) for key in asked)
    assert as_set(merge.latest_for(spark, path, keys.limit(0))) == []


def test_only_touched_stores_are_rewritten_and_read(spark, tmp_path):
    path = str(tmp_path / "h")
    for day in range(1, 5):
        stores = ["hot"] if day > 1 else ["hot", "still"]
        rows = [(s, f"u{i:04}", f"h{day}", day) for s in stores for i in range(300)]
        store.append_history(rows_of(spark, rows), path, f"b{day}")
    before = files(path)
    assert merge.merge_batches(spark, path, most_batches=2, file_rows=100) == ["hot"]
    after = files(path)
    kept = {name for name in before if "store_key=still" in name or "batch=b4" in name}
    assert {name: after[name] for name in kept} == {name: before[name] for name in kept}
    assert not any("batch=b1" in name and "store_key=hot" in name for name in after)
    assert len([name for name in after if "batch=merged-" in name]) >= 3  # files by ranges of URLs
    assert merge.merge_batches(spark, path, most_batches=2) == []
    found = merge.latest_for(spark, path, rows_of(spark, [("hot", "u0007", None, 1), ("hot", "u0009", None, 1)]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: ") :]
    assert "store_key" in filters.split("PushedFilters")[0] and "hot" in filters.split("PushedFilters")[0]
    assert "GreaterThanOrEqual(url,u0007)" in plan and "LessThanOrEqual(url,u0009)" in plan
    assert as_set(found) == [("hot", "u0007", "h4"), ("hot", "u0009", "h4")]


def test_cut_off_merge_and_repeated_batch(spark, tmp_path):
    path = str(tmp_path / "h")
    store.append_history(rows_of(spark, [("s", "u", "old", 1), ("s", "v", "v", 1)]), path, "b1")
    store.append_bits(store.read_history(spark, path), path, "b1")
    store.append_history(rows_of(spark, [("s", "u", "new", 2)]), path, "b2")
    store.append_history(rows_of(spark, [("s", "w", "w", 3)]), path, "b3")
    old = merge.stored_batches(spark, path)["s"]["b1"]
    copy = [(p.name, p.read_bytes()) for p in Path(old.removeprefix("file:")).glob("*.parquet")]
    assert merge.merge_batches(spark, path, most_batches=1) == ["s"]
    want = [("s", "u", "new"), ("s", "v", "v"), ("s", "w", "w")]
    # As if it had been cut off before it deleted what the base replaces.
    Path(old.removeprefix("file:")).mkdir()
    for name, data in copy:
        (Path(old.removeprefix("file:")) / name).write_bytes(data)
    assert as_set(store.read_history(spark, path, latest=True)) == want
    assert merge.merge_batches(spark, path, most_batches=1) == ["s"]
    assert as_set(store.read_history(spark, path)) == want
    assert as_set(store.read_history(spark, path, without_batch="b3")) == want[:2]
    keys = rows_of(spark, [("s", u, u, 4) for u in ("u", "v", "w", "x1")])
    bits = store.read_membership(spark, path)
    assert bits is not None and as_set(merge.latest_for(spark, path, keys)) == want


def test_files_of_a_batch_are_sorted_by_url(spark, tmp_path):
    path = str(tmp_path / "h")
    rows = [("s", f"u{i * 37 % 1000:04}", "h", 1) for i in range(1000)]
    store.append_history(rows_of(spark, rows).repartition(4), path, "b1")
    for file in Path(path).rglob("*.parquet"):
        urls = [r.url for r in spark.read.parquet(str(file)).select("url").collect()]
        assert urls == sorted(urls)


def test_nothing_stored(spark, tmp_path):
    path = str(tmp_path / "none")
    assert merge.merge_batches(spark, path) == []
    assert merge.latest_for(spark, path, rows_of(spark, [("s", "u", None, 1)])).count() == 0
