"""Stream operators that keep state by key: exact dedup, and requests resolved as attempts arrive.

State is in RocksDB, so it may outgrow memory, and is written to the checkpoint
with every micro-batch; a restarted stream goes on where it stopped. Nothing
stored earlier is read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagesift.operators.dedup import ORDER
from pagesift.operators.filters import fetch_failed

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state(spark: SparkSession) -> None:
    """Keep the state of streams in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


# Groups of keys that share a call to Python and a map of state. A group's rows of
# one micro-batch are reduced to the first of each key in memory. Fixed for the
# life of a checkpoint.
KEY_GROUPS = 1024


class FirstOfKey(StatefulProcessor):
    """The first row of each key of a group in the order of a micro-batch, and none later on."""

    def __init__(self, key: str, order: list[str], ttl_ms: int | None) -> None:
        self.key, self.order, self.ttl_ms = key, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = T.StructType([T.StructField("key", T.StringType())])
        seen = T.StructType([T.StructField("seen", T.BooleanType())])
        self.seen = handle.getMapState("seen", key, seen, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        # A hot key's rows come in batches; one row of each key is held.
        for batch in (b for b in rows if len(b)):
            batch = batch if first is None else pd.concat([first, batch])
            first = batch.sort_values(self.order, kind="stable").drop_duplicates(self.key)
        if first is not None:
            new = [not self.seen.containsKey((k,)) for k in first[self.key]]
            first = first[new]
            for k in first[self.key]:
                self.seen.updateValue((k,), (True,))
            yield first

    def close(self) -> None:
        pass


def keyed_dedup(records: DataFrame, key: str = "content_hash", ttl_seconds: int | None = None) -> DataFrame:
    """First record of each (store, ``key``) over all micro-batches.

    In a micro-batch the first in arrival order counts. A record with a null key
    is no duplicate of any. With ``ttl_seconds`` a key may come again that long
    after it was stored (processing time). Equals ``dedup`` where URLs do not
    repeat within a store, or on ``key='url'`` where content is not compared.
    """
    use_state(records.sparkSession)
    # Null keys are alone. Python sees columns by place, since names that begin with
    # an underscore don't reach it.
    names = records.columns
    alone = F.concat(F.lit("\0"), F.to_json(F.struct(*ORDER)))
    one = F.to_json(F.struct(F.col("store_key").alias("s"), F.coalesce(F.col(key), alone).alias("k")))
    keyed = records.withColumn("dedup_key", one).toDF(*[f"c{i}" for i in range(len(names) + 1)])
    place = {name: f"c{i}" for i, name in enumerate(names)}
    own = f"c{len(names)}"
    # A call to Python for each key would cost more than the dedup itself.
    grouped = keyed.withColumn("key_group", F.pmod(F.xxhash64(own), F.lit(KEY_GROUPS))).groupBy("key_group")
    processor = FirstOfKey(own, [place[c] for c in ORDER], None if ttl_seconds is None else ttl_seconds * 1000)
    mode = "None" if ttl_seconds is None else "ProcessingTime"
    shape = T.StructType([*keyed.schema, T.StructField("key_group", T.LongType())])
    found = grouped.transformWithStateInPandas(processor, shape, "Append", mode)
    return found.drop(own, "key_group").toDF(*names)


class Resolver(StatefulProcessor):
    """One row per request: its first good attempt, or the fact that all failed."""

    def __init__(self, tries: int, patience_ms: int) -> None:
        self.tries, self.patience_ms = tries, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        state = "seen ARRAY<BIGINT>, good BIGINT, answer BINARY, decided BOOLEAN"
        self.state = handle.getValueState("request", state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else ([], None, None, False)
        seen, good, answer, decided = set(held[0]), held[1], held[2], held[3]
        latest = 0
        for batch in (b for b in rows if len(b)):
            batch = batch[batch["attempt_no"] <= self.tries]
            seen.update(int(a) for a in batch["attempt_no"])
            if len(batch):
                latest = max(latest, int(batch["at_ms"].max()))
            usable = batch[batch["is_good"]]
            if len(usable):
                best = usable.sort_values(["attempt_no", "answer"], kind="stable").iloc[0]
                if good is None or best["attempt_no"] < good:
                    good, answer = int(best["attempt_no"]), bytes(best["answer"])
        if not seen:
            return
        # No earlier attempt can still turn out good, or no attempt is left.
        certain = set(range(1, (self.tries if good is None else good) + 1)) <= seen
        if certain and not decided:
            yield self.result(key, good, seen, answer)
        self.state.update((sorted(seen), good, answer, decided or certain))
        if latest:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(latest + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            seen, good, answer, decided = self.state.get()
            self.state.clear()
            if not decided:
                yield self.result(key, good, set(seen), answer)

    def result(self, key: tuple, good: int | None, seen: set[int], answer: bytes | None) -> pd.DataFrame:
        attempts = max(seen) if good is None else good
        text = None if answer is None else answer.decode()
        return pd.DataFrame({"request": [key[0]], "attempts": [attempts], "failed": [good is None], "answer": [text]})

    def close(self) -> None:
        pass


def resolve_stream(
    fetch_log: DataFrame, retries: int, patience: str, ts: str = "ts", request: str = "request_id", attempt: str = "attempt"
) -> DataFrame:
    """``resolve_attempts`` over a stream: a request's row comes as soon as it is certain.

    That is when its first good attempt and all before it are there, or its last
    one. Otherwise its timer decides: when event time (the watermark of ``ts``,
    ``patience`` behind the newest row) is ``patience`` past its newest attempt.
    State of a decided request is dropped by the same timer; what comes later
    still is behind the watermark. Rows with a null request or time are ignored.
    """
    use_state(fetch_log.sparkSession)
    rest = [f for f in fetch_log.schema if f.name not in (request, attempt, ts)]
    answer = T.StructType(rest)
    good = ~F.coalesce(fetch_failed("status"), F.lit(True))
    rows = fetch_log.filter(F.col(request).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(request).alias("request"),
        F.col(ts).alias("at"),
        F.col(attempt).cast("bigint").alias("attempt_no"),
        good.alias("is_good"),
        F.unix_millis(F.col(ts)).alias("at_ms"),
        F.to_json(F.struct(*[f.name for f in rest])).cast("binary").alias("answer"),
    )
    rows = rows.withWatermark("at", patience)
    kind = fetch_log.schema[request].dataType.simpleString()
    shape = f"request {kind}, attempts bigint, failed boolean, answer string"
    waiting = int(pd.Timedelta(patience).total_seconds() * 1000)
    processor = Resolver(retries + 1, waiting)
    found = rows.groupBy("request").transformWithStateInPandas(processor, shape, "Append", "EventTime")
    found = found.select(F.col("request").alias(request), "attempts", "failed", F.from_json("answer", answer).alias("_a"))
    return found.select(request, "attempts", "failed", "_a.*")
