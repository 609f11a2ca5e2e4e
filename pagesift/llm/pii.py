"""Personal data replaced by keyed stand-ins, the same ones all over the corpus.

Entities of all documents are made distinct; each draws a stand-in. One that
equals a real entity, or that another entity holds, is drawn again, in rounds
over the entities still open. So different entities stay different and all
mentions of one stay together. Nearly all entities keep their first draw, which
a task can make by itself; only the others are joined to the texts with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.llm import entities as en
from pagesift.llm.common import materialize, pick, slices

ATTEMPTS = "array<struct<kind:string,normal:string,attempt:int>>"


def found_entities(texts: DataFrame) -> DataFrame:
    """``hash, kind, normal`` of the entities of each text, once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for at, text in zip(batch.column("hash").to_pylist(), batch.column("text").to_pylist()):
                out += [(at, *e) for e in {(m.kind, m.normal) for m in en.mentions(text)}]
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                names=["hash", "kind", "normal"],
            )

    return texts.mapInArrow(run, "hash long, kind string, normal string")


def drawn(rows: DataFrame, key: bytes, attempt: int) -> DataFrame:
    """Adds ``space`` and ``value``, the stand-in at this attempt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column("kind").to_pylist(), batch.column("normal").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("kind"), batch.column("normal"), pa.array([en.space(k) for k, _ in pairs], pa.string()),
                    pa.array([en.surrogate(key, k, n, attempt) for k, n in pairs], pa.string()),
                ],
                names=["kind", "normal", "space", "value"],
            )

    return rows.mapInArrow(run, "kind string, normal string, space string, value string")


def attempts(distinct: DataFrame, key: bytes) -> DataFrame:
    """``kind, normal, space, value, attempt``: a stand-in for each entity, no two alike.

    A draw is refused if it is an entity's own normal form, or held. Of several
    entities with one draw the smallest gets it. From the eighth round on the
    shapes grow, so the rounds end.
    """
    real = drawn(distinct, key, 0).select("space", F.col("normal").alias("value")).distinct()
    open_ones, held, attempt = distinct, None, 0
    while True:
        draws = materialize(drawn(open_ones, key, attempt), "draws")
        free = draws.join(real, ["space", "value"], "left_anti")
        if held is not None:
            free = free.join(held.select("space", "value"), ["space", "value"], "left_anti")
        best = free.groupBy("space", "value").agg(F.min(F.struct("kind", "normal")).alias("e"))
        won = best.select("e.kind", "e.normal", "space", "value", F.lit(attempt).alias("attempt"))
        won = materialize(won, "won")
        held = won if held is None else held.unionByName(won)
        open_ones = materialize(draws.join(won, ["kind", "normal"], "left_anti").select("kind", "normal"), "open")
        if open_ones.isEmpty():
            return held
        attempt += 1


def replaced(text: str, key: bytes, other: dict[tuple[str, str], int], drawn: dict) -> tuple[str, int]:
    found = en.mentions(text)
    if not found:
        return text, 0
    out, at = [], 0
    for m in found:
        entity = (m.kind, m.normal, other.get((m.kind, m.normal), 0))
        if entity not in drawn:
            drawn[entity] = en.surrogate(key, *entity)
        out += [text[at : m.start], en.written(text[m.start : m.end], m.kind, drawn[entity])]
        at = m.end
    return "".join(out) + text[at:], len(found)


def with_surrogates(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """The rows of ``docs`` with stand-ins in the text, and the number of mentions.

    ``key`` (up to 64 bytes, not empty) makes stand-ins repeatable and cannot be
    told from them. All columns stay, whatever their names; a column called
    ``count_col`` would be there twice, so it is replaced. A null text stays
    null with no mentions; texts without personal data stay as they are.
    Repeated rows get the same stand-ins. An empty table gives no rows. Texts are
    scanned for entities and again to replace them, and take no shuffle unless
    the redrawn entities are too many to send out.
    """
    secret = key.encode()
    if not 0 < len(secret) <= 64:
        raise ValueError("the key must have 1 to 64 bytes")
    pick(docs, text_col)
    names = [c for c in docs.columns if c != count_col]
    positions = [i for i, c in enumerate(docs.columns) if c != count_col]
    text_at = f"_{names.index(text_col)}"
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    plain = plain.select(*[F.col(f"_c{p}").alias(f"_{i}") for i, p in enumerate(positions)])
    plain = plain.withColumn("hash", F.xxhash64(text_at))
    texts = plain.select("hash", F.col(text_at).alias("text")).filter("text is not null")

    per_text = found_entities(texts)
    distinct = materialize(per_text.select("kind", "normal").distinct(), "entities")
    redrawn = materialize(attempts(distinct, secret).filter("attempt > 0"), "redrawn")
    if redrawn.isEmpty():
        joined = plain.withColumn("other", F.lit(None).cast(ATTEMPTS))
    else:
        rows = per_text.join(redrawn, ["kind", "normal"])
        rows = rows.groupBy("hash").agg(F.collect_set(F.struct("kind", "normal", "attempt")).alias("other"))
        joined = plain.join(materialize(rows, "others"), "hash", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_at):
            made: dict = {}
            out = []
            for text, other in zip(batch.column(text_at).to_pylist(), batch.column("other").to_pylist()):
                chosen = {(o["kind"], o["normal"]): o["attempt"] for o in other or ()}
                out.append((None, 0) if text is None else replaced(text, secret, chosen, made))
            columns = {f.name: batch.column(f.name) for f in batch.schema if f.name.startswith("_")}
            columns[text_at] = pa.array([t for t, _ in out], pa.string())
            columns["_count"] = pa.array([n for _, n in out], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    joined = joined.select(*[f"_{i}" for i in range(len(names))], "other")
    fields = [f for f in joined.schema if f.name.startswith("_")]
    schema = T.StructType([*fields, T.StructField("_count", T.LongType())])
    return joined.mapInArrow(run, schema).toDF(*names, count_col)
