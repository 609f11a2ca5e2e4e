"""Conflict chains decided by pointer jumping.

Rows take a URL and a content hash in order; a row is stored if what it checks is
still free, and then takes both. A URL or a hash is a wire that runs through its
rows and is free (0) or taken (1) between them. A row makes the wires' values
behind it from those before it, so behind a row a wire is a constant, or another
place's value, or its negation, or hangs on two places at once.

Every wire place thus points to an earlier one. A round replaces each pointer by
what its target points to, so the reach doubles: a chain of n conflicts takes
about log2(n) rounds instead of n. Where two undecided wires meet in a row, the row
waits until one of them is known. The first undecided row of all is decided in
every round, so rounds end.

Before the rounds, each task follows the wires through its own range of rows, so
a row points to what lies before that range. The rounds then run on the rows
that are pointed to; all others ask these once, at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.columns import bind_sql
from pagesift.operators.running import numbered_in_order
from pagesift.session import checked_broadcast, materialize

URL, HASH = 0, 1
# Wire ends that a task remembers; beyond that it starts anew.
MOST_ENDS = 200_000


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` written with ``_row``, a number that follows the order and tells all rows apart."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(dealt.withColumn("_row", F.monotonically_increasing_id()), "in-order")


def wire(key: str) -> Column:
    """Text that stands for (store, key); a null is alone on its wire."""
    named = F.concat(F.length("store_key").cast("string"), F.lit(":"), "store_key", F.lit("/"), key)
    return F.coalesce(named, F.concat(F.lit("#"), F.col("_row").cast("string")))


def before(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``_row`` and the row before it on its wire; a hot wire is cut into ranges."""
    numbers = materialize(numbered_in_order(rows.select(wire(key).alias("_w"), "_row"), ["_w"], ["_row"], "_n"), "wire")
    last = numbers.select("_w", (F.col("_n") + 1).alias("_n"), F.col("_row").alias(name))
    return numbers.join(last, ["_w", "_n"]).select("_row", name)


def behind(rows: DataFrame) -> DataFrame:
    """Add what the wires are behind each row, and whether it is stored (null: not known yet).

    A value is ``(ref, val)``: ``val`` itself where ``ref`` is null, else that of
    the place ``ref``, negated if ``val`` is 1. Worked out from the four cases of
    the at most two places that come in.
    """

    def a(x: int) -> str:
        return f"(CASE WHEN a.ref IS NULL THEN a.val ELSE a.val ^ {x} END)"

    def b(x: int, y: int) -> str:
        return f"(CASE WHEN b.ref IS NULL THEN b.val WHEN b.ref = a.ref THEN b.val ^ {x} ELSE b.val ^ {y} END)"

    def stored(x: int, y: int) -> str:
        return f"CASE WHEN (by_url AND {a(x)} = 1) OR (by_content AND {b(x, y)} = 1) THEN 0 ELSE 1 END"

    cases = [(x, y) for x in (0, 1) for y in (0, 1)]
    s = f"array({', '.join(stored(x, y) for x, y in cases)})"
    along = {
        URL: f"transform(array({', '.join(a(x) for x, _ in cases)}), (v, i) -> v | s[i])",
        HASH: f"transform(array({', '.join(b(x, y) for x, y in cases)}), (v, i) -> v | s[i])",
    }

    def value(cells: str, place: str) -> str:
        by_first = "(o[0] <> o[2] OR o[1] <> o[3])"
        by_second = "(o[0] <> o[1] OR o[2] <> o[3])"
        body = (
            f"CASE WHEN {by_first} AND {by_second} THEN struct({place} AS ref, 0 AS val) "
            f"WHEN {by_first} THEN struct(a.ref AS ref, o[0] AS val) WHEN {by_second} THEN struct(b.ref AS ref, o[0] AS val) "
            "ELSE struct(CAST(NULL AS BIGINT) AS ref, o[0] AS val) END"
        )
        return bind_sql("o", cells, body)

    known = "CASE WHEN s[0] = s[1] AND s[0] = s[2] AND s[0] = s[3] THEN s[0] END"
    both = f"struct({value(along[URL], '2 * _row')} AS u, {value(along[HASH], '2 * _row + 1')} AS h, {known} AS stored)"
    made = rows.withColumn("_out", F.expr(bind_sql("s", s, both)))
    return made.withColumns({"u": F.col("_out.u"), "h": F.col("_out.h"), "stored": F.col("_out.stored")}).drop("_out")


@cache
def outcome(by_url: bool | None, by_content: bool | None, a: int | None, b: int | None, val_a: int, val_b: int) -> tuple:
    """``behind`` for one row in plain Python: what its two wires hang on, and their values.

    ``a`` and ``b`` tell what comes in apart: None is a constant, equal numbers the
    same place. A wire hangs on 0 nothing, 1 ``a``, 2 ``b`` or 3 both.
    """
    wires: tuple[list, list] = ([], [])
    for x, y in ((0, 0), (0, 1), (1, 0), (1, 1)):
        taken_a = val_a if a is None else val_a ^ x
        taken_b = val_b if b is None else val_b ^ (x if b == a else y)
        stored = int(not (by_url and taken_a or by_content and taken_b))
        wires[URL].append(taken_a | stored)
        wires[HASH].append(taken_b | stored)
    made = []
    for o in wires:
        on = int(o[0] != o[2] or o[1] != o[3]) + 2 * int(o[0] != o[1] or o[2] != o[3])
        made.append((on, 0 if on == 3 else o[0]))
    return tuple(made)


def nearby(rows: DataFrame) -> DataFrame:
    """Replace pointers along the wires within a task's range of rows.

    A place is pointed to by the next row of its wire alone, so it is forgotten
    once that row was met: a task holds the ends of its wires, not its rows.
    """
    names = ["_row", "by_url", "by_content", "a_ref", "a_val", "b_ref", "b_val"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[int, tuple[int | None, int]] = {}
        for batch in batches:
            new: list[list] = [[], [], [], []]
            for row, by_url, by_content, a, val_a, b, val_b in zip(*[batch.column(c).to_pylist() for c in names]):
                if a in ends:
                    a, known = ends.pop(a)
                    val_a ^= known
                if b in ends:
                    b, known = ends.pop(b)
                    val_b ^= known
                if len(ends) >= MOST_ENDS:
                    ends.clear()
                kind_b = None if b is None else int(b != a)
                made = outcome(by_url, by_content, None if a is None else 0, kind_b, val_a, val_b)
                for side, (on, val) in enumerate(made):
                    ends[2 * row + side] = ((None, a, b, 2 * row + side)[on], val)
                for column, value in zip(new, (a, val_a, b, val_b)):
                    column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names[:3]], *map(pa.array, new, kinds)], names=names
            )

    flat = rows.select("_row", "by_url", "by_content", *[F.col(c)[f].alias(f"{c}_{f}") for c in "ab" for f in ("ref", "val")])
    dealt = flat.repartitionByRange("_row").sortWithinPartitions("_row")
    kinds = "_row bigint, by_url boolean, by_content boolean, a_ref bigint, a_val int, b_ref bigint, b_val int"
    found = dealt.mapInArrow(run, kinds)
    sides = [F.struct(F.col(f"{c}_ref").alias("ref"), F.col(f"{c}_val").alias("val")).alias(c) for c in "ab"]
    return found.select("_row", "by_url", "by_content", *sides)


def jumped(rows: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """Replace a pointer by what its target is: one row per target, so AQE can split a hot one's rows."""
    key = F.coalesce(F.col(name)["ref"], -1 - F.col("_row"))
    found = rows.withColumn("_at", key).join(places, "_at", "left")
    new = F.struct(F.col("_to.ref").alias("ref"), F.col(name)["val"].bitwiseXOR(F.col("_to.val")).alias("val"))
    return found.withColumn(name, F.when(F.col("_to").isNull(), F.col(name)).otherwise(new)).drop("_at", "_to")


def decided(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows that get stored where nothing is stored yet.

    Needs store_key, url, content_hash, by_url, by_content and the order columns.
    A row without a store, or a null URL or hash, conflicts with none in it.
    """
    numbered = in_order(rows, order)
    free = F.struct(F.lit(None).cast("bigint").alias("ref"), F.lit(0).alias("val"))

    def place(name: str, side: int) -> Column:
        at = F.struct((2 * F.col(name) + side).alias("ref"), F.lit(0).alias("val"))
        return F.when(F.col(name).isNull(), free).otherwise(at)

    slim = numbered.select("_row", "by_url", "by_content")
    slim = slim.join(before(numbered, "url", "_pu"), "_row", "left").join(before(numbered, "content_hash", "_ph"), "_row", "left")
    slim = slim.select("_row", "by_url", "by_content", place("_pu", URL).alias("a"), place("_ph", HASH).alias("b"))
    rows_in = materialize(behind(nearby(slim)), "chain")
    is_open = "u.ref IS NOT NULL OR h.ref IS NOT NULL OR stored IS NULL"
    kept = rows_in.filter(f"stored = 1 AND NOT ({is_open})").select("_row")
    waiting = rows_in.filter(is_open).select("_row", "by_url", "by_content", "a", "b")
    if not waiting.isEmpty():
        asked = waiting.select(F.explode(F.array("a.ref", "b.ref")).alias("_at")).filter("_at IS NOT NULL")
        asked = asked.select(F.expr("_at div 2").alias("_row")).distinct()
        places = known_places(rows_in.join(asked, "_row", "left_semi"), is_open)
        places = checked_broadcast(materialize(places, "chain-places"))
        last = behind(jumped(jumped(waiting, places, "a"), places, "b"))
        kept = kept.unionByName(last.filter("stored = 1").select("_row"))
    return numbered.join(kept, "_row", "left_semi").select(rows.columns)


def known_places(now: DataFrame, is_open: str) -> DataFrame:
    """Values of all places of these rows, which point to each other alone, by rounds of jumps."""
    sides = F.inline(
        F.array(
            F.struct((2 * F.col("_row")).alias("_at"), F.col("u").alias("_to")),
            F.struct((2 * F.col("_row") + 1).alias("_at"), F.col("h").alias("_to")),
        )
    )
    closed = None  # places that are known: pointers to them may still be handed on
    while True:
        now = materialize(now, "chain")
        done = now.filter(f"NOT ({is_open})").select(sides)
        closed = done if closed is None else closed.unionByName(done)
        waiting = now.filter(is_open)
        if waiting.isEmpty():
            return closed
        places = waiting.select(sides).unionByName(closed)
        waiting = waiting.select("_row", "by_url", "by_content", "a", "b")
        now = behind(jumped(jumped(waiting, places, "a"), places, "b"))
