"""Chat formatting: every dialogue once from the view of each participant.

In a participant's rendering its own turns are those of the assistant and all
others are users that carry their names. Masks mark what a model is trained on:
the assistant's words and the mark that ends them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.llm.common import materialize, pick
from pagesift.session import checked_broadcast

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# Turns of one part of a rendering. Longer dialogues have several parts.
PART_TURNS = 512
UNNAMED = "unknown"


def header(role: Column, speaker: Column) -> Column:
    return F.when(role == speaker, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), role, F.lit("\n")))


def rendered(turns: Column, speaker: Column) -> tuple[Column, Column]:
    """The text of the turns, and start and end of each trained stretch in it."""
    pieces = F.transform(
        turns,
        lambda t: F.struct(
            header(t["role"], speaker).alias("head"),
            F.concat(t["text"], F.lit(CLOSE)).alias("body"),
            (t["role"] == speaker).alias("own"),
        ),
    )
    text = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"])), "")
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["head"])
        end = start + F.length(piece["body"])
        # The line break after the mark is not trained.
        span = F.array(F.struct(start.alias("start"), (end - 1).alias("end")))
        spans = F.when(piece["own"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    return text, F.aggregate(pieces, empty, step, lambda s: s["spans"])


def unmarked(text: Column) -> Column:
    """A text that can't be taken for marks: one more backslash in each ``<|im_``.

    Taking one out of every ``<\\...|im_`` gives the text back.
    """
    return F.regexp_replace(text, r"<(\\*)\|im_", r"<\\$1|im_")


def in_order(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dealt, at``: rows in order, with their place in
    the conversation's share of one range partition.

    A conversation is cut wherever its rows need it, copies of one row as well.
    Digests stand for the texts, so that no texts are sampled for the ranges.
    """
    order = ["conv_id", "turn", "role", "_key", "_apart"]
    keyed = rows.withColumns({"_key": F.sha2("text", 256), "_apart": F.xxhash64(F.monotonically_increasing_id())})
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_key", "_apart")
    dealt = dealt.withColumn("dealt", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = object(), 0
        for batch in batches:
            places = []
            for conv in batch.column("conv_id").to_pylist():
                at = at + 1 if conv == last else 0
                last = conv
                places.append(at)
            yield batch.append_column("at", pa.array(places, pa.int64()))

    schema = T.StructType([*dealt.schema.fields, T.StructField("at", T.LongType())])
    return dealt.mapInArrow(run, schema)


def numbered(dealt: DataFrame) -> DataFrame:
    """Rows with ``number``, 0, 1, ... within the conversation.

    Of a partition's conversations only the first can have begun in an earlier
    one, so there are no more starts beyond 0 than partitions: they are sent out.
    """
    along = Window.partitionBy("conv_id").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
    shares = dealt.groupBy("conv_id", "dealt").agg(F.count(F.lit(1)).alias("_n"))
    starts = shares.select(
        F.col("conv_id").alias("_conv"), F.col("dealt").alias("_dealt"), F.sum("_n").over(along).alias("_start")
    ).filter("_start > 0")
    here = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("dealt") == F.col("_dealt"))
    placed = dealt.join(F.broadcast(starts), here, "left")
    return placed.withColumn("number", F.col("at") + F.coalesce("_start", F.lit(0))).drop("_conv", "_dealt", "_start")


def rotated(
    turns: DataFrame,
    part_turns: int = PART_TURNS,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_id, speaker, part, n_turns, text, masks``: a row per participant and part.

    ``masks`` holds ``start`` and ``end`` (code points, end excluded) of the
    participant's turns within ``text``. Turns go by number, those without one
    first, then by role and SHA-256 of the text; repeated rows are repeated
    turns. Every 512 of them are a part, whatever their numbers, so a dialogue of any length is
    whole, in the order of ``part``, and no row holds one of unbounded length; a
    participant who is silent in a part has a rendering of it with no masks. A
    null or blank role is the participant ``unknown``, a null text an empty
    turn. Rows with a null conversation are one conversation. Line breaks and
    blanks in names become one underscore. Marks inside texts and names are
    escaped (see ``unmarked``), so no turn can pass for another's. The turns are
    written once, in order. An empty table gives no rows.
    """
    rows = pick(turns, conv_col, turn_col, role_col, text_col).toDF("conv_id", "turn", "role", "text")
    role = F.regexp_replace(F.trim(F.coalesce("role", F.lit(""))), "\\s+", "_")
    rows = rows.withColumns(
        {
            "role": F.when(role == "", F.lit(UNNAMED)).otherwise(unmarked(role)),
            "text": unmarked(F.coalesce("text", F.lit(""))),
        }
    )
    dealt = materialize(in_order(rows), "dialogues")
    placed = numbered(dealt).withColumn("part", F.floor(F.col("number") / part_turns).cast("long"))
    turn = F.struct("number", "role", "text")
    parts = placed.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    speakers = dealt.select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    views = parts.join(checked_broadcast(speakers), F.col("conv_id").eqNullSafe(F.col("_conv")))
    text, masks = rendered(F.col("turns"), F.col("speaker"))
    return views.select(
        "conv_id", "speaker", "part", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), masks.alias("masks")
    )
