"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two halves of 32 bits. Two fingerprints at ``bits`` =
4 or fewer differing bits have a half in which they differ by 2 at most, so the
balls of radius 1 around these halves meet. Every distinct fingerprint enters the
tables under all keys of its balls (33 for each half). The entries are sorted by
key once; fingerprints under one key are compared as a whole, and a key gives as
many links as connect its members.

Groups of copies make crowded keys, whose pairs would grow with the square of
the group. Members of a key beyond ``CROWDED`` are not paired. Each of them, once
however many such keys it is in, enters a table under its own ball of half the
distance: two whole fingerprints are within 4 bits if and only if their balls of
radius 2 meet, so sharing a key there is a link for certain and no pairs are
needed. Work is bounded by a constant for each fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import materialize, pick, slices

WORDS = 4
BITS = 4
SEED = 42
# Members of a key that are compared in pairs: as many as a ball of radius 2 has keys.
CROWDED = 2048


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> list[int]:
    """XXH64 of each run of words; of the whole sequence where it is shorter."""
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return []
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(joined, seed)]
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends]
    return [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :])]


def votes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of hashes: bits set in over half of the run."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    starts = np.r_[0, np.cumsum(sizes)[:-1]][full]
    for bit in range(64):
        ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), starts)
        out[full] |= (2 * ones > sizes[full]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp`` (a signed long) of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, hashes = [], []
            for text in batch.column("text").to_pylist():
                found = shingle_hashes(text, words)
                sizes.append(len(found))
                hashes += found
            fps = votes(np.array(hashes, np.uint64), np.array(sizes, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(fps.view(np.int64))],
                names=["doc_id", "text_hash", "fp"],
            )

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    rows = rows.select("doc_id", text_hash("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def text_hash(column: str | Column) -> Column:
    """Tells rows with the same id apart; null and empty texts are the same."""
    return F.xxhash64(F.coalesce(column, F.lit("")))


def tables(fps: DataFrame) -> DataFrame:
    """``slot, fp``: the keys of the balls of radius 1 around both halves; the half is bit 32 of a slot."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    low_keys = F.transform(flips, lambda flip: low.bitwiseXOR(flip))
    high_keys = F.transform(flips, lambda flip: high.bitwiseXOR(flip).bitwiseOR(F.lit(1 << 32)))
    return fps.select(F.explode(F.concat(low_keys, high_keys)).alias("slot"), "fp")


def within(prints: np.ndarray, bits: int) -> np.ndarray:
    """For each fingerprint of one key the place of the first that it is connected to."""
    label = np.arange(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= bits
    while True:
        least = np.where(near, label[None, :], len(prints)).min(1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def key_links(entries: DataFrame, bits: int, crowded: int) -> DataFrame:
    """``a, b`` of the links under each key; ``b`` is null for a member of a crowded key.

    Entries stream through a task sorted by key; at most ``crowded`` of them and a
    batch are held.
    """

    def settled(slots: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        edges = np.flatnonzero(np.diff(slots)) + 1
        starts, sizes = np.r_[0, edges], np.diff(np.r_[0, edges, len(slots)])
        pairs = starts[sizes == 2]
        x, y = prints[pairs], prints[pairs + 1]
        close = np.bitwise_count(x ^ y) <= bits
        yield x[close], y[close]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            group = prints[start : start + size]
            first = within(group, bits)
            moved = first != np.arange(size)
            yield group[moved], group[first[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            other = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), other], names=["a", "b"])

        held_slots, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        full = None  # the key that has proved crowded
        for batch in batches:
            slots = np.r_[held_slots, batch.column("slot").to_numpy()]
            prints = np.r_[held, batch.column("fp").to_numpy().view(np.uint64)]
            counts = np.diff(np.r_[np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]]), len(slots)])
            size = np.repeat(counts, counts)
            over = (size > crowded) | (slots == full if full is not None else False)
            if over.any():
                yield out(prints[over], None)
                full = slots[over][-1]
                slots, prints = slots[~over], prints[~over]
            # The last key may go on in the next batch.
            rest = slots == slots[-1] if len(slots) else np.zeros(0, bool)
            held_slots, held = slots[rest], prints[rest]
            for a, b in settled(slots[~rest], prints[~rest]):
                if len(a):
                    yield out(a, b)
        for a, b in settled(held_slots, held):
            if len(a):
                yield out(a, b)

    dealt = entries.repartition("slot").sortWithinPartitions("slot")
    return dealt.mapInArrow(run, "a long, b long")


def ball(fp: Column, radius: int) -> Column:
    """All values within ``radius`` bits of a fingerprint, with the number of bits: up to 2,081 of radius 2."""
    flips = [(0, 0)]
    if radius > 0:
        flips += [(1 << i, 1) for i in range(64)]
    if radius > 1:
        flips += [(1 << i | 1 << j, 2) for i in range(64) for j in range(i)]
    masks = F.lit(np.array([mask for mask, _ in flips], np.uint64).view(np.int64).tolist())
    return F.transform(masks, lambda mask: fp.bitwiseXOR(mask))


def sure_links(fps: DataFrame, bits: int) -> DataFrame:
    """``a, b`` of fingerprints whose balls meet; a key has no more members than a ball has values."""
    outer, inner = (bits + 1) // 2, bits // 2
    entries = fps.select("fp", F.explode(ball(F.col("fp"), outer)).alias("key"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("key"))) <= inner
    groups = entries.groupBy("key").agg(F.min(F.when(close, F.col("fp"))).alias("b"), F.collect_list("fp").alias("members"))
    some = groups.filter((F.size("members") > 1) & F.col("b").isNotNull())
    return some.select(F.explode("members").alias("a"), "b").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest value reachable over ``a, b``, for nodes with an edge.

    Alternates two steps, each a minimum for each node: neighbours above a node
    move to its smallest neighbour, then those below it do. Every round is
    written, so it can be read again when executors go. The rounds grow with
    the logarithm of the longest chain.
    """
    def star(links: DataFrame) -> DataFrame:
        return links.filter("a <> b").distinct()

    def state(links: DataFrame) -> tuple:
        row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return tuple(row)

    links = materialize(star(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
    known = state(links)
    while known[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(star(large), "links")
        # Now each link goes from a larger to a smaller node.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = star(small.unionByName(lowest.select("a", F.col("m").alias("b"))))
        links = materialize(small, "links")
        new = state(links)
        if new == known:
            break
        known = new
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def labelled(fps: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    found = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return found.withColumn(name, F.coalesce("root", "fp")).drop("root")


def linked_roots(fps: DataFrame, bits: int = BITS, crowded: int = CROWDED) -> DataFrame:
    """``node, root`` of distinct fingerprints that link to another one."""
    if not 0 <= bits <= 4:
        raise ValueError("two tables with balls of radius 1 find up to 4 differing bits")
    found = materialize(key_links(tables(fps), bits, crowded), "key-links")
    members = materialize(found.filter("b is null").select(F.col("a").alias("fp")).distinct(), "crowded")
    links = found.filter("b is not null").distinct()
    if not members.isEmpty():
        links = links.unionByName(sure_links(members, bits))
    return components(links)


def near_duplicates(
    docs: DataFrame, words: int = WORDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, text_hash, fp, component_id`` of each row.

    ``component_id`` is the smallest id reachable over links of ``bits`` or
    fewer differing bits, the row's own included. A null or empty text has the
    fingerprint zero, linked like any other. Rows with a null id link too; the
    component has a null id only if all its ids are null. Repeated rows are
    returned each time. An empty table gives no rows; other columns are ignored.
    """
    rows = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    least = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = linked_roots(least.select("fp"), bits)
    classes = labelled(least, roots, "class")
    smallest = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    owner = materialize(classes.join(smallest, "class").select("fp", "component_id"), "owner")
    return rows.join(owner, "fp").select("doc_id", "text_hash", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` with one row kept of each component: the smallest id.

    Only the keys of dropped rows go to the join with the texts. Among rows
    with the same smallest id the smallest text hash stays; where all ids of a
    component are null, that of each fingerprint. Of wholly equal rows one stays.
    """
    found = materialize(near_duplicates(docs, words, bits), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), "text_hash")
    # All-null components of different kinds must not fall together.
    group = ["component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")]
    best = found.groupBy(*group).agg(F.min(rank).alias("best"), F.count("*").alias("n"))
    best = best.filter("n > 1").withColumnRenamed("component_id", "c")
    losers = found.join(best.filter("c is not null"), F.col("component_id") == F.col("c")).filter(
        ~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash")))
    )
    nulls = found.filter("component_id is null").join(
        best.filter("c is null"), F.col("fp") == F.col("alone")
    ).filter(F.col("text_hash") != F.col("best.text_hash"))
    dropped = losers.select("doc_id", "text_hash").unionByName(nulls.select("doc_id", "text_hash")).distinct()
    dropped = materialize(dropped.toDF("_drop_id", "_drop_text"), "dropped")
    twice = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1")
    twice = materialize(twice.select(F.col("doc_id").alias("_drop_id"), F.col("text_hash").alias("_drop_text")), "twice")

    # Columns go by place: their names may clash with each other or with ours.
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    own_id, own_text = (F.col(f"_{docs.columns.index(name)}") for name in ("doc_id", "text"))
    keyed = plain.withColumns({"_id": own_id, "_hash": text_hash(own_text)})
    same = F.col("_id").eqNullSafe(F.col("_drop_id")) & (F.col("_hash") == F.col("_drop_text"))
    kept = keyed.join(dropped, same, "left_anti")
    if not twice.isEmpty():
        once = kept.join(twice, same, "left_semi").dropDuplicates(["_id", "_hash"])
        kept = kept.join(twice, same, "left_anti").unionByName(once)
    return kept.drop("_id", "_hash").toDF(*docs.columns)
