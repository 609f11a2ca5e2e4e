"""Conversation structure repair: faults, cheapest edits, and the least audit among them.

Rows of a conversation are edited until their roles read ``(s?(ua)+)?``: at most
one system turn, then user and assistant in turn. Four states tell how far a
sequence is (nothing yet, after system, after user, after assistant). From a
state a row may be kept, given the role that fits, or deleted, and an empty turn
of the role that fits may be inserted, so an edit's initial leads to one state.

A cost DP gives the cheapest cost from every (row, state). The arcs that stay
on a cheapest way are ranked by what can be written from their nodes in 1, 2, 4,
... edits: the rank for twice the length is that of a pair, a node's own rank
and the rank of the node its pointer leads to. The last ranks choose each node's
arc, and the doubled pointers then give all edits of the least audit at once.

A conversation may be of any length. Its rows are dealt in ranges and cut into
chunks; a chunk gives a 4 x 4 matrix of costs between its ends, these few numbers
are summed up from the end of the conversation, and every chunk is then solved
alone for each state it may be entered in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import materialize, pick, slices

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
# A chunk ends at this many rows, or beyond this many bytes of text.
CHUNK_ROWS = 512
CHUNK_BYTES = 1 << 20
# Rows that numpy handles at once.
BATCH_ROWS = 1 << 15

STATES = 4
USER = np.array([2, 2, -1, 2])  # state after a user's turn, from each state
ASSISTANT = np.array([-1, -1, 3, -1])
SYSTEM = np.array([1, -1, -1, -1])
FITTING = np.array([2, 2, 3, 2])  # state after the role that fits
ENDS = (0, 3)
LETTERS = b"DIKR"  # in ASCII order
FAR = 1 << 40

BLANK, DUPLICATE, CUT = 1, 2, 3


# --- one batch of chunks -----------------------------------------------------------


class Chunks:
    """Rows of several chunks one after another: a role's class and a fault for each."""

    def __init__(self, roles: list[bytes], faults: list[bytes]) -> None:
        self.sizes = np.array([len(r) for r in roles], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        role, fault = np.frombuffer(b"".join(roles), np.uint8), np.frombuffer(b"".join(faults), np.uint8)
        must_go = (fault == BLANK) | (fault == DUPLICATE)
        stays = np.where(must_go, FAR, np.where(fault == CUT, TRUNCATED, 0)).astype(np.int64)
        # Cost of keeping or rerole for each row and state, and the state it leads to.
        self.keep = np.full((len(role), STATES), FAR, np.int64)
        self.keep_to = np.zeros((len(role), STATES), np.int64)
        for initial, after in ((b"s", SYSTEM), (b"u", USER), (b"a", ASSISTANT)):
            here = np.flatnonzero(role == initial[0])
            for state in np.flatnonzero(after >= 0):
                self.keep[here, state] = KEEP + stays[here]
                self.keep_to[here, state] = after[state]
        self.rerole = np.minimum(REROLE + stays, FAR)

    def backward(self, at_end: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """Cheapest cost from each node to the chunk's end; ``at_end`` per chunk, column and state.

        An array per place, for the chunks that have it (longest first, see
        ``order``). Inserted turns before a row belong to it; those after the
        last row only to a chunk that ends its conversation.
        """
        order = np.argsort(-self.sizes, kind="stable")
        self.order, longest = order, int(self.sizes.max(initial=0))
        count = np.searchsorted(-self.sizes[order], -np.arange(longest + 1), side="right")
        closing = np.where(last[:, None, None], inserts(at_end), at_end)[order]
        out: list[np.ndarray] = [None] * (longest + 1)
        for place in range(longest, -1, -1):
            more = int(count[place + 1]) if place < longest else 0
            now = closing[: count[place]].copy()
            if more:
                after = out[place + 1][:more]
                rows = self.starts[order[:more]] + place
                now[:more] = inserts(self.before(rows, after))
            out[place] = now
        return out

    def before(self, rows: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Cost ahead of rows (before insertions), from that behind them: chunk, column, state."""
        kept = np.take_along_axis(after, self.keep_to[rows][:, None, :].repeat(after.shape[1], 1), 2)
        best = np.minimum(after + DELETE, kept + self.keep[rows][:, None, :])
        rerole = after[:, :, FITTING] + self.rerole[rows][:, None, None]
        return np.minimum(np.minimum(best, rerole), FAR)


def inserts(cost: np.ndarray) -> np.ndarray:
    """Costs once turns may be inserted first: two in a row lead from any state to any reachable one."""
    for _ in range(2):
        cost = np.minimum(cost, cost[..., FITTING] + INSERT)
    return np.minimum(cost, FAR)


def matrices(roles: list[bytes], faults: list[bytes], last: np.ndarray) -> np.ndarray:
    """Cost between the ends of each chunk, 16 numbers: from state, to state."""
    ends = np.full((len(roles), STATES, STATES), FAR, np.int64)
    ends[:, range(STATES), range(STATES)] = 0
    chunks = Chunks(roles, faults)
    first = chunks.backward(ends, last)[0]
    out = np.empty_like(ends)
    out[chunks.order] = first
    return out.transpose(0, 2, 1)


def solved(roles: list[bytes], faults: list[bytes], last: np.ndarray, behind: np.ndarray) -> list[list[tuple[int, bytes]]]:
    """For each chunk and entry state: exit state and edits of the least audit.

    ``behind`` is the cost from each state at a chunk's end to the end of the
    conversation. An entry state from which there is no way has the exit -1.
    """
    chunks = Chunks(roles, faults)
    costs = chunks.backward(behind[:, None, :], last)
    nodes = (chunks.sizes + 1) * STATES
    base = np.concatenate(([0], np.cumsum(nodes)))
    cost = np.empty(int(base[-1]), np.int64)
    for place, values in enumerate(costs):
        own = chunks.order[: len(values)]
        cost[(base[own] + place * STATES)[:, None] + np.arange(STATES)] = values[:, 0, :]

    # Arcs of all nodes: target and cost for each letter, FAR where there is none.
    total = len(cost)
    target = np.zeros((total, 4), np.int64)
    weight = np.full((total, 4), FAR, np.int64)
    chunk = np.repeat(np.arange(len(roles)), nodes)
    state = np.arange(total) % STATES
    place = (np.arange(total) - base[chunk]) // STATES
    node = np.arange(total)
    inner = place < chunks.sizes[chunk]
    may_insert = inner | last[chunk]
    target[:, 1], weight[:, 1] = node - state + FITTING[state], np.where(may_insert, INSERT, FAR)
    some = np.flatnonzero(inner)
    row, own = chunks.starts[chunk[some]] + place[some], state[some]
    below = some - own + STATES
    target[some, 0], weight[some, 0] = below + own, DELETE
    target[some, 2], weight[some, 2] = below + chunks.keep_to[row, own], chunks.keep[row, own]
    target[some, 3], weight[some, 3] = below + FITTING[own], chunks.rerole[row]
    optimal = (weight < FAR) & (cost[:, None] < FAR) & (weight + cost[target] == cost[:, None])

    pointer, letter = chosen(target, optimal)
    pointers, lengths = doubled(pointer, letter)
    entry = (base[:-1, None] + np.arange(STATES)).ravel()
    edits, exits = walked(entry, letter, pointers, lengths)
    reachable = cost[entry] < FAR
    out: list[list[tuple[int, bytes]]] = []
    for k in range(len(roles)):
        four = range(k * STATES, (k + 1) * STATES)
        out.append([(int(exits[i] % STATES), edits[i]) if reachable[i] else (-1, b"") for i in four])
    return out


def chosen(target: np.ndarray, optimal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Target and letter (4 at an end) of each node's arc on its least audit.

    Ranks for one edit are the least letters. A round doubles the length: the
    pair (own rank, rank behind the pointer) is ranked anew, until all pointers
    have reached an end. An end comes before all letters.
    """
    node, some = np.arange(len(target)), optimal.any(1)
    letter = optimal.argmax(1)
    pointer = np.where(some, target[node, letter], node)
    rank, ended = np.where(some, letter + 1, 0), False
    while not ended:
        pairs = rank * (int(rank.max(initial=0)) + 1) + rank[pointer]
        rank = np.unique(pairs, return_inverse=True)[1]
        pointer = pointer[pointer]
        ended = bool((pointer == pointer[pointer]).all())
    # The last ranks choose: the least letter, then the least rank behind it.
    width = int(rank.max(initial=0)) + 1
    choice = np.where(optimal, np.arange(4) * width + rank[target], 4 * width).argmin(1)
    return np.where(some, target[node, choice], node), np.where(some, choice, 4)


def doubled(pointer: np.ndarray, letter: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Pointers over 1, 2, 4, ... edits, and the number of edits behind each node."""
    pointers, length = [pointer], (letter < 4).astype(np.int64)
    while (pointers[-1] != pointers[-1][pointers[-1]]).any():
        length = length + length[pointers[-1]]
        pointers.append(pointers[-1][pointers[-1]])
    return pointers, length


def walked(entry: np.ndarray, letter: np.ndarray, pointers: list[np.ndarray], lengths: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Edits from each entry node to its end, and the node there: a jump per bit of the step's number."""
    sizes = lengths[entry]
    stops = np.cumsum(sizes)
    step = np.arange(int(stops[-1]) if len(stops) else 0) - np.repeat(stops - sizes, sizes)
    at, end = np.repeat(entry, sizes), entry.copy()
    for bit, jump in enumerate(pointers):
        at = np.where(step >> bit & 1, jump[at], at)
        end = np.where(sizes >> bit & 1, jump[end], end)
    text = np.frombuffer(LETTERS, np.uint8)[letter[at]].tobytes()
    return [text[b - n : b] for b, n in zip(stops.tolist(), sizes.tolist())], end


# --- tables --------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """The rows with seeded faults, by CRC32 of ``conv_id:turn`` modulo 20; a native projection."""
    kind = F.crc32(
        F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")
    ) % 20
    rows = turns.withColumns({"kind": kind, "role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.filter("kind <> 0").withColumns(
        {"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "copy": copies}
    )
    return rows.withColumn("copy", F.explode("copy")).drop("kind")


def keyed(conv: Column) -> Column:
    """A text that stands for a conversation's id; a null id has one of its own."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


CHUNK = (
    "conv string, part int, seq int, roles binary, faults binary, keys array<binary>, turns array<long>, "
    "names array<string>, texts array<binary>"
)


def chunked(rows: DataFrame, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """Sorted rows as chunks ``(conv, part, seq)`` in order; texts are moved once here."""
    visible = F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", "")
    initial = F.left("role", F.lit(1))
    rows = rows.select(
        keyed(F.col("conv_id")).alias("conv"),
        "turn",
        "role",
        F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("key"),
        F.when(initial.isin("s", "u", "a"), F.ascii(initial)).otherwise(0).cast("int").alias("initial"),
        F.when(visible == "", BLANK).when(~F.right(visible, F.lit(1)).isin(*".!?"), CUT).otherwise(0).alias("fault"),
        F.col("text").cast("binary").alias("text"),
        # Copies of one row are told apart, so that many of them are dealt out as well.
        F.xxhash64(F.monotonically_increasing_id(), "copy").alias("apart"),
    )
    order = ["conv", F.asc_nulls_first("turn"), "role", "key", "apart"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("part", F.spark_partition_id())
    names = [c.split()[0] for c in CHUNK.split(", ")]
    schema = pa.schema(
        [("conv", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("roles", pa.binary()), ("faults", pa.binary()),
         ("keys", pa.list_(pa.binary())), ("turns", pa.list_(pa.int64())), ("names", pa.list_(pa.string())), ("texts", pa.list_(pa.binary()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        conv, seq, size, ready, waiting = None, 0, 0, [], 0

        def close() -> None:
            nonlocal held, seq, size
            if held:
                _, part, turns, roles, keys, initials, faults, texts = zip(*held)
                digests = [bytes.fromhex(k) for k in keys]
                ready.append((conv, part[0], seq, bytes(initials), bytes(faults), digests, list(turns), list(roles), list(texts)))
            held, seq, size = [], seq + 1, 0

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("conv", "part", "turn", "role", "key", "initial", "fault", "text")]
            for row in zip(*columns):
                if row[0] != conv or len(held) >= chunk_rows or size >= chunk_bytes:
                    close()
                    conv = row[0]
                held.append(row)
                size += len(row[7])
                waiting += len(row[7]) + 64
                if waiting >= 4 * chunk_bytes and ready:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready), schema.types)], names=names)
                    ready, waiting = [], size
        close()
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready), schema.types)], names=names)

    return dealt.mapInArrow(run, CHUNK)


PLACE = ["conv", "part", "seq"]


def with_duplicates(chunks: DataFrame) -> DataFrame:
    """Chunks without texts, with the fault of rows whose role and text come earlier.

    The first place of each (conversation, role and text) is a pre-aggregated
    minimum; it goes back by the place of its chunk, which no row shares.
    """
    slim = chunks.drop("keys", "names", "texts")
    each = chunks.select("conv", "part", "seq", F.posexplode("keys").alias("at", "key"))
    firsts = each.groupBy("conv", "key").agg(F.min(F.struct("part", "seq", "at")).alias("first"))
    firsts = firsts.select("conv", "first.*").groupBy(*PLACE).agg(F.collect_list("at").alias("firsts"))
    return slim.join(firsts, PLACE, "left")


def marked(faults: bytes, firsts: list[int] | None) -> bytes:
    """Faults with the duplicates among rows that are not blank."""
    out = np.frombuffer(faults, np.uint8).copy()
    again = np.ones(len(out), bool)
    again[firsts or []] = False
    out[again & (out != BLANK)] = DUPLICATE
    return out.tobytes()


def per_conversation(df: DataFrame, order: list, body: Callable[[Iterator[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """``body`` over the sorted rows of each partition, in which conversations are whole."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                yield from batch.to_pylist()

        ready: list[tuple] = []
        for row in body(rows()):
            ready.append(row)
            if len(ready) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready), types)], names=names)
                ready = []
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready), types)], names=names)

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    return df.repartition("conv").sortWithinPartitions(*order).mapInArrow(run, schema)


FACTS = (
    "conv string, part int, seq int, first_role int, last_role int, blank int, duplicate int, truncated int, illegal int, "
    "first_turn long, last_turn long, distinct_turns long, roles binary, faults binary"
)


def facts_of(chunks: DataFrame) -> DataFrame:
    """Faults, adjacent roles and turns of each chunk alone."""
    arrow = [pa.string()] + [pa.int32()] * 8 + [pa.int64()] * 3 + [pa.binary()] * 2
    names = [c.split()[0] for c in FACTS.split(", ")]
    legal = {b"su", b"ua", b"au"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                roles, faults = row["roles"], marked(row["faults"], row["firsts"])
                turns = [t for t in row["turns"] if t is not None]
                out.append(
                    (row["conv"], row["part"], row["seq"], roles[0], roles[-1], faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT),
                     sum(roles[i : i + 2] not in legal for i in range(len(roles) - 1)),
                     turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), roles, faults)
                )
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow)], names=names)

    return chunks.mapInArrow(run, FACTS)


def with_matrices(chunks: DataFrame) -> DataFrame:
    """``conv, part, seq, costs``: both matrices of a chunk, as an inner one and as the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "roles", BATCH_ROWS):
            roles, faults = batch.column("roles").to_pylist(), batch.column("faults").to_pylist()
            both = [matrices(roles, faults, np.full(len(roles), last)).reshape(-1, 16) for last in (False, True)]
            costs = pa.array(np.concatenate(both, 1).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in PLACE] + [costs], names=[*PLACE, "costs"])

    return chunks.select(*PLACE, "roles", "faults").mapInArrow(run, "conv string, part int, seq int, costs array<long>")


def behind_chunks(rows: Iterator[dict]) -> Iterator[tuple]:
    """Cost from the end of each chunk to that of its conversation; ``first`` and ``last`` mark the ends.

    Chunks come last to first, so one vector is all that is held.
    """
    conv, cost, place = None, None, None
    for row in rows:
        last = row["conv"] != conv
        if place is not None:
            yield (*place, last)
        if last:
            conv = row["conv"]
            cost = np.array([0 if s in ENDS else FAR for s in range(STATES)], np.int64)
        place = (row["conv"], row["part"], row["seq"], cost.tolist(), last)
        matrix = np.array(row["costs"][16:] if last else row["costs"][:16], np.int64).reshape(STATES, STATES)
        cost = np.minimum((matrix + cost[None, :]).min(1), FAR)
    if place is not None:
        yield (*place, True)


EDITS = FACTS.replace(", roles binary", "") + ", exits array<int>, audits array<string>"


def edits_of(chunks: DataFrame) -> DataFrame:
    """Least edits of each chunk, beside its facts, for every state it may be entered in."""
    names = [c.split()[0] for c in EDITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "roles", BATCH_ROWS):
            behind = np.array(batch.column("behind").to_pylist(), np.int64)
            last = np.array(batch.column("last").to_pylist(), bool)
            found = solved(batch.column("roles").to_pylist(), batch.column("faults").to_pylist(), last, behind)
            # A conversation's first chunk is entered in the state of nothing.
            found = [four[:1] if one else four for four, one in zip(found, batch.column("first").to_pylist())]
            exits = pa.array([[e for e, _ in four] for four in found], pa.list_(pa.int32()))
            audits = pa.array([[a.decode() for _, a in four] for four in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:-2]), exits, audits], names=names)

    return chunks.mapInArrow(run, EDITS)


NAMES = {2: b"user", 3: b"assistant"}


def repaired_rows(state: int, audit: str, names: list[str], texts: list[bytes]) -> Iterator[bytes]:
    """``role:text`` of a chunk's rows after its edits."""
    at = 0
    for letter in audit:
        if letter == "I":
            state = int(FITTING[state])
            yield NAMES[state] + b":"
            continue
        if letter == "K":
            role = names[at].encode("utf-8", "replace")
            state = int({"s": SYSTEM, "u": USER, "a": ASSISTANT}[names[at][0]][state])
            yield role + b":" + texts[at]
        elif letter == "R":
            state = int(FITTING[state])
            yield NAMES[state] + b":" + texts[at]
        at += 1


RESULT = (
    "conv string, blank long, duplicate long, truncated long, illegal long, distinct_turns long, "
    "cost long, audit string, repaired_sha256 string"
)


def audit_cost(audit: str) -> int:
    return audit.count("R") * REROLE + audit.count("D") * DELETE + audit.count("I") * INSERT


def finished(rows: Iterator[dict]) -> Iterator[tuple]:
    """One row per conversation from its chunks in order; a chunk's text is hashed and let go."""
    done: dict = {}

    def result() -> tuple:
        audit = "".join(done["audit"])
        counts = [done[n] for n in ("blank", "duplicate", "truncated", "illegal", "distinct_turns")]
        return (done["conv"], *counts, done["cost"], audit, done["hash"].hexdigest())

    edits: dict = {}
    for row in rows:
        if row["kind"] == 0:
            edits = row
            continue
        if not done or done["conv"] != row["conv"]:
            if done:
                yield result()
            done = {"conv": row["conv"], "state": 0, "audit": [], "hash": hashlib.sha256(), "lines": 0, "cost": 0, "role": None, "turn": None}
            done |= {n: 0 for n in ("blank", "duplicate", "truncated", "illegal", "distinct_turns")}
        audit = edits["audits"][done["state"]]
        for line in repaired_rows(done["state"], audit, row["names"], row["texts"]):
            done["hash"].update(b"\n" + line if done["lines"] else line)
            done["lines"] += 1
        # Undeleted truncated rows cost as well.
        kept = [e for e in audit if e != "I"]
        done["cost"] += audit_cost(audit) + TRUNCATED * sum(f == CUT and e != "D" for f, e in zip(edits["faults"], kept))
        done["state"] = edits["exits"][done["state"]]
        done["audit"].append(audit)
        for name in ("blank", "duplicate", "truncated", "illegal", "distinct_turns"):
            done[name] += edits[name]
        if done["role"] is not None:
            done["illegal"] += bytes([done["role"], edits["first_role"]]) not in (b"su", b"ua", b"au")
        if done["turn"] is not None and done["turn"] == edits["first_turn"]:
            done["distinct_turns"] -= 1
        done["role"] = edits["last_role"]
        done["turn"] = edits["last_turn"] if edits["last_turn"] is not None else done["turn"]
    if done:
        yield result()


def repaired(
    turns: DataFrame,
    damage: bool = False,
    chunk_rows: int = CHUNK_ROWS,
    chunk_bytes: int = CHUNK_BYTES,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation.

    ``damage`` first seeds faults (see ``damaged``). Rows go by turn, nulls
    first, then by role and SHA-256 of role and text; repeated rows are repeated
    turns. Null roles and texts are one blank. The first fault of a row counts:
    blank, then duplicate (role and text seen earlier in the conversation), then
    truncated (its last visible character is none of ``.!?``). ``gaps`` counts the
    turn numbers missing between the least and the largest; null if that is
    beyond 64 bits. A null ``conv_id`` is a conversation. One without rows has
    zeros, an empty audit and the hash of an empty text. An empty table gives no
    rows; other columns may have any name.
    """
    given = pick(turns, conv_col, turn_col, role_col, text_col).toDF("conv_id", "turn", "role", "text")
    given = given.withColumn("turn", F.col("turn").cast("long"))
    whole = damaged(given) if damage else given.withColumns(
        {"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" ")), "copy": F.lit(0)}
    )
    chunks = materialize(chunked(whole, chunk_rows, chunk_bytes), "chunks")
    facts = materialize(facts_of(with_duplicates(chunks)), "facts")
    costs = per_conversation(
        with_matrices(facts), ["conv", F.desc("part"), F.desc("seq")], behind_chunks,
        "conv string, part int, seq int, behind array<long>, last boolean, first boolean",
    )
    both = edits_of(facts.join(costs, PLACE)).withColumn("kind", F.lit(0)).unionByName(
        chunks.select(*PLACE, "names", "texts").withColumn("kind", F.lit(1)), allowMissingColumns=True
    )
    done = per_conversation(both, [*PLACE, "kind"], finished, RESULT)

    wide = F.col("turn").cast("decimal(38,0)")
    spans = whole.groupBy(keyed(F.col("conv_id")).alias("conv")).agg((F.max(wide) - F.min(wide) + 1).alias("span"))
    ids = given.select("conv_id").distinct().withColumn("conv", keyed(F.col("conv_id")))
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    gaps = F.when(F.col("span").isNull(), 0).otherwise(F.expr("try_cast(span - distinct_turns AS bigint)"))
    return ids.join(done, "conv", "left").join(spans, "conv", "left").select(
        "conv_id", gaps.alias("gaps"), zero("blank"), zero("duplicate"), zero("truncated"), zero("illegal"), zero("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
