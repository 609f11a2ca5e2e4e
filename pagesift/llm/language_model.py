"""Scores of documents by the pseudo-likelihood of a bidirectional window network.

Every token is masked in turn and predicted from the tokens on both sides. The
network is small and written in numpy: embeddings of the window, one hidden
layer, and a softmax in two steps (the class of a token, then the token within
it), so that all probabilities are normalised. What the network gives a bucket of
words is dealt to the words in it by a table of the counts of all words, which
grows with the corpus. Each Spark task trains on all
its documents from the same start; the results are averaged by tokens, and the
next round starts from the average.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import materialize, pick, slices

CLASSES, MEMBERS = 32, 64
# Last entries are buckets for words that are not listed; the last one is the edge.
BUCKETS = 128
SIDE = 2
EMBEDDING, HIDDEN = 8, 24
ROUNDS, BATCH, SCORED, RATE = 2, 8192, 16384, 0.08
# Of the output weights: with hidden units within 1, logits stay below 80.
BOUND = 3.0
# Distinct words that a task counts before it passes them on.
COUNTED = 300_000
# Tokens of a chunk: documents whose unlisted words are numbered and looked up together.
CHUNK_TOKENS = 1_000_000
CHUNKS, SALTS = 8, 32
# Bytes of a block of memory above all that one batch takes at a time.
BLOCK = 30 << 20
SIZE = CLASSES * MEMBERS
EDGE = SIZE
SHAPES = {
    "embedding": (SIZE + 1, EMBEDDING), "mix": (2 * SIDE * EMBEDDING, HIDDEN), "bias": (HIDDEN,),
    "classes": (HIDDEN, CLASSES), "class_bias": (CLASSES,),
    "members": (CLASSES, HIDDEN, MEMBERS), "member_bias": (CLASSES, MEMBERS),
}
Model = dict[str, np.ndarray]
Groups = list[tuple[int, slice]]


def start_model(seed: int = 7) -> Model:
    draw = np.random.default_rng(seed)
    scale = {"embedding": 0.1, "mix": 0.2, "classes": 0.1, "members": 0.1}
    return {k: (draw.standard_normal(s) * scale.get(k, 0)).astype(np.float32) for k, s in SHAPES.items()}


def flat(model: Model) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in SHAPES])


def shaped(values: np.ndarray) -> Model:
    """The weights in these values; of 32-bit ones they are views."""
    out, at = {}, 0
    for key, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[key] = values[at : at + n].reshape(shape).astype(np.float32, copy=False)
        at += n
    return out


def keep_memory() -> None:
    """Freed blocks of up to this size stay with the process, which is what glibc does once it has seen one freed.

    Else a new process hands its first batches' arrays back to the system each time and
    gets them again as untouched pages.
    """
    np.empty(BLOCK, np.uint8)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def words_in(texts: list[str]) -> pa.ListArray:
    """``words_of`` each text, null for none. Both split at the same characters, and a strip leaves no empty word."""
    return pc.utf8_split_whitespace(pa.array([t.lower().strip() or None for t in texts], pa.large_string()))


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over all texts, counted in each task first."""

    def passed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        counts: Counter = Counter()
        for batch in slices(batches, "text"):
            found = words_in(batch.column("text").to_pylist()).flatten().value_counts()
            for word, n in zip(found.field(0).to_numpy(zero_copy_only=False), found.field(1).to_numpy().tolist()):
                counts[word] += n
            if len(counts) > COUNTED:
                yield passed(counts)
                counts = Counter()
        yield passed(counts)

    # Tasks have counted already: what they pass on is not counted again before the shuffle.
    counted = texts.mapInArrow(run, "word string, n long").repartition("word")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary_of(counts: DataFrame) -> dict[str, int]:
    """The most frequent words, in order, and their counts: a fixed number of rows, ties by word."""
    return {r["word"]: r["n"] for r in counts.orderBy(F.desc("n"), "word").limit(SIZE - BUCKETS).collect()}


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


class Shares:
    """How the words of a bucket share its probability.

    A word that was counted ``n`` times has ``n / (N + T + 1)``, where the bucket's
    words have ``N`` tokens and ``T`` distinct ones. What is left, ``T + 1`` parts,
    goes to words that were never counted, each by its length in bytes: every
    byte, and the end, has a chance of 1 in 257.
    """

    def __init__(self, counts: DataFrame, listed: dict[str, int]) -> None:
        self.number = F.crc32(F.col("word").cast("binary")) % BUCKETS
        tokens, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
        found = counts.groupBy(self.number.alias("b")).agg(F.sum("n").alias("n"), F.count("n").alias("kinds"))
        for row in found.collect():
            tokens[row["b"]], kinds[row["b"]] = row["n"], row["kinds"]
        for word, n in listed.items():
            tokens[bucket(word)] -= n
            kinds[bucket(word)] -= 1
        self.counts, self.total, self.rest = counts, np.log(tokens + kinds + 1), np.log(kinds + 1)

    def of_bucket(self, values: np.ndarray) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])[self.number.cast("int")]

    def of(self, words: DataFrame) -> DataFrame:
        """``words`` and the logarithm ``share`` of each one's part of its bucket."""
        unseen = self.of_bucket(self.rest) - (F.octet_length("word") + 1) * F.lit(float(np.log(257)))
        part = F.coalesce(F.log("n"), unseen) - self.of_bucket(self.total)
        # A word is one row of the counts, so no partition of theirs is skewed, and their
        # part of a partition is held while the words, which are many more, go by unsorted.
        return words.join(self.counts.hint("shuffle_hash"), "word", "left").withColumn("share", part).drop("n")


class Codes(dict):
    """Codes of words: the number of a listed one, others from ``SIZE`` on as they are first asked for."""

    def __init__(self, known: dict[str, int]) -> None:
        super().__init__(known)
        self.listed = len(known)
        self.buckets = np.empty(0, "<u2")

    def __missing__(self, word: str) -> int:
        code = self[word] = SIZE + len(self) - self.listed
        return code

    def unlisted(self, start: int = 0) -> list[str]:
        return [*islice(self, self.listed + start, None)]

    def coded(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Of each text the numbers of its words, and the places of the unlisted ones."""
        found = words_in(texts)
        # A word is looked up once, however often it comes.
        words = found.flatten().dictionary_encode()
        kinds = words.dictionary.to_numpy(zero_copy_only=False)
        codes = np.fromiter(map(self.__getitem__, kinds), "<u4", len(kinds))
        fresh = [SIZE - BUCKETS + bucket(w) for w in self.unlisted(len(self.buckets))]
        self.buckets = np.concatenate([self.buckets, np.array(fresh, "<u2")])
        other = codes >= SIZE
        numbers = codes.astype("<u2")
        numbers[other] = self.buckets[codes[other] - np.uint32(SIZE)]
        at = words.indices.to_numpy()
        codes = np.take(codes, at)
        other = codes >= SIZE
        ends = np.cumsum([0, *found.value_lengths().fill_null(0).to_pylist()])
        return cut(np.take(numbers, at), ends), cut(codes[other] - np.uint32(SIZE), np.r_[0, np.cumsum(other)][ends])


def cut(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [values[a:b].tobytes() for a, b in pairwise(ends.tolist())]


def numbered(rows: DataFrame, known: dict[str, int]) -> DataFrame:
    """Documents in chunks, written once for all rounds and the scores.

    A document's row has its ``tokens`` (16-bit numbers) and ``unlisted``, the
    places of its unlisted words (32-bit) in the chunk's ``words``, which are a
    row of their own without tokens.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        chunk, held, codes = TaskContext.get().partitionId() << 32, 0, Codes(known)
        doc_type = None

        def made(ids: pa.Array, tokens: list, unlisted: list, words: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    ids, pa.array([chunk] * len(ids), pa.int64()), pa.array(tokens, pa.binary()),
                    pa.array(unlisted, pa.binary()), pa.array(words, pa.list_(pa.string())),
                ],
                names=["doc_id", "chunk", "tokens", "unlisted", "words"],
            )

        for batch in slices(batches, "text"):
            doc_type = batch.column("doc_id").type
            tokens, unlisted = codes.coded(batch.column("text").to_pylist())
            held += sum(map(len, tokens)) // 2
            yield made(batch.column("doc_id"), tokens, unlisted, [None] * len(tokens))
            if len(codes.buckets) > COUNTED or held > CHUNK_TOKENS:
                yield made(pa.nulls(1, doc_type), [None], [None], [codes.unlisted()])
                chunk, held, codes = chunk + 1, 0, Codes(known)
        if len(codes.buckets):
            yield made(pa.nulls(1, doc_type), [None], [None], [codes.unlisted()])

    kinds = f"doc_id {kind}, chunk long, tokens binary, unlisted binary, words array<string>"
    return materialize(rows.mapInArrow(run, kinds), "tokens")


class Sequence:
    """Tokens of many documents with edges between them."""

    def __init__(self, documents: list[bytes]) -> None:
        edge = np.full(SIDE, EDGE, "<u2").tobytes()
        self.sizes = [len(d) // 2 for d in documents]
        self.tokens = np.frombuffer(edge + b"".join(d + edge for d in documents), "<u2")
        self.places = np.flatnonzero(self.tokens != EDGE)
        # The windows lie side by side: training takes them in random order, each from one place.
        n = len(self.tokens)
        self.around = np.empty((n, 2 * SIDE), "<u2")
        for i, o in enumerate(o for o in range(-SIDE, SIDE + 1) if o):
            self.around[SIDE : n - SIDE, i] = self.tokens[SIDE + o : n - SIDE + o]

    def windows(self, places: np.ndarray) -> np.ndarray:
        return np.take(self.around, places, axis=0)


def spots(targets: np.ndarray, width: int) -> np.ndarray:
    """Where the targets lie in flat logits with rows of this width."""
    return np.arange(0, len(targets) * width, width) + targets


def sorted_by_token(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the flat windows by token, in order; the tokens that occur, and where each begins."""
    at = windows.ravel()
    bits = len(at).bit_length()
    # Token and place in one number: these are distinct, so that a plain sort keeps the order.
    kind = np.uint32 if bits + SIZE.bit_length() <= 32 else np.uint64
    keys = at.astype(kind) << kind(bits)
    keys |= np.arange(len(at), dtype=kind)
    keys.sort()
    order = keys & kind((1 << bits) - 1)
    keys >>= kind(bits)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return order, keys[starts], starts


def totals(values: np.ndarray, groups: Groups) -> np.ndarray:
    """Sums of the rows. Each group is summed by itself, so that its sums do not hang on where it lies."""
    out, ones = np.empty(len(values), np.float32), np.ones(values.shape[1], np.float32)
    for _, rows in groups:
        np.matmul(values[rows], ones, out=out[rows])
    return out


def log_softmax_at(logits: np.ndarray, at: np.ndarray, groups: Groups) -> np.ndarray:
    """Overwrites the logits. They are bounded (see ``BOUND``), so nothing overflows."""
    wanted = np.take(logits, at)
    np.exp(logits, out=logits)
    return wanted - np.log(totals(logits, groups))


def output(h: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    logits = h @ weights
    logits += bias
    return logits


def hidden(model: Model, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inputs = np.take(model["embedding"], windows, axis=0).reshape(len(windows), -1)
    h = inputs @ model["mix"]
    h += model["bias"]
    return inputs, np.tanh(h, out=h)


def member_logits(model: Model, h: np.ndarray, classes: Groups) -> np.ndarray:
    """Of rows in order of classes: the logits of the members of each row's class."""
    logits = np.empty((len(h), MEMBERS), np.float32)
    for c, rows in classes:
        some = logits[rows]
        np.matmul(h[rows], model["members"][c], out=some)
        some += model["member_bias"][c]
    return logits


def sorted_by_class(targets: np.ndarray) -> tuple[np.ndarray, Groups]:
    """An order of the rows, and where each class that occurs then lies."""
    groups = (targets // MEMBERS).astype(np.uint16, copy=False)
    order = np.argsort(groups, kind="stable")
    starts = np.searchsorted(groups[order], np.arange(CLASSES + 1))
    return order, [(c, slice(a, b)) for c, (a, b) in enumerate(zip(starts, starts[1:])) if a < b]


def log_probabilities(model: Model, windows: np.ndarray, targets: np.ndarray) -> np.ndarray:
    order, classes = sorted_by_class(targets)
    targets = targets[order]
    _, h = hidden(model, np.take(windows, order, axis=0))
    all_rows = [(0, slice(None))]
    out = log_softmax_at(output(h, model["classes"], model["class_bias"]), spots(targets // MEMBERS, CLASSES), all_rows)
    out += log_softmax_at(member_logits(model, h, classes), spots(targets % MEMBERS, MEMBERS), classes)
    back = np.empty_like(out)
    back[order] = out
    return back


def errors(logits: np.ndarray, at: np.ndarray, groups: Groups) -> np.ndarray:
    """Probabilities less one at the targets."""
    np.exp(logits, out=logits)
    logits /= totals(logits, groups)[:, None]
    logits.reshape(-1)[at] -= 1
    return logits


def gradients(model: Model, windows: np.ndarray, targets: np.ndarray) -> Model:
    return shaped(flat_gradients(model, windows, targets))


def flat_gradients(model: Model, windows: np.ndarray, targets: np.ndarray) -> np.ndarray:
    n = len(targets)
    order, classes = sorted_by_class(targets)
    targets, windows = targets[order], np.take(windows, order, axis=0)
    inputs, h = hidden(model, windows)
    ones = np.ones(n, np.float32)
    whole = np.zeros(sum(v.size for v in model.values()), np.float32)
    out = shaped(whole)
    logits = output(h, model["classes"], model["class_bias"])
    error = errors(logits, spots(targets // MEMBERS, CLASSES), [(0, slice(None))])
    out["classes"][:], out["class_bias"][:] = h.T @ error, ones @ error
    back = error @ model["classes"].T
    member_errors = errors(member_logits(model, h, classes), spots(targets % MEMBERS, MEMBERS), classes)
    for c, rows in classes:
        inner = member_errors[rows]
        out["members"][c], out["member_bias"][c] = h[rows].T @ inner, ones[rows] @ inner
        back[rows] += inner @ model["members"][c].T
    h *= h
    back *= np.subtract(1, h, out=h)
    out["mix"][:], out["bias"][:] = inputs.T @ back, ones @ back
    down = (back @ model["mix"].T).reshape(-1, EMBEDDING)
    order, tokens, starts = sorted_by_token(windows)
    out["embedding"][tokens] = np.add.reduceat(np.take(down, order, axis=0), starts, axis=0)
    whole /= n
    return whole


class Trainer:
    """Steps scaled by the root of the summed squares of each weight's gradients."""

    def __init__(self, model: Model) -> None:
        self.weights = flat(model)
        self.model = shaped(self.weights)
        self.squares = np.full_like(self.weights, 1e-8)
        self.tokens = 0

    def learn(self, sequence: Sequence, batch: int = BATCH) -> None:
        draw = np.random.default_rng(self.tokens)
        places = draw.permutation(sequence.places)
        # Few tokens make small steps, so that there are some.
        batch = max(64, min(batch, len(places) // 64))
        held = np.empty_like(self.weights)
        for i in range(0, len(places), batch):
            some = places[i : i + batch]
            g = flat_gradients(self.model, sequence.windows(some), sequence.tokens[some])
            self.squares += np.multiply(g, g, out=held)
            g *= RATE
            g /= np.sqrt(self.squares, out=held)
            self.weights -= g
            for k in ("classes", "class_bias", "members", "member_bias"):
                np.clip(self.model[k], -BOUND, BOUND, out=self.model[k])
        self.tokens += len(places)


def train_round(rows: DataFrame, model: Model) -> Model | None:
    """One pass over the tokens of all documents; the average of the tasks' models, weighted by tokens.

    The sums go over two levels of groups, so that none holds a row for each
    task. What comes back is one model, whatever the number of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        trainer = Trainer(model)
        for batch in slices(batches, "tokens"):
            trainer.learn(Sequence(batch.column("tokens").to_pylist()))
        if trainer.tokens:
            weighted = np.array_split(flat(trainer.model).astype(np.float64) * trainer.tokens, CHUNKS)
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array(range(CHUNKS), pa.int32()), "task": pa.array([task] * CHUNKS, pa.int32()),
                    "tokens": pa.array([trainer.tokens] * CHUNKS, pa.int64()),
                    "data": pa.array([c.tobytes() for c in weighted], pa.binary()),
                }
            )

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("task", kind="stable")
        total = np.sum([np.frombuffer(d) for d in rows["data"]], axis=0)
        first = rows.iloc[:1].copy()
        first["tokens"], first["data"] = int(rows["tokens"].sum()), [total.tobytes()]
        return first

    kinds = "chunk int, task int, tokens long, data binary"
    rows = rows.select("tokens").mapInArrow(run, kinds).withColumn("salt", F.col("task") % SALTS)
    some = rows.groupBy("chunk", "salt").applyInPandas(lambda g: summed(g.drop(columns="salt")), kinds)
    parts = sorted(some.groupBy("chunk").applyInPandas(summed, kinds).collect(), key=lambda r: r["chunk"])
    if not parts:
        return None
    return shaped(np.concatenate([np.frombuffer(r["data"]) / r["tokens"] for r in parts]))


def sums_of(values: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Sums of runs of these lengths."""
    return np.diff(np.r_[0.0, np.cumsum(values)][np.cumsum([0, *sizes])])


def scored(
    docs: DataFrame, trained_on: DataFrame | None = None, rounds: int = ROUNDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_tokens, log_prob, mean_log_prob`` of each row.

    Tokens are words in lower case. The counts of words and the network come from
    all texts of ``trained_on`` (the documents themselves, if none are given). A text
    without words has no tokens, the sum 0 and a null mean. Each token is scored
    as itself: the network predicts a listed word or the bucket of an unlisted
    one, and ``Shares`` the word within the bucket. In the window around a token,
    unlisted words are their buckets. Null ids and repeated rows stay; a repeated
    text counts each time in training. No documents to train on leave the network
    as it starts. An empty table gives no rows. The network has a fixed size and is
    sent to all tasks; the counts of words are a table that grows with the texts
    and is joined to the words of each chunk.
    """
    prepared = lambda df: df.withColumn("text", F.coalesce("text", F.lit("")))
    rows = prepared(pick(docs, id_col, text_col).toDF("doc_id", "text"))
    source = rows if trained_on is None else prepared(pick(trained_on, id_col, text_col).toDF("doc_id", "text"))
    counts, model = materialize(word_counts(source.select("text")), "word_counts"), start_model()
    listed = vocabulary_of(counts)
    known = {word: i for i, word in enumerate(listed)}
    tokens = numbered(rows, known)
    learned = tokens if trained_on is None else numbered(source, known)
    for _ in range(rounds):
        model = train_round(learned.filter(F.col("tokens").isNotNull()), model) or model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        for batch in slices(batches, "tokens"):
            sequence = Sequence(batch.column("tokens").to_pylist())
            out = np.zeros(len(sequence.places))
            for i in range(0, len(out), SCORED):
                some = sequence.places[i : i + SCORED]
                out[i : i + SCORED] = log_probabilities(model, sequence.windows(some), sequence.tokens[some])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("chunk"), pa.array(sequence.sizes, pa.int64()),
                    pa.array(sums_of(out, sequence.sizes)), batch.column("unlisted"),
                ],
                names=["doc_id", "chunk", "n_tokens", "log_prob", "unlisted"],
            )

    def completed(docs: pa.Table, words: pa.Table) -> pa.Table:
        shares = np.zeros(len(words))
        shares[words.column("place").to_numpy()] = words.column("share").to_numpy()
        unlisted = docs.column("unlisted").to_pylist()
        parts = sums_of(shares[np.frombuffer(b"".join(unlisted), "<u4")], [len(u) // 4 for u in unlisted])
        sums, sizes = docs.column("log_prob").to_numpy() + parts, docs.column("n_tokens").to_pylist()
        means = [s / n if n else None for s, n in zip(sums.tolist(), sizes)]
        return pa.table(
            [docs.column("doc_id"), docs.column("n_tokens"), pa.array(sums), pa.array(means, pa.float64())],
            names=["doc_id", "n_tokens", "log_prob", "mean_log_prob"],
        )

    kind = rows.schema["doc_id"].dataType.simpleString()
    docs = tokens.filter(F.col("tokens").isNotNull()).select("doc_id", "chunk", "tokens", "unlisted")
    docs = docs.mapInArrow(run, f"doc_id {kind}, chunk long, n_tokens long, log_prob double, unlisted binary")
    words = tokens.filter(F.col("words").isNotNull()).select("chunk", F.posexplode("words").alias("place", "word"))
    words = Shares(counts, listed).of(words).select("chunk", "place", "share")
    both = docs.groupBy("chunk").cogroup(words.groupBy("chunk"))
    return both.applyInArrow(completed, f"doc_id {kind}, n_tokens long, log_prob double, mean_log_prob double")
