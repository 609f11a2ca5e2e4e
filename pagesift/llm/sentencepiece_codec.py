"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

The pieces of a model file and their scores form a unigram lattice. Equal words
of a batch are searched once, and words of equal length advance together: at
each end position the hashes of all substrings that end there are looked up in
the sorted hashes of the pieces, and the best way to get there is a maximum
over the starts, kept as a backpointer. A hit is compared with the piece itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import pick, slices, vocabulary

MODEL = "piece_bpe_32k.model"
MARK = "▁"
FACTOR = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN_PENALTY = 10.0
# Fixed value: what the library writes for an unknown piece.
UNKNOWN_SURFACE = " ⁇ "
# Words remembered by a worker; beyond that it starts anew. Results don't change.
REMEMBERED = 500_000
# Characters of the words that advance together.
CELLS = 1 << 20


def code_points(words: list[str]) -> np.ndarray:
    """A row of code points for each word; all words have the same length."""
    data = "".join(words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, np.uint32).reshape(len(words), -1)


def run_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of each prefix, the empty one first."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * FACTOR + codes[:, i] + np.uint64(1)
    return out


class Pieces:
    """Pieces of one length, sorted by hash."""

    def __init__(self, entries: list[tuple[str, float, int]]) -> None:
        codes = code_points([piece for piece, _, _ in entries])
        keys = run_hashes(codes)[:, -1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.codes = keys[order], codes[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have the same hash")
        self.scores = np.array([s for _, s, _ in entries], np.float64)[order]
        self.ids = np.array([i for _, _, i in entries], np.int32)[order]

    def find(self, keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of substrings that are pieces, and which ones."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        rows = np.flatnonzero(self.keys[at] == keys)
        found = at[rows]
        same = (self.codes[found] == codes[rows]).all(1)
        return rows[same], found[same]

    def has(self, keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        out[self.find(keys, codes)[0]] = True
        return out


class Codec:
    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        normalizer, trainer = proto.normalizer_spec, proto.trainer_spec
        if normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces:
            raise ValueError("only models without normalisation are understood")
        if trainer.treat_whitespace_as_suffix or not normalizer.escape_whitespaces or trainer.user_defined_symbols:
            raise ValueError("only models that mark the start of a word are understood")
        self.prefix = MARK if normalizer.add_dummy_prefix else ""
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        normal = [(p.piece, p.score, i) for i, p in enumerate(proto.pieces) if p.type == 1]
        if any(MARK in piece.lstrip(MARK) for piece, _, _ in normal):
            raise ValueError("a piece goes over the start of a word")
        byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_ids = [byte_ids[b] for b in range(256)] if trainer.byte_fallback else None
        self.unknown_score = min(s for _, s, _ in normal) - UNKNOWN_PENALTY
        self.longest = max(len(p) for p, _, _ in normal)
        # Pieces that start a word, and those within one, by length.
        groups: dict[tuple[bool, int], list[tuple[str, float, int]]] = {}
        for entry in normal:
            groups.setdefault((entry[0].startswith(MARK), len(entry[0])), []).append(entry)
        self.tables = {key: Pieces(entries) for key, entries in groups.items()}
        self.pieces = [p.piece for p in proto.pieces]
        self.surfaces = [self._surface(p, i) for i, p in enumerate(proto.pieces)]
        self.byte_values = {i: b for b, i in byte_ids.items()}
        # A line break that is in no piece stands alone.
        apart = "" if any("\n" in piece for piece, _, _ in normal) else "\n"
        self.words = re.compile(f"{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+|\n")
        self.powers = np.array([pow(int(FACTOR), i, 1 << 64) for i in range(self.longest + 1)], np.uint64)
        self.seen: dict[str, bytes] = {}

    def _surface(self, piece, i: int) -> bytes:
        if piece.type == 6:
            return bytes([int(piece.piece[3:5], 16)])
        if piece.type == 3:
            return b""
        if piece.type == 2:
            return UNKNOWN_SURFACE.encode()
        return piece.piece.replace(MARK, " ").encode("utf-8", "surrogatepass")

    def search(self, words: list[str]) -> list[bytes]:
        """Ids (as int32) of words of one length, with the same number of marks in front."""
        codes = code_points(words)
        n, length = codes.shape
        marks = len(words[0]) - len(words[0].lstrip(MARK))
        hashes = run_hashes(codes)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0.0
        back = np.zeros((length + 1, n), np.int32)
        piece = np.full((length + 1, n), -1, np.int32)
        for end in range(1, length + 1):
            # Longest first: of equal sums the piece that starts first is taken.
            for start in range(max(0, end - self.longest), end):
                pieces = self.tables.get((start < marks, end - start))
                if pieces is not None:
                    key = hashes[:, end] - hashes[:, start] * self.powers[end - start]
                    rows, found = pieces.find(key, codes[:, start:end])
                    sums = best[start, rows] + pieces.scores[found]
                    better = sums > best[end, rows]
                    rows, found = rows[better], found[better]
                    best[end, rows] = sums[better]
                    back[end, rows], piece[end, rows] = start, pieces.ids[found]
                if start == end - 1:
                    # A character that is no piece is unknown.
                    none = np.ones(n, bool)
                    if pieces is not None:
                        none = ~pieces.has(key, codes[:, start:end])
                    rows = np.flatnonzero(none & (best[start] + self.unknown_score > best[end]))
                    best[end, rows] = best[start, rows] + self.unknown_score
                    back[end, rows], piece[end, rows] = start, -1
        return self._traced(words, back, piece)

    def _traced(self, words: list[str], back: np.ndarray, piece: np.ndarray) -> list[bytes]:
        """Follows the backpointers of all words at once; ids in the order of the text."""
        each, none = np.arange(len(words)), np.int32(-2)
        at = np.full(len(words), len(back) - 1)
        steps = []
        while at.any():
            steps.append(np.where(at > 0, piece[at, each], none))
            at = back[at, each]
        table = np.ascontiguousarray(np.array(steps[::-1], np.int32).T)
        width, data = 4 * table.shape[1], table.tobytes()
        skips = (4 * (table == none).sum(1)).tolist()
        out = [data[w * width + skip : (w + 1) * width] for w, skip in enumerate(skips)]
        for w in np.flatnonzero((table == -1).any(1)):
            ids = np.frombuffer(out[w], np.int32).tolist()
            out[w] = np.array(self._spelled(words[w], ids), np.int32).tobytes()
        return out

    def _spelled(self, word: str, ids: list[int]) -> list[int]:
        """Bytes, or the unknown piece, in place of characters that are no piece."""
        out, at = [], 0
        for i in ids:
            if i >= 0:
                out.append(i)
                at += len(self.pieces[i])
                continue
            if self.byte_ids:
                out += [self.byte_ids[b] for b in word[at].encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at += 1
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(data, np.int32).tolist() for data in self.encode_bytes(texts)]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as int32."""
        seen = self.seen
        if len(seen) > REMEMBERED:
            seen.clear()
        split = [self.words.findall(self.prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        new: dict[tuple[int, int], list[str]] = {}
        for word in set().union(*split):
            if word not in seen:
                new.setdefault((len(word), len(word) - len(word.lstrip(MARK))), []).append(word)
        for (length, _), words in new.items():
            step = max(1, CELLS // (length + 1))
            for i in range(0, len(words), step):
                some = words[i : i + step]
                seen.update(zip(some, self.search(some)))
        out = [b"".join(map(seen.__getitem__, words)) for words in split]
        for (length, _), words in new.items():
            if length >= 64:
                for word in words:
                    del seen[word]
        return out if self.byte_ids else [self._merged(data) for data in out]

    def _merged(self, data: bytes) -> bytes:
        """Neighbouring unknown pieces as one."""
        ids = np.frombuffer(data, np.int32)
        again = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[np.r_[True, ~again][: len(ids)]].tobytes()

    def decode(self, ids: list[int]) -> str:
        data = b"".join([self.surfaces[i] for i in ids])
        text = data.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int) of each row; no shuffle.

    A null or empty text has no ids. Null ids and repeated rows stay; other
    columns are ignored. A word without white space of any length is one search
    of its own. An empty table gives no rows.
    """
    path = model or vocabulary(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode_bytes
        for batch in slices(batches, "text"):
            ids = encode(batch.column("text").to_pylist())
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            flat = np.frombuffer(b"".join(ids), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def round_trip(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_ids, decoded_sha256, same``: each text encoded and decoded again.

    ``decoded_sha256`` is of the text that the ids give, ``same`` whether that is
    the text; only a U+2581 in a text makes a difference, as it decodes to a
    blank. Encoding as in ``encoded``, decoding as in ``decoded``; both in one
    pass, since rows need not have an id to be joined by. A null text counts as
    empty. Null ids and repeated rows stay; an empty table gives no rows.
    """
    path = model or vocabulary(MODEL)
    numbers = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = codec(path)
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            coded = [np.frombuffer(data, np.int32) for data in tools.encode_bytes(texts)]
            offsets = np.cumsum([0, *map(len, coded)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded))).cast(numbers)
            back = [tools.decode(ids.tolist()) for ids in coded]
            digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), lists, pa.array(map(len, coded), pa.int64()), pa.array(digests, pa.string()),
                    pa.array([a == b for a, b in zip(back, texts)], pa.bool_()),
                ],
                names=["doc_id", "ids", "n_ids", "decoded_sha256", "same"],
            )

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_ids long, decoded_sha256 string, same boolean")


def decoded(rows: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of each row of ids.

    Null ids arrays give a null text, null elements are skipped, and ids outside
    the vocabulary are an error. Byte pieces that are no UTF-8 become U+FFFD.
    """
    path = model or vocabulary(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for batch in batches:
            texts = [None if x is None else decode([i for i in x if i is not None]) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    picked = pick(rows, id_col, ids_col).toDF("doc_id", "ids")
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, text string")
