"""Packing by lexical retrieval: BM25 neighbours of a seed fill its window.

A document's full windows are sequences of their own. What remains of each
document, less than a window, goes to a shard with an inverted index of its
documents, each with the terms of its whole text. There a seed opens a window,
its unused neighbours by BM25 fill it in falling order of score, and the last one
is cut to fit; the rest of that one is the next seed. So every window of a shard
but the last is full. All terms of a seed's document are looked up.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import pick, slices, vocabulary

TOKENIZER = "byte_bpe_50k.json"
WINDOW = 1024
END = 0
# Documents of a shard. A shard is one task's group of at most a few MB.
SHARD_DOCS = 2048
# Terms in at least this share of a shard's documents have a row of weights instead
# of postings. Both give the same scores; a row is faster for terms that most hold.
ROW_SHARE = 1 / 8
K1, B = 1.2, 0.75

PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """The vocabulary file as a byte-pair encoder; its special strings have their ids."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab, symbols = spec["model"]["vocab"], byte_symbols()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(symbols[c] for c in token): i for token, i in vocab.items() if token not in special}
    # Ids must follow the order of the merges for the ranks to be ids.
    first = len(ranks) - len(spec["model"]["merges"])
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    if any(vocab[a + b] != first + i for i, (a, b) in enumerate(pairs)):
        raise ValueError("ids don't follow the merges")
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def terms_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a document, rising, and how often each is in it."""
    return np.unique(ids, return_counts=True)


class Index:
    """BM25 over the documents of a shard: terms and frequencies of each."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], row_share: float = ROW_SHARE) -> None:
        n = self.n = len(docs)
        sizes = np.array([len(terms) for terms, _ in docs], np.int64)
        self.terms, own = np.unique(np.concatenate([terms for terms, _ in docs]), return_inverse=True)
        counts = np.concatenate([c for _, c in docs]).astype(float)
        holders = np.repeat(np.arange(n), sizes)
        lengths = np.bincount(holders, counts, n)
        df = np.bincount(own, minlength=len(self.terms))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(lengths.mean(), 1))
        weight = idf[own] * counts * (K1 + 1) / (counts + norm[holders])
        # Terms of each document, as places in the shard's list of terms.
        self.of_doc = np.split(own, np.cumsum(sizes)[:-1])
        common = df >= max(1, row_share * n)
        self.row_of = np.where(common, np.cumsum(common) - 1, -1)
        self.rows = np.zeros((int(common.sum()), n))
        in_row = common[own]
        self.rows[self.row_of[own[in_row]], holders[in_row]] = weight[in_row]
        # Postings of the others, by term and document.
        rare = np.flatnonzero(~in_row)
        rare = rare[np.argsort(own[rare], kind="stable")]
        self.docs, self.weight = holders[rare], weight[rare]
        self.sizes = np.where(common, 0, df)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def scores(self, doc: int) -> np.ndarray:
        """Of every document of the shard, for all terms of one of them."""
        terms = self.of_doc[doc]
        sizes = self.sizes[terms]
        places = np.repeat(self.starts[terms] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        found = np.bincount(self.docs[places], self.weight[places], self.n)
        common = self.row_of[terms]
        return found + self.rows[common[common >= 0]].sum(axis=0)


def fill(
    tails: list[np.ndarray], window: int, terms: list[tuple[np.ndarray, np.ndarray]] | None = None
) -> Iterator[tuple[int, int, int, int, int]]:
    """Document, start in its remainder, length, sequence and offset of each piece.

    ``terms`` are those of the whole documents; without it, of the remainders.
    """
    index = Index(terms if terms is not None else [terms_of(t) for t in tails])
    unused = np.ones(len(tails), bool)
    first = 0
    seed, begin, sequence = -1, 0, 0
    while True:
        if seed < 0:
            while first < len(tails) and not unused[first]:
                first += 1
            if first == len(tails):
                return
            seed, begin = first, 0
            unused[seed] = False
        room = window
        take = len(tails[seed]) - begin
        yield seed, begin, take, sequence, 0
        room -= take
        rest = (-1, 0)
        if room:
            scores = np.where(unused, index.scores(seed), -1.0)
            while room:
                best = int(scores.argmax())
                if scores[best] < 0:
                    break
                scores[best], unused[best] = -1.0, False
                take = min(room, len(tails[best]))
                yield best, 0, take, sequence, window - room
                room -= take
                if take < len(tails[best]):
                    rest = (best, take)
        seed, begin = rest
        sequence += 1


def tokenized(docs: DataFrame, tokenizer: str | None, window: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: token count, checksums of its full windows, ids of the remainder.

    If there are both, also the terms of the whole document and their frequencies;
    else they are those of the remainder.
    """
    path = tokenizer or vocabulary(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches, "text"):
            counts, fulls, tails, terms, times = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = np.array([*encode.encode(text, allowed_special="all"), END], np.uint32)
                cut = len(ids) - len(ids) % window
                counts.append(len(ids))
                fulls.append([crc(ids[i : i + window]) for i in range(0, cut, window)])
                tails.append(ids[cut:].tobytes())
                held, often = terms_of(ids) if 0 < cut < len(ids) else (ids[:0], ids[:0])
                terms.append(held.astype(np.uint32).tobytes())
                times.append(often.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("row"), pa.array(counts, pa.int64()),
                    pa.array(fulls, pa.list_(pa.int64())), pa.array(tails, pa.binary()),
                    pa.array(terms, pa.binary()), pa.array(times, pa.binary()),
                ],
                names=["doc_id", "row", "doc_tokens", "fulls", "tail", "terms", "times"],
            )

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    # The row's place in the files: tells repeated rows and null ids apart.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, row long, doc_tokens long, fulls array<long>, tail binary, terms binary, times binary")


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    window: int = WINDOW,
    shard_docs: int = SHARD_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All texts cut and packed into sequences of at most ``window`` tokens.

    Returns a row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``; a sequence's offsets have no gaps. A document is its
    ids and a closing 0, so a null or empty text is that one id. Repeated rows
    and rows with a null id are packed each time; equal scores go to the row
    that comes first. Only each shard's last sequence may be short. Sequence
    ids are unique, not dense. The rows are counted once to set the number of
    shards; each holds about ``shard_docs`` rows, dealt by a hash of the row's
    place, so no key can crowd one. An empty table gives no rows.
    """
    shards = max(1, -(-docs.count() // shard_docs))
    rows = tokenized(docs, tokenizer, window, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))

    def fill_shard(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", kind="stable").reset_index(drop=True)
        out: list[tuple] = []
        sequence = int(key[0]) << 36
        ids, tokens = group["doc_id"].array, group["doc_tokens"].to_numpy()
        held, tails, terms = [], [], []
        for i, (fulls, tail, whole, times) in enumerate(zip(group["fulls"], group["tail"], group["terms"], group["times"])):
            for j, check in enumerate(fulls):
                out.append((i, j * window, window, check, sequence, 0))
                sequence += 1
            if tail:
                held.append(i)
                tails.append(np.frombuffer(tail, np.uint32))
                own = (np.frombuffer(whole, np.uint32), np.frombuffer(times, np.uint32))
                terms.append(own if whole else terms_of(tails[-1]))
        for t, begin, take, local, offset in fill(tails, window, terms) if tails else ():
            i, tail = held[t], tails[t]
            start = int(tokens[i]) - len(tail) + begin
            out.append((i, start, take, crc(tail[begin : begin + take]), sequence + local, offset))
        place, start, length, check, number, offset = map(list, zip(*out))
        return pd.DataFrame(
            {
                "doc_id": ids.take(place), "start": start, "length": length, "ids_crc32": check,
                "doc_tokens": tokens[place], "sequence_id": number, "offset": offset,
            }
        )

    return rows.groupBy("shard").applyInPandas(fill_shard, PIECES.format(id=kind))
