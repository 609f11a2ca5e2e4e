"""Token counts by byte-pair merging with a heap over a linked list.

Pieces never cross the start of a word (white space is marked at the front of
a word and the vocabulary is checked for that), so a text's count is the sum
over its words, and equal words are merged once per worker.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import pick, slices, vocabulary

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"
# Words remembered by a worker; beyond that it starts anew. Results don't change.
REMEMBERED = 400_000


class MergeCounter:
    """Counts the pieces of one model; holds ranks only, never identifiers."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        normalizer, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != 2 or normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces:
            raise ValueError("only byte-pair models without normalisation are understood")
        if trainer.treat_whitespace_as_suffix or not normalizer.escape_whitespaces or trainer.user_defined_symbols:
            raise ValueError("only models that mark the start of a word are understood")
        normal = [p for p in proto.pieces if p.type == 1]
        if any(p.type not in (1, 2, 3, 6) for p in proto.pieces):
            raise ValueError("only models without unused or user-defined pieces are understood")
        # The best score is popped first: the rank is the negated score.
        self.ranks = {p.piece: -p.score for p in normal}
        self.prefix = MARK if normalizer.add_dummy_prefix else ""
        self.byte_fallback = trainer.byte_fallback
        if any(MARK in p.piece.lstrip(MARK) for p in normal):
            raise ValueError("a piece goes over the start of a word")
        # A character that only stands alone or is unknown ends a word as well.
        apart = "" if any("\n" in p.piece and len(p.piece) > 1 for p in normal) else "\n"
        self.words = re.compile(f"{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+|\n")
        self.seen: dict[str, int] = {}

    def _weight(self, symbol: str) -> int:
        if symbol in self.ranks:
            return 1
        return len(symbol.encode("utf-8", "surrogatepass")) if self.byte_fallback else 1

    def merge(self, word: str) -> int:
        """Initial symbols (bytes for unknown characters) minus merges.

        Where the model has no byte pieces, neighbouring unknown characters are
        one unknown token.
        """
        ranks = self.ranks
        symbols: list[str] = list(word)
        n = len(symbols)
        count = sum(map(self._weight, symbols))
        if not self.byte_fallback:
            unknown = [s not in ranks for s in symbols]
            count -= sum(a and b for a, b in zip(unknown, unknown[1:]))
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            rank = ranks.get(word[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 1, 2))
        heapq.heapify(heap)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            # A pair is stale when either side has been merged since.
            if not symbols[left] or not symbols[right] or after[left] != right:
                continue
            joined = symbols[left] + symbols[right]
            if len(joined) != size:
                continue
            symbols[left], symbols[right] = joined, ""
            count -= 1
            far = after[left] = after[right]
            if far >= 0:
                before[far] = left
                rank = ranks.get(joined + symbols[far])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, far, len(joined) + len(symbols[far])))
            near = before[left]
            if near >= 0:
                rank = ranks.get(symbols[near] + joined)
                if rank is not None:
                    heapq.heappush(heap, (rank, near, left, len(symbols[near]) + len(joined)))
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        seen, total = self.seen, 0
        if len(seen) > REMEMBERED:
            seen.clear()
        for word, times in Counter(self.words.findall(self.prefix + text.replace(" ", MARK))).items():
            n = seen.get(word)
            if n is None:
                n = self.merge(word)
                if len(word) < 64:
                    seen[word] = n
            total += times * n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(
    docs: DataFrame, model: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokens of every whole text, as the model's own library counts them.

    Returns ``doc_id, n_bytes, n_tokens, over_limit``, one row for each row:
    repeated rows are counted each time, a null id stays null. A null text
    counts as empty: no bytes, no tokens. ``model`` is the file's path. No
    shuffle; a very long text is one task's row, merged in n log n. Other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    path = model or vocabulary(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in slices(batches, "text"):
            counts = [count(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
