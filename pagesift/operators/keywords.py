"""Keyword match for many keywords: one pass over a text finds all of them.

The keywords of all sources make an automaton; a text is read through it once,
and the first keyword of its own source ends the search. Cost grows with the
text, not with keywords times text. A keyword table too large for one automaton
is cut into parts of a fixed size, each a pass of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.session import MAX_BROADCAST_BYTES, materialize

Matcher = Callable[[Column, Column], Column]
_BUILT: dict[int, tuple] = {}


def automaton(pairs: list[tuple[str, str]]) -> tuple:
    """An automaton whose values are the sources of a keyword, and the sources whose empty keyword fits all."""
    import ahocorasick

    sources: dict[str, set[str]] = {}
    for source, keyword in pairs:
        sources.setdefault(keyword, set()).add(source)
    always = sources.pop("", set())
    found = ahocorasick.Automaton()
    for keyword, names in sources.items():
        found.add_word(keyword, frozenset(names))
    found.make_automaton()
    return found, always


def matcher_of(pairs: list[tuple[str, str]], key: int) -> Matcher:
    """The check of a part of the keywords; a worker builds its automaton once."""

    @F.pandas_udf("boolean")
    def hit(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = automaton(pairs)
        found, always = _BUILT[key]

        def one(text: str | None, source: str | None) -> bool:
            if text is None or source is None:
                return False
            return source in always or (len(found) > 0 and any(source in names for _, names in found.iter(text)))

        for texts, sources in batches:
            yield pd.Series([one(t, s) for t, s in zip(texts, sources)], dtype=bool)

    return hit


def keyword_matcher(keywords: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> Matcher:
    """``keyword_match`` for a table of ``source_name, keyword``: a function of a haystack and a source.

    A source without keywords takes everything; null keywords are none. The
    table is read in parts of at most ``max_bytes``, so the driver and a task
    hold one part's bytes at a time and the parts together are the settings.
    """
    table = keywords.filter("source_name IS NOT NULL AND keyword IS NOT NULL")
    table = table.select("source_name", F.lower("keyword").alias("keyword")).distinct()
    sized = materialize(table.withColumn("bytes", F.octet_length("keyword") + F.octet_length("source_name")), "keywords")
    total = sized.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    parts = max(1, -(-total // max_bytes))
    hits = []
    for part in range(parts):
        rows = sized.filter(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == part).select("source_name", "keyword").collect()
        pairs = sorted(tuple(r) for r in rows)
        hits.append(matcher_of(pairs, hash((part, total, tuple(pairs)))))
    named = [r["source_name"] for r in sized.select("source_name").distinct().collect()]

    def match(text: Column, source: Column) -> Column:
        hit = hits[0](text, source)
        for other in hits[1:]:
            hit = hit | other(text, source)
        return ~F.coalesce(source.isin(named), F.lit(False)) | hit

    return match
