"""JSON objects that stand inside page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.columns import as_col, let


def json_after(text: Column | str, marker: str) -> Column:
    """Text from the first ``{`` after the marker on; null without one.

    JSON readers stop at the end of the object, so what follows may stay.
    """
    text = as_col(text)

    def cut(t: Column) -> Column:
        rest = F.substring(t, F.locate(marker, t), F.length(t))
        start = F.locate("{", rest)
        return F.when(
            (F.locate(marker, t) > 0) & (start > 0), F.substring(rest, start, F.length(rest))
        )

    return let(text, cut)


def json_around(text: Column | str, marker: str) -> Column:
    """Text from the last ``{`` before the marker on; null without one."""

    def cut(t: Column) -> Column:
        at = F.locate(marker, t)
        before = F.substring(t, 1, at - 1)
        back = F.locate("{", F.reverse(before))
        return F.when(
            (at > 0) & (back > 0), F.substring(t, at - back, F.length(t))
        )

    return let(as_col(text), cut)


def read_embedded_json(text: Column | str, marker: str, schema: str, where: str = "after") -> Column:
    """Struct read from the object at the marker; null if it cannot be parsed."""
    cut = json_after(text, marker) if where == "after" else json_around(text, marker)
    return F.from_json(cut, schema)


def json_text(text: Column | str, schema: str) -> Column:
    return F.from_json(as_col(text), schema)
