"""Small helpers shared by the expressions.

Nested expressions are written as SQL text and turned into a ``Column`` in one
go: building them call by call costs a round trip to the JVM for every node.
Functions named ``*_sql`` take and give SQL text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    Inside lambdas Spark re-evaluates an outer expression for every element;
    binding it to a lambda variable avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bind_sql(name: str, value: str, body: str) -> str:
    """``let`` as SQL text: ``body`` may use ``name`` for the value."""
    return f"transform(array({value}), {name} -> {body})[0]"


def text_sql(value: str) -> str:
    """SQL literal of a text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
