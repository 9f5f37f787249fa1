"""Columns that an operator only passes through."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

_REST = "__rest"


def apart(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with the used columns and one struct of all others, and a function that gives a result docs' columns back.

    Operators name what they compute with two underscores in front. Where docs has such names itself, nothing
    of its own stays beside them; otherwise docs is returned as it is. ``back(df, *more)`` keeps the columns ``more`` too.
    """
    names = docs.columns
    if not any(c.startswith("__") for c in names):
        return docs, lambda df, *more: df.select(*[f"`{c}`" for c in names], *more)
    rest = [c for c in names if c not in used]
    narrow = docs.select(*[f"`{c}`" for c in names if c in used], F.struct(*[F.col(f"`{c}`") for c in rest]).alias(_REST))

    def back(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*[F.col(c) if c in used else F.col(_REST).getField(c).alias(c) for c in names], *more)

    return narrow, back
