"""Token ids of training examples, encoded in Arrow batches with a given vocabulary file."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Characters of texts that are encoded at a time.
BLOCK_CHARS = 4 << 20


@functools.lru_cache(maxsize=2)
def _tokenizer(vocabulary: str):
    """One a Python worker, whatever the number of its tasks."""
    from tokenizers import Tokenizer

    return Tokenizer.from_str(vocabulary)


def _encoded(tokenizer, texts: list[str | None], room: int | None, before: list[int], after: list[int]):
    """The ids of each text with what stands before and after; a null text is None."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars < BLOCK_CHARS):
            chars += len(texts[end] or "")
            end += 1
        part = texts[at:end]
        for text, e in zip(part, tokenizer.encode_batch([t or "" for t in part], add_special_tokens=False), strict=True):
            yield None if text is None else before + e.ids[:room] + after
        at = end


def encode(df: DataFrame, vocabulary: str, lengths: dict[str, int | None], before: Sequence[int] = (), after: Sequence[int] = ()) -> DataFrame:
    """df with ``<column>_ids`` for each column of lengths: its texts as ids, cut to that many (None: whole) with the special ids.

    A column is a string, or an array of strings, which gives an array of ids for each. ``vocabulary`` is the path of a
    tokenizer's file on the driver. What is cut is the text's end, never the ids ``before`` and ``after`` it. A null text
    has null ids, an empty one the special ids alone. Special tokens' strings in a text are what the tokenizer makes of them.
    """
    before, after = list(before), list(after)
    for c, n in lengths.items():
        if n is not None and n < len(before) + len(after):
            raise ValueError(f"{c}: no room for the special ids in {n}")
    held = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))
    nested = {c: isinstance(df.schema[c].dataType, ArrayType) for c in lengths}
    room = {c: None if n is None else n - len(before) - len(after) for c, n in lengths.items()}

    def run(batches):
        tokenizer, ids = _tokenizer(held.value), pa.list_(pa.int32())
        for batch in batches:
            for c in lengths:
                column = batch.column(batch.schema.get_field_index(c))
                if not nested[c]:
                    out = pa.array(_encoded(tokenizer, column.to_pylist(), room[c], before, after), ids)
                else:
                    rows = column.to_pylist()
                    flat = _encoded(tokenizer, [t for r in rows if r is not None for t in r], room[c], before, after)
                    out = pa.array([None if r is None else [next(flat) for _ in r] for r in rows], pa.list_(ids))
                batch = batch.append_column(f"{c}_ids", out)
            yield batch

    kind = lambda c: ArrayType(ArrayType(IntegerType())) if nested[c] else ArrayType(IntegerType())
    return df.mapInArrow(run, StructType([*df.schema.fields, *(StructField(f"{c}_ids", kind(c)) for c in lengths)]))


def padded(ids: Column, length: int, pad_id: int = 0, left: bool = False) -> Column:
    """Ids filled up to a length; longer ones stay as they are."""
    fill = F.array_repeat(F.lit(pad_id), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def mask(ids: Column, length: int, left: bool = False) -> Column:
    """1 for each id, 0 for what ``padded`` adds."""
    return padded(F.transform(ids, lambda _: F.lit(1)), length, 0, left)


def query_passage_ids(examples: DataFrame, vocabulary: str, query_length: int = 32, passage_length: int = 128, before: Sequence[int] = (), after: Sequence[int] = ()) -> DataFrame:
    """Examples(query, passages) with ``query_ids`` and ``passages_ids``, cut to the lengths of a retriever's inputs and not padded."""
    return encode(examples, vocabulary, {"query": query_length, "passages": passage_length}, before, after)
