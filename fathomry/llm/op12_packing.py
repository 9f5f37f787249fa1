"""Packing documents into sequences: linear grouping over the histogram of lengths, then best fit.

1. ``token_pieces`` encodes every whole text once and cuts it into pieces of at most ``CAPACITY`` ids. Words
   that a Python worker met before come from a bounded table; a word's ids don't depend on its neighbours, as the
   tokenizer drops white space and never merges across it.
2. Pieces of one length are alike, so the packing is found on the histogram of lengths, which has at most CAPACITY
   rows whatever the corpus (``_packing``): large lengths are rounded up within groups of equal cardinality,
   configurations of these few sizes are optimised by a linear program, documents take the places, and small ones go
   by best fit. What counts as large is a share of the capacity; SHARES are tried until the sequences are within
   CLOSE of the fewest that the tokens allow. The plan is a list of ranges of piece numbers, some thousands.
3. Pieces are numbered by length in written ranges, with one shuffle of narrow rows, so no length is gathered in one task, and
   each looks its range up: sequence and offset follow from its number.

Defined results: a null or empty text is the separator alone; a text of more than CAPACITY ids is cut, and all
of its pieces but the last fill a sequence; repeated rows and ids and null ids are packed row by row; special tokens'
strings in a text are what the tokenizer makes of them; an empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.order import global_index
from ._arrow import bound_batches, with_bytes
from ._packing import pack
from ._work import Work

CAPACITY, SEPARATOR = 2048, 0
#: From which share of the capacity on a length is large, in the order in which they are tried; groups; and when to stop.
SHARES, GROUPS, CLOSE = (1 / 2, 1 / 3, 1 / 5), 64, 0.001
#: Words that a task keeps, twice: those met lately and those before (200 bytes each); longer ones aren't kept.
KEPT_WORDS, KEPT_BYTES = 300_000, 64
#: Bytes of text that are split at a time.
BLOCK = 1 << 20

#: What is looked up: Latin letters up to a stop, else all up to white space. Neither side of such a cut changes the other's ids.
_CHUNK = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++(?=[.,;:!?])|[^\x20\x09-\x0D]+")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _visible() -> dict[int, int]:
    """The character that stands for each byte in the merges: the byte's own if it can be seen, else the next from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return dict(zip((b for b in range(256) if b not in seen), range(256, 512)))


_VISIBLE = _visible()


def vocabulary(path: str | None) -> str:
    """The tokenizer's file: the one given, or the installed one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


class Encoder:
    """bytes of little-endian 32-bit ids of a text; words that were met lately are remembered."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.lately: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _word(self, word: bytes) -> bytes:
        if _LETTERS.fullmatch(word):  # composed Latin letters are one word for the merges; nothing but their case changes
            seen = word.decode().lower().encode().decode("latin-1").translate(_VISIBLE)
            ids = [t.id for t in self.tokenizer.model.tokenize(seen)]
        else:
            ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: bytes | None) -> bytes:
        out, start, text = [], 0, text or b""
        if text.isascii() and b"<|" not in text:  # the tokenizer lower-cases; special tokens are matched before that
            text = text.lower()
        while start < len(text):
            cut = _SPACE.search(text, start + BLOCK) if start + BLOCK < len(text) else None
            end = cut.start() if cut else len(text)
            words = _CHUNK.findall(text, start, end)
            held = self.lately
            for w in set(words).difference(held):
                held[w] = self.before.get(w) or self._word(w)
            out.append(b"".join(map(held.__getitem__, words)))
            if len(held) > KEPT_WORDS or len(words) * 4 > KEPT_WORDS:
                self.before = {w: ids for w, ids in held.items() if len(w) <= KEPT_BYTES}
                self.lately = {}
            start = end
        return b"".join(out)


@functools.lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> Encoder:
    """One a Python worker, so that its tasks share the words they met."""
    return Encoder(vocabulary)


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), with the ids themselves as bytes if asked for."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    separator, width = SEPARATOR.to_bytes(4, "little"), 4 * capacity
    names = ["piece", "start", "length", "ids_crc32"]

    def run(batches):
        encode = _encoder(held.value)
        for batch in batches:
            rows, columns, ids = [], [[] for _ in names], []
            for i, text in enumerate(batch.column(1)):
                all_ids = memoryview(encode(text.as_py()) + separator)
                for k, at in enumerate(range(0, len(all_ids), width)):
                    part = all_ids[at : at + width]
                    rows.append(i)
                    for column, value in zip(columns, (k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
                    if with_ids:
                        ids.append(bytes(part))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            out = [batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, ["doc_id", *names, *["ids"] * with_ids])

    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return with_bytes(docs.select("doc_id", "text")).mapInArrow(run, schema)


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Ranges of piece numbers (``first``, ascending; pieces are numbered by length) with where they go:
    the number i is in sequence ``sequence + (i - first) // each`` at ``offset + (i - first) % each * length``."""
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    before = np.cumsum(counts) - counts
    rows, sequence = [], 0
    for block in pack(counts, capacity, SHARES, GROUPS, CLOSE):
        rows += [(int(before[length]) + first, sequence, each, offset) for length, first, each, offset in block.entries]
        sequence += block.count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("first", "sequence", "each", "offset"), table.T.copy(), strict=True))


def sequences(work: Work, docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), with ``ids`` if asked for."""
    pieces = work.save(token_pieces(docs, path, capacity, with_ids).withColumn("__row", F.monotonically_increasing_id()), "pieces")
    # As many rows as there are lengths: at most ``capacity``.
    plan = packing_plan({r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)
    numbered = global_index(pieces.select("__row", "length") if with_ids else pieces, ["length", "__row"], "__number", save=work.save)

    def place(batches):
        for batch in batches:
            number, length = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("__number", "length"))
            at = np.searchsorted(plan["first"], number, "right") - 1
            step = number - plan["first"][at]
            yield batch.append_column("sequence_id", pa.array(plan["sequence"][at] + step // plan["each"][at])).append_column("offset", pa.array(plan["offset"][at] + step % plan["each"][at] * length))

    from pyspark.sql.types import LongType, StructType

    bound_batches(docs.sparkSession)
    placed = numbered.mapInArrow(place, StructType([*numbered.schema.fields]).add("sequence_id", LongType()).add("offset", LongType()))
    if not with_ids:
        return placed.drop("__row", "__number")
    return pieces.join(placed.select("__row", "sequence_id", "offset"), "__row").drop("__row")


def packed(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, documents) of a placed table with ids: what a training job reads. A sequence's pieces are gathered,
    which are bounded by its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", F.hex("ids").alias("hex"))))
    by = placed.groupBy("sequence_id").agg(parts.alias("p"))
    return by.select("sequence_id", F.unhex(F.array_join(F.transform("p", lambda x: x.hex), "")).alias("ids"), F.transform("p", lambda x: F.struct(x.doc_id.alias("doc_id"), x.piece.alias("piece"), x.offset.alias("offset"), x.length.alias("length"))).alias("documents"))
