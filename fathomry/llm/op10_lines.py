"""Corpus-wide line dedup through a sharded minimal perfect hash.

``count_lines`` counts, for every distinct line key, the documents that hold it.
``build_index`` puts all of these keys into shards of bounded size: a minimal perfect hash
(levels of collision-free bits, ranked by popcounts) gives each key a slot in a compact array
of 64-bit fingerprints and one of 32-bit counts: about 13 bytes a key. Documents probe the
arrays: a task holds texts up to a bound of bytes and their lines' hashes, sorts the distinct
hashes by shard, and reads each shard once for all of them. Lines are never joined, shuffled
or broadcast.

The index has two tiers, keys of at least ``tier_docs`` documents and all others. Whoever asks
which lines stand in at least ``min_docs >= tier_docs`` documents needs the first tier alone,
which is small in any corpus; a key of the other tier misses there by its fingerprint (64 bits
beside the 64 that chose the slot). ``with_counts`` and smaller ``min_docs`` read both.

Defined results: a null or empty text is one empty line; a null text stays null; keys
shorter than ``min_chars`` code points are never dropped; a line that repeats within one
document counts once for it; repeated rows count as documents of their own; a key that the
index doesn't have counts 0 documents; an empty table gives an empty result. A text of any
length is split in one task, which is inherent to a row. Other columns pass through untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._arrow import bound_batches, with_bytes
from ._work import Work

MIN_DOCS, MIN_CHARS = 10, 1
#: Keys of a shard on average; and a tier's shards at least, if it has LEAST_KEYS for each, so that building them is spread.
SHARD_KEYS, LEAST_SHARDS, LEAST_KEYS = 500_000, 16, 4_000
#: Bytes of line hashes that a task counts before it hands them on, and of texts that it holds for one pass over the shards.
PARTIAL_BYTES, HELD_BYTES = 4 << 20, 24 << 20

_GAMMA = 2.0
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_INDEX = "tier string, shard int, sizes array<long>, bits binary, fingerprints binary, counts binary"


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip().lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def _hashes(digests: bytes | bytearray) -> np.ndarray:
    return np.frombuffer(digests, "<u8").reshape(-1, 2)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of h, and for each row of h which of them it is."""
    if not len(h):
        return h, np.zeros(0, np.int64)
    order = np.lexsort((h[:, 1], h[:, 0]))
    rows = h[order]
    new = np.r_[True, (rows[1:] != rows[:-1]).any(1)]
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    return rows[new], back


def count_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, n_docs) of every distinct line key; each task adds up what it sees first."""

    def partial(batches):
        def flush():
            h, back = distinct(_hashes(bytes(held)))
            return pa.RecordBatch.from_arrays([pa.array(h[:, i].view("<i8")) for i in (0, 1)] + [pa.array(np.bincount(back, minlength=len(h)).astype(np.int64))], ["h1", "h2", "n"])

        held = bytearray()
        for batch in batches:
            for text in batch.column(0):
                keys = {line_key(x) for x in (text.as_py() or b"").split(b"\n")}
                held += b"".join(xxhash.xxh3_128_digest(k) for k in keys if _long_enough(k, min_chars))
                if len(held) >= PARTIAL_BYTES:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    bound_batches(docs.sparkSession)
    return with_bytes(docs.select("text")).mapInArrow(partial, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"))


def _slots(h: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h[:, 0] + _M1 * np.uint64(level + 1)) ^ (h[:, 1] * _M2)
        x = (x ^ (x >> np.uint64(31))) * _M1
        return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


def perfect_hash(h: np.ndarray) -> tuple[list[int], bytes]:
    """Levels' sizes and their bits, one after the other: a key has the first level where it collides with none."""
    sizes, bits, left = [], [], h
    while len(left):
        size = int(_GAMMA * len(left)) // 64 * 64 + 64
        at = _slots(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        bits.append(np.packbits(alone, bitorder="little").tobytes())
        sizes.append(size)
        left = left[~alone[at]]
    return sizes, b"".join(bits)


class Shard:
    """A shard's arrays, ready for look-ups; beside the arrays as stored it holds 4 bytes for every 64 bits."""

    def __init__(self, sizes: list[int], bits: bytes, fingerprints: bytes, counts: bytes):
        self.sizes, self.words = sizes, np.frombuffer(bits, "<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.uint32)[:-1]]).astype(np.uint32) if len(self.words) else np.zeros(0, np.uint32)
        self.fingerprints, self.counts = np.frombuffer(fingerprints, "<u8"), np.frombuffer(counts, "<u4")

    def slot(self, h: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 where no level has it."""
        out, todo, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            at = base + _slots(h[todo], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = self.before[at[hit] >> 6].astype(np.int64) + below[hit]
            todo, base = todo[~hit], base + size
        return out

    def count(self, h: np.ndarray) -> np.ndarray:
        """Documents with each key; 0 for a key that isn't here."""
        if not len(self.counts):
            return np.zeros(len(h), np.int64)
        slot = self.slot(h)
        return np.where((slot >= 0) & (self.fingerprints[slot] == h[:, 1]), self.counts[slot], 0)


class LineIndex:
    """Where the shards of one corpus are, and how many of each tier."""

    def __init__(self, path: str, tier_docs: int, shards: dict[str, int]):
        self.path, self.tier_docs, self.shards = path, tier_docs, shards

    def reader(self, min_docs: int = 1):
        """A function h -> counts for distinct keys, made in the task; counts below min_docs may come as 0.

        It reads a shard, looks up all keys that belong there and forgets it.
        """
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        filesystem, root = pafs.FileSystem.from_uri(self.path)
        tiers = ("often",) if min_docs >= self.tier_docs else ("often", "rest")

        def shard(tier: str, k: int) -> Shard:
            at = f"{root}/tier={tier}/shard={k}"
            if filesystem.get_file_info(at).type == pafs.FileType.NotFound:
                return Shard([], b"", b"", b"")
            count.reads += 1
            t = pq.read_table(at, filesystem=filesystem, columns=["sizes", "bits", "fingerprints", "counts"], partitioning=None)
            return Shard(*(t.column(c)[0].as_py() for c in t.column_names))

        def count(h: np.ndarray) -> np.ndarray:
            out = np.zeros(len(h), np.int64)
            for tier in tiers:
                if not self.shards[tier]:
                    continue
                todo = np.flatnonzero(out == 0)
                of = (h[todo, 0] % np.uint64(self.shards[tier])).astype(np.int64)
                todo, of = todo[order := np.argsort(of, kind="stable")], of[order]
                for part in np.split(todo, np.flatnonzero(np.diff(of)) + 1) if len(todo) else ():
                    out[part] = shard(tier, int(h[part[0], 0] % np.uint64(self.shards[tier]))).count(h[part])
            return out

        count.reads = 0
        return count


def build_index(work: Work, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> LineIndex:
    """The index of all distinct keys; ``min_docs`` parts the tiers."""
    lines = work.save(count_lines(docs, min_chars), "lines")
    often = F.col("n_docs") >= min_docs
    n, n_often = lines.agg(F.count("*"), F.count_if(often)).first()
    spread = lambda size: max(-(-size // shard_keys), min(LEAST_SHARDS, -(-size // LEAST_KEYS)))
    shards = {"often": spread(n_often), "rest": spread(n - n_often)}

    def build(t: pa.Table) -> pa.Table:
        h = np.stack([t.column(c).to_numpy().astype("<i8").view("<u8") for c in ("h1", "h2")], 1)
        sizes, bits = perfect_hash(h)
        slot, n = Shard(sizes, bits, b"", b"").slot(h), np.minimum(t.column("n_docs").to_numpy(), 0xFFFFFFFF)
        fingerprints, counts = np.empty(len(h), "<u8"), np.empty(len(h), "<u4")
        fingerprints[slot], counts[slot] = h[:, 1], n
        binary = lambda x: pa.array([x], pa.binary())
        return pa.table({"tier": t.column("tier").slice(0, 1), "shard": t.column("shard").slice(0, 1), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": binary(bits), "fingerprints": binary(fingerprints.tobytes()), "counts": binary(counts.tobytes())})

    def place(n: int):
        """h1 as an unsigned number modulo the shards, which is what the reader computes."""
        n = max(n, 1)
        return F.pmod(F.pmod(F.col("h1"), F.lit(n)) + F.when(F.col("h1") < 0, F.lit((1 << 64) % n)).otherwise(0), F.lit(n)).cast("int")

    placed = lines.select("h1", "h2", "n_docs", F.when(often, "often").otherwise("rest").alias("tier"), F.when(often, place(shards["often"])).otherwise(place(shards["rest"])).alias("shard"))
    work.save(placed.groupBy("tier", "shard").applyInArrow(build, _INDEX), "index", "tier", "shard")
    work.drop("lines")
    return LineIndex(work.path("index"), min_docs, shards)


def _held(batches):
    """Lists of batches whose bytes reach HELD_BYTES together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def probe(batches: list[pa.RecordBatch], at: int, count, min_chars: int):
    """For each batch the counts of its texts' lines, text by text; lines shorter than min_chars count 0."""
    digests, sizes, short = bytearray(), [], []
    for batch in batches:
        for text in batch.column(at):
            keys = [line_key(x) for x in (text.as_py() or b"").split(b"\n")]
            short += [len(digests) // 16 + i for i, k in enumerate(keys) if not _long_enough(k, min_chars)]
            digests += b"".join(map(xxhash.xxh3_128_digest, keys))
            sizes.append(len(keys))
    h, back = distinct(_hashes(bytes(digests)))
    counts = count(h)[back]
    counts[short] = 0
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    start = 0
    for batch in batches:
        yield batch, [counts[ends[i] : ends[i + 1]] for i in range(start, start + batch.num_rows)]
        start += batch.num_rows


def kept_text(text: bytes | None, gone: np.ndarray) -> bytes:
    lines = (text or b"").split(b"\n")
    return b"\n".join(x for x, g in zip(lines, gone, strict=True) if not g)


def line_report(docs: DataFrame, index: LineIndex, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every document."""

    def report(batches):
        count = index.reader(min_docs)
        for held in _held(batches):
            for batch, found in probe(held, 1, count, min_chars):
                gone = [n >= min_docs for n in found]
                sha = [hashlib.sha256(kept_text(t.as_py(), g) if g.any() else t.as_py() or b"").hexdigest() for t, g in zip(batch.column(1), gone)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(g) for g in gone], pa.int64()), pa.array([int(g.sum()) for g in gone], pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_bytes(docs.select("doc_id", "text")).mapInArrow(report, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


def with_counts(docs: DataFrame, index: LineIndex, column: str = "line_docs", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the number of documents that hold each line, line by line, from the whole index."""
    from pyspark.sql.types import ArrayType, LongType, StructType

    def run(batches):
        count = index.reader()
        for held in _held(batches):
            for batch, found in probe(held, batch_at, count, min_chars):
                yield batch.append_column(column, pa.array([n.tolist() for n in found], pa.list_(pa.int64())))

    bound_batches(docs.sparkSession)
    raw, batch_at = with_bytes(docs), docs.columns.index("text")
    return raw.mapInArrow(run, StructType([*raw.schema.fields]).add(column, ArrayType(LongType()))).withColumn("text", F.col("text").cast("string"))


def drop_lines(docs: DataFrame, index: LineIndex, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the frequent lines gone from ``text``; ``n_chars``, where present, follows."""

    def clean(batches):
        count = index.reader(min_docs)
        for held in _held(batches):
            for batch, found in probe(held, at, count, min_chars):
                if any((n >= min_docs).any() for n in found):
                    kept = [t.as_py() if not t.is_valid or not (n >= min_docs).any() else kept_text(t.as_py(), n >= min_docs) for t, n in zip(batch.column(at), found)]
                    batch = batch.set_column(at, "text", pa.array(kept, pa.binary()))
                yield batch

    bound_batches(docs.sparkSession)
    raw, at = with_bytes(docs), docs.columns.index("text")
    out = raw.mapInArrow(clean, raw.schema).withColumn("text", F.col("text").cast("string"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
