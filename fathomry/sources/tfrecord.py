"""TFRecord files of ``tf.train.Example`` messages, read and written without TensorFlow.

A record is its length (8 bytes), a masked CRC-32C of that, the message, and a masked CRC-32C of
the message. Of a message's features each is a list of bytes, floats or integers.
"""

from __future__ import annotations

import functools
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, row long, features map<string, struct<bytes: array<binary>, floats: array<float>, ints: array<long>>>"
#: The reflected polynomial of CRC-32C, and what its masked form adds.
_POLYNOMIAL, _MASK = 0x82F63B78, 0xA282EAD8


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (_POLYNOMIAL if n & 1 else 0)
        out.append(n)
    return out


_TABLE = _table()
_STEPS = np.array(_TABLE, np.uint32)
#: Bytes that are gone through one after the other; lanes of so many are gone through side by side.
LANE = 32


def _after(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Remainders after as many zero bytes as the four tables stand for, one for each byte of a remainder."""
    return tables[0][crc & 0xFF] ^ tables[1][crc >> 8 & 0xFF] ^ tables[2][crc >> 16 & 0xFF] ^ tables[3][crc >> 24]


@functools.cache
def _zeros(level: int) -> np.ndarray:
    """The tables for LANE * 2**level zero bytes."""
    out = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    if level:
        half = _zeros(level - 1)
        return _after(half, _after(half, out))
    for _ in range(LANE):
        out = out >> 8 ^ _STEPS[out & 0xFF]
    return out


def masked_crc(data: bytes) -> int:
    """The masked CRC-32C.

    A long message is cut into lanes, whose remainders are found side by side and then joined two by two: a remainder
    is carried over the bytes after it by tables, since remainders are linear.
    """
    crc, at, lanes = 0xFFFFFFFF, 0, len(data) // LANE
    if lanes >= 8:
        levels = (lanes - 1).bit_length()
        columns = np.frombuffer(data, np.uint8, lanes * LANE).reshape(lanes, LANE).T.astype(np.uint32)
        left = np.zeros(1 << levels, np.uint32)  # lanes of zeros in front change nothing
        now = np.zeros(lanes, np.uint32)
        now[0] = crc
        for column in columns:
            now = now >> 8 ^ _STEPS[(now ^ column) & 0xFF]
        left[-lanes:] = now
        for level in range(levels):
            left = _after(_zeros(level), left[::2]) ^ left[1::2]
        crc, at = int(left[0]), lanes * LANE
    for b in data[at:]:
        crc = crc >> 8 ^ _TABLE[(crc ^ b) & 0xFF]
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


# -- messages --------------------------------------------------------------------------


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return out, at


def _fields(data: bytes):
    """(number, wire type, value) of a message's fields; a length-delimited value is bytes."""
    at = 0
    while at < len(data):
        key, at = _read_varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _read_varint(data, at)
        elif kind == 2:
            size, at = _read_varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, kind, value


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def decode_example(data: bytes) -> dict[str, tuple[list, list, list]]:
    """Feature name -> (bytes, floats, ints)."""
    out = {}
    for _, _, features in _fields(data):
        for _, _, entry in _fields(features):
            parts = {number: value for number, _, value in _fields(entry)}
            lists: tuple[list, list, list] = ([], [], [])
            for number, _, body in _fields(parts.get(2, b"")):
                for _, kind, value in _fields(body):
                    if number == 1:
                        lists[0].append(value)
                    elif number == 2:
                        lists[1].extend(struct.unpack(f"<{len(value) // 4}f", value))
                    elif kind == 0:
                        lists[2].append(_signed(value))
                    else:  # packed
                        at = 0
                        while at < len(value):
                            n, at = _read_varint(value, at)
                            lists[2].append(_signed(n))
            out[parts.get(1, b"").decode()] = lists
    return out


def encode_example(features: dict) -> bytes:
    """Values are lists of bytes or strings, floats, or integers; an empty list has no kind."""
    entries = b""
    for name, values in features.items():
        if not values:
            body = b""
        elif isinstance(values[0], (bytes, str)):
            body = _field(1, b"".join(_field(1, v.encode() if isinstance(v, str) else v) for v in values))
        elif isinstance(values[0], float):
            body = _field(2, _field(1, struct.pack(f"<{len(values)}f", *values)))
        else:
            body = _field(3, _field(1, b"".join(map(_varint, values))))
        entries += _field(1, _field(1, name.encode()) + _field(2, body))
    return _field(1, entries)


def record(message: bytes) -> bytes:
    size = struct.pack("<Q", len(message))
    return size + struct.pack("<I", masked_crc(size)) + message + struct.pack("<I", masked_crc(message))


# -- files -----------------------------------------------------------------------------


#: Bytes of files that one task reads, and what opening a file counts as; tasks at most, beyond which each reads more.
SPLIT_BYTES, OPEN_BYTES, MOST_PARTS = 32 << 20, 256 << 10, 20_000
#: Bytes of messages, and messages, that a task hands on at a time.
PART_BYTES, PART_ROWS = 8 << 20, 10_000


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _packed(files: list[tuple[str, int]], cores: int) -> list[_Files]:
    """Files (path, bytes) in order as partitions: each file is in one, small ones share it, and all cores get some if there are enough."""
    total = sum(size + OPEN_BYTES for _, size in files)
    most = max(min(SPLIT_BYTES, total // cores), total // MOST_PARTS)
    out, held = [], 0
    for path, size in files:
        if not out or held + size + OPEN_BYTES > most:
            out.append([])
            held = 0
        out[-1].append(path)
        held += size + OPEN_BYTES
    return [_Files(paths) for paths in out]


class TfrecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.check, self.cores = options["path"], options.get("check", "false") == "true", int(options.get("cores", 1))

    def partitions(self):
        import pyarrow.fs as pafs

        uri = self.uri if "://" in self.uri else f"file://{self.uri}"
        fs, root = pafs.FileSystem.from_uri(uri)
        if fs.get_file_info(root).type != pafs.FileType.Directory:
            return [_Files([uri])]
        base = uri[: len(uri) - len(root)]
        found = sorted((base + i.path, i.size or 0) for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.is_file and ".tfrecord" in i.base_name)
        return _packed(found, self.cores)

    def _messages(self, path: str):
        """(row, message) of a file."""
        import pyarrow.fs as pafs

        fs, at = pafs.FileSystem.from_uri(path)
        row = 0
        with fs.open_input_stream(at) as f:
            while head := f.read(12):
                size = struct.unpack("<Q", head[:8])[0] if len(head) == 12 else 0
                body = f.read(size + 4)
                if len(head) < 12 or len(body) < size + 4 or self.check and (masked_crc(head[:8]), masked_crc(body[:-4])) != (struct.unpack("<I", head[8:])[0], struct.unpack("<I", body[-4:])[0]):
                    raise ValueError(f"{path} is damaged at record {row}")
                yield row, body[:-4]
                row += 1

    def read(self, partition):
        import pyarrow as pa

        lists = pa.struct([("bytes", pa.list_(pa.binary())), ("floats", pa.list_(pa.float32())), ("ints", pa.list_(pa.int64()))])
        kinds = (pa.string(), pa.int64(), pa.map_(pa.string(), lists))
        batch = lambda held: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["file", "row", "features"])
        held, bytes_held = [], 0
        for path in partition.paths:
            for row, message in self._messages(path):
                held.append((path, row, [(name, dict(zip(("bytes", "floats", "ints"), found))) for name, found in decode_example(message).items()]))
                bytes_held += len(message)
                if bytes_held >= PART_BYTES or len(held) >= PART_ROWS:
                    yield batch(held)
                    held, bytes_held = [], 0
        if held:
            yield batch(held)


class TfrecordSource(DataSource):
    @classmethod
    def name(cls):
        return "tfrecord"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TfrecordReader(self.options)


def read_tfrecords(spark: SparkSession, path: str, check: bool = False) -> DataFrame:
    """(file, row, features) of a file, or of all files of a folder with ``.tfrecord`` in their names; ``check`` compares checksums.

    A task reads many small files one after the other, so tasks, and what they send to the driver, grow with bytes more than with files.
    """
    spark.dataSource.register(TfrecordSource)
    reader = spark.read.format("tfrecord").option("path", path).option("check", str(check).lower())
    return reader.option("cores", max(spark.sparkContext.defaultParallelism, 1)).load()


def write_tfrecords(df: DataFrame, path: str, max_bytes: int = 64 << 20) -> None:
    """Every row as an Example with a feature for each column (an array, or a single value), in files of about ``max_bytes``."""
    import pyarrow as pa

    from .sink import write_raw

    def run(batches):
        part = lambda out: pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["content"])
        for batch in batches:
            out, held = [], 0
            for row in batch.to_pylist():
                lists = {k: v if isinstance(v, list) else [] if v is None else [v] for k, v in row.items()}
                out.append(record(encode_example(lists)))
                held += len(out[-1])
                if held >= PART_BYTES:
                    yield part(out)
                    out, held = [], 0
            if out:
                yield part(out)

    write_raw(df.mapInArrow(run, "content binary"), path, F.col("content"), ".tfrecord", max_bytes)
