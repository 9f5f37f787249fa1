"""WARC archives as a Spark data source, read and written.

Writing: one gzip member per record, so a record can be read by itself. Each member's
header carries its lengths in an ``sl`` extra field (compressed, then uncompressed), so a
reader can step over a record that it has only read the headers of. Files are rolled at
``maxFileBytes``; a task's files have names of their own, and only those of committed tasks
are listed in the manifest that the commit writes, so failed or repeated tasks add nothing.

Reading: partitions are whole files, small ones together up to ``partitionBytes``. Equality
and IN filters on header columns are pushed down; headers are parsed first, and a record
whose headers fail is stepped over. ``payload`` tells what to decode: ``full`` (bytes,
digest, length), ``digest`` (digest and length only, no bytes leave the reader) or ``none``.
Plain ``.warc`` files and members without the extra field are read too, the latter by
decoding and dropping what isn't wanted.

Defined results: a null payload is empty; a null url or id is an empty header value and is
read as null; a record cut off by the end of its file ends that file; an empty table gives
an archive without records.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from ._arrow import bound_batches
from ._work import Work

REVISIT_BYTES = 100
MAX_FILE_BYTES, PARTITION_BYTES = 256 << 20, 64 << 20
READ_AHEAD, BATCH_BYTES = 64 << 10, 8 << 20
#: Digests that a broadcast may hold (about 100 bytes each); beyond it the same join shuffles.
BROADCAST_DIGESTS = 200_000
#: Rows that make a digest hot: it is decided before rows are shuffled by digest.
HOT_ROWS = 10_000

SCHEMA = "record_id string, record_type string, target_uri string, date string, content_length long, payload_digest string, refers_to string, http_length long, payload binary, payload_bytes long, payload_sha256 string"
WRITE_FIELDS = ("record_id", "record_type", "target_uri", "payload_digest", "refers_to", "http_length", "payload")
#: Columns that are a header each, for the filters.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _fs(uri: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri)


# -- records ---------------------------------------------------------------------------


def _header_value(v) -> str:
    """One line: a url may hold anything."""
    return "" if v is None else str(v).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain_value(v: str | None) -> str | None:
    return v.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if v else None


def record_bytes(r: dict) -> bytes:
    """A response with its payload, or a revisit with the HTTP headers only."""
    payload = r["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['http_length']}\r\n\r\n".encode()
    block = http if r["record_type"] == "revisit" else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: <urn:page:{_header_value(r['record_id'])}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header_value(r['target_uri'])}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{r['payload_digest']}",
    ]
    if r["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{_header_value(r['refers_to'])}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int) -> bytes:
    """A gzip member whose header tells its lengths."""
    z = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = z.compress(record) + z.flush()
    length = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, length & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def _urn(v: str | None) -> str | None:
    return _plain_value(v.removeprefix("<").removesuffix(">").removeprefix("urn:page:")) if v else None


class _Source:
    """Bytes of a file from a position on, read ahead in blocks."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.buffer = f, size, 0, b""

    def take(self, n: int) -> bytes:
        if len(self.buffer) < n:
            self.f.seek(self.at + len(self.buffer))
            self.buffer += self.f.read(max(n - len(self.buffer), READ_AHEAD))
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        self.at += len(out)
        return out

    def go(self, to: int) -> None:
        ahead = to - self.at
        self.buffer = self.buffer[ahead:] if 0 <= ahead <= len(self.buffer) else b""
        self.at = to


class _Member:
    """The decoded bytes of the gzip member at the source's position, as they are asked for."""

    def __init__(self, source: _Source):
        self.source, self.start, self.length = source, source.at, None
        head = source.take(12)
        if len(head) == 12 and head[3] & 4:
            extra = source.take(struct.unpack("<H", head[10:])[0])
            if extra[:2] == b"sl" and len(extra) >= 12:
                self.length = struct.unpack("<I", extra[4:8])[0]
        source.go(self.start)
        self.z, self.out = zlib.decompressobj(zlib.MAX_WBITS | 16), bytearray()

    def fill(self, n: int) -> bool:
        """Whether n bytes are there."""
        while len(self.out) < n and not self.z.eof:
            data = self.z.unconsumed_tail or self.source.take(READ_AHEAD)
            if not data:
                return False
            self.out += self.z.decompress(data, max(n - len(self.out), 4096))
        return len(self.out) >= n

    def skip(self) -> None:
        """Leave the source at the next member, without decoding the rest where the length is known."""
        if self.length is not None:
            self.source.go(self.start + self.length)
            return
        while not self.z.eof:
            data = self.z.unconsumed_tail or self.source.take(READ_AHEAD)
            if not data:
                return
            self.z.decompress(data, 1 << 20)
        self.source.go(self.source.at - len(self.z.unused_data))


class _Plain:
    """A record of an uncompressed file."""

    def __init__(self, source: _Source):
        self.source, self.start, self.out, self.length = source, source.at, bytearray(), None

    def fill(self, n: int) -> bool:
        if len(self.out) < n:
            self.out += self.source.take(max(n - len(self.out), 4096))
        return len(self.out) >= n

    def skip(self) -> None:
        self.source.go(self.start + self.length)


def records(f, size: int, wanted, payload: str):
    """Tuples in the order of SCHEMA of the records whose headers are wanted."""
    source = _Source(f, size)
    magic = source.take(2)
    source.go(0)
    kind = _Member if magic == b"\x1f\x8b" else _Plain
    while source.at < size:
        r, end = kind(source), -1
        while end < 0:
            more = r.fill(len(r.out) + 2048)
            end = r.out.find(b"\r\n\r\n")
            if end < 0 and not more:
                return
        h = parse_headers(bytes(r.out[:end]))
        n = int(h.get("content-length") or 0)
        if kind is _Plain:
            r.length = end + 4 + n + 4
        if not wanted(h):
            r.skip()
            continue
        http = h.get("content-type", "").startswith("application/http")
        http_length, body_at = None, 0
        if http:
            stop = -1
            have = 0
            while stop < 0 and have < n:
                have = min(n, have + 2048)
                if not r.fill(end + 4 + have):
                    return
                stop = r.out.find(b"\r\n\r\n", end + 4, end + 4 + have)
            if stop >= 0:
                body_at = stop + 4 - (end + 4)
                length = parse_headers(bytes(r.out[end + 4 : stop])).get("content-length")
                http_length = int(length) if length and length.isdigit() else None
        data = total = sha = None
        if payload != "none" and h.get("warc-type") != "revisit":
            if not r.fill(end + 4 + n):
                return
            data = bytes(r.out[end + 4 + body_at : end + 4 + n])
            total, sha = len(data), hashlib.sha256(data).hexdigest()
        digest = h.get("warc-payload-digest")
        yield (
            _urn(h.get("warc-record-id")), h.get("warc-type"), _plain_value(h.get("warc-target-uri")), h.get("warc-date"), n, digest.removeprefix("sha256:") if digest else None,
            _urn(h.get("warc-refers-to")), http_length, data if payload == "full" else None, total, sha,
        )
        r.skip()


# -- the data source -------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    paths: list

    def __init__(self, paths: list):
        self.paths = paths


@dataclass
class Written(WriterCommitMessage):
    names: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.payload = options["path"], options.get("payload", "full")
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.wanted: list[tuple[str, list]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in HEADERS:
                self.wanted.append((name, [f.value] if isinstance(f, EqualTo) else list(f.value)))
            else:
                yield f

    def partitions(self):
        import pyarrow.fs as pafs

        filesystem, root = _fs(self.uri)
        manifests = [i for i in filesystem.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if i.base_name.startswith("_manifest")]
        if manifests:
            files = []
            for m in manifests:
                with filesystem.open_input_stream(m.path) as f:
                    files += [(f"{root}/{name}", size) for name, size in json.loads(f.read())]
        else:
            files = [(i.path, i.size) for i in filesystem.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if i.is_file and i.base_name.endswith((".warc", ".warc.gz"))]
        out, room = [], 0
        for path, size in sorted(files):
            if not out or room < size:
                out.append([])
                room = self.partition_bytes
            out[-1].append((path, size))
            room -= size
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition):
        filesystem, _ = _fs(self.uri)
        decode = {"record_id": _urn, "refers_to": _urn, "target_uri": _plain_value, "payload_digest": lambda v: v.removeprefix("sha256:") if v else None}
        checks = [(HEADERS[name], decode.get(name, lambda v: v), set(values)) for name, values in self.wanted]

        def wanted(h):
            return all(f(h.get(name)) in values for name, f, values in checks)

        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
        names, rows, held = [c.split()[0] for c in SCHEMA.split(", ")], [], 0
        for path, size in partition.paths if partition else []:
            with filesystem.open_input_file(path) as f:
                for row in records(f, size, wanted, self.payload):
                    rows.append(row)
                    held += 500 + len(row[8] or b"")
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.uri, self.level = options["path"], int(options.get("level", 3))
        self.max_bytes = int(options.get("maxfilebytes", MAX_FILE_BYTES))

    def write(self, iterator):
        filesystem, root = _fs(self.uri)
        filesystem.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.select(list(WRITE_FIELDS)).to_pylist():
                    if out is None or size >= self.max_bytes:
                        if out is not None:
                            out.close()
                            names[-1][1] = size
                        names.append([f"{uuid.uuid4().hex}.warc.gz", 0])
                        out, size = filesystem.open_output_stream(f"{root}/{names[-1][0]}", compression=None), 0
                    data = member(record_bytes(row), self.level)
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
                names[-1][1] = size
        return Written(names)

    def commit(self, messages):
        filesystem, root = _fs(self.uri)
        filesystem.create_dir(root, recursive=True)
        with filesystem.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages):
        filesystem, root = _fs(self.uri)
        for m in messages:
            for name, _ in m.names if m else []:
                filesystem.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; see the module."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known, with filter pushdown for Python sources on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# -- archives of pages -----------------------------------------------------------------


def to_records(work: Work, pages: DataFrame, page_id: Column, url: Column, payload: Column, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Rows to write: of equal payloads the one with the smallest id is the response, others revisit it.

    Rows that repeat the response's own id are responses too; a null id comes after all others.
    """
    rows = pages.select(page_id.alias("id"), url.alias("target_uri"), F.coalesce(payload, F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("http_length", F.octet_length("payload").cast("long"))
    known = pages.select(page_id.alias("id"), F.coalesce(payload, F.lit("")).cast("binary").alias("payload")).where(F.octet_length("payload") >= revisit_bytes)
    first = known.groupBy(F.sha2("payload", 256).alias("payload_digest")).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    first = work.save(first, "first")
    again = F.col("first").isNotNull() & F.coalesce(F.col("id") != F.col("first"), F.lit(True))
    if first.count() <= BROADCAST_DIGESTS:
        joined = rows.join(F.broadcast(first.drop("n")), "payload_digest", "left")
    else:
        # Digests with many rows are decided by a broadcast (there can't be many of them); their rows then go where their ids send
        # them, revisits without their payload. The others' rows meet by digest, some at a time.
        hot, cold = first.where(F.col("n") >= HOT_ROWS).drop("n"), first.where(F.col("n") < HOT_ROWS).select(F.col("payload_digest").alias("key"), F.col("first").alias("cold"))
        decided = rows.join(F.broadcast(hot) if hot.count() <= BROADCAST_DIGESTS else hot, "payload_digest", "left").withColumn("payload", F.when(~again, F.col("payload")))
        key = F.when(F.col("first").isNull(), F.col("payload_digest")).otherwise(F.concat("payload_digest", F.lit(":"), F.xxhash64("id", "target_uri").cast("string")))
        joined = decided.withColumn("key", key).join(cold, "key", "left").withColumn("first", F.coalesce("first", "cold"))
    return joined.select(
        F.col("id").cast("string").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", "payload_digest",
        F.when(again, F.col("first")).cast("string").alias("refers_to"), "http_length", F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archive(rows: DataFrame, path: str, **options) -> None:
    register(rows.sparkSession)
    bound_batches(rows.sparkSession)
    rows.select(*WRITE_FIELDS).write.format("warc").options(path=path, **options).mode("append").save()


def read_archive(spark: SparkSession, path: str, payload: str = "full", **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(path=path, payload=payload, **options).load()
