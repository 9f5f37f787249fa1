"""Members of tar and zip archives as rows, read by a Python data source.

Each archive is a partition. Members are listed from their headers; the bytes of a member
are only read if its name passes a pattern or is among given ids, so a filter costs no reading of the rest.
"""

from __future__ import annotations

import hashlib
import io
import re
import tarfile
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.store import scratch
from ..functions.text import to_base64

SCHEMA = "archive string, name string, size long, content binary"
#: Archives inside archives are opened down to this depth, unless the option ``nesting`` says otherwise.
NESTING = 1
#: Ids that a reader may hold, 8 bytes each; beyond, members are only filtered after they were read.
HELD_IDS = 5_000_000


def expand(pattern: str) -> tuple[list[str], int | None]:
    """Names of a brace pattern (``a-{000..012}.tar``, ``{x,y}``, joined by ``::``), and the count after ``|``."""
    pattern, _, count = pattern.partition("|")
    out = []
    for part in pattern.split("::"):
        todo = [part]
        while todo:
            name = todo.pop(0)
            m = re.search(r"\{([^{}]*)\}", name)
            if not m:
                out.append(name)
                continue
            span = re.fullmatch(r"(\d+)\.\.(\d+)", m[1])
            values = [str(i).zfill(len(span[1])) for i in range(int(span[1]), int(span[2]) + 1)] if span else m[1].split(",")
            todo = [name[: m.start()] + v + name[m.end() :] for v in values] + todo
    return out, int(count) if count else None


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, _ = expand(options["path"])
        self.pattern = options.get("pattern")
        self.skip_errors = options.get("skiperrors", "false") == "true"
        self.nesting, self.ids_path = int(options.get("nesting", NESTING)), options.get("ids")

    def partitions(self):
        import pyarrow.fs as pafs

        found = []
        for uri in self.paths:
            fs, path = pafs.FileSystem.from_uri(uri)
            info = fs.get_file_info(path)
            base = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
            if info.type == pafs.FileType.Directory:
                found += [base + i.path for i in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if i.is_file and re.search(r"\.(tar|tar\.gz|tgz|zip)$", i.path)]
            else:
                found.append(uri)
        return [_Archive(p) for p in sorted(found)]

    def _wanted(self):
        """Whether a member is to be read, by its name: the pattern, and its base name's hash among those of the ids."""
        match = re.compile(self.pattern).search if self.pattern else lambda _: True
        if not self.ids_path:
            return match
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        fs, root = pafs.FileSystem.from_uri(self.ids_path)
        hashes = np.sort(pq.read_table(root, filesystem=fs).column("h").to_numpy())

        def among(name: str) -> bool:
            h = name_hash(name.rpartition("/")[2])
            at = hashes.searchsorted(h)
            return bool(at < len(hashes) and hashes[at] == h and match(name))

        return among

    def _members(self, f, name: str, wanted, depth: int = 0):
        if name.endswith(".zip"):
            with zipfile.ZipFile(f) as z:
                for i in z.infolist():
                    if not i.is_dir() and wanted(i.filename):
                        yield i.filename, i.file_size, z.read(i)
            return
        with tarfile.open(fileobj=f, mode="r:*") as t:
            for m in t:
                if not m.isfile():
                    continue
                if depth < self.nesting and m.name.endswith(".tar"):
                    yield from self._members(io.BytesIO(t.extractfile(m).read()), m.name, wanted, depth + 1)
                elif wanted(m.name):
                    yield m.name, m.size, t.extractfile(m).read()

    def read(self, partition):
        import pyarrow.fs as pafs

        fs, path = pafs.FileSystem.from_uri(partition.path)
        with fs.open_input_file(path) as f:
            try:
                for name, size, content in self._members(f, path, self._wanted()):
                    yield partition.path, name, size, content
            except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError):
                if not self.skip_errors:
                    raise


class ArchiveSource(DataSource):
    @classmethod
    def name(cls):
        return "archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options)


class IndexReader(ArchiveReader):
    """Where the members of plain tar files lie; headers are read, and what is between them is skipped."""

    def _places(self, f, start: int, above: str = "", depth: int = 0):
        f.seek(start)
        with tarfile.open(fileobj=f, mode="r:") as t:
            for m in t:
                if not m.isfile():
                    continue
                # An archive inside is not compressed either, so its members have places in the outer file.
                if depth < self.nesting and m.name.endswith(".tar"):
                    yield from self._places(f, m.offset_data, f"{above}{m.name}/", depth + 1)
                else:
                    yield above + m.name, m.offset_data, m.size
                t.members.clear()  # it would hold on to every header

    def read(self, partition):
        import pyarrow.fs as pafs

        wanted = self._wanted()
        fs, path = pafs.FileSystem.from_uri(partition.path)
        with fs.open_input_file(path) as f:
            try:
                for name, offset, size in self._places(f, 0):
                    if wanted(name):
                        yield partition.path, name, offset, size
            except (tarfile.TarError, EOFError, OSError):
                if not self.skip_errors:
                    raise


class IndexSource(DataSource):
    @classmethod
    def name(cls):
        return "archive_index"

    def schema(self):
        return "archive string, name string, offset long, size long"

    def reader(self, schema):
        return IndexReader(self.options)


def member_index(spark: SparkSession, path: str, pattern: str | None = None, skip_errors: bool = False, nesting: int = NESTING) -> DataFrame:
    """(archive, name, offset, size) of the members of plain tar files; a member of an archive inside has that one's name in front.

    Worth keeping as a table: whoever has it needs to list no archive again.
    """
    spark.dataSource.register(IndexSource)
    reader = spark.read.format("archive_index").option("path", path).option("skiperrors", str(skip_errors).lower()).option("nesting", nesting)
    return (reader.option("pattern", pattern) if pattern else reader).load()


#: Bytes of an archive that one task reads members from, and of members that it hands on at a time.
SPLIT_BYTES, PART_BYTES = 64 << 20, 8 << 20
#: Tasks at most; beyond, each reads several splits.
MOST_PARTS = 20_000


def read_places(index: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(archive, name, size, content) of the members in an index (or a part of it), read from where they are; what else the index has goes along.

    An archive is split by offsets: a large one is read by many tasks, each in the order of the file. A member that the archive
    ends in the middle of is an error.
    """
    more = [c for c in index.columns if c not in ("archive", "name", "offset", "size")]
    placed = index.select("archive", "name", "offset", "size", F.floor(F.col("offset") / split_bytes).alias("__split"), *more)
    # A number of its own: adaptive execution would join partitions by the size of the index, not of what it points at.
    parts = min(max(placed.select("archive", "__split").distinct().count(), 1), MOST_PARTS)
    placed = placed.repartition(parts, "archive", "__split").sortWithinPartitions("archive", "offset").drop("__split")
    schema = ", ".join([SCHEMA, *(f"`{c}` {index.schema[c].dataType.simpleString()}" for c in more)])

    def run(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        opened, f, held, bytes_held = None, None, [], 0
        kinds = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["archive", "name", "size", "content", *more])
        for batch in batches:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), *batch.schema.types[4:]]
            for archive, name, offset, size, *others in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != opened:
                    if f:
                        f.close()
                    fs, path = pafs.FileSystem.from_uri(archive)
                    opened, f = archive, fs.open_input_file(path)
                f.seek(offset)
                content = f.read(size)
                if len(content) < size:
                    raise EOFError(f"{archive} ends within {name}")
                held.append((archive, name, size, content, *others))
                bytes_held += size
                if bytes_held >= PART_BYTES:
                    yield flush()
                    held, bytes_held = [], 0
        if held:
            yield flush()
        if f:
            f.close()

    return placed.mapInArrow(run, schema)


def name_hash(name: str) -> int:
    """The first 63 bits of an md5, as Spark computes it below."""
    return int(hashlib.md5(name.encode()).hexdigest()[:16], 16) >> 1


def read_archive(spark: SparkSession, path: str, pattern: str | None = None, skip_errors: bool = False, ids: DataFrame | None = None, nesting: int = NESTING) -> DataFrame:
    """(archive, name, size, content) of the members whose names match the regular expression.

    With ids(id) only members whose base name is one of them are read: the ids' hashes are a table
    that each reader holds, and a semi-join makes the result exact.
    """
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("archive").option("path", path).option("skiperrors", str(skip_errors).lower()).option("nesting", nesting)
    if pattern:
        reader = reader.option("pattern", pattern)
    if ids is None:
        return reader.load()
    asked = ids.select(F.col("id").cast("string").alias("__id")).distinct()
    h = F.shiftrightunsigned(F.conv(F.substring(F.md5("__id"), 1, 16), 16, -10).cast("long"), 1)
    table = scratch(spark)(asked.select("__id", h.alias("h")), "ids")
    if table.count() <= HELD_IDS:
        reader = reader.option("ids", table.inputFiles()[0].rpartition("/")[0] if table.inputFiles() else "")
    return reader.load().join(table.select("__id"), F.substring_index("name", "/", -1) == F.col("__id"), "left_semi")


def members_of(archive: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    """Members whose base name is among the ids: (id, image) in base64. ``read_archive(ids=...)`` doesn't even read the others."""
    rows = archive.select(F.substring_index("name", "/", -1).alias("id"), to_base64("content").alias("image"))
    return rows.join(ids.select(F.col(on).alias("id")).distinct(), "id", "left_semi")


def read_members(archive: DataFrame, names: DataFrame) -> DataFrame:
    """names(name) with the member's text: one scan and a join, however many names."""
    return names.join(archive.select("name", F.decode("content", "UTF-8").alias("text")), "name", "left")


def read_image_tar(spark: SparkSession, path: str, extensions=("png", "jpg", "jpeg"), labels: DataFrame | None = None) -> DataFrame:
    """(archive, name, label, image): the label is the member's folder, or the archive's name where it has none."""
    rows = read_archive(spark, path, r"(?i)\.(" + "|".join(extensions) + ")$")
    folder = F.regexp_extract("name", r"([^/]+)/[^/]*$", 1)
    label = F.when(folder != "", folder).otherwise(F.regexp_extract("archive", r"([^/]+)\.[^/]*$", 1))
    out = rows.select("archive", "name", label.alias("label"), to_base64("content").alias("image"))
    return out.join(labels, "label", "left") if labels is not None else out


def read_shards(spark: SparkSession, pattern: str, image_key: str = "jpg", target_key: str = "cls", alt_label: str | None = None) -> DataFrame:
    """(archive, key, image, label, json): a sample is the members that share the name up to the first dot.

    With ``alt_label`` the label is that field of the sample's JSON; negative ones are left out. Damaged shards end where they are damaged.
    """
    return samples(read_archive(spark, pattern, skip_errors=True), image_key, target_key, alt_label)


def samples(rows: DataFrame, image_key: str = "jpg", target_key: str = "cls", alt_label: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Members (archive, name, content) put together as samples; ``more`` are columns in which a sample's members agree."""
    base = F.substring_index("name", "/", -1)
    parts = rows.select("archive", F.concat(F.substr("name", F.lit(1), F.length("name") - F.length(base)), F.substring_index(base, ".", 1)).alias("key"), F.regexp_replace(base, r"^[^.]*\.", "").alias("ext"), "content", *more)
    of = lambda k: F.max(F.when(F.col("ext") == k, F.col("content")))
    out = parts.groupBy("archive", "key", *more).agg(of(image_key).alias("image"), F.trim(F.decode(of(target_key), "UTF-8")).cast("int").alias("cls"), F.decode(of("json"), "UTF-8").alias("json"))
    label = F.get_json_object("json", f"$.{alt_label}").cast("int") if alt_label else F.col("cls")
    out = out.withColumn("label", label).drop("cls")
    return out.where("label >= 0") if alt_label else out
