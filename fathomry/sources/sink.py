"""A Python data sink for files that Spark's own writers can't make: named files, archives, files rolled by bytes.

Rows are (archive, name, content). ``kind`` says what becomes of them:

* ``each``: a file ``name`` for every row, with the content's bytes;
* ``rolled``: contents, each with an ``ending``, one after the other in files that end when they reach ``maxbytes``;
* ``tar`` and ``zip``: members ``name`` of the archives named in ``archive``. The rows of an archive
  have to lie together in one partition, which ``write_archives`` sees to.

Files are named after rows, or after the job and partition, so a task that runs again writes the
same ones. What a job's failed attempts have left besides is deleted at its commit.
"""

from __future__ import annotations

import io
import json
import tarfile
import uuid
import zipfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SCHEMA = "archive string, name string, content binary"
MAX_BYTES = 8 << 20


@dataclass
class Written(WriterCommitMessage):
    names: list


def _open(uri: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class FileSink(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.uri, self.kind = options["path"].rstrip("/"), options.get("kind", "each")
        self.max_bytes, self.suffix = int(options.get("maxbytes", MAX_BYTES)), options.get("suffix", ".jsonl")
        self.job, self.ending = options.get("job") or uuid.uuid4().hex[:12], b"\n" if options.get("lines", "true") == "true" else b""

    def _rows(self, iterator):
        for batch in iterator:
            for archive, name, content in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("archive", "name", "content")), strict=True):
                yield archive.as_py(), name.as_py(), content.as_py() or b""

    def write(self, iterator):
        filesystem, root = _open(self.uri)
        filesystem.create_dir(root, recursive=True)
        make = {"each": self._each, "rolled": self._rolled, "tar": self._archives, "zip": self._archives}[self.kind]
        return Written(list(make(filesystem, root, self._rows(iterator))))

    def _each(self, filesystem, root, rows):
        for _, name, content in rows:
            if "/" in name:
                filesystem.create_dir(f"{root}/{name.rpartition('/')[0]}", recursive=True)
            with filesystem.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(content)
        return ()

    def _rolled(self, filesystem, root, rows):
        from pyspark import TaskContext

        part, out, size, n = TaskContext.get().partitionId(), None, 0, 0
        for _, _, content in rows:
            if out is None or size >= self.max_bytes:
                if out is not None:
                    out.close()
                name = f"{self.job}-{part:05d}-{n:05d}{self.suffix}"
                yield name
                out, size, n = filesystem.open_output_stream(f"{root}/{name}", compression=None), 0, n + 1
            out.write(content + self.ending)
            size += len(content) + len(self.ending)
        if out is not None:
            out.close()

    def _archives(self, filesystem, root, rows):
        stream = out = last = None

        def close():
            if out is not None:
                out.close()
                stream.close()

        for archive, name, content in rows:
            if archive != last:
                close()
                stream, last = filesystem.open_output_stream(f"{root}/{archive}", compression=None), archive
                gz = archive.endswith((".gz", ".tgz"))
                out = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) if self.kind == "zip" else tarfile.open(fileobj=stream, mode="w|gz" if gz else "w|")
            if self.kind == "zip":
                out.writestr(name, content)
            else:
                info = tarfile.TarInfo(name)
                info.size = len(content)
                out.addfile(info, io.BytesIO(content))
                out.members.clear()  # it would hold on to every header
        close()
        return ()

    def commit(self, messages):
        import pyarrow.fs as pafs

        if self.kind == "rolled":
            filesystem, root = _open(self.uri)
            filesystem.create_dir(root, recursive=True)
            good = {n for m in messages if m for n in m.names}
            for info in filesystem.get_file_info(pafs.FileSelector(root)):
                if info.base_name.startswith(self.job) and info.base_name not in good:
                    filesystem.delete_file(info.path)

    def abort(self, messages):
        pass


class FileSinkSource(DataSource):
    @classmethod
    def name(cls):
        return "filesink"

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        return FileSink(self.options)


def _write(df: DataFrame, path: str, **options) -> None:
    df.sparkSession.dataSource.register(FileSinkSource)
    df.select("archive", "name", "content").write.format("filesink").options(path=path, job=uuid.uuid4().hex[:12], **options).mode("append").save()


def write_files(df: DataFrame, path: str, name: Column, content: Column) -> None:
    """A file for each row: texts or images by id. Of rows with one name any one stays."""
    _write(df.select(F.lit(None).cast("string").alias("archive"), name.cast("string").alias("name"), content.cast("binary").alias("content")), path, kind="each")


def write_rolled_jsonl(df: DataFrame, path: str, max_bytes: int = MAX_BYTES) -> None:
    """JSON lines with nulls kept; a file ends with the line by which it reaches ``max_bytes``."""
    line = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    _write(df.select(F.lit(None).cast("string").alias("archive"), F.lit(None).cast("string").alias("name"), line.cast("binary").alias("content")), path, kind="rolled", maxbytes=max_bytes)


def write_raw(df: DataFrame, path: str, content: Column, suffix: str, max_bytes: int = MAX_BYTES) -> None:
    """Contents one after the other in files of about ``max_bytes``."""
    rows = df.select(F.lit(None).cast("string").alias("archive"), F.lit(None).cast("string").alias("name"), content.cast("binary").alias("content"))
    _write(rows, path, kind="rolled", maxbytes=max_bytes, suffix=suffix, lines="false")


def write_archives(df: DataFrame, path: str, archive: Column, name: Column, content: Column, kind: str = "tar") -> None:
    """Rows as members of tar or zip archives, by name; each archive is written by one task, member by member."""
    if kind not in ("tar", "zip"):
        raise ValueError(f"unknown kind {kind}")
    rows = df.select(archive.cast("string").alias("archive"), name.cast("string").alias("name"), content.cast("binary").alias("content"))
    _write(rows.repartition("archive").sortWithinPartitions("archive", "name"), path, kind=kind)


def write_markdown(df: DataFrame, path: str, title: Column, text: Column, image: Column | None = None, image_folder: str = "images") -> None:
    """A preview page for each row, ``title.md``, and its undecoded image beside it where there is one."""
    rows = df.select(title.cast("string").alias("t"), F.coalesce(text, F.lit("")).alias("x"), (image if image is not None else F.lit(None).cast("binary")).cast("binary").alias("i"))
    link = F.when(F.col("i").isNotNull(), F.concat(F.lit(f"![]({image_folder}/"), "t", F.lit(".png)\n\n"))).otherwise(F.lit(""))
    write_files(rows, path, F.concat("t", F.lit(".md")), F.concat(F.lit("# "), "t", F.lit("\n\n"), link, "x", F.lit("\n")))
    write_files(rows.where("i IS NOT NULL"), f"{path}/{image_folder}", F.concat("t", F.lit(".png")), F.col("i"))


def append_summary(df: DataFrame, path: str, most: int = 10_000) -> None:
    """Rows appended to one CSV file, whose header is written once. A summary is a log of a run: more than ``most`` rows at a time are an error."""
    import csv

    import pyarrow.fs as pafs

    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a summary of more than {most} rows at a time")
    filesystem, file = _open(path)
    there = filesystem.get_file_info(file).type == pafs.FileType.File
    old = filesystem.open_input_file(file).read() if there else b""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    if not there:
        writer.writerow(df.columns)
    writer.writerows(tuple(r) for r in rows)
    filesystem.create_dir(file.rpartition("/")[0], recursive=True)
    with filesystem.open_output_stream(file, compression=None) as f:
        f.write(old + out.getvalue().encode())


def write_split_json(df: DataFrame, path: str, index: str | None = None, mode: str = "error") -> None:
    """Every part file is one JSON value: ``{"columns": [...], "data": [[...], ...]}``, or with ``index`` one object from its values to records."""
    columns = [c for c in df.columns if c != index]

    def run(batches):
        import pandas as pd

        first = True
        for batch in batches:
            for row in batch.to_dict("records"):
                head = ("{" if index else json.dumps({"columns": columns})[:-1] + ', "data": [') if first else ""
                record = json.loads(row["record"])
                values = [record.get(c) for c in columns]
                body = f"{json.dumps(record.get(index) if isinstance(record.get(index), str) else str(record.get(index)))}: {json.dumps(dict(zip(columns, values)))}" if index else json.dumps(values)
                yield pd.DataFrame({"value": [head + ("" if first else ", ") + body]})
                first = False
        if not first:
            yield pd.DataFrame({"value": ["}" if index else "]}"]})

    record = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record")
    df.select(record).mapInPandas(run, "value string").write.mode(mode).text(path)
