"""Row files: JSON lines, TSV, id lists, images, PDFs; readers by suffix; writers."""

from __future__ import annotations

import json
import re
import warnings

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.order import global_index
from ..functions.text import to_base64
from .pdf import count_pages
from .sink import append_summary, write_archives, write_files, write_markdown, write_rolled_jsonl, write_split_json  # noqa: F401  the other writers

# Image suffixes that count unless others are registered.
IMAGE_EXTENSIONS = {".png", ".jpg", ".jpeg"}


def add_image_extensions(*suffixes: str) -> None:
    if any(len(s) < 2 or s[0] != "." for s in suffixes):
        raise ValueError("a suffix starts with a dot")
    IMAGE_EXTENSIONS.update(s.lower() for s in suffixes)


def remove_image_extensions(*suffixes: str) -> None:
    IMAGE_EXTENSIONS.difference_update(s.lower() for s in suffixes)


def is_image_extension(suffix: str) -> bool:
    return suffix.lower() in IMAGE_EXTENSIONS


# -- readers ---------------------------------------------------------------------------


def read_jsonl(spark: SparkSession, paths, schema: StructType | str, predicate=None, glob: str | None = None) -> DataFrame:
    """JSON lines with a given schema; ``predicate`` is a Column and goes down to the scan."""
    reader = spark.read.schema(schema)
    df = (reader.option("pathGlobFilter", glob) if glob else reader).json(paths)
    return df if predicate is None else df.where(predicate)


def read_jsonl_map(spark: SparkSession, paths, schema, key: str = "id", predicate=None) -> DataFrame:
    """One row an id: the last line of the last file that has it."""
    lines = read_jsonl(spark, paths, schema, predicate).select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__n"))
    last = lines.groupBy(key).agg(F.max_by(F.struct(*[c for c in lines.columns if not c.startswith("__")]), F.struct("__f", "__b", "__n")).alias("r"))
    return last.select("r.*")


def read_tsv(spark: SparkSession, paths, schema=None, header: bool = True) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("quote", "")
    return (reader.schema(schema) if schema else reader).csv(paths, header=header)


def read_collection(spark: SparkSession, paths) -> DataFrame:
    """Headerless ``text_id, title, text``."""
    return read_tsv(spark, paths, "text_id string, title string, text string", header=False)


def read_queries(spark: SparkSession, paths) -> DataFrame:
    return read_tsv(spark, paths, "qid string, text string", header=False)


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """Prompts and id lists: (value)."""
    return spark.read.text(paths)


def read_whole_json(spark: SparkSession, paths, schema, unwrap: str | None = "data") -> DataFrame:
    """Files that are one JSON value each; ``unwrap`` names the array of records in it."""
    df = spark.read.schema(schema).option("multiLine", True).json(paths)
    return df.select(F.inline(unwrap)) if unwrap else df


def read_binary(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def read_images(spark: SparkSession, path: str, extensions=None, recursive: bool = True) -> DataFrame:
    """(id, image): undecoded files in base64, the id is the file's name."""
    kinds = [e.lower() for e in (extensions or IMAGE_EXTENSIONS)]
    df = read_binary(spark, path, recursive=recursive)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return df.where(suffix.isin(kinds)).select(F.substring_index("path", "/", -1).alias("id"), to_base64("content").alias("image"), "path")


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, pages) of the PDFs under a folder; ``pages`` is what the page tree states."""
    df = read_binary(spark, path, "*.pdf", recursive=True).select("path", "content")

    def run(batches):
        for batch in batches:
            yield batch.append_column("pages", pa.array([count_pages(c.as_py()) for c in batch.column(1)], pa.int32()))

    return df.mapInArrow(run, "path string, content binary, pages int")


def read_image_folder(spark: SparkSession, path: str, leaf_only: bool = True, extensions=None) -> DataFrame:
    """(path, label, class_index, image): a class for each folder, numbered in natural order."""
    from ..functions.text import natural_key

    images = read_images(spark, path, extensions)
    root = re.sub(r"^file:/+", "/", path.rstrip("/"))
    inner = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(root) + "/", "")
    folder = F.regexp_replace(inner, r"/?[^/]*$", "")
    label = F.substring_index(folder, "/", -1) if leaf_only else F.replace(folder, F.lit("/"), F.lit("_"))
    rows = images.withColumn("label", label)
    classes = global_index(rows.select("label").distinct(), [natural_key(F.col("label")), F.col("label")], "class_index")
    return rows.join(classes, "label").select("path", "label", "class_index", "image")


def class_map(spark: SparkSession, found: str | dict) -> DataFrame:
    """(label, class_index) from a dictionary, or from a text file of labels in file order. Pickled maps are refused: opening one runs code."""
    if isinstance(found, dict):
        return spark.createDataFrame([(str(k), int(v)) for k, v in found.items()], "label string, class_index long")
    if not found.endswith(".txt"):
        raise ValueError(f"no reader for the class map {found}")
    return read_class_map(spark, found)


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    """(label, class_index) from a text file of labels, in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: x != "")).alias("class_index", "label"))
    return lines.select(F.trim("label").alias("label"), F.col("class_index").cast("long"))


def read_parquet_rows(spark: SparkSession, path: str, split: str = "", name: str = "doc_id") -> DataFrame:
    """Parquet files whose names start with split, with a running row number over the files in name order."""
    df = spark.read.option("pathGlobFilter", f"{split}*.parquet").parquet(path)
    rows = df.select("*", F.col("_metadata.file_name").alias("__f"), F.col("_metadata.row_index").alias("__r"))
    return global_index(rows, [F.col("__f"), F.col("__r")], name).drop("__f", "__r")


def read_figures(df: DataFrame, outer: str = "caption_images", inner: str = "cil_pairs") -> DataFrame:
    """Nested rows as one row for each figure with exactly one image: (figure, caption, image)."""
    figures = df.select("*", F.posexplode(outer).alias("figure", "f")).where(F.size(F.col("f")[inner]) == 1)
    return figures.select(*[c for c in df.columns if c != outer], "figure", F.col("f.caption").alias("caption"), F.get(F.col("f")[inner], F.lit(0)).image.alias("image"))


def read_numbered_lines(spark: SparkSession, paths) -> DataFrame:
    """(file, line, value): lines with their number in the file, from 0. Files are read in splits, of any size."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__n"))
    placed = global_index(lines, [F.col("file"), F.col("__b"), F.col("__n")], "__i")
    first = placed.groupBy("file").agg(F.min("__i").alias("__first"))
    return placed.join(first, "file").select("file", (F.col("__i") - F.col("__first")).alias("line"), "value")


def read_pdf_jsonl(spark: SparkSession, paths, field: str = "pdf") -> DataFrame:
    """(name, pdf): the bytes of base64 PDFs, named after file and line."""
    lines = read_numbered_lines(spark, paths)
    stem = F.regexp_extract("file", r"([^/]*)\.[^./]*$", 1)
    return lines.select(F.concat(stem, F.lit("_"), F.col("line").cast("string"), F.lit(".pdf")).alias("name"), F.unbase64(F.get_json_object("value", f"$.{field}")).alias("pdf"))


def from_memory(spark: SparkSession, rows: list, schema: StructType | str) -> DataFrame:
    """Rows that the caller holds; dictionaries may lack fields."""
    return spark.createDataFrame(rows, schema)


def look_up(store: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(the store's rows with these ids, the ids that it doesn't have)."""
    asked = ids.select(key).distinct()
    return store.join(asked, key, "left_semi"), asked.join(store.select(key), key, "left_anti")


def page_images(pages: DataFrame, store: DataFrame, key: str = "id", image: str = "image") -> DataFrame:
    """(key, image): the bytes of the base64 images of sampled pages."""
    return store.join(pages.select(key).distinct(), key, "left_semi").select(key, F.unbase64(image).alias(image))


_BY_SUFFIX = {"jsonl": "json", "json": "json", "tsv": "tsv", "txt": "tsv", "parquet": "parquet"}


def read_by_suffix(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The reader that goes with the file's suffix; none means a folder of Parquet."""
    suffix = path.rstrip("/").rpartition("/")[2].rpartition(".")
    kind = _BY_SUFFIX.get(suffix[2]) if suffix[1] else "parquet"
    if kind == "json":
        return read_jsonl(spark, path, schema) if schema else spark.read.json(path)
    if kind == "tsv":
        return read_tsv(spark, path, schema)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}")


# Folder names that stand for one split.
SPLITS = (("train", "training"), ("val", "valid", "validation", "eval", "evaluation"))


def split_folder(root: str, split: str) -> str:
    """The sub-folder of a split, or of a synonym of it; root itself where there is none. ``split`` may end in a range in brackets."""
    import pyarrow.fs as pafs

    filesystem, base = pafs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
    name = split.split("[")[0]
    for folder in (name, *next((s for s in SPLITS if name in s), ())):
        if filesystem.get_file_info(f"{base.rstrip('/')}/{folder}").type == pafs.FileType.Directory:
            return f"{root.rstrip('/')}/{folder}"
    return root


def open_dataset(spark: SparkSession, name: str, root: str, schema=None) -> DataFrame:
    """``wds/`` and a tar name are shards, ``hfds/`` and ``hfids/`` Parquet, ``tfds/`` TFRecord files, anything else an image folder or tar."""
    from .archives import read_image_tar, read_shards
    from .tfrecord import read_tfrecords

    prefix, _, rest = name.rpartition("/")
    if prefix == "wds":
        return read_shards(spark, f"{root}/{rest}" if rest else root)
    if prefix in ("hfds", "hfids"):
        return spark.read.parquet(f"{root}/{rest}" if rest else root)
    if prefix == "tfds":
        return read_tfrecords(spark, f"{root}/{rest}" if rest else root)
    if root.endswith(".tar"):
        return read_image_tar(spark, root)
    return read_image_folder(spark, root)


# -- counts ----------------------------------------------------------------------------


def row_count(df: DataFrame, metadata: str | None = None) -> int:
    """``length`` of the metadata file if it can be read, else a count."""
    if metadata:
        try:
            found = df.sparkSession.read.text(metadata, wholetext=True).first()
            return int(json.loads(found[0])["length"])
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        except (TypeError, ValueError, KeyError) as e:
            warnings.warn(f"{metadata} is damaged ({e!r}); the rows are counted", stacklevel=2)
    return df.count()


# -- writers ---------------------------------------------------------------------------


def write_jsonl(df: DataFrame, path: str, mode: str = "error", max_records: int | None = None, partition_by: list[str] | None = None) -> None:
    """JSON lines with nulls kept; files roll at ``max_records``."""
    w = df.write.mode(mode).option("ignoreNullFields", False)
    if max_records:
        w = w.option("maxRecordsPerFile", max_records)
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def write_batches(df: DataFrame, path: str, batch: str = "batch_id", mode: str = "error") -> None:
    """A folder for each batch."""
    write_jsonl(df.repartition(batch), path, mode, partition_by=[batch])


def write_dataset(df: DataFrame, path: str, mode: str = "error", **metadata) -> int:
    """JSON lines under ``path``/data and the row count beside them."""
    write_jsonl(df, f"{path}/data", mode)
    n = df.sparkSession.read.text(f"{path}/data").count()
    line = json.dumps({"length": n, **metadata})
    df.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return n


def write_pages(df: DataFrame, path: str, mode: str = "error", max_records: int | None = None) -> None:
    """A page or embedding store: Parquet keyed by its id."""
    w = df.write.mode(mode)
    (w.option("maxRecordsPerFile", max_records) if max_records else w).parquet(path)


def write_predictions(df: DataFrame, path: str, form: str = "parquet", mode: str = "error") -> None:
    """Predictions as ``parquet``, ``json`` (records), ``json-split`` (columns once, then rows), ``json-index`` (by the first column) or ``csv``."""
    if form in ("json-split", "json-index"):
        write_split_json(df, path, df.columns[0] if form == "json-index" else None, mode)
    elif form == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif form == "json":
        write_jsonl(df, path, mode)
    elif form == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown form {form}")
