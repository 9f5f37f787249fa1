"""Splits of sharded datasets: which shards, and which samples of them, a split or a worker reads.

A dataset's ``_info.json`` (or ``info.json``) names its splits, each with file names and numbers of samples. A plan
is made of that alone: rows (place, file, first, end, samples) of the shards that are read at all, a sample's place counting within its shard.
Shards are small in number beside samples, and come from one file, so a plan is made on the driver.
"""

from __future__ import annotations

import json
import math
import re
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.store import Work
from .archives import expand, member_index, read_places, samples

#: Names of the file that describes a dataset, in the order in which they are looked for.
INFO_NAMES = ("_info.json", "info.json")
_RANGE = re.compile(r"([^\[\]+]+)(?:\[(-?\d+%?)?:(-?\d+%?)?\])?$")


@dataclass(frozen=True)
class Split:
    """Shards in order, with their samples where the info says how many; ``count`` is what the split itself says."""

    name: str
    files: tuple[str, ...]
    lengths: tuple[int, ...] = ()
    count: int = 0
    alt_label: str | None = None


def read_info(root: str) -> dict:
    """The dataset's description; empty, with a warning, where there is none."""
    import pyarrow.fs as pafs

    fs, base = pafs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
    for name in INFO_NAMES:
        if fs.get_file_info(f"{base.rstrip('/')}/{name}").type == pafs.FileType.File:
            with fs.open_input_file(f"{base.rstrip('/')}/{name}") as f:
                return json.loads(f.read())
    warnings.warn(f"no description of the dataset in {root}", stacklevel=2)
    return {}


def find_split(info: dict, name: str) -> Split:
    """A split by its name in the info, or by a brace pattern of shards, with the samples after ``|``.

    A pattern whose dash-separated parts end in a split's name (the fourth at most) takes its shards' lengths from there.
    """
    known = info.get("splits", {})
    if "tar" not in name and ".." not in name:
        if name not in known:
            raise ValueError(f"no split {name} among {', '.join(known) or 'none'}")
        s = known[name]
        return Split(s.get("name", name), tuple(s["filenames"]), tuple(s["shard_lengths"]), s["num_samples"], s.get("alt_label") or None)
    files, count = expand(name)
    pattern = name.partition("|")[0]
    part = "" if "::" in pattern else pattern.split("-", 3)[-1]
    if part in known and "-" in pattern:
        s = known[part]
        lengths = dict(zip(s["filenames"], s["shard_lengths"], strict=True))
        each = tuple(lengths[f] for f in files)
        return Split(part, tuple(files), each, count or sum(each), s.get("alt_label") or None)
    return Split("", tuple(files), (), count or 0)


def _bound(text: str | None, n: int, default: int) -> int:
    if not text:
        return default
    at = round(n * int(text[:-1]) / 100) if text.endswith("%") else int(text)
    return min(max(at + n if at < 0 else at, 0), n)


def plan(info: dict, spec: str) -> list[tuple[str, int, int]]:
    """(file, first, end) of what a split reads: ``train``, ``train[:100]``, ``train[10%:-5]``, or several joined by ``+``."""
    out = []
    for part in spec.split("+"):
        m = _RANGE.match(part.strip()) if "tar" not in part else None
        if "tar" in part:
            split, first, end = find_split(info, part), None, None
        elif not m:
            raise ValueError(f"not a split: {part}")
        else:
            split, first, end = find_split(info, m[1].strip()), m[2], m[3]
        if not split.lengths:
            if first or end:
                raise ValueError(f"{part}: a range needs the lengths of the shards")
            out += [(f, 0, -1) for f in split.files]
            continue
        n = sum(split.lengths)
        low, high, at = _bound(first, n, 0), _bound(end, n, n), 0
        for file, length in zip(split.files, split.lengths, strict=True):
            if max(low, at) < min(high, at + length):
                out.append((file, max(low - at, 0), min(high - at, length)))
            at += length
    return out


def even_parts(spec: str, n: int, count: int) -> list[str]:
    """The split cut into n ranges whose sizes differ by one at most."""
    ends = [round(i * count / n) for i in range(n + 1)]
    return [f"{spec}[{a}:{b}]" for a, b in zip(ends, ends[1:])]


def worker_plan(shards: list[tuple[str, int, int]], worker: int, workers: int) -> list[tuple[str, int, int]]:
    """The shards of one worker of all processes: every so-manieth."""
    return shards[worker::workers] if workers > 1 else list(shards)


def samples_per_worker(count: int, workers: int, replicas: int = 1, batch: int = 1, training: bool = False) -> int:
    """Samples that a worker gives in an epoch: whole batches in training, and never too few where there are several processes."""
    each = count / max(workers, replicas)
    if training or replicas > 1:
        each = math.ceil(each)
    return int(math.ceil(each / batch) * batch if training else each)


def read_plan(spark: SparkSession, root: str, shards: list[tuple[str, int, int]], image_key: str = "jpg", target_key: str = "cls", alt_label: str | None = None) -> DataFrame:
    """(archive, place, key, image, label, json) of a plan's samples.

    The planned shards are listed by their headers; a sample is placed by its first member, in the order of its shard, and only
    members of samples in range are read. A shard that is planned twice is read once, and its samples come for both ranges.
    """
    if not shards:
        return spark.createDataFrame([], "archive string, place long, key string, image binary, label int, json string")
    base = (root if "://" in root else f"file://{root}").rstrip("/")
    files = sorted({f for f, _, _ in shards})
    work = Work(spark, "splits")  # headers are read once, whatever the index is asked for
    index = work.save(member_index(spark, "::".join(f"{base}/{f}" for f in files), skip_errors=True, nesting=0), "index")
    file = F.substr("archive", F.lit(len(base) + 2))
    key = F.concat(F.regexp_extract("name", r"^(.*/)?", 1), F.substring_index(F.substring_index("name", "/", -1), ".", 1))
    at = F.min("offset").over(Window.partitionBy("archive", "key"))
    place = (F.dense_rank().over(Window.partitionBy("archive").orderBy("__at")) - 1).cast("long")
    placed = index.withColumn("key", key).withColumn("__at", at).withColumn("place", place).withColumn("file", file)
    # Only the plan is broadcast. The size of the index says nothing about that of what it points at, so contents are never joined with it.
    asked = F.broadcast(spark.createDataFrame(shards, "__file string, first long, end long"))
    among = (F.col("file") == F.col("__file")) & (F.col("place") >= F.col("first")) & ((F.col("place") < F.col("end")) | (F.col("end") < 0))
    members = work.save(placed.join(asked, among, "left_semi").select("archive", "name", "offset", "size", "place"), "members")
    found = samples(read_places(members), image_key, target_key, alt_label, ("place",)).withColumn("file", file)
    return found.join(asked, among).select("archive", "place", "key", "image", "label", "json")


def read_split(spark: SparkSession, root: str, spec: str, **options) -> DataFrame:
    """A split's samples, by its name or range in the dataset's info."""
    info = read_info(root)
    alt = None if "+" in spec or "tar" in spec else find_split(info, spec.partition("[")[0]).alt_label
    return read_plan(spark, root, plan(info, spec), **({"alt_label": alt} | options))
