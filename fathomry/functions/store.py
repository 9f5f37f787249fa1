"""Tables written to the folder that all executors share: the only way lineage is cut."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder (removed at exit);
    on a cluster that would lose data, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fathomry-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
    return root.rstrip("/")


#: Rows of a file, for a narrow table whose size is known before it is written.
ROWS_PER_FILE = 100_000


def save_table(df: DataFrame, path: str, *partition_by: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet and return the table as written.

    ``rows`` is a bound on the rows of a narrow table that comes from a shuffle: it gets a file
    for each ROWS_PER_FILE of them instead of one for every shuffle partition.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_OPEN: contextvars.ContextVar[list | None] = contextvars.ContextVar("open", default=None)


class Work:
    """Tables under one folder of ``spark.checkpoint.dir``. A lazy result may read them, so they stay
    until ``clear`` or the end of the ``cleared`` block in which the run began."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/fathomry/{name}-{uuid.uuid4().hex[:12]}"
        if (seen := _OPEN.get()) is not None:
            seen.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, *partition_by: str, rows: int | None = None) -> DataFrame:
        """Write df as Parquet and return the table as written; ``rows``, a bound on a narrow table's rows, sets its files."""
        return save_table(df, self.path(name), *partition_by, rows=rows)

    def load(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._delete(self.path(name))

    def sub(self, name: str) -> Work:
        """A folder inside this one, for the tables of a part."""
        part = Work.__new__(Work)
        part.spark, part.root = self.spark, f"{self.root}/{name}-{uuid.uuid4().hex[:12]}"
        return part

    def keep(self, *names: str) -> None:
        """Delete all tables of this run but those that a result still reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        for status in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path):
            if status.getPath().getName() not in names:
                self.drop(status.getPath().getName())

    def clear(self) -> None:
        """Delete all tables of this run."""
        self._delete(self.root)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def cleared():
    """On leaving, the tables of all runs that began inside are deleted."""
    token = _OPEN.set([])
    try:
        yield
    finally:
        for work in _OPEN.get():
            work.clear()
        _OPEN.reset(token)


def scratch(spark: SparkSession) -> Callable[..., DataFrame]:
    """A function (df, name) -> the table as written, in a folder of its own."""
    work = Work(spark, "scratch")
    return lambda df, name, rows=None: work.save(df, name, rows=rows)
