"""Tables in the folder that driver and executors share: lineage ends in them, and they survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local master gets a temporary one; a cluster must name its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='kinweave-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Tables of this process that are still there, in the order in which they were written.
_THERE: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, results are read; at its end, the tables that were written for them are removed.

    A lazy result reads its tables whenever it is run, so it must have been collected or written before.
    """
    mark = len(_THERE)
    try:
        yield
    finally:
        for path in _THERE[mark:]:
            remove(spark, path)


def written(df: DataFrame, name: str, merge: bool = False) -> DataFrame:
    """df written as Parquet into the shared folder and read back."""
    return Rounds(name, merge=merge).put(df)


class Rounds:
    """The tables of a loop: each is written and read back, and the ones before the last `keep` are removed, as nothing reads them.

    merge: joins with them are sort-merge joins. A file of a few MB holds many times as much in rows of keys, so where a loop joins its
    tables in every round, broadcasts would send all of them through the driver.
    """

    def __init__(self, name: str, keep: int = 1, merge: bool = False) -> None:
        self.name, self.keep, self.merge, self.paths, self.schema = name, keep, merge, [], None

    def put(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path = f"{shared_folder(spark)}/{self.name}-{uuid.uuid4().hex}"
        _THERE.append(path)
        df.write.parquet(path)
        self.paths.append(path)
        self.schema = df.schema
        while len(self.paths) > self.keep:
            remove(spark, self.paths.pop(0))
        back = spark.read.schema(df.schema).parquet(path)
        return back.hint("merge") if self.merge else back

    def all(self, spark: SparkSession) -> DataFrame:
        """Everything put so far (keep must cover it), one scan of all folders."""
        return spark.read.schema(self.schema).parquet(*self.paths)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _THERE:
        _THERE.remove(path)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has in any spelling."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
