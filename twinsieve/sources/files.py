"""File trees as inventories.

Two ways in: Spark's ``binaryFile`` source for any file system Spark reads, and a
walk by tasks for trees mounted on every executor. The first has no inode, mode or
link count, drops empty files and hides names that start with "." or "_". The
second sees everything ``lstat`` sees.
"""

import os
import stat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsieve.schema import INVENTORY, STAT
from twinsieve.workspace import new_path

ENTRY = T.StructType(
    [
        *INVENTORY.fields,
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)

BATCH_ROWS = 10_000


def scan_listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, size and mtime_us of every file under `roots`; no content is read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(roots)
        .select(
            "path",
            F.col("length").alias("size"),
            F.unix_micros("modificationTime").alias("mtime_us"),
        )
    )


def _list_directories(batches):
    """Entries of each directory in `batches`, in batches of bounded size."""

    def entry(root, found):
        try:
            # lstat, not DirEntry.stat: the latter has no inode on some systems.
            s = os.lstat(found.path)
        except OSError as error:
            return (found.path, root, None, False, str(error))
        mtime_us = s.st_mtime_ns // 1000
        stats = (s.st_mode, s.st_ino, s.st_dev, s.st_nlink, s.st_size, mtime_us)
        stats = dict(zip(STAT.fieldNames(), stats))
        return (found.path, root, stats, stat.S_ISDIR(s.st_mode), None)

    def entries(root, directory):
        try:
            with os.scandir(directory) as listing:
                for found in listing:
                    yield entry(root, found)
        except OSError as error:
            yield (directory, root, None, False, str(error))

    for batch in batches:
        out = []
        for root, directory in zip(batch["root"], batch["path"]):
            for row in entries(root, directory):
                out.append(row)
                if len(out) == BATCH_ROWS:
                    yield pd.DataFrame(out, columns=ENTRY.fieldNames())
                    out = []
        yield pd.DataFrame(out, columns=ENTRY.fieldNames())


def walk_tree(spark: SparkSession, roots: list[str], tasks: int | None = None) -> DataFrame:
    """Every entry below `roots` on a file system that all executors mount.

    One Spark job per directory level: the directories found on a level are spread
    over the tasks of the next. Only the count of levels is a loop on the driver.
    Symlinks are listed but not followed. An entry that cannot be read has a null
    `stat` and its message in `error`; see `unreadable`.
    """
    tasks = tasks or spark.sparkContext.defaultParallelism
    base = new_path(spark, "walk")
    frontier = spark.createDataFrame(
        [(os.path.abspath(r), os.path.abspath(r)) for r in roots], "path string, root string"
    )
    level = 0
    while True:
        found = frontier.repartition(tasks, "path").mapInPandas(_list_directories, ENTRY)
        path = f"{base}/level={level}"
        found.write.parquet(path)
        frontier = spark.read.schema(ENTRY).parquet(path).filter("is_dir").select("path", "root")
        if frontier.isEmpty():
            break
        level += 1
    return spark.read.schema(ENTRY).parquet(*[f"{base}/level={n}" for n in range(level + 1)])


def inventory_of(entries: DataFrame) -> DataFrame:
    """The readable entries of a walk in inventory layout. A path that overlapping
    roots list twice counts once, under the root that sorts first."""
    return (
        entries.filter(F.col("stat").isNotNull())
        .groupBy("path")
        .agg(F.min(F.struct("root", "stat")).alias("first"))
        .select("path", "first.root", "first.stat")
    )


def unreadable(entries: DataFrame) -> DataFrame:
    """Number of entries a walk had to skip, per root."""
    return (
        entries.filter(F.col("error").isNotNull())
        .groupBy("root")
        .agg(F.count("*").alias("n_unreadable"))
    )
