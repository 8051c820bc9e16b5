"""Building manifests: from an inventory with stat columns, or from table rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions import byte_size, content_digest, is_regular_file
from twinsieve.schema import INVENTORY, MANIFEST

ROW_MODE = 0o100644  # a table row counts as a regular file


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """An inventory table: path, root and the `stat` struct of every entry."""
    return spark.read.schema(INVENTORY).parquet(path)


def regular_files(inventory: DataFrame) -> DataFrame:
    """Entries whose mode says regular file: no directories, no symlinks."""
    mode = "stat.mode" if "stat" in inventory.columns else "mode"
    return inventory.filter(is_regular_file(mode))


def manifest_from_inventory(inventory: DataFrame) -> DataFrame:
    """Regular files of an inventory in manifest layout, digests still unknown."""
    return regular_files(inventory).select(
        "path",
        "root",
        F.col("stat.dev").alias("device"),
        F.col("stat.ino").alias("inode"),
        F.col("stat.mode").alias("mode"),
        F.col("stat.size").alias("size"),
        F.col("stat.mtime_us").alias("mtime_us"),
        F.col("stat.nlink").alias("links"),
        F.lit(None).cast("string").alias("md5"),
    )


def manifest_from_rows(
    table: DataFrame,
    path: Column,
    payload: str,
    *,
    root: Column,
    mtime_us: Column | None = None,
    with_digest: bool = True,
) -> DataFrame:
    """Treat every row of a table as an object with `payload` as its content.

    A row has no inode, so its path is its identity.
    """
    md5 = content_digest(payload) if with_digest else F.lit(None).cast("string")
    return table.select(
        path.alias("path"),
        root.alias("root"),
        F.lit(0).cast("long").alias("device"),
        F.lit(None).cast("long").alias("inode"),
        F.lit(ROW_MODE).alias("mode"),
        byte_size(payload).alias("size"),
        (F.lit(0) if mtime_us is None else mtime_us).cast("long").alias("mtime_us"),
        F.lit(1).cast("long").alias("links"),
        md5.alias("md5"),
    )


def union_roots(*manifests: DataFrame) -> DataFrame:
    """All rows of several roots; a path that overlapping roots list twice counts
    once, under the root that sorts first."""
    together = reduce(DataFrame.unionByName, manifests)
    rest = [c for c in MANIFEST.fieldNames() if c != "path"]
    one = together.groupBy("path").agg(F.min(F.struct(*rest)).alias("row"))
    return one.select("path", *[F.col("row")[c].alias(c) for c in rest])
