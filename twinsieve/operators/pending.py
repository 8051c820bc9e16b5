"""Which rows still need a digest."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.operators.groups import join_groups
from twinsieve.operators.reconcile import has_inode, with_identity


def without_digest(manifest: DataFrame) -> DataFrame:
    return manifest.filter(F.col("md5").isNull())


def size_groups(manifest: DataFrame) -> DataFrame:
    """Sizes that more than one row has."""
    return manifest.groupBy("size").agg(F.count("*").alias("n")).filter("n > 1")


def size_collisions(manifest: DataFrame) -> DataFrame:
    """Rows without digest whose size some other row has too: only these can turn
    out to be duplicates. `n` is the number of rows of that size."""
    return join_groups(without_digest(manifest), size_groups(manifest), ["size"], how="inner")


def one_per_inode(pending: DataFrame) -> DataFrame:
    """The first path of each physical object, with the number of pending paths `n`.

    Picked by an aggregate of the whole row, so nothing is joined back. Rows without
    a known inode are objects of their own and are not shuffled.
    """
    rest = [c for c in pending.columns if c != "path"]
    keyed = with_identity(pending)
    firsts = (
        keyed.filter(has_inode())
        .groupBy("identity")
        .agg(F.min(F.struct("path", *rest)).alias("first"), F.count("*").alias("n"))
        .select("first.*", "identity", "n")
    )
    alone = keyed.filter(~has_inode()).withColumn("n", F.lit(1).cast("long"))
    return firsts.unionByName(alone)


def by_size(pending: DataFrame) -> DataFrame:
    """Smallest first."""
    return pending.orderBy("size", "path")


def by_size_largest_first(pending: DataFrame) -> DataFrame:
    return pending.orderBy(F.col("size").desc(), "path")
