"""Purge plans: rows whose content is on a list of digests."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.operators.groups import is_short, join_groups
from twinsieve.operators.pending import one_per_inode


# Up to this many digests (33 bytes each) are broadcast to the manifest.
BROADCAST_DIGESTS = 250_000


def _broadcast_list(reference: DataFrame) -> DataFrame | None:
    digests = reference.select("md5")
    return F.broadcast(digests) if is_short(digests, BROADCAST_DIGESTS) else None


def _listed(manifest: DataFrame, reference: DataFrame) -> DataFrame:
    """Digests of the manifest that are on the list, each with its row count.

    Both sides are reduced to one row per digest before they meet.
    """
    hashed = manifest.filter(F.col("md5").isNotNull())
    mine = hashed.groupBy("md5").agg(F.count("*").alias("n"))
    return mine.join(reference.select("md5").distinct(), "md5", "left_semi").withColumn(
        "listed", F.lit(True)
    )


def purge_candidates(manifest: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows whose digest is on the list. A short list is broadcast, and the manifest
    stays where it is."""
    short = _broadcast_list(reference)
    if short is not None:
        return manifest.join(short, "md5", "left_semi").select(*manifest.columns)
    hashed = manifest.filter(F.col("md5").isNotNull())
    listed = _listed(manifest, reference)
    return join_groups(hashed, listed, ["md5"], how="inner").select(*manifest.columns)


def purge_survivors(manifest: DataFrame, reference: DataFrame) -> DataFrame:
    """All other rows; those without digest are among them."""
    short = _broadcast_list(reference)
    if short is not None:
        return manifest.join(short, "md5", "left_anti").select(*manifest.columns)
    listed = _listed(manifest, reference)
    joined = join_groups(manifest, listed, ["md5"])
    return joined.filter(F.col("listed").isNull()).select(*manifest.columns)


def purge_one_per_inode(manifest: DataFrame, reference: DataFrame) -> DataFrame:
    """Of the candidates, only the first path of each physical object."""
    return one_per_inode(purge_candidates(manifest, reference)).select(*manifest.columns)
