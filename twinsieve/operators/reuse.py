"""Carrying digests over from the previous snapshot.

Every join here is on `path`, which is unique in a manifest, so no key is hot.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINGERPRINT = ["path", "size", "mtime_us"]


def old_digests(previous: DataFrame) -> DataFrame:
    """One trusted digest per (path, size, mtime_us) of a snapshot.

    Overlapping roots can leave a fingerprint in a snapshot twice; should the two
    rows disagree, neither digest is used.
    """
    lo, hi = F.min("md5"), F.max("md5")
    return (
        previous.filter(F.col("md5").isNotNull())
        .groupBy(*FINGERPRINT)
        .agg(F.when(lo == hi, lo).alias("old_md5"))
    )


def reuse_digests(manifest: DataFrame, previous: DataFrame) -> DataFrame:
    """Take the old digest of each row whose path, size and mtime are unchanged."""
    merged = manifest.join(old_digests(previous), FINGERPRINT, "left")
    return merged.withColumn("md5", F.coalesce("md5", "old_md5")).select(*manifest.columns)


def reuse_bucketed(manifest: DataFrame, previous: DataFrame) -> DataFrame:
    """As `reuse_digests`, for tables that are bucketed by path alike (`store_bucketed`).

    The snapshot becomes one row per path, with all its fingerprints, and tables meet by
    path only, so that nothing is exchanged. Elsewhere `reuse_digests` shuffles less.
    """
    known = previous.filter(F.col("md5").isNotNull()).groupBy("path")
    known = known.agg(F.collect_list(F.struct("size", "mtime_us", "md5")).alias("old"))
    merged = manifest.join(known, "path", "left")
    is_same = lambda x: (x["size"] == F.col("size")) & (x["mtime_us"] == F.col("mtime_us"))
    found = F.transform(F.filter("old", is_same), lambda x: x["md5"])
    old = F.when(F.array_min(found) == F.array_max(found), F.array_min(found))
    return merged.withColumn("md5", F.coalesce("md5", old)).select(*manifest.columns)


def old_by_path(previous: DataFrame) -> DataFrame:
    """Per path of a snapshot, its fingerprints, each with the one digest it is trusted
    for, or null. There are as many as roots that overlap there."""
    lo, hi = F.min("md5"), F.max("md5")
    settled = previous.groupBy(*FINGERPRINT).agg(F.when(lo == hi, lo).alias("md5"))
    return settled.groupBy("path").agg(
        F.collect_list(F.struct("size", "mtime_us", "md5")).alias("old")
    )


def _unchanged(size: Column, mtime_us: Column) -> Column:
    """The fingerprint among `old` that equals the given one, or null."""
    same = F.filter("old", lambda x: (x["size"] == size) & (x["mtime_us"] == mtime_us))
    return F.get(same, F.lit(0))


def reuse_by_path(manifest: DataFrame, previous: DataFrame) -> DataFrame:
    """As `reuse_digests`, by matching paths first and then dropping the digests of
    changed rows. Rows without a counterpart, or with a changed one, end up with none."""
    merged = manifest.join(old_by_path(previous), "path", "left")
    found = _unchanged(F.col("size"), F.col("mtime_us"))
    return merged.withColumn("md5", found["md5"]).select(*manifest.columns)


def digest_mismatches(manifest: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows that look unchanged, but whose digest in `manifest` is not the old one.

    `manifest` must carry recomputed digests. Digests reused from `previous` agree
    with it by construction.
    """
    hashed = manifest.filter(F.col("md5").isNotNull())
    return (
        hashed.join(old_digests(previous), FINGERPRINT)
        .filter(F.col("md5") != F.col("old_md5"))
        .select("path", "size", "mtime_us", "md5", "old_md5")
    )


def clear_mismatches(manifest: DataFrame, previous: DataFrame) -> DataFrame:
    """`reuse_digests`, except that a row whose own digest contradicts the old one
    is left without any, to be digested again."""
    merged = manifest.join(old_digests(previous), FINGERPRINT, "left")
    kept = F.when(
        F.col("md5").isNull() | F.col("old_md5").isNull() | (F.col("md5") == F.col("old_md5")),
        F.coalesce("md5", "old_md5"),
    )
    return merged.withColumn("md5", kept).select(*manifest.columns)


def mismatch_examples(mismatches: DataFrame, examples: int = 5) -> DataFrame:
    """The first few mismatched paths, each with the count of all mismatches."""
    total = mismatches.agg(F.count("*").alias("n_mismatches")).scalar()
    return (
        mismatches.select("path").orderBy("path").limit(examples).withColumn("n_mismatches", total)
    )


def snapshot_changes(manifest: DataFrame, previous: DataFrame) -> DataFrame:
    """What happened to each path since the snapshot: new, deleted, changed,
    unhashed (unchanged, but no digest was saved, or none to trust) or reused."""
    now = manifest.select("path", F.struct("size", "mtime_us").alias("new"))
    both = now.join(old_by_path(previous), "path", "full_outer")
    found = _unchanged(F.col("new.size"), F.col("new.mtime_us"))
    change = (
        F.when(F.col("old").isNull(), "new")
        .when(F.col("new").isNull(), "deleted")
        .when(found.isNull(), "changed")
        .when(found["md5"].isNull(), "unhashed")
        .otherwise("reused")
    )
    return both.select("path", change.alias("change"))
