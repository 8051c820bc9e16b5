"""Making digests agree among rows that are the same physical object."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.functions import identity
from twinsieve.operators.groups import join_groups, with_group_values


def with_identity(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("identity", identity())


def has_inode() -> Column:
    """Whether the physical object of a row is known: its device and its inode."""
    return F.coalesce((F.col("inode") != 0) & F.col("device").isNotNull(), F.lit(False))


def _per_object(
    manifest: DataFrame,
    values: dict[str, Column],
    md5: Column,
    *,
    trust_links: bool = False,
) -> DataFrame:
    """Replace the digests of rows that may share an object by `md5`, which is made
    from `values` over the object. All other rows stay as and where they are."""
    may_share = has_inode()
    if trust_links:
        may_share = may_share & (F.coalesce("links", F.lit(2)) > 1)
    shared = with_identity(manifest.filter(may_share))
    grouped = with_group_values(shared, ["identity"], values)
    replaced = grouped.withColumn("md5", md5).select(*manifest.columns)
    return replaced.unionByName(manifest.filter(~may_share))


def sync_digests(manifest: DataFrame, *, trust_links: bool = False) -> DataFrame:
    """One digest per physical object.

    An object with a single known digest gives it to all its paths; one with
    several has them all cleared; one with none stays as it is. Rows without a known
    inode cannot share an object and are not shuffled. With `trust_links` neither
    are rows with a single link, which is most of a usual tree; leave it off where
    link counts may be out of date.
    """
    known = {"lo": F.min("md5"), "hi": F.max("md5")}
    agreed = F.when(F.col("lo") == F.col("hi"), F.col("hi"))
    return _per_object(manifest, known, agreed, trust_links=trust_links)


def fill_digests(manifest: DataFrame) -> DataFrame:
    """Only fill gaps: a row without digest takes that of its object, if the object
    has exactly one and more than one link. Contradicting digests stay in place."""
    known = {"lo": F.min("md5"), "hi": F.max("md5"), "affected": _affected()}
    filled = F.when(F.col("affected") & (F.col("lo") == F.col("hi")), F.col("hi"))
    return _per_object(manifest, known, F.coalesce("md5", filled))


def inode_profile(manifest: DataFrame) -> DataFrame:
    """Per physical object: paths, digested paths, distinct digests, first path."""
    return (
        with_identity(manifest)
        .groupBy("identity")
        .agg(
            F.count("*").alias("n_paths"),
            F.count("md5").alias("n_hashed"),
            F.count_distinct("md5").alias("n_digests"),
            F.min("path").alias("first_path"),
        )
    )


def inode_conflicts(manifest: DataFrame) -> DataFrame:
    """Physical objects whose paths carry more than one digest, one row per digest."""
    keyed = with_identity(manifest).filter(F.col("md5").isNotNull())
    per_digest = keyed.groupBy("identity", "md5").agg(
        F.count("*").alias("n_paths"), F.min("path").alias("first_path")
    )
    conflicting = (
        per_digest.groupBy("identity")
        .agg(F.count("*").alias("n_digests"))
        .filter("n_digests > 1")
    )
    joined = join_groups(
        per_digest, conflicting, ["identity"], how="inner", n="n_digests", spread_by="md5"
    )
    return joined.select("identity", "md5", "n_paths", "n_digests", "first_path")


def inode_flags(manifest: DataFrame) -> DataFrame:
    """Per physical object: are all, any or none of its paths digested."""
    hashed = F.col("md5").isNotNull()
    return (
        with_identity(manifest)
        .groupBy("identity")
        .agg(
            F.bool_and(hashed).alias("all_hashed"),
            F.bool_or(hashed).alias("any_hashed"),
            F.bool_and(~hashed).alias("none_hashed"),
        )
    )


def linked_without_digest(manifest: DataFrame) -> DataFrame:
    return manifest.filter((F.col("links") > 1) & F.col("md5").isNull())


def _affected() -> Column:
    return F.bool_or((F.col("links") > 1) & F.col("md5").isNull())


def affected_rows(manifest: DataFrame) -> DataFrame:
    """All paths of every object that has a linked path without digest. Rows that are
    objects of their own are judged where they are."""
    shared = with_identity(manifest.filter(has_inode()))
    groups = shared.groupBy("identity").agg(F.count("*").alias("n"), _affected().alias("affected"))
    found = join_groups(shared, groups.filter("affected"), ["identity"], how="inner")
    alone = linked_without_digest(manifest.filter(~has_inode()))
    return found.select(*manifest.columns).unionByName(alone)
