"""Groups of equal content and the election of one member of each.

Content is compared by md5 within a device, as objects can only be linked there; rows on
an unknown device take no part.
Every election is a total order that ends in the path.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.operators.groups import join_groups
from twinsieve.operators.reconcile import with_identity

CONTENT = ["device", "md5"]


def hashed_rows(manifest: DataFrame) -> DataFrame:
    """Rows that links could be planned for: on a known device, with a digest."""
    return with_identity(manifest).filter(F.col("device").isNotNull() & F.col("md5").isNotNull())


def _best(order: Column) -> Column:
    return F.min(F.struct(order.alias("order"), "path", "inode", "identity"))


# Policies that look at one row at a time, by what makes a row come first.
ORDERS = {
    "max_links": lambda: -F.coalesce("links", F.lit(1)),
    "first_seen": lambda: F.col("mtime_us"),
}
# `modal_inode` looks at objects: the one that most paths of the group point at.
POLICIES = [*ORDERS, "modal_inode"]


def _check(policy: str) -> None:
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}, not {policy!r}")


def _by_row(hashed: DataFrame, policy: str) -> DataFrame:
    return hashed.groupBy(*CONTENT).agg(
        F.count("*").alias("n"),
        F.min("identity").alias("lo_identity"),
        F.max("identity").alias("hi_identity"),
        _best(ORDERS[policy]()).alias("best"),
    )


def _by_object(hashed: DataFrame) -> DataFrame:
    objects = hashed.groupBy(*CONTENT, "identity").agg(
        F.count("*").alias("paths"), F.min(F.struct("path", "inode")).alias("first")
    )
    best = F.struct((-F.col("paths")).alias("order"), "first.path", "first.inode", "identity")
    return objects.groupBy(*CONTENT).agg(
        F.sum("paths").alias("n"),
        F.min("identity").alias("lo_identity"),
        F.max("identity").alias("hi_identity"),
        F.min(best).alias("best"),
    )


def canonicals(manifest: DataFrame, policy: str = "max_links") -> DataFrame:
    """The canonical member of every content group.

    `policy` says which: max_links, the member with most links; first_seen, the
    oldest; modal_inode, the object that most paths of the group already point at.
    `n` counts the paths of a group; lo_identity and hi_identity differ exactly
    when it consists of more than one physical object.
    """
    _check(policy)
    hashed = hashed_rows(manifest)
    elected = _by_row(hashed, policy) if policy in ORDERS else _by_object(hashed)
    return elected.select(
        *CONTENT,
        "n",
        "lo_identity",
        "hi_identity",
        F.col("best.path").alias("canonical_path"),
        F.col("best.inode").alias("canonical_inode"),
        F.col("best.identity").alias("canonical_identity"),
    )


def with_canonical(manifest: DataFrame, policy: str = "max_links") -> DataFrame:
    """The rows of contents that several objects hold, each with the canonical member.

    Contents of a single object are dropped by the narrow election, before rows meet
    their groups. `manifest` is read several times: pass a stored table.
    """
    _check(policy)
    groups = canonicals(manifest, policy).filter("lo_identity <> hi_identity")
    return join_groups(hashed_rows(manifest), groups, CONTENT, how="inner")


def duplicate_groups(manifest: DataFrame) -> DataFrame:
    """Content that several physical objects hold: paths, objects, size, first path."""
    return (
        hashed_rows(manifest)
        .groupBy(*CONTENT)
        .agg(
            F.count("*").alias("n_paths"),
            F.count_distinct("identity").alias("n_objects"),
            F.max("size").alias("size"),
            F.min("path").alias("first_path"),
        )
        .filter("n_paths > 1 AND n_objects > 1")
    )


def duplicate_rows(manifest: DataFrame) -> DataFrame:
    """Every row whose digest some other row has too, none left out."""
    hashed = manifest.filter(F.col("md5").isNotNull())
    groups = hashed.groupBy("md5").agg(F.count("*").alias("n")).filter("n > 1")
    return join_groups(hashed, groups, ["md5"], how="inner").select(*manifest.columns)
