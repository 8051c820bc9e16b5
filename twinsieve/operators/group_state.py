"""Groups of equal content kept up to date from the changes of a run.

The state has one row per object and content: how many of its paths hold the content, and
the first of them. A run changes few rows of an inventory, and only these are counted: paths
that came, went, or hold something else now. Counts are raised and lowered, first paths
lowered; where the first path itself went, and only there, the rows are read again.

Every step joins short tables of changes to stored ones. Catalyst broadcasts the changes
while they are short, so the state and the inventory are then scanned, not shuffled.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.operators.canonical import CONTENT, hashed_rows
from twinsieve.operators.groups import join_groups

# Sizes are part of the key: should two sizes share a digest, the larger one can go.
OBJECT = ["device", "md5", "size", "identity"]
NO_SIZE = -1


def _members(manifest: DataFrame) -> DataFrame:
    """(path, *OBJECT) of the rows that links could be planned for."""
    size = F.coalesce("size", F.lit(NO_SIZE)).alias("size")
    return hashed_rows(manifest).select("path", "device", "md5", size, "identity")


def content_objects(manifest: DataFrame) -> DataFrame:
    """The state of an inventory: (*OBJECT, n_paths, first_path)."""
    return _members(manifest).groupBy(*OBJECT).agg(
        F.count("*").alias("n_paths"), F.min("path").alias("first_path")
    )


def object_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a run changed: (*OBJECT, delta, first_added, first_removed).

    A path that holds other content, or is another object, is removed there and added
    here. Objects whose paths are the same as before don't occur. A path occurs once in an
    inventory, so no key of the join is hot; copies are combined before the second shuffle.
    """
    old, new = (
        _members(rows).select("path", F.struct(*OBJECT).alias(name))
        for rows, name in ((before, "old"), (after, "new"))
    )
    both = old.join(new, "path", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    added = lambda value: F.when(F.col("side.sign") > 0, value)
    removed = lambda value: F.when(F.col("side.sign") < 0, value)
    side = lambda name, sign: F.struct(F.col(name).alias("object"), F.lit(sign).alias("sign"))
    sides = F.explode(F.array(side("old", -1), side("new", 1))).alias("side")
    moved = both.select("path", sides).filter("side.object is not null")
    keys = [F.col(f"side.object.{c}").alias(c) for c in OBJECT]
    return moved.groupBy(*keys).agg(
        F.sum("side.sign").alias("delta"),
        F.min(added(F.col("path"))).alias("first_added"),
        F.min(removed(F.col("path"))).alias("first_removed"),
    )


def merged_changes(objects: DataFrame, changes: DataFrame) -> DataFrame:
    """(*OBJECT, n_paths, first_path, is_lost) of the changed objects that still have
    paths; is_lost: the first path went, so that first_path isn't known. Store it."""
    known = objects.join(changes.select(*OBJECT), OBJECT)
    both = changes.join(known, OBJECT, "left")
    n = (F.coalesce("n_paths", F.lit(0)) + F.col("delta")).alias("n_paths")
    lost = F.col("first_path").isNotNull() & F.col("first_path").eqNullSafe(F.col("first_removed"))
    first = F.when(~lost, F.least("first_path", "first_added")).alias("first_path")
    return both.select(*OBJECT, n, first, lost.alias("is_lost")).filter("n_paths > 0")


def updated_objects(
    objects: DataFrame, changes: DataFrame, merged: DataFrame, after: DataFrame
) -> DataFrame:
    """The state after a run. All arguments are stored tables: the state before it, its
    `object_changes`, their `merged_changes`, and the inventory of the run."""
    lost = merged.filter("is_lost").select(*OBJECT, F.col("n_paths").alias("n"))
    again = join_groups(_members(after), lost, OBJECT, how="inner")
    again = again.groupBy(*OBJECT).agg(F.count("*").alias("n_paths"), F.min("path").alias("first_path"))
    settled = merged.filter("not is_lost").select(*again.columns)
    same = objects.join(changes, OBJECT, "left_anti").select(*again.columns)
    return same.unionByName(settled).unionByName(again)


def groups_of(objects: DataFrame) -> DataFrame:
    """`duplicate_groups`, from the state."""
    return (
        objects.groupBy(*CONTENT)
        .agg(
            F.sum("n_paths").alias("n_paths"),
            F.count_distinct("identity").alias("n_objects"),
            F.nullif(F.max("size"), F.lit(NO_SIZE)).alias("size"),
            F.min("first_path").alias("first_path"),
        )
        .filter("n_paths > 1 AND n_objects > 1")
    )


def updated_groups(groups: DataFrame, objects: DataFrame, changes: DataFrame) -> DataFrame:
    """`duplicate_groups` after a run, from those before it, the state after it and its
    changes. Groups that no change touches are taken over."""
    touched = changes.select(*CONTENT).distinct()
    anew = groups_of(objects.join(touched, CONTENT, "left_semi"))
    return groups.join(touched, CONTENT, "left_anti").unionByName(anew)
