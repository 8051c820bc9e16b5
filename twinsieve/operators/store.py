"""The table form of hard linking: each content kept once, rows refer to it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.functions import byte_size, content_digest
from twinsieve.operators.groups import join_groups, salted_join
from twinsieve.operators.members import likely_members
from twinsieve.workspace import stage


def store_refs(rows: DataFrame, payload: str) -> DataFrame:
    """path and md5 of every row. Store this table and pass it on as `refs`."""
    return rows.select("path", content_digest(payload).alias("md5"))


def redundant_paths(refs: DataFrame) -> DataFrame:
    """Paths whose content some smaller path already holds."""
    groups = (
        refs.filter(F.col("md5").isNotNull())
        .groupBy("md5")
        .agg(F.count("*").alias("n"), F.min("path").alias("kept_path"))
        .filter("n > 1")
    )
    return join_groups(refs, groups, ["md5"], how="inner").filter("path <> kept_path").select("path")


def store_blobs(rows: DataFrame, payload: str, redundant: DataFrame) -> DataFrame:
    """md5, size and payload of each distinct content.

    `redundant` should be stored `redundant_paths`: Catalyst then knows its size and
    broadcasts it when short, so that payloads go from scan to output without a
    shuffle. A long list is joined on path, which no group of copies can skew.
    """
    kept = rows.join(redundant, "path", "left_anti").filter(F.col(payload).isNotNull())
    return kept.select(
        content_digest(payload).alias("md5"),
        byte_size(payload).alias("size"),
        F.col(payload).alias("payload"),
    )


def store_restore(refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """The original rows: path and payload. A blob many rows refer to is copied to
    as many tasks as their number calls for; rows without payload come back as such."""
    found = salted_join(refs, blobs.select("md5", "payload"), "md5", sizes=blobs).select("path", "payload")
    empty = refs.filter(F.col("md5").isNull()).select(
        "path", F.lit(None).cast(blobs.schema["payload"].dataType).alias("payload")
    )
    return found.unionByName(empty)


def ref_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """md5 and by how many its references grew from one run's refs to the next one's.

    Refs are (path, md5), a path once; only paths whose content changed are counted.
    """
    was, now = old.select("path", F.col("md5").alias("_was")), new.select("path", F.col("md5").alias("_now"))
    changed = was.join(now, "path", "full_outer").filter(~F.col("_was").eqNullSafe(F.col("_now")))
    ends = F.array(
        F.struct(F.col("_was").alias("md5"), F.lit(-1).cast("long").alias("by")),
        F.struct(F.col("_now").alias("md5"), F.lit(1).cast("long").alias("by")),
    )
    steps = changed.select(F.explode(ends).alias("_step")).select("_step.*").filter("md5 is not null")
    return steps.groupBy("md5").agg(F.sum("by").alias("by")).filter("by <> 0")


def apply_ref_changes(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """md5 and n_refs of every blob after the changes. One row per digest meets one, so
    no group of copies can be hot. Blobs at 0 stay in the list until they are removed."""
    n = F.coalesce("n_refs", F.lit(0)) + F.coalesce("by", F.lit(0))
    return counts.join(changes, "md5", "full_outer").select("md5", n.alias("n_refs"))


def garbage(counts: DataFrame) -> DataFrame:
    """Digests of blobs that nothing refers to any more."""
    return counts.filter("n_refs = 0").select("md5")


def new_blob_paths(refs: DataFrame, counts: DataFrame, changes: DataFrame) -> DataFrame:
    """md5 and path of the contents the store has not yet: the first path of each.

    `counts` are the store's before the changes. Store the result for `new_blobs`.
    """
    added = changes.filter("by > 0").join(counts, "md5", "left_anti").select("md5", F.col("by").alias("n"))
    added = stage(added, "added-digests")
    found = join_groups(refs, added, ["md5"], how="inner")
    return found.groupBy("md5").agg(F.min("path").alias("path"))


def new_blobs(rows: DataFrame, payload: str, paths: DataFrame) -> DataFrame:
    """md5, size and payload of the contents that `new_blob_paths` named.

    Other payloads are dropped where they are read. Those of the list are moved only if it
    is too long to broadcast and `rows` is not bucketed by path like it.
    """
    near = likely_members(rows.select("path", F.col(payload).alias("payload")), paths, "path")
    return near.join(paths, "path").select("md5", byte_size("payload").alias("size"), "payload")


def upserted(blobs: DataFrame, fresh: DataFrame, unused: DataFrame) -> DataFrame:
    """The blobs after a run: those still in use and the new ones. Only digests are joined
    to the stored blobs; a long list of unused ones goes there as a shuffle of its own."""
    return blobs.join(unused, "md5", "left_anti").unionByName(fresh.select(*blobs.columns))
