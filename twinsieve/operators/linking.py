"""Link plans: which paths to point at which canonical object."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.operators.canonical import with_canonical
from twinsieve.schema import LINK_PLAN


def link_plan(manifest: DataFrame, policy: str = "max_links") -> DataFrame:
    """One row per path that should be relinked.

    A path is planned when its own physical object is not the canonical one of its
    content, so all paths of a replaced object move together.
    """
    members = with_canonical(manifest, policy)
    return members.filter("identity <> canonical_identity").select(*LINK_PLAN.fieldNames())


def apply_link_plan(manifest: DataFrame, plan: DataFrame) -> DataFrame:
    """The manifest as it will be once `plan` is carried out. Planned paths get the
    inode of their canonical object; nothing else changes."""
    moved = plan.select("path", F.lit(True).alias("moved"), "canonical_inode")
    inode = F.when(F.col("moved"), F.col("canonical_inode")).otherwise(F.col("inode"))
    return (
        manifest.join(moved, "path", "left").withColumn("inode", inode).select(*manifest.columns)
    )
