"""The user-level jobs: hash, dedupe and purge.

A job returns DataFrames and changes nothing it was given. Manifests should be
stored tables, since a job reads them more than once. The `digest` argument takes
pending rows (path, size, mtime_us, identity, n) and returns them with md5; `digest_rows` and
`digest_files` in `operators.digest` are ready-made ones, and `streaming.digest_resumed`
makes one of them go on after a lost run.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.operators.digest import apply_inode_digests
from twinsieve.operators.linking import link_plan
from twinsieve.operators.pending import one_per_inode, size_collisions, without_digest
from twinsieve.operators.purge import purge_candidates, purge_one_per_inode
from twinsieve.operators.reconcile import sync_digests
from twinsieve.operators.reports import dry_run, require_one_device, scan_totals
from twinsieve.operators.reuse import reuse_digests
from twinsieve.workspace import stage

Digest = Callable[[DataFrame], DataFrame]


def merge_previous(
    manifest: DataFrame, previous: DataFrame | None, *, trust_links: bool = False
) -> DataFrame:
    """Digests of the previous snapshot where still valid, one per physical object.

    Without a snapshot, or to refresh everything, pass None.
    """
    if previous is None:
        return manifest.withColumn("md5", F.lit(None).cast("string"))
    reused = reuse_digests(manifest, previous)
    return sync_digests(reused, trust_links=trust_links)


def pending_rows(manifest: DataFrame, skip_unique_sizes: bool = False) -> DataFrame:
    """The rows a run has to digest: one per physical object, on request only those
    whose size is not unique."""
    rows = size_collisions(manifest).drop("n") if skip_unique_sizes else without_digest(manifest)
    return one_per_inode(rows)


def hash_job(
    manifest: DataFrame,
    previous: DataFrame | None,
    digest: Digest,
    *,
    skip_unique_sizes: bool = False,
    trust_links: bool = False,
) -> DataFrame:
    """The manifest with digests: reused, shared within objects, and computed where
    missing. Rows that could not be digested, or were skipped, keep a null.

    `trust_links` takes rows with a link count of 1 for objects of their own, which
    spares most rows of a usual tree a shuffle.
    """
    merged = merge_previous(manifest, previous, trust_links=trust_links)
    if previous is not None:
        merged = stage(merged, "merged")
    waiting = pending_rows(merged, skip_unique_sizes)
    waiting = stage(waiting.select("path", "size", "mtime_us", "identity", "n"), "pending")
    found = stage(digest(waiting).filter(F.col("md5").isNotNull()), "digests")
    return apply_inode_digests(merged, found)


def hash_dry_run(manifest: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Number and bytes of the rows without digest that `hash_job` would start from."""
    return dry_run(merge_previous(manifest, previous))


def job_dry_run(
    manifest: DataFrame, previous: DataFrame | None, *, skip_unique_sizes: bool = False
) -> DataFrame:
    """Number and bytes of the objects that `hash_job` would digest, which is one path
    of each."""
    merged = merge_previous(manifest, previous)
    return scan_totals(pending_rows(merged, skip_unique_sizes))


def dedupe_job(
    manifest: DataFrame,
    previous: DataFrame | None,
    digest: Digest,
    *,
    policy: str = "max_links",
    skip_unique_sizes: bool = False,
    one_device: bool = False,
    trust_links: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """`hash_job`, then the link plan. Returns the hashed manifest and the plan.

    Plans never link across devices. `one_device` makes several devices an error.
    """
    if one_device:
        require_one_device(manifest)
    hashed = hash_job(
        manifest,
        previous,
        digest,
        skip_unique_sizes=skip_unique_sizes,
        trust_links=trust_links,
    )
    hashed = stage(hashed, "hashed")
    return hashed, link_plan(hashed, policy)


def purge_job(
    manifest: DataFrame, reference: DataFrame, *, first_of_inode: bool = False
) -> DataFrame:
    """Rows of a hashed manifest to delete because their digest is on the list."""
    if first_of_inode:
        return purge_one_per_inode(manifest, reference)
    return purge_candidates(manifest, reference)


def purge_dry_run(
    manifest: DataFrame, reference: DataFrame, *, first_of_inode: bool = False
) -> DataFrame:
    """Number and bytes of the rows that `purge_job` would name."""
    return scan_totals(purge_job(manifest, reference, first_of_inode=first_of_inode))
