"""Counts and sums. All are integers; `display` turns them into text."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from twinsieve.functions import display_bytes, display_count
from twinsieve.operators.canonical import CONTENT, duplicate_groups, with_canonical
from twinsieve.operators.pending import without_digest
from twinsieve.operators.reconcile import with_identity
from twinsieve.operators.reuse import FINGERPRINT, digest_mismatches, old_digests


def scan_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes")
    )


def dry_run(manifest: DataFrame) -> DataFrame:
    """How many rows, and bytes, a run would have to digest."""
    return scan_totals(without_digest(manifest))


def device_report(manifest: DataFrame) -> DataFrame:
    """Devices below each root."""
    return manifest.groupBy("root").agg(
        F.count_distinct("device").alias("n_devices"),
        F.min("device").alias("lo_device"),
        F.max("device").alias("hi_device"),
    )


def require_one_device(manifest: DataFrame) -> None:
    """Raise OSError when the rows are spread over several devices."""
    lo, hi = manifest.agg(F.min("device"), F.max("device")).first()
    if lo != hi:
        raise OSError(f"roots must be on one device, found at least {lo} and {hi}")


def savings(manifest: DataFrame) -> DataFrame:
    """What linking would free at most: all but one physical object of every content
    group on a known device. Links outside the manifest keep some of them."""
    hashed = with_identity(manifest).filter(F.col("device").isNotNull() & F.col("md5").isNotNull())
    groups = hashed.groupBy(*CONTENT).agg(
        F.count_distinct("identity").alias("n_objects"), F.max("size").alias("size")
    )
    spare = groups.filter("n_objects > 1").withColumn("n_spare", F.col("n_objects") - 1)
    return spare.agg(
        F.count("*").alias("n_groups"),
        F.coalesce(F.sum("n_spare"), F.lit(0)).alias("n_objects_freed"),
        F.coalesce(F.sum(F.col("n_spare") * F.col("size")), F.lit(0)).alias("n_bytes_freed"),
    )


def sure_savings(manifest: DataFrame, policy: str = "max_links") -> DataFrame:
    """What the link plan frees for certain: objects all of whose links it moves.

    An object with an unknown number of links, or with more than the manifest has
    paths of it, is planned but not counted as freed.
    """
    planned = with_canonical(manifest, policy).filter("identity <> canonical_identity")
    objects = planned.groupBy("identity").agg(
        F.count("*").alias("paths"), F.max("links").alias("links"), F.max("size").alias("size")
    )
    sure = F.col("paths") >= F.col("links")
    return objects.agg(
        F.count("*").alias("n_objects_planned"),
        F.count_if(sure).alias("n_objects_surely_freed"),
        F.coalesce(F.sum(F.when(sure, F.col("size"))), F.lit(0)).alias("n_bytes_surely_freed"),
    )


def digest_size_check(manifest: DataFrame) -> DataFrame:
    """Number of digests that rows of different sizes share. Anything but 0 means
    that md5 alone does not identify content here."""
    groups = (
        manifest.filter(F.col("md5").isNotNull())
        .groupBy("md5")
        .agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    )
    return groups.agg(F.count_if(F.col("lo") != F.col("hi")).alias("n_ambiguous"))


def run_summary(manifest: DataFrame, previous: DataFrame) -> DataFrame:
    """One row about a finished run: rows, saved rows, digest failures (rows still
    without digest), mismatches with the previous snapshot and duplicate groups."""
    hashed = F.col("md5").isNotNull()
    mismatches = digest_mismatches(manifest, previous).agg(F.count("*")).scalar()
    groups = duplicate_groups(manifest).agg(F.count("*")).scalar()
    return manifest.agg(
        F.count("*").alias("n_files"),
        F.count_if(hashed).alias("n_saved"),
        F.count_if(~hashed).alias("n_without_digest"),
    ).select(
        "*", mismatches.alias("n_mismatches"), groups.alias("n_duplicate_groups")
    )


def observed(manifest: DataFrame, previous: DataFrame) -> tuple[DataFrame, Observation]:
    """The manifest, to be written by the run itself, and the counts its write will show.

    Rows, saved rows, rows without digest and mismatches are counted in that one pass;
    `observed_summary` takes them from there.
    """
    hashed = F.col("md5").isNotNull()
    counts = Observation()
    compared = manifest.join(old_digests(previous), FINGERPRINT, "left")
    compared = compared.observe(
        counts,
        F.count("*").alias("n_files"),
        F.count_if(hashed).alias("n_saved"),
        F.count_if(~hashed).alias("n_without_digest"),
        F.count_if(F.col("md5") != F.col("old_md5")).alias("n_mismatches"),
    )
    return compared.select(*manifest.columns), counts


def observed_summary(written: DataFrame, counts: Observation) -> DataFrame:
    """`run_summary` of what `observed` gave and has been written since."""
    seen = counts.get
    names = ("n_files", "n_saved", "n_without_digest", "n_mismatches")
    groups = duplicate_groups(written).agg(F.count("*").alias("n_duplicate_groups"))
    return groups.select(*[F.lit(seen[c]).cast("long").alias(c) for c in names], "n_duplicate_groups")


def display(totals: DataFrame) -> DataFrame:
    """`scan_totals` (or `dry_run`) with readable text next to the numbers."""
    return totals.select(
        "n_files",
        "n_bytes",
        display_count("n_files").alias("files_text"),
        display_bytes("n_bytes").alias("bytes_text"),
    )
