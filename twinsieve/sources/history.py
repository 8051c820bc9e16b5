"""The saved snapshots of many runs, read as one table.

Each run has written a directory `snapshot=<id>`; ids sort by time. A condition on
`snapshot` prunes directories, so a look at the last runs doesn't read the others.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsieve.operators.reuse import FINGERPRINT
from twinsieve.schema import SNAPSHOT

# Ids stay text: dates and numbers are not to be guessed from them.
HISTORY = T.StructType([*SNAPSHOT.fields, T.StructField("snapshot", T.StringType())])


def read_history(
    spark: SparkSession, base: str, since: str | None = None, until: str | None = None
) -> DataFrame:
    """Rows of the snapshots under `base`, from `since` to `until`, both included."""
    rows = spark.read.schema(HISTORY).parquet(base)
    if since is not None:
        rows = rows.filter(F.col("snapshot") >= since)
    if until is not None:
        rows = rows.filter(F.col("snapshot") <= until)
    return rows


def _settled(history: DataFrame) -> DataFrame:
    """One row per fingerprint and snapshot that has a digest of it; `md5` is null where
    a snapshot contradicts itself.

    Rows are dealt by fingerprint once, which serves what follows as well. No fingerprint
    has more rows than there are snapshots and roots that overlap.
    """
    lo, hi = F.min("md5"), F.max("md5")
    hashed = history.filter(F.col("md5").isNotNull()).repartition(*FINGERPRINT)
    return hashed.groupBy(*FINGERPRINT, "snapshot").agg(F.when(lo == hi, lo).alias("md5"))


def latest_digests(history: DataFrame) -> DataFrame:
    """(*FINGERPRINT, old_md5, snapshot): of each fingerprint the digest in the last
    snapshot that has one, and which that is. A contradiction there leaves it null."""
    last = F.max(F.struct("snapshot", "md5")).alias("last")
    found = _settled(history).groupBy(*FINGERPRINT).agg(last)
    return found.select(*FINGERPRINT, F.col("last.md5").alias("old_md5"), "last.snapshot")


def reuse_from_history(manifest: DataFrame, history: DataFrame) -> DataFrame:
    """Take the latest digest of each row that any snapshot knows with the same path, size
    and mtime: also of a file that was away, or changed back, for some runs."""
    merged = manifest.join(latest_digests(history), FINGERPRINT, "left")
    return merged.withColumn("md5", F.coalesce("md5", "old_md5")).select(*manifest.columns)


def snapshot_history(history: DataFrame) -> DataFrame:
    """Intervals in which a path had a fingerprint and a digest, without a break:
    (*FINGERPRINT, md5, valid_from, valid_to, n_snapshots).

    Snapshots count as neighbours that follow each other in `history`. Their ids are few,
    one per run; rows of a path are as many at most, so a window may hold them.
    """
    ids = history.agg(F.array_sort(F.collect_set("snapshot")).alias("ids"))
    runs = ids.select(F.posexplode("ids").alias("_at", "snapshot"))
    numbered = _settled(history).join(F.broadcast(runs), "snapshot")
    state = [*FINGERPRINT, "md5"]
    parts = ", ".join(state)
    # What stays the same within an unbroken interval, and differs between two of them.
    start = F.expr(f"_at - row_number() OVER (PARTITION BY {parts} ORDER BY _at)")
    return (
        numbered.withColumn("_start", start)
        .groupBy(*state, "_start")
        .agg(
            F.min("snapshot").alias("valid_from"),
            F.max("snapshot").alias("valid_to"),
            F.count("*").alias("n_snapshots"),
        )
        .drop("_start")
    )


def as_of(intervals: DataFrame, snapshot: str) -> DataFrame:
    """The fingerprints and digests that a snapshot held, from the intervals."""
    held = (F.col("valid_from") <= snapshot) & (F.col("valid_to") >= snapshot)
    return intervals.filter(held).select(*FINGERPRINT, "md5")
