"""Digests that outlive their run: a log of finished slices in a folder of the caller.

The pending list is written as files, each a slice of about equal bytes, and digested as a
checkpointed stream over these files. A run that is lost and started again on the same
folder digests only the slices that were not committed.

    folder/pending     the list, one file per slice
    folder/digests     slice=<number>: the digested rows
    folder/checkpoint  which slices are done
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsieve.operators.balance import OBJECT_COST, balanced
from twinsieve.operators.reuse import FINGERPRINT
from twinsieve.schema import SNAPSHOT

Digest = Callable[[DataFrame], DataFrame]

# Bytes to be digested between two commits.
SLICE_BYTES = 64 * 1024**3

LISTED = T.StructType([f for f in SNAPSHOT.fields if f.name in FINGERPRINT])
LOGGED = T.StructType([*LISTED.fields, T.StructField("md5", T.StringType())])


def _saved(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def logged_digests(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, mtime_us and md5 of what has been digested so far; md5 is null where
    that failed."""
    return _saved(spark, f"{folder}/digests", LOGGED)


def list_pending(
    pending: DataFrame, folder: str, slice_bytes: int = SLICE_BYTES, most_slices: int | None = None
) -> int:
    """Add the rows to the list in `folder` that it does not have; returns how many.

    A row is the same as long as path, size and mtime are. Slices grow beyond `slice_bytes`
    where more than `most_slices` would have to be added.
    """
    listed = _saved(pending.sparkSession, f"{folder}/pending", LISTED)
    fresh = pending.select(*FINGERPRINT).join(listed, FINGERPRINT, "left_anti")
    weight = F.coalesce("size", F.lit(0)) + F.lit(OBJECT_COST).cast("long")
    added, total = fresh.agg(F.count("*"), F.sum(weight)).first()
    if added > 0:
        if most_slices is not None:
            # Bins are stretches of half their bytes.
            slice_bytes = max(slice_bytes, 2 * -(-total // most_slices))
        # Each partition becomes one file.
        balanced(fresh, slice_bytes).select(*FINGERPRINT).write.mode("append").parquet(f"{folder}/pending")
    return added


def digest_slices(spark: SparkSession, folder: str, digest: Digest, slices: int = 1) -> None:
    """Digest what the list holds and the log does not, `slices` at a time.

    A slice that was digested but not committed is digested again, into the same place.
    """
    pending = spark.readStream.schema(LISTED).option("maxFilesPerTrigger", slices)

    def run(rows: DataFrame, number: int) -> None:
        found = digest(rows).select(*FINGERPRINT, "md5")
        found.write.mode("overwrite").parquet(f"{folder}/digests/slice={number}")

    query = pending.parquet(f"{folder}/pending").writeStream.foreachBatch(run)
    query = query.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    query.start().awaitTermination()


def digest_resumed(
    pending: DataFrame,
    folder: str,
    digest: Digest,
    *,
    slice_bytes: int = SLICE_BYTES,
    slices: int = 1,
    most_commits: int | None = None,
) -> DataFrame:
    """The `pending` rows with md5, digested in slices that are kept in `folder`.

    For `hash_job`, as `partial(digest_resumed, folder=..., digest=...)`. The folder belongs to
    one run and its repetitions: of rows it knows by path, size and mtime it gives the
    digest it has, and rows that are new in a repetition make new slices.

    With `digest_rows` each commit (of `slices` slices) is a scan of the payloads' table.
    `most_commits` bounds them, and so the scans, by making slices larger; a loss then costs
    such a part of the run.
    """
    spark = pending.sparkSession
    list_pending(pending, folder, slice_bytes, most_commits and most_commits * slices)
    if not _saved(spark, f"{folder}/pending", LISTED).isEmpty():
        digest_slices(spark, folder, digest, slices)
    found = logged_digests(spark, folder).dropDuplicates(FINGERPRINT)
    return pending.drop("md5").join(found, FINGERPRINT).select(*pending.drop("md5").columns, "md5")
