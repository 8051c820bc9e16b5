"""Snapshots: what one run saves so that the next need not digest again."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from twinsieve.schema import DIGEST_LIST, SNAPSHOT


def _read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A saved snapshot; an empty one where nothing has been saved yet."""
    return _read_or_empty(spark, path, SNAPSHOT)


def read_digest_list(spark: SparkSession, path: str) -> DataFrame:
    """The md5 column of a snapshot or of any table that has one. A missing table
    is an error here: purging against nothing would look like success."""
    return spark.read.schema(DIGEST_LIST).parquet(path)


def next_snapshot(manifest: DataFrame) -> DataFrame:
    """The rows worth keeping for the next run: those whose digest is known."""
    return manifest.filter(manifest.md5.isNotNull()).select(*SNAPSHOT.fieldNames())


def snapshot_path(base: str, snapshot_id: str) -> str:
    return f"{base.rstrip('/')}/snapshot={snapshot_id}"


def write_snapshot(manifest: DataFrame, base: str, snapshot_id: str) -> str:
    """Save `manifest` as a new snapshot directory under `base`; returns its path.

    Each run writes a directory of its own, outside the scanned roots. An existing
    one is never overwritten, so the snapshot a job reads stays whole.
    """
    path = snapshot_path(base, snapshot_id)
    next_snapshot(manifest).write.parquet(path)
    return path


def store_bucketed(df: DataFrame, table: str, buckets: int) -> DataFrame:
    """Save a manifest or snapshot as a table bucketed by path.

    Between tables bucketed alike `reuse_by_path` and `snapshot_changes` shuffle
    nothing, which pays off where the same inventory is compared run after run.
    """
    df.write.bucketBy(buckets, "path").sortBy("path").saveAsTable(table)
    return df.sparkSession.table(table)
