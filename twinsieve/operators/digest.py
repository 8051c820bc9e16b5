"""Computing digests and putting them into a manifest."""

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsieve.functions import byte_size, content_digest
from twinsieve.operators.balance import BIN_BYTES, balanced
from twinsieve.operators.groups import is_short, join_groups
from twinsieve.operators.members import likely_members
from twinsieve.operators.reconcile import with_identity

# Up to this many pending paths are broadcast to the table that holds the payloads.
BROADCAST_ROWS = 50_000


def digest_table(table: DataFrame, payload: str) -> DataFrame:
    """path, md5 and size of every row: one pass over the payloads, no shuffle."""
    return table.select("path", content_digest(payload).alias("md5"), byte_size(payload).alias("size"))


def digest_rows(pending: DataFrame, table: DataFrame, payload: str) -> DataFrame:
    """The `pending` rows with their md5, from the table that has their payload.

    `pending` should be a stored table: its length is looked at first. A short list
    goes to the payloads by broadcast and only its rows are digested. A longer one goes
    there as a bitmap of its paths, so that few other payloads are digested, and only
    path and digest are shuffled. Payloads never are.
    """
    wanted = pending.drop("md5")
    if is_short(wanted, BROADCAST_ROWS):
        hits = table.select("path", F.col(payload).alias("_payload"))
        hits = hits.join(F.broadcast(wanted), "path")
        return hits.select(*wanted.columns, content_digest("_payload").alias("md5"))
    near = likely_members(table.select("path", F.col(payload).alias("_payload")), wanted, "path")
    digests = digest_table(near, "_payload").select("path", "md5")
    return wanted.join(digests, "path")


def _digest_files(batches):
    """The rows of each batch with the md5 of the file at `path`; null where it
    cannot be read."""

    def digest(path):
        try:
            with open(path, "rb") as file:
                return hashlib.file_digest(file, "md5").hexdigest()
        except OSError:
            return None

    for batch in batches:
        yield batch.assign(md5=batch["path"].map(digest).astype(object))


def digest_files(pending: DataFrame, bytes_per_task: int = BIN_BYTES) -> DataFrame:
    """The `pending` rows with the md5 of the file each path names, on a file system
    that all executors mount.

    Files are read through a small buffer, whatever their size. Tasks have about equal
    bytes to read, and one larger file at most. `pending` should be a stored table.
    """
    wanted = pending.drop("md5")
    schema = T.StructType([*wanted.schema.fields, T.StructField("md5", T.StringType())])
    return balanced(wanted, bytes_per_task).select(*wanted.columns).mapInPandas(_digest_files, schema)


def digest_binary_files(spark, roots: list[str]) -> DataFrame:
    """path and md5 of all files below `roots` on any file system Spark reads, for
    files that fit into a row (2 GiB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    return files.select("path", content_digest("content").alias("md5"))


def apply_digests(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """Put new digests in by path; where there is no new one the old one stays."""
    new = digests.select("path", F.col("md5").alias("new_md5"))
    merged = manifest.join(new, "path", "left")
    return merged.withColumn("md5", F.coalesce("new_md5", "md5")).select(*manifest.columns)


def apply_inode_digests(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """Give the digest of a physical object to all its paths that have none.

    `digests` has identity, md5 and `n`, the number of paths waiting for it. Rows
    that have a digest are not moved.
    """
    groups = digests.select("identity", F.col("md5").alias("new_md5"), "n")
    waiting = with_identity(manifest.filter(F.col("md5").isNull()))
    joined = join_groups(waiting, groups, ["identity"]).withColumn("md5", F.col("new_md5"))
    done = manifest.filter(F.col("md5").isNotNull())
    return done.unionByName(joined.select(*manifest.columns))
