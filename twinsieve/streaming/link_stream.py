"""The link plan of objects that arrive over time.

The first object of each content to arrive is canonical for good; every later one
is planned to link to it. What has been elected so far is a table, not operator
state: it can be read at any time and its size is bounded by storage only.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from twinsieve.operators.canonical import CONTENT
from twinsieve.operators.groups import join_groups
from twinsieve.operators.reconcile import with_identity
from twinsieve.schema import LINK_PLAN
from twinsieve.streaming.first_seen import SAVE_EVERY

CANONICAL = T.StructType(
    [
        T.StructField("device", T.LongType()),
        T.StructField("md5", T.StringType()),
        T.StructField("canonical_path", T.StringType()),
        T.StructField("canonical_inode", T.LongType()),
        T.StructField("canonical_identity", T.StringType()),
    ]
)
BATCHES = T.StructType([T.StructField("batch", T.LongType())])
ARRIVAL = ["device", "inode", "path", "size", "md5"]


def link_batch(base: str) -> Callable[[DataFrame, int], None]:
    """The work on one micro-batch, below the directory `base`.

    Everything a batch writes goes to directories of its own number, and of the
    elected objects only those of earlier batches are read. A batch that is run
    again after a failure therefore overwrites its output with the same rows.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def write(df: DataFrame, table: str) -> DataFrame:
            path = f"{base}/{table}/batch={batch_id}"
            schema = df.schema
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(schema).parquet(path)

        # The digests of the batch are computed once, and saved by the same token.
        arrived = write(batch.select(*ARRIVAL).filter("md5 IS NOT NULL"), "arrivals")
        here = with_identity(arrived.filter("device IS NOT NULL"))
        firsts = here.groupBy(*CONTENT).agg(
            F.count("*").alias("n"), F.min(F.struct("path", "inode", "identity")).alias("first")
        )
        firsts = write(firsts, "firsts")

        # Stored, the batch's contents have a known size: a short list is broadcast
        # to the scan of the elected objects, a long one is joined by shuffle.
        elected = _elected_before(spark, base, batch_id)
        met = elected.join(firsts.select(*CONTENT), CONTENT)
        groups = firsts.join(met, CONTENT, "left").select(
            *CONTENT,
            "n",
            F.col("canonical_path").isNull().alias("is_new"),
            F.coalesce("canonical_path", "first.path").alias("canonical_path"),
            F.when(F.col("canonical_path").isNull(), F.col("first.inode"))
            .otherwise(F.col("canonical_inode"))
            .alias("canonical_inode"),
            F.coalesce("canonical_identity", "first.identity").alias("canonical_identity"),
        )
        groups = write(groups, "groups")
        members = join_groups(here, groups, CONTENT, how="inner")
        links = members.filter("identity <> canonical_identity")
        write(links.select(*LINK_PLAN.fieldNames()), "links")
        write(groups.filter("is_new").select(*CANONICAL.fieldNames()), "elected")

    return run


def _elected_before(spark, base: str, batch_id: int) -> DataFrame:
    if batch_id == 0:
        return spark.createDataFrame([], CANONICAL)
    schema = T.StructType([*CANONICAL.fields, *BATCHES.fields])
    elected = spark.read.schema(schema).parquet(f"{base}/elected")
    return elected.filter(F.col("batch") < batch_id).drop("batch")


def start_link_stream(
    stream: DataFrame, base: str, *, every: str | None = SAVE_EVERY
) -> StreamingQuery:
    """Plan links for a stream of manifest rows with digests, below `base`.

    `every=None` takes what is there and stops.
    """
    writer = stream.writeStream.foreachBatch(link_batch(base)).option(
        "checkpointLocation", f"{base}/checkpoint"
    )
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()


def planned_links(spark, base: str) -> DataFrame:
    """The link plan so far."""
    schema = T.StructType([*LINK_PLAN.fields, *BATCHES.fields])
    return spark.read.schema(schema).parquet(f"{base}/links").drop("batch")


def saved_arrivals(spark, base: str) -> DataFrame:
    """The digested rows so far."""
    return spark.read.parquet(f"{base}/arrivals").drop("batch")
