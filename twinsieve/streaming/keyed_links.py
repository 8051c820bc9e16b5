"""The link plan of arriving objects, with what has been elected as keyed state.

As `link_stream`, but the elected object of a content is looked up in a state store by
(device, md5) instead of in a table: a batch costs what it brings, however much has been
elected before. With the RocksDB store the state is on local disks, checkpointed in the
stream's folder, and bounded by these disks.

Before any row is shuffled, a batch is reduced to the first path of each content, so that
the stateful step gets one row per content, whatever its number of copies. The rows of the
batch then meet these answers as `join_groups` does it, which splits hot contents.

The step is an aggregate of built-in functions (`first_of_contents`). Folders that have the
state of `elected_stream`, which calls Python once per content, go on with that.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from twinsieve.operators.canonical import CONTENT
from twinsieve.operators.groups import join_groups
from twinsieve.operators.reconcile import with_identity
from twinsieve.schema import LINK_PLAN
from twinsieve.streaming.first_seen import SAVE_EVERY
from twinsieve.streaming.link_stream import ARRIVAL, CANONICAL

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

FIRST = "device long, md5 string, batch long, n long, path string, inode long, identity string"
STATE = "path string, inode long, identity string"
GROUP = T.StructType(
    [*CANONICAL.fields, T.StructField("batch", T.LongType()), T.StructField("n", T.LongType())]
)


def _elect(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The elected object of one content; the first row to come elects it."""
    rows = pd.concat(list(frames)).sort_values(["batch", "path"])  # one row per batch
    if state.exists:
        path, inode, identity = state.get
    else:
        first = rows.iloc[0]
        inode = None if pd.isna(first["inode"]) else int(first["inode"])
        path, identity = first["path"], first["identity"]
        state.update((path, inode, identity))
    yield pd.DataFrame(
        {
            "device": key[0],
            "md5": key[1],
            "canonical_path": path,
            "canonical_inode": pd.array([inode] * len(rows), dtype="Int64"),
            "canonical_identity": identity,
            "batch": rows["batch"].to_numpy(),
            "n": rows["n"].to_numpy(),
        }
    )


def elected_stream(firsts: DataFrame) -> DataFrame:
    """For each row of a stream of FIRST the elected object of its content."""
    keyed = firsts.groupBy(*CONTENT)
    found = keyed.applyInPandasWithState(_elect, GROUP, STATE, "append", GroupStateTimeout.NoTimeout)
    # A computed column: the writer's sort can't take rows as they come from Python.
    return found.withColumn("n", F.greatest("n", F.lit(1)))


def first_of_contents(firsts: DataFrame) -> DataFrame:
    """For each content of a stream of FIRST its elected object, as of its latest batch.

    An aggregate for the update mode: a trigger gives the contents it brings. It has to
    bring one batch, since a content gets one row.
    """
    first = F.min(F.struct("batch", "path", "inode", "identity")).alias("first")
    latest = F.max(F.struct("batch", "n")).alias("latest")
    return firsts.groupBy(*CONTENT).agg(first, latest).select(
        *CONTENT,
        F.col("first.path").alias("canonical_path"),
        F.col("first.inode").alias("canonical_inode"),
        F.col("first.identity").alias("canonical_identity"),
        "latest.batch",
        "latest.n",
    )


def _exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _once(df: DataFrame, path: str) -> DataFrame:
    """Write `df` unless that has been finished before; the table as written."""
    spark, schema = df.sparkSession, df.schema
    if not _exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _write_groups(base: str) -> Callable[[DataFrame, int], None]:
    """Writes the answers of a trigger, by batch; a trigger that runs again overwrites them."""

    def run(groups: DataFrame, _: int) -> None:
        write = groups.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        write.partitionBy("batch").parquet(f"{base}/groups")

    return run


def _elect_new(spark: SparkSession, base: str) -> None:
    """Take the contents into the state that have been written since the last time."""
    firsts = spark.readStream.schema(FIRST).option("recursiveFileLookup", "true").parquet(f"{base}/firsts")
    if _exists(spark, f"{base}/state"):
        writer = elected_stream(firsts).writeStream.format("parquet").option("path", f"{base}/groups")
        writer = writer.option("checkpointLocation", f"{base}/state").partitionBy("batch")
    else:
        writer = first_of_contents(firsts).writeStream.outputMode("update").foreachBatch(_write_groups(base))
        writer = writer.option("checkpointLocation", f"{base}/contents")
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, old) if old else spark.conf.unset(PROVIDER)
    query.awaitTermination()


def keyed_batch(base: str) -> Callable[[DataFrame, int], None]:
    """The work on one micro-batch, below the directory `base`.

    A batch that is run again after a failure goes on where it stopped: what it has finished
    writing is not written again, and the state takes each content of it once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived = batch.select(*ARRIVAL).filter("md5 IS NOT NULL")
        arrived = _once(arrived, f"{base}/arrivals/batch={batch_id}")
        here = with_identity(arrived.filter("device IS NOT NULL"))
        first = F.min(F.struct("path", "inode", "identity")).alias("first")
        firsts = here.groupBy(*CONTENT).agg(F.count("*").alias("n"), first)
        firsts = firsts.select(*CONTENT, F.lit(batch_id).cast("long").alias("batch"), "n", "first.*")
        # A number of its own each time, as the stream takes new files only.
        _once(firsts, f"{base}/firsts/part-of-{batch_id}")
        _elect_new(spark, base)
        groups = groups_of(spark, base, batch_id)
        members = join_groups(here, groups, CONTENT, how="inner")
        links = members.filter("identity <> canonical_identity").select(*LINK_PLAN.fieldNames())
        links.write.mode("overwrite").parquet(f"{base}/links/batch={batch_id}")

    return run


def groups_of(spark: SparkSession, base: str, batch_id: int) -> DataFrame:
    """The contents of one batch with their elected objects; only its partition is read."""
    try:
        groups = spark.read.schema(GROUP).parquet(f"{base}/groups")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        groups = spark.createDataFrame([], GROUP)
    return groups.filter(F.col("batch") == batch_id).drop("batch")


def start_keyed_link_stream(
    stream: DataFrame, base: str, *, every: str | None = SAVE_EVERY
) -> StreamingQuery:
    """Plan links for a stream of manifest rows with digests, below `base`.

    `planned_links` and `saved_arrivals` read the results, as for `start_link_stream`.
    `every=None` takes what is there and stops.
    """
    writer = stream.writeStream.foreachBatch(keyed_batch(base)).option(
        "checkpointLocation", f"{base}/checkpoint"
    )
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()
