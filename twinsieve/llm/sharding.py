"""Shuffled shards of any input, by a two-pass external shuffle (operator 2).

Pass one scatters the records over buckets by a seeded hash: a shuffle, whose files are
the only copy of the texts that is made. A bucket is sized to fit into a task's memory.
Pass two puts each bucket into a defined order, applies a seeded Fisher-Yates shuffle and
numbers its records after those of the buckets before it. The numbers 0, 1, ... are dealt round robin to
the shards, so shards differ by one row at most and slots have no gaps.

The order depends on seed, keys and texts, not on how the input is split into files.
Rows equal in key and text are interchangeable; where one such group would overfill a
bucket, by its bytes, its rows are scattered by their place in the input instead. As that
place might change when the input is read again, the scattered records are stored in this
case, and only then the order may depend on how the input is split.
Null keys, null and empty texts are records like others. An empty table gives none.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsieve.llm.columns import packed, stored, unpacked

BUCKET_BYTES = 64 << 20
MIN_BUCKETS = 256
# A group of less is never split.
LEAST_HOT_BYTES = 1 << 20


def record_bytes(docs: DataFrame) -> Column:
    """About what a record takes: the bytes of its texts, and some for each other column."""
    size = F.lit(1).cast("long")
    for field in docs.schema:
        if isinstance(field.dataType, T.StringType | T.BinaryType):
            size = size + F.coalesce(F.octet_length(docs[field.name]), F.lit(0))
        else:
            size = size + 8
    return size


def scatter(docs: DataFrame, key: str, text: str, seed: int, bucket_bytes: int) -> DataFrame:
    """Pass one: the records with their hash and bucket, the same whenever they are read."""
    record = F.xxhash64(F.lit(seed), key, text)
    size = record_bytes(docs)
    n_bytes = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(MIN_BUCKETS, math.ceil(n_bytes / bucket_bytes))

    # Groups of equal records that a bucket couldn't hold beside its share: of small
    # inputs four shares, of large ones half a bucket.
    many = min(bucket_bytes // 2, max(LEAST_HOT_BYTES, 4 * n_bytes // buckets))
    repeats = docs.groupBy(record.alias("_repeated")).agg(F.sum(size).alias("_bytes"), F.count("*").alias("_n"))
    repeats = repeats.filter((F.col("_bytes") > many) & (F.col("_n") > 1))
    repeats = stored(repeats.select("_repeated"), "shard-repeats")
    hashed = docs.select(packed(docs), record.alias("_h"))
    # A second hash, as bits of the first order the records within their bucket.
    bucket = lambda of: F.pmod(F.xxhash64(of, F.lit(seed)), F.lit(buckets)).cast("int")
    if repeats.isEmpty():
        return hashed.withColumn("_bucket", bucket(F.col("_h")))
    place = F.xxhash64("_h", F.monotonically_increasing_id())
    spread = F.when(F.col("_repeated").isNotNull(), place).otherwise(F.col("_h"))
    marked = hashed.join(repeats, hashed["_h"] == repeats["_repeated"], "left")
    return stored(marked.withColumn("_bucket", bucket(spread)).drop("_repeated"), "shard-scatter")


def shuffled_shards(
    docs: DataFrame,
    shards: int = 8,
    seed: int = 17,
    key: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All rows with `shard` (0 to shards - 1) and `slot` (0, 1, ... in each shard).

    Columns of these two names in the input are replaced.
    """
    scattered = scatter(docs, key, text, seed, bucket_bytes)
    counts = scattered.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # One row per bucket: a millionth of the rows at most, in one task.
    before = F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")
    offsets = stored(counts.select("_bucket", before.alias("_offset")), "shard-offsets")
    placed = scattered.join(offsets, "_bucket")
    schema = T.StructType([
        scattered.schema["_row"],
        T.StructField("_shard", T.IntegerType()),
        T.StructField("_slot", T.LongType()),
    ])

    def fisher_yates(bucket: pa.Table) -> pa.Table:
        hashes = bucket["_h"].to_numpy()
        order = np.argsort(hashes, kind="stable")
        rng = np.random.default_rng([seed, bucket["_bucket"][0].as_py()])
        rng.shuffle(order)  # numpy's shuffle is Fisher-Yates
        place = bucket["_offset"][0].as_py() + np.arange(len(order))
        dealt = bucket.select(["_row"]).take(pa.array(order))
        dealt = dealt.append_column("_shard", pa.array(place % shards, pa.int32()))
        return dealt.append_column("_slot", pa.array(place // shards, pa.int64()))

    dealt = placed.groupBy("_bucket").applyInArrow(fisher_yates, schema)
    return unpacked(dealt, docs, {"shard": F.col("_shard"), "slot": F.col("_slot")})


def write_shards(sharded: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Write each shard to its own folder, its files in slot order."""
    shards = sharded.agg(F.max("shard")).first()[0]
    files = ((shards or 0) + 1) * files_per_shard
    ordered = sharded.repartitionByRange(files, "shard", "slot")
    ordered.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
