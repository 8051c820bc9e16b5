"""Column layouts shared by every part of the package."""

from pyspark.sql import types as T

STAT = T.StructType(
    [
        T.StructField("mode", T.IntegerType()),
        T.StructField("ino", T.LongType()),
        T.StructField("dev", T.LongType()),
        T.StructField("nlink", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime_us", T.LongType()),
    ]
)

# What a scan delivers, before anything is filtered or projected.
INVENTORY = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("root", T.StringType()),
        T.StructField("stat", STAT),
    ]
)

# One row per object. `path` is unique; inode null or 0 means "identity unknown".
MANIFEST = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("root", T.StringType()),
        T.StructField("device", T.LongType()),
        T.StructField("inode", T.LongType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime_us", T.LongType()),
        T.StructField("links", T.LongType()),
        T.StructField("md5", T.StringType()),
    ]
)

# What one run hands to the next.
SNAPSHOT = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("inode", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime_us", T.LongType()),
        T.StructField("md5", T.StringType()),
    ]
)

DIGEST_LIST = T.StructType([T.StructField("md5", T.StringType())])

LINK_PLAN = T.StructType(
    [
        T.StructField("md5", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("inode", T.LongType()),
        T.StructField("canonical_path", T.StringType()),
        T.StructField("canonical_inode", T.LongType()),
        T.StructField("size", T.LongType()),
    ]
)
