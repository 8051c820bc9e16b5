"""Manifest and previous snapshot derived from the `documents` table.

Inodes, link counts, times and a partly outdated snapshot follow from doc_id by
fixed rules, so that every kind of change and every kind of inode group occurs.
The derived tables are written once per session and input directory.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions import byte_size, content_digest
from twinsieve.operators.groups import join_groups
from twinsieve.schema import MANIFEST, SNAPSHOT
from twinsieve.workspace import new_path

# Fixed values of the fixture.
FIRST_MTIME_US = 1704067200000000
STEP_US = 60000000
DIRECTORY, SYMLINK, REGULAR = 16877, 41471, 33188
FAR_SOURCE = "src19"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_path() -> Column:
    return F.concat(
        F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")
    )


def document_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(document_path().alias("path"), "text")


def derive_manifest(documents: DataFrame) -> DataFrame:
    doc = F.col("doc_id")
    rows = documents.select(
        "doc_id",
        document_path().alias("path"),
        F.col("source").alias("root"),
        byte_size("text").alias("size"),
        content_digest("text").alias("content_md5"),
    )
    linked = (
        rows.filter(doc % 3 != 0)
        .groupBy("content_md5")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    )
    joined = join_groups(rows, linked, ["content_md5"])
    inode = F.when(doc % 3 != 0, F.col("first_doc")).otherwise(doc)
    paths = F.when(doc % 3 != 0, F.col("n")).otherwise(1)
    mode = F.when(doc % 10 == 9, DIRECTORY).when(doc % 10 == 8, SYMLINK).otherwise(REGULAR)
    return joined.select(
        "doc_id",
        "path",
        "root",
        F.lit(0).cast("long").alias("device"),
        inode.alias("inode"),
        mode.alias("mode"),
        "size",
        (F.lit(FIRST_MTIME_US) + doc * STEP_US).alias("mtime_us"),
        (paths + inode % 4).cast("long").alias("links"),
        "content_md5",
    )


def derive_previous(manifest: DataFrame) -> DataFrame:
    doc, md5 = F.col("doc_id"), F.col("content_md5")
    stale = F.md5(F.concat(md5, F.lit("x")))
    kept = manifest.filter(doc % 5 != 0).select(
        "path",
        "inode",
        F.when(doc % 11 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(doc % 7 == 0, F.col("mtime_us") - 1).otherwise(F.col("mtime_us")).alias("mtime_us"),
        F.when(doc % 13 != 0, F.when(doc % 6 == 1, stale).otherwise(md5)).alias("md5"),
    )
    gone = manifest.filter(doc % 50 == 0).select(
        F.concat("path", F.lit(".gone")).alias("path"),
        (F.col("inode") + 1000000).alias("inode"),
        "size",
        "mtime_us",
        md5.alias("md5"),
    )
    return kept.unionByName(gone)


@dataclass(frozen=True)
class Fixture:
    spark: SparkSession
    manifest_path: str
    previous_path: str

    @property
    def derived(self) -> DataFrame:
        return self.spark.read.parquet(self.manifest_path)

    def _manifest(self, md5: Column) -> DataFrame:
        return self.derived.withColumn("md5", md5).select(*MANIFEST.fieldNames())

    @property
    def manifest(self) -> DataFrame:
        """As a scan delivers it: no digests."""
        return self._manifest(F.lit(None).cast("string"))

    @property
    def hashed(self) -> DataFrame:
        """With the true digest of every row."""
        return self._manifest(F.col("content_md5"))

    @property
    def previous(self) -> DataFrame:
        return self.spark.read.schema(SNAPSHOT).parquet(self.previous_path)


_fixtures: dict[tuple[str, str], Fixture] = {}


def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _fixtures:
        made = Fixture(spark, new_path(spark, "manifest"), new_path(spark, "previous"))
        derive_manifest(table(spark, sf_dir, "documents")).write.parquet(made.manifest_path)
        derive_previous(made.derived).write.parquet(made.previous_path)
        _fixtures[key] = made
    return _fixtures[key]


def on_unknown_device(manifest: DataFrame) -> DataFrame:
    """The device of a third of the rows is not known."""
    unknown = F.col("mtime_us") / STEP_US % 3 == 1
    return manifest.withColumn("device", F.when(~unknown, F.col("device")))


def contradicting(previous: DataFrame) -> DataFrame:
    """Some rows a second time, with another digest."""
    other = previous.filter("size % 4 = 0").withColumn("md5", F.md5(F.concat("md5", F.lit("y"))))
    return previous.unionByName(other)


def on_two_devices(manifest: DataFrame) -> DataFrame:
    far = (F.col("root") == FAR_SOURCE).cast("long")
    return manifest.withColumn("device", far)
