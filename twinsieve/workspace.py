"""Where jobs keep the tables they write between stages.

A stage written as Parquet cuts the lineage, survives the loss of any executor,
keeps column pruning and filter pushdown for its readers, and gives Catalyst the
real size of the table, which is what its broadcast decision rests on.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """Shared folder of this application, in ``spark.checkpoint.dir``.

    Where that is unset, the folder is in the warehouse, which executors share as well.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"
    return f"{base.rstrip('/')}/twinsieve-{app}"


def remove_stages(spark: SparkSession) -> None:
    """Delete what this application's jobs have written to the work folder.

    Frames that read a stage can't be used afterwards.
    """
    remove_path(spark, work_dir(spark))


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that `new_path` named, with all that is in it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the work folder that nothing has used yet."""
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the work folder and return it as read back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
