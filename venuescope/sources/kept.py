"""Tables that cut lineage: written to the shared folder and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The part of the shared folder that these tables are in.
FOLDER = "venuescope"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session, as in tests, may do without: on a
    cluster a folder of one machine would hold only its own part of a table."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="venuescope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/{FOLDER}/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again with its schema.

    files: at most so many, where shuffled rows are known to be few for the shuffle's partitions. A table
    lives until `remove_written`: frames made from it read it whenever they run."""
    spark = df.sparkSession
    df = df.coalesce(files) if files else df
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a table from which it is worth to deal out its rows, and splits for each core beyond which it is not looked at.
WORTH, MANY = 4 << 20, 4


def spread(table: DataFrame) -> DataFrame:
    """A table read from files, its rows dealt to all cores where the files keep most of them idle.

    A Parquet file is read by at most as many tasks as it has row groups, so one file of one group, however many
    splits it has, is one task's work. Only tables of few splits are looked at, by counting rows a split."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < WORTH or table.rdd.getNumPartitions() >= MANY * cores:
        return table
    busy = table.select(F.spark_partition_id().alias("split")).distinct().count()
    return table.repartition(cores) if busy < cores else table


def remove_written(spark: SparkSession) -> bool:
    """Remove the tables that this application has written, once no frame that reads them is needed; whether there
    were any. Those of other applications on the same folder stay."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
