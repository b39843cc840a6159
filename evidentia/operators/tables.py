"""Tables in the folder that the cluster's machines share, which end the lineage of iterations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may go without, and then has a temporary folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="evidentia-")
    spark.sparkContext.setCheckpointDir(where)
    return where


def tasks(df: DataFrame) -> int:
    """How many tasks a shuffle has: for those that must not be made fewer, since their rows are few and their work is not."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as a table and read back."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
