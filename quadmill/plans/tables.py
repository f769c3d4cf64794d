"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder where it is unset and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="quadmill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Tables:
    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{work_dir(spark)}/tiles-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        """df, written and read again: its rows are computed once and outlive executors."""
        self.n += 1
        df.write.parquet(f"{self.root}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.n}")

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
