"""Cutting lineage: checkpoints and written tables live in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset the warehouse, which a cluster shares too, or on a local master a temporary folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return tempfile.mkdtemp(prefix="checkpoint-")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of a loop, written to a folder of their own that is deleted at the end.

    A table that was checkpointed keeps the estimate of its size. Where tables are joined round after round, estimates multiply until
    planning never ends; of a written table the plan knows the true size.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
