"""Cutting the lineage of iterative state through the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def base(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one is chosen only where it is unset and all run on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (at or f"/tmp/checkpoints/skein-{spark.sparkContext.applicationId}").rstrip("/")


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Have what lies at ``path`` deleted when the application ends, unless it is deleted before."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


class Rounds:
    """Tables of successive rounds, until they are dropped or the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, f"{base(spark)}/skein/{name}-{uuid.uuid4().hex}", {}

    def cut(self, df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
        """The table of a round, and aggregates of it that are taken while it is written.

        They are taken in the stage that writes, whose tasks count once however often they
        run, so they are exact.
        """
        if not measures:
            return self._write(df), {}
        seen = Observation()
        out = self._write(df.observe(seen, *[c.alias(k) for k, c in measures.items()]))
        return out, seen.get

    def _write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        if not self.made:
            forget_at_exit(self.spark, self.root)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this object that no later plan reads; others are left alone."""
        for t in tables:
            _, path = self.made.pop(id(t), (None, None))
            if path:
                p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
