"""Degrees over a stream of edge files, as a running aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_edges(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Edges (src, dst) of Parquet files as they appear under ``path``."""
    return spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of nodes seen so far; write it in update or complete mode."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return edges.select(ends.alias("e")).groupBy(F.col("e.id").alias("id")).agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
