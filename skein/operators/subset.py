"""Frontiers: sets of nodes, in a sparse (id) or dense (id, active) form.

The form never changes a result: every operation works on either.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class NodeSubset:
    def __init__(self, spark: SparkSession, num_nodes: int, members: DataFrame, dense: bool, count: int | None = None):
        self.spark, self.num_nodes, self._df, self.is_dense, self._count = spark, num_nodes, members, dense, count

    @classmethod
    def empty(cls, spark: SparkSession, num_nodes: int = 0) -> NodeSubset:
        return cls(spark, num_nodes, spark.range(0), False, 0)

    @classmethod
    def single(cls, spark: SparkSession, num_nodes: int, node: int) -> NodeSubset:
        if not 0 <= node < num_nodes:
            raise ValueError(f"node {node} is not in 0..{num_nodes - 1}")
        return cls(spark, num_nodes, spark.range(node, node + 1), False, 1)

    @classmethod
    def full(cls, spark: SparkSession, num_nodes: int) -> NodeSubset:
        return cls(spark, num_nodes, spark.range(num_nodes).withColumn("active", F.lit(True)), True, num_nodes)

    @classmethod
    def sparse(cls, spark: SparkSession, num_nodes: int, ids: Iterable[int] | DataFrame, count: int | None = None) -> NodeSubset:
        """Listed members; repeats count once. ``count`` is trusted and saves a job."""
        if not isinstance(ids, DataFrame):
            ids = sorted(set(ids))
            if ids and not (0 <= ids[0] and ids[-1] < num_nodes):
                raise ValueError(f"members must be in 0..{num_nodes - 1}")
            return cls(spark, num_nodes, spark.createDataFrame([(i,) for i in ids], "id long"), False, len(ids))
        rows = ids.select(F.col(ids.columns[0]).cast("long").alias("id"))
        return cls(spark, num_nodes, rows if count is not None else rows.distinct(), False, count)

    @classmethod
    def dense(cls, spark: SparkSession, num_nodes: int, bits: Iterable[bool] | DataFrame, count: int | None = None) -> NodeSubset:
        """Members by a flag a node: flags from 0 on, or a table (id, active)."""
        if isinstance(bits, DataFrame):
            return cls(spark, num_nodes, bits.select("id", F.coalesce("active", F.lit(False)).alias("active")), True, count)
        flags = list(bits)
        if len(flags) > num_nodes:
            raise ValueError("more flags than nodes")
        rows = spark.createDataFrame([(i, bool(b)) for i, b in enumerate(flags)], "id long, active boolean")
        return cls(spark, num_nodes, rows, True, sum(map(bool, flags)))

    @property
    def node_count(self) -> int:
        return self.num_nodes

    @property
    def subset_count(self) -> int:
        if self._count is None:
            self._count = self.nodes().count()
        return self._count

    @property
    def is_empty(self) -> bool:
        return self.nodes().isEmpty() if self._count is None else self._count == 0

    def nodes(self) -> DataFrame:
        """Members, as (id)."""
        return self._df.where("active").select("id") if self.is_dense else self._df.select("id")

    def node(self, i: int) -> int:
        """The i-th least member."""
        row = self.nodes().orderBy("id").offset(i).limit(1).first() if i >= 0 else None
        if row is None:
            raise IndexError(i)
        return row.id

    def __iter__(self) -> Iterator[int]:
        return (r.id for r in self.nodes().orderBy("id").toLocalIterator())

    def __len__(self) -> int:
        return self.subset_count

    def flags(self) -> DataFrame:
        """(id, active) of every node."""
        marks = self.nodes().withColumn("active", F.lit(True))
        return self.spark.range(self.num_nodes).join(marks, "id", "left").select("id", F.coalesce("active", F.lit(False)).alias("active"))

    def to_dense(self) -> NodeSubset:
        return self if self.is_dense else NodeSubset(self.spark, self.num_nodes, self.flags(), True, self._count)

    def to_sparse(self) -> NodeSubset:
        return NodeSubset(self.spark, self.num_nodes, self.nodes(), False, self._count) if self.is_dense else self

    def contains(self, node: int) -> bool:
        return not self.nodes().where(F.col("id") == node).isEmpty()

    def contained(self, nodes: DataFrame) -> DataFrame:
        """The rows of ``nodes`` (with ``id``) that are members."""
        return nodes.join(self.nodes(), "id", "left_semi")
