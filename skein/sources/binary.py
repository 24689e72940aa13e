"""Binary CSR: little-endian u64 N, M, (degree, offset) x N, targets x M, then the same for in-edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..session import ship
from . import files
from .ordered import write_ordered

RANGE = 32 << 20


def _column(spark: SparkSession, path: str, begin: int, count: int, width: int, step: int) -> DataFrame:
    """(pos, a[, b]): ``count`` entries of ``width`` numbers from byte ``begin``."""
    ship(spark)
    size = 8 * width
    parts = files.ranges(0, count, max(1, step // size))
    names = ["pos", "a", "b"][: 1 + width]
    ddl = ", ".join(f"{c} long" for c in names)
    if not parts:
        return spark.createDataFrame([], ddl)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(files.read(path, begin + r["a"] * size, (r["b"] - r["a"]) * size), "<i8").reshape(-1, width)
                cols = [np.arange(r["a"], r["b"]), *(np.ascontiguousarray(x[:, c]) for c in range(width))]
                for i in range(0, len(x), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 200_000]) for c in cols], names)

    return spark.createDataFrame(parts, "part long, a long, b long").repartition(len(parts), "part").mapInArrow(emit, ddl)


def read_binary(spark: SparkSession, path: str, step: int = RANGE) -> Graph:
    """The graph of a binary file; the in-edges of the file are the same edges and are not read.

    ValueError: a size that doesn't fit the counts (trailing bytes too), targets or
    offsets out of range.
    """
    total = files.size(path)
    head = np.frombuffer(files.read(path, 0, 16), "<u8")
    n, m = (int(v) for v in head) if len(head) == 2 else (-1, -1)
    if n < 0 or total != 16 + 2 * (16 * n + 8 * m):
        raise ValueError("the file's size doesn't fit its counts")
    nodes = _column(spark, path, 16, n, 2, step).select(F.col("pos").alias("id"), F.col("b").alias("offset"), F.col("a").alias("degree"))
    targets = _column(spark, path, 16 + 16 * n, m, 1, step).select("pos", F.col("a").alias("dst"))
    if not nodes.where((F.col("degree") < 0) | (F.col("offset") < 0) | (F.col("offset") + F.col("degree") > m)).isEmpty():
        raise ValueError("a node's edges are out of range")
    if not targets.where((F.col("dst") < 0) | (F.col("dst") >= n)).isEmpty():
        raise ValueError(f"targets must be in 0..{n - 1}")
    return Graph.from_csr(nodes.select("id", "offset"), targets, n, m)


def _raw(batch: pa.RecordBatch) -> bytes:
    """The numbers of ``batch`` row by row."""
    return np.column_stack([c.to_numpy() for c in batch.columns]).astype("<i8").tobytes()


def write_binary(graph: Graph, path: str) -> None:
    """Write the binary form as one file, in parallel (for exchange); executors must see ``path``."""
    head = np.array([graph.num_nodes, graph.num_rels], "<u8").tobytes()
    tables = []
    for g in (graph, graph.invert()):
        tables += [g.csr().orderBy("id").select("degree", "offset"), g.edges.orderBy("src", "dst").select("dst")]
    write_ordered(graph.spark, path, head, tables, _raw, RANGE)
