"""Graphs as Parquet: an edge table and a one-row table of counts."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.graph import Graph


def write_graph(graph: Graph, path: str, mode: str = "errorifexists") -> None:
    """Write edges (sorted by source in each file, so that point reads skip row groups) and counts."""
    graph.edges.repartition("src").sortWithinPartitions("src", "dst").write.mode(mode).parquet(f"{path}/edges")
    counts = graph.spark.createDataFrame([(graph.num_nodes, graph.num_rels)], "num_nodes long, num_rels long")
    counts.coalesce(1).write.mode(mode).parquet(f"{path}/counts")


def read_graph(spark: SparkSession, path: str) -> Graph:
    """A graph from Parquet written by :func:`write_graph`, or from a binary file."""
    if path.endswith((".bin", ".csr")):
        from .binary import read_binary

        return read_binary(spark, path)
    row = spark.read.parquet(f"{path}/counts").first()
    return Graph(spark.read.parquet(f"{path}/edges"), row.num_nodes, row.num_rels)


def convert(spark: SparkSession, text_path: str, out: str) -> Graph:
    """Adjacency text to Parquet (or to the binary form for .bin and .csr)."""
    from .adjacency import read_adjacency
    from .binary import write_binary

    graph = read_adjacency(spark, text_path)
    if out.endswith((".bin", ".csr")):
        write_binary(graph, out)
    else:
        write_graph(graph, out)
    return read_graph(spark, out)
