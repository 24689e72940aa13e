"""Graph sources and sinks: adjacency text, binary CSR, Parquet."""

from .adjacency import read_adjacency, write_adjacency
from .binary import read_binary, write_binary
from .tables import convert, read_graph, write_graph

__all__ = ["convert", "read_adjacency", "read_binary", "read_graph", "write_adjacency", "write_binary", "write_graph"]
