"""Graph operators: graphs, frontiers, maps over nodes and edges, algorithms."""

from .algorithms import bfs, connected_components, page_rank_delta, top_ranked
from .engine import EdgeMapper, NodeMapper, fill, iterate, node_filter, node_map, relationship_map, tabulate
from .graph import Graph
from .subset import NodeSubset

__all__ = [
    "EdgeMapper", "Graph", "NodeMapper", "NodeSubset", "bfs", "connected_components", "fill", "iterate", "node_filter",
    "node_map", "page_rank_delta", "relationship_map", "tabulate", "top_ranked",
]
