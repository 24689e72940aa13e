"""Directed multigraphs as a vertex range and an edge table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A frontier whose out-degrees sum to more than 1/FRACTION of the edges is dense.
FRACTION = 20
#: A partition of edges has about this many, if there are no more than partitions.
PART_EDGES = 50_000
#: Tables of more rows are joined by shuffle, whatever size the planner takes them for.
BROADCAST_ROWS = 200_000


class Graph:
    """Nodes ``0 .. num_nodes-1`` and edges (src, dst); parallel edges and loops count.

    Node ids come from the count, not from the edges, so isolated nodes exist.
    """

    def __init__(self, edges: DataFrame, num_nodes: int, num_rels: int | None = None):
        if num_nodes < 0:
            raise ValueError("num_nodes must not be negative")
        self.spark: SparkSession = edges.sparkSession
        self.edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        self.num_nodes = int(num_nodes)
        self._num_rels = num_rels

    @classmethod
    def from_edges(cls, edges: DataFrame, num_nodes: int | None = None, src: str = "src", dst: str = "dst", validate: bool = True) -> Graph:
        """A graph of an edge table; without ``num_nodes`` the largest id decides."""
        pairs = edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
        if not validate and num_nodes is not None:
            return cls(pairs, num_nodes)
        bad = F.col("src").isNull() | F.col("dst").isNull() | (F.least("src", "dst") < 0)
        row = pairs.agg(F.count("*").alias("m"), F.max(F.greatest("src", "dst")).alias("top"), F.count_if(bad).alias("bad")).first()
        top = -1 if row.top is None else row.top
        n = top + 1 if num_nodes is None else num_nodes
        if row.bad or top >= n:
            raise ValueError(f"edge ends must be in 0..{n - 1}")
        return cls(pairs, n, row.m)

    @classmethod
    def from_adjacency(cls, spark: SparkSession, lists: Sequence[Sequence[int]]) -> Graph:
        """A graph of out-neighbour lists, for tests and small inputs."""
        rows = [(s, d) for s, out in enumerate(lists) for d in out]
        return cls.from_edges(spark.createDataFrame(rows, "src long, dst long"), len(lists))

    @classmethod
    def from_csr(cls, nodes: DataFrame, targets: DataFrame, num_nodes: int, num_rels: int) -> Graph:
        """A graph of (id, offset) and (pos, dst): node ``id`` owns targets from its offset to the next one.

        Positions are generated in two steps, so that no node's list is one row.
        """
        spans = csr_degrees(nodes, num_rels, num_nodes).where("degree > 0")
        first, size, step = F.col("offset"), F.col("degree"), F.lit(1 << 16)
        blocks = spans.select("id", "offset", "degree", F.explode(F.sequence(first, first + size - 1, step)).alias("_at"))
        pos = blocks.select(F.col("id").alias("src"), F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + step, first + size) - 1)).alias("pos"))
        return cls(pos.join(_counted(targets, num_rels), "pos").select("src", "dst"), num_nodes, num_rels)

    @cached_property
    def vertices(self) -> DataFrame:
        return self.spark.range(self.num_nodes)

    @property
    def num_rels(self) -> int:
        """Edges, parallel ones included; counted once."""
        if self._num_rels is None:
            self._num_rels = self.edges.count()
        return self._num_rels

    @property
    def threshold(self) -> int:
        return self.num_rels // FRACTION

    def _parts(self) -> int:
        """Partitions of a view: those of a shuffle, fewer where they would hold few edges."""
        most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(1, min(most, -(-self.num_rels // PART_EDGES)))

    def _hubs(self, by: str) -> DataFrame:
        """(hub, splits): nodes with more edges than a fair partition has, of which there are at most as many as partitions."""
        fair = max(1, self.num_rels // self._parts())
        counted = self.edges.groupBy(F.col(by).alias("hub")).agg(F.count("*").alias("n")).where(F.col("n") > fair)
        rows = counted.select("hub", F.ceil(F.col("n") / F.lit(fair)).cast("int").alias("splits")).collect()
        return F.broadcast(self.spark.createDataFrame(rows, "hub long, splits int"))

    @cached_property
    def out_hubs(self) -> DataFrame:
        return self._hubs("src")

    @cached_property
    def in_hubs(self) -> DataFrame:
        return self._hubs("dst")

    def _view(self, by: str, other: str, hubs: DataFrame) -> DataFrame:
        marked = self.edges.join(hubs, F.col(by) == F.col("hub"), "left")
        part = F.coalesce(F.pmod(F.xxhash64(other), F.col("splits")), F.lit(0)).cast("int")
        return marked.select("src", "dst", part.alias("part")).repartition(self._parts(), by, "part").cache()

    @cached_property
    def out_view(self) -> DataFrame:
        """(src, dst, part): edges dealt by source, a hub's over several parts, kept for the rounds of a push."""
        return self._view("src", "dst", self.out_hubs)

    @cached_property
    def in_view(self) -> DataFrame:
        """(src, dst, part): edges dealt by target, a hub's over several parts, kept for the rounds of a pull."""
        return self._view("dst", "src", self.in_hubs)

    def unpersist(self) -> None:
        for name in ("out_view", "in_view"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()

    @staticmethod
    def spread(rows: DataFrame, hubs: DataFrame, key: str) -> DataFrame:
        """``rows`` with ``part``: a hub's row once for each part of its edges, all others once."""
        marked = rows.join(hubs, F.col(key) == F.col("hub"), "left")
        parts = F.sequence(F.lit(0), F.coalesce(F.col("splits"), F.lit(1)) - 1)
        return marked.select(*rows.columns, F.explode(parts).alias("part"))

    def _degrees(self, by: str) -> DataFrame:
        counted = self.edges.groupBy(F.col(by).alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices.join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def out_degrees(self) -> DataFrame:
        """(id, degree) of every node; parallel edges count each."""
        return self._degrees("src")

    def in_degrees(self) -> DataFrame:
        return self._degrees("dst")

    def neighbors_out(self, node: int | None = None) -> DataFrame:
        """(id, neighbor), a row an edge: of one node, or of all."""
        rows = self.edges if node is None else self.edges.where(F.col("src") == node)
        return rows.select(F.col("src").alias("id"), F.col("dst").alias("neighbor"))

    def neighbors_in(self, node: int | None = None) -> DataFrame:
        rows = self.edges if node is None else self.edges.where(F.col("dst") == node)
        return rows.select(F.col("dst").alias("id"), F.col("src").alias("neighbor"))

    def adjacency(self, incoming: bool = False) -> DataFrame:
        """(id, neighbors) with sorted lists; a node's list must fit in a row."""
        rows = self.neighbors_in() if incoming else self.neighbors_out()
        lists = rows.groupBy("id").agg(F.array_sort(F.collect_list("neighbor")).alias("neighbors"))
        none = F.array().cast("array<bigint>")
        return self.vertices.join(lists, "id", "left").select("id", F.coalesce("neighbors", none).alias("neighbors"))

    def invert(self) -> Graph:
        """The transpose."""
        return Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), self.num_nodes, self._num_rels)

    def symmetrize(self) -> Graph:
        """Every edge in both directions."""
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return Graph(self.edges.union(back), self.num_nodes, None if self._num_rels is None else 2 * self._num_rels)

    def filter_edges(self, condition) -> Graph:
        """The graph with the edges that meet ``condition`` on (src, dst)."""
        return Graph(self.edges.where(condition), self.num_nodes)

    def csr(self) -> DataFrame:
        """(id, degree, offset): where each node's edges start when sorted by source."""
        from ..functions.prefix import running_start

        return running_start(self.out_degrees(), "degree", "id", "offset", self.num_nodes)


def _counted(rows: DataFrame, count: int) -> DataFrame:
    """``rows``, which are ``count``, as a side of a join; rows that a function makes from a few ranges count as few for the planner."""
    return rows if count <= BROADCAST_ROWS else rows.hint("merge")


def csr_degrees(nodes: DataFrame, num_rels: int, num_nodes: int = 0) -> DataFrame:
    """(id, offset, degree) from (id, offset): the next offset less the own one. ``num_nodes``: rows of ``nodes``, if the planner can't know."""
    nxt = _counted(nodes.select((F.col("id") - 1).alias("id"), F.col("offset").alias("next")), num_nodes)
    return nodes.join(nxt, "id", "left").select("id", "offset", (F.coalesce("next", F.lit(num_rels)) - F.col("offset")).alias("degree"))
