"""Maps over frontiers: declared as columns, run as joins and aggregates.

A round is bulk-synchronous: messages and checks see the state before the round.
Targets are checked before any message is aggregated. State is a table of all
nodes and small tables of the rows changed since: a round of a small frontier reads
its edges' targets and writes the changed rows only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import Rounds
from .graph import Graph
from .subset import NodeSubset

#: A push broadcasts frontiers of at most this many members; beyond it Spark picks the join.
BROADCAST_ROWS = 500_000
#: Tables of changed rows are merged at this number, and into the whole table at this share of it.
FOLD, SHARE = 8, 0.25
#: Tables of fewer nodes are written whole each round, which costs less than reading several.
SMALL_NODES = 1_000_000


@dataclass(frozen=True)
class EdgeMapper:
    """What an edge map does with the edges out of a frontier.

    ``message`` is made of the source's columns (and ``src``, ``dst``), ``combine``
    aggregates the messages ``m`` at a target, ``apply`` gives new state columns from the
    old ones and the combined ``m``, ``emits`` says whether the target joins the next
    frontier, and ``check`` filters targets by their old state before any of it.
    """

    message: Callable[[], Column]
    combine: Callable[[Column], Column]
    apply: Callable[[], dict[str, Column]] = dict
    emits: Callable[[], Column] = lambda: F.col("m").isNotNull()
    check: Callable[[], Column] | None = None
    has_output: bool = True
    source: tuple[str, ...] = ()


@dataclass(frozen=True)
class NodeMapper:
    """New columns of members, from old ones, and whether they stay in the frontier."""

    update: Callable[[], dict[str, Column]] = dict
    keep: Callable[[], Column] = lambda: F.lit(True)


def tabulate(spark: SparkSession, n: int, f: Callable[[Column], Column], name: str = "value") -> DataFrame:
    """(id, value) with value = f(id) for 0..n-1."""
    return spark.range(n).select("id", f(F.col("id")).alias(name))


def fill(spark: SparkSession, n: int, value, name: str = "value") -> DataFrame:
    """(id, value) with one value, or what a supplier returns, for 0..n-1."""
    return tabulate(spark, n, lambda _: F.lit(value() if callable(value) else value), name)


def degree_sum(graph: Graph, frontier: NodeSubset) -> int:
    """Edges that leave the frontier."""
    row = graph.edges.join(frontier.nodes(), graph.edges.src == F.col("id"), "left_semi").agg(F.count("*").alias("n")).first()
    return row.n


def is_dense(graph: Graph, degrees: int) -> bool:
    return degrees > graph.threshold


def messages(graph: Graph, active: DataFrame, mapper: EdgeMapper, direction: str, size: int | None, targets: DataFrame | None = None) -> DataFrame:
    """(dst, m): combined messages of the active sources (id and the mapper's columns) to ``targets`` (id), or to all.

    Push joins the frontier to edges dealt by source; pull joins targets to edges dealt
    by target first, so that others' edges end there. A frontier of known and small ``size``
    is broadcast. Partial aggregates precede every exchange by target. Results don't differ.
    """
    small = size is not None and size <= BROADCAST_ROWS
    src = active.select(F.col("id").alias("src_id"), *[F.col(c).alias(c) for c in mapper.source])
    edges = graph.in_view if direction == "pull" else graph.out_view
    if direction == "pull" and targets is not None:
        to = graph.spread(targets.select(F.col("id").alias("to")), graph.in_hubs, "to").withColumnRenamed("part", "to_part")
        edges = edges.join(to, (F.col("dst") == F.col("to")) & (F.col("part") == F.col("to_part")), "left_semi")
    if small:
        joined = edges.join(F.broadcast(src), F.col("src") == F.col("src_id"))
    elif direction == "push":
        src = graph.spread(src, graph.out_hubs, "src_id").withColumnRenamed("part", "src_part")
        joined = edges.join(src, (F.col("src") == F.col("src_id")) & (F.col("part") == F.col("src_part")))
    else:
        joined = edges.join(src, F.col("src") == F.col("src_id"))
    sent = joined.select("dst", mapper.message().alias("m"))
    if direction == "push" and targets is not None:
        sent = sent.join(targets.select(F.col("id").alias("to")), F.col("dst") == F.col("to"), "left_semi")
    return sent.groupBy("dst").agg(mapper.combine(F.col("m")).alias("m"))


def open_targets(state: DataFrame, mapper: EdgeMapper) -> DataFrame | None:
    """Nodes that the mapper's check lets through; None without a check."""
    return None if mapper.check is None else state.where(mapper.check()).select("id")


def relationship_map(graph: Graph, state: DataFrame, frontier: NodeSubset, mapper: EdgeMapper, direction: str = "auto", degrees: int | None = None) -> tuple[DataFrame, NodeSubset]:
    """Map over the edges out of ``frontier``: (new state, next frontier).

    ``state`` has a row a node (id and state columns). With ``has_output`` False the
    frontier is returned as it was. The new state is a table in the shared folder and the next
    frontier's count is known, so a loop of maps plans each round by itself.
    """
    if direction not in ("auto", "push", "pull"):
        raise ValueError("direction is auto, push or pull")
    if direction == "auto":
        degrees = degree_sum(graph, frontier) if degrees is None else degrees
        direction = "pull" if is_dense(graph, degrees) else "push"
    active = state.join(frontier.nodes(), "id", "left_semi")
    got = messages(graph, active, mapper, direction, frontier._count, open_targets(state, mapper))
    out, seen = Rounds(graph.spark, "map").cut(apply_messages(state, got, mapper), n=F.count_if("active"))
    new_state = out.drop("active")
    if not mapper.has_output:
        return new_state, frontier
    return new_state, NodeSubset(graph.spark, graph.num_nodes, out.select("id", "active"), True, seen["n"])


def _applied(joined: DataFrame, columns: list[str], mapper: EdgeMapper) -> DataFrame:
    """``joined`` (id, state columns, m) after its messages, and ``active``."""
    hit = F.col("m").isNotNull()
    if mapper.check is not None:
        hit = hit & F.coalesce(mapper.check(), F.lit(False))
    new = mapper.apply()
    cols = [F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in columns]
    emits = (hit & F.coalesce(mapper.emits(), F.lit(False))) if mapper.has_output else F.lit(False)
    return joined.select("id", *cols, emits.alias("active"))


def apply_messages(state: DataFrame, got: DataFrame, mapper: EdgeMapper) -> DataFrame:
    """State columns after the messages, and ``active``: who joins the next frontier."""
    joined = state.join(got.select(F.col("dst").alias("id"), "m"), "id", "left")
    return _applied(joined, [c for c in state.columns if c != "id"], mapper)


def node_map(state: DataFrame, frontier: NodeSubset, mapper: NodeMapper) -> DataFrame:
    """State with members' columns updated, all from old values; others stay."""
    new = mapper.update()
    marked = state.join(frontier.nodes().withColumn("_in", F.lit(True)), "id", "left")
    inside = F.col("_in").isNotNull()
    return marked.select("id", *[F.when(inside, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in state.columns if c != "id"])


def node_filter(state: DataFrame, frontier: NodeSubset, mapper: NodeMapper) -> tuple[DataFrame, NodeSubset]:
    """Update members and keep those for which ``keep`` holds on their old columns."""
    new = mapper.update()
    marked = state.join(frontier.nodes().withColumn("_in", F.lit(True)), "id", "left")
    inside = F.col("_in").isNotNull()
    cols = [F.when(inside, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in state.columns if c != "id"]
    out = marked.select("id", *cols, (inside & F.coalesce(mapper.keep(), F.lit(False))).alias("active"))
    return out.drop("active"), NodeSubset(frontier.spark, frontier.num_nodes, out.select("id", "active"), True)


class Versions:
    """A table of all nodes and small tables of rows changed since, the newest last."""

    def __init__(self, rounds: Rounds, whole: DataFrame, size: int):
        self.rounds, self.whole, self.size, self.later, self.rows, self.spare = rounds, whole, size, [], 0, []
        self.columns = [c for c in whole.columns if c != "id"]

    def _numbered(self, tables: list[DataFrame]) -> DataFrame:
        out = None
        for i, t in enumerate(tables):
            t = t.select("id", F.struct(*self.columns).alias("s"), F.lit(i).alias("v"))
            out = t if out is None else out.union(t)
        return out

    def _newest(self, tables: list[DataFrame]) -> DataFrame:
        if len(tables) == 1:
            return tables[0].select("id", *self.columns)
        return self._numbered(tables).groupBy("id").agg(F.max_by("s", "v").alias("s")).select("id", "s.*")

    def all(self) -> DataFrame:
        """A row a node."""
        if not self.later:
            return self.whole
        newest = self._newest(self.later)
        ids = newest.select("id")
        old = self.whole.join(F.broadcast(ids) if self.rows <= BROADCAST_ROWS else ids, "id", "left_anti")
        return old.select("id", *self.columns).union(newest)

    def met(self, got: DataFrame) -> DataFrame:
        """The newest rows of the nodes in ``got`` (dst, m; small), and m."""
        found = self._numbered([self.whole, *self.later]).join(F.broadcast(got), F.col("id") == F.col("dst"))
        if self.later:
            found = found.groupBy("id").agg(F.max_by(F.struct("s", "m"), "v").alias("x")).select("id", "x.s", "x.m")
        return found.select("id", "s.*", "m")

    def replace(self, whole: DataFrame, front: DataFrame | None = None) -> None:
        """Go on from ``whole``; ``front`` is still read, as the frontier of the round to come."""
        old = [t for t in (self.whole, *self.later, *self.spare) if t is not front]
        self.whole, self.later, self.rows, self.spare = whole, [], 0, [] if front is None else [front]
        self.rounds.drop(*old)

    def add(self, changed: DataFrame, n: int) -> None:
        """Note the newest rows of ``n`` nodes; now and then older ones are merged, so that few tables are read."""
        self.later.append(changed)
        self.rows += n
        if self.rows > max(1, self.size * SHARE):
            self.replace(self.rounds.cut(self.all())[0], changed)
        elif len(self.later) > FOLD:  # all but the newest, which is the frontier
            old = self.later[:-1]
            self.later = [self.rounds.cut(self._newest(old))[0], changed]
            self.rounds.drop(*old)


def iterate(graph: Graph, state: DataFrame, mapper: EdgeMapper, direction: str = "auto", max_rounds: int | None = None, name: str = "state") -> tuple[DataFrame, int]:
    """Edge maps until the frontier is empty. ``state`` has id, degree, active and more.

    One job a round writes what it changes to the shared folder; the size and degree sum of
    its frontier are taken meanwhile for the next choice of direction. A pushed frontier with
    few edges changes few rows, and only those are written. Returns the last state and
    the number of rounds.
    """
    rounds = Rounds(graph.spark, name)
    size = {"rows": F.count("*"), "n": F.count_if("active"), "d": F.coalesce(F.sum(F.when(F.col("active"), F.col("degree"))), F.lit(0))}
    front, seen = rounds.cut(state, **size)
    states = Versions(rounds, front, graph.num_nodes)
    columns = [c for c in state.columns if c not in ("id", "active")]
    done = 0
    while seen["n"] and (max_rounds is None or done < max_rounds):
        way = direction if direction != "auto" else "pull" if is_dense(graph, seen["d"]) else "push"
        active = front.where("active")
        few = way == "push" and seen["d"] <= BROADCAST_ROWS  # as many messages at most
        if few and graph.num_nodes >= SMALL_NODES and seen["d"] <= graph.num_nodes * SHARE:
            met = states.met(messages(graph, active, mapper, way, seen["n"]))
            old = met.select("id", "m", *columns, F.struct(*columns).alias("old"))
            # The check precedes what is written; the few messages were combined for the lookup.
            out = _applied(old, [*columns, "old"], mapper)
            changed = out.where(F.col("active") | ~F.struct(*columns).eqNullSafe(F.col("old"))).select("id", *columns, "active")
            front, seen = rounds.cut(changed.select("id", *states.columns), **size)
            states.add(front, seen["rows"])
        else:
            now = states.all().drop("active")
            # A few messages are combined before the one lookup of their targets, which checks them too.
            got = messages(graph, active, mapper, way, seen["n"], None if few else open_targets(now, mapper))
            front, seen = rounds.cut(apply_messages(now, got, mapper).select("id", *states.columns), **size)
            states.replace(front)
        done += 1
    return states.all(), done
