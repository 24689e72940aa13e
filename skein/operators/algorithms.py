"""Breadth-first search, component labels and PageRank on edge maps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import Rounds
from .engine import EdgeMapper, iterate, messages
from .graph import Graph

DAMPING, TOLERANCE, DELTA = 0.85, 1e-7, 1e-2


def _start(graph: Graph, active) -> DataFrame:
    return graph.out_degrees().withColumn("active", active)


def bfs(graph: Graph, root: int, direction: str = "auto") -> DataFrame:
    """(id, parent, depth): null where ``root`` doesn't reach; its own parent is itself.

    Among the predecessors one step nearer, the least id is the parent.
    """
    if not 0 <= root < graph.num_nodes:
        raise ValueError(f"root {root} is not in 0..{graph.num_nodes - 1}")
    at = F.col("id") == root
    state = _start(graph, at).withColumns({"parent": F.when(at, F.col("id")), "depth": F.when(at, F.lit(0))})
    mapper = EdgeMapper(
        message=lambda: F.struct(F.col("src").alias("src"), (F.col("depth") + 1).alias("depth")),
        combine=lambda m: F.struct(F.min(m["src"]).alias("src"), F.min(m["depth"]).alias("depth")),
        apply=lambda: {"parent": F.col("m.src"), "depth": F.col("m.depth")},
        check=lambda: F.col("parent").isNull(),
        source=("depth",),
    )
    return iterate(graph, state, mapper, direction, name="bfs")[0].select("id", "parent", "depth")


def connected_components(graph: Graph, symmetrize: bool = False, direction: str = "auto") -> DataFrame:
    """(id, label): the least node from which a directed path leads here.

    With ``symmetrize`` edges count both ways, and labels name weak components.
    """
    g = graph.symmetrize() if symmetrize else graph
    state = _start(g, F.lit(True)).withColumn("label", F.col("id"))
    mapper = EdgeMapper(
        message=lambda: F.col("label"),
        combine=F.min,
        apply=lambda: {"label": F.least("label", "m")},
        emits=lambda: F.col("m") < F.col("label"),
        source=("label",),
    )
    out = iterate(g, state, mapper, direction, name="cc")[0].select("id", "label")
    if symmetrize:
        g.unpersist()
    return out


@dataclass(frozen=True)
class RankMode:
    """Where the two variants of delta PageRank differ."""

    scale_base: bool  # base rank over N
    relative: bool  # thresholds relative to the rank and by the size of delta
    signed_error: bool


MODES = {"reference": RankMode(False, False, True), "published": RankMode(True, True, False)}


def page_rank_delta(graph: Graph, max_iterations: int, mode: str = "reference", damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = DELTA) -> DataFrame:
    """(id, rank) after at most ``max_iterations`` rounds in which only changes travel.

    ``reference``: base rank 1 - damping, first round keeps nodes with |delta| > rank +
    threshold, later ones test the rank itself, the signed sum of deltas ends it.
    ``published``: base rank over N, |delta| > threshold * rank, absolute sum.
    """
    if max_iterations < 1:
        raise ValueError("max_iterations must be at least 1")
    if mode not in MODES:
        raise ValueError(f"mode is one of {sorted(MODES)}")
    n, how = graph.num_nodes, MODES[mode]
    if not n:
        return graph.spark.createDataFrame([], "id long, rank double")
    base = (1 - damping) / (n if how.scale_base else 1)
    state = _start(graph, F.lit(True)).withColumns({"delta": F.lit(1.0 / n), "rank": F.lit(0.0)})
    mapper = EdgeMapper(message=lambda: F.col("delta") / F.col("degree"), combine=F.sum, has_output=False, source=("delta", "degree"))
    rounds = Rounds(graph.spark, "rank")
    seen = {
        "n": F.count_if("active"), "d": F.coalesce(F.sum(F.when(F.col("active"), F.col("degree"))), F.lit(0)),
        "error": F.sum("delta" if how.signed_error else F.abs("delta")),
    }
    state, size = rounds.cut(state, **seen)
    for k in range(max_iterations):
        way = "pull" if size["d"] > graph.threshold else "push"
        got = messages(graph, state.where("active"), mapper, way, size["n"]).select(F.col("dst").alias("id"), "m")
        joined = state.join(got, "id", "left").withColumn("ngh", F.coalesce("m", F.lit(0.0)))
        if k == 0:
            x = F.col("ngh") * damping + base
            step = joined.select("id", "degree", (x - 1.0 / n).alias("delta"), (F.col("rank") + x).alias("rank"))
            limit = F.col("rank") * threshold if how.relative else F.col("rank") + threshold
            step = step.withColumn("active", F.abs("delta") > limit)
        else:
            change = F.col("ngh") * damping
            step = joined.select("id", "degree", change.alias("delta"), F.col("rank"))
            big = F.abs("delta" if how.relative else "rank") > F.col("rank") * threshold
            step = step.select("id", "degree", "delta", F.when(big, F.col("rank") + F.col("delta")).otherwise(F.col("rank")).alias("rank"), big.alias("active"))
        before, (state, size) = state, rounds.cut(step, **seen)  # one job a round
        rounds.drop(before)
        if size["error"] < tolerance:
            break
    return state.select("id", "rank")


def top_ranked(ranks: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest ranks; ties by least id."""
    return ranks.orderBy(F.desc("rank"), "id").limit(k)
