"""Connected components of an undirected link table by alternating stars.

Each round links every node's larger neighbours to its least neighbour (large
star), then its smaller ones (small star). Both are an aggregate and one join on
a key. A hub's links are pre-aggregated, and its join is one with a broadcast row: of
all nodes' least neighbours where there are few, else of the hubs', which are fewer than
the partitions. So a hub's links stay dealt as they are. The link table converges to one star a component in a logarithmic
number of rounds, each cut by a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

MAX_ROUNDS = 60


def _digest(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the links."""
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first()
    return tuple(row)


def _star(pairs: DataFrame, large: bool, most: int) -> tuple[DataFrame, DataFrame | None]:
    """pairs(u, v), at most ``most``: links seen from u. Links u's larger (or smaller) neighbours to the least of them all."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"), "n")
    joined, keys = shared.join_keys(pairs, least, "u", most)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct(), keys


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component_id: the least node reachable, for each node with a link.

    Links with a null end and self-links say nothing; direction and repeats don't
    matter. No links: no rows. Nodes without links are not listed.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = shared.materialize(edges.select(hi.alias("a"), lo.alias("b")).distinct(), "links")
    state = _digest(edges)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
        wide, keys = _star(both, True, 2 * state[0])
        if keys is not None:  # read several times below
            wide = shared.materialize(wide, "wide")
        # After the large star every link leads from a node to a smaller one; there are no more links than before.
        step, more = _star(wide.select(F.col("a").alias("u"), F.col("b").alias("v")), False, state[0])
        step = shared.materialize(step, "links")
        now = _digest(step)
        for table in (edges, wide, keys, more):
            shared.release(table)
        edges, state, before = step, now, state
        if now == before:
            break
    else:
        raise RuntimeError("components did not converge")
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component_id")).distinct()
    return members.union(roots)
