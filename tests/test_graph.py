import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import model
from skein.checkpoints import Rounds
from skein.operators import engine
from skein.operators import graph as graph_module
from skein.operators import EdgeMapper, Graph, NodeMapper, NodeSubset, bfs, connected_components, fill, node_filter, node_map, page_rank_delta, relationship_map, tabulate, top_ranked

GRAPHS = {
    # name: (n, edges, root, parents, labels, rank after at most ten reference rounds)
    "sample": (4, [(0, 1), (2, 3)], 0, [0, 0, None, None], [0, 0, 2, 2], [0.15, 0.3625, 0.15, 0.3625]),
    "chain": (4, [(0, 1), (1, 2), (2, 3)], 1, [None, 1, 1, 2], [0, 0, 0, 0], [0.15, 0.3625, 0.3625, 0.3625]),
    "triangle": (3, [(0, 1), (1, 2), (2, 0)], 0, [0, 0, 1], [0, 0, 0], [0.433333] * 3),
    "n3": (3, [(0, 1), (1, 2)], 0, [0, 0, 1], [0, 0, 0], [0.15, 0.2775, 0.433333]),
    "n2": (2, [(0, 1)], 0, [0, 0], [0, 0], [0.15, 0.575]),
    "multi": (6, [(0, 1), (0, 2), (1, 3), (2, 3), (2, 3), (3, 3), (5, 4)], 0, [0, 0, 0, 1, None, None], [0, 0, 0, 0, 4, 5], [0.15, 0.220833, 0.220833, 0.575, 0.291667, 0.15]),
    "ancestor": (4, [(3, 0), (3, 1), (1, 2)], 3, [3, 3, 1, 3], [0, 1, 1, 3], [0.25625, 0.25625, 0.3625, 0.15]),
    "isolated": (3, [], 1, [None, 1, None], [0, 1, 2], [0.15] * 3),
}


def make(spark, n, edges):
    return Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"), n)


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("name", GRAPHS)
def test_golden(spark, name):
    n, edges, root, parents, labels, rank = GRAPHS[name]
    g = make(spark, n, edges)
    assert column(bfs(g, root), "parent") == parents
    assert column(connected_components(g), "label") == labels
    assert column(page_rank_delta(g, 10), "rank") == pytest.approx(rank, abs=1e-6)


def test_published_rank(spark):
    g = make(spark, *GRAPHS["sample"][:2])
    assert column(page_rank_delta(g, 10, "published"), "rank") == pytest.approx([0.0375, 0.069375, 0.0375, 0.069375])


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 12).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=25), st.integers(0, n - 1))))
def test_random_graphs(spark, case):
    n, edges, root = case
    g = make(spark, n, edges)
    want = model.bfs(n, edges, root)
    for way in ("push", "pull", "auto"):
        got = {r.id: (r.parent, r.depth) for r in bfs(g, root, way).collect()}
        assert got == want, way
    assert {r.id: r.label for r in connected_components(g).collect()} == model.labels(n, edges)
    both = edges + [(d, s) for s, d in edges]
    assert {r.id: r.label for r in connected_components(g, symmetrize=True).collect()} == model.labels(n, both)
    for mode in ("reference", "published"):
        got = {r.id: r.rank for r in page_rank_delta(g, 3, mode).collect()}
        assert got == pytest.approx(model.ranks(n, edges, 3, mode), abs=1e-9)


def test_accessors(spark):
    g = Graph.from_adjacency(spark, [[1, 2, 2], [2], [], [3]])
    assert (g.num_nodes, g.num_rels, g.threshold) == (4, 5, 0)
    assert column(g.out_degrees(), "degree") == [3, 1, 0, 1]
    assert column(g.in_degrees(), "degree") == [0, 1, 3, 1]
    assert sorted(r.neighbor for r in g.neighbors_out(0).collect()) == [1, 2, 2]
    assert sorted(r.neighbor for r in g.neighbors_in(2).collect()) == [0, 0, 1]
    assert column(g.adjacency(), "neighbors") == [[1, 2, 2], [2], [], [3]]
    assert column(g.adjacency(incoming=True), "neighbors") == [[], [0], [0, 0, 1], [3]]
    back = g.invert().invert().edges
    assert back.exceptAll(g.edges).isEmpty() and g.edges.exceptAll(back).isEmpty()
    assert [tuple(r) for r in g.csr().orderBy("id").select("degree", "offset").collect()] == [(3, 0), (1, 3), (0, 4), (1, 4)]
    assert g.filter_edges(F.col("src") == F.col("dst")).num_rels == 1
    assert g.symmetrize().num_rels == 10
    rows = g.edges.orderBy("src", "dst").collect()
    targets = spark.createDataFrame([(i, r.dst) for i, r in enumerate(rows)], "pos long, dst long")
    again = Graph.from_csr(g.csr().select("id", "offset"), targets, 4, 5).edges
    assert again.exceptAll(g.edges).isEmpty() and again.count() == 5


def test_invalid_graphs(spark):
    for edges in ([(0, 4)], [(-1, 0)], [(None, 0)]):
        with pytest.raises(ValueError):
            make(spark, 4, edges)
    g = make(spark, 2, [(0, 1)])
    for bad in (lambda: bfs(g, 2), lambda: bfs(g, -1), lambda: page_rank_delta(g, 0), lambda: page_rank_delta(g, 1, "other")):
        with pytest.raises(ValueError):
            bad()


def test_subsets(spark):
    assert NodeSubset.empty(spark, 42).is_empty and NodeSubset.empty(spark, 42).subset_count == 0
    assert list(NodeSubset.single(spark, 42, 13)) == [13]
    full = NodeSubset.full(spark, 42)
    assert full.subset_count == 42 and full.is_dense and full.contains(41) and list(full) == list(range(42))
    some = NodeSubset.sparse(spark, 42, [1, 9, 8, 4, 4])
    assert list(some) == [1, 4, 8, 9] and len(some) == 4 and some.node(2) == 8
    dense = some.to_dense()
    assert dense.is_dense and dense.contains(9) and not dense.contains(5) and list(dense.to_sparse()) == [1, 4, 8, 9]
    assert len(NodeSubset.dense(spark, 42, [True] * 23)) == 23
    assert list(NodeSubset.dense(spark, 4, [False, True])) == [1]
    assert [r.active for r in some.flags().orderBy("id").collect()].count(True) == 4
    for bad in (lambda: NodeSubset.single(spark, 3, 3), lambda: NodeSubset.sparse(spark, 3, [3]), lambda: NodeSubset.dense(spark, 1, [True, True])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(IndexError):
        some.node(4)


@pytest.mark.parametrize("way", ["push", "pull", "auto"])
def test_one_hop(spark, way):
    g = make(spark, *GRAPHS["chain"][:2])
    state = g.vertices.withColumn("from_", F.lit(None).cast("long"))
    mapper = EdgeMapper(message=lambda: F.col("src"), combine=F.min, apply=lambda: {"from_": F.col("m")})
    new, frontier = relationship_map(g, state, NodeSubset.single(spark, 4, 1), mapper, way)
    assert list(frontier) == [2] and column(new, "from_") == [None, None, 1, None]
    checked = EdgeMapper(message=lambda: F.col("src"), combine=F.min, check=lambda: F.col("id") != 2)
    assert list(relationship_map(g, state, NodeSubset.single(spark, 4, 1), checked, way)[1]) == []


def test_node_maps(spark):
    state = spark.range(4).withColumns({"a": F.col("id"), "b": F.lit(0).cast("long")})
    members = NodeSubset.sparse(spark, 4, [1, 2])
    mapper = NodeMapper(update=lambda: {"a": F.col("a") + 10, "b": F.col("a")}, keep=lambda: F.col("a") > 1)
    new, kept = node_filter(state, members, mapper)
    assert column(new, "a") == [0, 11, 12, 3] and column(new, "b") == [0, 1, 2, 0] and list(kept) == [2]
    assert column(node_map(state, members.to_dense(), mapper), "a") == [0, 11, 12, 3]
    assert column(tabulate(spark, 3, lambda i: i * 2), "value") == [0, 2, 4]
    assert column(fill(spark, 3, lambda: 7), "value") == [7, 7, 7]
    ranks = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0)], "id long, rank double")
    assert [r.id for r in top_ranked(ranks, 2).collect()] == [1, 2]


def test_plans(spark):
    g = make(spark, *GRAPHS["multi"][:2])
    g.in_view.count()
    counted = g.in_view.groupBy("dst").count()
    plan = counted._jdf.queryExecution().sparkPlan().toString() + counted._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    joined = g.out_view.join(F.broadcast(spark.range(2)), F.col("src") == F.col("id"))
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    g.unpersist()


@pytest.mark.parametrize("small", [0, 10**9])
def test_rounds_of_changed_rows(spark, monkeypatch, small):
    """Long paths, a star and a cycle: with tables of changed rows, merged now and then, as with whole tables."""
    monkeypatch.setattr(engine, "SMALL_NODES", small)
    monkeypatch.setattr(engine, "FOLD", 2)
    edges = [(i, i + 1) for i in range(11)] + [(20, 20 + i) for i in range(1, 9)] + [(30, 31), (31, 32), (32, 30)] + [(11, 20), (28, 39)]
    n = 40
    g = make(spark, n, edges * 3 + [(39, 39)])
    for way in ("push", "auto"):
        assert {r.id: (r.parent, r.depth) for r in bfs(g, 0, way).collect()} == model.bfs(n, edges, 0)
    assert {r.id: r.label for r in connected_components(g, direction="push").collect()} == model.labels(n, edges)


def test_versions(spark, monkeypatch):
    monkeypatch.setattr(engine, "FOLD", 2)
    rounds = Rounds(spark, "t")
    rows = {i: i for i in range(100)}
    states = engine.Versions(rounds, rounds.cut(spark.range(100).selectExpr("id", "id as x"))[0], 100)
    for k in range(9):
        new = {i: 1000 * k + i for i in range(k, k + 4)}
        rows |= new
        front = rounds.cut(spark.createDataFrame([*new.items()], "id long, x long"))[0]
        states.add(front, len(new))
        assert {r.id: r.x for r in front.collect()} == new  # still there: it is the frontier
        assert {r.id: r.x for r in states.all().collect()} == rows
        got = spark.createDataFrame([(i, -i) for i in range(0, 100, 3)], "dst long, m long")
        assert {r.id: (r.x, r.m) for r in states.met(got).collect()} == {i: (rows[i], -i) for i in range(0, 100, 3)}


def test_hubs_are_dealt_over_partitions(spark, monkeypatch):
    """Most edges leave one node and enter another: no partition of a view holds them all, and nothing changes."""
    monkeypatch.setattr(graph_module, "PART_EDGES", 100)
    edges = [(0, i) for i in range(1, 300)] + [(i, 299) for i in range(1, 299)]
    g = make(spark, 300, edges)
    for view in (g.out_view, g.in_view):
        sizes = [r.n for r in view.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 3 and max(sizes) < 0.6 * len(edges)
    hits = EdgeMapper(message=lambda: F.lit(1), combine=F.sum, apply=lambda: {"hits": F.col("m")}, check=lambda: F.col("id") > 250)
    state = g.vertices.withColumn("hits", F.lit(0).cast("long"))
    for limit in (0, 10**6):  # by shuffle and by broadcast
        monkeypatch.setattr(engine, "BROADCAST_ROWS", limit)
        for way in ("push", "pull"):
            new, front = relationship_map(g, state, NodeSubset.full(spark, 300), hits, way)
            assert {r.id: r.hits for r in new.where("hits > 0").collect()} == {i: 1 for i in range(251, 299)} | {299: 299}
            assert front.subset_count == 49
    plan = engine.messages(g, state, hits, "pull", None, engine.open_targets(state, hits))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [dst") < plan.index("LeftSemi")  # the check is below the aggregate
    g.unpersist()


def test_trusted_counts(spark):
    """A count that is given is taken as it is, without a job."""
    s = NodeSubset.sparse(spark, 50, spark.range(5), count=5)
    assert (s.subset_count, s.is_empty, len(s)) == (5, False, 5) and [*s] == [0, 1, 2, 3, 4]
    d = NodeSubset.dense(spark, 50, spark.range(50).selectExpr("id", "id % 10 = 3 as active"), count=5)
    assert d.subset_count == 5 and d.node(1) == 13 and [*d.to_sparse()] == [3, 13, 23, 33, 43]
    assert NodeSubset.sparse(spark, 50, spark.range(5), count=7).subset_count == 7
