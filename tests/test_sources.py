import os

import numpy as np
import pytest

from skein import cli
from skein.functions import prefix
from skein.operators import Graph
from skein.operators import graph as graphs
from skein.sources import adjacency, binary, ordered, read_adjacency, read_binary, read_graph, write_adjacency, write_binary, write_graph
from skein.streaming import stream_degrees, stream_edges

EDGES = [(0, 1), (0, 2), (1, 3), (2, 3), (2, 3), (3, 3), (5, 4)]


def edges(g):
    return sorted((r.src, r.dst) for r in g.edges.collect())


@pytest.fixture
def graph(spark):
    return Graph.from_edges(spark.createDataFrame(EDGES, "src long, dst long"), 6)


@pytest.mark.parametrize("step", [1, 3, 7, 1 << 20])
def test_text_round_trip(spark, graph, tmp_path, step):
    path = str(tmp_path / "g.adj")
    write_adjacency(graph, path)
    if step == 1 << 20:
        with open(path, "a") as f:
            f.write("99\n")  # what follows the last target doesn't count
    got = read_adjacency(spark, path, step)
    assert (got.num_nodes, got.num_rels, edges(got)) == (6, 7, sorted(EDGES))


@pytest.mark.parametrize("text", ["AdjacencyGraph\n4\n2\n0 1 1 2 1 3", "AdjacencyGraph\n4\n2\n0\n1\n1\n2\n1\n3\n"])
def test_sample(spark, tmp_path, text):
    path = tmp_path / "g.adj"
    path.write_text(text)
    assert edges(read_adjacency(spark, str(path))) == [(0, 1), (2, 3)]


@pytest.mark.parametrize(
    "text",
    ["WeightedAdjacencyGraph\n1\n0\n0\n", "AdjacencyGraph\r\n1\n0\n0\n", "AdjacencyGraph\nx\n0\n0\n", "AdjacencyGraph\n2\n1\n0\n1\n", "AdjacencyGraph\n2\n1\n0\n1\n5\n",
     "AdjacencyGraph\n2\n1\n1\n0\n1\n", "AdjacencyGraph\n2\n1\n0\n2\n1\n", "AdjacencyGraph\n2\n1\n0\nx\n1\n"],
)
def test_malformed(spark, tmp_path, text):
    path = tmp_path / "g.adj"
    path.write_bytes(text.encode())
    with pytest.raises(Exception, match="tag|number|count|target|offset"):
        read_adjacency(spark, str(path))


def test_empty_text(spark, tmp_path):
    path = tmp_path / "g.adj"
    path.write_text("AdjacencyGraph\n0\n0\n")
    g = read_adjacency(spark, str(path))
    assert (g.num_nodes, edges(g)) == (0, [])


def test_binary(spark, graph, tmp_path):
    path = str(tmp_path / "g.csr")
    write_binary(graph, path)
    raw = np.fromfile(path, "<u8")
    assert raw[:2].tolist() == [6, 7] and len(raw) * 8 == 16 + 2 * (16 * 6 + 8 * 7)
    assert edges(read_binary(spark, path, 40)) == sorted(EDGES)
    with open(path, "ab") as f:
        f.write(b"12345678")
    with pytest.raises(ValueError):
        read_binary(spark, path)


def plain(n, pairs):
    """Degrees and offsets in turn, offsets, targets."""
    degrees = [sum(s == i for s, _ in pairs) for i in range(n)]
    offsets = [sum(degrees[:i]) for i in range(n)]
    return [x for both in zip(degrees, offsets, strict=True) for x in both], offsets, [d for _, d in sorted(pairs)]


@pytest.mark.parametrize("in_place", [True, False])
def test_written_by_tasks(spark, tmp_path, monkeypatch, in_place):
    """One file of the same bytes whatever the partitions and ranges; no rows pass through the driver."""

    def refuse(*_, **__):
        raise AssertionError("rows to the driver")

    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", refuse)
    monkeypatch.setattr(ordered, "_in_place", lambda _: in_place, raising=False)
    monkeypatch.setattr(binary, "RANGE", 24)
    monkeypatch.setattr(adjacency, "RANGE", 7)
    monkeypatch.setattr(ordered, "BLOCK", 5, raising=False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # all partitions stay
    try:
        pairs = [(i * i % 50, i * 7 % 53) for i in range(120)] + [(3, i % 60) for i in range(80)] + [(9, 9)] * 30
        g = Graph.from_edges(spark.createDataFrame(pairs, "src long, dst long").repartition(5), 60)
        out, offsets, targets = plain(60, pairs)
        into, _, sources = plain(60, [(d, s) for s, d in pairs])
        path, text = tmp_path / "g.csr", tmp_path / "g.adj"
        path.write_bytes(b"old" * 9999)
        write_binary(g, str(path))
        write_adjacency(g, f"file://{text}")
        assert np.fromfile(path, "<u8").tolist() == [60, len(pairs), *out, *targets, *into, *sources]
        assert text.read_text() == "\n".join(["AdjacencyGraph", "60", str(len(pairs)), *map(str, offsets + targets), ""])
        none = Graph.from_edges(spark.createDataFrame([], "src long, dst long"), 0)
        write_binary(none, str(tmp_path / "none.csr"))
        assert (tmp_path / "none.csr").read_bytes() == bytes(16)
        assert sorted(os.listdir(tmp_path)) == ["g.adj", "g.csr", "none.csr"]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_failed_write(spark, graph, tmp_path):
    path = tmp_path / "g.csr"
    path.write_bytes(b"old")
    bad = Graph(graph.edges.selectExpr("if(src = 5, cast(raise_error('no such edge') as long), src) as src", "dst"), 6, 7)
    with pytest.raises(Exception, match="no such edge"):
        write_binary(bad, str(path))
    assert path.read_bytes() == b"old" and os.listdir(tmp_path) == ["g.csr"]


@pytest.mark.parametrize(("most", "kinds"), [(3, {"SortMergeJoin"}), (200_000, {"BroadcastHashJoin"})])
def test_read_joins_by_count(spark, graph, tmp_path, monkeypatch, most, kinds):
    """What a few ranges hold is not broadcast because the ranges are few."""
    monkeypatch.setattr(graphs, "BROADCAST_ROWS", most, raising=False)
    path = str(tmp_path / "g.csr")
    write_binary(graph, path)
    got = read_binary(spark, path, 40).edges
    assert sorted((r.src, r.dst) for r in got.collect()) == sorted(EDGES)
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert {k for k in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin") if k in plan} == kinds


def test_parquet_and_cli(spark, graph, tmp_path, capsys):
    write_graph(graph, str(tmp_path / "p"))
    got = read_graph(spark, str(tmp_path / "p"))
    assert (got.num_nodes, got.num_rels, edges(got)) == (6, 7, sorted(EDGES))
    text = str(tmp_path / "g.adj")
    write_adjacency(graph, text)
    for out in (str(tmp_path / "q"), str(tmp_path / "q.csr")):
        assert cli.main(["parse", "-o", out, text]) == 0
        assert cli.main(["cc", out]) == 0
    assert cli.main(["bfs", "-s", "0", out, "--save", str(tmp_path / "r")]) == 0
    assert cli.main(["prd", "-i", "2", out]) == 0
    assert spark.read.parquet(str(tmp_path / "r")).count() == 6
    assert capsys.readouterr().out.count("6 ") >= 4
    for bad in (["other"], ["bfs", out], ["prd", out], ["cc", out, "more"]):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_prefix(spark, monkeypatch):
    rows = spark.range(50).selectExpr("id", "id % 4 as v")
    want = [sum(i % 4 for i in range(k)) for k in range(50)]
    for bucket in (1 << 16, 7):
        monkeypatch.setattr(prefix, "BUCKET", bucket)
        got = prefix.running_start(rows, "v", "id", "start", 50).orderBy("id").collect()
        assert [r.start for r in got] == want


def test_stream(spark, graph, tmp_path):
    graph.edges.write.parquet(str(tmp_path / "in"))
    q = stream_degrees(stream_edges(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("deg").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.id: (r.out_degree, r.in_degree) for r in spark.table("deg").collect()}[3] == (1, 4)
