"""Queries over graphs of the driver's tables, with oracle SQL.

part_hop: parts linked through orders (deep, directed); cust_part_sym: customers
and parts linked both ways (sparse, many components); part_supp: bipartite.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from .. import operators as ops
from ..checkpoints import base, forget_at_exit
from ..operators import EdgeMapper, Graph, NodeMapper, NodeSubset
from ..operators.engine import degree_sum, is_dense
from ..operators.graph import csr_degrees
from ..session import ship
from ..sources import convert, read_adjacency, read_binary, read_graph, write_adjacency, write_binary, write_graph


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_hop(spark: SparkSession, sf_dir: str) -> Graph:
    n = _table(spark, sf_dir, "part").count()
    items = _table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_quantity >= 25")
    return Graph.from_edges(items.select(F.col("l_partkey").alias("src"), (F.col("l_orderkey") % n).alias("dst")), n)


def part_supp(spark: SparkSession, sf_dir: str) -> Graph:
    parts, supps = (_table(spark, sf_dir, t).count() for t in ("part", "supplier"))
    items = _table(spark, sf_dir, "lineitem")
    return Graph.from_edges(items.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + parts).alias("dst")), parts + supps)


def cust_part(spark: SparkSession, sf_dir: str) -> Graph:
    """One direction of cust_part_sym."""
    custs, parts = (_table(spark, sf_dir, t).count() for t in ("customer", "part"))
    items = _table(spark, sf_dir, "lineitem").where("l_quantity >= 50 and l_returnflag = 'R'")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return Graph.from_edges(both.select(F.col("o_custkey").alias("src"), (F.col("l_partkey") + custs).alias("dst")), custs + parts)


def _root(graph: Graph) -> int:
    return graph.edges.agg(F.min("src")).first()[0] or 0


def _seeds(graph: Graph) -> NodeSubset:
    return NodeSubset.sparse(graph.spark, graph.num_nodes, graph.vertices.where("id % 7 = 0"))


def _rounded():
    """Ranks to six places; the small addend keeps sums in other orders off the halves."""
    return F.round(F.col("rank") + F.lit(1e-10), 6).alias("rank")


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_HOP = """e as materialized (select l_partkey::bigint as s, (l_orderkey % (select count(*) from part))::bigint as d
  from lineitem where l_linenumber = 1 and l_quantity >= 25),
v as materialized (select i::bigint as id from range((select count(*) from part)) t(i))"""
_SYM = """b as (select o_custkey::bigint as s, ((select count(*) from customer) + l_partkey)::bigint as d
  from orders join lineitem on o_orderkey = l_orderkey where l_quantity >= 50 and l_returnflag = 'R'),
e as materialized (select s, d from b union all select d, s from b),
v as materialized (select i::bigint as id from range((select count(*) from customer) + (select count(*) from part)) t(i))"""
_SUPP = """e as materialized (select l_partkey::bigint as s, ((select count(*) from part) + l_suppkey)::bigint as d from lineitem),
v as materialized (select i::bigint as id from range((select count(*) from part) + (select count(*) from supplier)) t(i))"""


def query(sql: str | None = None):
    def add(f):
        @wraps(f)
        def run(spark, sf_dir):
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return add


@query(f"with {_HOP} select (select count(*) from v) as node_count, (select count(*) from e) as rel_count, (select count(*) from e) // 20 as threshold")
def graph_counts(spark, sf_dir):
    g = part_hop(spark, sf_dir)
    return spark.createDataFrame([(g.num_nodes, g.num_rels, g.threshold)], "node_count long, rel_count long, threshold long")


@query(f"with {_HOP} select id, count(s) as degree from v left join e on s = id group by id")
def out_degrees(spark, sf_dir):
    return part_hop(spark, sf_dir).out_degrees()


@query(f"with {_HOP} select id, count(d) as degree from v left join e on d = id group by id")
def in_degrees(spark, sf_dir):
    return part_hop(spark, sf_dir).in_degrees()


@query(f"with {_SUPP} select id, count(d) as degree from v left join e on d = id group by id")
def in_degrees_multigraph(spark, sf_dir):
    return part_supp(spark, sf_dir).in_degrees()


@query(f"with {_HOP} select s as id, d as neighbor from e")
def neighbors_out(spark, sf_dir):
    return part_hop(spark, sf_dir).neighbors_out()


@query(f"with {_HOP} select d as id, s as neighbor from e")
def neighbors_in(spark, sf_dir):
    return part_hop(spark, sf_dir).neighbors_in()


@query(f"with {_HOP} select id, coalesce(string_agg(s::varchar, ',' order by s), '') as sources from v left join e on d = id group by id")
def adjacency_in(spark, sf_dir):
    lists = part_hop(spark, sf_dir).adjacency(incoming=True)
    return lists.select("id", F.concat_ws(",", F.transform("neighbors", lambda x: x.cast("string"))).alias("sources"))


@query(f"with {_HOP} select d as src, s as dst from e")
def invert_edges(spark, sf_dir):
    return part_hop(spark, sf_dir).invert().edges


@query(f"with {_HOP} select s as src, d as dst from e union all select d, s from e")
def symmetrize_edges(spark, sf_dir):
    return part_hop(spark, sf_dir).symmetrize().edges


@query(f"with {_HOP} select s as src, d as dst from e where s < d")
def filter_edges(spark, sf_dir):
    return part_hop(spark, sf_dir).filter_edges(F.col("src") < F.col("dst")).edges


_DEG = "deg as (select id, count(s) as degree from v left join e on s = id group by id)"


@query(f"with {_HOP}, {_DEG} select id, degree, (sum(degree) over (order by id) - degree)::bigint as \"offset\" from deg")
def csr_offsets(spark, sf_dir):
    return part_hop(spark, sf_dir).csr()


@query(f"with {_HOP}, {_DEG} select id, degree, (sum(degree) over (order by id) - degree)::bigint as \"offset\" from deg")
def csr_degrees_from_offsets(spark, sf_dir):
    g = part_hop(spark, sf_dir)
    return csr_degrees(g.csr().select("id", "offset"), g.num_rels).select("id", "degree", "offset")


@query(f"with {_HOP} select id, id % 7 = 0 as active from v")
def subset_dense(spark, sf_dir):
    return _seeds(part_hop(spark, sf_dir)).to_dense().flags()


@query(f"with {_HOP} select id from v where id % 7 = 0")
def subset_sparse(spark, sf_dir):
    return _seeds(part_hop(spark, sf_dir)).to_dense().to_sparse().nodes()


@query(f"with {_HOP} select id from v where id % 7 = 0 and id % 2 = 0")
def subset_contains(spark, sf_dir):
    g = part_hop(spark, sf_dir)
    return _seeds(g).contained(g.vertices.where("id % 2 = 0"))


@query(
    f"""with {_HOP} select * from (values ('empty', 0::bigint), ('single', 1), ('full', (select count(*) from v)), ('sparse', (select count(*) from v where id % 7 = 0)),
    ('dense', (select count(*) from v where id % 3 = 0))) t(kind, members)"""
)
def subset_counts(spark, sf_dir):
    g = part_hop(spark, sf_dir)
    n = g.num_nodes
    dense = NodeSubset.dense(spark, n, g.vertices.select("id", (F.col("id") % 3 == 0).alias("active")))
    made = {"empty": NodeSubset.empty(spark, n), "single": NodeSubset.single(spark, n, 0), "full": NodeSubset.full(spark, n), "sparse": _seeds(g), "dense": dense}
    return spark.createDataFrame([(k, s.subset_count) for k, s in made.items()], "kind string, members long")


@query(f"with {_HOP}, x as (select count(*) as n from e where s % 7 = 0) select n as degree_sum, n > (select count(*) from e) // 20 as is_dense from x")
def frontier_degree_sum(spark, sf_dir):
    g = part_hop(spark, sf_dir)
    total = degree_sum(g, _seeds(g))
    return spark.createDataFrame([(total, is_dense(g, total))], "degree_sum long, is_dense boolean")


def _one_hop(spark, sf_dir, direction):
    g = part_hop(spark, sf_dir)
    state = g.vertices.withColumn("hits", F.lit(0).cast("long"))
    mapper = EdgeMapper(message=lambda: F.lit(1), combine=F.sum, apply=lambda: {"hits": F.col("m")}, check=lambda: F.col("id") % 2 == 1)
    new, frontier = ops.relationship_map(g, state, _seeds(g), mapper, direction)
    g.unpersist()
    return new.join(frontier.nodes(), "id", "left_semi").select("id", F.col("hits").cast("long").alias("hits"))


_HIT = f"with {_HOP} select d as id, count(*) as hits from e where s % 7 = 0 and d % 2 = 1 group by d"


@query(_HIT)
def relationship_map_push(spark, sf_dir):
    return _one_hop(spark, sf_dir, "push")


@query(_HIT)
def relationship_map_pull(spark, sf_dir):
    return _one_hop(spark, sf_dir, "pull")


@query(_HIT)
def relationship_map_auto(spark, sf_dir):
    return _one_hop(spark, sf_dir, "auto")


@query(f"with {_HOP} select id, count(s)::bigint as value from v left join (select * from e where s % 7 = 0) on d = id group by id")
def relationship_map_no_output(spark, sf_dir):
    g = part_hop(spark, sf_dir)
    state = g.vertices.withColumn("value", F.lit(0).cast("long"))
    mapper = EdgeMapper(message=lambda: F.lit(1), combine=F.sum, apply=lambda: {"value": F.col("m")}, has_output=False)
    out = ops.relationship_map(g, state, _seeds(g), mapper)[0]
    g.unpersist()
    return out


@query(f"with {_HOP} select id, case when id % 7 = 0 then id * 2 + 1 else id end as value from v")
def node_map_state(spark, sf_dir):
    g = part_hop(spark, sf_dir)
    state = g.vertices.withColumn("value", F.col("id"))
    return ops.node_map(state, _seeds(g), NodeMapper(update=lambda: {"value": F.col("value") * 2 + 1}))


@query(f"with {_HOP} select id, id * 2 + 1 as value from v where id % 7 = 0 and id % 3 = 0")
def node_filter_keep(spark, sf_dir):
    g = part_hop(spark, sf_dir)
    state = g.vertices.withColumn("value", F.col("id"))
    mapper = NodeMapper(update=lambda: {"value": F.col("value") * 2 + 1}, keep=lambda: F.col("value") % 3 == 0)
    new, kept = ops.node_filter(state, _seeds(g), mapper)
    return new.join(kept.nodes(), "id", "left_semi")


@query(f"with {_HOP} select id, id * id + 1 as value, 42 as filled from v")
def tabulate_fill(spark, sf_dir):
    n = part_hop(spark, sf_dir).num_nodes
    return ops.tabulate(spark, n, lambda i: i * i + 1).join(ops.fill(spark, n, 42, "filled"), "id")


_LEVELS = """root as (select min(s) as r from e),
b as (select r as id, 0 as dep from root union select e.d, dep + 1 from b join e on e.s = b.id where dep < 64),
dd as materialized (select id, min(dep) as dep from b group by id)"""


@query(
    f"""with recursive {_HOP}, {_LEVELS},
p as (select x.id, coalesce(min(u.id), x.id) as parent from dd x left join e on e.d = x.id left join dd u on u.id = e.s and u.dep = x.dep - 1 group by x.id)
select v.id, p.parent from v left join p on p.id = v.id"""
)
def bfs_parents(spark, sf_dir):
    g = part_hop(spark, sf_dir)
    out = ops.bfs(g, _root(g)).select("id", "parent")
    g.unpersist()
    return out


@query(f"with recursive {_HOP}, {_LEVELS} select v.id, dd.dep::int as depth from v left join dd on dd.id = v.id")
def bfs_depths(spark, sf_dir):
    g = part_hop(spark, sf_dir)
    out = ops.bfs(g, _root(g)).select("id", "depth")
    g.unpersist()
    return out


_LABELS = """r(id, label) as (select id, id from v union select e.d, r.label from r join e on e.s = r.id where r.label < e.d),
l as (select id, min(label) as label from r group by id)"""


@query(f"with recursive {_HOP}, {_LABELS} select id, label from l")
def cc_directed(spark, sf_dir):
    g = part_hop(spark, sf_dir)
    out = ops.connected_components(g)
    g.unpersist()
    return out


@query(f"with recursive {_SYM}, {_LABELS} select id, label from l")
def cc_symmetric(spark, sf_dir):
    return ops.connected_components(cust_part(spark, sf_dir), symmetrize=True)


@query(f"with recursive {_SYM}, {_LABELS} select label, count(*) as n from l group by label")
def cc_sizes(spark, sf_dir):
    return cc_symmetric(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


_REFERENCE = f"""with {_HOP}, {_DEG}, c as (select count(*)::double as n from v),
x as (select e.d as id, sum(1.0 / (c.n * deg.degree)) as g from e join deg on deg.id = e.s, c group by e.d)
select v.id, round(0.15 + 0.85 * coalesce(x.g, 0) + 1e-10, 6) as rank from v left join x on x.id = v.id"""


@query(_REFERENCE)
def prd_reference(spark, sf_dir):
    """For four nodes or more the first round decides (see README); the SQL is that closed form."""
    g = part_hop(spark, sf_dir)
    out = ops.page_rank_delta(g, 10, "reference").select("id", _rounded())
    g.unpersist()
    return out


def _published(rounds: int) -> str:
    sql = f"""with {_HOP}, deg as materialized (select id, count(s) as degree from v left join e on s = id group by id), c as materialized (select count(*)::double as n from v),
g1 as materialized (select e.d as id, sum(1.0 / c.n / deg.degree) as g from e join deg on deg.id = e.s, c group by e.d),
s1 as materialized (select v.id, 0.85 * coalesce(g, 0) + 0.15 / n as rank, 0.85 * coalesce(g, 0) + 0.15 / n - 1 / n as delta from v left join g1 using (id), c)"""
    keep = "abs(delta) > 0.01 * rank"
    for k in range(2, rounds + 1):
        p = k - 1
        alive = f"{keep}" if k == 2 else "active"
        sql += f""",
g{k} as materialized (select e.d as id, sum(delta / degree) as g from e join (select * from s{p} where {alive}) q on q.id = e.s join deg on deg.id = e.s group by e.d),
t{k} as materialized (select s{p}.id, s{p}.rank, 0.85 * coalesce(g, 0) as delta from s{p} left join g{k} using (id)),
s{k} as materialized (select id, case when {keep} then rank + delta else rank end as rank, delta, {keep} as active from t{k})"""
    return sql


@query(_published(3) + " select id, round(rank + 1e-10, 6) as rank from s3")
def prd_published_k3(spark, sf_dir):
    g = part_hop(spark, sf_dir)
    out = ops.page_rank_delta(g, 3, "published").select("id", _rounded())
    g.unpersist()
    return out


@query(_published(1) + " select id, round(rank + 1e-10, 6) as rank from s1 order by 2 desc, id limit 20")
def top_rank(spark, sf_dir):
    g = part_hop(spark, sf_dir)
    ranks = ops.page_rank_delta(g, 1, "published").select("id", _rounded())
    g.unpersist()
    return ops.top_ranked(ranks, 20)


_EDGES = f"with {_HOP} select s as src, d as dst from e"


def _scratch(spark, name: str) -> str:
    import uuid

    at = base(spark)
    path = f"{at if '://' in at else 'file://' + at}/skein/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    forget_at_exit(spark, path)
    return path


def _round_trip(spark, sf_dir, name, write, read):
    path = f"{_scratch(spark, 'graph')}/{name}"
    write(part_hop(spark, sf_dir), path)
    return read(spark, path).edges


@query(_EDGES)
def adjacency_text_roundtrip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "g.adj", write_adjacency, read_adjacency)


@query(_EDGES)
def binary_roundtrip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "g.csr", write_binary, read_binary)


@query(_EDGES)
def parquet_roundtrip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "g", write_graph, read_graph)


@query(_EDGES)
def parse_text_to_parquet(spark, sf_dir):
    return _round_trip(spark, sf_dir, "g.adj", write_adjacency, lambda s, path: convert(s, path, path + ".parquet"))


@query("select n_regionkey::bigint as src, ((select count(*) from region) + n_nationkey)::bigint as dst from nation")
def graph_from_adjacency(spark, sf_dir):
    regions = _table(spark, sf_dir, "region").count()
    rows = _table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").collect()  # 25 rows at every scale
    lists = [[] for _ in range(regions + len(rows))]
    for r in rows:
        lists[r.n_regionkey].append(regions + r.n_nationkey)
    return Graph.from_adjacency(spark, lists).edges


@query(f"with {_HOP} select * from (values ('sparse', (select count(*) from v where id % 7 = 0)), ('dense', (select count(*) from v where id % 3 = 0)), ('default', 0::bigint)) t(kind, members)")
def subset_trusted_counts(spark, sf_dir):
    """Counts that are given are not counted again."""
    g = part_hop(spark, sf_dir)
    n = g.num_nodes
    sparse = NodeSubset.sparse(spark, n, g.vertices.where("id % 7 = 0"), count=-(-n // 7))
    dense = NodeSubset.dense(spark, n, g.vertices.select("id", (F.col("id") % 3 == 0).alias("active")), count=-(-n // 3))
    made = {"sparse": sparse, "dense": dense, "default": NodeSubset.empty(spark)}
    return spark.createDataFrame([(k, s.subset_count) for k, s in made.items()], "kind string, members long")


@query(f"with {_HOP}, s as (select id, row_number() over (order by id) - 1 as place from v where id % 7 = 0) select place, id from s where place in (0, 1, 20)")
def subset_node_at(spark, sf_dir):
    seeds = _seeds(part_hop(spark, sf_dir))
    return spark.createDataFrame([(i, seeds.node(i)) for i in (0, 1, 20)], "place long, id long")


@query(f"with {_HOP} select row_number() over (order by id) - 1 as place, id from v where id % 7 = 0")
def subset_iterate(spark, sf_dir):
    return spark.createDataFrame([*enumerate(_seeds(part_hop(spark, sf_dir)))], "place long, id long")


def _command(spark, graph: Graph, verb: str, *flags: str) -> DataFrame:
    """What a command of the command line saves for a stored graph."""
    path = _scratch(spark, "command")
    write_graph(graph, f"{path}/graph")
    cli.main([verb, f"{path}/graph", "--save", f"{path}/out", *flags])
    return spark.read.parquet(f"{path}/out")


@query(f"with recursive {_SYM}, {_LABELS} select id, label from l")
def command_cc_symmetrize(spark, sf_dir):
    return _command(spark, cust_part(spark, sf_dir), "cc", "--symmetrize")


@query(f"with recursive {_HOP}, {_LEVELS} select v.id, dd.dep::int as depth from v left join dd on dd.id = v.id")
def command_bfs(spark, sf_dir):
    g = part_hop(spark, sf_dir)
    return _command(spark, g, "bfs", "-s", str(_root(g))).select("id", "depth")


@query(_published(2) + " select id, round(rank + 1e-10, 6) as rank from s2")
def command_prd(spark, sf_dir):
    return _command(spark, part_hop(spark, sf_dir), "prd", "-i", "2", "--mode", "published").select("id", _rounded())


# --- The same on all of lineitem: few targets with very many edges each.

@query(f"with {_SUPP} select id, count(s) as degree from v left join e on s = id group by id")
def whole_out_degrees(spark, sf_dir):
    return part_supp(spark, sf_dir).out_degrees()


@query(f"with {_SUPP} select id, count(s)::bigint as value from v left join e on d = id group by id")
def whole_relationship_map(spark, sf_dir):
    g = part_supp(spark, sf_dir)
    state = g.vertices.withColumn("value", F.lit(0).cast("long"))
    mapper = EdgeMapper(message=lambda: F.lit(1), combine=F.sum, apply=lambda: {"value": F.col("m")})
    out = ops.relationship_map(g, state, NodeSubset.full(spark, g.num_nodes), mapper)[0]
    g.unpersist()
    return out


@query(f"with {_SUPP}, r as (select min(s) as r from e), x as (select distinct d from e, r where s = r) select id, case when id = r or id in (select d from x) then r end as parent from v, r")
def whole_bfs_parents(spark, sf_dir):
    """Edges lead from parts to suppliers: a root reaches its own suppliers only."""
    g = part_supp(spark, sf_dir)
    out = ops.bfs(g, _root(g)).select("id", "parent")
    g.unpersist()
    return out


@query(f"with {_SUPP} select id, least(id, coalesce(min(s), id)) as label from v left join e on d = id group by id")
def whole_cc_directed(spark, sf_dir):
    g = part_supp(spark, sf_dir)
    out = ops.connected_components(g)
    g.unpersist()
    return out


@query(_REFERENCE.replace(_HOP, _SUPP))
def whole_prd_reference(spark, sf_dir):
    g = part_supp(spark, sf_dir)
    out = ops.page_rank_delta(g, 10, "reference").select("id", _rounded())
    g.unpersist()
    return out
