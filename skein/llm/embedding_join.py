"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine >= t lie within eps = sqrt(2 - 2t). Projection on the
leading principal directions never lengthens a distance, so grid cells of
width eps on those directions order the vectors such that close vectors are
close in the sequence; the sequence is cut in blocks. Intervals of blocks are
joined recursively, FAN parts at a step, as tables: two whose boxes are further apart
than eps in the projection are skipped, as no vector of one can be near one of the
other. Surviving block pairs are compared exactly in double precision. Equal vectors are one
representative with a weight from the start, and a block pair returns link counts
and a spanning forest of its links, never the links themselves. The driver holds a
row a range partition, never vectors, blocks or pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components

THRESHOLD = 0.9
#: Leading principal directions in the grid and vectors in a block.
GRID_DIMS, BLOCK = 4, 1024
#: Intervals that one interval is split into at a step of the recursion.
FAN = 8
#: Tables of up to this many rows, counted first, are broadcast.
BROADCAST_ROWS = 200_000
#: Slack on skipping, for rounding in the projection.
SLACK = 1e-6


def _usable(v: str):
    """True where a vector may link: no null, no non-finite component, not zero."""
    c = F.col(v)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(c.isNotNull() & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    flat = flat / np.abs(flat).max(1, keepdims=True)  # squares of very small or large components stay in range
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def principal(reps: DataFrame, dim: int, k: int) -> np.ndarray:
    """Leading ``k`` directions of the second-moment matrix over *all* vectors (dim x k)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean, n = np.zeros((dim, dim)), np.zeros(dim), 0
        for b in batches:
            x = _unit(b.column(0), dim)
            total, mean, n = total + x.T @ x, mean + x.sum(0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.concatenate([total.ravel(), mean]).tobytes()], pa.binary())], ["n", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim * dim + dim)
        for b in batches:
            for part, m in zip(b.column(0).to_pylist(), shared.texts(b.column(1))):
                n, total = n + part, total + np.frombuffer(m)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["n", "m"])

    # A matrix a task, summed in a tree: no task reads more than 16 of them, nor does the driver.
    sums = reps.select("v").mapInArrow(moments, "n long, m binary")
    parts = reps.rdd.getNumPartitions()
    while parts > 16:
        parts = -(-parts // 16)
        sums = sums.repartition(parts).mapInArrow(add, "n long, m binary")
    n, total = 0, np.zeros(dim * dim + dim)
    for row in sums.collect():
        n, total = n + row.n, total + np.frombuffer(row.m)
    mean = total[dim * dim :] / max(1, n)
    cov = total[: dim * dim].reshape(dim, dim) / max(1, n) - np.outer(mean, mean)
    return np.linalg.eigh(cov)[1][:, ::-1][:, : min(k, dim)]


def _box_columns(k: int) -> list[str]:
    return [f"{end}{d}" for d in range(k) for end in ("lo", "hi")]


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def block_pairs(boxes: DataFrame, n: int, k: int, eps: float, fan: int = FAN) -> DataFrame:
    """(i, j), i <= j: pairs of blocks that may hold vectors within ``eps``.

    ``boxes`` has a row for each of ``n`` blocks: its place ``b`` in the sequence and bounds lo0, hi0, ...
    in ``k`` dimensions. Intervals of fan ** level blocks are joined from the whole
    sequence down; the children of a pair that is too far apart are never made.
    """
    cols = _box_columns(k)
    levels, sizes = [boxes.select("b", *cols)], [n]
    while sizes[-1] > 1:
        fold = [(F.min if c.startswith("lo") else F.max)(c).alias(c) for c in cols]
        levels.append(levels[-1].groupBy((F.col("b") / fan).cast("long").alias("b")).agg(*fold))
        sizes.append(-(-sizes[-1] // fan))
    pairs = boxes.sparkSession.range(1).select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")) if n else boxes.sparkSession.createDataFrame([], "i long, j long")
    for level in range(len(levels) - 2, -1, -1):
        table, size = levels[level], sizes[level]
        left = _small(table.select(F.col("b").alias("i"), *[F.col(c).alias("x" + c) for c in cols]), size)
        right = _small(table.select(F.col("b").alias("j"), *[F.col(c).alias("y" + c) for c in cols]), size)
        children = lambda c: F.sequence(F.col(c) * fan, F.least(F.col(c) * fan + fan - 1, F.lit(size - 1).cast("long")))
        pairs = pairs.select(F.explode(children("i")).alias("i"), F.col("j").alias("p")).join(left, "i")
        pairs = pairs.select("i", *[c for c in left.columns if c != "i"], F.explode(children("p")).alias("j")).where("i <= j").join(right, "j")
        gaps = [F.greatest(F.lit(0.0), F.col(f"ylo{d}") - F.col(f"xhi{d}"), F.col(f"xlo{d}") - F.col(f"yhi{d}")) for d in range(k)]
        far = F.lit(0.0)
        for g in gaps:
            far = far + g * g
        pairs = pairs.where(far <= eps * eps).select("i", "j")
        if level and sizes[level] > 1000:  # spread what the next step splits
            pairs = pairs.repartition("i", "j")
    return pairs


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, as (row, column), of the bipartite links in ``near``."""
    out, rows_left = [], np.ones(len(near), bool)
    new_col = near.any(0)
    for r in np.flatnonzero(near.any(1)):
        if not rows_left[r]:
            continue
        rows_left[r] = False
        rows = [r]
        while rows:
            r0 = rows.pop()
            cols = np.flatnonzero(near[r0] & new_col)
            new_col[cols] = False
            for c in cols.tolist():
                out.append((int(r0), c))
                more = np.flatnonzero(near[:, c] & rows_left)
                rows_left[more] = False
                out += [(r1, c) for r1 in more.tolist()]
                rows += more.tolist()
    return out


#: Blocks compared with one block in one task row.
TILE = 32


def _links(todo: DataFrame, dim: int, threshold: float) -> DataFrame:
    """rep, n (weighted links to others), other (a tree link or null) over all block pairs.

    ``todo`` (i, js) has block files only; a task reads its blocks' files from the
    shared folder, one at a time.
    """

    def load(file: str):
        raw = shared.read_range(file)
        n = int.from_bytes(raw[:8], "little")
        x = np.frombuffer(raw, np.float64, offset=8 + 16 * n).reshape(n, dim)
        return np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n), x

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            ri, wi, x = load(row["i"])
            total, edges = np.zeros(len(ri)), []
            for file in row["js"]:
                same = file == row["i"]
                rj, wj, y = (ri, wi, x) if same else load(file)
                near = x @ y.T >= threshold
                if same:
                    np.fill_diagonal(near, False)
                if not near.any():
                    continue
                total += near @ wj.astype(np.float64)
                if not same:
                    right = near.T @ wi.astype(np.float64)
                    edges.append((rj, right, [None] * len(rj), right > 0))
                tree = _forest(near)
                edges.append((ri[[r for r, _ in tree]], np.zeros(len(tree)), rj[[c for _, c in tree]].tolist(), np.ones(len(tree), bool)))
            edges.append((ri, total, [None] * len(ri), total > 0))
            for rep, n, other, keep in edges:
                out = pa.RecordBatch.from_arrays([pa.array(rep), pa.array(n.astype(np.int64)), pa.array(other, pa.int64())], ["rep", "n", "other"])
                yield out.filter(pa.array(keep))

    return shared.map_arrow(todo, f, "rep long, n long, other long")


def _one_size(reps: DataFrame, dim: int, threshold: float, grid_dims: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(key, weight, least, rep) of the representatives of one dimension, and links among them; rep is a place in the sequence."""
    spark, eps = reps.sparkSession, math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    axes = principal(reps, dim, grid_dims)
    k = axes.shape[1]

    folder = shared.shared_path(spark, "vector-blocks")
    schema = "key string, weight long, least long, rep long, part int, n int, file string, " + ", ".join(f"{c} double" for c in _box_columns(k))
    names = shared.schema_of(schema).names

    def cells(cols):
        at = np.floor(_unit(cols[0], dim) @ axes / max(eps, 1e-3)).astype(np.int64) + (1 << 13)
        key = np.zeros(len(at), np.int64)
        for d in range(k):
            key = key << 14 | np.clip(at[:, d], 0, (1 << 14) - 1)
        return [pa.array(key)]

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: list = []

        def make(key, weight, least, x):
            nonlocal n
            for at in range(0, len(x), block):
                some, w = x[at : at + block], weight[at : at + block]
                m = len(some)
                # Dense in its block, block and range: no two vectors share a number.
                rep = (part << 42) + n * block + np.arange(m)
                p = some @ axes
                raw = b"".join((m.to_bytes(8, "little"), rep.tobytes(), w.tobytes(), some.tobytes()))
                file = shared.publish(folder, f"block-{part:06d}-{n:06d}.bin", lambda out, raw=raw: out.write(raw))
                first = np.arange(m) == 0  # a block's file and box stand in its first row
                box = [v for d in range(k) for v in (p[:, d].min(), p[:, d].max())]
                yield pa.RecordBatch.from_arrays(
                    [
                        key.slice(at, m), pa.array(w), pa.array(least[at : at + m]), pa.array(rep), pa.array(np.full(m, part, np.int32)), pa.array(np.full(m, n, np.int32)),
                        pa.array([file, *[None] * (m - 1)], pa.string()), *[pa.array(np.full(m, v), mask=~first) for v in box],
                    ],
                    names,
                )
                n += 1

        def whole(h):
            return pa.concat_arrays([p[0] for p in h]), *[np.concatenate([p[c] for p in h]) for c in (1, 2, 3)]

        for b in batches:
            held.append((b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy(), _unit(b.column(3), dim)))
            size = sum(len(h[0]) for h in held)
            if size >= block:
                full = size // block * block
                joined = whole(held)
                yield from make(*[w[:full] for w in joined])
                held = [tuple(w[full:] for w in joined)] if size > full else []
        if held:
            yield from make(*whole(held))

    keyed = shared.append_columns(reps.select("key", "weight", "least", "v"), ["v"], "cell long", lambda: cells)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "cell", "key").sortWithinPartitions("cell", "key").select("key", "weight", "least", "v")
    placed = shared.materialize(shared.map_arrow(ordered, to_blocks, schema), "vector-blocks-table")
    heads = placed.where("file is not null")
    # A row a range: where its blocks begin in the sequence.
    counts = {r.part: r.n for r in heads.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    begin = F.broadcast(spark.createDataFrame(starts, "p int, start long"))
    boxes = heads.join(begin, F.col("part") == F.col("p")).select((F.col("start") + F.col("n")).alias("b"), "file", *_box_columns(k))
    boxes = shared.materialize(boxes, "blocks")
    pairs = block_pairs(boxes, at, k, eps)
    # TILE blocks of the sequence meet one block in a row.
    file = boxes.select("b", "file")
    tiles = pairs.join(_small(file.withColumnRenamed("b", "j"), at), "j").groupBy("i", (F.col("j") / TILE).cast("long").alias("t")).agg(F.collect_list("file").alias("js"))
    todo = tiles.join(_small(file.withColumnRenamed("b", "i"), at), "i").select(F.col("file").alias("i"), F.array_sort("js").alias("js"), F.xxhash64("i", "t").alias("s"))
    todo = shared.materialize(todo, "block-pairs")
    n = todo.count()
    return placed.select("key", "weight", "least", "rep"), _links(todo.repartition(max(1, min(n, 8 * parts)), "s").select("i", "js"), dim, threshold)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, grid_dims: int = GRID_DIMS, block: int = BLOCK) -> DataFrame:
    """id, n_links, component_id and kept for each row.

    Null, zero and non-finite vectors, and vectors of different lengths, never
    link; they are components of their own. Equal vectors link with each other.
    Rows with equal ids are separate vectors of one component; null ids can't
    link and have a null component. An empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold is in (0, 1]")
    shared.ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    good = F.col("id").isNotNull() & _usable("v")
    # Equal vectors are one node. -0.0 is 0.0, so that the text of a vector is its identity.
    keyed = rows.select("id", F.when(good, F.transform("v", lambda x: x.cast("double") + F.lit(0.0))).alias("v"))
    keyed = keyed.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.to_json("v").cast("binary"), 256)))
    keyed = shared.materialize(keyed, "vectors")
    usable = keyed.where("key is not null")
    # Equal vectors are one representative; the ids of one that stand under several texts of a vector stay apart by key.
    groups = shared.materialize(usable.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("weight")), "vector-groups")
    one = usable.join(groups.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("id") == F.col("least"))).select("key", "least", "weight", "v").dropDuplicates(["key"])
    reps = shared.materialize(one.withColumn("dim", F.size("v")), "representatives")
    nodes = links = None
    for i, r in enumerate(sorted(reps.select("dim").distinct().collect(), key=lambda r: r.dim)):
        placed, found = _one_size(reps.where(F.col("dim") == r.dim), r.dim, threshold, grid_dims, block)
        shift = F.lit(i << 58)  # places of other dimensions
        placed = placed.withColumn("rep", F.col("rep") + shift)
        found = found.select((F.col("rep") + shift).alias("rep"), "n", (F.col("other") + shift).alias("other"))
        nodes, links = (placed, found) if nodes is None else (nodes.union(placed), links.union(found))
    if links is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    links = shared.materialize(links, "vector-links")
    counted = links.groupBy("rep").agg(F.sum("n").alias("n"))
    trees = links.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    # Different vectors under one id: chain each to the id's least key.
    shared_ids = usable.select("id", "key").distinct().groupBy("id").agg(F.min("key").alias("k0"), F.count("*").alias("m")).where("m > 1").select(F.col("id").alias("i"), "k0")
    twins = usable.select("id", "key").distinct().join(shared_ids, F.col("id") == F.col("i")).where("key <> k0").select("key", "k0")
    place = lambda key, name: nodes.select(F.col("key").alias(key), F.col("rep").alias(name))
    twins = twins.join(place("key", "a"), "key").join(place("k0", "b"), "k0").select("a", "b")
    linked = components(trees.union(twins)).withColumnsRenamed({"node": "rep", "component_id": "c"})
    owned = nodes.join(linked, "rep", "left").join(counted, "rep", "left").select("key", "weight", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("c", "rep").alias("c"))
    owned = shared.materialize(owned, "vector-owners")
    named = owned.groupBy("c").agg(F.min("least").alias("component_id"), F.count("*").alias("size")).withColumnsRenamed({"c": "k", "size": "n"})
    info = shared.join_keys(owned, named, "c", owned.count())[0].select(F.col("key").alias("k"), (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id")
    info = shared.materialize(info, "vector-components")
    for table in (groups, reps, links, owned):
        shared.release(table)
    out = keyed.select("id", "key").join(info, F.col("key") == F.col("k"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op8_embedding_join(spark, sf_dir: str) -> DataFrame:
    """Links, component and keeper of every embedding at cosine 0.9."""
    return near_duplicates(shared.table(spark, sf_dir, "embeddings"))


#: The links, and components as the least id reached by links, over all pairs of usable vectors.
ORACLE = """with recursive v as materialized (
  select vec_id, embedding::double[] as x from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
u as materialized (select vec_id, list_transform(x, lambda c: c / sqrt(list_dot_product(x, x))) as x from v),
l as materialized (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_dot_product(a.x, b.x) >= 0.9),
r(id, c) as (select a, a from l union select l.b, r.c from r join l on l.a = r.id where r.c < l.b),
g as (select id, min(c) as c from r group by id),
n as (select a, count(*) as n from l group by a)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(g.c, e.vec_id)::bigint as component_id, coalesce(g.c, e.vec_id) = e.vec_id as kept
from embeddings e left join g on g.id = e.vec_id left join n on n.a = e.vec_id"""
