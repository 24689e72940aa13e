"""Near copies by shingle similarity: the second link rule of the SimHash operator.

Two texts whose five-word shingle sets have a Jaccard similarity of 0.8 differ by
about ten bits of a 64-bit fingerprint (measured: 0 to 17), far beyond the two
bits that the segment-popcount grid covers. So the grid proposes the pairs it
can, bands of minwise hashes propose the others, and every proposed pair is
compared exactly. A cluster of up to TILE texts is compared whole, in one task row group.
A larger one is dealt to tiles, each with the same few pivots of the cluster: texts
near a pivot, or near each other in a tile, are linked after one copy of each text.
Only texts that share a band or fingerprint with a text of another group by then
are compared across tiles. A tile returns a spanning forest of its links, never the
links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, simhash
from .components import components
from .embedding_join import _forest

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 agrees on all ROWS hashes of some band with probability 0.994, one of 0.85 with 0.9998.
BANDS, ROWS = 22, 7
#: Texts of a cluster in a tile, and pivots of a larger cluster; a task row group holds two tiles, or one and the pivots.
TILE, PIVOTS = 512, 32
_CHUNK, _COLUMNS = 1 << 12, 1 << 12


def _multipliers(n: int) -> np.ndarray:
    """Odd multipliers of the minwise hashes, the same everywhere."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) | np.uint64(1)


def band_keys(hashes: np.ndarray, multipliers: np.ndarray) -> list[int]:
    """A key for each band of a text's minwise hashes (signed longs; none for a text without shingles)."""
    if not len(hashes):
        return []
    least = np.full(len(multipliers), np.iinfo(np.uint64).max)
    mixed = hashes ^ (hashes >> np.uint64(32))
    for i in range(0, len(mixed), _CHUNK):
        least = np.minimum(least, (mixed[i : i + _CHUNK, None] * multipliers).min(0))
    least ^= least >> np.uint64(29)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(31)
    return key.view(np.int64).tolist()


def links_within(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sorted hash sets with at least this similarity."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    shared_by = np.zeros((n, n))
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes.astype(np.int64))
    often = count > 1
    place = np.cumsum(often) - 1
    on = often[column]
    row, column = row[on], place[column[on]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(often.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [at, at + _COLUMNS])
        x = np.zeros((n, min(_COLUMNS, int(often.sum()) - at)), np.float32)
        x[row[a:b], column[a:b] - at] = 1
        shared_by += x @ x.T
    union = sizes[:, None] + sizes[None, :] - shared_by
    near = shared_by >= similarity * union - 1e-9
    np.fill_diagonal(near, False)
    return _forest(near)


def _prints(docs: DataFrame, id_col: str, text: str, shingle: int) -> DataFrame:
    """(id, m, fp, keys) of each row; m is the text's md5. Texts stay where they are."""
    rows = docs.select(F.col(id_col).alias("id"), F.md5(F.col(text).cast("binary")).alias("m"), F.col(text).alias("t"))

    def start():
        multipliers = _multipliers(BANDS * ROWS)

        def run(cols):
            fps, keys = [], []
            for t in shared.texts(cols[0]):
                h = simhash.shingle_hashes(t, shingle)
                fps.append(simhash.majority(h) if len(h) else None)
                keys.append(band_keys(h, multipliers))
            return [pa.array([f if f is None or f < 1 << 63 else f - (1 << 64) for f in fps], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]

        return run

    return shared.append_columns(rows, ["t"], "fp long, keys array<long>", start, drop=["t"])


def _buckets(nodes: DataFrame) -> DataFrame:
    """(node, key): texts with a key in common are to be compared. Keys are bands, fingerprints, and pairs of near fingerprints."""
    grid = simhash.near_pairs(nodes.select("fp").distinct())
    pair = F.xxhash64(F.lit("pair"), "a", "b")
    ends = grid.select(pair.alias("key"), F.explode(F.array("a", "b")).alias("f"))
    near = ends.join(shared.small(nodes.select("node", "fp")), F.col("f") == F.col("fp")).select("node", "key")
    bands = nodes.select("node", F.explode("keys").alias("key"))
    return bands.union(nodes.select("node", F.xxhash64(F.lit("print"), "fp").alias("key"))).union(near)


def _clusters(buckets: DataFrame) -> DataFrame:
    """(node, component_id) of the texts that a key proposes to compare."""
    first = buckets.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "k")
    met, keys = shared.join_keys(buckets, first, "key", buckets.count() // 2)
    out = components(met.select(F.col("node").alias("a"), F.col("least").alias("b")))
    shared.release(keys)
    return out


def _compare(dealt: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) among the texts of each cell; ``dealt`` has cell, node, t."""
    spark = dealt.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("cell", "node", "t").repartition(parts, "cell").sortWithinPartitions("cell", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes_, sets = None, [], []

        def done():
            tree = links_within(sets, similarity) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes_[i] for i, _ in tree], pa.int64()), pa.array([nodes_[j] for _, j in tree], pa.int64())], ["a", "b"])

        for batch in batches:
            for cell, node, t in zip(*(shared.texts(col) for col in batch.columns)):
                if cell != now:
                    if sets:
                        yield done()
                    now, nodes_, sets = cell, [], []
                if nodes_ and nodes_[-1] == node:  # a repeated row
                    continue
                nodes_.append(node)
                sets.append(np.unique(simhash.shingle_hashes(t, shingle)))
        if sets:
            yield done()

    return shared.materialize(shared.map_arrow(dealt, compare, "a long, b long"), "similar-links")


def _cell(*parts):
    return F.concat_ws("/", *[p.cast("string") for p in parts])


def _own(tiles, seed: int = 0):
    return F.pmod(F.xxhash64(F.lit(seed), "node"), tiles).cast("int")


def _first_links(held: DataFrame, placed: DataFrame) -> DataFrame:
    """(cell, node, t): whole clusters, and tiles of larger ones with the cluster's pivots in each."""
    pivots = placed.where("tiles > 1").groupBy("c", _own(F.lit(PIVOTS), 1).alias("slot")).agg(F.min("node").alias("pivot")).select("pivot")
    pivots = shared.materialize(pivots, "similar-pivots")
    marked = held.join(shared.small(pivots), F.col("node") == F.col("pivot"), "left")
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    at = F.when(F.col("pivot").isNotNull(), every).otherwise(F.array(_own(F.col("tiles"))))
    return marked.select("c", "node", "t", F.explode(at).alias("tile")).select(_cell(F.col("c"), F.col("tile")).alias("cell"), "node", "t")


def _open_texts(large: DataFrame, buckets: DataFrame, links: DataFrame) -> DataFrame | None:
    """Of the large clusters, the texts that meet a text of another group in a bucket, for :func:`_open_cells`; None if there are none.

    In a cluster the texts of its largest group are dealt to tiles of their own, which need not meet each
    other: only the remaining texts are compared with all. The work grows with the texts of other groups.
    """
    labels = components(links).withColumnsRenamed({"node": "x", "component_id": "label"})
    known = large.select("node", "c").join(shared.small(labels), F.col("node") == F.col("x"), "left").select("node", "c", F.coalesce("label", "node").alias("label"))
    known = shared.materialize(known, "similar-labels")
    met = buckets.join(shared.small(known.withColumnRenamed("node", "x")), F.col("node") == F.col("x")).select("key", "node", "c", "label")
    met = shared.materialize(met, "similar-met")
    mixed = met.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("n")).where("l0 <> l1").select(F.col("key").alias("k"), "n")
    among_others, keys = shared.join_keys(met, mixed, "key", met.count() // 2)
    open_ = shared.materialize(among_others.select("node", "c", "label").distinct(), "similar-open")
    for table in (met, keys):
        shared.release(table)
    if open_.isEmpty():
        return None
    sizes = open_.groupBy("c", "label").agg(F.count("*").alias("n"))
    most = sizes.groupBy("c").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    tiles = lambda n: F.ceil(n / F.lit(TILE)).cast("int")
    most = shared.materialize(most.select(F.col("c").alias("k"), F.col("top.label").alias("main"), tiles(F.col("top.n")).alias("mains"), tiles(F.col("all") - F.col("top.n")).alias("others")), "similar-main")
    placed = open_.join(shared.small(most), F.col("c") == F.col("k"))
    main = F.col("label") == F.col("main")
    own = F.when(main, _own(F.col("mains"))).otherwise(_own(F.col("others")))
    return placed.select("node", "c", main.alias("is_main"), own.alias("own"), "mains", "others")


def _open_cells():
    """All cells of a text of :func:`_open_texts`: hundreds in a large cluster, so they are made where its text is."""
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_main = F.transform(span("others"), lambda i: _cell(F.col("c"), F.lit("m"), i, F.col("own")))
    with_main = F.transform(span("mains"), lambda j: _cell(F.col("c"), F.lit("m"), F.col("own"), j))
    among = F.transform(F.filter(span("others"), lambda j: j != F.col("own")), lambda j: _cell(F.col("c"), F.lit("o"), F.least(F.col("own"), j), F.greatest(F.col("own"), j)))
    return F.when(F.col("is_main"), as_main).otherwise(F.concat(with_main, among))


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """id, m and group of each row: the md5 of its text (the empty one's for null), and a name that the texts of its group share.

    Only pairs compared exactly at ``similarity`` or more are links. Equal texts are one
    node; wordless ones have no links. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    prints = shared.materialize(_prints(docs, id_col, text, shingle), "shingle-keys")
    nodes = prints.where("fp is not null").groupBy("m").agg(F.min("id").alias("owner"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    # Numbered where they are written, so that no two texts share a number and all that follows is on whole numbers.
    nodes = shared.materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "similar-nodes")
    buckets = shared.materialize(_buckets(nodes), "similar-buckets")
    found = shared.materialize(_clusters(buckets).select("node", F.col("component_id").alias("c")), "similar-clusters")
    # Only clusters of several tiles need their size: at most one in TILE texts is such a row.
    big = found.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    big = shared.materialize(big.select(F.col("c").alias("k"), F.ceil(F.col("n") / F.lit(TILE)).cast("int").alias("tiles")), "similar-sizes")
    names = nodes.select("node", F.col("m").alias("md5"), "owner")
    named = names.join(shared.small(found.withColumnRenamed("node", "x")), F.col("x") == F.col("node"))
    sized = named.join(shared.small(big), F.col("c") == F.col("k"), "left")
    placed = shared.materialize(sized.select("c", F.coalesce("tiles", F.lit(1)).alias("tiles"), "node", "md5", "owner"), "similar-placed")
    # One row of each text: the one with its least id.
    texts = docs.select(F.col(id_col).alias("id"), F.md5(F.col(text).cast("binary")).alias("m"), F.col(text).alias("t"))
    same = (F.col("m") == F.col("md5")) & F.col("id").eqNullSafe(F.col("owner"))
    held = texts.join(shared.small(placed), same)
    large = not big.isEmpty()
    dealt = _first_links(held, placed) if large else held.select(F.col("c").alias("cell"), "node", "t")
    links = [_compare(dealt, shingle, similarity)]
    open_ = _open_texts(placed.where("tiles > 1"), buckets, links[0]) if large else None
    if open_ is not None:
        open_ = shared.materialize(open_.withColumnRenamed("node", "x"), "similar-open-texts")
        open_ = shared.materialize(names.join(shared.small(open_), F.col("x") == F.col("node")).drop("x"), "similar-open-names")
        again = texts.join(shared.small(open_), same)
        links.append(_compare(again.select(F.explode(_open_cells()).alias("cell"), "node", "t"), shingle, similarity))
    linked = components(links[0] if len(links) == 1 else links[0].union(links[1])).withColumnRenamed("node", "x")
    linked = names.join(shared.small(linked), F.col("x") == F.col("node")).select("md5", F.col("component_id").cast("string").alias("group"))
    linked = shared.materialize(linked, "similar-groups")
    for table in (nodes, buckets, found, big, placed, *links):
        shared.release(table)
    out = prints.select("id", F.coalesce("m", F.md5(F.lit("").cast("binary"))).alias("m")).join(shared.small(linked), F.col("m") == F.col("md5"), "left")
    return out.select("id", "m", F.coalesce("group", "m").alias("group"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each group: that of least id (nulls last), then of least md5; all columns as they are.

    Equal texts are a group (null counts as empty), as are the texts that links of
    :func:`groups` join. Of rows equal in id and text any one stays. An id that stands in
    several groups can stay in each.
    """
    units = groups(docs, id_col, text, shingle, similarity).groupBy("id", "m").agg(F.first("group").alias("group"), F.count("*").alias("n"))
    least = F.struct(F.isnull("id").alias("z"), "id", "m")
    kept = units.groupBy("group").agg(F.min(F.struct(least.alias("least"), "n")).alias("top"))
    kept = kept.select(F.col("top.least.id").alias("kept_id"), F.col("top.least.m").alias("kept_md5"), F.col("top.n").alias("kept_n"))
    units, kept = shared.materialize(units, "units"), shared.materialize(kept, "kept")
    same_unit = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("m") == F.col("kept_md5"))
    gone = units.join(shared.small(kept), same_unit, "left_anti").select(F.col("id").alias("x_id"), F.col("m").alias("x_md5"))
    repeated = kept.where("kept_n > 1").select(F.col("kept_id").alias("x_id"), F.col("kept_md5").alias("x_md5"))
    # What goes is far less than what stays, and is looked up without moving texts where its size allows.
    away = shared.materialize(gone.union(repeated), "gone")
    md5 = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    same = F.col(id_col).eqNullSafe(F.col("x_id")) & (md5 == F.col("x_md5"))
    out = docs.join(shared.small(away), same, "left_anti")
    shared.release(units)
    if repeated.isEmpty():
        return out
    # The few rows that are listed several times: their aggregate leaves one before the exchange.
    more = docs.join(shared.small(repeated), same, "left_semi").withColumn("_md5", md5)
    return out.union(more.dropDuplicates([id_col, "_md5"]).drop("_md5"))
