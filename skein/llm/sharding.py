"""Sharding by balanced label propagation, in DataFrame operations only.

Rows with the same key are linked, and keys may be linked to other keys. Every
round counts the labels (shards) around each key, lets rows move to the label
most of their neighbours have, and admits movers only up to each shard's
quota: opposite flows are exchanged one for one, the rest must fit in the room that
is left. Then rows are laid along (label, key) and cut in equal shards, so the
`rows` law holds exactly: shard counts differ by one at most, and a key is cut only
where a shard ends or where it is larger than its shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

SHARDS, ROUNDS, SLACK = 8, 5, 0.05
#: Rows in a window of the final layout; keys of more rows are dealt over several.
UNIT = 4000


def _quotas(flows: dict[tuple[int, int, bool], int], sizes: dict[int, int], shards: int, slack: float) -> tuple[dict[tuple[int, int, bool], float], set[int]]:
    """Share of each flow (from, to, late) that is admitted, and the labels then full.

    Opposite flows are exchanged one for one, the rest fits in room; in both, rows of late
    flows come after all others. At most twice shards squared entries.
    """
    cap = sum(sizes.values()) / shards * (1 + slack)
    admitted = dict.fromkeys(flows, 0.0)

    def left(p):
        return flows.get(p, 0) - admitted.get(p, 0.0)

    for mine, theirs in ((False, False), (False, True), (True, True)):
        swaps = {p: min(left(p), left((p[1], p[0], theirs))) for p in flows if p[2] == mine}
        for (a, b, _), n in swaps.items():
            if n:
                admitted[a, b, mine] += n
                if mine != theirs:
                    admitted[b, a, theirs] += n
    full = set()
    for to in range(shards):
        room = max(0.0, cap - sizes.get(to, 0))
        for late in (False, True):
            wants = {p: left(p) for p in flows if p[1] == to and p[2] == late}
            total = sum(wants.values())
            for p, n in wants.items():
                admitted[p] += n * min(1.0, room / total) if total else 0
            room = max(0.0, room - total)
        if not room:
            full.add(to)
    return {p: admitted[p] / n for p, n in flows.items() if n}, full


def propagate(rows: DataFrame, key: list[str], id_col: str, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK, links: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``label`` in 0..shards-1 after ``rounds`` of label propagation.

    ``links`` (a, b: key hashes as made by xxhash64 of the key columns) ties keys to
    each other. Keys of at most a tenth of a shard move whole; larger ones row by row,
    so that a key too large for any shard fills what room there is. Keys larger than a
    shard's room (``slack``) are admitted after all others, and others wish for their best
    label that was not full in the round before; where all of a cut key's are full, for
    any that was not.
    """
    k = F.xxhash64(*key)
    state = shared.materialize(rows.withColumn("_k", k).withColumn("label", F.pmod(F.xxhash64(F.lit(1), id_col, *key), F.lit(shards)).cast("int")), "labels")
    full: set[int] = set()
    total = 0
    for r in range(rounds):
        cells = state.groupBy("_k", "label").agg(F.count("*").alias("n"))
        if links is not None:
            both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b")
            near = both.join(cells, both.b == cells._k).select(F.col("a").alias("_k"), "label", "n")
            cells = cells.union(near).groupBy("_k", "label").agg(F.sum("n").alias("n"))
        # The most frequent label; ties by a hash, so that they don't all go to one shard.
        rank = F.struct("n", F.xxhash64("_k", "label"), "label")
        free = F.when(~F.col("label").isin(sorted(full)), rank)
        best = cells.groupBy("_k").agg(F.max(rank).alias("top"), F.max(free).alias("free"), F.count("*").alias("cells"), F.sum("n").alias("size")).where("size > 1")
        want = F.col("top.label")
        if full:
            open_ = [s for s in range(shards) if s not in full]
            other = F.lit(None).cast("int")
            if open_ and links is None:  # linked keys would be dealt apart
                other = F.when(F.col("cells") > 1, F.element_at(F.array(*map(F.lit, open_)), (F.pmod(F.xxhash64(F.lit(r), "_k"), F.lit(len(open_))) + 1).cast("int")))
            want = F.when(F.col("size") <= slack * total / shards, F.coalesce("free.label", other, "top.label")).otherwise(want)
        best = best.select(F.col("_k").alias("_b"), want.alias("want"), "size")
        best = shared.materialize(best, "wishes")  # so that the join below has exchanges that can be split where a key is hot
        moves = state.join(best, F.col("_k") == F.col("_b"), "left").drop("_b")
        moves = shared.materialize(moves.withColumn("want", F.coalesce("want", "label")).withColumn("size", F.coalesce("size", F.lit(0))), "moves")
        total = total or moves.count()
        late = F.col("size") > slack * total / shards
        counted = moves.groupBy("label", "want", late.alias("late")).agg(F.count("*").alias("n")).collect()  # twice shards squared rows
        sizes: dict[int, int] = {}
        for c in counted:
            sizes[c.label] = sizes.get(c.label, 0) + c.n
        flows = {(c.label, c.want, c.late): c.n for c in counted if c.label != c.want}
        before = full
        share, full = _quotas(flows, sizes, shards, slack)
        if not flows or not any(share.values()) and full == before:  # no move is admitted, and wishes stay: further rounds would change nothing
            shared.release(state)
            state = moves.drop("want", "size")
            break
        # At most twice shards squared entries, as an expression: no join.
        table = F.create_map(*[F.lit(x) for (a, b, c), f in sorted(share.items()) for x in ((a * shards + b) * 2 + c, float(f))])
        small = F.col("size") <= total / shards / 10
        u = F.pmod(F.when(small, F.xxhash64(F.lit(r), "_k")).otherwise(F.xxhash64(F.lit(r), "_k", id_col)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        part = F.coalesce(F.try_element_at(table, (F.col("label") * shards + F.col("want")) * 2 + late.cast("int")), F.lit(0.0))
        step = moves.withColumn("label", F.when(u < part, F.col("want")).otherwise(F.col("label")))
        step = shared.materialize(step.drop("want", "size"), "labels")
        shared.release(state)
        shared.release(moves)
        state = step
    return state


def lay(rows: DataFrame, key: list[str], id_col: str, shards: int = SHARDS) -> DataFrame:
    """``rows`` with shard and slot: equal cuts of the order (label, key, id).

    No window holds more than about UNIT rows whatever the keys: rows are counted by
    unit first, and only the units' counts are summed along the order.
    """
    total = rows.count()
    small = max(1, total // (shards * UNIT))
    big = rows.groupBy("_k").agg(F.count("*").alias("size")).where(F.col("size") > UNIT).select(F.col("_k").alias("_b"), "size")
    marked = rows.join(big, F.col("_k") == F.col("_b"), "left").drop("_b")
    hot = F.col("size").isNotNull()
    parts = F.ceil(F.col("size") / F.lit(UNIT))
    marked = marked.select(
        *rows.columns,
        F.pmod("_k", F.lit(small)).alias("_u0"),
        F.when(hot, F.col("_k")).otherwise(F.lit(-(1 << 63))).alias("_u1"),
        F.when(hot, F.pmod(F.xxhash64(id_col), parts)).otherwise(F.lit(0)).cast("long").alias("_u2"),
    )
    marked = shared.materialize(marked, "units")
    unit = ["label", "_u0", "_u1", "_u2"]
    counts = marked.groupBy(*unit).agg(F.count("*").alias("n"))
    starts, at = {}, 0
    for r in sorted(marked.groupBy("label").agg(F.count("*").alias("n")).collect(), key=lambda r: r.label):  # a row a shard
        starts[r.label], at = at, at + r.n
    begin = F.coalesce(*[F.when(F.col("label") == s, F.lit(v).cast("long")) for s, v in starts.items()], F.lit(0).cast("long")) if starts else F.lit(0).cast("long")
    inside = Window.partitionBy("label").orderBy("_u0", "_u1", "_u2")
    offsets = counts.withColumn("_at", begin + F.sum("n").over(inside) - F.col("n")).select(*[F.col(c).alias(f"_o{c}") for c in unit], "_at")
    joined = marked.join(offsets, [F.col(c) == F.col(f"_o{c}") for c in unit])
    order = Window.partitionBy(*unit).orderBy("_k", *key, F.col(id_col).asc_nulls_first())
    placed = joined.withColumn("_pos", F.col("_at") + F.row_number().over(order) - 1)
    n = max(1, total)
    placed = placed.withColumn("shard", F.expr(f"cast(_pos * {shards} div {n} as int)"))
    placed = placed.withColumn("slot", F.expr(f"_pos - (cast(shard as bigint) * {n} + {shards - 1}) div {shards}"))
    return placed.drop("_at", "_pos", *unit, *[f"_o{c}" for c in unit])


def shard(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK, links: DataFrame | None = None) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for each row.

    Null texts count as empty ones (size 1). Repeated rows and null ids are rows like
    any other. With fewer rows than shards some shards are empty; an empty table
    gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    light = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(body) + 1).cast("long").alias("size_bytes"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("_t"),
    )
    key = ["_t", "text_crc32", "size_bytes"]
    labelled = propagate(light, key, "_id", shards, rounds, slack, links)
    laid = lay(labelled, key, "_id", shards)
    return laid.select(
        F.col("_id").alias(id_col), F.col("size_bytes").alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of equal row counts, equal texts together."""
    return shard(shared.table(spark, sf_dir, "documents"))


def sharding_law(spark, sf_dir: str) -> DataFrame:
    """What the law says of every shard of op7, read from its result: rows, slots, and the texts they hold in all."""
    out = op7_sharding(spark, sf_dir)
    per = out.groupBy("shard").agg(F.count("*").alias("n_rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("n_slots"), F.sum("size").alias("bytes"))
    whole = Window.partitionBy(F.lit(0))  # a row a shard
    return per.select("shard", "n_rows", "first_slot", "last_slot", "n_slots", F.sum("bytes").over(whole).alias("all_bytes"), F.lit("rows").alias("law"))


#: Shard counts are the equal cuts of the row count, whatever rows a shard holds.
LAW = """with n as (select count(*) as n, sum(octet_length(encode(coalesce(text, ''))) + 1)::bigint as b from documents)
select s::int as shard, ((s + 1) * n + 7) // 8 - (s * n + 7) // 8 as n_rows, 0::bigint as first_slot,
  ((s + 1) * n + 7) // 8 - (s * n + 7) // 8 - 1 as last_slot, ((s + 1) * n + 7) // 8 - (s * n + 7) // 8 as n_slots, b as all_bytes, 'rows' as law
from range(8) t(s), n where ((s + 1) * n + 7) // 8 > (s * n + 7) // 8"""
