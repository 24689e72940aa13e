"""Packing along a space-filling curve.

A document's token counts are projected by hashing to a few dimensions, and the
point's place on a Hilbert curve is its key. Documents are range-sorted by key, in
ranges of like numbers of tokens, and laid end to end along the curve; a sequence is each
stretch of SEQUENCE tokens. Neighbours on the curve share sequences, and only the very last
sequence of the corpus is not full.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encoding, shared

SEQUENCE, END_ID = 4096, 2
#: Dimensions of the projection and bits of each on the curve.
DIMS, BITS = 4, 10
#: Bits of the id's hash that spread documents of one key over ranges.
SPREAD = 20
#: Points a range that its bounds are drawn from, by tokens.
POINTS = 64
#: The mean of a document's token directions seldom exceeds 1 / SCALE.
SCALE = 5.0


def signs(n: int, dims: int = DIMS) -> np.ndarray:
    """The hashed projection: a direction for each of ``n`` token ids, the same everywhere."""
    x = np.arange(n * dims, dtype=np.uint64).reshape(n, dims) + np.uint64(1)
    for mult, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(40)).astype(np.float32) / 2**23 - 1


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert curve keys of integer ``points`` (rows of n coordinates of ``bits`` bits)."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work, from the highest bit
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(flip, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def place(vectors: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
    """Grid points of projected documents: the mean direction of a text's tokens, whatever its length."""
    scaled = SCALE * vectors / np.maximum(1, n_tokens)[:, None]
    return np.clip((np.tanh(scaled) + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)


def project(ids: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Sums of the directions of each document's ids (none is empty), by dimension; a document's bits depend on it alone."""
    flat = np.concatenate(ids)
    starts = np.cumsum([0, *map(len, ids[:-1])])
    return np.stack([np.add.reduceat(np.take(t, flat), starts, dtype=np.float64) for t in table.T], 1)


def range_bounds(tokens: DataFrame, parts: int) -> list[int]:
    """Bounds of ``parts`` ranges of ``pos`` with like sums of ``n``, from about POINTS drawn documents a range.

    A document is drawn by its tokens, so a few long ones weigh what they hold. The
    bounds say which task lays a document, and nothing about the layout's order.
    """
    total = tokens.agg(F.sum("n")).first()[0]
    if not total or parts < 2:
        return []
    unit = total / (parts * POINTS)
    u = F.pmod(F.xxhash64("pos", "id", "n"), F.lit(1 << 30)) / float(1 << 30)
    drawn = tokens.where(u < F.col("n") / unit).groupBy("pos").agg(F.sum(F.greatest(F.lit(1.0), F.col("n") / unit)).alias("w"))
    points = sorted((r.pos, r.w) for r in drawn.collect())  # about POINTS a range
    weight = np.cumsum([w for _, w in points])
    at = np.searchsorted(weight, weight[-1] * np.arange(1, parts) / parts) if len(points) else []
    return [points[i][0] for i in np.unique(at)]


def range_of(pos, bounds: list[int]):
    """How many of the sorted ``bounds`` are at or below ``pos``, in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    fine = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    among = lambda values: F.size(F.filter(values, lambda b: b <= pos))
    full = among(F.array(*[F.lit(f[-1]) for f in fine]))
    rest = F.try_element_at(F.array(*[F.array(*map(F.lit, f)) for f in fine]), full + 1)
    return (F.least(full * step, F.lit(len(bounds))) + F.coalesce(F.when(rest.isNotNull(), among(rest)), F.lit(0))).cast("int")


def encoded(docs: DataFrame, tokenizer: str, id_col: str, text: str, end_id: int, keep: int = encoding.CACHE) -> DataFrame:
    """(key, id, n, ids): tokens of each document and its place on the curve."""
    shared.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding.encoder(tokenizer, keep)
        table = np.asfortranarray(signs(enc.tok.get_vocab_size()))
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            at = 0
            for group in encoding.groups(shared.texts(batch.column(1))):
                raw = [r + end for r in enc.encode(group)]
                sizes = [len(r) // enc.dtype.itemsize for r in raw]
                points = place(project([np.frombuffer(r, enc.dtype) for r in raw], table), np.array(sizes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hilbert(points)), batch.column(0).slice(at, len(raw)), pa.array(sizes, pa.int64()), pa.array([enc.dtype.itemsize] * len(raw), pa.int32()), pa.array(raw, pa.binary())],
                    ["key", "id", "n", "width", "ids"],
                )
                at += len(raw)

    return shared.map_arrow(rows, run, "key long, id long, n long, width int, ids binary", encoders=True)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False, partitions: int | None = None, keep: int = encoding.CACHE) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``with_ids`` adds the piece's ids; ``keep`` is how many encoded words a worker remembers. Null and empty texts are ``end_id`` alone.
    Equal keys are ordered by a hash of the id, by id (nulls first), then by ids, so repeated rows are
    laid side by side, each in its own piece. An empty table has no pieces.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The bounds of the ranges are drawn first: a written table is read twice, but texts are encoded once.
    tokens = shared.materialize(encoded(docs, tokenizer, id_col, text, end_id, keep), "encoded")
    pos = F.shiftleft("key", SPREAD).bitwiseOR(F.xxhash64("id").bitwiseAND(F.lit((1 << SPREAD) - 1)))
    bounds = range_bounds(tokens.select("id", "n", pos.alias("pos")), n)
    ordered = tokens.select("id", "n", "width", "ids", pos.alias("pos")).withColumn("part", range_of(F.col("pos"), bounds))
    ordered = ordered.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "pos", "id", "ids")

    # A row a range: the tokens before each range are known before any is laid.
    sums = {r.part: r.n for r in tokens.select("n", range_of(pos, bounds).alias("part")).groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sums):
        before[p] = total
        total += sums[p]
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            doc, size, width, ids, part = (batch.column(i) for i in range(5))
            out = []
            for d, n_ids, w, raw, p in zip(doc.to_pylist(), size.to_pylist(), width.to_pylist(), shared.texts(ids), part.to_pylist()):
                if p != now:  # another range begins
                    now, at = p, before[p]
                data = np.frombuffer(raw, f"<u{w}").astype("<u4")
                done = 0
                while done < n_ids:
                    seq, offset = divmod(at, sequence)
                    length = min(n_ids - done, sequence - offset)
                    piece = data[done : done + length]
                    out.append((d, done, length, zlib.crc32(piece.tobytes()), n_ids, seq, offset, *([piece.tolist()] if with_ids else [])))
                    done, at = done + length, at + length
            for i in range(0, len(out), 10_000):
                cols = list(zip(*out[i : i + 10_000]))
                arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(c, pa.list_(pa.int64())) for c in cols[7:]]
                yield pa.RecordBatch.from_arrays(arrays, names)

    ddl = fields + (", ids array<long>" if with_ids else "")
    names = shared.schema_of(ddl).names
    return shared.map_arrow(ordered.select("id", "n", "width", "ids", "part"), run, ddl)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 4096 tokens along the curve."""
    import public_tokenizers

    return pack(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
