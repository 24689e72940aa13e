"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 16 segments of 4 bits are mapped to their bit counts. A changed
bit moves one count by one, so the Manhattan distance of two count vectors never
exceeds the fingerprints' Hamming distance. Vectors within distance 2 have a
common grid point within 1 of either: every fingerprint is dealt to its own
cell and the up to 32 next to it, cells are joined, and the pairs that meet are
verified bit by bit. Equal fingerprints are one node from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
SEGMENTS, SEGMENT_BITS = 16, 4
#: Shingle hashes unpacked to bits at once.
_CHUNK = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of a whole text, repeats included.

    ASCII letters are lower-cased, words are cut at ASCII white space. Fewer words
    than a shingle make one shingle; null and wordless texts have none.
    """
    import xxhash

    words = text.encode("utf-8", "replace").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(line, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(sizes) - sizes
    end = (start + sizes - 1)[shingle - 1 :].tolist()
    return np.fromiter([digest(line[a:b], seed) for a, b in zip(start.tolist(), end)], np.uint64, len(end))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half of ``hashes``; 0 for none."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        bits = np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit fingerprint of a whole text: the majority of its shingles' XXH64 bits."""
    return majority(shingle_hashes(text, shingle, seed))


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, seed: int = SEED, drop=()) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long."""

    def start():
        def run(cols):
            made = np.array([fingerprint(t, shingle, seed) for t in shared.texts(cols[0])], np.uint64)
            return [pa.array(made.view(np.int64), pa.int64())]

        return run

    return shared.append_columns(docs, [text], "fp long", start, drop)


def _counts(fp):
    """The 16 bit counts of a fingerprint, 4 bits each, in one long."""
    ones = F.lit(0x1111111111111111)
    parts = [F.shiftrightunsigned(fp, i).bitwiseAND(ones) for i in range(SEGMENT_BITS)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def near_pairs(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), a < b, of distinct fingerprints ``fp`` within ``radius`` <= 2 bits."""
    if not 0 <= radius <= 2:
        raise ValueError("the grid covers radii 0 to 2")
    cell = _counts(F.col("fp"))
    near = [cell]
    for s in range(SEGMENTS):
        at = SEGMENT_BITS * s
        count = F.shiftrightunsigned(cell, at).bitwiseAND(F.lit(15))
        unit = F.lit(1 << at)
        near.append(F.when(count < SEGMENT_BITS, cell + unit))
        near.append(F.when(count > 0, cell - unit))
    dealt = fps.select("fp", F.explode(F.array_compact(F.array(*near))).alias("cell"))
    left = dealt.select(F.col("fp").alias("a"), "cell")
    right = dealt.select(F.col("fp").alias("b"), F.col("cell").alias("cell_b"))
    met = left.join(shared.by_shuffle(right), (F.col("cell") == F.col("cell_b")) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    return met.select("a", "b").distinct()


def cluster(prints: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """fp, component_id: the least id of each fingerprint's group.

    Groups are the components of links at ``radius`` bits or fewer; null ids can
    join texts but name a group only where all its ids are null.
    """
    groups = shared.materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprints")
    linked = components(near_pairs(groups.select("fp"), radius))
    linked = shared.materialize(linked, "fingerprint-components")
    owned = groups.join(shared.small(linked), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component_id", "fp").alias("c"))
    owned = shared.materialize(owned, "fingerprint-owners")
    named = owned.groupBy("c").agg(F.min("least").alias("component_id"), F.count("*").alias("n")).withColumnRenamed("c", "k")
    return shared.join_keys(owned, named, "c", owned.count())[0].select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """id, fp and component_id for each row; repeated rows are rows of their own."""
    prints = with_fingerprints(docs.select(F.col(id_col), F.col(text)), text, shingle, drop=[text])
    prints = shared.materialize(prints, "prints")
    groups = shared.materialize(cluster(prints, id_col, radius), "groups")
    return prints.join(shared.small(groups.withColumnRenamed("fp", "g")), F.col("fp") == F.col("g")).drop("g")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = near_duplicates(shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
