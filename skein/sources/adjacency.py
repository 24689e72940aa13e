"""Adjacency text: a tag line, N, M, N offsets, M targets, separated by white space.

The file is cut in byte ranges. A first pass counts the numbers of each range by
their first bytes; a second one parses them once, with their positions, into a table in
the shared folder, from which all checks and the graph are read. Nothing depends on row
order and no task holds more than its range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import Rounds
from ..operators.graph import Graph, csr_degrees
from ..session import ship
from . import files
from .ordered import write_ordered

TAG = b"AdjacencyGraph\n"
RANGE = 32 << 20
_SEPARATORS = b" \t\r\n\x0b\x0c"
_DIGITS, _LONG = re.compile(rb"[0-9 \t\r\n\x0b\x0c]*").fullmatch, re.compile(rb"[0-9]{19}").search


def _header(path: str) -> tuple[int, int, int]:
    """(N, M, offset of the first number after them)."""
    head = files.read(path, 0, 256)
    if not head.startswith(TAG):
        got = head.split(b"\n", 1)[0][:40].decode("utf-8", "replace")
        raise ValueError(f"expected the tag line {TAG.decode().strip()!r}, found {got!r}")
    m = re.match(rb"[ \t]*(\d+)[^\n]*\n[ \t]*(\d+)[^\n]*(?:\n|$)", head[len(TAG) :])
    if not m:
        raise ValueError("the node or relationship count is not a number")
    n, rels = int(m[1]), int(m[2])
    if max(n, rels) >= 1 << 63:
        raise ValueError("counts must be below 2^63")
    return n, rels, len(TAG) + m.end()


def _text(path: str, start: int, end: int) -> bytes:
    """The numbers that begin in [start, end): one cut by the range's end is read on."""
    before = files.read(path, start - 1, 1)
    raw = files.read(path, start, end - start)
    if raw and raw[-1] not in _SEPARATORS:
        at = end
        while more := files.read(path, at, 64):
            cut = next((i for i, c in enumerate(more) if c in _SEPARATORS), len(more))
            raw += more[:cut]
            at += cut
            if cut < len(more):
                break
    if before and before[0] not in _SEPARATORS:  # the first number began in the range before
        cut = next((i for i, c in enumerate(raw) if c in _SEPARATORS), len(raw))
        raw = raw[cut:]
    return raw


def _count(raw: bytes) -> int:
    """Numbers in ``raw``, by their first bytes."""
    inside = ~np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(_SEPARATORS, np.uint8))
    return int(inside[:1].sum() + (inside[1:] & ~inside[:-1]).sum())


def _parse(raw: bytes) -> np.ndarray:
    """The numbers in ``raw``; ValueError for anything else, and past 2^63 - 1."""
    if not _DIGITS(raw) or _LONG(raw):
        for t in raw.split():
            if not t.isdigit() or int(t) >= 1 << 63:
                raise ValueError(f"{t[:40]!r} is not a number of 63 bits")
    return np.array(raw.split(), dtype="S").astype(np.int64)


def _numbers(spark: SparkSession, path: str, begin: int, step: int) -> DataFrame:
    """(pos, value): all numbers from byte ``begin`` on, by position."""
    ship(spark)
    parts = files.ranges(begin, files.size(path), step)
    if not parts:
        return spark.createDataFrame([], "pos long, value long")
    table = spark.createDataFrame(parts, "part long, a long, b long").repartition(len(parts), "part")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]]), pa.array([_count(_text(path, r["a"], r["b"]))])], ["part", "n"])

    sizes = {r.part: r.n for r in table.mapInArrow(count, "part long, n long").collect()}  # a row a range
    first, at = {}, 0
    for p in sorted(sizes):
        first[p], at = at, at + sizes[p]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                got = _parse(_text(path, r["a"], r["b"]))
                for i in range(0, len(got), 100_000):
                    some = got[i : i + 100_000]
                    at = first[r["part"]] + i
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(some))), pa.array(some)], ["pos", "value"])

    return table.mapInArrow(emit, "pos long, value long")


def read_adjacency(spark: SparkSession, path: str, step: int = RANGE) -> Graph:
    """The graph of an adjacency text file.

    ValueError: another tag, a count or number that is none, too few numbers,
    offsets that decrease or exceed M, targets out of 0..N-1. What follows the
    M-th target is ignored; the last line needs no line end; N may be 0.
    """
    n, m, begin = _header(path)
    numbers, _ = Rounds(spark, "adjacency").cut(_numbers(spark, path, begin, step))
    nodes = numbers.where(F.col("pos") < n).select(F.col("pos").alias("id"), F.col("value").alias("offset"))
    targets = numbers.where((F.col("pos") >= n) & (F.col("pos") < n + m)).select((F.col("pos") - n).alias("pos"), F.col("value").alias("dst"))
    pos, value = F.col("pos"), F.col("value")
    seen = numbers.agg(
        F.count("*").alias("n"), F.count_if((pos == 0) & (value != 0) & (pos < n)).alias("start"),
        F.count_if((pos >= n) & (pos < n + m) & (value >= n)).alias("targets"),
    ).first()
    if seen.n < n + m:
        raise ValueError(f"{n + m} numbers expected, {seen.n} found")
    if seen.start or not csr_degrees(nodes, m, n).where("degree < 0").isEmpty():
        raise ValueError("offsets must start at 0, never decrease and not exceed the relationship count")
    if seen.targets:
        raise ValueError(f"targets must be in 0..{n - 1}")
    return Graph.from_csr(nodes, targets, n, m)


def _lines(batch: pa.RecordBatch) -> bytes:
    return "".join(f"{v}\n" for v in batch.column(0).to_pylist()).encode()


def write_adjacency(graph: Graph, path: str) -> None:
    """Write adjacency text as one file, in parallel (for exchange and tests); executors must see ``path``."""
    head = TAG + f"{graph.num_nodes}\n{graph.num_rels}\n".encode()
    tables = [graph.csr().orderBy("id").select("offset"), graph.edges.orderBy("src", "dst").select("dst")]
    write_ordered(graph.spark, path, head, tables, _lines, RANGE)
