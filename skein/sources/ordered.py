"""One file from sorted tables, written in parallel.

Tasks write the bytes of their sorted partitions to part files beside the target; a row a part
(number, name, size) comes to the driver, which adds up where each begins. On a local or mounted
file system tasks then copy the parts to their places in one file, which is renamed to the target
when it is whole. Other file systems have no writes at a position: there the driver appends the parts,
a block at a time.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import files

BLOCK = 8 << 20


def _in_place(fsys: fs.FileSystem) -> bool:
    return fsys.type_name == "local"


def _write_parts(table: DataFrame, folder: str, encode: Callable[[pa.RecordBatch], bytes]) -> list[tuple[str, int]]:
    """(name, bytes) of the part files of ``table`` in its order; an attempt that fails leaves a file that no row names."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = TaskContext.get().partitionId(), 0
        name = f"{part:06d}-{uuid.uuid4().hex}"
        first = next(batches, None)
        if first is None:
            return
        fsys, p = files.resolve(f"{folder}/{name}")
        with fsys.open_output_stream(p, compression=None) as out:
            while first is not None:
                raw = encode(first)
                out.write(raw)
                size += len(raw)
                first = next(batches, None)
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "size": [size]})

    rows = table.mapInArrow(write, "part long, name string, size long").collect()  # a row a partition
    return [(r.name, r.size) for r in sorted(rows, key=lambda r: r.part)]


def _copy_parts(spark: SparkSession, folder: str, whole: str, places: list[tuple[str, int, int]], step: int) -> int:
    """Copy the parts of (name, place, bytes) into the file ``whole``, a range a row; the bytes that were copied."""
    rows = [(name, a, at + a, b - a) for name, at, size in places for _, a, b in files.ranges(0, size, step)]
    if not rows:
        return 0

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open(f"{folder}/{r['name']}", "rb") as part, open(whole, "r+b") as out:
                    part.seek(r["begin"])
                    out.seek(r["at"])
                    left = r["size"]
                    while left and (raw := part.read(min(BLOCK, left))):
                        out.write(raw)
                        left -= len(raw)
                yield pa.RecordBatch.from_pydict({"copied": [r["size"] - left]})

    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, name string, begin long, at long, size long")
    return table.repartition(len(rows), "k").mapInArrow(copy, "copied long").agg(F.sum("copied")).first()[0]


def write_ordered(spark: SparkSession, path: str, head: bytes, tables: list[DataFrame], encode: Callable[[pa.RecordBatch], bytes], step: int) -> None:
    """Write ``head`` and then the rows of the sorted ``tables`` by ``encode`` as the file ``path``.

    ``path`` is in a folder that the driver and all executors share. Copies are made in ranges of ``step`` bytes.
    """
    ship(spark)
    path = path if "://" in path else os.path.abspath(path)
    folder = f"{path}-{uuid.uuid4().hex}"
    fsys, p = files.resolve(path)
    _, at = files.resolve(folder)
    fsys.create_dir(at, recursive=False)
    try:
        places, end = [], len(head)
        for table in tables:
            for name, size in _write_parts(table, folder, encode):
                places.append((name, end, size))
                end += size
        if _in_place(fsys):
            with open(f"{at}/whole", "wb") as out:
                out.write(head)
                out.truncate(end)
            copied = _copy_parts(spark, at, f"{at}/whole", places, step)
            if copied != end - len(head):
                raise OSError(f"{end - len(head)} bytes to copy to {path}, {copied} copied")
            os.replace(f"{at}/whole", p)
        else:
            with fsys.open_output_stream(p, compression=None) as out:
                out.write(head)
                for name, _, _ in places:
                    with fsys.open_input_stream(f"{at}/{name}", compression=None) as part:
                        while raw := part.read(BLOCK):
                            out.write(raw)
    finally:
        with contextlib.suppress(OSError):  # a task that is being stopped may still write there
            fsys.delete_dir(at)
