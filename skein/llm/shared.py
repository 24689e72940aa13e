"""Shared-folder and Arrow helpers used by the operators of this subpackage.

Everything that outlives a task goes to the folder named by
``spark.checkpoint.dir``: all executors and the driver see it, so a lost
executor costs a recomputed task and never a lost intermediate result.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import checkpoints
from ..session import ship

#: Bytes of an Arrow batch, unless the session says otherwise.
BATCH_BYTES = 4 << 20
#: Tables of up to this many rows, counted or bounded first, are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def shared_base(spark: SparkSession) -> str:
    """Folder that all executors share; one is set only where the cluster names none."""
    base = checkpoints.base(spark)
    if "://" not in base:
        base = f"file://{base}" if base.startswith("/") else base.replace("file:/", "file:///", 1)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; what is there when the application ends is deleted."""
    path = f"{shared_base(spark)}/skein/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    checkpoints.forget_at_exit(spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.mode("append").option("compression", "zstd").parquet(path)  # the folder is there
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a table made by :func:`materialize` that no later plan reads."""
    if path := getattr(df, "_skein_path", None):
        delete(df.sparkSession, path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df``, for a join by shuffle whatever the planner takes its size for.

    The planner reads the size from compressed files and doesn't see what explode makes of a row, so
    what it takes for a few MB to broadcast can fill the driver.
    """
    return df.hint("merge")


def small(df: DataFrame) -> DataFrame:
    """``df``, for a broadcast join if its counted size allows, else for one by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else by_shuffle(df)


def join_keys(rows: DataFrame, keys: DataFrame, on: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` joined to ``keys`` (k, n, ...) with no task of its own for a hot key; and a table to release later, if any.

    ``k`` is unique, ``n`` is the number of rows that have it (neither is kept) and ``most`` bounds the
    number of keys. Few keys are broadcast. Of many, those with more rows than a partition's even share are:
    they are fewer than the partitions, whatever the data. The others are joined by shuffle.
    """
    if most <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys.drop("n")), F.col(on) == F.col("k")).drop("k"), None
    keys = materialize(keys, "keys")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = (keys.agg(F.sum("n")).first()[0] or 0) / parts
    hot, others = keys.where(F.col("n") > share).drop("n"), keys.where(F.col("n") <= share).drop("n")
    met = rows.join(F.broadcast(hot), F.col(on) == F.col("k"))
    rest = rows.join(F.broadcast(hot.select("k")), F.col(on) == F.col("k"), "left_anti")
    return met.union(rest.join(by_shuffle(others), F.col(on) == F.col("k"))).drop("k"), keys


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str):
    """pyarrow file system and path of a shared URI; works in any Python worker."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def publish(uri: str, name: str, write: Callable) -> str:
    """Write ``uri/name`` under a temporary name, then rename it into place.

    A retried or speculative task writes the same bytes under another
    temporary name, so whichever rename comes last leaves a whole file.
    """
    fsys, base = filesystem(uri)
    fsys.create_dir(base, recursive=True)
    final = posixpath.join(base, name)
    temp = posixpath.join(base, f"_tmp-{uuid.uuid4().hex}-{name}")
    with fsys.open_output_stream(temp, compression=None) as out:  # never by the name's ending
        write(out)
    fsys.move(temp, final)
    return posixpath.join(uri, name)


def read_range(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    fsys, path = filesystem(uri)
    with fsys.open_input_file(path) as f:
        if offset:
            f.seek(offset)
        return f.read() if length is None else f.read(length)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def without(df: DataFrame, names) -> list[str]:
    """Columns of ``df`` that don't clash (in any case) with output ``names``."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def id_crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def tidy(encoders: bool = False) -> None:
    """Give a reused Python worker's free memory back; ``encoders``: keep its cached pieces."""
    import ctypes

    from . import encoding

    if not encoders:
        encoding.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of about BATCH_BYTES: long texts are many rows of memory. A limit the user has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864b", "64MB"):
        spark.conf.set(key, str(BATCH_BYTES))


def map_arrow(df: DataFrame, fn: Callable, schema, encoders: bool = False) -> DataFrame:
    """``df.mapInArrow`` over batches of bounded size, whose workers hold no more after a task than before it."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(encoders)
        try:
            yield from fn(batches)
        finally:
            tidy(encoders)

    return df.mapInArrow(run, schema)


def append_columns(df: DataFrame, inputs: list[str], ddl: str, fn: Callable, drop: list[str] = ()) -> DataFrame:
    """Append the columns that ``fn`` makes from ``inputs``, row by row in place.

    ``fn`` is called once a partition and returns a function from a
    RecordBatch of ``inputs`` to a list of Arrow arrays in ``ddl`` order. Input
    columns with an output's name are replaced; ``drop`` names inputs not kept.
    """
    ship(df.sparkSession)
    new = schema_of(ddl)
    kept = [c for c in without(df, new.names) if c not in drop]
    out_schema = T.StructType([df.schema[c] for c in kept] + list(new.fields))
    cols = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)]
    ins = [F.col(f"`{c}`").alias(f"i{i}") for i, c in enumerate(inputs)]
    n, width, names = len(kept), len(ins), out_schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = fn()
        for batch in batches:
            if batch.num_rows:
                made = f([batch.column(n + i) for i in range(width)])
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + list(made), names)

    return map_arrow(df.select(*cols, *ins), run, out_schema)


def texts(column: pa.Array) -> Iterator[str | None]:
    """Strings of an Arrow column, one at a time (no second copy of the batch)."""
    for v in column:
        yield v.as_py()
