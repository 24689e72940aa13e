"""Token ids as length-delimited binary records with a separate offset index.

File: records one after another, each
    length   u64   bytes of the payload
    mask     u32   masked crc32 of the 8 length bytes
    payload        flags u8 (1: id present, 2: 32-bit ids), id i64, token ids
    mask     u32   masked crc32 of the payload
all little-endian; the mask rotates the checksum right by 15 bits and adds a
constant, so that checksums of data holding checksums stay useful.
Index (``.idx``): per record (byte offset u64, token start in file u64,
payload length u64) for reads in any order. A manifest row a file commits it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encoding, shared

END_ID = 2
#: A file is closed at the first record that takes it over this size.
ROLL_BYTES = 128 << 20
_MASK_DELTA = 0xA282EAD8
_HEAD, _META, _U32 = struct.Struct("<Q"), struct.Struct("<Bq"), struct.Struct("<I")
MANIFEST = "part int, seq int, file string, bytes long, n_records long, n_tokens long, index_crc long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def index_row(offset: int, start: int, size: int) -> bytes:
    return struct.pack("<QQQ", offset, start, size)


def frame(payload: bytes) -> bytes:
    head = _HEAD.pack(len(payload))
    return b"".join((head, _U32.pack(masked(head)), payload, _U32.pack(masked(payload))))


def unframe(buf: bytes, at: int = 0) -> tuple[bytes, int]:
    """Payload at ``at`` and the offset after it; ValueError where a checksum differs."""
    head = buf[at : at + 8]
    if len(head) < 8 or _U32.unpack_from(buf, at + 8)[0] != masked(head):
        raise ValueError(f"bad record length at byte {at}")
    end = at + 12 + _HEAD.unpack(head)[0]
    payload = buf[at + 12 : end]
    if len(buf) < end + 4 or _U32.unpack_from(buf, end)[0] != masked(payload):
        raise ValueError(f"bad record at byte {at}")
    return payload, end + 4


def pack(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    return _META.pack((doc_id is not None) | (wide << 1), doc_id or 0) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = _META.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=_META.size)
    return (doc_id if flags & 1 else None), ids


def write(docs: DataFrame, tokenizer: str, out: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID, partitions: int | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Encode ``text`` and write record files under ``out`` in ascending id order.

    Returns the manifest, one row a file, in file order. Rows are range-sorted by
    id (nulls first; equal ids by text), encoded where they land, and streamed to
    files that roll by size. Null and empty texts become records of ``end_id`` alone.
    An empty table writes no file. Other columns are ignored.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoding.encoder(tokenizer)
        wide = enc.dtype.itemsize == 4
        end = np.array([end_id], enc.dtype).tobytes()

        def records():
            for batch in batches:
                ids, at = batch.column(0), 0
                for group in encoding.groups(shared.texts(batch.column(1))):
                    for raw in enc.encode(group):
                        yield ids[at].as_py(), raw + end
                        at += 1

        source, seq = records(), 0
        first = next(source, None)
        while first is not None:
            index, count = bytearray(), [0, 0, 0]  # bytes, records, tokens

            def body(stream, item=first):
                nonlocal first
                first = None
                while item is not None:
                    rec = frame(pack(item[0], item[1], wide))
                    index.extend(index_row(count[0], count[2], len(rec) - 16))
                    stream.write(rec)
                    count[0] += len(rec)
                    count[1] += 1
                    count[2] += len(item[1]) // enc.dtype.itemsize
                    item = next(source, None)
                    if count[0] >= roll_bytes:
                        first = item
                        return

            name = f"tokens-{part:06d}-{seq:04d}"
            file = shared.publish(out, name + ".rec", body)
            shared.publish(out, name + ".idx", lambda s, b=bytes(index): s.write(b))
            row = [part, seq, file, *count, zlib.crc32(index)]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4), strict=True)], names)
            seq += 1

    names = shared.schema_of(MANIFEST).names
    manifest = shared.materialize(shared.map_arrow(rows, run, MANIFEST, encoders=True), "tokens-manifest")
    return manifest.orderBy("part", "seq")


def read(manifest: DataFrame, batch_records: int = 4096) -> DataFrame:
    """Records of the manifest's files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all records before, in file order. Files are read
    in parallel, each by its index, with every checksum verified.
    """
    spark = manifest.sparkSession
    files = manifest.collect()  # a row a file of ROLL_BYTES, never a row a document
    starts, total = [], 0
    for f in files:
        starts.append((f.file, f.index_crc, total))
        total += f.n_tokens
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index = shared.read_range(row["file"].removesuffix(".rec") + ".idx")
                if zlib.crc32(index) != row["index_crc"]:
                    raise ValueError(f"bad index of {row['file']}")
                entries = np.frombuffer(index, "<u8").reshape(-1, 3)
                fsys, path = shared.filesystem(row["file"])
                with fsys.open_input_file(path) as stream:
                    for at in range(0, len(entries), batch_records):
                        some = entries[at : at + batch_records]
                        out = []
                        for _, start, size in some.tolist():
                            doc, ids = unpack(unframe(stream.read(size + 16))[0])
                            out.append((doc, row["start"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], ddl_names)

    ddl_names = shared.schema_of(ddl).names
    if not starts:
        return spark.createDataFrame([], ddl)
    table = spark.createDataFrame(starts, "file string, index_crc long, start long")
    return shared.map_arrow(table.repartition(len(starts), "file"), run, ddl)


def fetch(manifest: DataFrame, numbers: DataFrame, column: str = "number") -> DataFrame:
    """Records by their numbers in file order, in whatever order they are asked for: number, doc_id, ids.

    Each is found by its offset in the index, and only its bytes are read. A number asked
    for twice comes twice, a null one has null columns; one that no record has is a ValueError.
    """
    shared.ship(manifest.sparkSession)
    files = [(r.file, r.n_records, r.index_crc) for r in manifest.collect()]
    begin = np.cumsum([0, *[n for _, n, _ in files]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(0).to_pylist()
            known = [n for n in asked if n is not None]
            if known and not (0 <= min(known) and max(known) < begin[-1]):
                raise ValueError(f"record numbers are 0 to {begin[-1] - 1}")
            got: dict[int, tuple] = {}
            for f in np.unique(np.searchsorted(begin, known, "right") - 1).tolist():
                name, _, crc = files[f]
                index = shared.read_range(name.removesuffix(".rec") + ".idx")
                if zlib.crc32(index) != crc:
                    raise ValueError(f"bad index of {name}")
                entries = np.frombuffer(index, "<u8").reshape(-1, 3)
                fsys, path = shared.filesystem(name)
                with fsys.open_input_file(path) as stream:
                    for n in sorted({n for n in known if begin[f] <= n < begin[f + 1]}):
                        at, _, size = entries[n - int(begin[f])].tolist()
                        stream.seek(at)
                        doc, ids = unpack(unframe(stream.read(size + 16))[0])
                        got[n] = doc, ids.tolist()
            none = None, None
            rows = [got.get(n, none) for n in asked]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d for d, _ in rows], pa.int64()), pa.array([i for _, i in rows], pa.list_(pa.int64()))], ["number", "doc_id", "ids"])

    return shared.map_arrow(numbers.select(F.col(column).cast("long").alias("number")), run, "number long, doc_id long, ids array<long>")


def op2_token_records(spark, sf_dir: str) -> DataFrame:
    """Write all documents as token records, then read the files back."""
    import public_tokenizers

    docs = shared.table(spark, sf_dir, "documents")
    manifest = write(docs, public_tokenizers.path("byte_bpe_50k.json"), shared.shared_path(spark, "tokens"))
    return read(manifest)
