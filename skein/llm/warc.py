"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id, written as one gzip member each, and files
roll by compressed size. Headers and digests are made anew from the payload. A
payload met before (same bytes, MIN_REVISIT or more) becomes a revisit of the
record with the least id. Files appear under their final names by rename only,
and the manifest lists those that count.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Payloads shorter than this are never deduplicated; a file rolls at this compressed size.
MIN_REVISIT, ROLL_BYTES = 100, 256 << 20
#: Every record's WARC-Date: output depends on the input alone.
DATE = "2000-01-01T00:00:00Z"
LEVEL = 5
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "part int, seq int, file string, bytes long, n_records long"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _uri(url: str | None) -> str:
    """A URL that fits in a header line; what doesn't is percent-encoded."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "") or "urn:none"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, number: int = 0) -> bytes:
    """One uncompressed WARC/1.1 record."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, f'{name}/{digest}/{number}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Page-ID: {name}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record."""

    def fields(head: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["Content-Length"])]
    if hashlib.sha256(block).hexdigest() != warc["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError(f"bad block digest in {warc['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def gzip_member(raw: bytes) -> bytes:
    """A gzip member without time or name, so equal records are equal bytes."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def revisits(pages: DataFrame, id_col: str, payload: str) -> DataFrame:
    """(id, digest, first): rows whose payload an earlier id has; payloads stay where they are."""
    light = pages.select(F.col(id_col).alias("id"), F.sha2(F.col(payload).cast("binary"), 256).alias("digest")).where(F.octet_length(payload) >= MIN_REVISIT)
    first = light.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    return light.join(first.select(F.col("digest").alias("d"), "first"), F.col("digest") == F.col("d")).select("id", "digest", "first")


def write(pages: DataFrame, out: str, id_col: str = "page_id", url: str = "url", payload: str = "html", partitions: int | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write all ``pages`` under ``out``; returns the manifest, a row a file.

    Null payloads are empty ones and null URLs ``urn:none``. Null ids sort first,
    and never are what others refer to. Rows with the same id and payload: the first
    is the response, the others revisit it. An empty table writes no file.
    """
    spark = pages.sparkSession
    shared.ship(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).alias("url"), F.col(payload).alias("payload"))
    marks = revisits(rows, "id", "payload")
    # A mark travels with its page to the same range: the payloads are shuffled once, and no join holds them.
    both = rows.select("id", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("first")).union(
        marks.distinct().select("id", F.lit(0), F.lit(None).cast("string"), "digest", "first")
    )
    ordered = both.repartitionByRange(n, "id").sortWithinPartitions("id", "kind", "url", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def members():
            now, known, number = object(), {}, 0
            for b in batches:
                for page, kind, link, body, first in zip(*(shared.texts(c) for c in b.columns)):
                    if page != now:
                        now, known, number = page, {}, 0
                    if kind == 0:
                        known[body] = first
                        continue
                    data = (body or "").encode("utf-8", "replace")
                    digest = hashlib.sha256(data).hexdigest()
                    refers = known.get(digest)
                    if refers is not None and refers == page:  # this row is the first itself; its repeats are not
                        known[digest], refers = (page, None), None
                    elif isinstance(refers, tuple):
                        refers = refers[0]
                    yield gzip_member(record(page, link, data, digest, refers, number))
                    number += 1

        source, seq = members(), 0
        item = next(source, None)
        while item is not None:
            size = count = 0

            def body(stream):
                nonlocal item, size, count
                while item is not None:
                    stream.write(item)
                    size, count = size + len(item), count + 1
                    item = next(source, None)
                    if size >= roll_bytes:
                        return

            file = shared.publish(out, f"part-{part:06d}-{seq:04d}.warc.gz", body)
            row = [part, seq, file, size, count]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names)
            seq += 1

    names = shared.schema_of(MANIFEST).names
    manifest = shared.materialize(ordered.mapInArrow(run, MANIFEST), "warc-manifest")
    shared.publish(out, "MANIFEST.tsv", lambda s: s.write("".join(f"{r.file}\t{r.bytes}\t{r.n_records}\n" for r in manifest.orderBy("part", "seq").collect()).encode()))
    return manifest


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Uncompressed gzip members of a stream, one at a time."""
    d, held, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(chunk)
        if not data:
            if held:
                raise ValueError("the last record is cut off")
            return
        held.append(d.decompress(data))
        rest = d.unused_data
        if d.eof:
            yield b"".join(held)
            d, held = zlib.decompressobj(31), []


def read(manifest: DataFrame) -> DataFrame:
    """Records of the archives, with digests checked against the bytes.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to; the size and
    digest of a revisit are those of the payload it stands for.
    """
    spark = manifest.sparkSession
    files = [(r.file, r.n_records) for r in manifest.select("file", "n_records").toLocalIterator()]  # a row a file
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = shared.schema_of(ddl).names
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            fsys, path = shared.filesystem(row["file"])
            with fsys.open_input_stream(path, compression=None) as stream:
                out, n = [], 0
                for raw in members(stream):
                    warc, http, payload = parse(raw)
                    digest, kind = warc["WARC-Payload-Digest"].removeprefix("sha256:"), warc["WARC-Type"]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"bad payload digest in {row['file']}")
                    page, refers = warc.get("X-Page-ID"), warc.get("X-Refers-To-Page-ID")
                    out.append((int(page) if page else None, warc["WARC-Target-URI"], int(http["Content-Length"]), digest, kind, int(refers) if refers else None))
                    n += 1
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                if n != row["n_records"]:
                    raise ValueError(f"{row['file']} has {n} records, not {row['n_records']}")

    if not files:
        return spark.createDataFrame([], ddl)
    return spark.createDataFrame(files, "file string, n_records long").repartition(len(files), "file").mapInArrow(run, ddl)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Archive all pages, then read the archives back."""
    pages = shared.table(spark, sf_dir, "pages")
    found = read(write(pages, shared.shared_path(spark, "warc")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
     d as (select page_id, octet_length(encode(h)) as payload_bytes, sha256(h) as payload_digest from p),
     f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by payload_digest)
select d.page_id, d.payload_bytes::bigint as payload_bytes, d.payload_digest,
       case when f.first is not null and f.first <> d.page_id then 'revisit' else 'response' end as record_type,
       case when f.first <> d.page_id then f.first end as refers_to,
       q.url
from d left join f on d.payload_digest = f.payload_digest and d.payload_bytes >= 100
join pages q on q.page_id = d.page_id
"""
