"""Substring dedup by sliding sentence spans.

A text is cut in sentences (at . ! ? in all widths and line ends). In scripts written
without spaces each character counts as a word. Sentences of over MAX_WORDS
words are cut further where the words themselves say so, so that the same passage
is cut alike wherever it stands. From each piece on, the run of the next RUN
pieces, or more until it has MIN_WORDS words, is hashed, and so is the run back from each
piece, so that both ends of a passage are in runs that lie inside it; runs are joined over the
whole corpus, and the pieces of each run that is not its first occurrence are
removed. The first occurrence is the one with the least id (null ids last, each text
of theirs a document of its own), then the least place in its text. Texts are cut and
hashed once; only those with something to remove are cut again.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

RUN, MIN_WORDS, MAX_WORDS = 3, 20, 12
#: In a long sentence a piece has this many words or more, and ends at a word whose checksum the divisor divides.
LEAST_WORDS, DIVISOR = 4, 4
_SENTENCE = re.compile(r"[^.!?\n。！？．｡]*[.!?\n。！？．｡]+|[^.!?\n。！？．｡]+")
_WORD = re.compile(r"\S+")
#: Letters of scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana, Han.
_SOLID = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_ANY_SOLID, _SOLID_WORD = re.compile(f"[{_SOLID}]"), re.compile(f"[{_SOLID}]|[^\\s{_SOLID}]+")


def _cuts(words: list[str], max_words: int) -> list[int]:
    """Ends of the pieces of a long sentence."""
    out, last, before = [], 0, 0
    for i, w in enumerate(words, 1):
        crc = zlib.crc32(w.lower().encode("utf-8", "replace"))
        size = i - last
        if size >= max_words or size >= LEAST_WORDS and (crc ^ before >> 1) % DIVISOR == 0:
            out.append(i)
            last = i
        before = crc
    if last < len(words):
        out.append(len(words))
    return out


def pieces(text: str, max_words: int = MAX_WORDS) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each piece with words."""
    out = []
    word = _SOLID_WORD if not text.isascii() and _ANY_SOLID.search(text) else _WORD
    for m in _SENTENCE.finditer(text):
        words = m.group().split() if word is _WORD else word.findall(m.group())
        if len(words) > max_words:
            spots = [w.start() + m.start() for w in word.finditer(m.group())]
            first = 0
            for stop in _cuts(words, max_words):
                out.append((spots[first], spots[stop] if stop < len(words) else m.end(), words[first:stop]))
                first = stop
        elif words:
            out.append((m.start(), m.end(), words))
    return out


def run_hashes(parts: list, run: int = RUN, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first piece, piece after the last, 128-bit hash as two longs) of each run, in order; case and spacing don't count.

    Runs are the shortest ones from each piece on and back from each piece; one that is both comes once.
    """
    import xxhash

    n = len(parts)
    size = np.fromiter((len(p[2]) for p in parts), np.int64, n)
    words = np.concatenate([[0], np.cumsum(size)])
    begin = np.arange(n)
    end = np.maximum(begin + run, np.searchsorted(words, words[:-1] + min_words))
    stop = np.arange(1, n + 1)
    start = np.minimum(stop - run, np.searchsorted(words, words[1:] - min_words, "right") - 1)
    begin, end = np.concatenate([begin[end <= n], start[start >= 0]]), np.concatenate([end[end <= n], stop[start >= 0]])
    begin, end = np.divmod(np.unique(begin * (n + 1) + end), n + 1)
    if not len(begin):
        return begin, end, np.zeros((0, 2), np.int64)
    h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(" ".join(p[2]).lower().encode("utf-8", "replace")) for p in parts), "<u8").reshape(-1, 2)
    # A polynomial in an odd number: a run's sum is a difference of prefix sums, brought to its start by the inverse.
    power, back = (np.cumprod(np.full(n, m, np.uint64)) for m in (_BASE, _INVERSE))
    total = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(h * power[:, None], axis=0)])
    mixed = (total[end] - total[begin]) * back[begin][:, None] + (end - begin).astype(np.uint64)[:, None]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return begin, end, (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _unit(id_col: str, text: str):
    """Tells documents with a null id apart, by text; 0 for those with an id."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", run: int = RUN, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """(id, unit, h1, h2): each document's distinct runs. Null and short texts have none.

    A document with a run that its own text repeats has one more row, without a hash.
    """
    shared.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), _unit(id_col, text).alias("unit"), F.col(text).alias("text"))
    ids = rows.schema["id"].dataType.simpleString()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, found, repeats, held = [], [], [], 0
            for i, t in enumerate(shared.texts(batch.column(2))):
                if t:
                    every = run_hashes(pieces(t, max_words), run, min_words)[2]
                    h = np.unique(every, axis=0)
                    where.append(np.full(len(h), i))
                    found.append(h)
                    held += len(h)
                    if len(h) < len(every):
                        repeats.append(i)
                if held > 200_000 or i == batch.num_rows - 1:
                    if held:
                        h, none = np.concatenate(found), pa.nulls(len(repeats), pa.int64())
                        at = pa.array(np.concatenate([*where, np.array(repeats, np.int64)]))
                        hashes = [pa.concat_arrays([pa.array(h[:, c]), none]) for c in (0, 1)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *hashes], ["id", "unit", "h1", "h2"])
                    where, found, repeats, held = [], [], [], 0

    return shared.map_arrow(rows, f, f"id {ids}, unit long, h1 long, h2 long")


def remove(docs: DataFrame, id_col: str = "doc_id", text: str = "text", run: int = RUN, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with ``text`` less its repeated spans, n_removed and ``removed``.

    ``removed`` has the character ranges [start, end) cut from the old text. Within a
    text every repeat after the first goes. Rows with equal id count as one
    document in two parts: repeats between them stay. Rows with a null id are documents
    after all others, told apart by text; equal ones are cut alike. Null texts stay null. A
    run repeated in its own overlap (the same sentence many times) is cut down to
    its first occurrence too.
    """
    found = shared.materialize(spans(docs, id_col, text, run, min_words, max_words), "spans")
    runs = found.where("h1 is not null")
    first = runs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    first = first.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    met = runs.join(first, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    # Null ids come last: they never own a span while a row with an id has it.
    later = met.where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "unit", F.struct("h1", "h2").alias("span"))
    if not runs.where("id is null").isEmpty():
        # Spans of documents without ids only: the one of least unit keeps them.
        alone = met.where("first is null")
        owner = alone.groupBy("g1", "g2").agg(F.min("unit").alias("least")).withColumnsRenamed({"g1": "o1", "g2": "o2"})
        alone = alone.join(owner, (F.col("g1") == F.col("o1")) & (F.col("g2") == F.col("o2"))).where("unit <> least")
        later = later.union(alone.select("id", "unit", F.struct("h1", "h2").alias("span")))
    # A text with a repeat of its own is cut again too, even if it owns its spans.
    own = found.where("h1 is null").select("id", "unit", F.lit(None).cast("struct<h1:bigint,h2:bigint>").alias("span"))
    gone = later.union(own).groupBy("id", "unit").agg(F.collect_set("span").alias("gone")).select(F.col("id").alias("gone_id"), F.col("unit").alias("gone_unit"), "gone")
    gone = shared.materialize(gone, "repeated-spans")
    shared.release(found)
    held = shared.without(docs, ("gone", "gone_id", "gone_unit", "n_removed", "removed"))
    old = docs.select(*[F.col(f"`{c}`") for c in held])
    same = F.col(id_col).eqNullSafe(F.col("gone_id")) & (_unit(id_col, text) == F.col("gone_unit"))
    joined = old.join(gone, same, "left").drop("gone_id", "gone_unit")

    def start():
        def one(t, hashes):
            if hashes is None or not t:
                return t, []
            parts = pieces(t, max_words)
            begin, end, h = run_hashes(parts, run, min_words)
            known = {(x["h1"], x["h2"]) for x in hashes}
            cut, seen = np.zeros(len(parts), bool), set()
            for i, j, pair in zip(begin.tolist(), end.tolist(), map(tuple, h.tolist())):
                if pair in known or pair in seen:
                    cut[i:j] = True
                seen.add(pair)
            if not cut.any():
                return t, []
            edge = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]]))).tolist()
            ranges = [(parts[a][0], parts[b - 1][1]) for a, b in zip(edge[::2], edge[1::2])]
            kept, last = [], 0
            for a, b in ranges:
                kept.append(t[last:a])
                last = b
            return "".join([*kept, t[last:]]), ranges

        def call(cols):
            got = [one(t, g) for t, g in zip(shared.texts(cols[0]), map(lambda v: v.as_py(), cols[1]))]
            ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return [
                pa.array([g[0] for g in got], pa.string()),
                pa.array([len(g[1]) for g in got], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in g[1]] for g in got], ranges),
            ]

        return call

    ddl = f"`{text}` string, n_removed long, removed array<struct<start:long,end:long>>"
    return shared.append_columns(joined, [text, "gone"], ddl, start, drop=["gone"])


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its repeated passages removed."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove(docs)
    return out.select("doc_id", "text", "n_removed", "removed", (F.col("n_removed") > 0).alias("has_repeats"))
