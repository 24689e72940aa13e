"""Benchmark decontamination with an FM-index per training shard.

Words of a shard become symbols of the phrases' vocabulary; stretches with other
words can hold no phrase and are cut out first (this loses no occurrence). The
rest is indexed: suffix order by prefix doubling, Burrows-Wheeler transform in
a wavelet matrix, every eighth suffix position sampled. All phrases are searched
backwards at once, and each occurrence is located by walking to a sampled suffix.
"""

from __future__ import annotations

import hashlib
import pickle
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared

WINDOW = 8
#: Words indexed together, and the share of suffixes whose position is kept.
SHARD_WORDS, SAMPLE = 1_500_000, 8
#: Phrases up to this many bytes travel with the task; more are read block by block.
PHRASE_BYTES = 8 << 20
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words: runs of digits, letters and non-ASCII characters."""
    return [] if not text else text.encode("utf-8", "replace").translate(_WORD).split()


class WaveletMatrix:
    """rank and access over a symbol array, all queries of a call at once."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.words, self.ranks, self.zeros = [], [], []
        s = s.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            bit = (s >> b & 1).astype(np.uint8)
            w = np.zeros(len(s) // 64 * 8 + 8, np.uint8)
            packed = np.packbits(bit, bitorder="little")
            w[: len(packed)] = packed
            w = w.view(np.uint64)
            self.words.append(w)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(w), dtype=np.int64)]))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[level][i >> 6] + np.bitwise_count(self.words[level][i >> 6] & below).astype(np.int64)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol ``c`` is among the first ``i``."""
        lo, hi = np.zeros_like(i), i
        for level in range(self.bits):
            one = (c >> (self.bits - 1 - level) & 1).astype(bool)
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + b, hi - b)
        return hi - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for level in range(self.bits):
            a = self._ones(level, i)
            one = (self.words[level][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            c = c << 1 | one
            i = np.where(one, self.zeros[level] + a, i - a)
        return c


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s``, whose last symbol is least and unique."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k = min(2 * k, n - 1)


class FMIndex:
    """Index of symbols >= 1; 1 never occurs in a pattern, 0 ends the text."""

    def __init__(self, s: np.ndarray, sigma: int):
        s = np.concatenate([s, [0]])
        sa = suffix_array(s)
        self.n = len(s)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        self.bwt = WaveletMatrix(s[sa - 1], sigma)
        self.kept = sa % SAMPLE == 0
        self.kept[sa == 0] = True
        self.slot = np.cumsum(self.kept) - 1
        self.samples = sa[self.kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of right-aligned ``patterns``, one a row."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(patterns.shape[1]):
            on = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(on):
                break
            c = patterns[on, -1 - step]
            lo[on] = self.first[c] + self.bwt.rank(c, lo[on])
            hi[on] = self.first[c] + self.bwt.rank(c, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ``rows``."""
        out, rows, steps = np.zeros(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        on = np.arange(len(rows))
        while len(on):
            done = self.kept[rows[on]]
            hit = on[done]
            out[hit] = self.samples[self.slot[rows[hit]]] + steps[hit]
            on = on[~done]
            c = self.bwt.access(rows[on])
            rows[on] = self.first[c] + self.bwt.rank(c, rows[on])
            steps[on] += 1
        return out


class Phrases:
    """Windows of benchmark items: distinct patterns and the items of each."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        vocabulary: dict[bytes, int] = {}
        patterns: dict[tuple, set] = {}
        for item, text in items:
            w = [vocabulary.setdefault(x, len(vocabulary) + 2) for x in words(text)]
            for i in range(max(len(w) - window + 1, min(1, len(w)))):
                patterns.setdefault(tuple(w[i : i + window]), set()).update([] if item is None else [str(item)])
        self.vocabulary, self.sigma = vocabulary, len(vocabulary) + 2
        self.lengths = np.array([len(p) for p in patterns], np.int64)
        self.patterns = np.ones((len(patterns), window), np.int64)
        for i, p in enumerate(patterns):
            self.patterns[i, window - len(p) :] = p
        self.items = [sorted(v) for v in patterns.values()]
        self.least = int(self.lengths.min()) if len(patterns) else 0

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, pattern) of each occurrence in ``codes`` (1: no phrase's word)."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.lengths) or not len(codes):
            return none
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (codes > 1).view(np.int8), [0]])))
        start, stop = edge[::2], edge[1::2]
        long = stop - start >= self.least
        start, stop = start[long], stop[long]
        if not len(start):
            return none
        size = stop - start + 1  # with the separator behind each stretch
        place = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        text = codes[np.minimum(place, len(codes) - 1)]
        text[np.cumsum(size) - 1] = 1
        index = FMIndex(text, self.sigma)
        lo, hi = index.search(self.patterns, self.lengths)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return place[index.locate(rows)], which


def _shard(texts: list[str | None], blocks) -> list[tuple]:
    """(n_words, n_hit, items, spans) of each text of one shard."""
    split = [words(t) for t in texts]
    sizes = [len(w) for w in split]
    base = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])
    cover = np.zeros(int(base[-1]) + 1, np.int64)
    found: dict[int, set] = {}
    for phrases in blocks():
        get = phrases.vocabulary.get
        codes = np.ones(int(base[-1]), np.int64)
        for w, b in zip(split, base.tolist()):
            if w:
                codes[b : b + len(w)] = np.fromiter(map(get, w, repeat(1)), np.int64, len(w))
        at, which = phrases.occurrences(codes)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + phrases.lengths[which], -1)
        doc = np.searchsorted(base, at, "right") - 1
        for d, p in np.unique(np.stack([doc, which], 1), axis=0).tolist() if len(at) else ():
            found.setdefault(d, set()).update(phrases.items[p])
    hit = (np.cumsum(cover) > 0)[:-1]
    out = []
    for i, (n, b) in enumerate(zip(sizes, base.tolist())):
        if i not in found:
            out.append((n, 0, [], []))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[b : b + n].view(np.int8), [0]]))).tolist()
        spans = [{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2])]
        out.append((n, sum(s["end"] - s["start"] for s in spans), sorted(found[i]), spans))
    return out


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, drop=(), phrase_bytes: int = PHRASE_BYTES, cut: str | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids and merged word spans [start, end).

    ``cut`` names a further column, the text without its hit words; it may be ``text`` itself, which it then replaces.
    Null and empty texts have no words and no hits; null, empty and wordless
    benchmark items match nothing; repeated items count once by item_id; items of null
    id hit words and are no item of a document. Benchmarks
    over ``phrase_bytes`` are written to the shared folder in blocks of that size and
    searched one after another, so neither driver nor task holds them whole.
    """
    spark = docs.sparkSession
    folder, small, block, held, files = None, [], [], 0, []
    for row in benchmark.select(item_id, item_text).toLocalIterator():
        block.append((row[0], row[1]))
        held += len((row[1] or "").encode("utf-8", "replace")) + 64
        if held >= phrase_bytes:
            folder = folder or shared.shared_path(spark, "phrases")
            files.append(shared.publish(folder, f"{len(files):06d}.pkl", lambda s, b=block: s.write(pickle.dumps(b))))
            block, held = [], 0
    small = block

    def start():
        last = Phrases(small, window)

        def blocks():
            for f in files:
                yield Phrases(pickle.loads(shared.read_range(f)), window)
            yield last

        def run(cols):
            from .encoding import groups

            got = [r for g in groups(shared.texts(cols[0]), SHARD_WORDS * 5) for r in _shard(g, blocks)]
            made = [
                pa.array([g[0] for g in got], pa.int64()),
                pa.array([g[1] for g in got], pa.int64()),
                pa.array([g[2] for g in got], pa.list_(pa.string())),
                pa.array([g[3] for g in got], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ]
            if cut:
                made.append(pa.array([cut_spans(t, g[3]) if g[3] else t for t, g in zip(shared.texts(cols[0]), got)], pa.string()))
            return made

        return run

    ddl = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>" + (f", `{cut}` string" if cut else "")
    return shared.append_columns(docs, [text], ddl, start, drop)


def cut_spans(text: str, spans: list) -> str:
    """``text`` without the words in ``spans``; what stands between words goes with them."""
    raw = text.encode("utf-8", "replace")
    plain = np.frombuffer(raw.translate(_WORD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], plain.view(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    out, at = [], 0
    for s in spans:
        out.append(raw[at : int(begin[s["start"]])])
        at = int(end[s["end"] - 1])
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words and items of the benchmark met in each document."""
    from pyspark.sql import functions as F

    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = search(docs, shared.table(spark, sf_dir, "benchmark"), drop=["text"])
    n_items = F.size("item_ids").cast("long")
    return found.select(
        "doc_id", "n_words", "n_hit", n_items.alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        (n_items >= 2).alias("contaminated"),
    )


#: Windows as joined words, looked up among all windows of the documents of that length; words hit are counted once.
ORACLE = r"""with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
i as (select item_id, least(8, len(w)) as n, unnest(range(1, greatest(len(w) - 7, 1) + 1)) as pos, w from b where len(w) > 0),
p as materialized (select distinct item_id, n, array_to_string(w[pos:pos + n - 1], ' ') as p from i),
m as (select distinct n from p),
x as (select r, n, unnest(range(1, len(w) - n + 2)) as pos, w from d, m where len(w) >= n),
h as materialized (select x.r, x.pos, p.n, p.item_id from x join p on p.n = x.n and p.p = array_to_string(x.w[x.pos:x.pos + x.n - 1], ' ')),
c as (select r, count(distinct pos + k) as n_hit from (select r, pos, unnest(range(0, n)) as k from h) group by r),
t as (select r, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct r, item_id::varchar as id from h where item_id is not null) group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit, coalesce(t.n_items, 0)::bigint as n_items,
  sha256(coalesce(t.ids, '')) as items_sha256, coalesce(t.n_items, 0) >= 2 as contaminated
from d left join c on c.r = d.r left join t on t.r = d.r"""
