"""Language ID by compression: one zstandard raw-content dictionary a language.

A text is put in canonical form (lower case, letters only, single spaces) and
cut in blocks; each block is compressed against every language's dictionary.
The language with the fewest bytes over the *whole* text wins. A text whose
two best languages are nearly as short is rejected. Any number of languages can be
told apart: a block of dictionaries is held at a time.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bound of the fit: a dictionary is made of SLOTS labelled texts, each of them whole.
SLOTS = 64
#: Languages whose dictionaries are held at once, in tasks and on the driver; more are read block by block.
LANGUAGES = 64
#: Tables of up to this many rows, counted first, are broadcast.
BROADCAST_ROWS = 100_000
BLOCK = 4096
#: Margins (bytes, share of the shortest code) under which a text is rejected.
MIN_BYTES, MIN_SHARE = 1, 0.03
UNKNOWN = "und"

#: Ends every dictionary and begins every block: its match pays for zstandard's least gain, so that
#: short blocks are coded against the dictionary instead of being stored.
_PAD = bytes(range(1, 49))
_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def canonical(text: str) -> bytes:
    """Lower-cased UTF-8 words of a text, without ASCII digits and signs."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split())


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Dictionaries(dict):
    """The last block of dictionaries, and the files of those before it; languages in the order that settles ties."""

    def __init__(self, items=(), files: tuple[str, ...] = ()):
        super().__init__(items)
        self.files = tuple(files)

    def __reduce__(self):
        return Dictionaries, (dict(self), self.files)

    def blocks(self) -> Iterator[dict[str, bytes]]:
        for f in self.files:
            yield pickle.loads(shared.read_range(f))
        if self:
            yield dict(self)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Dictionaries:
    """Dictionaries from a bounded sample of ``labelled``.

    Each language's texts are dealt to ``SLOTS`` slots by their hash, and the text
    of the smallest hash in each slot is taken whole, so the sample is deterministic,
    ignores repeats and has ``SLOTS`` texts a language at most. Rows with null text or label, or
    without letters, teach nothing. No labelled rows: no dictionaries. Languages come in
    order of their rows, which settles ties; past ``LANGUAGES`` of them, full blocks go to the shared folder.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    least = rows.groupBy("lang", F.pmod("h", F.lit(SLOTS)).alias("slot")).agg(F.min("h").alias("h"), F.count("*").alias("n"))
    least = shared.materialize(least, "language-slots")
    size = least.groupBy("lang").agg(F.sum("n").alias("rows"))
    picked = least.join(size, "lang").select(F.col("lang").alias("l"), F.col("h").alias("k"), "rows")
    if least.count() <= BROADCAST_ROWS:
        picked = F.broadcast(picked)
    taken = rows.join(picked, (F.col("lang") == F.col("l")) & (F.col("h") == F.col("k")))
    taken = taken.groupBy("lang", "h", "rows").agg(F.max("text").alias("t")).orderBy(F.desc("rows"), "lang", "h")
    made, files, folder = {}, [], None
    for r in taken.toLocalIterator():  # a language after the other
        if r.lang not in made and len(made) == LANGUAGES:
            folder = folder or shared.shared_path(spark, "dictionaries")
            files.append(shared.publish(folder, f"{len(files):06d}.pkl", lambda s, m=made: s.write(pickle.dumps(m))))
            made = {}
        made[r.lang] = made.get(r.lang, b"") + canonical(r.t) + b" "
    shared.release(least)
    return Dictionaries(made, files)


class Coder:
    """Code lengths of a text under each dictionary; built once a worker task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        # A window that holds the whole dictionary: any passage of it can be matched.
        window = max(18, min(27, (max(map(len, dictionaries.values()), default=0) + 2 * BLOCK).bit_length()))
        params = z.ZstdCompressionParameters(
            window_log=window, chain_log=16, hash_log=17, search_log=3, min_match=4, target_length=8,
            strategy=z.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        self.langs = list(dictionaries)
        self.coders = [
            z.ZstdCompressor(dict_data=z.ZstdCompressionDict(dictionaries[k] + _PAD, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params).compress
            for k in self.langs
        ]

    def lengths(self, text: str) -> list[int]:
        code = canonical(text)
        blocks = [_PAD + code[i : i + BLOCK] for i in range(0, len(code), BLOCK)]
        return [sum(len(c(b)) for b in blocks) for c in self.coders]


def verdict(langs: list[str], sizes: list[int]) -> tuple[str, float, int, bool]:
    """(language, score 0..1, margin in bytes, rejected) from a text's code lengths; none: unknown."""
    if not sizes:
        return UNKNOWN, 0.0, 0, True
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    best = sizes[order[0]]
    margin = sizes[order[1]] - best if len(order) > 1 else best
    score = 1.0 / sum(math.exp(-min(700, (s - best) / 4.0)) for s in sizes)
    return langs[order[0]], score, margin, margin < max(MIN_BYTES, MIN_SHARE * best)


def identify(docs: DataFrame, dictionaries: Dictionaries, text: str = "text", drop=()) -> DataFrame:
    """``docs`` with lang_pred, score, margin and rejected; only ``text`` is read.

    Null, empty and letterless texts are ``und``, score 0, rejected. Ties go to
    the language with more labelled rows and are rejected. Without dictionaries all is ``und``.
    """

    def start():
        held = [Coder(b) for b in dictionaries.blocks()] if not dictionaries.files else None

        def run(cols):
            said = [t if has_letter(t) else None for t in shared.texts(cols[0])]
            langs, sizes = [], [[] for _ in said]
            for coder in held if held is not None else map(Coder, dictionaries.blocks()):
                langs += coder.langs
                for t, s in zip(said, sizes):
                    if t is not None:
                        s += coder.lengths(t)
            got = [verdict(langs, s) for s in sizes]
            return [
                pa.array([g[0] for g in got], pa.string()),
                pa.array([g[1] for g in got], pa.float64()),
                pa.array([g[2] for g in got], pa.int64()),
                pa.array([g[3] for g in got], pa.bool_()),
            ]

        return run

    return shared.append_columns(docs, [text], "lang_pred string, score double, margin long, rejected boolean", start, drop)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from crc32(doc_id) mod 4 != 2."""
    docs = shared.table(spark, sf_dir, "documents")
    held = shared.id_crc_mod(F.col("doc_id"), 4) == 2
    found = fit(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), found, drop=["text"])
