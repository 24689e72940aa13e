"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows its
predecessor kept. Every stage but the last returns the columns of documents; its
result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontamination, language_id, packing, shared, similar, substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"
#: Encoded words a worker remembers while it packs: fewer than alone, beside what the stages before have left in memory.
KEEP = 400_000


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with another text and the length that goes with it; nulls stay null."""
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language isn't told: no letters, or a tie of two languages.

    The dictionaries are learned from the stage's own labelled rows. Without any labelled
    row nothing can be told and nothing is dropped.
    """
    shared.ship(spark)
    docs = docs.select(*COLUMNS)
    found = language_id.fit(docs)
    if not found:
        return docs
    kept = language_id.identify(docs, found).where(~F.col("rejected"))
    return kept.select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id in each group of near copies: five words, similarity 0.8."""
    shared.ship(spark)
    return similar.keep_first(docs.select(*COLUMNS))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages; a document that was nothing else goes, others stay."""
    shared.ship(spark)
    out = substring_dedup.remove(docs.select(*COLUMNS))
    gone = (F.col("n_removed") > 0) & (F.trim(F.col("text")) == "")
    out = out.where(~F.coalesce(gone, F.lit(False)))
    return _with_text(out, F.col("text"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with two benchmark items or more; cut the hit words from the others."""
    # Found and cut in one Python worker a task: workers of a second step would stay, and each load the tokenizer of the packing.
    found = decontamination.search(docs.select(*COLUMNS), shared.table(spark, sf_dir, "benchmark"), cut="text")
    found = found.where(F.size("item_ids") < 2)
    return _with_text(found, F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences along the curve."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER), keep=KEEP)


STAGES = [
    ("language_id", identify),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: No stage of this pipeline can be said in SQL; tests hold each to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
