"""Quality by Bradley-Terry ranking: scores learned from preference pairs.

A pair says that one document is better than another; its probability is the
logistic function of the difference of their utilities, and a utility is linear
in whole-text features. The fit minimises the logistic loss over feature
differences. A quantile of the fitted utilities of all labelled documents, at the
share of bad labels, becomes the threshold, which scores map to THRESHOLD.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

THRESHOLD = 0.3
#: Bounds of the fit of weights: labelled rows a class, and preference pairs.
ROWS, PAIRS = 6000, 120_000
RIDGE, STEPS = 1e-3, 25

_LOWER = bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))
_END, _LINE, _PIPE, _BANG = b".?", b"\n", b"|", b"!"
_SIGNS = b"#$%&*+<=>@[]^_{}~\\/"
FEATURES = (
    "log_words", "distinct_words", "word_bytes", "lower", "upper", "digit", "high", "ends", "lines", "pipes", "bangs",
    "signs", "same_next", "top_word", "long_words", "short", "capitals", "distinct_pairs", "empty",
)


def features(text: str | None) -> list[float]:
    """Shares and counts over a whole text; null and empty texts have only ``empty``."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]

    def share(chars: bytes) -> float:
        return (size - len(raw.translate(None, chars))) / size

    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    same = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    return [
        math.log1p(n), len(counts) / n, size / n / 10, share(_LOWER), share(_UPPER), share(_DIGIT), share(_HIGH),
        share(_END) * size / n, share(_LINE) * size / n, share(_PIPE) * size / n, share(_BANG) * size / n, share(_SIGNS) * size / n,
        same / n, max(counts.values()) / n, sum(len(w) > 20 for w in counts) / len(counts), 1 / (1 + n),
        sum(w[:1].isupper() for w in counts) / len(counts), len(set(zip(words, words[1:]))) / n, 0.0,
    ]


class Ranker:
    """A linear utility with its threshold; ``score`` maps the threshold to THRESHOLD."""

    def __init__(self, mean, scale, weights, cut: float, slope: float):
        self.mean, self.scale, self.weights, self.cut, self.slope = mean, scale, weights, cut, slope

    def utility(self, x: np.ndarray) -> np.ndarray:
        # Summed row by row, so that a row's bits don't depend on the rows beside it.
        return (np.clip((x - self.mean) / self.scale, -8, 8) * self.weights).sum(-1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.utility(x) - self.cut) + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bradley_terry(better: np.ndarray, worse: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, steps: int = STEPS) -> Ranker:
    """Fit by Newton's method on deterministic pairs (every row is in about as many)."""
    both = np.concatenate([better, worse])
    if not len(both):
        both = np.zeros((1, len(FEATURES)))
    mean, scale = both.mean(0), both.std(0) + 1e-6
    a, b = (np.clip((v - mean) / scale, -8, 8) for v in (better, worse))
    w = np.zeros(both.shape[1])
    if len(a) and len(b):
        i = np.arange(pairs)
        d = a[i % len(a)] - b[(i * 7919 + i // len(a)) % len(b)]
        for _ in range(steps):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            grad = ridge * w - d.T @ p / pairs
            hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
    return Ranker(mean, scale, w, 0.0, 1.0)


def _flip(bits):
    """Bits of doubles as whole numbers of the same order, and back."""
    return bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)


def _double(key: int) -> float:
    return float(_flip(np.array([key], np.int64)).view(np.float64)[0])


def exact_cut(scored: DataFrame, counts: dict[int, int]) -> float:
    """Middle of the two values around the quantile of ``scored`` (y, key) at the share of bad labels.

    Rows of a class weigh as much as its labels in ``counts``. The value is found 16 bits a
    step by counts alone, so at most 65,536 rows come to the driver, whatever the table holds.
    """
    at, below, m = None, (0, 0), None
    for shift in (48, 32, 16, 0):
        part = scored if at is None else scored.where(F.shiftright("key", shift + 16) == F.lit(at))
        cells = part.groupBy(F.shiftright("key", shift).alias("p")).agg(F.count(F.when(F.col("y") == 0, 1)).alias("n0"), F.count(F.when(F.col("y") == 1, 1)).alias("n1"))
        cells = sorted((r.p, r.n0, r.n1) for r in cells.collect())
        m = m or (sum(c[1] for c in cells), sum(c[2] for c in cells))
        w0, w1, goal = counts[0] * m[1], counts[1] * m[0], counts[0] * m[0] * m[1]  # whole numbers: no rounding
        for at, n0, n1 in cells:
            if (below[0] + n0) * w0 + (below[1] + n1) * w1 >= goal:
                break
            below = below[0] + n0, below[1] + n1
    short = (below[0] + n0) * w0 + (below[1] + n1) * w1 - (w0 if n0 else w1) < goal  # the goal is met by the last row of this value
    other = at
    if short:
        ends = scored.agg(F.min(F.when(F.col("key") > at, F.col("key"))).alias("next"), F.max(F.when(F.col("key") < at, F.col("key"))).alias("last")).first()
        other = ends.next if ends.next is not None else at if n0 + n1 > 1 else ends.last
    return (_double(at) + _double(other)) / 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", rows: int = ROWS) -> Ranker:
    """Rank labels 1 over labels 0: weights from a bounded sample, the threshold from all labelled documents.

    About ``rows`` ids of each label are taken, those of least hash, before any text is
    read; their table is bounded and is broadcast to the texts. Then all ``docs`` are scored
    once, only ids and utilities are joined to ``labels``, and the cut is their exact quantile
    at the share of bad labels, counted over all of ``labels``. Null ids and labels are ignored, an id with both labels
    counts as bad, null texts count as empty; labels of no document and documents without label teach
    nothing. One label only, or an empty table: every score is THRESHOLD.
    """
    shared.ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label).cast("int").alias("y")).where("label_id is not null and y in (0, 1)")
    known = known.groupBy("label_id").agg(F.min("y").alias("y")).withColumn("h", F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    taken = F.lit(False)
    for y, n in counts.items():
        taken = taken | ((F.col("y") == y) & (F.col("h") < int((1 << 30) * min(1.0, rows / n))))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(known.where(taken)), F.col("id") == F.col("label_id"))

    def start():
        return lambda cols: [pa.array([features(t) for t in shared.texts(cols[0])], pa.list_(pa.float64()))]

    got = shared.append_columns(sample.select("y", "h", "text"), ["text"], "x array<double>", start, drop=["text"]).collect()
    got = sorted((r.y, r.h, tuple(r.x)) for r in got)
    sides = [np.array([x for y, _, x in got if y == k]).reshape(-1, len(FEATURES)) for k in (1, 0)]
    ranker = bradley_terry(*sides)
    if not len(sides[0]) or not len(sides[1]):
        return ranker

    def rate():
        def run(cols):
            u = ranker.utility(np.array([features(t) for t in shared.texts(cols[0])])) + 0.0  # no -0.0
            return [pa.array(_flip(u.view(np.int64)))]

        return run

    every = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("id is not null")
    rated = shared.append_columns(every, ["text"], "key long", rate, drop=["text"])
    scored = shared.materialize(rated.join(known, F.col("id") == F.col("label_id")).select("y", "key"), "utilities")
    ranker.cut = exact_cut(scored, counts)
    shared.release(scored)
    ranker.slope = 1.0
    return ranker


def score(docs: DataFrame, ranker: Ranker, text: str = "text", drop=()) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``; null texts score as empty ones.

    A score depends on the row's text alone: equal texts score alike, repeated rows are
    rows of their own. An empty table gives no rows; columns with an output's name are replaced.
    """

    def start():
        def run(cols):
            x = np.array([features(t) for t in shared.texts(cols[0])])
            s = ranker.score(x)
            return [pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]

        return run

    return shared.append_columns(docs, [text], "score double, predicted int", start, drop)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels with crc32(doc_id) mod 5 != 0."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    held = shared.id_crc_mod(F.col("doc_id"), 5) == 0
    labels = shared.table(spark, sf_dir, "labels").where(~held)
    ranker = fit(docs.where(~held), labels)
    return score(docs.select("doc_id", held.alias("held_out"), "text"), ranker, drop=["text"])
